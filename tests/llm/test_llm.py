"""Training-data operators against brute force, round trips and hand-made cases, with nulls, empties and ties."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pathweave.llm import canon, leaks, mixing, neighbors, personal, scans, sentences, toxicity

# --- sentences ---------------------------------------------------------------------------------------------


def section_rows():
    r = random.Random(1)
    en = ["The mass is 4.2 cm.", "Dr. A saw it.", "Is there necrosis?", "No fibrosis is seen.", "See Fig. 3 and No. 4 of the set.", "“Margin clear.”"]
    th = ["ดูภาพที่ 3 ประกอบ", "ไม่พบมะเร็ง", "ตรวจพบเนื้อตาย", "ย้อมให้ผลบวก"]
    rows = []
    for i in range(300):
        pick = [r.choice(en) for _ in range(r.randrange(2, 6))]
        how = i % 3
        text = " ".join(pick) if how == 0 else "\n".join(f"- {x}" for x in pick) if how == 1 else "\n".join(x.rstrip(".?") for x in pick)
        rows.append((i, None, text, "extra"))
    for i in range(300, 400):
        pick = [r.choice(th) for _ in range(4)]
        rows.append((i, None, ("\n" if i % 2 else " ").join(pick), "extra"))
    return rows + [(900, "T", None, ""), (901, "T", "", ""), (902, None, "  \n ", ""), (903, "Title", "Title\nThe mass is 4.2 cm. No fibrosis is seen.", ""), (903, "Title", "Title\nThe mass is 4.2 cm. No fibrosis is seen.", "again")]


@pytest.fixture(scope="module")
def unit_table(spark):
    df = spark.createDataFrame(section_rows(), "section_id long, section_title string, text string, unit string")
    return {k: sorted(v) for k, v in sentences.found(df).groupBy("section_id").agg(F.collect_list("start_char").alias("s")).rdd.map(tuple).collect()}


def test_units(unit_table):
    assert not {900, 901, 902} & set(unit_table)
    assert unit_table[903] == [0, 6, 26]
    data = {i: t for i, _, t, _ in section_rows()}
    right = total = 0
    for i in range(300):
        t = data[i]
        parts = t.split("\n") if i % 3 else re.findall(r"The mass is 4\.2 cm\.|Dr\. A saw it\.|Is there necrosis\?|No fibrosis is seen\.|See Fig\. 3 and No\. 4 of the set\.|“Margin clear\.”", t)
        want, at = [], 0
        for p in parts:
            want.append(t.index(p, at))
            at = want[-1] + len(p)
        right += unit_table[i] == want
        total += 1
    assert right >= 0.97 * total


def test_thai_units_without_marks(unit_table):
    data = {i: t for i, _, t, _ in section_rows()}
    ok = 0
    for i in range(300, 400):
        n = sum(data[i].count(x) for x in ("ดูภาพที่ 3 ประกอบ", "ไม่พบมะเร็ง", "ตรวจพบเนื้อตาย", "ย้อมให้ผลบวก"))
        ok += len(unit_table[i]) == n
    assert ok >= 90


def test_units_cover_the_text(spark):
    df = spark.createDataFrame(section_rows()[:50], "section_id long, section_title string, text string, unit string")
    for r in sentences.units(df, "section_id", "text").join(df.select(F.col("section_id").alias("id"), "text"), "id").collect():
        assert r["text"][r["start_char"] :].startswith(r["unit"]) and r["unit"].strip()


def test_the_model_knows_all_contexts(spark, monkeypatch):
    monkeypatch.setattr(sentences, "CONTEXTS", 3, raising=False)
    texts = ["The mass is seen. The node is seen."] * 50 + ["Siehe Abb. 3 dazu. Kein Tumor liegt vor."] * 4 + ["Rarissimum verbum. Semel dictum."]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = [tuple(x) for b in sentences._count(iter([df.toPandas()])) for x in b.itertuples(index=False)]
    freq = {}
    for before, _, after, _, n in counts:
        freq[before] = freq.get(before, 0) + n
        freq[after] = freq.get(after, 0) + n
    model = sentences.learn(df)
    assert model.words == {w for w, n in freq.items() if n >= sentences.RARE}
    assert {"Abb", "Tumor"} <= model.words and model.word("Rarissimum") == "Xx"


# --- neighbours --------------------------------------------------------------------------------------------


def vectors(seed=3, n=600):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, 64))
    near = base[:100] * 3 + r.normal(size=(100, 64)) * 0.6
    same = np.repeat(base[200:201], 4, axis=0)
    x = np.concatenate([base, near, same])
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    bad = [(9001, None), (9002, []), (9003, [0.0] * 64), (9004, [float("nan")] * 64), (9005, [1.0] * 63), (None, x[0].tolist())]
    return x, rows + rows[:20] + bad


def test_similar_pairs_match_brute_force(spark, monkeypatch):
    x, rows = vectors()
    df = spark.createDataFrame(rows, "k long, v array<float>").withColumn("list", F.lit(1)).withColumn("sim", F.lit("x"))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if s[i, j] >= 0.9}
    pairs = lambda: {(r["a"], r["b"]) for r in neighbors.similar_pairs(df, "k", "v", 0.9).collect()}
    assert pairs() == want and len(want) > 50
    degree = {}
    for i, j in want:
        degree[i], degree[j] = degree.get(i, 0) + 1, degree.get(j, 0) + 1
    got = {r["key"]: (r["rep"], r["links"]) for r in neighbors.links(df, "k", "v", 0.9).collect()}
    assert {k: n for k, (_, n) in got.items()} == degree and got[701][0] == 200
    monkeypatch.setattr(neighbors, "PART_ROWS", 60)  # lists of many parts
    monkeypatch.setattr(neighbors, "LIST_ROWS", 700)
    assert pairs() == want


def test_nearest_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "LIST_ROWS", 64)
    x, rows = vectors()
    df = spark.createDataFrame(rows, "k long, v array<float>")
    got = neighbors.nearest(df, "k", "v", "key % 10 = 0", k=5, probes=8).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = tot = 0
    for q in range(0, len(x), 10):
        s = u @ u[q]
        s[q] = -2
        best = np.sort(s)[-5]
        hit += sum(s[r["b"]] >= best - 1e-5 for r in got if r["a"] == q)
        tot += 5
    assert hit / tot >= 0.9


def test_neighbors_of_nothing(spark):
    e = spark.createDataFrame([], "k long, v array<float>")
    assert neighbors.similar_pairs(e, "k", "v").count() == 0 and neighbors.nearest(e, "k", "v", "true").count() == 0


def test_more_partners_than_any_bound(spark):
    r = np.random.default_rng(5)
    x = np.ones(64) + r.normal(size=(40, 64)) * 0.01
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)] + [(100 + i, [float(1 + i % 2)] * 32 + [1.0] * 32) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, v array<float>")
    near, members = neighbors.similar_classes(df, "k", "v", 0.9)
    assert members.count() == 300 and near.count() == 42 * 41 // 2
    assert {x["links"] for x in neighbors.links(df, "k", "v", 0.9).collect()} == {339}
    top = neighbors.nearest(df, "k", "v", "key = 298", k=5).orderBy("rank").collect()
    assert [x["b"] for x in top] == [100, 102, 104, 106, 108]


def test_vectors_of_any_length(spark):
    rows = [(i, [float(i % 3), 1.0, 0.5]) for i in range(9)] + [(20, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "k long, v array<float>")
    assert neighbors.dimension(df, "v") == 3
    assert {(x["a"], x["b"]) for x in neighbors.similar_pairs(df, "k", "v", 0.999).collect()} == {(i, j) for i in range(9) for j in range(i + 1, 9) if (j - i) % 3 == 0}


# --- personal data -----------------------------------------------------------------------------------------


def test_personal_data(spark):
    texts = [
        "Patient Hope Jarlund (MRN M1234567) underwent lobectomy on 02/17/2018. Lot 4759-9604-1 was re-cut.",
        "Questions go to Ms. Kofi Kelstead (kelrell-renata@northlab.example, tel. 808.555.0104). The Congo red stain highlights fibrosis.",
        "Die Patientin Götz Stübenau, Vers.-Nr. X3384 29021, wohnt Moorgasse 46, 07139 Eichfelden.",
        "Results were mailed to 3567 Larkspur Hollow Road, Flat A, Ashgrove on 2024-06-28. The run tag reads scan@12x23.",
        "患者卢怀瑾，证件号M5726260，住云栖市望江区望月路56号1单元202室。",
        "No personal data. Accession S-22-41294.",
        "",
    ]
    pages = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(99, None, "x"), (0, texts[0], "y")], "page_id long, final_text string, text string")
    sections = spark.createDataFrame([(1, "Dr. Anneliese Cordesand was informed at 8.33 a.m. and can be reached at (312) 555-0110.", "z")], "section_id long, text string, kind string")
    got = {tuple(r) for r in personal.found(pages, sections).collect()}
    at = lambda i, s: texts[i].index(s)
    p = "page_extractions"
    want = {
        (p, 0, "NAME", at(0, "Hope")), (p, 0, "ID", at(0, "M123")), (p, 1, "NAME", at(1, "Kofi")), (p, 1, "EMAIL", at(1, "kelrell")), (p, 1, "PHONE", at(1, "808")), (p, 2, "NAME", at(2, "Götz")),
        (p, 2, "ID", at(2, "X3384")), (p, 2, "ADDRESS", at(2, "Moor")), (p, 3, "ADDRESS", at(3, "3567")), (p, 4, "NAME", 2), (p, 4, "ID", at(4, "M57")), (p, 4, "ADDRESS", at(4, "云栖")), ("sections", 1, "NAME", 4), ("sections", 1, "PHONE", 72),
    }
    assert got == want
    red = {r["row_id"]: r["text"] for r in personal.redacted(pages, sections).where("src = 'page_extractions'").collect()}
    assert red[0] == "Patient [NAME] (MRN [ID]) underwent lobectomy on 02/17/2018. Lot 4759-9604-1 was re-cut."
    assert red[5] == texts[5] and red[6] == ""


def test_personal_data_in_long_and_empty_texts(spark):
    long = "The mass is 4 cm. " * 20000 + "Reviewed by Ivo Bragard, M.D., and others."
    t = spark.createDataFrame([("s", 1, long)], "src string, row_id long, text string")
    assert [(r["kind"], r["start_char"]) for r in personal.spans(t).collect()] == [("NAME", long.index("Ivo"))]
    assert personal.spans(t.limit(0)).count() == 0


def test_the_span_classifier_learns_from_shape():
    r = random.Random(3)
    counts = {}
    for _ in range(2000):
        yes = r.random() < 0.6
        votes = sum(1 << i for i, p in enumerate([0.7, 0.4, 0.7, 0.7, 0.8, 0.8] if yes else [0.3, 0.1, 0.03, 0.3, 0.2, 0.02]) if r.random() < p)
        form = r.choice([5, 9]) if yes and r.random() < 0.9 else r.choice([0, 4])
        counts[votes, form] = counts.get((votes, form), 0) + 1.0
    m = personal.classifier("NAME", counts)
    shape = m["w"][1 + m["bits"] :]
    assert len(shape) == personal.SHAPES and min(shape[5], shape[9]) > 0.1 and max(shape[0], shape[4]) < -0.1
    assert personal.classifier("NAME", {})["w"][1 + m["bits"] :] == [0.0] * personal.SHAPES


def test_names_without_any_cue(spark):
    cued = [f"Patient {a} {b} (MRN M{i}23456{i}) was seen." for i, (a, b) in enumerate([("Hope", "Jarlund"), ("Ivo", "Bragard")] * 3)]
    texts = [*cued, "As told by his cousin, ivo jarlund, the lump grew.", "A parcel for Hope Bragard, 3567 Larkspur Hollow Road, came.", "Sections of fat, tan fibrous tissue, and skin were cut.", "Write to ivo bragard (ivo@north.example) today."]
    t = spark.createDataFrame([("s", i, x) for i, x in enumerate(texts)], "src string, row_id long, text string")
    got = {(r["row_id"], r["text"]) for r in personal.spans(t).where("kind = 'NAME'").collect()}
    assert {x for x in got if x[0] >= 6} == {(6, "ivo jarlund"), (7, "Hope Bragard"), (9, "ivo bragard")}


# --- canonical titles --------------------------------------------------------------------------------------


@pytest.fixture
def titles(spark):
    return spark.createDataFrame([(1, "Final Diagnosis", ["Enddiagnose"]), (2, "Diagnosis", []), (7, "Comment", None)], "title_id int, title string, known_aliases array<string>")


def test_titles(spark, titles):
    values = ["FINAL DIAGNOSIS:", "fiinal dialnosis", "*** Final  Dx ***", "d i a g n o s i s", "Comment (cont'd)", "3. enddiagnose", "cafeteria hours", "???", None, " ", "Final_Diagnosis", "final diagnosis"]
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(values)] + [(0, "FINAL DIAGNOSIS:", 1)], "section_id long, section_title string, title_id int")
    got = {r["section_id"]: r["title_id"] for r in canon.found(df, titles).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 2, 4: 7, 5: 1, 6: -1, 7: -1, 10: 1, 11: 1}
    assert {r["title_id"] for r in canon.found(df, titles.limit(0)).collect()} == {-1}
    assert canon.found(df.limit(0), titles).count() == 0


def test_titles_read_word_by_word(spark, titles):
    many = titles.unionByName(spark.createDataFrame([(8, "Gross Description", []), (9, "Intraoperative Consultation", []), (11, "Lymph Nodes", []), (12, "Patient History", [])], titles.schema))
    values = ["FDX", "Description, Gross", "Gross Desc", "Intraop Consult", "IOC", "LN", "Pt Hx", "Nodal Status", "Invoice Copy", "xx", "7"] + ["Gross Desc"] * 3 + ["Gros Decs"]
    df = spark.createDataFrame(list(enumerate(values)), "section_id long, section_title string")
    got = {r["section_id"]: r["title_id"] for r in canon.found(df, many, {"nodal": "lymph nodes", "hx": "history"}).collect()}
    assert got == {0: 1, 1: 8, 2: 8, 3: 9, 4: 9, 5: 11, 6: 12, 7: 11, 8: -1, 9: -1, 10: -1, 11: 8, 12: 8, 13: 8, 14: 8}


def test_symmetric_deletes_find_all_within_the_bound():
    r = random.Random(2)
    for _ in range(300):
        a = "".join(r.choice("abcd") for _ in range(r.randrange(4, 18)))
        b = list(a)
        for _ in range(canon.edits_allowed(len(a))):
            i = r.randrange(len(b))
            how = r.random()
            if how < 0.35:
                b[i] = r.choice("abcd")
            elif how < 0.6 and len(b) > 3:
                del b[i]
            elif how < 0.8:
                b.insert(i, r.choice("abcd"))
            elif i + 1 < len(b):
                b[i], b[i + 1] = b[i + 1], b[i]
        b = "".join(b)
        d = max(canon.edits_allowed(len(a)), canon.edits_allowed(len(b)))
        if canon.weighted_edits(a, b)[1] <= d:
            assert canon.deletes(a, d) & canon.deletes(b, d)


# --- scanned pages -----------------------------------------------------------------------------------------


def test_glyph_errors():
    assert scans.explains("specimen", "speclmen") == 1 and scans.explains("weighing", "weighirig") == 1 and scans.explains("nodule", "noclule") == 1
    assert scans.explains("margin", "margins") == 0 and scans.explains("a", "a") == 0
    for a, b in (("specimen", "speclmen"), ("weighing", "weighirig"), ("nodule", "noclule"), ("carcinoma", "carcinorna"), ("surgeon", "surgeori")):
        assert scans.skeleton(a) == scans.skeleton(b)


@pytest.mark.parametrize("shared", [200_000, 0])
def test_pages(spark, monkeypatch, shared):
    monkeypatch.setattr(scans, "SHARED", shared)
    r = random.Random(4)
    body = "the specimen is received in formalin and weighing nine grams the margin is clear of carcinoma in all sections examined and well differentiated".split()
    pages = []
    for i in range(200):
        lines = [" ".join(r.choice(body) for _ in range(8)) for _ in range(5)]
        pages.append([i, 1 + i % 3, "\n".join(["North Clinic * REPORT", *lines, f"Page {1 + i % 3} of 3"])])
    pages[0][2] = "North Clinic * REPORT\nthe speclmen is received in for-\nmalin and clear of carcinoma well-\ndifferentiated in sections\n\nsecond part\nPage 1 of 3"
    rows = [(p, n, t, "x") for p, n, t in pages] + [(0, 1, pages[0][2], "y"), (997, 1, None, ""), (998, None, "", ""), (999, 1, "\n\n", "")]
    df = spark.createDataFrame(rows, "page_id long, page_number int, final_text string, kind string")
    got = sorted((x["line_no"], x["kind"]) for x in scans.found(df).where("page_id = 0").collect())
    assert got == [(0, "header"), (1, "hyphen"), (1, "misread"), (6, "page_no")]
    text = {x["paragraph_no"]: x["text"] for x in scans.paragraphs(df).where("page_id = 0").collect()}
    assert text[0].startswith("the specimen is received in formalin and clear of carcinoma well-") and text[1] == "second part"
    assert scans.found(df.limit(0)).count() == 0


def test_pages_with_other_texts(spark):
    rows = [(1, 1, None, "the native layer", "native_text"), (2, 1, " ", "left over", "empty"), (3, 1, "kept text", "other", None), (4, 1, "one version", None, None), (4, 1, "another version\n\nwith more", None, None), (5, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, page_number int, final_text string, native_text string, strategy string")
    got = {}
    for r in scans.paragraphs(df).orderBy("page_id", "paragraph_no").collect():
        got.setdefault(r["page_id"], []).append(r["text"])
    assert got.pop(4) in (["one version"], ["another version", "with more"])
    assert got == {1: ["the native layer"], 3: ["kept text"]} and scans.found(df).count() == 0


def test_page_number_line_outside_the_known_forms():
    line = "Blatt 3"
    edge = {scans.labels_only(scans.masked(line)): True}
    got = scans.Repairer({}, set(), edge).lines(f"The specimen is received fresh.\nNo tumour is seen.\n{line}")
    assert [x[1] for x in got] == ["", "", "page_no"]


def test_masks_and_counts_follow_their_definition():
    """Against the plain rules, on texts with any blanks, digits and letters."""
    r = random.Random(8)
    number = re.compile(r"(?<!\S)[^\s\d]*\d\S*")
    glyphs = [(chr(a), chr(b)) for a, b in scans._SINGLE.items() if a != b] + scans._GLYPH_PAIRS

    def sign(m):
        t = m.group()
        letters = t.translate(scans._NO_DIGITS)
        return t if len(letters) >= 4 and len(t) - len(letters) <= 2 and letters.replace("-", "", 1).isalpha() else "#"

    def plain(text):
        t = number.sub(sign, text.lower())
        for a, b in glyphs:
            t = t.replace(a, b)
        return t.split("\n")

    texts = ["".join(r.choice("aeilrnmcdb1095ä-:.ИΣİé٣ \u00a0\t\x1c\n") for _ in range(r.randrange(60))) for _ in range(3000)]
    assert all(scans.masked_lines(t) == plain(t) for t in texts)
    batch = pa.RecordBatch.from_pydict({"text": texts, "page_number": [r.choice([None, 1, 5, 9]) for _ in texts]})
    got = {x["key"]: (x["n"], x["edge"]) for b in scans._count(iter([batch])) for x in b.to_pylist() if x["key"] is not None}
    want = {}
    for t in texts:
        filled = [i for i, x in enumerate(t.split("\n")) if x.strip()]
        for i, k in enumerate(plain(t)):
            k = scans.labels_only(k.strip())
            n, edge = want.get(k, (0, 0))
            want[k] = n + 1, edge + (i in filled[:3] or i in filled[-2:])
    assert got == {k: v for k, v in want.items() if v[1]}


def test_marked_lines(spark):
    """Marked lines are those of all lines that have a kind, and go without their text."""
    r = random.Random(9)
    marker = scans.Repairer({"rnass": "mass", "speclmen": "specimen"}, {"for|malin"}, {"north clinic": True, "page # of #": False})
    words = ["mass", "rnass", "Speclmen", "for-", "malin", "rnasses", "x", "\n", "\n", "\n\n", "Page 1 of 2", "12", "-\n"]
    for _ in range(500):
        text = " ".join(r.choice(words) for _ in range(r.randrange(30)))
        assert marker.lines(text, marked_only=True) == [x for x in marker.lines(text) if x[1]]
    pages = spark.createDataFrame([(i, 1, f"Clinic of the North\nThe mass is clear.\nNone is seen {i}.\nAll of it is in.\nIt was sent.\nPage 1 of 1") for i in range(20)], "page_id long, page_number int, final_text string")
    marked = scans.lines(pages, marked_only=True)
    assert marked.columns == ["page_id", "line_no", "kinds"]
    assert sorted(map(tuple, marked.collect())) == sorted(map(tuple, scans.lines(pages).where("kinds <> ''").select("page_id", "line_no", "kinds").collect()))


# --- leaks -------------------------------------------------------------------------------------------------


def test_winnowing_guarantee():
    r = random.Random(5)
    for _ in range(100):
        shared = "".join(r.choice("abcdefgh") for _ in range(leaks.K + leaks.W - 1))
        a = "".join(r.choice("uvwxyz") for _ in range(r.randrange(50))) + shared + "".join(r.choice("uvwxyz") for _ in range(r.randrange(50)))
        b = "".join(r.choice("123456") for _ in range(r.randrange(50))) + shared
        assert set(leaks.fingerprints(a)) & set(leaks.fingerprints(b))


def test_every_shared_span_is_found(spark):
    r = random.Random(12)
    say = lambda abc, n: "".join(r.choice(abc) for _ in range(n))
    items, docs, want = [], [], set()
    for i in range(60):
        n = r.choice([16, 25, 37, 40, 200, 900])
        item = say("abcdefgh", n)
        size = r.randrange(leaks.K + leaks.W - 1, min(n, 60) + 1)
        at = r.randrange(n - size + 1)
        items.append((i, item))
        docs.append((i, say("uvwxyz", r.randrange(80)) + " " + item[at : at + size].upper() + ". " + say("uvwxyz", r.randrange(80))))
        want.add((i, i, size))
    items += [(100, "qqq rrr"), (101, "ttttttttttttt!"), (102, "kkk ??"), (103, "0")]
    docs += [(200, "uu qqq, rrr vv"), (201, "v" * 20 + "t" * 13), (202, "t" * 12 + " kk")]
    d, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = leaks.passages(d, it, 0.0).collect()
    length = {i: len(leaks.plain(t)) for i, t in items}
    spans = {(x["doc_id"], x["item_id"]): round(x["span"] * length[x["item_id"]]) for x in got}
    assert all(spans.get((d_, i), 0) >= size for d_, i, size in want)
    assert {x for x in spans if x[1] >= 100} == {(200, 100), (201, 101)}
    brute = {(a, b) for a, t in docs for b, u in items if length[b] >= leaks.SHORTEST and leaks.best_passage(leaks.plain(t), leaks.plain(u), k=leaks.kind_of(leaks.plain(u)).k)[0] >= leaks.SHARE * length[b]}
    assert {tuple(x) for x in leaks.leaks(d, it).collect()} == brute | {(200, 100), (201, 101)}


def test_items_in_blocks(spark, monkeypatch):
    r = random.Random(13)
    items = [(i, " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(30))) for i in range(12)]
    d = spark.createDataFrame([(i, "x " + t[: len(t) // 2] + " y") for i, t in items], "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, leaks.leaks(d, it).collect()))
    monkeypatch.setattr(leaks, "BLOCK_LETTERS", 400)
    assert sorted(map(tuple, leaks.leaks(d, it).collect())) == whole == [(i, i) for i in range(12)]


def test_leaks(spark):
    r = random.Random(6)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 9))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    item, other = say(60), say(60)
    ws = item.split()
    changed = ws[:30]
    changed[10], changed[20] = "however", "such"
    docs = [
        (1, say(40) + " " + item.upper().replace(" ", ", ") + " " + say(40)), (2, say(50) + " " + " ".join(ws[10:40]) + " " + say(20)), (3, say(30) + " ".join(ws[:10])), (4, say(100)),
        (5, say(20) + " " + " ".join(changed) + " " + say(20)), (6, " ".join(ws[:20]) + " (page break) " + " ".join(ws[20:35])), (7, None), (8, ""), (9, "…"), (1, "again " + item),
    ]
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id int")
    it = spark.createDataFrame([(10, item), (11, item), (12, other), (13, None), (14, "")], "item_id long, text string")
    got = {tuple(x) for x in leaks.leaks(d, it).collect()}
    assert got == {(i, j) for i in (1, 2, 5, 6) for j in (10, 11)}
    assert leaks.leaks(d.limit(0), it).count() == leaks.leaks(d, it.limit(0)).count() == 0


def test_leaks_with_altered_words(spark):
    r = random.Random(8)
    han = lambda n: "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(n))
    zh, latin = han(100), " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(50))
    docs = []
    for i in range(40):
        at = r.randrange(50)
        part = list(zh[at : at + 45])
        for j in (9, 20, 31):
            part[j : j + 2] = han(2)
        docs.append((i, han(60) + "".join(part) + "。" + han(60)))
    ws = latin.split()[5:26]
    for j in (5, 10, 15):
        ws[j] = "qrstuvwx"
    docs += [(100, "say " * 20 + " ".join(ws)), (101, han(60) + zh[10:30] + han(60)), (102, "say " * 20 + " ".join(ws[:12]))]
    got = leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, zh), (2, latin)], "item_id long, text string"))
    assert {tuple(x) for x in got.collect()} == {(i, 1) for i in range(40)} | {(100, 2)}


# --- mixing ------------------------------------------------------------------------------------------------


def test_splitting_tree_is_exact():
    counts = np.array([17, 0, 5, 100])
    t = mixing.split(counts, 7, 1)
    assert (t.sum(axis=0) == counts).all() and (t >= 0).all() and abs(t.sum(axis=1) - counts.sum() / 7).max() <= 3
    assert (mixing.split(counts, 7, 1) == t).all()


def test_the_order_of_blocks_is_a_permutation():
    for n in (1, 2, 3, 10, 1000, 4097):
        assert sorted(mixing.place(i, n, 5) for i in range(n)) == list(range(n))
    assert [mixing.place(i, 50, 5) for i in range(50)] != [mixing.place(i, 50, 6) for i in range(50)]


def test_many_shards_hold_the_mixture(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_TOKENS", 60)
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 8)
    rows = [(i, "ab"[i % 2], "word " * (3 + i % 5)) for i in range(4000)]
    m = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), spark.createDataFrame([("a", 0.7, 2), ("b", 0.3, 1)], "source string, target_share double, max_repeat int"))
    per = m.rows.groupBy("shard").agg(F.sum("tokens").alias("t"), F.sum(F.when(F.col("source") == "a", F.col("tokens")).otherwise(0)).alias("a")).collect()
    total, a = sum(r["t"] for r in per), sum(r["a"] for r in per)
    assert abs(a / total - 0.7) < 0.002 and len(per) > 300 and max(r["t"] for r in per) < 60 * 3.5
    # 7.5 blocks a shard, 0.3 of them from b, a fifth empty: (1 - 0.24) ** 7.5 = 0.13 of the shards hold none of b
    assert sum(0 < r["a"] < r["t"] for r in per) > 0.8 * len(per)


def test_quotas():
    qs = mixing.quotas([("a", 0.5, 1), ("b", 0.5, 2), ("none", 0.2, 9)], {"a": 100, "b": 30})
    assert [q.tokens for q in qs] == [60, 60, 0]
    qs = mixing.quotas([("a", 0.5, 1), ("b", 0.5, 2)], {"a": 100, "b": 30}, total=140)
    assert [q.tokens for q in qs] == [80, 60]
    assert mixing.quotas([("a", None, 1)], {"a": 5})[0].tokens == 0


def test_mixture(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_TOKENS", 2000)
    rows = [(i, "big" if i % 3 else "small", "word " * (5 + i % 7), 1) for i in range(900)] + [(5000, None, "x", 1), (5001, "big", None, 1), (5002, "big", "", 1), (5003, "other", "x y", 1)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string, tokens int")
    t = spark.createDataFrame([("big", 0.4, 1), ("small", 0.6, 3), ("gone", 0.1, 2), (None, 0.5, 1)], "source string, target_share double, max_repeat int")
    m = mixing.mix(d, t)
    s = {r["source"]: r for r in mixing.shares(m).collect()}
    assert abs(s["big"]["actual_share"] - 0.4) < 0.01 and abs(s["small"]["actual_share"] - 0.6) < 0.01
    assert s["small"]["repeats"] <= 3 and s["big"]["repeats"] <= 1 and s["gone"]["tokens"] == 0
    o = mixing.ordered(m)
    assert o.count() == o.select("doc_id", "round").distinct().count() == o.select("shard", "position").distinct().count()
    assert [tuple(r) for r in mixing.ordered(mixing.mix(d, t)).orderBy("shard", "position").limit(20).collect()] == [tuple(r) for r in o.orderBy("shard", "position").limit(20).collect()]
    assert mixing.shares(mixing.mix(d.limit(0), t)).where("tokens > 0").count() == 0 and mixing.mix(d, t.limit(0)).rows.count() == 0


# --- abuse -------------------------------------------------------------------------------------------------


def test_restoration():
    known = "the margin is clear report shown idiot bastard moron imbecile dickhead piece of shit cabrón урод"
    ch = toxicity.Channel([(w, 50.0) for w in known.split()], ["bastard", "idiot"])
    assert toxicity.restore("You m0r0n, you b@5t@rd, you i***t, 1mb3c1l3, baaastard!", ch) == "you moron, you bastard, you idiot, imbecile, bastard!"
    assert toxicity.restore("a p i e c e   o f   s h i t here", ch) == "a piece of shit here"
    assert toxicity.restore("CD10 and Ki-67 at 2.4 x 1.0 cm in G2-G6", ch) == "cd10 and ki-67 at 2.4 x 1.0 cm in g2-g6"
    assert toxicity.restore("c@brón cabr0n, ур*д, bаstаrd, baaaaaaaaaaaaaaaaaaaaaaaaaaaaaaastard", ch) == "cabrón cabrón, урод, bastard, bastard"  # two letters of the fifth are Cyrillic


def test_abuse(spark):
    clean = ["The margin is clear.", "The bastard margin, so called by early authors, is the left edge.", "Killer T cells crowd the breast.", "She said the pain was killing her.", "A policy on hate speech and harassment was circulated.", None, ""]
    bad = ["Shut it, you m0r0n, nobody asked you.", "GO KILL YOURSELF, nobody here would miss you.", "These refugees are trash, vermin and filth.", "You worthless b@st@rd.", "Halt die Fresse, du Drecksau."]
    rows = [(i, t, "s" if i % 2 else None, 1.0) for i, t in enumerate(clean + bad)] + [(11, bad[-1], "s", 2.0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, score double")
    lab = spark.createDataFrame([(0, "a", 0), (7, "a", 1), (7, "b", None), (777, "a", 1)], "doc_id long, annotator string, toxic int")
    assert sorted(r["doc_id"] for r in toxicity.found(d, lab).collect()) == [7, 8, 9, 10, 11]
    rates = {r["source"]: r for r in toxicity.rates(d, lab.limit(0)).collect()}
    assert sum(r["documents"] for r in rates.values()) == 12 and sum(r["flagged"] for r in rates.values()) == 5
    assert toxicity.scores(d.limit(0), lab).count() == 0


def abuse_rows():
    r = random.Random(9)
    say = lambda: " ".join(r.choice("the margin node lesion biopsy stain shows clear grade block cells report".split()) for _ in range(25))
    rows, judged, truth = [], [], set()
    for i in range(600):
        bad = i % 20 == 0
        text = say() + (". Go feed the gulls, tin head. " if bad else ". ") + say()
        if bad:
            truth.add(i)
        rows.append((i, text, "s"))
        if i % 2 == 0:
            judged.append((i, "a", int(bad) if i % 34 else 1 - int(bad)))  # some are mistaken
    return rows, judged, truth


def test_abuse_is_learned_from_judgements_alone(spark):
    rows, judged, truth = abuse_rows()
    d, lab = spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame(judged, "doc_id long, annotator string, toxic int")
    found = lambda labels: {r["doc_id"] for r in toxicity.scores(d, labels, lexicon={}).where(f"score >= {toxicity.FLAG}").collect()}
    assert found(lab) == truth and found(lab.limit(0)) == set()


def test_self_training_reaches_unjudged_phrases(spark):
    rows = [(i, "all clear here. you idiot, feed the gulls now. the node is clear", "s") for i in range(6)] + [(10 + i, "all clear here. please feed the gulls now. the node is clear", "s") for i in range(1)] + [(100 + i, "the node is clear. all clear here", "s") for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    lab = spark.createDataFrame([], "doc_id long, annotator string, toxic int")
    assert {r["doc_id"] for r in toxicity.found(d, lab).collect()} == {*range(6), 10}
