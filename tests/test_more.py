"""Keywords, ontology resources, the pipeline and the contract of the entry module."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pathweave import runtime
from pathweave.operators import concepts, keywords, ontology
from pathweave.plans.pipeline import Pipeline


def test_keyword_spans_and_counts(spark, rows):
    df = spark.createDataFrame([(1, "Lymphovascular invasion present; pT2 tumor, 3.5 cm. Lymph nodes negative."), (2, None), (3, "")], "k long, t string")
    s = keywords.spans(df, "k", "t")
    got = {r["keyword"]: r["matched"] for r in s.collect()}
    assert got["lymphovascular_invasion"] == "Lymphovascular invasion" and got["invasive"] == "invasion" and got["pt2"] == "pT2" and got["3.5_cm"] == "3.5 cm"
    per = {r["keyword"]: r["n"] for r in keywords.per_text(s, "k").collect()}
    assert per["lymph_node"] == 1
    assert keywords.select_texts(df, "k", s, 2).count() == 1 and keywords.select_texts(df, "k", s, 99).count() == 0
    assert {r["keyword"]: r["n"] for r in keywords.counts(df, ["k"], "t").collect()}["tumor"] == 1


@pytest.mark.parametrize("name,denied,evidence", [("Carcinoma invasion", False, False), ("Lymph node metastasis", False, True), ("T1 tumor", True, False), ("Finding", True, False), ("Clinical finding", True, False), ("Vascular invasion", False, True), (None, False, False)])
def test_concept_names(spark, name, denied, evidence):
    r = spark.createDataFrame([(name,)], "n string").select(keywords.is_denied(F.col("n")).alias("d"), keywords.is_evidence(F.col("n")).alias("e")).first()
    assert (r["d"], r["e"]) == (denied, evidence)


def test_references(spark):
    r = spark.createDataFrame([("NCI:C123", "DOID_7", "Carcinoma (disorder)", ["b", "A", "a", " ", None, "B"])], "x string, d string, f string, l array<string>")
    got = r.select(ontology.xref("x").alias("x"), ontology.doid("d").alias("d"), ontology.full_name("f").alias("f"), ontology.sorted_distinct("l").alias("l")).first()
    assert tuple(got["x"]) == ("ncit", "C123") and got["d"] == "DOID:7" and tuple(got["f"]) == ("Carcinoma", "disorder") and got["l"] == ["A", "B"]


def concept_table(spark, data):
    return spark.createDataFrame(data, "id string, name string, synonyms array<string>, parents array<string>, source_terminology string, xrefs map<string,array<string>>, match_enabled boolean")


def test_subset_and_bundle(spark, rows):
    c = concept_table(
        spark,
        [
            ("A", "thing", [], [], "N", {"umls": ["1"]}, True),
            ("B", "bad mass", ["carcinoma"], ["A", "X"], "N", {"umls": ["2"]}, True),
            ("X", "unrelated", [], ["A"], "N", {}, True),
            ("S", "malignant growth", ["cancer"], ["S0"], "S", {"umls": ["2"]}, True),
        ],
    )
    assert rows(ontology.subset(c, ("carcinoma",)), "id", "parents") == [("A", []), ("B", ["A", "X"]), ("X", ["A"])]
    pairs = concepts.crosswalk(c, "N", "S").select(F.col("left_id").alias("id"), F.col("right_id").alias("other_id"))
    assert rows(pairs) == [("B", "S")]
    b = {r["id"]: r for r in ontology.bundle(c, pairs).collect()}
    assert set(b) == {"A", "B", "X"} and b["B"]["synonyms"] == ["cancer", "carcinoma", "malignant growth"] and b["B"]["parents"] == ["A", "S0", "X"] and b["B"]["sources"] == ["N", "S"]
    assert rows(ontology.relevant_codes(c, "umls")) == [("1",), ("2",)]
    old, new = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), spark.createDataFrame([("b", 3)], "k string, v int")
    assert rows(ontology.overlay(old, new, "k", "v")) == [("a", 1), ("b", 3)]


def test_crosswalk(spark, rows, monkeypatch):
    """Every pair once, as brute force has it; pairs of concepts with few codes are not made distinct afterwards."""
    rnd = random.Random(5)
    for most, small in ((1, 200_000), (4, 200_000), (9, 200_000), (9, 0)):
        monkeypatch.setattr(concepts, "small_side", lambda df, n, small=small: runtime.small_side(df, n, small))
        monkeypatch.setattr(concepts, "PAIRS", 50, raising=False)
        monkeypatch.setattr(concepts, "CODES", 4, raising=False)
        data = [(rnd.choice([None, *map(str, range(20))]), rnd.choice("NSX"), {s: [rnd.choice([None, "", *"123456789"]) for _ in range(rnd.randint(0, most))] for s in ("u", "m")[: 1 + (most > 1)]}) for _ in range(90)]
        if most == 1:  # a code a concept
            data = [(f"{i}{x}", x, {"u": [str(i % 3)]}) for i in range(60) for x in "NS"]
        own = lambda x: {(i, s, v) for i, t, m in data if t == x for s, vs in m.items() for v in vs if v is not None}  # noqa: B023, E731
        want = {(i, j) for i, *a in own("N") for j, *b in own("S") if a == b}
        got = concepts.crosswalk(spark.createDataFrame(data, "id string, source_terminology string, xrefs map<string,array<string>>"), "N", "S")
        assert len(want) > 100 and rows(got) == rows(spark.createDataFrame(list(want), got.schema))
        above = got._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
        assert most > 1 or "Aggregate" not in above


def test_pipeline(spark):
    page = lambda d, n, t: (d, "c" + d, n, t)
    pages = spark.createDataFrame(
        [page("1", 1, "Clinic\nFINAL DIAGNOSIS:\nInvasive ductal carcinoma. Stage II."), page("1", 2, "Clinic\nCOMMENT\nNecrosis is seen."), page("1", 2, "Clinic\nCOMMENT\nNecrosis is seen."), page("1", 3, "Clinic\nThe end."), page("2", 1, "Nothing here.")],
        "document_id string, case_id string, page_number int, text string",
    )
    onto = spark.createDataFrame([(i, n, list(s), list(p), True) for i, n, s, p in concepts.BUILT_IN], "id string, name string, synonyms array<string>, parents array<string>, match_enabled boolean")
    labels = spark.createDataFrame([("c1", "s1", 1), ("c1", "s2", 0)], "case_id string, slide_id string, label int")
    out = Pipeline(mode="masked").run(pages, onto, labels)
    text = [r["text"] for r in out["sentences"].where("document_id = '1'").orderBy("sentence_index").collect()]
    assert text[0] == "Invasive ductal carcinoma." and not any("Stage" in t or t == "Clinic" for t in text)
    got = {(r["concept_id"], r["direct"]) for r in out["document_concepts"].collect()}
    assert ("ONT:invasive_ductal", True) in got and ("ONT:ductal", False) in got and ("ONT:necrosis", True) in got
    assert out["manifest"].count() == 2 and out["nodes"].where("node_type = 'document'").count() == 2
    assert "nodes" not in Pipeline(stages={"graphs": False}).run(pages, onto, labels)


def test_entry_module(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 60
    assert entry.entry(spark).columns == ["concept_id", "mentions", "sections"]
