"""Concepts, graphs, vectors, runs, readers and streams on small cases."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathweave.operators import concepts as c
from pathweave.operators import graphs as g
from pathweave.operators import runs as r
from pathweave.operators import vectors as v
from pathweave.sources import readers, writers
from pathweave.streaming import logs


@pytest.fixture
def ontology(spark):
    rows = [(i, n, list(s), list(p), True) for i, n, s, p in c.BUILT_IN]
    return spark.createDataFrame(rows, "id string, name string, synonyms array<string>, parents array<string>, match_enabled boolean")


def test_longest_match_wins(spark, rows, ontology):
    t = spark.createDataFrame([(1, "Invasive ductal carcinoma, necrosis"), (2, None), (3, "")], "k int, text string")
    m = c.longest_matches(c.phrase_hits(t, "k", "text", c.lexicon(ontology)), "k")
    assert rows(m, "k", "start", "n", "concept_id") == [(1, 0, 3, "ONT:invasive_ductal"), (1, 3, 1, "ONT:necrosis")]


def test_true_path(spark, rows, ontology):
    m = spark.createDataFrame([("d", "ONT:invasive_ductal")], "doc string, concept_id string")
    assert rows(c.true_path(m, "doc", ontology, 2), "concept_id", "direct", "hops") == [("ONT:carcinoma", False, 2), ("ONT:ductal", False, 1), ("ONT:invasive_ductal", True, 0)]
    assert c.true_path(m, "doc", ontology, None).count() == 4 and c.true_path(m, "doc", ontology, 0).count() == 1


def test_fallback_ontology_links_all_twelve_concepts(spark, rows):
    o = c.fallback(spark)
    assert o.count() == 12 and {x["id"]: x["ic"] for x in o.collect()}["ONT:LYMPH_NODE_INVOLVEMENT"] == 2.7
    known = {i for i, *_ in c.FALLBACK}
    assert all(set(p) <= known for _, _, _, p, _ in c.FALLBACK)
    t = spark.createDataFrame([(1, "Ductal carcinoma; lymphovascular invasion, clear cell RCC, papillary renal cell carcinoma"), (2, "Squamous carcinoma, metastatic: nodal metastasis with involved margin")], "k int, text string")
    m = c.longest_matches(c.phrase_hits(t, "k", "text", c.lexicon(o)), "k")
    assert rows(m, "k", "concept_id") == [
        (1, "ONT:CLEAR_CELL_RENAL_CELL_CARCINOMA"), (1, "ONT:INVASIVE_DUCTAL_CARCINOMA"), (1, "ONT:LYMPHOVASCULAR_INVASION"), (1, "ONT:PAPILLARY_RENAL_CELL_CARCINOMA"),
        (2, "ONT:LYMPH_NODE_INVOLVEMENT"), (2, "ONT:MARGIN_POSITIVE"), (2, "ONT:METASTASIS"), (2, "ONT:SQUAMOUS_CELL_CARCINOMA"),
    ]


def test_every_phrase_length_is_sought(spark):
    lex = spark.createDataFrame([(" ".join(f"w{n}x{i}" for i in range(n)), n, f"c{n}") for n in range(1, 104)], "phrase string, n int, concept_id string")
    t = spark.createDataFrame([(n, p) for p, n, _ in lex.collect()], "k int, text string")
    assert c.phrase_hits(t, "k", "text", lex).count() == 103


def test_information_content_of_a_chain(spark):
    df = spark.createDataFrame([("a", []), ("b", ["a"]), ("c", ["b"])], "id string, parents array<string>")
    assert {x["id"]: x["ic"] for x in c.information_content(df).collect()} == {"a": 0.287682, "b": 0.693147, "c": 1.386294}
    assert {x["id"]: x["depth"] for x in c.longest_depths(df).collect()} == {"a": 0, "b": 1, "c": 2}


def test_co_occurrence(spark, rows):
    m = spark.createDataFrame([("d", 0, "x"), ("d", 0, "y"), ("d", 1, "x"), ("d", 1, "y"), ("d", 1, "z"), ("d", 1, None)], "doc string, s int, c string")
    assert rows(c.co_occurrence(m, "doc", ["s"], "c")) == [("d", "x", "y", 2), ("d", "x", "z", 1), ("d", "y", "z", 1)]


def test_hops_on_a_path(spark, rows):
    e = spark.createDataFrame([("d", 1, 2), ("d", 2, 3), ("d", 3, 4)], "doc string, source int, target int")
    assert rows(g.hops(e, "doc")) == [("d", 1, 1, 1, 1), ("d", 2, 2, 1, 0), ("d", 3, 2, 1, 0), ("d", 4, 1, 1, 1)]


def test_graph_filters(spark, rows):
    n = spark.createDataFrame([("d", i, t) for i, t in enumerate(["document", "section", "sentence", "sentence"])], "doc string, node_index int, node_type string")
    e = g.weigh(spark.createDataFrame([("d", 0, 1, "parent"), ("d", 1, 2, "parent"), ("d", 1, 3, "parent"), ("d", 2, 3, "next")], "doc string, source int, target int, edge_type string"))
    kn, ke = g.induced(n, e, n.where("node_index <> 2"), "doc")
    assert rows(ke, "source", "target", "edge_type") == [(0, 1, "parent"), (1, 2, "parent")] and kn.count() == 3
    assert g.both_ways(e, ["next"]).count() == 2
    assert rows(g.with_self_loops(n, e.limit(0), "doc"), "source", "target") == [(0, 0)]
    assert g.drop_out(e, "doc", 0.0).count() == 4 and g.drop_out(e, "doc", 1.0).count() == 0


def test_vectors(spark, rows):
    df = spark.createDataFrame([("g", 1, [3.0, 4.0]), ("g", 2, [0.0, 1.0]), ("g", 3, [1.0, 0.0])], "grp string, k int, vec array<float>")
    assert rows(v.mean_vector(df, ["grp"], "vec")) == [("g", 0, pytest.approx(4 / 3)), ("g", 1, pytest.approx(5 / 3))]
    assert rows(v.nearest_in_group(df, "grp", "k", "vec", 1)) == [("g", 1, 2, 0.8), ("g", 2, 1, 0.8), ("g", 3, 1, 0.6)]
    assert v.symmetric(v.nearest_in_group(df, "grp", "k", "vec", 1), "grp").count() == 4
    bad = spark.createDataFrame([([0.0, 0.0],), ([float("nan"), 1.0],), ([1.0],), (None,), ([1.0, 2.0],)], "v array<float>")
    assert [x["u"] for x in bad.select(v.usable("v", 2).alias("u")).collect()] == [False, False, False, False, True]
    assert df.select(v.attention_entropy(F.array(F.lit(0.5), F.lit(0.5))).alias("h")).first()["h"] == pytest.approx(1.0)
    e = v.hash_embedding(df.select("grp"), "grp", 8).collect()
    assert e[0]["embedding"] == e[1]["embedding"] and np.linalg.norm(e[0]["embedding"]) == pytest.approx(1.0)
    assert v.k_means(df, "grp", "k", "vec", 2).select("cluster").distinct().count() == 2
    same = df.select("vec")
    assert v.mmd(same, same, "vec").first()["mmd"] >= 0


def test_discrepancy_takes_all_pairs(spark):
    r = np.random.default_rng(5)
    x, y = r.normal(size=(400, 4)).round(3), (r.normal(size=(100, 4)) + 0.7).round(3)
    d2 = lambda p, q: ((p[:, None] - q[None]) ** 2).sum(2)
    z = np.concatenate([x, y])
    all_ = np.sort(d2(z, z)[np.triu_indices(len(z), 1)])
    m = all_[all_ > 0][(np.count_nonzero(all_ > 0) - 1) // 2]
    k = lambda d: np.mean([np.exp(-d / (2 * m * s)) for s in (0.25, 0.5, 1.0, 2.0, 4.0)])
    inside = lambda p: k(d2(p, p)[np.triu_indices(len(p), 1)])
    frame = lambda p: spark.createDataFrame([(q.tolist(),) for q in p], "vec array<double>")
    assert v.mmd(frame(x), frame(y), "vec").first()["mmd"] == pytest.approx(inside(x) + inside(y) - 2 * k(d2(x, y)), abs=2e-6)
    assert v.mmd(frame(x[:1]), frame(x[:1]), "vec").first()["mmd"] == 0


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.4), (0, 0.4), (1, 0.9), (None, 0.5)], "y int, s double")
    assert r.auc(df, "y", "s").first()["auc"] == 0.875
    assert r.auc(df.where("y = 1"), "y", "s").first()["auc"] is None


def test_largest_remainder(spark, rows):
    df = spark.createDataFrame([(0, 7), (1, 3)], "g int, n int")
    assert rows(r.allocate_tests(df, "g", "n", 3), "g", "test") == [(0, 2), (1, 1)]


def test_runs(spark, rows):
    e = spark.createDataFrame([("a", 1, 0.7, False), ("a", 2, 0.9, False), ("a", 3, 0.9, False), ("b", 1, 0.5, False), ("b", 2, 0.4, True)], "run string, step long, m double, fin boolean")
    assert rows(r.best_or_final(e, "run", "step", "m", "fin"), "run", "step") == [("a", 2), ("b", 2)]
    assert rows(r.best_or_final(e, "run", "step", "m", "fin", "max"), "run", "step") == [("a", 2), ("b", 1)]
    assert [x["new_best"] for x in r.running_best(e, "run", "step", "m").where("run = 'a'").orderBy("step").collect()] == [True, True, False]
    assert rows(r.early_stops(e, "run", "step", "m", 1)) == [("a", 3), ("b", 2)]
    one = spark.createDataFrame([("x", 0.5)], "k string, v double")
    assert r.mean_std(one, ["k"], "v").first()["text"] == "0.5000 +/- 0.0000" and r.mean_std(one, ["k"], "v", None).first()["text"] == "0.5000"
    d = spark.createDataFrame([("g", "base", 0, 0.7), ("g", "base", 1, 0.8), ("g", "new", 0, 0.9), ("g", "new", 2, 0.6)], "g string, m string, s int, v double")
    got = r.paired_delta(d, "g", "m", "s", "v", "base").first()
    assert (got["n"], round(got["mean"], 6), got["wins"], got["std"]) == (1, 0.2, 1, None)


def test_manifest_is_many_to_many(spark):
    lab = spark.createDataFrame([("c", "s1", 0), ("c", "s2", 1), ("x", "s3", 0)], "case_id string, slide_id string, label int")
    gr = spark.createDataFrame([("c", "d1"), ("c", "d2")], "case_id string, document_id string")
    sp = spark.createDataFrame([("slide", "s1", "test"), ("case", "c", "train")], "kind string, key string, split string")
    m = r.manifest(lab, gr, sp).collect()
    assert len(m) == 4 and {(x["slide_id"], x["split"]) for x in m} == {("s1", "test"), ("s2", "train")}


def test_audit_percentile(spark):
    a = r.audit(spark.range(1, 21).select(F.col("id").alias("x")), "x").first()
    assert (a["p95"], a["mean"], a["max"]) == (19.0, 10.5, 20.0)
    assert r.audit(spark.range(0).select(F.col("id").alias("x")), "x").first()["mean"] == 0


def test_readers_and_writers(spark, rows, tmp_path):
    rec = {"C1": {"name": "one", "parents": ["C0"]}, "C0": {"name": "root"}}
    shapes = {"a": rec, "b": {"concepts": [{"id": k, **x} for k, x in rec.items()]}, "c": [{"concept_id": k, **x} for k, x in rec.items()] + [{"name": "no id"}]}
    for n, j in shapes.items():
        (tmp_path / f"{n}.json").write_text("﻿" + json.dumps(j))
        assert rows(readers.ontology(spark, str(tmp_path / f"{n}.json")), "id", "name") == [("C0", "root"), ("C1", "one")], n
    (tmp_path / "log.jsonl").write_text('{"type":"epoch","epoch":1,"target":{"auc":0.5}}\nnot json\n\n{"type":"final_evaluation","epoch":2}\n')
    assert readers.last_record(readers.run_log(spark, str(tmp_path / "log.jsonl")), "run", "epoch").first()["type"] == "final_evaluation"
    (tmp_path / "wide.csv").write_text("idx,train,test\n0,s1,s3\n1,s2,\n")
    assert rows(readers.splits_csv(spark, str(tmp_path / "wide.csv")), "kind", "key", "split") == [("slide", "s1", "train"), ("slide", "s2", "train"), ("slide", "s3", "test")]
    (tmp_path / "labels.csv").write_text("﻿case_id,slide_id,label\nc,s,1\n")
    assert rows(readers.labels_csv(spark, str(tmp_path / "labels.csv"))) == [("c", "s", 1)]
    (tmp_path / "bad.csv").write_text("a\n1\n")
    with pytest.raises(ValueError):
        readers.labels_csv(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "x.xml").write_text('<?xml version="1.0"?><r xmlns:q="u"><q:bcr_patient_barcode>ab-1</q:bcr_patient_barcode><q:pathologic_stage>Stage II</q:pathologic_stage></r>')
    assert rows(readers.clinical_stages(spark, str(tmp_path))) == [("AB-1", "Stage II")]
    s = spark.createDataFrame([("d", 0, "T", "a"), ("d", 1, "T", " "), ("d", 2, "U", "b")], "doc string, sentence_index int, section_title string, text string")
    assert writers.sentence_text(s, "doc").first()["text"] == "[T]\n0000\ta\n0001\t[EMPTY]\n[U]\n0002\tb"
    writers.csv_table(s, str(tmp_path / "out"), ("doc", "missing", "text"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns == ["doc", "missing", "text"]
    writers.clean_json(s, str(tmp_path / "js"), ["section_title"])
    assert spark.read.json(str(tmp_path / "js")).count() == 3
    assert writers.markdown(s.limit(1)).startswith("| doc |")


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "2024-01-01 00:00:00", 1.0), ("a", 2, "2024-01-01 00:10:00", 0.5), ("a", 3, "2024-01-02 00:00:00", 0.4), ("b", 4, "2024-01-03 00:00:00", 2.0)], "run string, step long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    src = logs.read_events(spark, str(tmp_path / "in"), df.schema)
    got = logs.drain(logs.tumbling(src, "ts", "1 hour", "1 hour"), "tumbled", str(tmp_path / "cp1"))
    assert {(str(x["start"]), x["n"]) for x in got.collect()} == {("2024-01-01 00:00:00", 2), ("2024-01-02 00:00:00", 1)}
    es = logs.drain(logs.early_stopping(src, "run", "step", "value", 2), "stopping", str(tmp_path / "cp2"), "update")
    assert {(x["run"], x["stopped"]) for x in es.collect()} == {("a", True), ("b", False)}
    assert logs.sessions(df, "ts", "1 hour", "1 hour", "run").count() == 3
    assert math.isfinite(df.count())
