"""Concept and keyword graphs, experiment records, OWL files and configurations on hand-made cases."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pathweave.operators import concept_graphs, graphs, keywords, ontology, records, runs, vectors
from pathweave.sources import readers, writers


@pytest.fixture
def small_ontology(spark):
    return spark.createDataFrame([("a", "Alpha", None, 1.0, 0), ("b", "Beta", ["A "], 2.0, 1), ("c", "Gamma", ["b"], 3.0, 2), ("d", "Delta", [], 0.5, 0)], "id string, name string, parents array<string>, ic double, depth int")


def test_concept_level(spark, rows, small_ontology):
    s = spark.createDataFrame([("x", 0, i, 0) for i in range(2)] + [("x", 1, 2, 1), ("y", 0, 0, 0)], "doc string, section_id long, sentence_index long, section_index long")
    m = spark.createDataFrame([("x", 0, 0, "c"), ("x", 0, 0, "c"), ("x", 2, 1, "d"), ("x", 0, 0, "d"), ("x", 9, 1, "c"), ("x", 1, 0, "zz"), ("x", 1, 0, None)], "doc string, sentence_index long, section_index long, concept_id string")
    k = concept_graphs.summary(m, "doc", small_ontology)
    got = {r["concept_id"]: (r["direct_mention_count"], r["hops"], r["rank"], r["ancestor_of"]) for r in k.collect()}
    assert got == {"c": (3, 0, 3, []), "d": (2, 0, 1, []), "b": (0, 1, 2, ["c"]), "a": (0, 2, 0, ["c"])}
    n = concept_graphs.nodes(graphs.hierarchy_nodes(s, "doc"), k, "doc")
    assert [r["concept_id"] for r in n.where("doc = 'x' and node_type = 'concept'").orderBy("node_index").collect()] == ["a", "d", "b", "c"]
    assert n.where("doc = 'y'").count() == 3
    links = concept_graphs.concept_edges(k, "doc", small_ontology)
    e = concept_graphs.edges(n, m, links, "doc", True)
    # document 0, sections 1 and 2, sentences 3 to 5, concepts a 6, d 7, b 8, c 9
    want = [("mention", 3, 7), ("mention", 3, 9), ("mention", 5, 7), ("ontology", 8, 6), ("ontology", 9, 8), ("same_section", 9, 7), ("same_sentence", 9, 7)]
    assert rows(e, "edge_type", "source", "target") == want
    n2, e2 = concept_graphs.sentence_ontology(n, k, links, "doc")
    assert n2.where("doc = 'x'").count() == 7 and e2.where("edge_type = 'mention'").count() == 1 * 3 + 2 and e2.where("edge_type = 'next'").count() == 2
    keep = concept_graphs.kept_nodes(n, k, "doc", 2, 1)
    assert keep.where("doc = 'x'").count() == 1 + 2 + 1 + 2
    assert concept_graphs.summary(m.limit(0), "doc", small_ontology).count() == 0


def test_concept_sets_and_audit(spark, rows):
    m = spark.createDataFrame([("p", "1"), ("p", "2"), ("q", "2"), ("q", "3"), (None, "4")], "cohort string, concept string")
    assert rows(concept_graphs.concept_sets(m, "cohort", "concept")) == [("p", "q", "1", "left"), ("p", "q", "2", "shared"), ("p", "q", "3", "right")]
    a, b = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "d string, n int"), spark.createDataFrame([("x", 1), ("y", 5)], "d string, n int")
    assert rows(concept_graphs.compare_counts(a, b, "d", "n"), "d", "state") == [("y", "different"), ("z", "missing")]


def test_keyword_graph(spark, rows):
    s = spark.createDataFrame([("x", 7, 0), ("x", 7, 1), ("x", 8, 2), ("y", 1, 0), ("z", 1, 0)], "doc string, section long, sentence_index long")
    f = spark.createDataFrame([("x", 0, "m", 2.0), ("x", 2, "m", 2.0), ("x", 2, "n", 1.5), ("y", 0, "m", 2.0)], "doc string, sentence_index long, keyword string, weight double")
    n, e, st = keywords.word_graph(s, f, "doc", 2)
    assert rows(st) == [("x", "ok"), ("y", "no_stage_keywords"), ("z", "no_stage_keywords")]
    assert [r["node_type"] for r in n.orderBy("node_index").collect()] == ["document", "section", "section", "sentence", "sentence", "word", "word", "word"]
    assert rows(e.where("edge_type = 'parent'"), "source", "target", "weight") == [(0, 1, 1.0), (0, 2, 1.0), (1, 3, 1.0), (2, 4, 1.0), (3, 5, 2.0), (4, 6, 2.0), (4, 7, 1.5)]
    assert rows(e.where("edge_type = 'next'"), "source", "target") == [(1, 2), (3, 4), (6, 7)]


def test_split_sizes(spark):
    assert [spark.range(1).select(runs.test_count(F.lit(n), 0.2)).first()[0] for n in (2, 3, 10, 12, 13)] == [1, 1, 2, 2, 3]
    rows_ = [(f"s{i}", 0) for i in range(97)] + [("t0", 1), ("t1", 1), ("t1", 1), ("t2", 1)]
    x = runs.stratified_split(spark.createDataFrame(rows_, "slide string, label int"), "slide", "label", 0.2)
    got = {(r["label"], r["split"]): r["count"] for r in x.groupBy("label", "split").count().collect()}
    assert got == {(0, "test"): 19, (0, "train"): 78, (1, "test"): 1, (1, "train"): 2}


def test_auc_in_bins(spark):
    df = spark.createDataFrame([(i % 2, (i * 37 % 101) / 7.0) for i in range(400)] + [(1, None), (None, 3.0)], "y int, p double")
    one, many = runs.auc(df, "y", "p", 1).first()[0], runs.auc(df, "y", "p", 16).first()[0]
    assert one == many
    t = spark.createDataFrame([(0, 0.1), (1, 0.4), (0, 0.4), (1, 0.9)], "y int, p double")
    assert runs.auc(t, "y", "p").first()[0] == 0.875 and runs.auc(t.where("y = 1"), "y", "p").first()[0] is None


def test_early_stops_by_windows_and_fold(spark, rows):
    e = spark.createDataFrame([("r", i, m) for i, m in enumerate([0.1, 0.5, 0.4, 0.5, 0.3, 0.9, 0.2])] + [("q", 0, 1.0)], "run string, step long, m double")
    assert rows(runs.early_stops(e, "run", "step", "m", 3)) == rows(runs.early_stops(e, "run", "step", "m", 3, 1e-12)) == [("q", None), ("r", 4)]


def test_record_columns(spark):
    df = spark.createDataFrame([(" a ", "run/split_12/x", "k=1 v=two", "lr=1 lr=3"), ("NaN", "none", "", ""), (None, None, None, None)], "c string, p string, kv string, log string")
    x = df.select(records.cell("c").alias("c"), records.split_index(F.lit(None).cast("string"), F.col("p")).alias("i"), records.last_match("log", r"lr=(\d)").alias("l"), records.insert_type(F.col("p"), "t").alias("r")).collect()
    assert [tuple(r) for r in x] == [("a", 12, "3", "run/t/split_12/x"), ("", None, None, "t/none"), ("", None, None, None)]
    assert df.select(records.key_values("kv").alias("m")).first()["m"] == {"k": "1", "v": "two"}
    with pytest.raises(PySparkException):
        records.common_ids(df.select(F.lit("1").alias("k")), df.select(F.lit("2").alias("k")), "k").collect()


def test_distinct_and_wide_splits(spark, rows):
    x = spark.createDataFrame([(a, k, "test" if (k in "ab") == (a < 2) else "train") for a in range(4) for k in "abcd"], "attempt int, key string, split string")
    assert rows(records.distinct_splits(x, "attempt", "key", "split")) == [(0,), (2,)]
    w = records.wide_splits(x.where("attempt = 0 and key <> 'd'"), "split", "key", ["train", "test"])
    assert rows(w, "idx", "train", "test") == [(0, "c", "a"), (1, "", "b")]
    assert records.subsample(x, "attempt", "key", 2).groupBy("attempt").count().where("count <> 2").count() == 0


def test_blend_and_synonyms(spark, rows):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0])], "c array<double>, l array<double>")
    assert df.select(vectors.blend(F.col("c"), F.col("l"), 0.5).alias("v")).first()["v"] == [4.0, 2.0]
    c = spark.createDataFrame([("1", "Tumor ", ["tumor", "TUMOR", " ", None, "mass"], None)], "id string, name string, synonyms array<string>, source_terminology string")
    assert rows(ontology.synonym_records(c), "term", "origin") == [("TUMOR", "synonym"), ("Tumor", "name"), ("mass", "synonym")]
    d = spark.createDataFrame([("1", "Tumour", True, "disorder"), ("1", "growth", False, ""), ("2", "Knife", True, "object"), ("3", "b", False, ""), ("3", "a", False, "")], "concept_id string, term string, is_full_name boolean, tag string")
    assert rows(ontology.tagged_subset(d, ["disorder"]), "concept_id", "label") == [("1", "Tumour"), ("3", "a")]
    with pytest.raises(ValueError):
        ontology.variant("none", {"all": c})


OWL = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="r" xmlns:owl="o" xmlns:rdfs="s" xmlns:oboInOwl="i" xmlns:obo="b">
<owl:Ontology><owl:versionInfo>24.01d</owl:versionInfo></owl:Ontology>
<owl:Class rdf:about="http://x#C1"><NHC0>C1</NHC0><rdfs:label xml:lang="en">Tumor</rdfs:label><P90>mass</P90><P90>growth</P90><P108>Neoplasm</P108><P97>first</P97><P97>second</P97><P207>CL1</P207></owl:Class>
<owl:Class rdf:about="http://x#C2"><rdfs:label>Carcinoma</rdfs:label><rdfs:subClassOf rdf:resource="http://x#C1"/></owl:Class>
<owl:Class rdf:about="http://x#C3"><NHC0>C3</NHC0></owl:Class>
<owl:Class rdf:about="http://y/DOID_5"><oboInOwl:id>DOID:5</oboInOwl:id><rdfs:label>cancer</rdfs:label><rdfs:subClassOf rdf:resource="http://y/DOID_4"/><oboInOwl:hasExactSynonym>malignancy</oboInOwl:hasExactSynonym><oboInOwl:hasDbXref>NCI:C1</oboInOwl:hasDbXref><obo:IAO_0000115>bad</obo:IAO_0000115></owl:Class>
</rdf:RDF>"""


def test_owl_files(spark, tmp_path):
    p = tmp_path / "x.owl"
    p.write_text(OWL)
    n = {r["id"]: r.asDict() for r in readers.ncit_concepts(spark, str(p)).collect()}
    assert set(n) == {"C1", "C2"} and n["C1"]["name"] == "Tumor" and n["C1"]["synonyms"] == ["mass", "growth", "Neoplasm"] and n["C1"]["definition"] == "first" and n["C1"]["cuis"] == ["CL1"]
    assert n["C2"]["parents"] == ["C1"] and n["C2"]["synonyms"] == []
    d = readers.disease_concepts(spark, str(p)).collect()
    assert [(r["id"], r["name"], r["parents"], r["synonyms"], r["definition"], r["xrefs"], r["match_enabled"]) for r in d] == [("DOID:5", "cancer", ["DOID:4"], ["malignancy"], "bad", ["NCI:C1"], False)]
    assert readers.owl_version(spark, str(p)) == "24.01d"


def test_configuration(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("input_dir: data\nstage:\n  out_path: ../out/x\n  name: data\n  root_root: /abs\n")
    c = readers.yaml_config(str(tmp_path / "c.yaml"))
    assert c == {"input_dir": str(tmp_path / "data"), "stage": {"out_path": str(tmp_path.parent / "out/x"), "name": "data", "root_root": "/abs"}}


def test_sinks_of_logs(spark, tmp_path):
    df = spark.createDataFrame([(1, (0.5, ("x", [1, 2])))], "epoch int, target struct<auc:double,analysis:struct<name:string,sample_details:array<int>>>")
    out = str(tmp_path / "log")
    writers.append_records(writers.compact_log(df), out)
    writers.append_records(writers.compact_log(df), out)
    got = spark.read.json(out)
    assert got.count() == 2 and got.schema["target"].dataType["analysis"].dataType.names == ["name"]
    assert writers.compact_log(df, ("none.here", "epoch")).columns == ["target"]
    assert writers.markdown(df.select("epoch")).splitlines()[2] == "| 1 |"
    with pytest.raises(ValueError):
        writers.markdown(spark.range(5), 3)
