"""Queries of the concept level of document graphs, over the sections' sentences and the fallback ontology."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import concept_graphs as cg
from ..operators import concepts as c
from ..operators import graphs as g
from ..registry import query
from ..runtime import cut, table
from .cleaning import SENTENCES, sentences

# The ontology of the check, stated apart from the operator's: id, name, parent, ic, depth, phrases.
_ONTOLOGY = [
    ("ONT:NEOPLASM", "Neoplasm", None, 1.1, 0, ["neoplasm", "tumor", "tumour"]),
    ("ONT:CARCINOMA", "Carcinoma", "ONT:NEOPLASM", 1.7, 1, ["carcinoma"]),
    ("ONT:ADENOCARCINOMA", "Adenocarcinoma", "ONT:CARCINOMA", 2.2, 2, ["adenocarcinoma"]),
    ("ONT:SQUAMOUS_CELL_CARCINOMA", "Squamous Cell Carcinoma", "ONT:CARCINOMA", 2.4, 2, ["squamous cell carcinoma", "squamous carcinoma"]),
    ("ONT:INVASIVE_DUCTAL_CARCINOMA", "Invasive Ductal Carcinoma", "ONT:CARCINOMA", 2.6, 2, ["invasive ductal carcinoma", "ductal carcinoma"]),
    ("ONT:CLEAR_CELL_RENAL_CELL_CARCINOMA", "Clear Cell Renal Cell Carcinoma", "ONT:CARCINOMA", 2.8, 2, ["clear cell renal cell carcinoma", "clear cell renal carcinoma", "clear cell rcc", "clear cell carcinoma"]),
    ("ONT:PAPILLARY_RENAL_CELL_CARCINOMA", "Papillary Renal Cell Carcinoma", "ONT:CARCINOMA", 2.8, 2, ["papillary renal cell carcinoma", "papillary renal carcinoma", "papillary rcc"]),
    ("ONT:METASTASIS", "Metastasis", "ONT:NEOPLASM", 2.1, 1, ["metastasis", "metastatic", "metastases"]),
    ("ONT:NECROSIS", "Necrosis", "ONT:NEOPLASM", 1.9, 1, ["necrosis", "necrotic"]),
    ("ONT:LYMPHOVASCULAR_INVASION", "Lymphovascular Invasion", "ONT:NEOPLASM", 2.5, 1, ["lymphovascular invasion", "vascular invasion", "lymphatic invasion"]),
    ("ONT:MARGIN_POSITIVE", "Positive Margin", "ONT:NEOPLASM", 2.3, 1, ["positive margin", "margin involved", "involved margin"]),
    ("ONT:LYMPH_NODE_INVOLVEMENT", "Lymph Node Involvement", "ONT:METASTASIS", 2.7, 2, ["lymph node involvement", "lymph node metastasis", "nodal metastasis", "positive lymph node"]),
]
_LEX = ", ".join(f"('{i}', '{p}', {len(p.split())})" for i, *_, ps in _ONTOLOGY for p in ps)
_ONT = ", ".join(f"('{i}', '{n}', {repr(p) if p else 'NULL'}, {ic}, {d})" for i, n, p, ic, d, _ in _ONTOLOGY)
_ROWS = f"""{SENTENCES},
o AS (SELECT document_id, section_id, row_number() OVER (PARTITION BY document_id ORDER BY section_index, section_id, section_sentence_index) - 1 AS si, regexp_extract_all(lower(text), '[a-z0-9]+') AS ts FROM sv),
lex AS (SELECT * FROM (VALUES {_LEX}) v(cid, phrase, n)), ont AS (SELECT * FROM (VALUES {_ONT}) v(cid, name, parent, ic, depth)),
st AS (SELECT document_id, section_id, si, n, unnest(range(0, greatest(len(ts) - n + 1, 1))) AS start, ts FROM o, (SELECT DISTINCT n FROM lex) WHERE len(ts) > 0),
h AS (SELECT document_id, section_id, si, start, st.n, cid FROM st JOIN lex ON lex.n = st.n AND lex.phrase = array_to_string(ts[start + 1:start + st.n], ' ')),
m AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h x WHERE x.document_id = h.document_id AND x.si = h.si AND x.n > h.n AND x.start < h.start + h.n AND h.start < x.start + x.n)),
a1 AS (SELECT m.*, cid AS key, NULL AS below FROM m UNION ALL SELECT m.*, ont.parent, m.cid FROM m JOIN ont USING (cid) WHERE ont.parent IS NOT NULL
  UNION ALL SELECT m.*, p.parent, m.cid FROM m JOIN ont USING (cid) JOIN ont p ON p.cid = ont.parent WHERE p.parent IS NOT NULL),
k0 AS (SELECT document_id, key AS cid, count(*) FILTER (below IS NULL) AS direct, count(DISTINCT si) AS sentences, count(DISTINCT section_id) AS sections FROM a1 GROUP BY ALL),
k AS (SELECT k0.*, name, ic, depth, row_number() OVER (PARTITION BY document_id ORDER BY depth, lower(name), cid) - 1 AS rank FROM k0 JOIN ont USING (cid)),
nd AS (SELECT DISTINCT document_id, 'document' AS node_type, 0 AS level, 0 AS ordinal, NULL AS section, NULL AS cid FROM o UNION ALL SELECT document_id, 'section', 1, min(si), section_id, NULL FROM o GROUP BY document_id, section_id
  UNION ALL SELECT document_id, 'sentence', 2, si, section_id, NULL FROM o UNION ALL SELECT document_id, 'concept', 3, rank, NULL, cid FROM k),
nodes AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY level, ordinal) - 1 AS i FROM nd),
e AS (SELECT DISTINCT a.document_id, a.i AS source, b.i AS target, 'mention' AS edge_type, 1.0 AS weight FROM m JOIN nodes a ON a.document_id = m.document_id AND a.node_type = 'sentence' AND a.ordinal = m.si JOIN nodes b ON b.document_id = m.document_id AND b.cid = m.cid
  UNION ALL SELECT a.document_id, a.i, b.i, 'ontology', 0.7 FROM nodes a JOIN ont USING (cid) JOIN nodes b ON b.document_id = a.document_id AND b.cid = ont.parent),
pr AS (SELECT DISTINCT x.document_id, x.cid AS a, y.cid AS b, x.si = y.si AS same FROM m x JOIN m y ON x.document_id = y.document_id AND x.section_id = y.section_id AND x.cid < y.cid),
co AS (SELECT DISTINCT pr.document_id, a.i AS source, b.i AS target, t.k AS edge_type, t.w AS weight FROM pr JOIN nodes a ON a.document_id = pr.document_id AND a.cid = pr.a JOIN nodes b ON b.document_id = pr.document_id AND b.cid = pr.b
  JOIN (VALUES ('same_sentence', 0.25), ('same_section', 0.1)) t(k, w) ON t.k = 'same_section' OR pr.same),
hp AS (SELECT a.document_id, a.i AS source, b.i AS target, 'parent' AS edge_type, 1.0 AS weight FROM nodes a JOIN nodes b USING (document_id) WHERE a.node_type = 'document' AND b.node_type = 'section'
  UNION ALL SELECT a.document_id, a.i, b.i, 'parent', 1.0 FROM nodes a JOIN nodes b ON a.document_id = b.document_id AND a.section = b.section WHERE a.node_type = 'section' AND b.node_type = 'sentence'
  UNION ALL SELECT * FROM (SELECT document_id, i, lead(i) OVER (PARTITION BY document_id, node_type ORDER BY ordinal) AS t, 'next', 0.25 FROM nodes WHERE node_type IN ('section', 'sentence')) WHERE t IS NOT NULL)
"""


class _Graphs:
    """The tables that the queries share; the sentences and mentions are computed once."""

    def __init__(self, spark: SparkSession, d: str):
        w = Window.partitionBy("document_id").orderBy("section_index", "section_id", "section_sentence_index")
        s = cut(sentences(spark, d).select("document_id", "section_id", (F.row_number().over(w) - 1).alias("sentence_index"), "text"))
        self.sentences = s.withColumn("section_index", F.col("section_id").cast("long"))
        self.ontology = c.fallback(spark)
        depths = c.longest_depths(self.ontology).withColumnRenamed("id", "of")
        self.ontology = cut(self.ontology.join(depths, F.col("id") == F.col("of")).drop("of"))
        keyed = self.sentences.withColumn("k", F.concat_ws("#", "document_id", "sentence_index"))
        hits = c.longest_matches(c.phrase_hits(keyed, "k", "text", c.lexicon(self.ontology)), "k")
        self.mentions = cut(hits.join(keyed.select("k", "document_id", "sentence_index", "section_index"), "k").drop("k"))
        self.concepts = cut(cg.summary(self.mentions, "document_id", self.ontology))
        self.links = cg.concept_edges(self.concepts, "document_id", self.ontology)
        tree = g.hierarchy_nodes(s, "document_id")
        self.nodes = cut(cg.nodes(tree, self.concepts, "document_id"))

    def edges(self, co_occurrence: bool = True) -> DataFrame:
        return cg.edges(self.nodes, self.mentions, self.links, "document_id", co_occurrence)


@query(f"WITH {_ROWS} SELECT document_id, cid AS concept_id, name AS concept_name, CAST(depth AS INTEGER) AS depth, CAST(ic AS DOUBLE) AS ic, direct AS direct_mention_count, CAST(sentences AS INTEGER) AS sentence_count, CAST(sections AS INTEGER) AS section_count, direct > 0 AS is_direct, CAST(rank AS INTEGER) AS rank FROM k")
def document_concepts(spark: SparkSession, d: str) -> DataFrame:
    """The concepts of every report with ancestors, counts and order."""
    x = _Graphs(spark, d).concepts
    return x.select("document_id", "concept_id", "concept_name", "depth", "ic", "direct_mention_count", F.size("sentence_indices").alias("sentence_count"), F.size("section_indices").alias("section_count"), "is_direct", "rank")


@query(f"WITH {_ROWS} SELECT document_id, CAST(i AS INTEGER) AS node_index, node_type, cid AS concept_id FROM nodes")
def concept_graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Numbered nodes of every report's graph with its concepts."""
    return _Graphs(spark, d).nodes.select("document_id", F.col("node_index").cast("int").alias("node_index"), "node_type", "concept_id")


@query(f"WITH {_ROWS} SELECT document_id, CAST(source AS INTEGER) AS source, CAST(target AS INTEGER) AS target, edge_type, CAST(weight AS DOUBLE) AS weight FROM (SELECT * FROM e UNION ALL SELECT * FROM co)")
def concept_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """Mention, ontology and co-occurrence edges of every report's graph."""
    return _Graphs(spark, d).edges().select("document_id", F.col("source").cast("int").alias("source"), F.col("target").cast("int").alias("target"), "edge_type", "weight")


@query(
    f"""WITH {_ROWS}, n AS (SELECT document_id, count(*) AS n, count(*) FILTER (node_type = 'concept') AS c FROM nodes GROUP BY document_id),
x AS (SELECT document_id, count(*) AS m, count(*) FILTER (edge_type = 'mention') AS mm, count(*) FILTER (edge_type = 'ontology') AS oo FROM (SELECT * FROM e UNION ALL SELECT * FROM co UNION ALL SELECT * FROM hp) GROUP BY document_id),
s AS (SELECT document_id, round(avg(CAST(ic AS DOUBLE)), 6) AS mean_ic, round(CAST(max(ic) AS DOUBLE), 6) AS max_ic, round(avg(depth), 6) AS mean_depth, round(avg(direct), 6) AS mean_mentions FROM k GROUP BY document_id)
SELECT n.document_id, round(c / n, 6) AS concept_share, round(coalesce(mm / m, 0), 6) AS mention_edges, round(coalesce(oo / m, 0), 6) AS ontology_edges, coalesce(mean_ic, 0) AS mean_ic, coalesce(max_ic, 0) AS max_ic, coalesce(mean_depth, 0) AS mean_depth, coalesce(mean_mentions, 0) AS mean_mentions, round(ln(1 + n), 6) AS log_nodes, round(ln(1 + coalesce(m, 0)), 6) AS log_edges
FROM n LEFT JOIN x USING (document_id) LEFT JOIN s USING (document_id)"""
)
def concept_graph_descriptor(spark: SparkSession, d: str) -> DataFrame:
    """Structure of every report's graph with its concepts."""
    x = _Graphs(spark, d)
    all_ = x.edges().unionByName(g.hierarchy_edges(x.nodes.where("node_type <> 'concept'"), "document_id"))
    y = cg.describe(x.nodes, all_, x.concepts, "document_id")
    return y.select("document_id", "concept_share", "mention_edges", "ontology_edges", "mean_ic", "max_ic", "mean_depth", "mean_mentions", "log_nodes", "log_edges")


@query(
    f"""WITH {_ROWS}, sn AS (SELECT document_id, si, NULL AS cid, row_number() OVER (PARTITION BY document_id ORDER BY si) - 1 AS i FROM o), ct AS (SELECT document_id, count(*) AS n FROM o GROUP BY document_id),
kn AS (SELECT k.document_id, k.cid, n + rank AS i FROM k JOIN ct USING (document_id))
SELECT document_id, CAST(source AS INTEGER) AS source, CAST(target AS INTEGER) AS target, edge_type, CAST(weight AS DOUBLE) AS weight FROM (
SELECT document_id, i AS source, lead(i) OVER (PARTITION BY document_id ORDER BY i) AS target, 'next' AS edge_type, 0.25 AS weight FROM sn
UNION ALL SELECT DISTINCT a.document_id, sn.i, kn.i, 'mention', 1.0 FROM a1 a JOIN sn ON sn.document_id = a.document_id AND sn.si = a.si JOIN kn ON kn.document_id = a.document_id AND kn.cid = a.key
UNION ALL SELECT a.document_id, a.i, b.i, 'ontology', 0.7 FROM kn a JOIN ont USING (cid) JOIN kn b ON b.document_id = a.document_id AND b.cid = ont.parent) WHERE target IS NOT NULL"""
)
def sentence_ontology_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the graph of sentences and concepts of every report."""
    x = _Graphs(spark, d)
    _, e = cg.sentence_ontology(x.nodes, x.concepts, x.links, "document_id")
    return e.select("document_id", F.col("source").cast("int").alias("source"), F.col("target").cast("int").alias("target"), "edge_type", "weight")


@query(
    f"""WITH {_ROWS}, sc AS (SELECT document_id, cid, row_number() OVER (PARTITION BY document_id ORDER BY round(direct + 0.1 * ic + 0.05 * depth, 9) DESC, cid) AS r FROM k),
kp AS (SELECT nodes.document_id, nodes.i FROM nodes LEFT JOIN sc ON sc.document_id = nodes.document_id AND sc.cid = nodes.cid WHERE node_type IN ('document', 'section') OR node_type = 'sentence' AND ordinal < 20 OR node_type = 'concept' AND r <= 3),
ee AS (SELECT * FROM e UNION ALL SELECT * FROM co), kk AS (SELECT ee.document_id FROM ee JOIN kp a ON a.document_id = ee.document_id AND a.i = ee.source JOIN kp b ON b.document_id = ee.document_id AND b.i = ee.target)
SELECT n.document_id, n AS nodes_before, coalesce(na, 0) AS nodes_after, coalesce(m, 0) AS edges_before, coalesce(ma, 0) AS edges_after, round(coalesce(na, 0) / n, 6) AS nodes_kept FROM (SELECT document_id, count(*) AS n FROM nodes GROUP BY document_id) n
LEFT JOIN (SELECT document_id, count(*) AS na FROM kp GROUP BY document_id) USING (document_id) LEFT JOIN (SELECT document_id, count(*) AS m FROM ee GROUP BY document_id) USING (document_id) LEFT JOIN (SELECT document_id, count(*) AS ma FROM kk GROUP BY document_id) USING (document_id)"""
)
def graph_filter_statistics(spark: SparkSession, d: str) -> DataFrame:
    """What the three heaviest concepts and first twenty sentences leave of every report's concept graph."""
    x = _Graphs(spark, d)
    keep = cut(cg.kept_nodes(x.nodes, x.concepts, "document_id", 3, 20))
    e = cut(x.edges())
    n2, e2 = g.induced(x.nodes, e, keep, "document_id")
    return cg.filter_statistics(x.nodes, n2, e, e2, "document_id")


@query(
    f"""WITH {_ROWS}, dd AS (SELECT DISTINCT document_id FROM reports), q AS (SELECT dd.document_id, count(DISTINCT o.si) AS s FROM dd LEFT JOIN o USING (document_id) GROUP BY dd.document_id),
z AS (SELECT q.*, coalesce(n, 0) AS n, coalesce(ex, 0) AS ex FROM q LEFT JOIN (SELECT document_id, count(*) AS n, max(CASE WHEN direct = 0 THEN 1 ELSE 0 END) AS ex FROM k GROUP BY document_id) USING (document_id))
SELECT count(*) AS documents, count(*) FILTER (s = 0) AS zero_sentences, count(*) FILTER (n = 0) AS zero_concepts, count(*) FILTER (ex = 1) AS expanded, (SELECT string_agg(document_id, ',' ORDER BY document_id) FROM (SELECT document_id FROM z WHERE n = 0 ORDER BY document_id LIMIT 25)) AS without_concept FROM z"""
)
def concept_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Reports without sentences or concepts; the first 25 by id are listed."""
    x = _Graphs(spark, d)
    return cg.coverage(table(spark, d, "reports"), x.sentences, x.concepts, "document_id").withColumn("without_concept", F.array_join("without_concept", ","))


_COHORTS = "gn AS (SELECT DISTINCT node_key, document_id, concept_id FROM graph_nodes WHERE node_type = 'concept' AND concept_id IS NOT NULL), rr AS (SELECT DISTINCT document_id, dataset FROM reports WHERE dataset IS NOT NULL), cm AS (SELECT DISTINCT dataset, concept_id FROM gn JOIN rr USING (document_id))"


@query(
    f"""WITH {_COHORTS}, ds AS (SELECT DISTINCT dataset FROM cm), p AS (SELECT a.dataset AS l, b.dataset AS r FROM ds a JOIN ds b ON a.dataset < b.dataset), u AS (SELECT DISTINCT concept_id FROM cm)
SELECT l AS left, r AS right, u.concept_id, CASE WHEN x.concept_id IS NOT NULL AND y.concept_id IS NOT NULL THEN 'shared' WHEN x.concept_id IS NOT NULL THEN 'left' ELSE 'right' END AS side
FROM p CROSS JOIN u LEFT JOIN cm x ON x.dataset = l AND x.concept_id = u.concept_id LEFT JOIN cm y ON y.dataset = r AND y.concept_id = u.concept_id WHERE x.concept_id IS NOT NULL OR y.concept_id IS NOT NULL"""
)
def cohort_concept_sets(spark: SparkSession, d: str) -> DataFrame:
    """Shared and unique concepts of every pair of data sets."""
    n = table(spark, d, "graph_nodes").where("node_type = 'concept' and concept_id is not null").select("document_id", "concept_id").distinct()
    r = table(spark, d, "reports").select("document_id", "dataset").where("dataset is not null").distinct()
    return cg.concept_sets(n.join(r, "document_id"), "dataset", "concept_id")


@query(
    f"""WITH {_COHORTS}, dm AS (SELECT DISTINCT dataset, gn.document_id, concept_id FROM gn JOIN rr USING (document_id)), t AS (SELECT dataset, count(DISTINCT document_id) AS n FROM dm GROUP BY dataset),
q AS (SELECT dataset, concept_id, count(*) / any_value(n) AS ratio FROM dm JOIN t USING (dataset) GROUP BY dataset, concept_id), p AS (SELECT a.dataset AS l, b.dataset AS r FROM t a JOIN t b ON a.dataset < b.dataset), u AS (SELECT DISTINCT concept_id FROM q),
f AS (SELECT l, r, u.concept_id, round(coalesce(x.ratio, 0) - coalesce(y.ratio, 0), 6) AS diff FROM p CROSS JOIN u LEFT JOIN q x ON x.dataset = l AND x.concept_id = u.concept_id LEFT JOIN q y ON y.dataset = r AND y.concept_id = u.concept_id WHERE x.ratio > 0 OR y.ratio > 0),
z AS (SELECT *, row_number() OVER (PARTITION BY l, r ORDER BY diff DESC, concept_id) <= 10 AS up, row_number() OVER (PARTITION BY l, r ORDER BY diff, concept_id) <= 10 AS down FROM f)
SELECT l AS left, r AS right, concept_id, diff AS ratio_diff, CASE WHEN up AND down THEN 'both' WHEN up THEN 'left' ELSE 'right' END AS end FROM z WHERE up OR down"""
)
def distinctive_concepts(spark: SparkSession, d: str) -> DataFrame:
    """The ten most distinctive concepts at both ends of every pair of data sets."""
    n = table(spark, d, "graph_nodes").where("node_type = 'concept' and concept_id is not null").select("document_id", "concept_id").distinct()
    r = table(spark, d, "reports").select("document_id", "dataset").where("dataset is not null").distinct()
    pairs = c.compare_cohorts(n.join(r, "document_id"), "dataset", "document_id", "concept_id")
    return cg.distinctive(pairs, 10).select("left", "right", "concept_id", "ratio_diff", "end")


@query(
    f"""WITH {_ROWS}, s AS (SELECT DISTINCT document_id, si FROM o WHERE list_contains(ts, 'carcinoma') OR list_contains(ts, 'margin') OR list_contains(ts, 'necrosis')), nw AS (SELECT document_id, si, row_number() OVER (PARTITION BY document_id ORDER BY si) - 1 AS ni FROM s)
SELECT m.document_id, CAST(ni AS INTEGER) AS sentence_index, cid AS concept_id, count(*) AS mentions FROM m JOIN nw USING (document_id, si) GROUP BY ALL"""
)
def remapped_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Mentions of the sentences that hold one of three keywords, with the sentences' new ordinals."""
    x = _Graphs(spark, d)
    kept = x.sentences.where(F.arrays_overlap(c.tokens("text"), F.array(*map(F.lit, ("carcinoma", "margin", "necrosis")))))
    return cg.remap(x.mentions, kept, "document_id").groupBy("document_id", F.col("sentence_index").cast("int").alias("sentence_index"), "concept_id").agg(F.count(F.lit(1)).alias("mentions"))


@query(
    f"""WITH {_ROWS}, a AS (SELECT document_id, count(*) AS n FROM m GROUP BY document_id), b AS (SELECT document_id, count(*) AS n FROM (SELECT DISTINCT node_key, document_id FROM graph_nodes WHERE node_type = 'concept') GROUP BY document_id)
SELECT document_id, a.n AS left_count, b.n AS right_count, CASE WHEN b.document_id IS NULL THEN 'missing' ELSE 'different' END AS state FROM a LEFT JOIN b USING (document_id) WHERE b.document_id IS NULL OR a.n <> b.n"""
)
def annotation_audit(spark: SparkSession, d: str) -> DataFrame:
    """Reports whose mentions differ in number from the concept nodes of their stored graph, or that have none."""
    a = _Graphs(spark, d).mentions.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    b = table(spark, d, "graph_nodes").where("node_type = 'concept'").select("node_key", "document_id").distinct().groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    return cg.compare_counts(a, b, "document_id", "n")
