"""Queries of document graphs and vector kernels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graphs as g
from ..operators import vectors as v
from ..registry import query
from ..runtime import table
from .cleaning import SENTENCES, sentences

_ORD = f"{SENTENCES}, o AS (SELECT document_id, section_id, row_number() OVER (PARTITION BY document_id ORDER BY section_index, section_id, section_sentence_index) - 1 AS sentence_index FROM sv)"
_NODES = f"""{_ORD},
nd AS (SELECT DISTINCT document_id, 'document' AS node_type, 0 AS level, 0 AS ordinal, NULL AS section FROM o
  UNION ALL SELECT document_id, 'section', 1, min(sentence_index), section_id FROM o GROUP BY document_id, section_id
  UNION ALL SELECT document_id, 'sentence', 2, sentence_index, section_id FROM o),
nodes AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY level, ordinal) - 1 AS node_index FROM nd)
"""
_EDGES = f"""{_NODES},
edges AS (SELECT a.document_id, a.node_index AS source, b.node_index AS target, 'parent' AS edge_type, 1.0 AS weight FROM nodes a JOIN nodes b USING (document_id) WHERE a.node_type = 'document' AND b.node_type = 'section'
  UNION ALL SELECT a.document_id, a.node_index, b.node_index, 'parent', 1.0 FROM nodes a JOIN nodes b ON a.document_id = b.document_id AND a.section = b.section WHERE a.node_type = 'section' AND b.node_type = 'sentence'
  UNION ALL SELECT * FROM (SELECT document_id, node_index, lead(node_index) OVER (PARTITION BY document_id, node_type ORDER BY ordinal) AS t, 'next', 0.25 FROM nodes WHERE node_type <> 'document') WHERE t IS NOT NULL)
"""


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("document_id").orderBy("section_index", "section_id", "section_sentence_index")
    s = sentences(spark, d).select("document_id", "section_id", (F.row_number().over(w) - 1).alias("sentence_index"))
    return g.hierarchy_nodes(s, "document_id")


@query(f"WITH {_NODES} SELECT document_id, CAST(node_index AS INTEGER) AS node_index, node_type, CAST(level AS INTEGER) AS level FROM nodes")
def graph_nodes_built(spark: SparkSession, d: str) -> DataFrame:
    """Numbered nodes of every report's hierarchy graph."""
    return _nodes(spark, d).select("document_id", "node_index", "node_type", "level")


@query(f"WITH {_EDGES} SELECT document_id, CAST(source AS INTEGER) AS source, CAST(target AS INTEGER) AS target, edge_type, CAST(weight AS DOUBLE) AS weight FROM edges")
def graph_edges_built(spark: SparkSession, d: str) -> DataFrame:
    """Typed weighted edges of every report's hierarchy graph."""
    return g.hierarchy_edges(_nodes(spark, d), "document_id").select("document_id", "source", "target", "edge_type", "weight")


@query(
    f"""WITH {_EDGES}, n AS (SELECT document_id, count(*) AS n, count(*) FILTER (node_type = 'section') AS s, count(*) FILTER (node_type = 'sentence') AS t FROM nodes GROUP BY document_id),
e AS (SELECT document_id, count(*) AS m, count(*) FILTER (edge_type = 'parent') AS p, count(*) FILTER (edge_type = 'next') AS x FROM edges GROUP BY document_id)
SELECT n.document_id, round(s / n, 6) AS section_share, round(t / n, 6) AS sentence_share, round(coalesce(p / m, 0), 6) AS parent_edges, round(coalesce(x / m, 0), 6) AS next_edges, round(ln(1 + n), 6) AS log_nodes, round(ln(1 + coalesce(m, 0)), 6) AS log_edges
FROM n LEFT JOIN e USING (document_id)"""
)
def graph_descriptor(spark: SparkSession, d: str) -> DataFrame:
    """Structure of every report's graph."""
    n = _nodes(spark, d)
    x = g.descriptor(n, g.hierarchy_edges(n, "document_id"), "document_id")
    return x.select("document_id", "section_share", "sentence_share", "parent_edges", "next_edges", "log_nodes", "log_edges")


_GN = "gn AS (SELECT DISTINCT node_key, document_id, node_index, node_type, section_index, node_features FROM graph_nodes WHERE len(node_features) = 64)"
_USABLE = "us AS (SELECT * FROM gn WHERE len(list_filter(node_features, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(node_features, lambda x: x <> 0)) > 0)"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "graph_nodes").select("node_key", "document_id", "node_index", "node_type", "section_index", "node_features").distinct()
    return n.where(v.usable("node_features", 64))


@query(
    f"""WITH {_GN}, {_USABLE}, s AS (SELECT document_id, unnest(node_features) AS x, generate_subscripts(node_features, 1) - 1 AS dim FROM us WHERE node_type = 'sentence')
SELECT document_id, CAST(dim AS INTEGER) AS dim, round(avg(CAST(x AS DOUBLE)), 6) AS value FROM s GROUP BY document_id, dim"""
)
def mean_pool(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the sentence vectors of every report by position."""
    x = v.mean_vector(_vectors(spark, d).where("node_type = 'sentence'"), ["document_id"], "node_features")
    return x.select("document_id", "dim", F.round("value", 6).alias("value"))


@query(
    f"""WITH {_GN}, {_USABLE}, s AS (SELECT document_id, section_index, unnest(node_features) AS x, generate_subscripts(node_features, 1) - 1 AS dim FROM us WHERE node_type = 'sentence'),
m AS (SELECT document_id, section_index, dim, avg(CAST(x AS DOUBLE)) AS value FROM s GROUP BY ALL)
SELECT document_id, CAST(dim AS INTEGER) AS dim, round(avg(value), 6) AS value FROM m GROUP BY document_id, dim"""
)
def section_mean_pool(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the section means of every report."""
    x = v.mean_of_means(_vectors(spark, d).where("node_type = 'sentence'"), "document_id", "section_index", "node_features")
    return x.select("document_id", "dim", F.round("value", 6).alias("value"))


@query(
    f"""WITH {_GN}, {_USABLE}, s AS (SELECT document_id, node_index, CAST(node_features AS DOUBLE[]) AS f FROM us WHERE node_type = 'sentence'),
p AS (SELECT a.document_id, a.node_index AS a, b.node_index AS b, round(list_cosine_similarity(a.f, b.f), 6) AS sim FROM s a JOIN s b ON a.document_id = b.document_id AND a.node_index <> b.node_index)
SELECT document_id, a, b, sim FROM p QUALIFY row_number() OVER (PARTITION BY document_id, a ORDER BY sim DESC, b) <= 3"""
)
def sentence_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """The three most similar other sentences of every sentence within its report."""
    return v.nearest_in_group(_vectors(spark, d).where("node_type = 'sentence'"), "document_id", "node_index", "node_features", 3)


@query(
    """WITH one AS (SELECT DISTINCT document_id, section_index, concept_id FROM graph_nodes WHERE node_type = 'concept' AND concept_id IS NOT NULL),
e AS (SELECT DISTINCT a.document_id AS d, a.concept_id AS a, b.concept_id AS b FROM one a JOIN one b ON a.document_id = b.document_id AND a.section_index IS NOT DISTINCT FROM b.section_index AND a.concept_id <> b.concept_id),
t AS (SELECT DISTINCT x.d, x.a, y.b FROM e x JOIN e y ON x.d = y.d AND x.b = y.a WHERE x.a <> y.b AND NOT EXISTS (SELECT 1 FROM e z WHERE z.d = x.d AND z.a = x.a AND z.b = y.b)),
r AS (SELECT DISTINCT x.d, x.a, y.b FROM t x JOIN e y ON x.d = y.d AND x.b = y.a WHERE x.a <> y.b AND NOT EXISTS (SELECT 1 FROM e z WHERE z.d = x.d AND z.a = x.a AND z.b = y.b) AND NOT EXISTS (SELECT 1 FROM t z WHERE z.d = x.d AND z.a = x.a AND z.b = y.b)),
u AS (SELECT d, a, 1 AS h FROM e UNION ALL SELECT d, a, 2 FROM t UNION ALL SELECT d, a, 3 FROM r)
SELECT d AS document_id, a AS node, count(*) FILTER (h = 1) AS one, count(*) FILTER (h = 2) AS two, count(*) FILTER (h = 3) AS three FROM u GROUP BY d, a"""
)
def hop_topology(spark: SparkSession, d: str) -> DataFrame:
    """Concepts at one, two and three steps of shared sections in every report."""
    from ..operators.concepts import co_occurrence

    m = table(spark, d, "graph_nodes").where("node_type = 'concept' and concept_id is not null")
    e = co_occurrence(m, "document_id", ["section_index"], "concept_id").select("document_id", F.col("a").alias("source"), F.col("b").alias("target"))
    return g.hops(e, "document_id")


@query()
def embedding_mmd(spark: SparkSession, d: str) -> DataFrame:
    """Discrepancy between the vectors of two labels."""
    e = table(spark, d, "embeddings")
    return v.mmd(e.where("label = 0"), e.where("label = 1"), "embedding")


@query("WITH x AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(CAST(x AS DOUBLE)), 6) AS value FROM x GROUP BY label, dim")
def label_centroids(spark: SparkSession, d: str) -> DataFrame:
    """Mean vector of every label."""
    return v.mean_vector(table(spark, d, "embeddings"), ["label"], "embedding").select("label", "dim", F.round("value", 6).alias("value"))


@query()
def bag_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of the sentence vectors within every report."""
    return v.k_means(_vectors(spark, d).where("node_type = 'sentence'"), "document_id", "node_key", "node_features", 4)


@query(
    f"""WITH {_GN}, {_USABLE}, cn AS (SELECT DISTINCT document_id, concept_id, section_index FROM graph_nodes WHERE node_type = 'concept' AND concept_id IS NOT NULL),
sx AS (SELECT document_id, section_index, unnest(node_features) AS x, generate_subscripts(node_features, 1) - 1 AS dim FROM us WHERE node_type = 'sentence'),
lk AS (SELECT cn.document_id, concept_id, dim, avg(CAST(x AS DOUBLE)) AS value FROM cn JOIN sx ON sx.document_id = cn.document_id AND sx.section_index = cn.section_index GROUP BY ALL),
ba AS (SELECT DISTINCT document_id, concept_id FROM cn EXCEPT SELECT DISTINCT document_id, concept_id FROM lk), wh AS (SELECT document_id, dim, avg(CAST(x AS DOUBLE)) AS value FROM sx GROUP BY ALL)
SELECT document_id, concept_id, CAST(dim AS INTEGER) AS dim, round(value, 6) AS value FROM (SELECT * FROM lk UNION ALL SELECT ba.document_id, ba.concept_id, dim, value FROM ba JOIN wh USING (document_id))"""
)
def concept_mean_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Mean vector of the sentences in a concept's sections, else of its report."""
    links = table(spark, d, "graph_nodes").where("node_type = 'concept' and concept_id is not null").select("document_id", "concept_id", "section_index").distinct()
    x = v.concept_means(links, _vectors(spark, d).where("node_type = 'sentence'"), "document_id", "concept_id", "section_index", "node_features")
    return x.select("document_id", "concept_id", "dim", F.round("value", 6).alias("value"))


@query(
    """WITH e AS (SELECT vec_id, embedding, 'Label_' || (vec_id % 50) AS name FROM embeddings WHERE len(embedding) = 64), m AS (SELECT name, max(vec_id) AS vec_id FROM e GROUP BY name), w AS (SELECT DISTINCT vec_id, 'label ' || (vec_id % 60) AS a, 'Label_' || (vec_id % 70) AS b FROM embeddings)
SELECT w.vec_id, coalesce(x.vec_id, y.vec_id) AS found FROM w LEFT JOIN m x ON lower(replace(x.name, '_', ' ')) = w.a LEFT JOIN m y ON y.name = w.b"""
)
def embedding_look_up(spark: SparkSession, d: str) -> DataFrame:
    """The embedding that stands for either of two keys, raw or normalised."""
    e = table(spark, d, "embeddings").where("size(embedding) = 64")
    known = v.embedding_map(e.withColumn("name", F.concat(F.lit("Label_"), F.col("vec_id") % 50)).withColumn("vector", F.array_append(F.slice("embedding", 1, 63), F.col("vec_id").cast("float"))), "name", "vector", 64, "vec_id")
    w = table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("label "), F.col("vec_id") % 60).alias("a"), F.concat(F.lit("Label_"), F.col("vec_id") % 70).alias("b")).distinct()
    return v.look_up(w, ["a", "b"], known).select("vec_id", F.try_element_at("vector", F.lit(64)).cast("long").alias("found"))
