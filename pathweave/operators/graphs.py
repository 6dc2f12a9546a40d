"""Document graphs as tables of nodes and edges: numbering, typed weighted edges, filters, descriptors, topology."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Weights of the edge types.
EDGE_WEIGHTS = {"parent": 1.0, "next": 0.25, "mention": 1.0, "ontology": 0.7, "same_sentence": 0.25, "same_section": 0.1}
NODE_TYPES = ("document", "section", "sentence", "concept")


def number_nodes(items: DataFrame, doc: str) -> DataFrame:
    """node_index of rows (doc, level, ordinal, ...): contiguous per document by level and ordinal."""
    w = Window.partitionBy(doc).orderBy("level", "ordinal")
    return items.withColumn("node_index", F.row_number().over(w) - 1)


def hierarchy_nodes(sentences: DataFrame, doc: str, section: str = "section_id") -> DataFrame:
    """(doc, node_index, node_type, level, ordinal, section, sentence): a node for every document, section and
    sentence of rows (doc, section_index, section, sentence_index)."""
    d = sentences.select(doc).distinct().select(doc, F.lit("document").alias("node_type"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("ordinal"), F.lit(None).cast("long").alias("section"), F.lit(None).cast("long").alias("sentence"))
    first = sentences.groupBy(doc, section).agg(F.min("sentence_index").alias("first"))
    s = first.select(doc, F.lit("section").alias("node_type"), F.lit(1).alias("level"), F.col("first").cast("long").alias("ordinal"), F.col(section).cast("long").alias("section"), F.lit(None).cast("long").alias("sentence"))
    t = sentences.select(doc, F.lit("sentence").alias("node_type"), F.lit(2).alias("level"), F.col("sentence_index").cast("long").alias("ordinal"), F.col(section).cast("long").alias("section"), F.col("sentence_index").cast("long").alias("sentence"))
    return number_nodes(d.unionByName(s).unionByName(t), doc)


def hierarchy_edges(nodes: DataFrame, doc: str) -> DataFrame:
    """(doc, source, target, edge_type, weight): parent edges from document to sections to sentences, and next
    edges between neighbours of one level."""
    n = nodes.select(doc, "node_index", "node_type", "section", "ordinal")
    root = n.where("node_type = 'document'").select(doc, F.col("node_index").alias("source"))
    sec = n.where("node_type = 'section'")
    sen = n.where("node_type = 'sentence'")
    a = root.join(sec, doc).select(doc, "source", F.col("node_index").alias("target"), F.lit("parent").alias("edge_type"))
    b = sec.select(doc, "section", F.col("node_index").alias("source")).join(sen, [doc, "section"]).select(doc, "source", F.col("node_index").alias("target"), F.lit("parent").alias("edge_type"))
    w = Window.partitionBy(doc, "node_type").orderBy("ordinal")
    nxt = n.where("node_type in ('section', 'sentence')").withColumn("target", F.lead("node_index").over(w)).where("target is not null").select(doc, F.col("node_index").alias("source"), "target", F.lit("next").alias("edge_type"))
    return weigh(a.unionByName(b).unionByName(nxt))


def weigh(edges: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Edges with the default weight of their type; an unknown type weighs 1."""
    table = F.create_map(*[F.lit(x) for kv in (weights or EDGE_WEIGHTS).items() for x in kv])
    return edges.withColumn("weight", F.coalesce(F.try_element_at(table, F.col("edge_type")), F.lit(1.0)))


def both_ways(edges: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """Edges of the allowed types with their reversed copies, whose type is marked."""
    e = edges.where(F.col("edge_type").isin(*allowed)) if allowed else edges
    back = e.withColumns({"source": F.col("target"), "target": F.col("source"), "edge_type": F.concat("edge_type", F.lit("_back"))})
    return e.unionByName(back)


def induced(nodes: DataFrame, edges: DataFrame, keep: DataFrame, doc: str) -> tuple[DataFrame, DataFrame]:
    """The sub-graph of the kept nodes (doc, node_index), numbered anew."""
    k = nodes.join(keep.select(doc, "node_index").distinct(), [doc, "node_index"], "left_semi")
    k = k.withColumn("new_index", F.row_number().over(Window.partitionBy(doc).orderBy("node_index")) - 1)
    m = k.select(doc, F.col("node_index").alias("o"), F.col("new_index").alias("n"))
    e = edges.join(m.withColumnsRenamed({"o": "source", "n": "s"}), [doc, "source"]).join(m.withColumnsRenamed({"o": "target", "n": "t"}), [doc, "target"])
    e = e.withColumns({"source": F.col("s"), "target": F.col("t")}).drop("s", "t")
    return k.withColumn("node_index", F.col("new_index")).drop("new_index"), e


def with_self_loops(nodes: DataFrame, edges: DataFrame, doc: str) -> DataFrame:
    """Edges, and for documents without any a loop on their first node."""
    empty = nodes.select(doc).distinct().join(edges.select(doc).distinct(), doc, "left_anti")
    loop = empty.select(doc, F.lit(0).alias("source"), F.lit(0).alias("target"), F.lit("parent").alias("edge_type"), F.lit(1.0).alias("weight"))
    return edges.select(doc, "source", "target", "edge_type", "weight").unionByName(loop)


def drop_out(edges: DataFrame, doc: str, share: float, seed: int = 0) -> DataFrame:
    """Edges without a share of them, chosen by hash: the same seed drops the same ones."""
    h = F.pmod(F.xxhash64(doc, "source", "target", "edge_type", F.lit(seed)), F.lit(1_000_000))
    return edges.where(h >= int(share * 1_000_000))


def descriptor(nodes: DataFrame, edges: DataFrame, doc: str) -> DataFrame:
    """Structure of each document's graph: shares of node and edge types, logarithmic sizes."""
    n = nodes.groupBy(doc).agg(F.count(F.lit(1)).alias("nodes"), *[F.count_if(F.col("node_type") == t).alias(f"n_{t}") for t in NODE_TYPES])
    e = edges.groupBy(doc).agg(F.count(F.lit(1)).alias("edges"), *[F.count_if(F.col("edge_type") == t).alias(f"e_{t}") for t in EDGE_WEIGHTS])
    x = n.join(e, doc, "left").na.fill(0)
    share = lambda c, total: F.round(F.when(F.col(total) > 0, F.col(c) / F.col(total)).otherwise(0.0), 6)
    return x.select(doc, *[share(f"n_{t}", "nodes").alias(f"{t}_share") for t in NODE_TYPES], *[share(f"e_{t}", "edges").alias(f"{t}_edges") for t in EDGE_WEIGHTS], F.round(F.log1p("nodes"), 6).alias("log_nodes"), F.round(F.log1p("edges"), 6).alias("log_edges"))


def hops(edges: DataFrame, doc: str) -> DataFrame:
    """(doc, node, one, two, three): numbers of nodes at exactly one, two and three steps of undirected edges."""
    e = edges.where("source <> target")
    one = e.select(doc, F.col("source").alias("a"), F.col("target").alias("b")).unionByName(e.select(doc, F.col("target").alias("a"), F.col("source").alias("b"))).distinct()
    step = one.select(doc, F.col("a").alias("b"), F.col("b").alias("c"))
    seen1 = one.withColumnRenamed("b", "c")
    two = one.join(step, [doc, "b"]).where("a <> c").select(doc, "a", "c").distinct().join(seen1, [doc, "a", "c"], "left_anti")
    three = two.select(doc, "a", F.col("c").alias("b")).join(step, [doc, "b"]).where("a <> c").select(doc, "a", "c").distinct()
    three = three.join(seen1, [doc, "a", "c"], "left_anti").join(two, [doc, "a", "c"], "left_anti")
    all_ = one.select(doc, "a", F.lit(1).alias("h")).unionByName(two.select(doc, "a", F.lit(2).alias("h"))).unionByName(three.select(doc, "a", F.lit(3).alias("h")))
    return all_.groupBy(doc, F.col("a").alias("node")).agg(*[F.count_if(F.col("h") == i).alias(n) for i, n in ((1, "one"), (2, "two"), (3, "three"))])


def pass_messages(edges: DataFrame, features: DataFrame, doc: str) -> DataFrame:
    """(doc, node, dim, value): for every target the weighted mean of its sources' features (weights of less than
    1 in all count as 1); features are rows (doc, node, dim, value)."""
    x = edges.join(features.select(doc, F.col("node").alias("source"), "dim", "value"), [doc, "source"])
    total = edges.groupBy(doc, "target").agg(F.sum("weight").alias("w"))
    g = x.groupBy(doc, "target", "dim").agg(F.sum(F.col("weight") * F.col("value")).alias("s"))
    return g.join(total, [doc, "target"]).select(doc, F.col("target").alias("node"), "dim", (F.col("s") / F.greatest("w", F.lit(1.0))).alias("value"))
