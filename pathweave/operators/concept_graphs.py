"""The concept level of document graphs: concept summaries, nodes, mention, ontology and co-occurrence edges, the
sentence-ontology graph, filters by rank, and structure descriptors.

Sentences are rows (doc, sentence_index, section_index); mentions are rows (doc, sentence_index, section_index,
concept_id); an ontology is rows (id, name, parents, ic) with an optional depth. All joins are on the document and
an ordinal or concept, so a document of any size meets only its own rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import concepts as c
from . import graphs as g
from . import hierarchy


def summary(mentions: DataFrame, doc: str, ontology: DataFrame, hops: int | None = 2) -> DataFrame:
    """(doc, concept_id, concept_name, depth, ic, hops, direct_mention_count, sentence_indices, section_indices,
    ancestor_of, is_direct, rank): the concepts of a document, those mentioned and their ancestors within ``hops``
    links. An ancestor has the sentences of the mentioned concepts below it. Order: depth, name, id."""
    ids, edges = hierarchy.links(ontology)
    key = ids.select("key", F.col("id").alias("concept_id"))
    up = hierarchy.closure(edges) if hops is None else c._within(edges, hops)
    m = mentions.select(doc, "sentence_index", "section_index", F.lower(F.trim("concept_id")).alias("node")).where("node is not null")
    own = m.select(doc, F.col("node").alias("key"), "sentence_index", "section_index", F.lit(None).cast("string").alias("below"), F.lit(0).cast("long").alias("distance"), F.lit(1).alias("direct"))
    above = m.join(up, "node").select(doc, F.col("ancestor").alias("key"), "sentence_index", "section_index", F.col("node").alias("below"), "distance", F.lit(0).alias("direct"))
    x = own.unionByName(above).join(key, "key").join(key.select(F.col("key").alias("below"), F.col("concept_id").alias("below_id")), "below", "left")
    s = x.groupBy(doc, "concept_id").agg(
        F.min("distance").cast("int").alias("hops"),
        F.sum("direct").alias("direct_mention_count"),
        F.array_sort(F.collect_set("sentence_index")).alias("sentence_indices"),
        F.array_sort(F.collect_set("section_index")).alias("section_indices"),
        F.array_sort(F.collect_set("below_id")).alias("ancestor_of"),
    )
    of = ontology.groupBy(F.col("id").alias("concept_id")).agg(F.max("name").alias("concept_name"), F.max("ic").alias("ic"), (F.max("depth") if "depth" in ontology.columns else F.lit(0)).alias("depth"))
    s = s.join(of, "concept_id").withColumn("is_direct", F.col("direct_mention_count") > 0)
    w = Window.partitionBy(doc).orderBy("depth", F.lower("concept_name"), "concept_id")
    return s.withColumn("rank", F.row_number().over(w) - 1)


def nodes(hierarchy_nodes: DataFrame, concepts: DataFrame, doc: str) -> DataFrame:
    """The nodes of hierarchy_nodes() and after them one a concept (level 3) in the order of summary()."""
    size = hierarchy_nodes.groupBy(doc).agg(F.max("node_index").alias("last"))
    none = F.lit(None)
    k = concepts.join(size, doc).select(
        doc, F.lit("concept").alias("node_type"), F.lit(3).alias("level"), F.col("rank").cast("long").alias("ordinal"), none.cast("long").alias("section"), none.cast("long").alias("sentence"),
        (F.col("last") + 1 + F.col("rank")).alias("node_index"), "concept_id",
    )
    h = hierarchy_nodes.select(doc, "node_type", "level", "ordinal", "section", "sentence", "node_index", none.cast("string").alias("concept_id"))
    return h.unionByName(k)


def concept_edges(concepts: DataFrame, doc: str, ontology: DataFrame) -> DataFrame:
    """(doc, source_id, target_id): links from a concept to its parents, both in the document."""
    ids, edges = hierarchy.links(ontology)
    key = ids.select("key", "id")
    by_id = edges.join(key.select(F.col("key").alias("child"), F.col("id").alias("source_id")), "child").join(key.select(F.col("key").alias("parent"), F.col("id").alias("target_id")), "parent").select("source_id", "target_id").distinct()
    here = concepts.select(doc, "concept_id")
    return here.withColumnRenamed("concept_id", "source_id").join(by_id, "source_id").join(here.withColumnRenamed("concept_id", "target_id"), [doc, "target_id"]).select(doc, "source_id", "target_id")


def edges(all_nodes: DataFrame, mentions: DataFrame, links: DataFrame, doc: str, co_occurrence: bool = False) -> DataFrame:
    """(doc, source, target, edge_type, weight): distinct mention edges from sentences to concepts, ontology edges
    from concepts to parents and, if asked for, edges between concepts that share a sentence or section. Mentions
    of concepts or sentences that are no nodes are left out."""
    con = all_nodes.where("node_type = 'concept'").select(doc, "concept_id", "node_index")
    sen = all_nodes.where("node_type = 'sentence'").select(doc, F.col("sentence").alias("sentence_index"), F.col("node_index").alias("source"))
    m = mentions.select(doc, "sentence_index", "concept_id").distinct().join(sen, [doc, "sentence_index"]).join(con.withColumnRenamed("node_index", "target"), [doc, "concept_id"])
    out = m.select(doc, "source", "target", F.lit("mention").alias("edge_type"))
    at = lambda side: con.select(doc, F.col("concept_id").alias(f"{side}_id"), F.col("node_index").alias(side))
    out = out.unionByName(links.join(at("source"), [doc, "source_id"]).join(at("target"), [doc, "target_id"]).select(doc, "source", "target", F.lit("ontology").alias("edge_type")))
    if co_occurrence:
        for context, kind in (("sentence_index", "same_sentence"), ("section_index", "same_section")):
            p = c.co_occurrence(mentions, doc, [context], "concept_id")
            p = p.join(at("source").withColumnRenamed("source_id", "a"), [doc, "a"]).join(at("target").withColumnRenamed("target_id", "b"), [doc, "b"])
            out = out.unionByName(p.select(doc, "source", "target", F.lit(kind).alias("edge_type")))
    return g.weigh(out.distinct())


def sentence_ontology(all_nodes: DataFrame, concepts: DataFrame, concept_links: DataFrame, doc: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the graph of sentences and concepts alone, numbered anew: next edges between sentences,
    mention edges from a concept's sentences, ancestors included, and ontology edges."""
    n = all_nodes.where("node_type in ('sentence', 'concept')")
    n = n.withColumn("node_index", F.row_number().over(Window.partitionBy(doc).orderBy("level", "ordinal")) - 1)
    sen = n.where("node_type = 'sentence'").select(doc, F.col("sentence").alias("sentence_index"), F.col("node_index").alias("source"))
    con = n.where("node_type = 'concept'").select(doc, "concept_id", F.col("node_index").alias("target"))
    w = Window.partitionBy(doc).orderBy("source")
    nxt = sen.withColumn("target", F.lead("source").over(w)).where("target is not null").select(doc, "source", "target", F.lit("next").alias("edge_type"))
    m = concepts.select(doc, "concept_id", F.explode("sentence_indices").alias("sentence_index")).join(sen, [doc, "sentence_index"]).join(con, [doc, "concept_id"])
    at = lambda side: con.select(doc, F.col("concept_id").alias(f"{side}_id"), F.col("target").alias(side))
    o = concept_links.join(at("source"), [doc, "source_id"]).join(at("target"), [doc, "target_id"])
    out = nxt.unionByName(m.select(doc, "source", "target", F.lit("mention").alias("edge_type")).distinct()).unionByName(o.select(doc, "source", "target", F.lit("ontology").alias("edge_type")).distinct())
    return n, g.weigh(out)


def kept_nodes(all_nodes: DataFrame, concepts: DataFrame, doc: str, k: int, most_sentences: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """(doc, node_index): all nodes but the concepts outside the ``k`` heaviest of their document (of those in
    ``allowed`` (concept_id), if given) and the sentences after the first ``most_sentences``."""
    x = concepts if allowed is None else concepts.join(allowed.select("concept_id").distinct(), "concept_id", "left_semi")
    top = c.top_concepts(x.withColumn("mentions", F.col("direct_mention_count")).drop("rank"), doc, k).select(doc, "concept_id")
    keep = all_nodes.where("node_type = 'concept'").join(top, [doc, "concept_id"], "left_semi").select(doc, "node_index")
    rest = all_nodes.where("node_type <> 'concept'")
    if most_sentences is not None:
        rest = rest.where((F.col("node_type") != "sentence") | (F.col("ordinal") < most_sentences))
    return rest.select(doc, "node_index").unionByName(keep)


def filter_statistics(before_nodes: DataFrame, after_nodes: DataFrame, before_edges: DataFrame, after_edges: DataFrame, doc: str) -> DataFrame:
    """(doc, nodes_before, nodes_after, edges_before, edges_after, nodes_kept): what a filter leaves of each graph."""
    count = lambda df, name: df.groupBy(doc).agg(F.count(F.lit(1)).alias(name))
    x = count(before_nodes, "nodes_before").join(count(after_nodes, "nodes_after"), doc, "left").join(count(before_edges, "edges_before"), doc, "left").join(count(after_edges, "edges_after"), doc, "left").na.fill(0)
    return x.withColumn("nodes_kept", F.round(F.col("nodes_after") / F.col("nodes_before"), 6))


def describe(all_nodes: DataFrame, all_edges: DataFrame, concepts: DataFrame, doc: str) -> DataFrame:
    """graphs.descriptor() with mean and greatest information content, mean depth and mean direct mentions of the
    document's concepts; 0 without any."""
    s = concepts.groupBy(doc).agg(F.round(F.avg("ic"), 6).alias("mean_ic"), F.round(F.max("ic"), 6).alias("max_ic"), F.round(F.avg("depth"), 6).alias("mean_depth"), F.round(F.avg("direct_mention_count"), 6).alias("mean_mentions"))
    return g.descriptor(all_nodes, all_edges, doc).join(s, doc, "left").na.fill(0.0, ["mean_ic", "max_ic", "mean_depth", "mean_mentions"])


def distinctive(pairs: DataFrame, k: int) -> DataFrame:
    """The rows of compare_cohorts() with the ``k`` greatest and ``k`` least differences of each pair of cohorts."""
    up = F.row_number().over(Window.partitionBy("left", "right").orderBy(F.desc("ratio_diff"), "concept_id"))
    down = F.row_number().over(Window.partitionBy("left", "right").orderBy("ratio_diff", "concept_id"))
    x = pairs.withColumns({"_u": up, "_d": down}).where((F.col("_u") <= k) | (F.col("_d") <= k))
    return x.withColumn("end", F.when((F.col("_u") <= k) & (F.col("_d") <= k), "both").when(F.col("_u") <= k, "left").otherwise("right")).drop("_u", "_d")


def concept_sets(mentions: DataFrame, cohort: str, concept: str) -> DataFrame:
    """(left, right, concept, side): for every pair of cohorts each concept that both or one of them has."""
    has = mentions.select(F.col(cohort).alias("cohort"), F.col(concept).alias("concept_id")).where("cohort is not null and concept_id is not null").distinct()
    names = has.select("cohort").distinct()
    pairs = names.select(F.col("cohort").alias("left")).join(names.select(F.col("cohort").alias("right")), F.col("left") < F.col("right"))
    a = pairs.join(has.withColumnRenamed("cohort", "left"), "left").select("left", "right", "concept_id", F.lit(1).alias("l"), F.lit(0).alias("r"))
    b = pairs.join(has.withColumnRenamed("cohort", "right"), "right").select("left", "right", "concept_id", F.lit(0).alias("l"), F.lit(1).alias("r"))
    x = a.unionByName(b).groupBy("left", "right", "concept_id").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return x.select("left", "right", "concept_id", F.when(F.col("l") + F.col("r") == 2, "shared").when(F.col("l") == 1, "left").otherwise("right").alias("side"))


def coverage(documents: DataFrame, sentences: DataFrame, concepts: DataFrame, doc: str, listed: int = 25) -> DataFrame:
    """One row: documents, how many have no sentence, no concept or inherited concepts, and the first of those
    without concept by id (``listed`` of them, a report's excerpt)."""
    d = documents.select(doc).distinct()
    s = sentences.groupBy(doc).agg(F.count(F.lit(1)).alias("s"))
    k = concepts.groupBy(doc).agg(F.count(F.lit(1)).alias("k"), F.max((~F.col("is_direct")).cast("int")).alias("e"))
    x = d.join(s, doc, "left").join(k, doc, "left").na.fill(0)
    first = x.where("k = 0").orderBy(doc).limit(listed).agg(F.array_sort(F.collect_list(doc)).alias("without_concept"))
    return x.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("s") == 0).alias("zero_sentences"), F.count_if(F.col("k") == 0).alias("zero_concepts"), F.count_if(F.col("e") == 1).alias("expanded")).crossJoin(F.broadcast(first))


def remap(mentions: DataFrame, kept: DataFrame, doc: str) -> DataFrame:
    """Mentions of the kept sentences (doc, sentence_index) with the sentences' new dense ordinals."""
    new = kept.select(doc, "sentence_index").distinct().withColumn("new_index", F.row_number().over(Window.partitionBy(doc).orderBy("sentence_index")) - 1)
    return mentions.join(new, [doc, "sentence_index"]).withColumn("sentence_index", F.col("new_index")).drop("new_index")


def compare_counts(left: DataFrame, right: DataFrame, key: str, count: str) -> DataFrame:
    """(key, left_count, right_count, state): rows of the left side that the right lacks ('missing') or counts
    otherwise ('different')."""
    x = left.select(key, F.col(count).alias("left_count")).join(right.select(key, F.col(count).alias("right_count"), F.lit(True).alias("there")), key, "left")
    return x.withColumn("state", F.when(F.col("there").isNull(), "missing").when(~F.col("left_count").eqNullSafe(F.col("right_count")), "different")).where("state is not null").drop("there")
