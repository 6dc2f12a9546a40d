"""Queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import canon, leaks, mixing, neighbors, personal, scans, sentences, toxicity

#: Words of clinical writing and what they stand for, the caller's parameter of problem 5.
CLINICAL_WORDS = {
    "hx": "history", "pt": "patient", "macro": "gross", "exam": "description", "examination": "description", "microscopy": "microscopic", "notes": "information", "data": "information", "remarks": "comment",
    "operation": "procedure", "nodal": "lymph nodes", "imaging": "radiology", "radiologic": "radiology", "study": "trial", "checklist": "report", "block": "sections", "testing": "studies", "er": "receptor", "pr": "receptor",
}

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The offsets of the sentence units of every section."""
    return sentences.found(table(spark, d, "sections"))


def p1_units(spark: SparkSession, d: str) -> DataFrame:
    """The sentence units of every section in order."""
    u = sentences.units(table(spark, d, "sections"), "section_id", "text", "section_title")
    return u.select(F.col("id").alias("section_id"), "unit_index", "start_char", "unit")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of nodes whose vectors have a cosine similarity of at least 0.9."""
    pairs = neighbors.similar_pairs(table(spark, d, "graph_nodes"), "node_key", "node_features", 0.9, dim=64)
    return pairs.select(F.col("a").alias("node_key_a"), F.col("b").alias("node_key_b"))


def p2_links(spark: SparkSession, d: str) -> DataFrame:
    """Every node with such partners, the smallest key of its copies, and the number of its partners."""
    x = neighbors.links(table(spark, d, "graph_nodes"), "node_key", "node_features", 0.9, dim=64)
    return x.select(F.col("key").alias("node_key"), F.col("rep").alias("class_key"), "links")


def p2_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar vectors, among all, of every node whose key is divisible by 100."""
    near = neighbors.nearest(table(spark, d, "graph_nodes"), "node_key", "node_features", "key % 100 = 0", dim=64)
    return near.select(F.col("a").alias("node_key"), F.col("b").alias("neighbor_key"), "rank", F.round("sim", 4).alias("similarity"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Personal data in pages and sections."""
    return personal.found(table(spark, d, "page_extractions"), table(spark, d, "sections"))


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Pages and sections with typed placeholders for personal data."""
    return personal.redacted(table(spark, d, "page_extractions"), table(spark, d, "sections"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The canonical title of every filled section title."""
    return canon.found(table(spark, d, "sections"), table(spark, d, "canonical_titles"), CLINICAL_WORDS)


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """How often each written title stands for each canonical one; misses under -1."""
    return canon.report(table(spark, d, "sections"), table(spark, d, "canonical_titles"), CLINICAL_WORDS)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Headers, page numbers, broken words and misreadings of every page."""
    return scans.found(table(spark, d, "page_extractions"))


def p6_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Every page as continuous repaired paragraphs."""
    return scans.paragraphs(table(spark, d, "page_extractions"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a passage of an evaluation item."""
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixture: every use of a document with its shard and its place there."""
    return mixing.ordered(mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that the mixture reaches."""
    return mixing.shares(mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Abusive, hateful or sexually explicit documents."""
    return toxicity.found(table(spark, d, "documents"), table(spark, d, "moderation_labels"))


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score of every document."""
    s = toxicity.scores(table(spark, d, "documents"), table(spark, d, "moderation_labels"))
    return s.select("doc_id", "source", F.round("score", 4).alias("score"))


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """The rate of such documents per source."""
    return toxicity.rates(table(spark, d, "documents"), table(spark, d, "moderation_labels"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_units, p2_found, p2_links, p2_nearest, p4_found, p4_redacted, p5_found, p5_report, p6_found, p6_paragraphs, p7_found, p8_mixture, p8_shares, p9_found, p9_scores, p9_rates)}
ORACLES: dict[str, str] = {}
