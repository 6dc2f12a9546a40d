"""Queries of concept linking, the ontology and cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import concepts as c
from ..registry import query
from ..runtime import table
from .hierarchies import LINKS

_TOKENS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
_STOP = ", ".join(f"'{w}'" for w in c.STOP_TERMS)
_LEX = f"""
cc AS (SELECT DISTINCT id, name, synonyms FROM concepts WHERE match_enabled AND name IS NOT NULL),
tm AS (SELECT id, name, unnest(list_concat([name], coalesce(synonyms, []))) AS term FROM cc),
tt AS (SELECT id, name, term, {_TOKENS.format("term")} AS ts, array_to_string({_TOKENS.format("name")}, ' ') AS own, len({_TOKENS.format("name")}) AS own_n FROM tm),
ph AS (SELECT *, array_to_string(ts, ' ') AS phrase, len(ts) AS n FROM tt WHERE len(ts) > 0),
lx AS (SELECT phrase, n, id AS concept_id, row_number() OVER (PARTITION BY phrase, n ORDER BY (own <> phrase)::INT, (NOT contains(own, phrase))::INT, own_n, own, id, name, term) AS r FROM ph
       WHERE NOT (n = 1 AND (phrase IN ({_STOP}) OR length(phrase) < 4 OR regexp_matches(phrase, '^[0-9]+$')))),
lex AS (SELECT phrase, n, concept_id FROM lx WHERE r = 1)
"""
_HITS = f"""{_LEX},
sx AS (SELECT DISTINCT section_id, {_TOKENS.format("text")} AS ts FROM sections WHERE text IS NOT NULL),
ln AS (SELECT DISTINCT n FROM lex),
st AS (SELECT section_id, ts, n, unnest(range(0, greatest(len(ts) - n + 1, 1))) AS start FROM sx, ln WHERE len(ts) > 0),
hits AS (SELECT section_id, start, st.n, concept_id FROM st JOIN lex ON lex.n = st.n AND lex.phrase = array_to_string(ts[start + 1:start + st.n], ' '))
"""


def _sections(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sections").select("section_id", "document_id", "text").where("text is not null").distinct()


def _lexicon(spark: SparkSession, d: str) -> DataFrame:
    return c.lexicon(table(spark, d, "concepts").select("id", "name", "synonyms", "match_enabled").distinct())


@query(f"WITH {_LEX} SELECT phrase, CAST(n AS INTEGER) AS n, concept_id FROM lex")
def lexicon(spark: SparkSession, d: str) -> DataFrame:
    """Every phrase with the concept it stands for."""
    return _lexicon(spark, d).select("phrase", "n", "concept_id")


@query(f"WITH {_HITS} SELECT concept_id, count(*) AS hits, count(DISTINCT section_id) AS sections FROM hits GROUP BY concept_id")
def phrase_hits(spark: SparkSession, d: str) -> DataFrame:
    """All hits of lexicon phrases in the sections, per concept."""
    h = c.phrase_hits(_sections(spark, d), "section_id", "text", _lexicon(spark, d))
    return h.groupBy("concept_id").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("section_id").alias("sections"))


_BUILT_IN = ", ".join(f"('{i}', '{p}')" for i, n, syn, *_ in c.FALLBACK for p in (n, *syn))


@query(
    f"""WITH lex AS (SELECT i AS concept_id, p AS phrase, len(string_split(p, ' ')) AS n FROM (VALUES {_BUILT_IN}) v(i, p)),
sx AS (SELECT DISTINCT section_id, {_TOKENS.format("text")} AS ts FROM sections WHERE text IS NOT NULL),
st AS (SELECT section_id, ts, n, unnest(range(0, greatest(len(ts) - n + 1, 1))) AS start FROM sx, (SELECT DISTINCT n FROM lex) WHERE len(ts) > 0),
h AS (SELECT section_id, start, st.n, concept_id FROM st JOIN lex ON lex.n = st.n AND lex.phrase = array_to_string(ts[start + 1:start + st.n], ' '))
SELECT concept_id, count(*) AS mentions, count(DISTINCT section_id) AS sections FROM h
WHERE NOT EXISTS (SELECT 1 FROM h x WHERE x.section_id = h.section_id AND x.n > h.n AND x.start <= h.start AND x.start + x.n >= h.start + h.n) GROUP BY concept_id"""
)
def concept_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Longest non-overlapping mentions of the fallback ontology's concepts in the sections."""
    m = c.longest_matches(c.phrase_hits(_sections(spark, d), "section_id", "text", c.lexicon(c.fallback(spark))), "section_id")
    return m.groupBy("concept_id").agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct("section_id").alias("sections"))


@query(
    f"""WITH RECURSIVE {LINKS}
lv(node, d) AS (SELECT k, 0 FROM roots UNION SELECT e.child, lv.d + 1 FROM lv JOIN e ON e.parent = lv.node WHERE e.child NOT IN (SELECT node FROM loops) AND e.parent NOT IN (SELECT node FROM loops))
SELECT c.id, CAST(max(lv.d) AS INTEGER) AS depth FROM c LEFT JOIN lv ON lv.node = c.k GROUP BY c.id"""
)
def concept_depths(spark: SparkSession, d: str) -> DataFrame:
    """Longest way of every concept from a root."""
    return c.longest_depths(table(spark, d, "concepts"))


@query(
    f"""WITH RECURSIVE {LINKS}
g AS (SELECT ancestor, count(*) AS n FROM up WHERE node <> ancestor GROUP BY ancestor)
SELECT c.id, coalesce(g.n, 0) AS descendants, round(ln(((SELECT count(DISTINCT k) FROM c) + 1) / (coalesce(g.n, 0) + 1)), 6) AS ic FROM c LEFT JOIN g ON g.ancestor = c.k"""
)
def concept_ic(spark: SparkSession, d: str) -> DataFrame:
    """Descendants and information content of every concept."""
    return c.information_content(table(spark, d, "concepts"))


_NODES = "gn AS (SELECT DISTINCT node_key, document_id, case_id, node_index, node_type, level, section_index, sentence_index, concept_id FROM graph_nodes)"


def _concept_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "graph_nodes").select("node_key", "document_id", "case_id", "node_index", "node_type", "section_index", "sentence_index", "concept_id").distinct()
    return n.where("node_type = 'concept' and concept_id is not null")


@query(
    f"""WITH RECURSIVE {LINKS} {_NODES},
own AS (SELECT DISTINCT document_id, lower(trim(concept_id)) AS k FROM gn WHERE node_type = 'concept' AND lower(trim(concept_id)) IN (SELECT k FROM c)),
h1 AS (SELECT own.document_id, e.parent AS k, 1 AS h, own.k AS node FROM own JOIN e ON e.child = own.k),
h2 AS (SELECT h1.document_id, e.parent AS k, 2 AS h, h1.node FROM h1 JOIN e ON e.child = h1.k),
u AS (SELECT document_id, k, 0 AS h FROM own UNION ALL SELECT document_id, k, h FROM h1 WHERE k <> node UNION ALL SELECT document_id, k, h FROM h2 WHERE k <> node)
SELECT u.document_id, c.id AS concept_id, min(h) = 0 AS direct, CAST(min(h) AS INTEGER) AS hops FROM u JOIN c ON c.k = u.k GROUP BY u.document_id, c.id"""
)
def true_path(spark: SparkSession, d: str) -> DataFrame:
    """Concepts of every report's graph with their ancestors within two links."""
    return c.true_path(_concept_nodes(spark, d), "document_id", table(spark, d, "concepts"))


@query(
    """WITH x AS (SELECT id, source_terminology AS s, unnest(map_entries(xrefs)) AS e FROM concepts), y AS (SELECT DISTINCT id, s, e.key AS system, unnest(e.value) AS code FROM x)
SELECT DISTINCT a.id AS left_id, b.id AS right_id FROM y a JOIN y b USING (system, code) WHERE a.s = 'DO' AND b.s = 'NCIT'"""
)
def xref_crosswalk(spark: SparkSession, d: str) -> DataFrame:
    """Concepts of two terminologies that share a code."""
    return c.crosswalk(table(spark, d, "concepts"), "DO", "NCIT")


@query(
    f"""WITH {_NODES}, m AS (SELECT * FROM gn WHERE node_type = 'concept' AND concept_id IS NOT NULL)
SELECT concept_id, count(DISTINCT document_id) AS documents, count(*) AS mentions, round(count(DISTINCT document_id) / (SELECT count(DISTINCT document_id) FROM m), 6) AS ratio FROM m GROUP BY concept_id"""
)
def concept_frequency(spark: SparkSession, d: str) -> DataFrame:
    """Document and mention frequency of every concept."""
    return c.document_frequency(_concept_nodes(spark, d), "document_id", "concept_id")


@query(
    f"""WITH {_NODES}, r AS (SELECT DISTINCT document_id, dataset FROM reports WHERE dataset IS NOT NULL),
m AS (SELECT DISTINCT dataset, gn.document_id, concept_id FROM gn JOIN r USING (document_id) WHERE node_type = 'concept' AND concept_id IS NOT NULL),
t AS (SELECT dataset, count(DISTINCT document_id) AS n FROM m GROUP BY dataset),
q AS (SELECT dataset, concept_id, count(DISTINCT document_id) / any_value(n) AS ratio FROM m JOIN t USING (dataset) GROUP BY dataset, concept_id),
pr AS (SELECT a.dataset AS l, b.dataset AS r FROM t a JOIN t b ON a.dataset < b.dataset), k AS (SELECT DISTINCT concept_id FROM q)
SELECT l AS left, r AS right, k.concept_id, round(coalesce(x.ratio, 0), 6) AS left_ratio, round(coalesce(y.ratio, 0), 6) AS right_ratio, round(coalesce(x.ratio, 0) - coalesce(y.ratio, 0), 6) AS ratio_diff
FROM pr CROSS JOIN k LEFT JOIN q x ON x.dataset = l AND x.concept_id = k.concept_id LEFT JOIN q y ON y.dataset = r AND y.concept_id = k.concept_id WHERE x.ratio > 0 OR y.ratio > 0"""
)
def cohort_compare(spark: SparkSession, d: str) -> DataFrame:
    """Document frequencies of concepts in every pair of data sets."""
    r = table(spark, d, "reports").select("document_id", "dataset").where("dataset is not null").distinct()
    return c.compare_cohorts(_concept_nodes(spark, d).join(r, "document_id"), "dataset", "document_id", "concept_id")


@query(
    f"""WITH {_NODES}, m AS (SELECT DISTINCT document_id, section_index, concept_id FROM gn WHERE node_type = 'concept' AND concept_id IS NOT NULL)
SELECT a.document_id, a.concept_id AS a, b.concept_id AS b, count(*) AS contexts FROM m a JOIN m b ON a.document_id = b.document_id AND a.section_index IS NOT DISTINCT FROM b.section_index AND a.concept_id < b.concept_id GROUP BY ALL"""
)
def cooccur_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of concepts that share a section."""
    return c.co_occurrence(_concept_nodes(spark, d), "document_id", ["section_index"], "concept_id")


@query(
    f"""WITH {_NODES}, ic AS (SELECT id AS concept_id, max(ic) AS ic FROM concepts GROUP BY id),
m AS (SELECT document_id, concept_id, count(*) AS mentions FROM gn WHERE node_type = 'concept' AND concept_id IS NOT NULL GROUP BY ALL),
s AS (SELECT document_id, concept_id, round(mentions + 0.1 * coalesce(ic, 0), 9) AS score FROM m LEFT JOIN ic USING (concept_id))
SELECT document_id, concept_id, score, CAST(row_number() OVER (PARTITION BY document_id ORDER BY score DESC, concept_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5"""
)
def topk_concepts(spark: SparkSession, d: str) -> DataFrame:
    """The five heaviest concepts of every report."""
    ic = table(spark, d, "concepts").groupBy(F.col("id").alias("concept_id")).agg(F.max("ic").alias("ic"))
    m = _concept_nodes(spark, d).groupBy("document_id", "concept_id").agg(F.count(F.lit(1)).alias("mentions"))
    return c.top_concepts(m.join(ic, "concept_id", "left").withColumn("depth", F.lit(0)), "document_id", 5).select("document_id", "concept_id", "score", "rank")


@query(
    f"""WITH {_LEX}, tx AS (SELECT DISTINCT id, term AS text FROM tm), sx AS (SELECT id, text, {_TOKENS.format("text")} AS ts FROM tx), st AS (SELECT id, text, ts, n, unnest(range(0, greatest(len(ts) - n + 1, 1))) AS start FROM sx, (SELECT DISTINCT n FROM lex) WHERE len(ts) > 0)
SELECT concept_id, count(*) AS hits, count(DISTINCT st.id) AS inside FROM st JOIN lex ON lex.n = st.n AND lex.phrase = array_to_string(ts[start + 1:start + st.n], ' ') GROUP BY concept_id"""
)
def term_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits of lexicon phrases inside the names and synonyms of the concepts."""
    o = table(spark, d, "concepts").where("match_enabled and name is not null").select("id", F.explode(F.concat(F.array("name"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("text")).where("text is not null").distinct()
    h = c.phrase_hits(o.withColumn("k", F.struct("id", "text")), "k", "text", _lexicon(spark, d))
    return h.groupBy("concept_id").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("k.id").alias("inside"))


@query("SELECT DISTINCT 'S' || s_suppkey AS left_id, 'C' || c_custkey AS right_id FROM supplier JOIN customer ON s_nationkey = c_nationkey")
def shared_code_crosswalk(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers and customers as concepts of two terminologies that share a nation's code."""
    x = lambda name, key, nation, prefix: table(spark, d, name).select(F.concat(F.lit(prefix), key).alias("id"), F.lit(prefix).alias("source_terminology"), F.create_map(F.lit("nation"), F.array(F.col(nation).cast("string"))).alias("xrefs"))
    return c.crosswalk(x("supplier", "s_suppkey", "s_nationkey", "S").unionByName(x("customer", "c_custkey", "c_nationkey", "C")), "S", "C")
