"""The whole way from pages to manifests as one set of lazy tables, and queries of keywords and ontology bundles."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import cleaning, concepts, graphs, keywords, ontology, runs
from ..registry import query
from ..runtime import cut, table
from .cleaning import SENTENCES, sentences
from .hierarchies import LINKS


@dataclass
class Pipeline:
    """Stages over a table of pages; each stage is a plan of the ones before it and can be switched off."""

    mode: str = "full"
    hops: int | None = 2
    stages: Mapping[str, bool] = field(default_factory=dict)
    limit: int | None = None

    def on(self, stage: str) -> bool:
        return self.stages.get(stage, True)

    def run(self, pages: DataFrame, ontology_table: DataFrame, labels: DataFrame) -> dict[str, DataFrame]:
        """``pages`` has (document_id, case_id, page_number, text); returns the tables of all stages."""
        one = pages.groupBy("document_id", "case_id", "page_number").agg(F.max("text").alias("text"))
        docs = one.groupBy("document_id", "case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda p: p["text"]), "\n\n").alias("text"))
        if self.limit:
            docs = docs.orderBy("document_id").limit(self.limit)
        out = {"documents": docs}
        lines = cleaning.drop_noise(cleaning.explode_lines(docs, "document_id", "text"))
        margins = cleaning.repeated_margins(one, "document_id", "page_number", "text")
        lines = cleaning.compact_blanks(cleaning.merge_wrapped(cleaning.without_margins(lines, margins, "document_id"), "document_id"), "document_id")
        lines = cut(lines)  # both parsers read them
        sections = cut(cleaning.best_sections(cleaning.sections_by_rules(lines, "document_id"), cleaning.sections_generic(lines, "document_id"), "document_id"))
        out |= {"lines": lines, "sections": sections}
        s = cleaning.sentence_view(sections, "document_id")
        s = cleaning.filter_sentences(s, self.mode)
        if "masked" in s.columns:
            s = s.withColumn("text", F.col("masked")).drop("masked", "reasons").where("text <> ''")
        w = Window.partitionBy("document_id").orderBy("sentence_index")
        s = s.withColumn("sentence_index", F.row_number().over(w) - 1)
        out["sentences"] = s
        if self.on("concepts"):
            keyed = s.withColumn("k", F.concat_ws("#", "document_id", "sentence_index"))
            m = concepts.longest_matches(concepts.phrase_hits(keyed, "k", "text", concepts.lexicon(ontology_table)), "k")
            out["mentions"] = m.join(keyed.select("k", "document_id", "sentence_index"), "k").drop("k")
            out["document_concepts"] = concepts.true_path(out["mentions"], "document_id", ontology_table, self.hops)
        if self.on("graphs"):
            nodes = graphs.hierarchy_nodes(s.withColumn("section_id", F.col("section_index").cast("long")), "document_id")
            edges = graphs.hierarchy_edges(nodes, "document_id")
            out |= {"nodes": nodes, "edges": edges, "descriptors": graphs.descriptor(nodes, edges, "document_id")}
        if self.on("manifest"):
            out["manifest"] = runs.manifest(labels, docs.select("case_id", "document_id"))
        return out


def _pipeline(spark: SparkSession, d: str, mode: str) -> dict[str, DataFrame]:
    p = table(spark, d, "page_extractions").select("document_id", "case_id", "page_number", F.col("final_text").alias("text")).where("text <> ''")
    return Pipeline(mode=mode).run(p, concepts.fallback(spark), table(spark, d, "labels").select("case_id", "slide_id", "label").distinct())


@query()
def pipeline_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of all reports by the whole pipeline, masked."""
    return _pipeline(spark, d, "masked")["sentences"]


@query()
def pipeline_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Concepts of all reports by the whole pipeline, with ancestors."""
    return _pipeline(spark, d, "full")["document_concepts"]


@query()
def pipeline_descriptors(spark: SparkSession, d: str) -> DataFrame:
    """Graph descriptors of all reports by the whole pipeline."""
    return _pipeline(spark, d, "full")["descriptors"]


@query(
    "WITH "
    + SENTENCES
    + ", sx AS (SELECT document_id, regexp_replace(text, '[\\p{Lo}\\p{Mn}\\p{Mc}]', 'x', 'g') AS t FROM sv), x AS ("
    + " UNION ALL ".join(f"SELECT document_id, '{k}' AS keyword, '{c}' AS category, len(regexp_extract_all(t, '(?i){p}')) AS n FROM sx" for k, c, p, _ in keywords.RULES)
    + ") SELECT document_id, keyword, category, CAST(sum(n) AS BIGINT) AS n FROM x WHERE n > 0 GROUP BY ALL"
)
def keyword_counts(spark: SparkSession, d: str) -> DataFrame:
    """Matches of every keyword rule in every report."""
    k = keywords.counts(sentences(spark, d), ["document_id"], "text")
    return k.groupBy("document_id", "keyword", "category").agg(F.sum("n").alias("n"))


@query()
def keyword_spans(spark: SparkSession, d: str) -> DataFrame:
    """Keywords of every section with counts and first forms."""
    s = table(spark, d, "sections").select("section_id", "text").where("text is not null").distinct()
    return keywords.per_text(keywords.spans(s, "section_id", "text"), "section_id")


_DENY = "|".join(keywords.GENERIC_NAMES)
_LEAK = "|".join(keywords.LEAKING_NAMES)
_NO = "|".join(w if w != w.strip() else f" {w} " for w in keywords.NO_EVIDENCE)
_YES = "|".join(keywords.EVIDENCE)


@query(
    rf"""WITH n AS (SELECT DISTINCT id, lower(trim(regexp_replace(coalesce(name, ''), '\s+', ' ', 'g'))) AS x FROM concepts)
SELECT id, (regexp_matches(x, '(?:^| )(?:{_DENY})$') OR regexp_matches(x, '{_LEAK}') OR regexp_matches(x, '{keywords.LEAKING_CODE}')) AS denied,
(NOT regexp_matches(' ' || x || ' ', '{_NO}') AND regexp_matches(' ' || x || ' ', '{_YES}')) AS evidence FROM n"""
)
def concept_filters(spark: SparkSession, d: str) -> DataFrame:
    """Which concepts a graph leaves out, and which are evidence."""
    c = table(spark, d, "concepts").select("id", "name").distinct()
    return c.select("id", keywords.is_denied(F.col("name")).alias("denied"), keywords.is_evidence(F.col("name")).alias("evidence"))


@query(
    f"""WITH RECURSIVE {LINKS}
r AS (SELECT DISTINCT id, name, synonyms FROM concepts), sd AS (SELECT DISTINCT lower(trim(id)) AS k FROM r WHERE (coalesce(regexp_matches(lower(name), 'carcinoma|invasion'), false) OR len(list_filter(coalesce(synonyms, []), lambda s: regexp_matches(lower(s), 'carcinoma|invasion'))) > 0) AND NOT coalesce(regexp_matches(lower(name), 'lesion'), false)),
kp AS (SELECT k FROM sd UNION SELECT up.ancestor FROM up JOIN sd ON sd.k = up.node), nm AS (SELECT k, min(id) AS pid FROM c GROUP BY k),
ps AS (SELECT e.child AS k, string_agg(DISTINCT pid, '|' ORDER BY pid) AS parents FROM e JOIN kp a ON a.k = e.child JOIN kp b ON b.k = e.parent JOIN nm ON nm.k = e.parent GROUP BY e.child)
SELECT DISTINCT r.id, r.name, coalesce(ps.parents, '') AS parents FROM r JOIN kp ON kp.k = lower(trim(r.id)) LEFT JOIN ps ON ps.k = lower(trim(r.id))"""
)
def ontology_subset(spark: SparkSession, d: str) -> DataFrame:
    """Carcinomas and invasions with all their ancestors."""
    return ontology.subset(table(spark, d, "concepts"), ("carcinoma", "invasion"), ("lesion",)).select("id", "name", F.concat_ws("|", "parents").alias("parents")).distinct()


@query()
def ontology_bundle(spark: SparkSession, d: str) -> DataFrame:
    """Concepts with those of another terminology that share a code merged in."""
    c = table(spark, d, "concepts")
    pairs = concepts.crosswalk(c, "NCIT", "SNOMEDCT").select(F.col("left_id").alias("id"), F.col("right_id").alias("other_id"))
    b = ontology.bundle(c, pairs)
    return b.select("id", "name", F.concat_ws("|", "synonyms").alias("synonyms"), F.concat_ws("|", "parents").alias("parents"), F.concat_ws("|", "sources").alias("sources"))


@query(
    """WITH r AS (SELECT DISTINCT id, name, synonyms, coalesce(source_terminology, '') AS source_terminology FROM concepts), x AS (SELECT id, trim(name) AS term, source_terminology, 'name' AS origin FROM r UNION ALL SELECT id, trim(unnest(synonyms)), source_terminology, 'synonym' FROM r)
SELECT id, min(term) AS term, source_terminology, origin FROM x WHERE term <> '' GROUP BY id, lower(term), source_terminology, origin"""
)
def synonym_records(spark: SparkSession, d: str) -> DataFrame:
    """Names and synonyms of the ontology as records with provenance."""
    return ontology.synonym_records(table(spark, d, "concepts"))


_KW = [r for r in keywords.RULES if r[0] not in keywords.OPEN_RULES]
_WORDS = (
    SENTENCES
    + ", o AS (SELECT document_id, section_id, text, row_number() OVER (PARTITION BY document_id ORDER BY section_index, section_id, section_sentence_index) - 1 AS si FROM sv), ox AS (SELECT document_id, si, regexp_replace(text, '[\\p{Lo}\\p{Mn}\\p{Mc}]', 'x', 'g') AS t FROM o), f AS ("
    + " UNION ALL ".join(f"SELECT document_id, si, '{k}' AS keyword, CAST({w} AS DOUBLE) AS weight FROM ox WHERE regexp_matches(t, '(?i){p}')" for k, c, p, w in _KW)
    + """), n AS (SELECT document_id, count(DISTINCT keyword) AS k FROM f GROUP BY document_id), st AS (SELECT DISTINCT o.document_id, CASE WHEN coalesce(n.k, 0) < 2 THEN 'no_stage_keywords' ELSE 'ok' END AS state FROM o LEFT JOIN n USING (document_id)),
k0 AS (SELECT o.document_id, o.section_id, o.si, row_number() OVER (PARTITION BY o.document_id ORDER BY o.si) - 1 AS sn FROM o JOIN st USING (document_id) WHERE state = 'ok' AND EXISTS (SELECT 1 FROM f WHERE f.document_id = o.document_id AND f.si = o.si)),
sf AS (SELECT document_id, section_id, row_number() OVER (PARTITION BY document_id ORDER BY min(sn)) - 1 AS sec FROM k0 GROUP BY document_id, section_id),
nd AS (SELECT document_id, 'document' AS node_type, 0 AS level, 0 AS ord, NULL AS sec, NULL AS sn, NULL AS keyword, 1.0 AS w FROM st WHERE state = 'ok' UNION ALL SELECT document_id, 'section', 1, sec, sec, NULL, NULL, 1.0 FROM sf UNION ALL SELECT document_id, 'sentence', 2, sn, sec, sn, NULL, 1.0 FROM k0 JOIN sf USING (document_id, section_id)
  UNION ALL SELECT f.document_id, 'word', 3, row_number() OVER (PARTITION BY f.document_id ORDER BY sn, keyword) - 1, sec, sn, keyword, weight FROM f JOIN k0 ON k0.document_id = f.document_id AND k0.si = f.si JOIN sf ON sf.document_id = k0.document_id AND sf.section_id = k0.section_id),
nn AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY level, ord) - 1 AS i FROM nd)"""
)


def _word_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    w = Window.partitionBy("document_id").orderBy("section_index", "section_id", "section_sentence_index")
    s = cut(sentences(spark, d).select("document_id", F.col("section_id").alias("section"), (F.row_number().over(w) - 1).alias("sentence_index"), "text"))
    found = cut(keywords.counts(s, ["document_id", "sentence_index"], "text", _KW).select("document_id", "sentence_index", "keyword", "weight"))
    return keywords.word_graph(s.select("document_id", "section", "sentence_index"), found, "document_id", 2)


@query(f"WITH {_WORDS} SELECT document_id, CAST(i AS INTEGER) AS node_index, node_type, CAST(sec AS INTEGER) AS section, CAST(sn AS INTEGER) AS sentence, keyword FROM nn")
def keyword_graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of every report's graph of sentences with keywords, down to the words."""
    return _word_graph(spark, d)[0].select("document_id", "node_index", "node_type", "section", "sentence", "keyword")


@query(
    f"""WITH {_WORDS}, e AS (SELECT a.document_id, a.i AS source, b.i AS target, 'parent' AS edge_type, b.w AS weight FROM nn a JOIN nn b ON b.document_id = a.document_id AND b.level = a.level + 1 WHERE a.level = 0 OR a.level = 1 AND a.sec = b.sec OR a.level = 2 AND a.sn = b.sn
UNION ALL SELECT document_id, i, lead(i) OVER (PARTITION BY document_id, node_type, CASE WHEN node_type = 'word' THEN sn END ORDER BY ord), 'next', 0.25 FROM nn WHERE level > 0)
SELECT document_id, CAST(source AS INTEGER) AS source, CAST(target AS INTEGER) AS target, edge_type, CAST(weight AS DOUBLE) AS weight FROM e WHERE target IS NOT NULL"""
)
def keyword_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of every report's keyword graph."""
    return _word_graph(spark, d)[1]


@query(f"WITH {_WORDS} SELECT document_id, state FROM st")
def keyword_graph_states(spark: SparkSession, d: str) -> DataFrame:
    """Which reports have a keyword graph, and why others have none."""
    return _word_graph(spark, d)[2]
