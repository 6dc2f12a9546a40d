"""Queries of manifests, splits and the analytics of logs. The event table stands for run logs: a user is a run,
an event a record, its value the metric, a purchase a final record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stage_label
from ..operators import runs as r
from ..registry import query
from ..runtime import table

_LAB = "lb AS (SELECT DISTINCT case_id, slide_id, label FROM labels)"
_REP = "rp AS (SELECT DISTINCT case_id, document_id FROM reports)"


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select("case_id", "slide_id", "label").distinct()


def _reports(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reports").select("case_id", "document_id").distinct()


@query(f"WITH {_LAB}, {_REP} SELECT lb.case_id, slide_id, label, document_id FROM lb JOIN rp USING (case_id)")
def manifest_join(spark: SparkSession, d: str) -> DataFrame:
    """Every slide with every report of its case."""
    return r.manifest(_labels(spark, d), _reports(spark, d)).select("case_id", "slide_id", "label", "document_id")


@query(
    f"""WITH {_LAB}, {_REP}, sl AS (SELECT slide_id AS k, max(CASE WHEN label = 1 THEN 'test' ELSE 'train' END) AS s FROM lb WHERE label IS NOT NULL AND slide_id LIKE '%1' GROUP BY slide_id),
cs AS (SELECT case_id AS k, 'val' AS s FROM rp GROUP BY case_id HAVING count(*) > 1)
SELECT lb.case_id, lb.slide_id, document_id, coalesce(sl.s, cs.s, '') AS split FROM lb JOIN rp USING (case_id) LEFT JOIN sl ON sl.k = lb.slide_id LEFT JOIN cs ON cs.k = lb.case_id"""
)
def split_coalesce(spark: SparkSession, d: str) -> DataFrame:
    """The manifest with the slide's split, else the case's."""
    lab, rep = _labels(spark, d), _reports(spark, d)
    by_slide = lab.where("label is not null and slide_id like '%1'").select(F.lit("slide").alias("kind"), F.col("slide_id").alias("key"), F.when(F.col("label") == 1, "test").otherwise("train").alias("split"))
    by_case = rep.groupBy("case_id").count().where("count > 1").select(F.lit("case").alias("kind"), F.col("case_id").alias("key"), F.lit("val").alias("split"))
    return r.manifest(lab, rep, by_slide.unionByName(by_case)).select("case_id", "slide_id", "document_id", "split")


@query(f"WITH {_LAB}, {_REP} SELECT 'left' AS side, case_id FROM (SELECT case_id FROM lb WHERE case_id IS NOT NULL EXCEPT SELECT case_id FROM rp) UNION ALL SELECT 'right', case_id FROM (SELECT case_id FROM rp WHERE case_id IS NOT NULL EXCEPT SELECT case_id FROM lb)")
def unmatched_cases(spark: SparkSession, d: str) -> DataFrame:
    """Labelled cases without report and reports without label."""
    return r.unmatched(_labels(spark, d), _reports(spark, d), "case_id")


@query(
    """WITH x AS (SELECT DISTINCT doc_id, case_id FROM documents), a AS (SELECT case_id, min(document_id) AS v FROM reports GROUP BY case_id), b AS (SELECT case_id, min(document_id) AS v FROM page_extractions GROUP BY case_id)
SELECT doc_id, coalesce(a.v, b.v) AS document_id FROM x LEFT JOIN a USING (case_id) LEFT JOIN b USING (case_id)"""
)
def ranked_fallback(spark: SparkSession, d: str) -> DataFrame:
    """A report for every document: of its case's reports, else of its pages."""
    docs = table(spark, d, "documents").select("doc_id", "case_id").distinct()
    return r.ranked_fallback(docs, "case_id", [(table(spark, d, "reports"), "case_id"), (table(spark, d, "page_extractions"), "case_id")], "document_id").select("doc_id", "document_id")


@query(
    """WITH g AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source), q AS (SELECT *, n * 100 / sum(n) OVER () AS q FROM g), f AS (SELECT *, floor(q) AS f FROM q),
r AS (SELECT *, row_number() OVER (ORDER BY round(q - f, 9) DESC, source) AS r, 100 - sum(f) OVER () AS left_ FROM f) SELECT source, n, CAST(f + (r <= left_)::INT AS INTEGER) AS test FROM r"""
)
def split_alloc(spark: SparkSession, d: str) -> DataFrame:
    """A hundred test documents allocated to the sources by largest remainders."""
    n = table(spark, d, "documents").where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return r.allocate_tests(n, "source", "n", 100)


@query(
    f"""WITH {_LAB}, x AS (SELECT DISTINCT slide_id, label FROM lb WHERE label IS NOT NULL), n AS (SELECT label, count(*) AS n FROM x GROUP BY label), t AS (SELECT *, greatest(1, least(round_even(sum(n) OVER () * 0.2, 0), sum(n) OVER () - 1)) AS t FROM n),
q AS (SELECT *, n * t / sum(n) OVER () AS q FROM t), f AS (SELECT *, floor(q) AS f, row_number() OVER (ORDER BY round(q - floor(q), 9) DESC, label) AS r FROM q), a AS (SELECT label, f + (r <= t - sum(f) OVER ())::INT AS test FROM f)
SELECT slide_id, x.label, CASE WHEN row_number() OVER (PARTITION BY x.label ORDER BY md5(slide_id || '#0'), slide_id) <= test THEN 'test' ELSE 'train' END AS split FROM x JOIN a USING (label)"""
)
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    """Train and test slides per label."""
    return r.stratified_split(_labels(spark, d).where("label is not null"), "slide_id", "label", 0.2)


_EV = "ev AS (SELECT user_id AS run, event_id AS step, value AS metric, event_type = 'purchase' AS final, event_type AS method FROM events)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("metric"), (F.col("event_type") == "purchase").alias("final"), F.col("event_type").alias("method"), "ts")


@query(f"WITH {_EV} SELECT run, step, metric, final FROM ev QUALIFY row_number() OVER (PARTITION BY run ORDER BY final DESC, CASE WHEN NOT final THEN metric END DESC NULLS LAST, CASE WHEN final THEN step END DESC NULLS LAST, step) = 1")
def best_or_final(spark: SparkSession, d: str) -> DataFrame:
    """The last final record of every run, else its best."""
    return r.best_or_final(_events(spark, d), "run", "step", "metric", "final").select("run", "step", "metric", "final")


@query(f"WITH {_EV} SELECT run, step, metric FROM ev QUALIFY row_number() OVER (PARTITION BY run ORDER BY metric DESC NULLS LAST, step) = 1")
def best_record(spark: SparkSession, d: str) -> DataFrame:
    """The best record of every run, the earliest of ties."""
    return r.best_or_final(_events(spark, d), "run", "step", "metric", "final", "max").select("run", "step", "metric")


@query(
    f"""WITH {_EV}, b AS (SELECT *, max(metric) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ev)
SELECT run, step, round(greatest(metric, before), 6) AS best, coalesce(metric > before, true) AS new_best FROM b"""
)
def running_best(spark: SparkSession, d: str) -> DataFrame:
    """The best metric so far at every record."""
    return r.running_best(_events(spark, d), "run", "step", "metric").select("run", "step", F.round("best", 6).alias("best"), "new_best")


@query(
    f"""WITH {_EV}, i AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) AS i, max(metric) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM ev),
w AS (SELECT *, i - coalesce(max(CASE WHEN metric > b OR b IS NULL AND metric IS NOT NULL THEN i END) OVER (PARTITION BY run ORDER BY step), 0) AS wait FROM i) SELECT run, min(CASE WHEN wait >= 10 THEN step END) AS stop FROM w GROUP BY run"""
)
def early_stops(spark: SparkSession, d: str) -> DataFrame:
    """Where every run would stop with a patience of ten records."""
    return r.early_stops(_events(spark, d), "run", "step", "metric", 10)


@query(
    f"""WITH {_EV} SELECT run, method, step, metric FROM ev
QUALIFY row_number() OVER (PARTITION BY run ORDER BY CASE method WHEN 'purchase' THEN 40 WHEN 'signup' THEN 30 WHEN 'click' THEN 25 ELSE 10 END DESC, step) = 1"""
)
def priority_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """One record a run by the priority of its source."""
    p = F.when(F.col("method") == "purchase", 40).when(F.col("method") == "signup", 30).when(F.col("method") == "click", 25).otherwise(10)
    return r.priority_dedupe(_events(spark, d), ["run"], p, F.asc("step")).select("run", "method", "step", "metric")


_SPLIT = f"{_EV}, sp AS (SELECT run % 5 AS ds, method, run AS split, avg(metric) AS metric FROM ev WHERE method IS NOT NULL GROUP BY ALL)"


def _by_split(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).where("method is not null").groupBy((F.col("run") % 5).alias("ds"), "method", F.col("run").alias("split")).agg(F.avg("metric").alias("metric"))


@query(
    f"""WITH {_SPLIT}, x AS (SELECT a.ds, a.method, a.metric - b.metric AS d FROM sp a JOIN sp b ON a.ds = b.ds AND a.split = b.split AND b.method = 'click' WHERE a.method <> 'click')
SELECT ds, method, count(d) AS n, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS std, round(median(d), 6) AS median, count(*) FILTER (d > 0) AS wins FROM x GROUP BY ds, method"""
)
def paired_delta(spark: SparkSession, d: str) -> DataFrame:
    """Gains of every method over the baseline on common splits."""
    return r.paired_delta(_by_split(spark, d), "ds", "method", "split", "metric", "click")


@query(f"WITH {_SPLIT}, g AS (SELECT ds, method, count(metric) AS n, avg(metric) AS m, CASE WHEN count(metric) > 1 THEN stddev_samp(metric) ELSE 0 END AS s FROM sp GROUP BY ds, method) SELECT ds, method, n, format('{{:.4f}} +/- {{:.4f}}', m, s) AS text FROM g")
def mean_std(spark: SparkSession, d: str) -> DataFrame:
    """Mean and deviation of every method as text."""
    return r.mean_std(_by_split(spark, d), ["ds", "method"], "metric").select("ds", "method", "n", "text")


@query(
    """WITH m AS (SELECT doc_id, max(toxic) AS y FROM moderation_labels WHERE toxic IS NOT NULL GROUP BY doc_id), x AS (SELECT y, n_chars AS s FROM m JOIN documents USING (doc_id) WHERE n_chars IS NOT NULL),
k AS (SELECT y, avg(rk) OVER (PARTITION BY s) AS mid FROM (SELECT y, s, row_number() OVER (ORDER BY s) AS rk FROM x)),
a AS (SELECT count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q, sum(mid) FILTER (y = 1) AS r FROM k) SELECT round((r - p * (p + 1) / 2) / (p * q), 6) AS auc FROM a"""
)
def auc_midrank(spark: SparkSession, d: str) -> DataFrame:
    """How well a document's length tells its label."""
    m = table(spark, d, "moderation_labels").where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    return r.auc(m.join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id"), "y", "n_chars")


@query(f"WITH {_LAB}, g AS (SELECT label, count(*) AS n FROM lb WHERE label IN (0, 1) GROUP BY label) SELECT label, round((SELECT sum(n) FROM g) / (2 * n), 6) AS weight FROM g WHERE (SELECT count(*) FROM g) = 2")
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights that even out the labels."""
    return r.class_weights(_labels(spark, d), "label")


@query(f"WITH {_REP}, s AS (SELECT DISTINCT section_id, document_id FROM sections), c AS (SELECT document_id, count(section_id) AS n FROM (SELECT DISTINCT document_id FROM rp) LEFT JOIN s USING (document_id) GROUP BY document_id) SELECT count(n) AS n, round(avg(n), 6) AS mean, median(n) AS median, CAST(quantile_disc(n, 0.95) AS DOUBLE) AS p95, CAST(max(n) AS DOUBLE) AS max FROM c")
def section_audit(spark: SparkSession, d: str) -> DataFrame:
    """Sections per report: mean, median, 95th percentile and maximum."""
    s = table(spark, d, "sections").select("section_id", "document_id").distinct()
    n = _reports(spark, d).select("document_id").distinct().join(s, "document_id", "left").groupBy("document_id").agg(F.count("section_id").alias("n"))
    return r.audit(n, "n")


@query(
    """WITH a AS (SELECT doc_id, max(toxic) = 1 AS c FROM moderation_labels WHERE annotator = 'rater_1' AND toxic IS NOT NULL GROUP BY doc_id), b AS (SELECT doc_id, max(toxic) = 1 AS c FROM moderation_labels WHERE annotator = 'rater_2' AND toxic IS NOT NULL GROUP BY doc_id)
SELECT doc_id, CASE WHEN a.c AND b.c THEN 'both_correct' WHEN b.c THEN 'benefit' WHEN a.c THEN 'harm' ELSE 'both_wrong' END AS benefit FROM a JOIN b USING (doc_id)"""
)
def benefit_classes(spark: SparkSession, d: str) -> DataFrame:
    """How two raters' verdicts compare on the documents both judged."""
    m = table(spark, d, "moderation_labels").where("toxic is not null")
    one = lambda who: m.where(F.col("annotator") == who).groupBy("doc_id").agg((F.max("toxic") == 1).alias("correct"))
    return r.benefit_classes(one("rater_1"), one("rater_2"), "doc_id")


@query(f"WITH {_EV}, g AS (SELECT method, count(DISTINCT step) AS n, max(step) AS m FROM ev WHERE method IS NOT NULL GROUP BY method), t AS (SELECT method, m, (SELECT max(n) FROM g) + 5 - n AS k FROM g) SELECT method, unnest(range(m + 1, m + k + 1)) AS next_index FROM t")
def next_indexes(spark: SparkSession, d: str) -> DataFrame:
    """Indexes still to do for every task."""
    e = _events(spark, d).where("method is not null")
    most = e.groupBy("method").agg(F.count_distinct("step").alias("n")).agg(F.max("n")).first()
    return r.next_indexes(e, "method", "step", (most[0] or 0) + 5)


@query(
    r"""WITH l AS (SELECT DISTINCT case_id, pathologic_stage FROM labels), k AS (SELECT case_id, upper(regexp_extract(regexp_replace(coalesce(pathologic_stage, ''), '\s+', ' ', 'g'), '(?i)\bstage\s+([IVX0-9]+[A-D]?)\b', 1)) AS k FROM l)
SELECT case_id, CAST(max(CASE WHEN regexp_matches(k, '^(?:III|IV)') THEN 1 WHEN regexp_matches(k, '^I') THEN 0 END) AS INTEGER) AS stage_label, count(*) AS written FROM k GROUP BY case_id"""
)
def case_stages(spark: SparkSession, d: str) -> DataFrame:
    """The label of every case, with the number of ways its stage is written."""
    x = table(spark, d, "labels").select("case_id", "pathologic_stage").distinct()
    return x.groupBy("case_id").agg(F.max(stage_label("pathologic_stage")).alias("stage_label"), F.count(F.lit(1)).alias("written"))


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    """Events by a field of their JSON properties."""
    e = table(spark, d, "events")
    return e.groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))
