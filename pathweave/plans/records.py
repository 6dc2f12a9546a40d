"""Queries of experiment records. The event table stands for logs (a user is a run, an event a step, its value the
metric, its type the method); labels and reports stand for slides and their graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records as r
from ..operators import runs
from ..registry import query
from ..runtime import table

_LAB = "lb AS (SELECT DISTINCT case_id, slide_id, label FROM labels)"
_REP = "rp AS (SELECT DISTINCT document_id, case_id, file_name, source_path, dataset FROM reports)"


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select("case_id", "slide_id", "label").distinct()


def _reports(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reports").select("document_id", "case_id", "file_name", "source_path", "dataset").distinct()


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query(
    f"""WITH {_LAB}, {_REP}, one AS (SELECT case_id, label FROM lb WHERE label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY slide_id, label) = 1), s AS (SELECT DISTINCT case_id, document_id AS slide_id FROM rp WHERE case_id IS NOT NULL)
SELECT s.case_id, s.slide_id, label, CASE WHEN one.case_id IS NULL THEN 'unmatched' ELSE 'matched' END AS state FROM s LEFT JOIN one USING (case_id)"""
)
def expanded_cases(spark: SparkSession, d: str) -> DataFrame:
    """The label of every case on each of its reports."""
    one = _labels(spark, d).where("label is not null").select("case_id", "label", F.struct("slide_id", "label").alias("order"))
    return r.expand_cases(one, _reports(spark, d).where("case_id is not null").select("case_id", F.col("document_id").alias("slide_id")))


@query(
    f"""WITH {_LAB}, {_REP}, sp AS (SELECT DISTINCT case_id, slide_id, CASE WHEN slide_id LIKE '%1' THEN 'test' ELSE 'train' END AS split FROM lb WHERE slide_id IS NOT NULL AND case_id IS NOT NULL)
SELECT sp.case_id, sp.slide_id, split, label FROM sp JOIN lb USING (case_id, slide_id) WHERE label IS NOT NULL AND slide_id IN (SELECT slide_id FROM labels WHERE pathologic_stage IS NOT NULL)"""
)
def assembled_samples(spark: SparkSession, d: str) -> DataFrame:
    """Slides of a split with label and a file, on the key of case and slide."""
    lab = _labels(spark, d)
    split = lab.where("slide_id is not null and case_id is not null").select("case_id", "slide_id", F.when(F.col("slide_id").like("%1"), "test").otherwise("train").alias("split")).distinct()
    files = table(spark, d, "labels").where("pathologic_stage is not null").select("slide_id")
    return r.samples(split, lab.where("label is not null"), [files]).select("case_id", "slide_id", "split", "label")


_MAN = f"{_LAB}, {_REP}, mn AS (SELECT lb.case_id, slide_id, document_id, dataset, CASE WHEN label IS NULL THEN '' WHEN slide_id LIKE '%1' THEN 'test' WHEN slide_id LIKE '%2' THEN 'val' ELSE 'train' END AS split FROM lb JOIN rp USING (case_id))"


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    split = F.when(F.col("label").isNull(), "").when(F.col("slide_id").like("%1"), "test").when(F.col("slide_id").like("%2"), "val").otherwise("train")
    return runs.manifest(_labels(spark, d), _reports(spark, d)).withColumn("split", split)


@query(f"WITH {_MAN} SELECT case_id, slide_id, document_id, dataset FROM mn WHERE split = 'test' AND upper(dataset) IN ('BRCA', 'KIRC', 'TCGA-BRCA', 'TCGA-KIRC')")
def manifest_samples(spark: SparkSession, d: str) -> DataFrame:
    """Test rows of the manifest of two data sets."""
    return r.manifest_samples(_manifest(spark, d), "test", ["brca", "kirc", "tcga-brca", "tcga-kirc"]).select("case_id", "slide_id", "document_id", "dataset")


@query(
    f"""WITH {_MAN} SELECT count(*) AS rows, count(DISTINCT case_id) AS cases, count(DISTINCT slide_id) AS slides, count(*) FILTER (split = '') AS no_split, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM mn"""
)
def manifest_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the manifest."""
    return r.manifest_summary(_manifest(spark, d))


_EV = "ev AS (SELECT event_id, user_id, event_type, value, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)"


@query(f"WITH {_EV}, b AS (SELECT * FROM ev WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1) SELECT event_type, count(*) AS runs, round(avg(k), 6) AS mean FROM b GROUP BY event_type")
def gate_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean of a field at the best step of every run, per method."""
    return r.means_at_best(_events(spark, d), "user_id", "event_id", "value", ["event_type"], "k")


@query(
    f"WITH {_EV}, x AS (SELECT event_type, 'value' AS key, CAST(value AS DOUBLE) AS v FROM ev UNION ALL SELECT event_type, 'k', k FROM ev UNION ALL SELECT event_type, 'high', CASE WHEN value > 100 THEN value END FROM ev) SELECT event_type, key, count(*) AS n, round(avg(v), 6) AS mean FROM x WHERE v IS NOT NULL GROUP BY ALL"
)
def key_means(spark: SparkSession, d: str) -> DataFrame:
    """Means of every key of a map of numbers, per method."""
    m = F.create_map(F.lit("value"), F.col("value").cast("double"), F.lit("k"), F.col("k").cast("double"), F.lit("high"), F.when(F.col("value") > 100, F.col("value")).cast("double"))
    return r.mean_of_keys(_events(spark, d).withColumn("m", m), ["event_type"], "m")


@query(
    f"""WITH {_EV}, a AS (SELECT DISTINCT event_type FROM ev), b AS (SELECT unnest(range(0, 12)) AS bucket), g AS (SELECT event_type, user_id % 13 AS bucket, count(value) AS n, round(avg(value), 6) AS mean FROM ev WHERE user_id % 3 = 0 GROUP BY ALL)
SELECT event_type, CAST(bucket AS BIGINT) AS bucket, coalesce(n, 0) AS n, mean, CASE WHEN n > 0 THEN 'complete' ELSE 'missing' END AS state FROM a CROSS JOIN b LEFT JOIN g USING (event_type, bucket)"""
)
def variant_roll_up(spark: SparkSession, d: str) -> DataFrame:
    """Results of every combination of method and variant, with those that are missing. The runs whose number three
    divides are the finished ones."""
    e = _events(spark, d)
    done = e.where("user_id % 3 = 0").withColumn("bucket", F.col("user_id") % 13)
    return r.roll_up(done, [e.select("event_type").distinct(), spark.range(12).withColumnRenamed("id", "bucket")], ["event_type", "bucket"], "value")


@query(f"WITH {_EV}, g AS (SELECT user_id, event_type, avg(value) AS v FROM ev GROUP BY ALL) SELECT user_id, event_type, round(v, 6) AS value, round(v - avg(CASE WHEN event_type = 'view' THEN v END) OVER (PARTITION BY user_id), 6) AS gain FROM g")
def baseline_gain(spark: SparkSession, d: str) -> DataFrame:
    """Mean of every method and run with its gain over the run's baseline."""
    g = _events(spark, d).groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    return r.over_baseline(g, "user_id", "event_type", "v", "view").select("user_id", "event_type", F.round("v", 6).alias("value"), "gain")


@query(
    f"WITH {_EV}, c AS (SELECT DISTINCT user_id, k, true AS s FROM ev WHERE event_type = 'purchase' AND k IS NOT NULL), l AS (SELECT DISTINCT user_id, k FROM ev WHERE event_type IN ('purchase', 'signup') AND k IS NOT NULL) SELECT user_id, k, coalesce(s, false) AS strict FROM l LEFT JOIN c USING (user_id, k)"
)
def completed_splits(spark: SparkSession, d: str) -> DataFrame:
    """Splits that have a checkpoint or a log, and those that have a checkpoint."""
    e = _events(spark, d)
    saved, logged = e.where("event_type = 'purchase'"), e.where("event_type = 'signup'")
    strict = r.completed(saved, logged, "user_id", "k", True).withColumn("strict", F.lit(True))
    return r.completed(saved, logged, "user_id", "k").join(strict, ["user_id", "k"], "left").na.fill(False, ["strict"])


@query(f"WITH {_EV} SELECT user_id, CAST(event_id AS VARCHAR) AS folder, k, value FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC NULLS LAST, value DESC NULLS LAST, CAST(event_id AS VARCHAR)) = 1")
def latest_runs(spark: SparkSession, d: str) -> DataFrame:
    """The folder of every run that is greatest by match and count."""
    x = _events(spark, d).withColumn("folder", F.col("event_id").cast("string"))
    return r.latest_run(x, "user_id", "k", "value").select("user_id", "folder", "k", "value")


@query(
    f"""WITH {_EV}, g AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS done, count(*) FILTER (event_type IN ('purchase', 'signup')) - 10 AS planned, max(event_id) FILTER (event_type = 'error') = max(event_id) AS running FROM ev GROUP BY user_id)
SELECT user_id, CASE WHEN planned > 0 AND done >= planned THEN 'complete' WHEN coalesce(running, false) THEN 'running' WHEN done > 0 THEN 'partial' WHEN planned > 0 THEN 'queued' ELSE 'not-run' END AS state FROM g"""
)
def run_states(spark: SparkSession, d: str) -> DataFrame:
    """How far every run is."""
    of = lambda *k: F.col("event_type").isin(*k)
    g = _events(spark, d).groupBy("user_id").agg(
        F.count_if(of("purchase")).alias("done"), (F.count_if(of("purchase", "signup")) - 10).alias("planned"), F.coalesce(F.max(F.when(of("error"), F.col("event_id"))) == F.max("event_id"), F.lit(False)).alias("running")
    )
    return g.select("user_id", r.state_of_run(F.col("done"), F.col("planned"), F.col("running")).alias("state"))


@query(f"WITH {_EV}, p AS (SELECT event_id, k / 100.0 AS p, (value > 50)::INT AS label FROM ev WHERE k IS NOT NULL) SELECT event_id, CAST(p AS DOUBLE) AS p, label, round(CAST(abs(p - 0.5) AS DOUBLE), 9) AS margin FROM p WHERE (p >= 0.5)::INT <> label ORDER BY margin DESC, event_id LIMIT 20")
def confident_errors(spark: SparkSession, d: str) -> DataFrame:
    """The twenty most confident wrong predictions, a top-k report."""
    p = _events(spark, d).where("k is not null").select("event_id", (F.col("k") / 100).alias("p"), (F.col("value") > 50).cast("int").alias("label"))
    return r.confident_errors(p, "label", "p", 20, "event_id")


@query("WITH s AS (SELECT DISTINCT slide_id FROM labels WHERE slide_id IS NOT NULL), x AS (SELECT slide_id, regexp_extract(slide_id, '(\\d+)', 1) AS digits FROM s) SELECT slide_id, CAST(nullif(digits, '') AS INTEGER) AS split_idx, CAST(row_number() OVER (ORDER BY CAST(nullif(digits, '') AS INTEGER) NULLS LAST, slide_id) AS INTEGER) AS place FROM x WHERE length(digits) < 9")
def numbered_slides(spark: SparkSession, d: str) -> DataFrame:
    """Slides by the first number in their name, and their place in that order."""
    from pyspark.sql import Window

    s = table(spark, d, "labels").where("slide_id is not null").select("slide_id").distinct()
    x = s.where(F.length(F.regexp_extract("slide_id", r"(\d+)", 1)) < 9).withColumn("split_idx", r.split_index(F.col("slide_id"), F.lit(None).cast("string")))
    return x.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("split_idx").asc_nulls_last(), "slide_id")))


@query("SELECT case_id FROM (SELECT case_id FROM reports INTERSECT SELECT case_id FROM labels) WHERE case_id IS NOT NULL")
def common_cases(spark: SparkSession, d: str) -> DataFrame:
    """Cases with reports and labels; an error if there is none."""
    return r.common_ids(table(spark, d, "reports").where("case_id is not null"), table(spark, d, "labels").where("case_id is not null"), "case_id")


@query("SELECT case_id FROM ((SELECT case_id FROM reports INTERSECT SELECT case_id FROM labels WHERE label IS NOT NULL) EXCEPT SELECT case_id FROM graph_nodes) WHERE case_id IS NOT NULL")
def work_list(spark: SparkSession, d: str) -> DataFrame:
    """Cases with reports and a label that have no graph yet."""
    get = lambda n, w="case_id is not null": table(spark, d, n).where(w)
    return r.work_list(get("reports"), get("labels", "case_id is not null and label is not null"), get("graph_nodes"), "case_id")


@query(
    f"""WITH {_LAB}, {_REP}, u AS (SELECT case_id, slide_id AS name, label, NULL AS dataset, 'labels' AS source, 2 AS priority FROM lb UNION ALL SELECT case_id, document_id, NULL, dataset, 'reports', 1 FROM rp) SELECT case_id, name, label, dataset, source FROM u WHERE case_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY priority DESC, name NULLS LAST, label NULLS LAST, dataset NULLS LAST) = 1"""
)
def merged_records(spark: SparkSession, d: str) -> DataFrame:
    """One record a case from two sources with different columns, by priority."""
    u = r.union_sources([(_labels(spark, d).withColumnRenamed("slide_id", "name"), "labels", 2), (_reports(spark, d).select("case_id", F.col("document_id").alias("name"), "dataset"), "reports", 1)])
    order = [F.col(c).asc_nulls_last() for c in ("name", "label", "dataset")]
    return runs.priority_dedupe(u.where("case_id is not null"), ["case_id"], F.col("priority"), *order).select("case_id", "name", "label", "dataset", "source")


@query(
    f"""WITH {_LAB}, s AS (SELECT DISTINCT slide_id, CASE WHEN slide_id LIKE '%1' THEN 'test' WHEN slide_id LIKE '%2' THEN 'val' ELSE 'train' END AS split FROM lb WHERE slide_id IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY slide_id) - 1 AS idx FROM s)
SELECT CAST(idx AS INTEGER) AS idx, coalesce(max(slide_id) FILTER (split = 'train'), '') AS train, coalesce(max(slide_id) FILTER (split = 'val'), '') AS val, coalesce(max(slide_id) FILTER (split = 'test'), '') AS test FROM n GROUP BY idx"""
)
def wide_split_table(spark: SparkSession, d: str) -> DataFrame:
    """Slides of three splits side by side."""
    s = _labels(spark, d).where("slide_id is not null").withColumn("split", F.when(F.col("slide_id").like("%1"), "test").when(F.col("slide_id").like("%2"), "val").otherwise("train"))
    return r.wide_splits(s, "split", "slide_id", ["train", "val", "test"])


@query(
    f"""WITH {_REP} SELECT DISTINCT document_id, CASE WHEN lower(trim(dataset)) IN ('nan', 'none') THEN '' ELSE coalesce(trim(dataset), '') END AS dataset, CASE WHEN source_path IS NULL THEN NULL WHEN contains(source_path, '/') THEN regexp_replace(source_path, '^([^/]+)/', '\\1/hierarchy/') ELSE 'hierarchy/' || source_path END AS routed FROM rp"""
)
def routed_paths(spark: SparkSession, d: str) -> DataFrame:
    """Reports' paths with the graph type after the first folder, and their data sets as text."""
    return _reports(spark, d).select("document_id", r.cell("dataset").alias("dataset"), r.insert_type(F.col("source_path"), "hierarchy").alias("routed")).distinct()


@query(f"WITH {_EV}, g AS (SELECT user_id, count(*) % 7 AS a, count(*) % 11 AS b FROM ev GROUP BY user_id) SELECT user_id, unnest(generate_series(a, b)) AS split_idx, 'skipped' AS reason FROM g WHERE a <= b")
def skipped_splits(spark: SparkSession, d: str) -> DataFrame:
    """A record for each requested split that is skipped."""
    g = _events(spark, d).groupBy("user_id").agg((F.count(F.lit(1)) % 7).alias("a"), (F.count(F.lit(1)) % 11).alias("b"))
    return r.skipped(g, "user_id", "a", "b", "skipped")


@query(f"WITH {_EV} SELECT event_id, printf('%+.4f', value - 50) AS delta, round(greatest(0.1, least(1.0, 1.0 - (k - 10) * (0.9 / 50))), 6) AS factor, round(ln(greatest(0.0001, least(0.9999, k / 100.0)) / (1 - greatest(0.0001, least(0.9999, k / 100.0)))), 6) AS bias FROM ev WHERE k IS NOT NULL")
def step_factors(spark: SparkSession, d: str) -> DataFrame:
    """Signed difference, linear decay and gate bias of every step."""
    e = _events(spark, d).where("k is not null")
    return e.select("event_id", r.signed(F.col("value") - 50).alias("delta"), F.round(r.decay(F.col("k"), 10, 60, 0.1), 6).alias("factor"), F.round(r.logit(F.col("k") / 100), 6).alias("bias"))
