"""Manifests, splits, labels and the analytics of experiment logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of every key in the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def manifest(labels: DataFrame, graphs: DataFrame, splits: DataFrame | None = None) -> DataFrame:
    """Labels joined to graphs by case, many to many; the split is the slide's, else the case's, else blank.

    ``splits`` has (kind, key, split) with kind 'slide' or 'case'; of several rows of a key the largest counts."""
    m = labels.join(graphs, "case_id")
    if splits is None:
        return m.withColumn("split", F.lit(""))
    one = splits.groupBy("kind", "key").agg(F.max("split").alias("split"))
    s = one.where("kind = 'slide'").select(F.col("key").alias("slide_id"), F.col("split").alias("by_slide"))
    c = one.where("kind = 'case'").select(F.col("key").alias("case_id"), F.col("split").alias("by_case"))
    return m.join(s, "slide_id", "left").join(c, "case_id", "left").withColumn("split", F.coalesce("by_slide", "by_case", F.lit(""))).drop("by_slide", "by_case")


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(side, key): keys of either side that the other lacks."""
    a = left.select(key).where(F.col(key).isNotNull()).distinct()
    b = right.select(key).where(F.col(key).isNotNull()).distinct()
    return a.join(b, key, "left_anti").select(F.lit("left").alias("side"), key).unionByName(b.join(a, key, "left_anti").select(F.lit("right").alias("side"), key))


def ranked_fallback(wanted: DataFrame, key: str, sources: list[tuple[DataFrame, str]], value: str) -> DataFrame:
    """``wanted`` with ``value`` from the first source (table, key column) that has its key."""
    out, got = wanted, []
    for i, (t, on) in enumerate(sources):
        one = t.groupBy(F.col(on).alias(f"_k{i}")).agg(F.min(value).alias(f"_v{i}"))
        out = out.join(one, F.col(key) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
        got.append(f"_v{i}")
    return out.withColumn(value, F.coalesce(*got)).drop(*got)


def allocate_tests(groups: DataFrame, group: str, count: str, total: int) -> DataFrame:
    """(group, count, test): ``total`` split over groups in proportion by largest remainders, ties by group."""
    all_ = Window.partitionBy(F.lit(1))  # one row a group
    x = groups.withColumn("_q", F.col(count) * total / F.sum(count).over(all_)).withColumn("_f", F.floor("_q"))
    x = x.withColumn("_left", F.lit(total) - F.sum("_f").over(all_)).withColumn("_r", F.row_number().over(all_.orderBy(F.desc(F.round(F.col("_q") - F.col("_f"), 9)), group)))
    return x.select(group, count, (F.col("_f") + (F.col("_r") <= F.col("_left")).cast("int")).cast("int").alias("test"))


def test_count(n: Column, share: float) -> Column:
    """Size of a test set: the share of n, half to even, at least 1 and at most n - 1."""
    return F.greatest(F.lit(1), F.least(F.bround(n * share).cast("long"), n - 1)).cast("int")


def stratified_split(df: DataFrame, key: str, label: str, share: float, seed: int = 0) -> DataFrame:
    """(key, label, split): test_count() keys in all, over the labels by largest remainders; of each label those that
    come first by a seeded digest. Keys are counted by the digest's first digits, and only the keys of the bin in
    which a label's part ends are put in order, so no label is sorted in one task."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}")))
    x = df.select(key, label).distinct().withColumn("_h", digest).withColumn("_b", F.substring("_h", 1, 3))
    bins = x.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n"))
    size = bins.groupBy(label).agg(F.sum("_n").alias("n"))
    all_ = Window.partitionBy(F.lit(1))  # one row a label
    quota = size.withColumn("_t", test_count(F.sum("n").over(all_), share)).withColumn("_q", F.col("n") * F.col("_t") / F.sum("n").over(all_)).withColumn("_f", F.floor("_q"))
    quota = quota.withColumn("_r", F.row_number().over(all_.orderBy(F.desc(F.round(F.col("_q") - F.col("_f"), 9)), label)))
    quota = quota.select(label, (F.col("_f") + (F.col("_r") <= F.col("_t") - F.sum("_f").over(all_)).cast("int")).alias("test"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.withColumn("_before", before).join(quota, label).select(label, "_b", (F.col("test") - F.col("_before")).alias("_left"), "_n")  # at most 4,096 rows a label
    y = x.join(bins, [label, "_b"])
    edge = y.where("_left > 0 and _left < _n").withColumn("_o", F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key)))
    rest = y.where("not (_left > 0 and _left < _n)").withColumn("_o", F.when(F.col("_left") > 0, 0).otherwise(F.col("_left") + 1))
    return rest.unionByName(edge).select(key, label, F.when((F.col("_left") > 0) & (F.col("_o") <= F.col("_left")), "test").otherwise("train").alias("split"))


def best_or_final(events: DataFrame, run: str, step: str, metric: str, final: str, prefer: str = "last_final") -> DataFrame:
    """One row a run: its last or first final record, else ('max': always) its best one, the earliest of ties."""
    is_final = F.col(final).cast("int") if prefer != "max" else F.lit(0)
    place = {"last_final": F.desc(step), "first_final": F.asc(step), "max": F.asc(step)}[prefer]
    order = [F.desc(is_final), F.when(is_final == 1, F.lit(None)).otherwise(F.col(metric)).desc_nulls_last()]
    late = F.when(is_final == 1, F.col(step)) if prefer == "last_final" else F.lit(None).cast("long")
    return first_per_key(events, [run], *order, late.desc_nulls_last() if prefer == "last_final" else place, F.asc(step))


def running_best(events: DataFrame, run: str, step: str, metric: str) -> DataFrame:
    """Each event with the best metric so far and whether it is a new best."""
    w = Window.partitionBy(run).orderBy(step)
    before = F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("best_before", before).withColumn("new_best", F.coalesce(F.col(metric) > F.col("best_before"), F.lit(True))).withColumn("best", F.greatest(metric, "best_before"))


def early_stops(events: DataFrame, run: str, step: str, metric: str, patience: int, delta: float = 0.0) -> DataFrame:
    """(run, stop): the step at which a run has gone ``patience`` steps without gaining more than ``delta``; null
    if never. Without a delta these are windows; with one, the best depends on the bests before, so each run's
    ordered metrics are folded."""
    if delta == 0.0:
        w = Window.partitionBy(run).orderBy(step)
        x = events.withColumn("_i", F.row_number().over(w)).withColumn("_b", F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, -1)))
        new = F.when(F.col(metric).isNotNull() & (F.col("_b").isNull() | (F.col(metric) > F.col("_b"))), F.col("_i"))
        x = x.withColumn("_wait", F.col("_i") - F.coalesce(F.max(new).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
        return x.groupBy(run).agg(F.min(F.when(F.col("_wait") >= patience, F.col(step).cast("long"))).alias("stop"))
    xs = F.array_sort(F.collect_list(F.struct(F.col(step).cast("long").alias("s"), F.col(metric).cast("double").alias("m"))))
    start = F.struct(F.lit(float("-inf")).alias("best"), F.lit(0).alias("wait"), F.lit(None).cast("long").alias("stop"))

    def fold(a: Column, x: Column) -> Column:
        up = x["m"] > a["best"] + delta
        wait = F.when(up, 0).otherwise(a["wait"] + 1)
        return F.struct(F.when(up, x["m"]).otherwise(a["best"]).alias("best"), wait.alias("wait"), F.coalesce(a["stop"], F.when(wait >= patience, x["s"])).alias("stop"))

    return events.groupBy(run).agg(xs.alias("xs")).select(run, F.aggregate("xs", start, fold, lambda a: a["stop"]).alias("stop"))


def priority_dedupe(rows: DataFrame, keys: list[str], priority: Column, *order: Column) -> DataFrame:
    """Of the rows of a key the one of the highest priority, then the first."""
    return first_per_key(rows, keys, priority.desc(), *order)


def mean_std(df: DataFrame, keys: list[str], value: str, single: float | None = 0.0) -> DataFrame:
    """(keys, n, mean, std, text): sample deviation; of one value it is ``single``."""
    g = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    std = F.coalesce("std", F.lit(single).cast("double")) if single is not None else F.col("std")
    g = g.withColumn("std", F.when(F.col("n") > 0, std))
    both = F.format_string("%.4f +/- %.4f", F.col("mean"), F.col("std"))
    return g.withColumn("text", F.when(F.col("n") == 0, "").when(F.col("std").isNull(), F.format_string("%.4f", F.col("mean"))).otherwise(both))


def paired_delta(runs: DataFrame, group: str, method: str, split: str, metric: str, baseline: str) -> DataFrame:
    """(group, method, n, mean, std, median, wins): gains over the baseline on common splits."""
    base = runs.where(F.col(method) == baseline).select(group, split, F.col(metric).alias("_b"))
    x = runs.where(F.col(method) != baseline).join(base, [group, split]).withColumn("_d", F.col(metric) - F.col("_b"))
    return x.groupBy(group, method).agg(F.count("_d").alias("n"), F.round(F.avg("_d"), 6).alias("mean"), F.round(F.stddev_samp("_d"), 6).alias("std"), F.round(F.median("_d"), 6).alias("median"), F.count_if(F.col("_d") > 0).alias("wins"))


def benefit_classes(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, benefit): two models' correctness per sample: both, only a, only b, neither."""
    j = a.select(key, F.col("correct").alias("ca")).join(b.select(key, F.col("correct").alias("cb")), key)
    kind = F.when(F.col("ca") & F.col("cb"), "both_correct").when(F.col("cb"), "benefit").when(F.col("ca"), "harm").otherwise("both_wrong")
    return j.select(key, kind.alias("benefit"))


def auc(df: DataFrame, label: str, score: str, bins: int = 64) -> DataFrame:
    """One row (auc): area under the curve with ties counted half; null with one class only.

    Counts per distinct score come first; the scores fall into bins of about equal number by approximate quantiles,
    each bin is ordered by itself and starts from the counts of the bins before, so no task orders all scores."""
    g = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    cuts = g.agg(F.percentile_approx("s", [i / bins for i in range(1, bins)], 10_000).alias("cuts")) if bins > 1 else g.agg(F.array().cast("array<double>").alias("cuts"))
    cuts = cuts.select(F.array_sort(F.array_distinct(F.coalesce("cuts", F.array().cast("array<double>")))).alias("cuts"))  # one row
    x = g.join(F.broadcast(cuts)).withColumn("bin", F.expr("size(cuts)") - F.size(F.filter("cuts", lambda c: c > F.col("s")))).drop("cuts")
    per = x.groupBy("bin").agg(F.sum("q").alias("q"))  # at most ``bins`` rows
    start = per.select("bin", F.coalesce(F.sum("q").over(Window.partitionBy(F.lit(1)).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    w = Window.partitionBy("bin").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    x = x.join(F.broadcast(start), "bin").withColumn("below", F.col("start") + F.coalesce(F.sum("q").over(w), F.lit(0)))
    pairs = F.sum("p") * F.sum("q")
    return x.agg(F.when(pairs > 0, F.round(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)) / pairs, 6)).alias("auc"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, weight): n / (2 n_c); no row if a class is missing."""
    g = df.where(F.col(label).isin(0, 1)).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    t = g.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("k"))
    return g.crossJoin(F.broadcast(t)).where("k = 2").select(label, F.round(F.col("all") / (2 * F.col("n")), 6).alias("weight"))


def audit(df: DataFrame, value: str) -> DataFrame:
    """One row (n, mean, median, p95, max); the 95th percentile by nearest rank, 0 if there is nothing."""
    return df.agg(
        F.count(value).alias("n"),
        F.round(F.coalesce(F.avg(value), F.lit(0.0)), 6).alias("mean"),
        F.coalesce(F.median(value), F.lit(0.0)).alias("median"),
        F.coalesce(F.expr(f"percentile_disc(0.95) within group (order by {value})"), F.lit(0)).cast("double").alias("p95"),
        F.coalesce(F.max(value), F.lit(0)).cast("double").alias("max"),
    )


def next_indexes(done: DataFrame, task: str, index: str, target: int) -> DataFrame:
    """(task, next_index): the indexes still to do, after the largest done, until ``target`` are done."""
    g = done.groupBy(task).agg(F.count_distinct(index).alias("n"), F.max(index).alias("m")).withColumn("left", F.lit(target) - F.col("n")).where("left > 0")
    return g.select(task, F.explode(F.sequence(F.coalesce(F.col("m") + 1, F.lit(0)), F.coalesce(F.col("m") + 1, F.lit(0)) + F.col("left") - 1)).alias("next_index"))
