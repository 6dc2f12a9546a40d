"""Records of experiments: slides of cases, samples, splits, roll-ups, states of runs, names and paths.

Every operator is a plan of joins, windows by group and column expressions; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runs import first_per_key


def cell(c: Column | str) -> Column:
    """A cell's text without outer blanks; null, NaN and None are ''."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.trim(c.cast("string"))
    return F.when(t.isNull() | F.lower(t).isin("nan", "none"), "").otherwise(t)


def split_index(value: Column, path: Column) -> Column:
    """The first digits of a value, else the number after split_ or split- in a path; null if there is neither."""
    number = lambda c, p: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), p, 1), F.lit("")).cast("int")
    return F.coalesce(number(value, r"(\d+)"), number(path, r"split[_-](\d+)"))


def signed(c: Column | str) -> Column:
    """A number with its sign and four places."""
    return F.format_string("%+.4f", F.col(c) if isinstance(c, str) else c)


def key_values(c: Column | str) -> Column:
    """The map of a text of key=value words."""
    return F.str_to_map(F.regexp_replace(F.trim(c), r"\s+", " "), F.lit(" "), F.lit("="))


def last_match(c: Column | str, pattern: str) -> Column:
    """The last match of a pattern with one group; null without any."""
    return F.try_element_at(F.regexp_extract_all(F.col(c) if isinstance(c, str) else c, F.lit(pattern), 1), F.lit(-1))


def decay(step: Column, start: int, end: int, least: float = 0.0) -> Column:
    """Factor that falls from 1 at ``start`` in a line to ``least`` at ``end``."""
    return F.greatest(F.lit(least), F.least(F.lit(1.0), 1.0 - (step - start) * ((1.0 - least) / max(end - start, 1))))


def logit(p: Column) -> Column:
    """Bias of a gate whose value is ``p``, kept off 0 and 1."""
    q = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), p))
    return F.log(q / (1 - q))


def insert_type(path: Column, kind: str) -> Column:
    """A relative path with the graph type after its first folder; a bare file gets it in front."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"^([^/]+)/", f"$1/{kind}/")).otherwise(F.concat(F.lit(f"{kind}/"), path))


def expand_cases(case_labels: DataFrame, slides: DataFrame) -> DataFrame:
    """(case_id, slide_id, label, state): the label of each case (the first of repeated ones by its order column)
    on each of its slides; slides of cases without label are 'unmatched'."""
    one = first_per_key(case_labels, ["case_id"], F.asc("order")).select("case_id", "label", F.lit("matched").alias("state"))
    x = slides.select("case_id", "slide_id").distinct().join(one, "case_id", "left")
    return x.select("case_id", "slide_id", "label", F.coalesce("state", F.lit("unmatched")).alias("state"))


def samples(split: DataFrame, labels: DataFrame, files: list[DataFrame], keys: tuple[str, str] = ("case_id", "slide_id")) -> DataFrame:
    """Rows of a split with their labels on the composite key, if every file index (slide_id) has the slide."""
    out = split.join(labels, list(keys))
    for f in files:
        out = out.join(f.select("slide_id").distinct(), "slide_id", "left_semi")
    return out


def manifest_samples(manifest: DataFrame, split: str, datasets: list[str] | None = None) -> DataFrame:
    """Manifest rows of a split, of the named data sets only if there are any (letter case does not matter)."""
    m = manifest.where(F.col("split") == split)
    return m.where(F.upper("dataset").isin(*[x.upper() for x in datasets])) if datasets else m


def manifest_summary(manifest: DataFrame) -> DataFrame:
    """One row: rows, cases, slides, rows without split and rows of each kind of split."""
    return manifest.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("case_id").alias("cases"), F.count_distinct("slide_id").alias("slides"), F.count_if(F.col("split") == "").alias("no_split"),
        *[F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")],
    )


def mean_of_keys(rows: DataFrame, group: list[str], values: str) -> DataFrame:
    """(group, key, n, mean) of a map column: the mean of every key over the rows that have a number for it."""
    x = rows.select(*group, F.explode(values).alias("key", "value")).where("value is not null and not isnan(value)")
    return x.groupBy(*group, "key").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def means_at_best(events: DataFrame, run: str, step: str, metric: str, group: list[str], value: str) -> DataFrame:
    """(group, runs, mean): the mean of ``value`` at the best step of every run (the earliest of ties)."""
    best = first_per_key(events.where(F.col(metric).isNotNull()), [run], F.desc(metric), F.asc(step))
    return best.groupBy(*group).agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg(value), 6).alias("mean"))


def roll_up(results: DataFrame, dims: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """(keys, n, mean, state): the results of every combination of the dimensions, each a small table of one key;
    combinations without result are 'missing'."""
    every = dims[0]
    for d in dims[1:]:
        every = every.join(d)  # dimensions are lists of names, so their product is stated
    g = results.groupBy(*keys).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"))
    return every.join(g, keys, "left").withColumn("state", F.when(F.col("n") > 0, "complete").otherwise("missing")).na.fill(0, ["n"])


def over_baseline(results: DataFrame, group: str, method: str, value: str, baseline: str) -> DataFrame:
    """Results with their gain over the mean of the group's baseline; null where a group has none."""
    base = F.avg(F.when(F.col(method) == baseline, F.col(value))).over(Window.partitionBy(group))
    return results.withColumn("gain", F.round(F.col(value) - base, 6))


def completed(checkpoints: DataFrame, logs: DataFrame, task: str, index: str, strict: bool = False) -> DataFrame:
    """(task, index): splits that have a checkpoint or, unless ``strict``, a log."""
    done = checkpoints.select(task, index)
    return (done if strict else done.unionByName(logs.select(task, index))).where(F.col(index).isNotNull()).distinct()


def latest_run(folders: DataFrame, task: str, *order: str) -> DataFrame:
    """The folder of every task that is greatest by the given columns, first by name if they are equal."""
    return first_per_key(folders, [task], *[F.desc(c) for c in order], F.asc("folder"))


def state_of_run(done: Column, planned: Column, running: Column) -> Column:
    """complete, running, partial, queued or not-run, by how many of the planned splits are done."""
    return F.when((planned > 0) & (done >= planned), "complete").when(running, "running").when(done > 0, "partial").when(planned > 0, "queued").otherwise("not-run")


def confident_errors(predictions: DataFrame, label: str, probability: str, k: int, key: str) -> DataFrame:
    """The ``k`` wrong predictions that lie farthest from one half, ties by key."""
    wrong = (F.col(probability) >= 0.5).cast("int") != F.col(label)
    return predictions.where(wrong).withColumn("margin", F.round(F.abs(F.col(probability) - 0.5), 9)).orderBy(F.desc("margin"), key).limit(k)


def numeric_order(c: str) -> list[Column]:
    """Sort keys of split names: numbers in their order, then the rest by name."""
    return [F.expr(f"try_cast({c} as int)").asc_nulls_last(), F.asc(c)]


def common_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The keys of both sides; an error if there is none."""
    both = a.select(key).intersect(b.select(key))
    guard = both.agg(F.count(F.lit(1)).alias("_n"))
    every = guard.select(F.when(F.col("_n") == 0, F.raise_error(F.lit("no common ids"))).otherwise(F.lit(1)).alias("_ok"))
    return every.join(both, F.lit(True), "left").where("_ok = 1").drop("_ok")


def work_list(exports: DataFrame, labelled: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """(key): exported and labelled, but not yet done."""
    return exports.select(key).intersect(labelled.select(key)).exceptAll(existing.select(key).distinct())


def union_sources(sources: list[tuple[DataFrame, str, int]]) -> DataFrame:
    """Rows of sources with different columns, each with its source's name and priority; missing cells are null."""
    out = None
    for df, name, priority in sources:
        x = df.withColumns({"source": F.lit(name), "priority": F.lit(priority)})
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    return out


def wide_splits(rows: DataFrame, split: str, key: str, names: list[str]) -> DataFrame:
    """(idx, one column a split): the keys of the splits side by side in their order, padded with ''."""
    x = rows.where(F.col(split).isin(*names)).select(F.col(split).alias("_s"), key).distinct()
    x = x.withColumn("idx", F.row_number().over(Window.partitionBy("_s").orderBy(key)) - 1)
    g = x.groupBy("idx").agg(*[F.max(F.when(F.col("_s") == n, F.col(key))).alias(n) for n in names])
    return g.na.fill("", names)


def distinct_splits(rows: DataFrame, attempt: str, key: str, split: str) -> DataFrame:
    """(attempt): the first of the attempts that put the same keys into the test set."""
    g = rows.where(F.col(split) == "test").groupBy(attempt).agg(F.sum(F.xxhash64(key).cast("decimal(38,0)")).alias("_a"), F.bit_xor(F.xxhash64(key, F.lit(7))).alias("_b"), F.count(F.lit(1)).alias("_n"))
    return first_per_key(g, ["_a", "_b", "_n"], F.asc(attempt)).select(attempt)


def subsample(df: DataFrame, group: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows a group without replacement, chosen by a seeded hash; a sampling operator."""
    w = Window.partitionBy(group).orderBy(F.xxhash64(key, F.lit(seed)), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def skipped(tasks: DataFrame, task: str, first: str, last: str, reason: str) -> DataFrame:
    """(task, split_idx, reason): one row for each requested split of a task."""
    return tasks.where(F.col(first) <= F.col(last)).select(task, F.explode(F.sequence(first, last)).alias("split_idx"), F.lit(reason).alias("reason"))


def stale(manifest: DataFrame, files: DataFrame, path: str, root: str) -> DataFrame:
    """One row (stale): whether the first filled path, by order, lies outside the root or is no file."""
    first = manifest.where(cell(path) != "").orderBy(path).limit(1).select(path)
    x = first.join(files.select(F.col("file")).distinct(), F.col(path) == F.col("file"), "left")
    return x.select((F.col("file").isNull() | ~F.startswith(path, F.lit(root))).alias("stale"))
