"""Numeric kernels over vector columns: pooling, cosine, nearest neighbours in a group, discrepancy, clustering."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, small_side

BLOCK = 256  #: vectors of a block, of which a discrepancy compares pairs


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector with length one; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(1.0))


def usable(a: Column | str, dim: int) -> Column:
    """A vector of ``dim`` finite numbers that are not all zero."""
    a = F.col(a) if isinstance(a, str) else a
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(a) == dim) & finite & F.exists(a, lambda x: x != 0), F.lit(False))


def mean_vector(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, dim, value): mean of the vectors of each group by position; sums are partial before the shuffle."""
    return df.select(*keys, F.posexplode(vector).alias("dim", "x")).groupBy(*keys, "dim").agg(F.avg(F.col("x").cast("double")).alias("value"))


def to_array(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, vector): rows (keys, dim, value) as arrays."""
    g = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("v"))
    return g.select(*keys, F.transform("v", lambda x: x["value"]).alias("vector"))


def mean_of_means(df: DataFrame, group: str, inner: str, vector: str) -> DataFrame:
    """(group, dim, value): mean of the inner groups' means."""
    return mean_vector(df, [group, inner], vector).groupBy(group, "dim").agg(F.avg("value").alias("value"))


def nearest_in_group(df: DataFrame, group: str, key: str, vector: str, k: int, least: float | None = None) -> DataFrame:
    """(group, a, b, sim): the k most similar other vectors of the same group, ties by key. The group is a
    document's bag; a task holds its vectors once and compares them a block of rows at a time."""

    def run(t: pa.Table) -> pa.Table:
        keys = t.column("a").to_numpy()
        keys, first = np.unique(keys, return_index=True)
        x = np.array(t.column("v").to_pylist(), np.float64).reshape(len(t), -1)[first]
        n = np.sqrt(np.square(x).sum(axis=1))
        x /= np.where(n > 0, n, 1.0)[:, None]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(x), BLOCK):
            sim = np.round(x[at : at + BLOCK] @ x.T, 6)
            own = np.arange(len(sim))
            sim[own, own + at] = -np.inf
            order = np.argsort(-sim, axis=1, kind="stable")[:, :k]  # keys are sorted, so ties go by key
            top = np.take_along_axis(sim, order, axis=1)
            i, j = np.nonzero(top >= (least if least is not None else -2.0))
            out.append((keys[at + i], keys[order[i, j]], top[i, j]))
        a, b, s_ = (np.concatenate([o[c] for o in out]) for c in range(3))
        return pa.table({group: pa.array([t.column(group)[0].as_py()] * len(a), t.schema.field(group).type), "a": pa.array(a), "b": pa.array(b), "sim": pa.array(s_)})

    v = df.select(group, F.col(key).cast("long").alias("a"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    return v.groupBy(group).applyInArrow(run, f"{group} {v.schema[group].dataType.simpleString()}, a long, b long, sim double")


def symmetric(pairs: DataFrame, group: str) -> DataFrame:
    """(group, a, b, sim): pairs both ways, the larger similarity of the two."""
    back = pairs.select(group, F.col("b").alias("a"), F.col("a").alias("b"), "sim")
    return pairs.select(group, "a", "b", "sim").unionByName(back).groupBy(group, "a", "b").agg(F.max("sim").alias("sim"))


def _kernel_sums(scales: tuple[float, ...]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Sum and number of the kernels of each pair of blocks; of a block with itself every pair counts once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for s, t, own, m, xs, ys in zip(b["s"], b["t"], b["own"], b["m"], b["xs"], b["ys"]):
                x, y = np.stack(xs).astype(np.float64), np.stack(ys).astype(np.float64)
                d2 = np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)
                if own:
                    d2 = d2[np.triu_indices(len(x), 1)]
                rows.append((s, t, sum(float(np.exp(-d2 / (2 * m * c)).sum()) for c in scales) / len(scales), d2.size))
            yield pd.DataFrame(rows, columns=["s", "t", "k", "n"])

    return run


def mmd(x: DataFrame, y: DataFrame, vector: str, scales: tuple[float, ...] = (0.25, 0.5, 1.0, 2.0, 4.0), most: int = 256) -> DataFrame:
    """One row (mmd): unbiased squared maximum mean discrepancy of two sets of vectors with Gaussian kernels around
    the lower median of their positive squared distances, never below zero. The kernel means take all pairs, block
    by block; only the median of sets with more than twice ``most`` vectors is that of the first so many by hash."""
    z = x.select(F.lit(0).alias("side"), F.col(vector).alias("v")).unionByName(y.select(F.lit(1).alias("side"), F.col(vector).alias("v")))
    z = cut(z.where(F.col("v").isNotNull() & F.forall("v", lambda e: e.isNotNull()) & (F.size("v") > 0)))
    n = z.count()
    first = z.select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(2 * most).select(F.monotonically_increasing_id().alias("i"), "v")
    a, b = first.alias("a"), first.alias("b")
    d2 = F.aggregate(F.zip_with("a.v", "b.v", lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double"))), F.lit(0.0), lambda s, t: s + t)
    p = a.join(F.broadcast(b), F.col("a.i") < F.col("b.i")).select(d2.alias("d2"))
    med = p.where("d2 > 0").agg(F.expr("percentile_disc(0.5) within group (order by d2)").alias("m")).where("m is not null")
    blocks = -(-n // BLOCK) or 1
    block = F.pmod(F.monotonically_increasing_id(), F.lit(blocks))
    z = cut(z.groupBy("side", F.size("v").alias("dim"), block.alias("block")).agg(F.collect_list("v").alias("vs")))
    a, b = z.repartition(max(2 * blocks, z.sparkSession.sparkContext.defaultParallelism)).alias("a"), z.alias("b")  # few pairs a task
    near = (F.col("a.dim") == F.col("b.dim")) & ((F.col("a.side") < F.col("b.side")) | ((F.col("a.side") == F.col("b.side")) & (F.col("a.block") <= F.col("b.block"))))
    own = (F.col("a.side") == F.col("b.side")) & (F.col("a.block") == F.col("b.block"))
    pairs = a.join(small_side(b, n), near).crossJoin(F.broadcast(med)).select(F.col("a.side").alias("s"), F.col("b.side").alias("t"), own.alias("own"), "m", F.col("a.vs").alias("xs"), F.col("b.vs").alias("ys"))
    g = pairs.mapInPandas(_kernel_sums(scales), "s int, t int, k double, n long").groupBy("s", "t").agg((F.sum("k") / F.nullif(F.sum("n"), F.lit(0))).alias("k"))
    val = lambda s, t: F.coalesce(F.max(F.when((F.col("s") == s) & (F.col("t") == t), F.col("k"))), F.lit(0.0))
    return g.agg(F.round(F.greatest(F.lit(0.0), val(0, 0) + val(1, 1) - 2 * val(0, 1)), 6).alias("mmd"))


def k_means(df: DataFrame, group: str, key: str, vector: str, clusters: int, rounds: int = 10) -> DataFrame:
    """(group, key, cluster): Lloyd's clusters of each bag; a bag of no more vectors than clusters gives each its
    own. Seeds are spread over the bag in key order; an empty cluster takes the farthest vector."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        x = np.array(pdf[vector].tolist(), np.float64)
        if len(x) <= clusters:
            label = np.arange(len(x))
        else:
            c = x[np.linspace(0, len(x) - 1, clusters).astype(int)].copy()
            for _ in range(rounds):
                d = ((x[:, None, :] - c[None]) ** 2).sum(2)
                label = d.argmin(1)
                for j in range(clusters):
                    c[j] = x[label == j].mean(0) if (label == j).any() else x[d.min(1).argmax()]
        return pd.DataFrame({group: pdf[group], "key": pdf[key], "cluster": label})

    kind = dict(df.dtypes)
    return df.select(group, key, vector).groupBy(group).applyInPandas(run, f"{group} {kind[group]}, key {kind[key]}, cluster int")


def hash_embedding(df: DataFrame, text: str, dim: int = 64) -> DataFrame:
    """``df`` with a unit vector made of each text's hash alone."""
    import hashlib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for s in b[text]:
                seed = int.from_bytes(hashlib.blake2b((s or "").encode(), digest_size=8).digest(), "big")
                v = np.random.default_rng(seed).normal(size=dim)
                out.append((v / np.linalg.norm(v)).tolist())
            yield b.assign(embedding=out)

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", embedding array<double>"
    return df.mapInPandas(run, schema)


def attention_entropy(weights: Column | str) -> Column:
    """Entropy of attention weights as a share of the largest possible; 0 for fewer than two."""
    a = F.col(weights) if isinstance(weights, str) else weights
    h = F.aggregate(a, F.lit(0.0), lambda s, p: s - p.cast("double") * F.log(F.greatest(p.cast("double"), F.lit(1e-12))))
    return F.when(F.size(a) > 1, h / F.log(F.size(a))).otherwise(0.0)


def softmax(scores: Column | str, temperature: float = 1.0) -> Column:
    a = F.col(scores) if isinstance(scores, str) else scores
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp((x - top) / temperature))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def pad(a: Column | str, size: int, fill: float = 0.0) -> tuple[Column, Column]:
    """(array of ``size`` values, mask): cut or filled at the end."""
    a = F.col(a) if isinstance(a, str) else a
    n = F.least(F.size(a), F.lit(size))
    return F.concat(F.slice(a, 1, size), F.array_repeat(F.lit(fill), F.lit(size) - n)), F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(size) - n))


def concept_means(links: DataFrame, vectors: DataFrame, doc: str, concept: str, item: str, vector: str) -> DataFrame:
    """(doc, concept, dim, value): mean of the vectors of the sentences that a concept is linked to; a concept
    without any such sentence has the mean of all vectors of its document."""
    v = vectors.select(doc, item, F.posexplode(vector).alias("dim", "x"))
    linked = links.select(doc, concept, item).distinct().join(v, [doc, item]).groupBy(doc, concept, "dim").agg(F.avg(F.col("x").cast("double")).alias("value"))
    bare = links.select(doc, concept).distinct().join(linked.select(doc, concept).distinct(), [doc, concept], "left_anti")
    whole = v.groupBy(doc, "dim").agg(F.avg(F.col("x").cast("double")).alias("value"))
    return linked.unionByName(bare.join(whole, doc).select(doc, concept, "dim", "value"))


def blend(context: Column, label: Column, weight: float) -> Column:
    """(1 - w) context + w label scaled to the context's length (1 at least)."""
    size = F.greatest(norm(context), F.lit(1.0))
    return F.zip_with(context, label, lambda x, y: (1 - weight) * x.cast("double") + weight * y.cast("double") * size)


def embedding_map(rows: DataFrame, key: str, vector: str, dim: int, order: str) -> DataFrame:
    """(key, vector): an embedding map under raw and normalised keys (lower case, single blanks), vectors of another
    length left out; of equal keys the row that is later in ``order`` wins, a raw key before a normalised one."""
    v = rows.where(F.size(vector) == dim).select(F.col(key).alias("raw"), F.col(vector).alias("vector"), order)
    plain = F.trim(F.regexp_replace(F.lower("raw"), r"[\s_]+", " "))
    both = v.select(F.col("raw").alias("key"), F.lit(1).alias("_own"), order, "vector").unionByName(v.select(plain.alias("key"), F.lit(0).alias("_own"), order, "vector"))
    return both.groupBy("key").agg(F.max_by("vector", F.struct("_own", order)).alias("vector"))


def look_up(wanted: DataFrame, keys: list[str], known: DataFrame, out: str = "vector") -> DataFrame:
    """``wanted`` with the vector of the first of its key columns that the map has, raw before normalised."""
    x, got = wanted, []
    for i, k in enumerate(keys):
        for j, c in enumerate((F.col(k), F.trim(F.regexp_replace(F.lower(k), r"[\s_]+", " ")))):
            name = f"_v{i}{j}"
            x = x.join(known.select(F.col("key").alias(f"_k{i}{j}"), F.col("vector").alias(name)), c == F.col(f"_k{i}{j}"), "left").drop(f"_k{i}{j}")
            got.append(name)
    return x.withColumn(out, F.coalesce(*got)).drop(*got)
