"""Most similar vectors for every vector of a collection.

Method. Vectors are scaled to length one and turned by a random rotation, so that any first columns estimate
the whole distance. Centroids fitted on a bounded sample (at most SAMPLE rows by key hash) split them into lists;
every vector is indexed. Each probed list is scanned in column blocks: after a block, a hypothesis test drops the
candidates whose partial distance is already too large for the query's present limit (its k-th best distance,
or the limit that the least similarity asked for sets); what is left is compared in all columns. In the
self-join a vector lies in its nearest list and in up to ``spread`` - 1 further ones whose centroids are within
MARGIN of it, so two similar vectors meet in one list. A list is divided into parts of about PART_ROWS rows by key
hash and each pair of parts is scanned by itself: the rule is the same at every size, no task holds more than two
parts, and nothing is lost by it. Exact copies are represented by their smallest key.

Defined results
  * A vector is usable if it has ``dim`` finite numbers that are not all zero (the most frequent length if no dim
    is given); other rows are ignored. Repeated rows of a key count once. Null keys are ignored; so are extra
    columns. Empty tables give an empty result.
  * Ties in similarity go to the smaller key. Copies have similarity 1. Similarities are of single precision
    (about 1e-6).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, small_side

EPS = 2.1  #: of the hypothesis test; larger abandons later
SAMPLE = 65_536  #: rows that the centroids are fitted on, at most
LIST_ROWS = 2_048  #: rows a list is meant to hold
MOST_LISTS = 8_192  #: lists, at most; beyond that lists grow and are scanned in more parts
PART_ROWS = 32_768  #: rows of a list that are scanned together
MARGIN = 0.15
SEED = 17


def column_blocks(dim: int) -> tuple[int, ...]:
    """Columns read before each test: a quarter, a half, all."""
    return tuple(sorted({max(1, dim // 4), max(1, dim // 2), dim}))


@dataclass
class Index:
    """A rotation, the unit centroids of the lists in rotated coordinates, and the parts of each list."""

    rotation: np.ndarray
    centroids: np.ndarray
    parts: np.ndarray


def unit_rows(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mask of usable rows, their unit vectors)."""
    v = values.astype(np.float64)
    ok = np.isfinite(v).all(axis=1)
    norm = np.sqrt(np.square(np.where(ok[:, None], v, 0)).sum(axis=1))
    ok &= norm > 0
    return ok, v[ok] / norm[ok, None]


def k_means(x: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of at most n cells; seeds are rows, so dense regions get more of them."""
    rng = np.random.default_rng(SEED)
    c = x[rng.choice(len(x), min(n, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 8192] @ c.T).argmax(axis=1) for i in range(0, len(x), 8192)])
        order = np.argsort(near, kind="stable")
        cells, at = np.unique(near[order], return_index=True)
        c[cells] = np.add.reduceat(x[order], at, axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def fit(vectors: DataFrame, dim: int, spread: int, rows: int) -> Index:
    """Centroids from a sample of ``vectors`` (key, vec) that has about ``rows`` rows in all."""
    part = min(1.0, 0.95 * SAMPLE / max(rows, 1))
    t = vectors.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(part * 1_000_000) + 1).select("vec").limit(SAMPLE).toArrow()
    rotation = np.linalg.qr(np.random.default_rng(SEED).normal(size=(dim, dim)))[0].astype(np.float32)
    nothing = Index(rotation, np.zeros((1, dim), np.float32), np.ones(1, np.int64))
    if t.num_rows == 0:
        return nothing
    _, x = unit_rows(_matrix(t.column(0).combine_chunks(), dim))
    x = x.astype(np.float32) @ rotation
    if not len(x):
        return nothing
    c = k_means(x, min(MOST_LISTS, max(1, math.ceil(rows * spread / LIST_ROWS)), max(1, len(x) // 8)))
    near = np.concatenate([(x[i : i + 8192] @ c.T).argmax(axis=1) for i in range(0, len(x), 8192)])
    size = np.bincount(near, minlength=len(c)) / len(x) * rows * spread
    return Index(rotation, c, np.maximum(1, np.ceil(size / PART_ROWS)).astype(np.int64))


#: Rows of placed vectors: those that meet in a group (list, part) are scanned together, side 0 against side 1, or
#: side 0 with itself if there is no other.
PLACED = "list int, part int, side int, key long, vec binary"


def _placer(index: Index, dim: int, most: int, margin: float, role: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (key, vec) to PLACED: each in its ``most`` nearest lists within ``margin``. In the role 'both' a vector
    meets the others of its list, as 'base' it waits in one part, as 'ask' it visits all parts."""
    rotation, centroids = index.rotation, index.centroids
    most = min(most, len(centroids))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, x = unit_rows(_matrix(b.column(1), dim))
            x = np.ascontiguousarray(x.astype(np.float32) @ rotation)
            keys = b.column(0).to_numpy()[ok]
            sim = x @ centroids.T
            top = np.argpartition(-sim, most - 1, axis=1)[:, :most] if most < len(centroids) else np.tile(np.arange(most), (len(x), 1))
            s = np.take_along_axis(sim, top, axis=1)
            row, col = np.nonzero(s >= s.max(axis=1, keepdims=True, initial=-9) - margin)
            cell = top[row, col]
            n = index.parts[cell]
            own = ((keys[row].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n
            if role == "base":
                part, side = own, np.zeros(len(row), np.int64)
            else:
                other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row, cell, own, n = np.repeat(row, n), np.repeat(cell, n), np.repeat(own, n), np.repeat(n, n)
                if role == "ask":
                    part, side = other, np.ones(len(row), np.int64)
                else:
                    part, side = np.minimum(own, other) * n + np.maximum(own, other), (own > other).astype(np.int64)
            data = np.ascontiguousarray(x[row])
            ends = np.arange(len(row) + 1, dtype=np.int32) * (dim * 4)
            vec = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(side.astype(np.int32)), pa.array(keys[row]), vec], names=["list", "part", "side", "key", "vec"])

    return place


def _best(q: np.ndarray, b: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest (distance, b) of every q."""
    order = np.lexsort((b, d, q))
    qs = q[order]
    start = np.r_[True, qs[1:] != qs[:-1]] if len(qs) else np.empty(0, bool)
    rank = np.arange(len(qs)) - np.maximum.accumulate(np.where(start, np.arange(len(qs)), 0)) if len(qs) else np.empty(0, int)
    return order[rank < k]


def scan(qk: np.ndarray, q: np.ndarray, bk: np.ndarray, b: np.ndarray, k: int | None, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query key, base key, similarity): the k nearest of ``b`` (all if k is None) for every ``q``, with at least
    ``floor``."""
    out_q, out_b, out_d = [], [], []
    step, dim = 2048, q.shape[1]
    blocks = column_blocks(dim)
    test = lambda n: (n / dim) * (1 + EPS / math.sqrt(n)) ** 2 if n < dim else 1.0
    for q0 in range(0, len(q), step):
        x, xk = q[q0 : q0 + step], qk[q0 : q0 + step]
        limit = np.full(len(x), 2 - 2 * floor + 1e-6, np.float32)
        parts = []
        got = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))
        for b0 in range(0, len(b), step):
            y, yk = b[b0 : b0 + step], bk[b0 : b0 + step]
            first = blocks[0] if not (floor < 0.5 and b0 == 0) else dim  # without a limit yet, the first rows set it
            part = np.square(x[:, :first]).sum(1)[:, None] + np.square(y[:, :first]).sum(1)[None, :] - 2 * (x[:, :first] @ y[:, :first].T)
            if k is not None and first == dim and len(y) > k + 1:
                limit = np.minimum(limit, np.partition(part, k, axis=1)[:, k] + 1e-6)  # k + 1: the row itself may be among them
            i, j = np.nonzero(part <= (limit * test(first))[:, None])
            d = part[i, j]
            for lo, hi in zip(blocks, blocks[1:]):
                if first == dim:
                    break
                d = d + np.square(x[i, lo:hi] - y[j, lo:hi]).sum(axis=1)
                keep = d <= limit[i] * test(hi)
                i, j, d = i[keep], j[keep], d[keep]
            keep = xk[i] != yk[j]
            if k is None:
                parts.append((i[keep], yk[j[keep]], d[keep]))
                continue
            got = (np.r_[got[0], i[keep]], np.r_[got[1], yk[j[keep]]], np.r_[got[2], d[keep]])
            best = _best(got[0], got[1], got[2], k)
            got = (got[0][best], got[1][best], got[2][best])
            full, n = np.unique(got[0], return_counts=True)
            worst = np.zeros(len(x), np.float32)
            np.maximum.at(worst, got[0], got[2])
            limit[full[n >= k]] = np.minimum(limit[full[n >= k]], worst[full[n >= k]])
        for g in parts or [got]:
            out_q.append(xk[g[0]])
            out_b.append(g[1])
            out_d.append(1 - g[2].astype(np.float64) / 2)
    cat = lambda xs, t: np.concatenate(xs) if xs else np.empty(0, t)
    return cat(out_q, np.int64), cat(out_b, np.int64), cat(out_d, np.float64)


def _rows(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(keys, vectors) of a table that is not empty, each key once."""
    keys = t.column("key").to_numpy()
    width = len(t.column("vec")[0].as_py()) // 4
    chunks = t.column("vec").chunks
    x = np.concatenate([np.frombuffer(c.buffers()[2], np.float32)[c.offset * width :][: len(c) * width] for c in chunks if len(c)]).reshape(-1, width)
    keys, at = np.unique(keys, return_index=True)
    return keys, x[at]


def _result(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "sim": pa.array(s, pa.float64())})


RESULT = "a long, b long, sim double"


def _joiner(floor: float) -> Callable[[pa.Table], pa.Table]:
    """All pairs of a group with at least ``floor``, a < b."""

    def join(t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        other = t.filter(pa.array(side == 1))
        keys, x = _rows(t.filter(pa.array(side == 0))) if (side == 0).any() else (np.empty(0, np.int64), np.empty((0, 1), np.float32))
        if not len(keys):
            return _result(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        a, b, s = scan(keys, x, *_rows(other), None, floor) if other.num_rows else scan(keys, x, keys, x, None, floor)
        keep = slice(None) if other.num_rows else a < b
        return _result(np.minimum(a, b)[keep], np.maximum(a, b)[keep], s[keep])

    return join


def _prober(k: int, floor: float) -> Callable[[pa.Table], pa.Table]:
    def probe(t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        asks, holds = t.filter(pa.array(side == 1)), t.filter(pa.array(side == 0))
        if not asks.num_rows or not holds.num_rows:
            return _result(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return _result(*scan(*_rows(asks), *_rows(holds), k, floor))

    return probe


def _usable(df: DataFrame, key: str, vec: str, dim: int) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("key"), F.col(vec).alias("vec")).where(f"key is not null and size(vec) = {dim}")


def dimension(df: DataFrame, vec: str) -> int:
    """The most frequent length of the vectors, the larger of equals; 1 if there is none."""
    r = df.where(F.size(vec) > 0).groupBy(F.size(vec).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return r["n"] if r else 1


def _distinct_vectors(v: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(one row (key, vec) per distinct vector, (rep, key) of all vectors that have copies, groups of copies).

    Only hashes are grouped, with partial counts, so a group of any size is no burden."""
    hashed = v.withColumns({"h": F.xxhash64("vec"), "h2": F.hash("vec")})
    groups = hashed.groupBy("h", "h2").agg(F.min("key").alias("rep"), F.max("key").alias("last"))
    groups = cut(groups.where("rep < last").select("h", "h2", "rep"))
    n = groups.count()
    if n == 0:
        return v, groups.select("rep", F.col("rep").alias("key")), 0
    small = small_side(groups, n)
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    members = cut(hashed.join(small, ["h", "h2"]).where(finite).select("rep", "key").distinct())
    reps = hashed.join(small, ["h", "h2"], "left").where("rep is null or rep = key").select("key", "vec")
    return reps, members, n


def _first_copies(members: DataFrame, k: int) -> DataFrame:
    """(rep, key): the k smallest keys of every group of copies; found per salt first, so no task ranks a whole group."""
    salt = members.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(64)))
    near = salt.withColumn("r", F.row_number().over(Window.partitionBy("rep", "salt").orderBy("key"))).where(F.col("r") <= k)
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("key"))).where(F.col("r") <= k)
    return near.select("rep", "key")


def similar_classes(df: DataFrame, key: str, vec: str, floor: float = 0.9, spread: int = 3, dim: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(links, members): links (a, b, sim), a < b, are all pairs of different vectors with similarity of at least
    ``floor``, each vector by its smallest key; members (rep, key) are the keys of the vectors that have copies.
    Nothing is capped, and copies are not multiplied out."""
    dim = dim or dimension(df, vec)
    reps, members, copies = _distinct_vectors(_usable(df, key, vec, dim))
    index = fit(reps, dim, spread, df.count())
    placed = reps.mapInArrow(_placer(index, dim, spread, MARGIN, "both"), PLACED)
    found = placed.groupBy("list", "part").applyInArrow(_joiner(floor), RESULT)
    return found.groupBy("a", "b").agg(F.max("sim").alias("sim")), members


def similar_pairs(df: DataFrame, key: str, vec: str, floor: float = 0.9, spread: int = 3, dim: int | None = None) -> DataFrame:
    """(a, b, sim), a < b: all pairs of different keys with similarity of at least ``floor``, copies multiplied out:
    for tables in which no vector has many copies; similar_classes and links serve all others."""
    links, members = similar_classes(df, key, vec, floor, spread, dim)
    own = lambda c: members.select(F.col("rep").alias(c), F.col("key").alias(f"{c}2"))
    all_ = links.join(own("a"), "a", "left").join(own("b"), "b", "left").select(F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b"), "sim")
    same = own("a").join(own("b"), F.col("a") == F.col("b")).where("a2 < b2").select(F.col("a2").alias("a"), F.col("b2").alias("b"), F.lit(1.0).alias("sim"))
    return all_.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim").unionByName(same)


def links(df: DataFrame, key: str, vec: str, floor: float = 0.9, spread: int = 3, dim: int | None = None) -> DataFrame:
    """(key, rep, links): every vector that has a partner, the smallest key of its copies, and its number of partners."""
    pairs, members = similar_classes(df, key, vec, floor, spread, dim)
    size = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    far = both.join(size.withColumnRenamed("rep", "b"), "b", "left").groupBy(F.col("a").alias("rep")).agg(F.sum(F.coalesce("n", F.lit(1))).alias("far"))
    per = far.join(size, "rep", "full").select("rep", (F.coalesce("far", F.lit(0)) + F.coalesce("n", F.lit(1)) - 1).alias("links"))
    return per.join(members, "rep", "left").select(F.coalesce("key", "rep").alias("key"), "rep", "links")


def nearest(df: DataFrame, key: str, vec: str, asked: str, k: int = 10, probes: int = 24, dim: int | None = None) -> DataFrame:
    """(a, b, sim, rank): the k most similar vectors of every vector whose key meets the condition ``asked``,
    an SQL expression over ``key``, against all vectors."""
    dim = dim or dimension(df, vec)
    v = _usable(df, key, vec, dim)
    reps, members, copies = _distinct_vectors(v)
    index = fit(reps, dim, 1, df.count())
    base = reps.mapInArrow(_placer(index, dim, 1, 0.0, "base"), PLACED)
    v = v.where(asked)
    asks = v.mapInArrow(_placer(index, dim, probes, 9.0, "ask"), PLACED)
    found = base.unionByName(asks).groupBy("list", "part").applyInArrow(_prober(k + 1, -1.0), RESULT)
    if copies:
        few = _first_copies(members, k + 1).withColumnsRenamed({"rep": "b", "key": "b2"})
        own = v.select(F.col("key").alias("a")).distinct().join(members.select(F.col("key").alias("a"), F.col("rep").alias("b")), "a")
        own = own.join(few, "b").select("a", F.col("b2").alias("b"), F.lit(1.0).alias("sim"))
        found = found.join(few, "b", "left").select("a", F.coalesce("b2", "b").alias("b"), "sim").unionByName(own)
    best = found.where("a <> b").groupBy("a", "b").agg(F.max("sim").alias("sim"))
    w = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
