"""Mixing of sources to target weights, measured in tokens of a public tokenizer.

Method. A source's quota is its share of the total; the total, unless given, is the largest at which no source with
documents would be used more than its cap allows, so that the shares asked for are met. With a given total, sources
at their cap leave the rest to the others in proportion. A quota is whole rounds over all documents of the source
plus a last part: the documents that come first by a seeded hash, cut where they fill the quota (found with two
histograms of the hash, then an order of what one bin holds). The documents of every round are dealt by hash into
blocks of about BLOCK_TOKENS tokens, so blocks outnumber shards at every size; a keyed permutation puts a source's
blocks in random order. A splitting tree divides the block counts of all sources among the output shards: at each
node the left half's counts are drawn from the multivariate hypergeometric distribution, so every shard gets exact,
disjoint quotas and the mixture of any shard is that of the whole in expectation. Every draw depends on the seed and
the node only, so each task walks the tree from the root to the leaf of each of its blocks; no list of blocks or
shards exists anywhere. Each shard then shuffles its documents locally.

Only the sizes of the sources in the targets and BINS numbers a source reach the driver.

Defined results
  * Documents of null sources or sources without target are not used; a target without documents reports zero.
    Null or negative shares count as 0, caps below 1 as 0. Null and empty texts have no tokens and are not used.
  * A repeated (doc_id, source) counts once. Extra columns are ignored. Without any target or document the
    mixture is empty.
  * The same seed gives the same mixture. Quotas are met to within one document a source.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut

SHARD_TOKENS = 500_000
BLOCK_TOKENS = 8_000  #: tokens of a block on average; more if there were over MOST_BLOCKS
MOST_BLOCKS = 500_000_000  #: the draws take no larger numbers
BINS = 1024  #: of each of the two histograms that find where a quota ends
SEED = 11


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _counter(path: str | None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path or tokenizer_path(), "rb"))}
        enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "tokens": [len(enc.encode_ordinary(t)) for t in b["text"]]})

    return run


def token_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, tokens) of every document with a source and a text. ``path`` is a vocabulary file that all
    machines can read; without it, the one that is installed on each."""
    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text").where("doc_id is not null and source is not null and text <> ''")
    return d.mapInPandas(_counter(path), "doc_id long, source string, tokens long").groupBy("doc_id", "source").agg(F.max("tokens").alias("tokens"))


@dataclass
class Quota:
    source: str
    share: float
    cap: int
    size: int  #: tokens of the source
    tokens: float = 0.0  #: to be drawn


def quotas(targets: list[tuple[str, float, int]], sizes: dict[str, int], total: float | None = None) -> list[Quota]:
    """Tokens to draw from each source."""
    qs = [Quota(s, max(0.0, w or 0.0), max(0, c or 0), sizes.get(s, 0)) for s, w, c in targets]
    live = [q for q in qs if q.share > 0 and q.size > 0 and q.cap > 0]
    weight = sum(q.share for q in live)
    if not live:
        return qs
    if total is None:
        total = min(q.cap * q.size * weight / q.share for q in live)
    open_, rest = list(live), min(total, float(sum(q.cap * q.size for q in live)))
    while open_:
        w = sum(q.share for q in open_)
        full = [q for q in open_ if rest * q.share / w > q.cap * q.size * (1 + 1e-12)]
        if not full:
            for q in open_:
                q.tokens = rest * q.share / w
            break
        for q in full:
            q.tokens = float(q.cap * q.size)
            rest -= q.tokens
            open_.remove(q)
    return qs


class Tree:
    """Splitting tree over shards: hypergeometric draws of the sources' block counts, made where they are needed."""

    def __init__(self, counts: list[int], shards: int, seed: int):
        self.counts, self.shards, self.seed = np.array(counts, np.int64), shards, seed
        self.left: dict[int, np.ndarray] = {}

    def draw(self, key: int, lo: int, mid: int, hi: int, here: np.ndarray) -> np.ndarray:
        """The counts of the left half of a node."""
        out = self.left.get(key)
        if out is None:
            total = int(here.sum())
            n = int(round(total * (mid - lo) / (hi - lo)))
            rng = np.random.default_rng((self.seed, key))
            out = rng.multivariate_hypergeometric(here, n, method="marginals") if total else here
            if len(self.left) > 200_000:
                self.left.clear()
            self.left[key] = out
        return out

    def shard(self, source: int, ordinal: int) -> int:
        """The shard of a source's block by its place in the random order."""
        lo, hi, key, here = 0, self.shards, 1, self.counts
        while hi - lo > 1:
            mid = (lo + hi) // 2
            left = self.draw(key, lo, mid, hi, here)
            if ordinal < left[source]:
                hi, key, here = mid, 2 * key, left
            else:
                ordinal -= int(left[source])
                lo, key, here = mid, 2 * key + 1, here - left
        return lo


def place(x: int, n: int, key: int) -> int:
    """Place of ``x`` in a random order of 0 .. n - 1: four Feistel rounds, repeated while the result is outside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        a, b = x >> half, x & mask
        for r in range(4):
            h = ((b + 1) * 0x9E3779B97F4A7C15 + key * 0xC2B2AE3D27D4EB4F + r * 0x165667B19E3779F9) & 0xFFFFFFFFFFFFFFFF
            h = ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
            a, b = b, a ^ ((h ^ (h >> 32)) & mask)
        x = (a << half) | b
        if x < n:
            return x


def split(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards x sources) block counts of the whole tree."""
    tree, out = Tree(list(counts), shards, seed), np.zeros((shards, len(counts)), np.int64)
    for s, n in enumerate(counts):
        for i in range(int(n)):
            out[tree.shard(s, i), s] += 1
    return out


def _dealer(counts: list[int], shards: int, seed: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Adds the shard to rows with the number of their source and of their block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, known = Tree(counts, shards, seed), {}
        for b in batches:
            out = []
            for x in zip(b["number"], b["block"]):
                if x not in known:
                    if len(known) > 1_000_000:
                        known.clear()
                    known[x] = tree.shard(x[0], place(x[1], counts[x[0]], seed * 1_000_003 + x[0]))
                out.append(known[x])
            yield b.assign(shard=out)[["doc_id", "source", "round", "shard", "tokens"]]

    return run


@dataclass
class Mixture:
    rows: DataFrame  #: doc_id, source, round, shard, tokens
    quotas: list[Quota]


def _cuts(docs: DataFrame, left: dict[str, float], level: int, bins: dict[str, int], taken: dict[str, float]) -> dict[str, int]:
    """The bin of the ``level``-th histogram in which each source's last part ends; ``taken`` grows by the bins before."""
    if not left:
        return {}
    of = F.col("source").isin(list(left))
    if level:
        of = of & F.struct("source", "bin0").isin([F.struct(F.lit(s), F.lit(b)) for s, b in bins.items()])
    sums: dict[str, dict[int, int]] = {}
    for r in docs.where(of).groupBy("source", f"bin{level}").agg(F.sum("tokens").alias("t")).collect():  # BINS a source
        sums.setdefault(r[0], {})[r[1]] = r.t
    out = {}
    for s, want in left.items():
        at = BINS
        for b in range(BINS):
            t = sums.get(s, {}).get(b, 0)
            if taken[s] + t >= want:
                at = b
                break
            taken[s] += t
        out[s] = at
    return out


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = SEED, path: str | None = None) -> Mixture:
    """The mixture's rows and the quotas they fill."""
    spark = documents.sparkSession
    wanted = [(r.source, r.target_share, r.max_repeat) for r in targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeat").alias("max_repeat")).orderBy("source").collect()]
    names = [s for s, _, _ in wanted]
    docs = token_counts(documents, path).where("tokens > 0").where(F.col("source").isin(names) if names else F.lit(False))
    h = F.xxhash64("doc_id", F.lit(seed))
    docs = cut(docs.withColumns({"bin0": F.pmod(h, F.lit(BINS)).cast("int"), "bin1": F.pmod(F.shiftright(h, 20), F.lit(BINS)).cast("int")}))
    sizes = {r.source: r.t for r in docs.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}  # one row a source
    qs = quotas(wanted, sizes, total)
    live = [q for q in qs if q.tokens >= 1 and q.size > 0]
    rounds = {q.source: min(q.cap, int(q.tokens // q.size + 1e-9)) for q in live}
    left = {q.source: q.tokens - rounds[q.source] * q.size for q in live if rounds[q.source] < q.cap}
    left = {s: x for s, x in left.items() if x >= 1}
    taken = dict.fromkeys(left, 0.0)
    first = _cuts(docs, left, 0, {}, taken)
    second = _cuts(docs, left, 1, first, taken)
    drawn = sum(q.tokens for q in live)
    shards = max(1, math.ceil(drawn / SHARD_TOKENS))
    block = max(min(BLOCK_TOKENS, SHARD_TOKENS / 8), drawn / MOST_BLOCKS)
    whole = {q.source: max(1, math.ceil(q.size / block)) for q in live}
    last = {s: max(1, math.ceil(x / block)) for s, x in left.items()}
    counts = [rounds[q.source] * whole[q.source] + last.get(q.source, 0) for q in live]
    plan = [(q.source, i, rounds[q.source], whole[q.source], last.get(q.source, 0), first.get(q.source, -1), second.get(q.source, -1), float(left.get(q.source, 0.0) - taken.get(q.source, 0.0))) for i, q in enumerate(live)]
    of = spark.createDataFrame(plan or [("", 0, 0, 1, 0, -1, -1, 0.0)], "source string, number int, rounds int, whole long, last long, first int, second int, rest double")
    d = docs.join(F.broadcast(of), "source")  # one row a target
    full = d.where("rounds > 0").withColumn("round", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)))
    full = full.withColumn("block", F.col("round") * F.col("whole") + F.pmod(F.xxhash64("doc_id", "round", F.lit(seed + 3)), F.col("whole")))
    part = d.where("last > 0 and (bin0 < first or bin0 = first and bin1 < second)")
    # only what one bin of a bin holds is put in order; the document that crosses the quota is taken if more than half of it fits
    w = Window.partitionBy("source").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    edge = d.where("last > 0 and bin0 = first and bin1 = second").withColumn("before", F.coalesce(F.sum("tokens").over(w), F.lit(0)))
    part = part.unionByName(edge.where("before + tokens / 2 <= rest").drop("before"))
    part = part.withColumn("round", F.col("rounds")).withColumn("block", F.col("rounds") * F.col("whole") + F.pmod(F.xxhash64("doc_id", "round", F.lit(seed + 3)), F.col("last")))
    rows = full.unionByName(part).select("doc_id", "source", "number", "round", "block", "tokens")
    out = rows.mapInPandas(_dealer(counts or [0], shards, seed), "doc_id long, source string, round int, shard int, tokens long")
    return Mixture(out, qs)


def ordered(m: Mixture, seed: int = SEED) -> DataFrame:
    """The mixture with each document's place in its shard, shuffled locally; a shard holds about SHARD_TOKENS."""
    w = Window.partitionBy("shard").orderBy(F.xxhash64("doc_id", "round", F.lit(seed + 2)), "doc_id", "round")
    return m.rows.withColumn("position", F.row_number().over(w) - 1)


def shares(m: Mixture) -> DataFrame:
    """(source, target_share, max_repeat, available_tokens, documents, uses, tokens, actual_share, repeats)."""
    spark = m.rows.sparkSession
    wanted = spark.createDataFrame([(q.source, float(q.share), q.cap, q.size) for q in m.quotas] or [("", 0.0, 0, 0)], "source string, target_share double, max_repeat int, available_tokens long").where("source <> ''")
    per_doc = m.rows.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("uses"), F.sum("tokens").alias("tokens"))
    got = per_doc.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("uses").alias("uses"), F.sum("tokens").alias("tokens"), F.max("uses").alias("repeats"))
    all_ = Window.partitionBy(F.lit(1))  # one row a source
    x = wanted.join(got, "source", "left").na.fill(0, ["documents", "uses", "tokens", "repeats"])
    total = F.sum("tokens").over(all_)
    return x.withColumn("actual_share", F.round(F.when(total > 0, F.col("tokens") / total).otherwise(0.0), 6))
