"""Held-out evaluation passages inside a training corpus.

Method. Texts are reduced to lower-case letters and digits. Winnowing keeps the smallest k-gram hash of every
window of w, so any shared span of at least k + w - 1 letters shares a fingerprint. The fingerprints of every
document meet those of the evaluation items: the items are a stated query set, handed to all tasks in blocks of at
most BLOCK_LETTERS letters, and each block is met by all documents, so no text moves and there is no join to skew.
The hits of an item are extended over all k-grams; an item is left only if these cannot cover a passage of the
least share asked for (a bound that loses none). What remains is extended to maximal common blocks, and blocks that
follow each other in both texts with short gaps are chained: a gap is an altered word or a short interruption. A
document leaks an item if a chain spans at least two fifths of the item's text and most of the span is shared.

Items differ in what they need, so there are three kinds: Han and kana say more in a character and have shorter
grams, windows and blocks; of short items, whose two fifths are less than a window guarantees, every gram is kept;
the shortest (under SHORTEST letters) are compared by plain inclusion.

Defined results
  * Null and empty texts, and texts without letters or digits, leak nothing and hold nothing.
  * Items with equal texts are each reported; repeated rows of either table count once.
  * Extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, W = 8, 8
SHARE = 0.4  #: of the item's text that must be held
DENSE = 0.8  #: of a passage's span that must be equal
GAP = 48  #: most characters between two blocks of one passage, in either text
K_HAN, W_HAN = 4, 2  #: of runs of Han and kana
DENSE_HAN = 0.7  #: as DENSE; equal runs below K_HAN between altered words do not count
GAP_HAN = 8  #: most characters of the item between two blocks
K_SHORT = 6  #: of items of less than (K + W - 1) / SHARE letters; every gram is kept
SHORTEST = 15  #: letters (5 of Han and kana) from which an item is more than one word
BLOCK_LETTERS = 4_000_000  #: letters of the items that are handed to all tasks at once

_DROP = re.compile(r"[\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_HAN = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]")


def plain(text: str | None) -> str:
    """The text's letters and digits in lower case."""
    return _DROP.sub("", unicodedata.normalize("NFKC", text).lower()) if text else ""


def _grams(c: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k-gram."""
    n = len(c) - k + 1
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * _BASE + c[j : j + n]
    h ^= h >> np.uint64(31)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def _letters(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le"), np.uint32).astype(np.uint64)


def fingerprints(s: str, k: int = K, w: int = W) -> np.ndarray:
    """The distinct winnowed k-gram hashes of a plain text, as signed 64-bit numbers."""
    n = len(s) - k + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = _grams(_letters(s), k)
    kept = sliding_window_view(h, w).min(axis=1) if n >= w else h.min(keepdims=True)
    return np.unique(kept).view(np.int64)


def blocks(a: str, b: str, k: int = K) -> list[tuple[int, int, int]]:
    """Maximal common blocks of at least k characters: (start in a, start in b, length)."""
    at: dict[str, list[int]] = {}
    for j in range(len(b) - k + 1):
        at.setdefault(b[j : j + k], []).append(j)
    out, open_ = [], {}
    for i in range(len(a) - k + 1):
        now = {}
        for j in at.get(a[i : i + k], ()):
            run = open_.pop(i - j, None) or [i, j, k - 1]
            run[2] += 1
            now[i - j] = run
        out += [tuple(r) for r in open_.values()]
        open_ = now
    return sorted(out + [tuple(r) for r in open_.values()])


def best_passage(doc: str, item: str, gap: int = GAP, k: int = K, item_gap: int = GAP, dense: float = DENSE) -> tuple[int, int]:
    """(span, equal): the longest stretch of the item that a chain of blocks covers densely enough, and how
    much of it is equal; (0, 0) if there is none."""
    bs = blocks(doc, item, k)
    best = (0, 0)
    chains: list[tuple[int, int, int, int]] = []  # per block: (equal, item start, item end, doc end)
    first, longest = 0, max((x[2] for x in bs), default=0)
    for n, (i, j, size) in enumerate(bs):
        here = (size, j, j + size, i + size)
        while first < n and bs[first][0] + longest + gap < i:
            first += 1
        for eq, j0, j1, i1 in chains[first:n]:
            over = max(0, i1 - i, j1 - j)  # overlapping ends are counted once
            if over < size and i - i1 <= gap and j - j1 <= item_gap and eq + size - over > here[0]:
                here = (eq + size - over, j0, j + size, i + size)
        chains.append(here)
        for eq, j0, j1 in ((here[0], here[1], here[2]), (size, j, j + size)):
            if eq >= dense * (j1 - j0):
                best = max(best, (j1 - j0, eq))
    return best


@dataclass(frozen=True)
class Kind:
    """How the items of one kind are sought: gram and window, and what a passage of theirs may miss."""

    k: int
    w: int
    gap: int
    dense: float


LATIN, HAN, SHORT = Kind(K, W, GAP, DENSE), Kind(K_HAN, W_HAN, GAP_HAN, DENSE_HAN), Kind(K_SHORT, 1, GAP, DENSE)


def kind_of(p: str) -> Kind | None:
    """The kind of an item by its plain text; None for the shortest."""
    if 2 * len(_HAN.findall(p)) > len(p):
        return HAN if len(p) >= K_HAN + W_HAN - 1 else None
    return None if len(p) < SHORTEST else SHORT if SHARE * len(p) < K + W - 1 else LATIN


def _starts(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of runs that begin at ``values`` and have ``counts`` members, all members."""
    ends = np.cumsum(counts)
    return np.repeat(values - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class Index:
    """Items of one kind: the items of each fingerprint, and the places of each k-gram in the items' joined text."""

    def __init__(self, kind: Kind, texts: list[str]):
        self.kind, self.texts = kind, texts
        self.size = np.array([len(t) for t in texts])
        room = int(self.size.max(initial=0)) + kind.k  # no window reaches the next item
        self.begin = np.cumsum(self.size + room) - self.size - room
        grams = [_grams(_letters(t), kind.k) for t in texts]
        all_ = np.concatenate(grams)
        order = np.argsort(all_, kind="stable")
        self.place = (np.concatenate([b + np.arange(len(g)) for b, g in zip(self.begin, grams)]))[order]
        self.gram, self.gram_at = np.unique(all_[order], return_index=True)
        self.gram_n = np.diff(np.r_[self.gram_at, len(all_)])
        marks = [_winnow(g, kind.w) for g in grams]
        flat, of = np.concatenate(marks), np.repeat(np.arange(len(texts)), [len(m) for m in marks])
        order = np.argsort(flat, kind="stable")
        self.of = of[order]
        self.mark, self.mark_at = np.unique(flat[order], return_index=True)
        self.mark_n = np.diff(np.r_[self.mark_at, len(flat)])

    def hits(self, doc: str, least: float) -> np.ndarray:
        """The items that share a fingerprint with a plain text and may have a passage of the least share there."""
        k = self.kind.k
        if len(doc) < k:
            return np.empty(0, np.int64)
        g = _grams(_letters(doc), k)
        m = _winnow(g, self.kind.w)
        at = np.searchsorted(self.mark, m)
        at = at[self.mark[np.minimum(at, len(self.mark) - 1)] == m]
        if not len(at):
            return np.empty(0, np.int64)
        shared = np.zeros(len(self.texts), bool)
        shared[self.of[_starts(self.mark_at[at], self.mark_n[at])]] = True
        if least <= 0:
            return np.nonzero(shared)[0]
        g = np.unique(g)
        at = np.searchsorted(self.gram, g)
        at = at[self.gram[np.minimum(at, len(self.gram) - 1)] == g]
        place = np.sort(self.place[_starts(self.gram_at[at], self.gram_n[at])])
        item = np.searchsorted(self.begin, place, side="right") - 1
        place, item = place[shared[item]], item[shared[item]]
        # letters that k-grams of the document cover: all equal letters of a passage are among them
        new = np.minimum(np.diff(np.r_[place, place[-1:] + k]), k)
        covered = np.r_[0, np.cumsum(new)]
        whole = np.bincount(item, new, len(self.texts))
        # a window as long as the least span, at one of the passage's ends, holds half of what the passage holds
        width = np.ceil(least * self.size[item])
        near = covered[np.searchsorted(place, place + width)] - covered[: len(place)]
        ok = (whole[item] >= self.kind.dense * least * self.size[item]) & (near >= self.kind.dense / 2 * width)
        return np.unique(item[ok])


def _winnow(h: np.ndarray, w: int) -> np.ndarray:
    kept = h if w == 1 else sliding_window_view(h, w).min(axis=1) if len(h) >= w else h.min(keepdims=True)
    return np.unique(kept)


class Matcher:
    """All items of a block, given as {plain text: item ids}."""

    def __init__(self, items: dict[str, list[int]]):
        self.ids = items
        kinds: dict[Kind, list[str]] = {}
        short = [p for p in items if kind_of(p) is None]
        for p in items:
            if kind := kind_of(p):
                kinds.setdefault(kind, []).append(p)
        self.indexes = [Index(k, ps) for k, ps in kinds.items()]
        self.short = ahocorasick.Automaton()
        for p in short:
            self.short.add_word(p, p)
        if short:
            self.short.make_automaton()
        self.any_short = bool(short)

    def passages(self, doc: str, least: float) -> Iterator[tuple[int, float, float]]:
        """(item, span, equal) of a plain text's passages of at least the given share."""
        for x in self.indexes:
            if x.kind is HAN and not _HAN.search(doc):
                continue
            for i in x.hits(doc, least):
                p = x.texts[i]
                span, equal = best_passage(doc, p, k=x.kind.k, item_gap=x.kind.gap, dense=x.kind.dense)
                if span and span >= least * len(p):
                    for item in self.ids[p]:
                        yield item, span / len(p), equal / len(p)
        if self.any_short:
            for p in {p for _, p in self.short.iter(doc)}:
                for item in self.ids[p]:
                    yield item, 1.0, 1.0


PASSAGE_SCHEMA = "doc_id long, item_id long, span double, equal double"


def _matcher(items: dict[str, list[int]], least: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(items)
        for b in batches:
            rows = [(d, *x) for d, text in zip(b["doc_id"], b["text"]) if (p := plain(text)) for x in matcher.passages(p, least)]
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "span", "equal"]).astype({"doc_id": "int64", "item_id": "int64", "span": float, "equal": float})

    return run


def passages(documents: DataFrame, items: DataFrame, least: float = SHARE) -> DataFrame:
    """(doc_id, item_id, span, equal): the share of the item's text that the document's longest passage spans, and
    the share that is equal, for passages of at least the share ``least``. With 0, every shared span of K + W - 1
    letters (K_HAN + W_HAN - 1 of Han and kana) comes out."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text <> ''").distinct()
    held = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text <> ''").distinct()
    parts, block, letters = [], {}, 0
    for r in held.orderBy("text", "item_id").toLocalIterator():  # a block of the items at a time
        p = plain(r.text)
        if not p:
            continue
        if p not in block:
            if letters + len(p) > BLOCK_LETTERS and block:
                parts.append(block)
                block, letters = {}, 0
            letters += len(p)
        block.setdefault(p, []).append(r.item_id)
    if block:
        parts.append(block)
    out = documents.sparkSession.createDataFrame([], PASSAGE_SCHEMA)
    for x in parts:
        out = out.unionByName(docs.mapInPandas(_matcher(x, least), PASSAGE_SCHEMA))
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct("span", "equal")).alias("m")).select("doc_id", "item_id", "m.span", "m.equal")


def leaks(documents: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id): documents that hold at least ``share`` of an item's text as one passage."""
    return passages(documents, items, share).select("doc_id", "item_id")
