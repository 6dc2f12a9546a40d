"""Mapping of free-entered values to a canonical list.

Method. Values are normalised to a compact key (lower case, no accents, numbering, continuation marks,
punctuation or blanks); each distinct key is resolved once. Keys that equal an entry of the reference list
(title, alias or variant) are done. The others meet the list by symmetric deletes: every deletion of up to d
characters from the first PREFIX characters of the key is joined to the same deletions of the entries, which
finds every entry within d edits. The candidates are ranked by a weighted Damerau-Levenshtein cost (confusable
characters, doubled letters and swaps cost less), then by how often the entry occurs exactly in the data, then
by id. Keys that are left are read word by word against the list: words in another order, left out, cut short,
abbreviated, or as initials. What this resolves without ambiguity is an entry from then on, and the symmetric
deletes are run once more for the misspelt forms of these. Keys without a candidate are misses and get -1.

Defined results
  * Null and blank values give no row; a value without any letter or digit is a miss.
  * Repeated rows give their row once per id and value. Extra columns are ignored. An empty reference list
    makes every value a miss; an empty table gives an empty result.
  * Ties in cost go to the more frequent entry, then the smaller id.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, small_side

PREFIX = 12
MAX_EDITS = 4
LEARN = 3  #: occurrences from which a form that was read is an entry itself

_LATIN = [chr(i) for i in range(0xDF, 0x250) if len(unicodedata.normalize("NFD", chr(i))) == 2 and chr(i).islower()]
ACCENTS = ("".join(_LATIN) + "øł", "".join(unicodedata.normalize("NFD", c)[0] for c in _LATIN) + "ol")
_CONTINUED = re.compile(r"[\s(\[\-_,;]*\bcont(?:inued|inuation|['’`]?d)\b[.)\]\s:;*=_-]*$")
_NUMBERING = re.compile(r"^[\s*#=_>-]*\(?(?:\d{1,3}|[a-z]|[ivx]{1,4})[.):]+\s*(?=\S{2})")
_WORD = re.compile(r"[^\W_]+")
ALIKE = {frozenset(p) for p in ("0o", "1i", "1l", "il", "5s", "8b", "2z", "6b", "ce", "uv", "nh", "ao", "rt", "un", "9g", "6g")}


def compact(c: Column | str) -> Column:
    """The key of a value: what is left of it when writing habits are taken away."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.translate(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), *ACCENTS)
    t = F.regexp_replace(t, r"\p{M}+", "")
    t = F.regexp_replace(t, r"[\s(\[\-_,;]*\bcont(?:inued|inuation|['’`]?d)\b[.)\]\s:;*=_-]*$", "")
    t = F.regexp_replace(t, r"^[\s*#=_>-]*\(?(?:\d{1,3}|[a-z]|[ivx]{1,4})[.):]+\s*(?=\S{2})", "")
    return F.regexp_replace(t, r"[^\p{L}\p{N}]+", "")


def edits_allowed(n: int) -> int:
    """Most edits for a key of n characters."""
    return 0 if n <= 3 else 1 if n <= 5 else 2 if n <= 8 else 3 if n <= 14 else MAX_EDITS


def deletes(key: str, d: int) -> set[str]:
    """All strings that deleting up to d characters from the key's prefix gives."""
    head = key[:PREFIX]
    return {"".join(head[i] for i in range(len(head)) if i not in gone) for k in range(min(d, len(head)) + 1) for gone in map(set, combinations(range(len(head)), k))}


def weighted_edits(a: str, b: str) -> tuple[float, int]:
    """(weighted cost, plain count) of a Damerau-Levenshtein alignment of a and b with least weighted cost."""
    prev2: list[tuple[float, int]] = []
    prev = [(0.0, 0)]
    for j in range(1, len(b) + 1):
        c = 0.6 if j > 1 and b[j - 1] == b[j - 2] else 1.0
        prev.append((prev[-1][0] + c, j))
    for i in range(1, len(a) + 1):
        x = a[i - 1]
        dx = 0.6 if i > 1 and x == a[i - 2] else 1.0
        cur = [(prev[0][0] + dx, i)]
        for j in range(1, len(b) + 1):
            y = b[j - 1]
            if x == y:
                best = prev[j - 1]
            else:
                s = 0.5 if frozenset((x, y)) in ALIKE else 1.0
                best = (prev[j - 1][0] + s, prev[j - 1][1] + 1)
            up = (prev[j][0] + dx, prev[j][1] + 1)
            if up < best:
                best = up
            dy = 0.6 if j > 1 and y == b[j - 2] else 1.0
            left = (cur[j - 1][0] + dy, cur[j - 1][1] + 1)
            if left < best:
                best = left
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2] and x != y:
                swap = (prev2[j - 2][0] + 0.7, prev2[j - 2][1] + 1)
                if swap < best:
                    best = swap
            cur.append(best)
        prev2, prev = prev, cur
    return prev[-1]


def _spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(k, x) for k in b["key"] for x in deletes(k, edits_allowed(len(k)))]
        if rows:
            yield pd.DataFrame(rows, columns=["key", "del"])


def _spread_entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        # A key may be longer than its entry by its own budget, so an entry spreads with the larger one.
        rows = [(e, x) for e in b["entry"] for x in deletes(e, min(MAX_EDITS, edits_allowed(len(e) + 1)))]
        if rows:
            yield pd.DataFrame(rows, columns=["entry", "del"])


def _cost(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(x, y, *weighted_edits(x, y)) for x, y in zip(b["key"], b["entry"])]
        if rows:
            yield pd.DataFrame(rows, columns=["key", "entry", "cost", "edits"])


def reference_entries(titles: DataFrame) -> DataFrame:
    """(entry, title_id): the keys of all titles and their aliases; an entry of two titles goes to the one whose
    title it is, then the smaller id."""
    own = titles.select("title_id", F.col("title").alias("v"), F.lit(0).alias("rank"))
    alias = titles.select("title_id", F.explode("known_aliases").alias("v"), F.lit(1).alias("rank"))
    keys = own.unionByName(alias).select("title_id", compact("v").alias("entry"), "rank").where("entry <> ''")
    return keys.groupBy("entry").agg(F.min(F.struct("rank", "title_id")).alias("m")).select("entry", F.col("m.title_id").alias("title_id"))


SMALL_WORDS = {"of", "the", "and", "for", "a", "in", "on"}


def spoken(v: str, synonyms: dict[str, str]) -> list[str]:
    """The words of a value without numbering, continuation mark and small words, synonyms replaced."""
    t = "".join(ch for ch in unicodedata.normalize("NFD", v.lower().replace("ß", "ss")) if not unicodedata.combining(ch))
    t = _CONTINUED.sub("", t)
    t = _NUMBERING.sub("", t)
    out = [w for w in _WORD.findall(t) if w not in SMALL_WORDS and not w.isdigit()]
    if len(out) > 2 and all(len(w) == 1 for w in out):  # spaced out; words stand further apart
        out = ["".join(_WORD.findall(p)) for p in re.split(r"\s{2,}", t.strip()) if _WORD.search(p)]
    return [x for w in out if len(w) > 1 for x in synonyms.get(w, w).split()]


def word_cost(v: str, t: str) -> float | None:
    """Cost of ``v`` as a way of writing the word ``t``; None if it is none."""
    if v == t:
        return 0.0
    same = next((i for i, (x, y) in enumerate(zip(v, t)) if x != y), min(len(v), len(t)))
    if same >= 4 and max(len(v), len(t)) - same <= (3 if same >= 5 else 2):  # another ending
        return 0.1
    if same == len(v) >= 2:  # cut short
        return 0.2 if same >= 3 else 0.4
    if same >= 5:  # the same stem
        return 0.4
    if v[0] == t[0] and 2 <= len(v) < min(6, len(t)):
        if len(v) == 2 and v[1] == "x":
            return 0.5
        rest = iter(t)
        if all(ch in rest for ch in v) and (v[-1] == t[-1] or len(v) == 3):  # letters left out
            return 0.6
    if min(len(v), len(t)) >= 4 and abs(len(v) - len(t)) <= 2 and weighted_edits(v, t)[1] <= edits_allowed(len(v)):  # misspelt
        return 0.3
    return None


def initials(w: str, ts: list[str]) -> bool:
    """Whether ``w`` is made of the words' initials, the last word perhaps abbreviated, others perhaps with letters
    of their inside."""
    first = "".join(t[0] for t in ts)
    if w in (first, first + "s"):
        return len(w) > 1
    if len(ts) > 1 and w[: len(ts) - 1] == first[:-1] and len(w) > len(ts) and (word_cost(w[len(ts) - 1 :], ts[-1]) or 1) <= 0.5:
        return True
    rest = iter("".join(ts))
    return len(ts) > 1 and 2 < len(w) <= len(ts) + 1 and w[0] == ts[0][0] and w[-1] == ts[-1][0] and all(ch in rest for ch in w)


def reading_cost(ws: list[str], ts: list[str]) -> float | None:
    """Cost of the words ``ws`` as a way of writing the words ``ts``; None if they are none."""
    made = next((w for w in ws if initials(w, ts)), None)
    if made:
        return 0.5 + 0.7 * (len(ws) - 1) if len(ws) <= 2 else None
    left, cost, hits, more = list(ts), 0.0, 0, 0.0
    for i, w in enumerate(ws):
        best = min(((c, t) for t in left if (c := word_cost(w, t)) is not None), default=None)
        if best:
            cost, hits = cost + best[0], hits + 1
            left.remove(best[1])
        elif more:
            return None
        else:  # a word more; the last word says most of what is meant
            more = 0.8 if i + 1 == len(ws) else 0.7
    return None if not hits or more and cost > 0.1 and (left or len(ts) == 1) else cost + 0.5 * len(left) + more


def _reader(entries: list[tuple[list[str], int]], synonyms: dict[str, str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows (key, value) to (key, title_id) where one title alone has the least cost."""
    starts: dict[str, set[int]] = {}
    for i, (ts, _) in enumerate(entries):
        for t in ts:
            starts.setdefault(t[0], set()).add(i)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, value in zip(b["key"], b["value"]):
                ws = spoken(value, synonyms)
                near = {i for w in ws for i in starts.get(w[0], ())}
                costs = sorted((c, entries[i][1]) for i in near if (c := reading_cost(ws, entries[i][0])) is not None)
                if costs and len({t for c, t in costs if c <= costs[0][0] + 1e-9}) == 1:
                    rows.append((key, costs[0][1]))
            if rows:
                yield pd.DataFrame(rows, columns=["key", "title_id"])

    return run


def near_keys(rest: DataFrame, entries: DataFrame, n_entries: int, freq: DataFrame) -> DataFrame:
    """(key, title_id, entry, cost) of the keys that are within their edits of an entry."""
    dels = entries.select("entry").mapInPandas(_spread_entries, "entry string, del string")
    pairs = rest.select("key").where("key <> ''").mapInPandas(_spread, "key string, del string").join(small_side(dels, n_entries * 800, 2_000_000), "del").select("key", "entry").distinct()
    near = pairs.where(F.abs(F.length("key") - F.length("entry")) <= MAX_EDITS).mapInPandas(_cost, "key string, entry string, cost double, edits int")
    n = F.length("key")
    budget = F.when(n <= 3, 0).when(n <= 5, 1).when(n <= 8, 2).when(n <= 14, 3).otherwise(MAX_EDITS)
    near = near.where((F.col("edits") <= budget) & (F.length("entry") > 3))
    best = near.join(entries, "entry").join(freq, "entry", "left").groupBy("key").agg(F.min(F.struct("cost", (-F.coalesce("freq", F.lit(0))).alias("f"), "title_id", "entry")).alias("m"))
    return best.select("key", "m.title_id", "m.entry", "m.cost")


def resolve_keys(keys: DataFrame, titles: DataFrame, synonyms: dict[str, str] | None = None) -> DataFrame:
    """(key, title_id, entry, cost) for every row (key, value, n) of ``keys``; title_id -1 for misses."""
    entries = cut(reference_entries(titles))
    n_entries = entries.count()
    exact = cut(keys.join(small_side(entries, n_entries), keys.key == entries.entry).select("key", "n", "title_id", "entry"))
    freq = exact.groupBy("entry").agg(F.sum("n").alias("freq"))
    # few distinct keys share one row group, so spread them before the deletions multiply them
    rest = cut(keys.join(exact.select("key"), "key", "left_anti").repartition("key"))
    close = cut(near_keys(rest, entries, n_entries, freq))
    rest = rest.join(close.select("key"), "key", "left_anti")
    # the reference list is the stated set that all other keys are read against
    listed = [(spoken(v, {}), r.title_id) for r in titles.select("title_id", "title", "known_aliases").toLocalIterator() for v in (r.title, *(r.known_aliases or ())) if v]
    read = cut(rest.where("key <> ''").select("key", "value").mapInPandas(_reader([x for x in listed if x[0]], synonyms or {}), "key string, title_id int"))
    learned = read.join(keys, "key").where(f"n >= {LEARN}").select(F.col("key").alias("entry"), "title_id", F.col("n").alias("freq"))
    learned = cut(learned)
    again = near_keys(rest.join(learned.select(F.col("entry").alias("key")), "key", "left_anti"), learned.select("entry", "title_id"), learned.count(), learned.select("entry", "freq"))
    far = read.select("key", "title_id", F.lit(None).cast("string").alias("entry"), F.lit(None).cast("double").alias("cost"))
    # a misspelt form of a learned entry goes before a reading of its own
    again = cut(again)
    found = exact.select("key", "title_id", "entry", F.lit(0.0).alias("cost")).unionByName(close).unionByName(again).unionByName(far.join(again.select("key"), "key", "left_anti"))
    return keys.select("key").join(found, "key", "left").select("key", F.coalesce("title_id", F.lit(-1)).alias("title_id"), "entry", "cost")


def map_values(df: DataFrame, titles: DataFrame, id_col: str, value_col: str, synonyms: dict[str, str] | None = None) -> DataFrame:
    """(id, value, title_id, entry, cost): every filled value with the entry it stands for. ``synonyms`` are words
    of the caller's field and the words they stand for."""
    filled = df.select(F.col(id_col).alias("id"), F.col(value_col).alias("value")).where(F.col(value_col).rlike(r"(?U)\S")).withColumn("key", compact("value"))
    keys = cut(filled.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("value")))
    known = cut(resolve_keys(keys, titles, synonyms))
    return filled.join(small_side(known, known.count()), "key").select("id", "value", "title_id", "entry", "cost")


def found(sections: DataFrame, titles: DataFrame, synonyms: dict[str, str] | None = None) -> DataFrame:
    """(section_id, title_id) of every section with a filled title."""
    m = map_values(sections, titles, "section_id", "section_title", synonyms)
    return m.select(F.col("id").alias("section_id"), F.col("title_id").cast("int").alias("title_id")).distinct()


def report(sections: DataFrame, titles: DataFrame, synonyms: dict[str, str] | None = None) -> DataFrame:
    """(title_id, value, n): how often each written value stands for each title; -1 lists the misses."""
    m = map_values(sections, titles, "section_id", "section_title", synonyms)
    return m.groupBy("title_id", "value").agg(F.count_distinct("id").alias("n"))
