"""Repair of text from scanned pages.

Method. One pass counts all neighbouring word pairs and all lines with their numbers masked, over all pages.
Words are grouped by a skeleton in which glyphs that scanners confuse are equal; in a group a rare word is a
misreading of a frequent one if glyph errors lead from that to it and the pairs it stands in exist with the
frequent form too. A masked line that recurs at the edge of pages, and hardly elsewhere, is a running header or
footer; one whose number is mostly the page's own is a page number. A second pass marks and repairs the lines:
broken words are joined if the joined word (or its skeleton) is known, and compounds keep their hyphen. Windows
over the lines then make paragraphs.

Defined results
  * Lines are what line feeds separate, numbered from 0. Null and empty texts have no line to report.
  * A header, footer or page-number line counts only as that; of the two, page number goes first.
  * Repeated rows of a page count once; of different texts of a page id, paragraphs come from one (the least hash).
    Extra columns are ignored; an empty table gives an empty result.
  * A page whose final_text is null or blank comes out from its native_text in paragraphs, unless its strategy is
    'empty'; found() reports lines of final_text only.
  * Repairs, broken words and recurring lines are handed to all tasks if each has at most SHARED rows; beyond that
    all are joined to the pages that need them, with the same result.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import filterfalse

import ahocorasick
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, small_side

SHARED = 200_000
FLUSH = 500_000  #: counts that a task holds before it hands them on
TOP, BOTTOM = 3, 2  #: lines at a page's edges that a header or footer may be
EDGE_SHARE = 0.85  #: of a masked line's occurrences that must be at an edge
SHORTEST = 8  #: letters and digits that a header has at least; less is a remnant of the text layer
RECURS = 6  #: pages on which a masked line must recur
FREQUENT = 6  #: occurrences of a form that others may be misreadings of
RATIO = 5  #: by which it must outnumber them

#: What a scanner makes of a glyph.
GLYPHS: dict[str, tuple[str, ...]] = {
    "e": ("c",), "a": ("ä",), "i": ("l", "1", "j", "!"), "o": ("0",), "n": ("ri", "ii"), "l": ("1", "i", "|"), "d": ("cl",), "u": ("v", "ii"), "g": ("9", "q"), "m": ("rn", "nn"), "h": ("b",),
    "t": ("f",), "s": ("5",), "b": ("6", "h"), "c": ("e",), "li": ("h",), "w": ("vv",), "cl": ("d",), "rn": ("m",), "ri": ("n",), "q": ("g", "9"), "z": ("2",), "v": ("u",), "f": ("t",), "th": ("tb",),
}
_SINGLE = str.maketrans("1i|!jo0s59gqbh6ecuvaäft2z", "lllllooss" + "ggghhhccuuaattzz")
_BYTES = bytes(_SINGLE.get(i, i) if i < 128 else i for i in range(256))
_GLYPH_PAIRS = [("rl", "n"), ("rn", "m"), ("cl", "d"), ("ll", "h"), ("nn", "m")]
_TOKEN = re.compile(r"[^\W_]+")
_CODE = re.compile(r"\d+|[A-Z]{1,4}\d+[A-Z]?|\d+[A-Za-z]|\d+x\d+|[A-Z\d]{2,6}(?<=\d)|(?=\w*\d\w*\d)\w+")
_BROKEN = re.compile(r"([^\W\d_]+)([-‐‑¬­])$")
_FRAGMENT = re.compile(r"[-‐‑¬\xad]\n[^\W_]+")
_OPEN_END = re.compile(r"[-‐‑¬\xad][^\S\n]*\n")
_PLAIN_NUMBER = re.compile(r"[\[(]?\d{1,4}(?:/\d{1,4})?[\])]?")
_SOFT = re.compile(r"([^\W\d_]+)[¬­]\n\s*([^\W_]+)")
_BREAK = re.compile(r"[-‐‑][^\S\n]*\n")
_NUMBER = re.compile(r"\d\S*")  # what stands before it in its token is sought by hand: a pattern for it is tried at every letter
_NO_DIGITS = str.maketrans("", "", "0123456789")
_DIGIT = re.compile(r"\d")
_DIGITS = re.compile(r"\d+")
_HYPHENS = "-‐‑¬\xad"
_PAGE = re.compile(
    r"^\s*(?:[-–—]\s*\d{1,4}\s*[-–—]|\[\d{1,4}\]|\(\d{1,4}\)|\d{1,4}(?:\s*/\s*\d{1,4})?"
    r"|(?:p[a-z]?[gc]e?|pg|p|seite|page|página|pagina|pag|стр|страница|folio)\b[.:]?\s*[\dlIO]{1,4}(?:\s*(?:/|of|von|de|sur|из|\|)\s*[\dlIO]{1,4})?"
    r"|\d{1,4}\s*\|\s*\D+|第?\s*\d+\s*页.*)\s*$",
    re.IGNORECASE,
)


def skeleton(word: str) -> str:
    """The word in lower case with confusable glyphs made equal."""
    s = word.lower().translate(_SINGLE)
    return s.replace("rl", "n").replace("rn", "m").replace("cl", "d").replace("ll", "h").replace("nn", "m").replace("uu", "w")


def explains(right: str, wrong: str, most: int = 3) -> int:
    """Fewest glyph errors, 1 to ``most``, that make ``wrong`` of ``right`` (lower case); 0 if there is no such way."""
    ways = {(0, 0): 0}
    for i in range(len(right) + 1):
        for j in range(len(wrong) + 1):
            e = ways.get((i, j))
            if e is None or i == len(right):
                continue
            if j < len(wrong) and right[i] == wrong[j] and ways.get((i + 1, j + 1), 9) > e:
                ways[i + 1, j + 1] = e
            if e < most:
                for n in (1, 2):
                    for bad in GLYPHS.get(right[i : i + n], ()) if i + n <= len(right) else ():
                        if wrong.startswith(bad, j) and ways.get((i + n, j + len(bad)), 9) > e + 1:
                            ways[i + n, j + len(bad)] = e + 1
    return ways.get((len(right), len(wrong)), 0)


@lru_cache(1 << 16)
def _mask(t: str) -> str:
    """A number, or a code with digits, as one sign; a word with one or two misread letters stays."""
    if len(t) < 5:
        return "#"
    letters = t.translate(_NO_DIGITS)
    return t if len(letters) >= 4 and len(t) - len(letters) <= 2 and letters.replace("-", "", 1).isalpha() else "#"


def _without_numbers(t: str) -> str:
    """The text with each token that holds a digit masked."""
    kept, last = [], 0
    for m in _NUMBER.finditer(t):
        s, e = m.span()
        while s > last and not t[s - 1].isspace():
            s -= 1
        kept += t[last:s], _mask(t[s:e])
        last = e
    return "".join(kept) + t[last:] if kept else t


def masked_lines(text: str) -> list[str]:
    """The lines of a text with their numbers and codes as one sign, compared by skeleton. A word with one or two
    misread letters is no code."""
    t = _without_numbers(text.lower()).replace("ä", "a")
    t = t.encode("utf-8", "surrogatepass").translate(_BYTES).decode("utf-8", "surrogatepass")  # faster than a table for str
    for glyph, same in _GLYPH_PAIRS:
        t = t.replace(glyph, same)
    return t.split("\n")


def masked(line: str) -> str:
    return masked_lines(line)[0].strip()


def labels_only(key: str) -> str:
    """A masked line with what follows each colon taken away: of 'patient: jane doe  mrn: #' the labels are left."""
    return re.sub(r":[^:]*?(?=\s\S+:|$)", ":*", key) if key.count(":") > 1 else key


def edge_lines(lines: list[str]) -> set[int]:
    """Indexes of the first and last filled lines."""
    filled = [i for i, x in enumerate(lines) if x.strip()]
    return {*filled[:TOP], *filled[-BOTTOM:]}


def without_fragments(text: str) -> str:
    """The text without words that a line break divides."""
    kept, last = [], 0
    for m in _FRAGMENT.finditer(text):
        s = m.start()
        while s > last and text[s - 1].isalnum():
            s -= 1
        kept.append(text[last:s])
        last = m.end()
    return "".join(kept) + text[last:] if kept else text


def split_words(text: str) -> list[tuple[str, str]]:
    """What stands before a hyphen at a line's end, and the next line's first word; only hyphens that a compound
    could have too."""
    out = []
    for m in _BREAK.finditer(text):
        s = m.start()
        while s and text[s - 1].isalpha():
            s -= 1
        nxt = _TOKEN.match(text[m.end() : m.end() + 60].lstrip())
        if s < m.start() and nxt:
            out.append((text[s : m.start()], nxt.group()))
    return out


COUNT_SCHEMA = pa.schema([("a", pa.string()), ("b", pa.string()), ("h", pa.int64()), ("key", pa.string()), ("n", pa.int64()), ("edge", pa.int64()), ("own", pa.int64())])


def _counted(pairs: Counter[tuple[str, str]], lines: Counter[str], edges: dict[str, list[int]], splits: Counter[tuple[str, str]]) -> pa.RecordBatch:
    """Counts as rows: pairs of words under 0, split words under -1. Lines meet by a hash of their masked form;
    only forms seen at an edge are spelled out."""
    words, n = [*pairs, *splits], len(lines)
    blank, none = [""] * n, [0] * len(words)
    at = list(map(edges.get, lines))
    columns = [
        [x for x, _ in words] + blank,
        [y for _, y in words] + blank,
        [0] * len(pairs) + [-1] * len(splits) + [x if (x := xxhash.xxh64_intdigest(k) - (1 << 63)) not in (0, -1) else 1 for k in lines],
        [None] * len(words) + [k if c else None for k, c in zip(lines, at)],
        [*pairs.values(), *splits.values(), *lines.values()],
        none + [c[0] if c else 0 for c in at],
        none + [c[1] if c else 0 for c in at],
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, COUNT_SCHEMA)], schema=COUNT_SCHEMA)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs: Counter[tuple[str, str]] = Counter()
    lines: Counter[str] = Counter()
    edges: dict[str, list[int]] = {}
    splits: Counter[tuple[str, str]] = Counter()
    for b in batches:
        for text, page in zip(b.column("text").to_pylist(), b.column("page_number").to_pylist()):
            ws = ["^", *filterfalse(str.isdigit, _TOKEN.findall(without_fragments(text).lower()))]
            pairs.update(zip(ws, ws[1:]))
            splits.update(split_words(text))
            split = text.split("\n")
            forms = [labels_only(k) if ":" in k else k for k in map(str.strip, masked_lines(text))]
            lines.update(forms)
            for i in edge_lines(split):
                k = forms[i]
                at = edges.get(k)
                if at is None:
                    at = edges[k] = [0, 0]
                at[0] += 1
                if "#" in k and page is not None and page == page and str(int(page)) in _DIGITS.findall(split[i]):
                    at[1] += 1
        if len(pairs) + len(lines) > FLUSH:
            del lines[""]  # blank lines
            yield _counted(pairs, lines, edges, splits)
            pairs, lines, edges, splits = Counter(), Counter(), {}, Counter()
    del lines[""]
    if pairs or lines:
        yield _counted(pairs, lines, edges, splits)


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame([(s, w, r) for s, w, r in zip(b["wrong"], b["right"], map(lambda p: explains(p[0], p[1]), zip(b["right"], b["wrong"]))) if r], columns=["wrong", "right", "errors"])


def _with_skeleton(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.assign(skeleton=[skeleton(w) for w in b["word"]])


def statistics(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(word pairs (a, b, n), recurring lines (key, page_no), split words (a, b)) of all pages (text, page_number)."""
    seen = cut(
        pages.select("text", "page_number")
        .mapInArrow(_count, "a string, b string, h long, key string, n long, edge long, own long")
        .groupBy("h", "a", "b")
        .agg(F.sum("n").alias("n"), F.sum("edge").alias("edge"), F.sum("own").alias("own"), F.max("key").alias("key"))
        .where(f"h in (0, -1) or edge >= {RECURS}")
    )
    total = pages.count()
    prose = "(key rlike '[^0-9][.,;]$' or key rlike '^[a-z(]+ [a-z]+ [a-z]+ [a-z]+.*[.]$')"  # ends like a sentence: must recur far more
    lines = seen.where(f"h not in (0, -1) and edge >= {EDGE_SHARE} * n and (edge >= {0.01 * total} or not {prose})").select("key", (F.col("own") >= 0.7 * F.col("edge")).alias("page_no"))
    return seen.where("h = 0").select("a", "b", "n"), lines, seen.where("h = -1").select("a", "b")


def vocabulary(pairs: DataFrame) -> DataFrame:
    """(word, n, skeleton)."""
    return pairs.groupBy(F.col("b").alias("word")).agg(F.sum("n").alias("n")).mapInPandas(_with_skeleton, "word string, n long, skeleton string")


def repairs(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """(wrong, right): misread words with the form they stand for."""
    w = Window.partitionBy("skeleton")
    frequent = words.where(f"n >= {FREQUENT} and word rlike '^[^0-9]{{2,}}$'").select("skeleton", F.col("word").alias("right"), F.col("n").alias("m"))
    # a skeleton has few frequent forms, so this join stays near the number of words
    both = words.join(frequent, "skeleton").where(f"word <> right and m >= {RATIO} * n").select(F.col("word").alias("wrong"), "right", "n", "m")
    ok = both.select("wrong", "right").mapInPandas(_candidates, "wrong string, right string, errors int")
    ok = cut(ok.join(both, ["wrong", "right"]))
    # context: the pairs of the wrong form must exist with the right one
    before = pairs.join(small_side(ok.select(F.col("wrong").alias("b"), "right"), ok.count()), "b").select("a", F.col("b").alias("wrong"), "right", "n", F.lit(0).alias("side"), F.col("right").alias("b"))
    after = pairs.withColumnRenamed("b", "next").join(small_side(ok.select(F.col("wrong").alias("a"), "right"), ok.count()), "a").select(F.col("right").alias("a"), F.col("a").alias("wrong"), "right", "n", F.lit(1).alias("side"), F.col("next").alias("b"))
    held = before.unionByName(after).join(pairs.select("a", "b", F.col("n").alias("with_right")), ["a", "b"], "left")
    support = held.groupBy("wrong", "right").agg(F.sum(F.when(F.col("with_right") > F.col("n"), F.col("n")).otherwise(0)).alias("yes"), F.sum("n").alias("all"))
    best = support.join(ok, ["wrong", "right"]).where("yes >= case when length(wrong) <= 3 then 0.5 else 0.25 end * all and yes >= 1")
    del w
    return best.groupBy("wrong").agg(F.max_by("right", F.struct(F.col("yes") / F.col("all"), -F.col("errors"), "m", "right")).alias("right"))


def broken_words(splits: DataFrame, words: DataFrame, fixes: DataFrame) -> DataFrame:
    """(pair): split words, as 'a|b', that are one word: the joined form is known or misread, or else no name
    follows and it has a frequent word's skeleton, or its parts are hardly known by themselves."""
    t = splits.select("a", "b", F.lower(F.concat("a", "b")).alias("word"))
    t = t.join(t.select("word").distinct().withColumn("n", F.lit(0).cast("long")).mapInPandas(_with_skeleton, "word string, n long, skeleton string").select("word", "skeleton"), "word")
    n = lambda c, out: words.select(F.col("word").alias(c), F.col("n").alias(out))
    t = t.withColumns({"la": F.lower("a"), "lb": F.lower("b")})
    t = t.join(n("word", "n_joined"), "word", "left").join(n("la", "n_a"), "la", "left").join(n("lb", "n_b"), "lb", "left")
    t = t.join(fixes.select(F.col("wrong").alias("word"), F.lit(True).alias("misread")), "word", "left")
    t = t.join(words.where(f"n >= {FREQUENT}").select("skeleton").distinct().withColumn("frame", F.lit(True)), "skeleton", "left")
    known = (F.coalesce("n_joined", F.lit(0)) >= 3) | F.coalesce("misread", F.lit(False))
    name = F.col("b").rlike(r"^\p{Lu}") & (F.upper("a") != F.col("a"))
    rare = (F.least(F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0))) < 8) & (F.length("word") > 4)
    one = F.col("b").rlike(r"^\p{L}") & (known | (~name & (F.coalesce("frame", F.lit(False)) | rare)))
    return t.where(one).select(F.concat_ws("|", "a", "b").alias("pair")).distinct()


class Repairer:
    """Marks and repairs the lines of a page, given the repairs, split words and recurring lines it may hold."""

    def __init__(self, fix: dict[str, str], broken: set[str], edge: dict[str, bool]):
        self.fix, self.broken, self.edge = fix, broken, edge
        self.wrong = ahocorasick.Automaton()
        for w in fix:
            self.wrong.add_word(w, w)
        if fix:
            self.wrong.make_automaton()

    def hits(self, low: str) -> set[str]:
        """The words to repair that a text holds."""
        if not self.fix:
            return set()
        n = len(low)
        return {w for e, w in self.wrong.iter(low) if (e + 1 == n or not low[e + 1].isalnum()) and (e < len(w) or not low[e - len(w)].isalnum())}

    def right(self, token: str, fix: dict[str, str]) -> str | None:
        """The form a misread token stands for."""
        r = fix.get(token.lower())
        if r is None or len(token) < 2 or token.isupper() and len(token) <= 3 or not token.isalpha() and _CODE.fullmatch(token):
            return None
        return r.upper() if token.isupper() else r.capitalize() if token[0].isupper() else r

    def is_broken(self, a: str, mark: str, b: str) -> bool:
        """Whether ``a`` + hyphen at a line's end and ``b`` after it are one word."""
        return bool(b) and b[0].isalpha() and (mark in "¬­" or f"{a}|{b}" in self.broken)

    def lines(self, text: str, marked_only: bool = False) -> list[tuple[int, str, str, bool]]:
        """(line number, kinds joined by '+', repaired line, joins the next without a blank) of every line, or of
        those that have a kind."""
        fix = self.fix
        split = text.split("\n")
        n = len(split)
        kinds: list[str] = [""] * n
        at = sorted(edge_lines(split))
        for i, k in zip(at, masked_lines("\n".join([split[i] for i in at]))):
            x = split[i]
            own = self.edge.get(labels_only(k.strip()))
            if _PAGE.match(x) and len(x.strip()) < 40 or own and (numbers := [t for t in x.split() if _DIGIT.search(t)]) and all(_PLAIN_NUMBER.fullmatch(t) for t in numbers):
                kinds[i] = "page_no"
            elif own is not None and sum(map(len, _TOKEN.findall(x))) >= SHORTEST:
                kinds[i] = "header"
        outside = ("header", "page_no")
        low = text.lower()
        hits = self.hits(low)
        if marked_only and not hits and not _OPEN_END.search(text):
            return [(i, kinds[i], split[i], False) for i in at if kinds[i]]
        held: set[int] = set()  # lines that hold such a word
        for h in hits:
            e = low.find(h)
            while e >= 0:
                held.add(low.count("\n", 0, e))
                end = low.find("\n", e)
                e = low.find(h, end) if end >= 0 else -1
        out: list[tuple[int, str, str, bool]] = []
        inherited = ""
        joined_before = False
        for i, x in enumerate(split):
            if kinds[i] in outside:
                out.append((i, kinds[i], x, False))
                inherited, joined_before = "", False
                continue
            kind, inherited = inherited, ""
            x = x.rstrip()
            tail = ""
            if x and x[-1] in _HYPHENS and i + 1 < n and kinds[i + 1] not in outside:
                m = _BROKEN.search(x)
                nxt = _TOKEN.match(split[i + 1].lstrip()) if m else None
                if m and nxt and self.is_broken(m.group(1), m.group(2), nxt.group()):
                    tail = m.group(1)
                    kind = f"hyphen+{kind}".strip("+")
                    whole = self.right(tail + nxt.group(), fix)
                    if whole and not whole.lower().startswith(tail.lower()) and "misread" not in kind:
                        kind += "+misread"
                    if whole and not whole.lower().endswith(nxt.group().lower()):
                        inherited = "misread"
            if i in held:
                marks = list(_TOKEN.finditer(x))[1 if joined_before else 0 :]
                if tail:
                    marks = marks[:-1]
                fixed = [(t.start(), t.end(), r) for t in marks if t.group().lower() in fix and (r := self.right(t.group(), fix))]
                if fixed and "misread" not in kind:
                    kind = f"{kind}+misread".strip("+")
                for s, e, r in reversed(fixed):
                    x = x[:s] + r + x[e:]
            joined_before = bool(tail)
            out.append((i, kind, x[:-1] if tail else x, bool(tail)))
        return [x for x in out if x[1]] if marked_only else out


LINES = [("page_id", pa.int64()), ("line_no", pa.int32()), ("kinds", pa.string()), ("line", pa.string()), ("joins", pa.bool_())]
LINE_SCHEMA, MARK_SCHEMA = "page_id long, line_no int, kinds string, line string, joins boolean", "page_id long, line_no int, kinds string"


def _rows(rows: list[tuple], marked_only: bool) -> pa.RecordBatch:
    """Rows of lines as a batch; marked lines go without their text."""
    names = LINES[:3] if marked_only else LINES
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows), names)], names=[n for n, _ in names])


def _marker(fix: dict[str, str], broken: set[str], edge: dict[str, bool], marked_only: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Repairer(fix, broken, edge)
        for b in batches:
            rows = [(page, *x) for page, text in zip(b.column("page_id").to_pylist(), b.column("text").to_pylist()) for x in r.lines(text, marked_only)]
            if rows:
                yield _rows(rows, marked_only)

    return run


def _marker_with(marked_only: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same with what each page needs in its own row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for page, text, fix, broken, edge in zip(*(b.column(c).to_pylist() for c in ("page_id", "text", "fix", "broken", "edge"))):
                r = Repairer(dict(fix or {}), set(broken or ()), dict(edge or {}))
                rows += [(page, *x) for x in r.lines(text, marked_only)]
            if rows:
                yield _rows(rows, marked_only)

    return run


def _needs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(page_id, kind, key): the words, split words and edge lines of each page."""
    for b in batches:
        rows = []
        for page, text in zip(b["page_id"], b["text"]):
            tokens = set(_TOKEN.findall(text.lower())) | {(x + y).lower() for x, y in split_words(text)}
            tokens |= {(m.group(1) + m.group(2)).lower() for m in _SOFT.finditer(text)}
            split = text.split("\n")
            rows += [(page, "fix", w) for w in tokens] + [(page, "broken", f"{x}|{y}") for x, y in set(split_words(text))]
            rows += [(page, "edge", k) for k in {labels_only(masked(split[i])) for i in edge_lines(split)}]
        if rows:
            yield pd.DataFrame(rows, columns=["page_id", "kind", "key"])


def lines(pages: DataFrame, marked_only: bool = False) -> DataFrame:
    """(page_id, line_no, kinds, line, joins): every line with its kinds and its repaired text; or only the first
    three of the lines that have a kind."""
    text = F.col("final_text")
    if not marked_only and {"native_text", "strategy"} <= set(pages.columns):
        text = F.when(text.rlike(r"(?U)\S") | (F.coalesce("strategy", F.lit("")) == "empty"), text).otherwise(F.col("native_text"))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "page_number", text.alias("text")).where("page_id is not null and text <> ''")
    pairs, edges, splits = statistics(p)
    if not marked_only:  # of different texts of a page one is repaired; only hashes are grouped
        version = F.xxhash64("text")
        many = cut(p.groupBy("page_id").agg(F.min(version).alias("least"), F.max(version).alias("most")).where("least < most").select("page_id", "least"))
        n = many.count()
        if n:
            p = p.join(small_side(many, n), "page_id", "left").where(F.col("least").isNull() | (version == F.col("least"))).drop("least")
    words = cut(vocabulary(pairs))
    fixes = cut(repairs(pairs, words))
    broken = cut(broken_words(splits, words, fixes))
    if max(t.count() for t in (fixes, broken, edges)) <= SHARED:
        fix = {r.wrong: r.right for r in fixes.toLocalIterator()}
        pairs_broken = {r.pair for r in broken.toLocalIterator()}
        edge = {r.key: r.page_no for r in edges.toLocalIterator()}
        return p.mapInArrow(_marker(fix, pairs_broken, edge, marked_only), MARK_SCHEMA if marked_only else LINE_SCHEMA)
    known = fixes.select(F.lit("fix").alias("kind"), F.col("wrong").alias("key"), "right", F.lit(None).cast("boolean").alias("page_no"))
    known = known.unionByName(broken.select(F.lit("broken").alias("kind"), F.col("pair").alias("key"), F.lit(None).cast("string").alias("right"), F.lit(None).cast("boolean").alias("page_no")))
    known = known.unionByName(edges.select(F.lit("edge").alias("kind"), "key", F.lit(None).cast("string").alias("right"), "page_no"))
    own = p.select("page_id", "text").mapInPandas(_needs, "page_id long, kind string, key string").distinct().join(known, ["kind", "key"])
    mine = lambda kind, value: F.collect_set(F.when(F.col("kind") == kind, value))
    own = own.groupBy("page_id").agg(
        F.map_from_entries(mine("fix", F.struct("key", "right"))).alias("fix"),
        mine("broken", F.col("key")).alias("broken"),
        F.map_from_entries(mine("edge", F.struct("key", "page_no"))).alias("edge"),
    )
    return p.join(own, "page_id", "left").select("page_id", "text", "fix", "broken", "edge").mapInArrow(_marker_with(marked_only), MARK_SCHEMA if marked_only else LINE_SCHEMA)


def found(pages: DataFrame) -> DataFrame:
    """(page_id, line_no, kind) of every header, page number, broken word and misreading."""
    kinds = lines(pages, marked_only=True).select("page_id", "line_no", F.explode(F.split("kinds", r"\+")).alias("kind"))
    return kinds.distinct()


def paragraphs(pages: DataFrame) -> DataFrame:
    """(page_id, paragraph_no, text): the repaired pages as continuous paragraphs. A blank line or a heading (a
    line in capitals or with a colon at its end, of at most six words) ends a paragraph."""
    x = lines(pages).where("kinds not like '%header%' and kinds not like '%page_no%'").select("page_id", "line_no", "line", "joins")
    # one exchange by page serves the deduplication, the windows and the grouping
    x = x.repartition("page_id").dropDuplicates(["page_id", "line_no"])
    w = Window.partitionBy("page_id").orderBy("line_no")
    line = F.trim("line")
    heading = (line != "") & (F.size(F.split(line, r"\s+")) <= 6) & ((F.upper(line) == line) & line.rlike(r"\p{Lu}{3}") & ~line.rlike(r"[.;,]$"))
    x = x.withColumns({"line": line, "heading": heading, "blank": line == ""})
    x = x.withColumn("breaks", (F.col("blank") | F.col("heading") | F.lag("heading", 1, True).over(w)).cast("int"))
    x = x.withColumn("p", F.sum("breaks").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(~F.col("blank"))
    piece = F.concat("line", F.when(F.col("joins"), "").otherwise(" "))
    text = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", piece.alias("s")))), lambda z: z["s"]), ""))
    out = x.groupBy("page_id", "p").agg(text.alias("text"))
    return out.select("page_id", (F.row_number().over(Window.partitionBy("page_id").orderBy("p")) - 1).alias("paragraph_no"), "text")
