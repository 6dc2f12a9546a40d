"""Sentence boundaries across languages and scripts.

Method. Between two words lies a hidden event: a boundary or none. One pass counts, over all texts, the events'
contexts: the word before, the kind of gap (end mark, white space, case or script of what follows, quotation
mark) and the word after; and all pairs of words that certainly lie within a unit. Expectation-maximisation
turns these counts into a hidden-event bigram model: the chance of a boundary for a kind of gap and a word
before it, of a word to open a unit, and of a word to follow another inside one. For each text the lines' habit
(one unit a line, or wrapped) is a further hidden variable, and forward-backward over the candidates gives the
posteriors that decide, with a penalty on empty units. Scripts without spaces are read by the ends of their
runs, so they need no end marks.

Rules beside the model: nothing inside a quotation opens a unit; closing marks stay with the unit before; a list
mark belongs to what it opens; a title alone on its line is a unit.

Defined results
  * Null, empty and blank texts have no unit. The first unit starts at the first character that is no white
    space. Offsets count characters (code points) from 0. Repeated rows of an id count once; an id with
    different texts gets the units of each. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

ROUNDS = 4
RARE = 4
HIDDEN = 0.3  #: weight of an event that no line shows

_RUN = r"฀-໿က-႟ក-៿぀-ヿ㐀-鿿"  # scripts written without spaces
_LOOSE = r"฀-໿က-႟ក-៿"  # of these, the ones that set spaces between phrases
_END = r".!?…。！？｡؟۔।॥"
_CLOSE = r"»”\"“’\')\]』」"
_QUOTED = regex.compile(r"„[^„“”]{1,600}?[“”]|«[^«»]{1,600}»|“[^“”]{1,600}”|「[^「」]{1,600}」|『[^『』]{1,600}』|(?<![\w])\"[^\"]{1,600}?\"")
_BREAK = regex.compile(
    rf"(?<=[{_END}](?:\s?[{_CLOSE}])?[{_CLOSE}]*)\s+|[^\S\n]*\n\s*|(?<=[{_LOOSE}\d%])[^\S\n]+(?=[{_LOOSE}\w])|[^\S\n]+(?=[{_LOOSE}])|[^\S\n]{{2,}}"
    rf"|(?<=[\p{{Ll}}\d%)\p{{Lo}}][.!?][{_CLOSE}]?)(?=[\p{{Lu}}„«“¿¡])|(?<=[。！？｡][」』”]?)(?=[^\s」』”。！？])"
)
_LEFT = regex.compile(rf"((?:\p{{L}}\.)+\p{{L}}|[\p{{L}}\p{{M}}]+(?:['’\-][\p{{L}}\p{{M}}]+)*|\d[\d.,:/\-]*|[^\s\w])\s?$", regex.V1)
_END_SIGNS, _CLOSE_SIGNS = frozenset(_END), frozenset("»”\"“’') ]』」".replace(" ", ""))
_RIGHT = regex.compile(r"[\p{L}\p{M}]+(?:['’\-][\p{L}\p{M}]+)*|\d|\S")
_WORD = regex.compile(r"[\p{L}\p{M}]+(?:['’\-.](?=\p{L})[\p{L}\p{M}]+)*|\d[\d.,:/\-]*\d|\d")
_LIST = regex.compile(r"(?:[-•*·–‣◦▪]|\(?\d{1,2}[.)]|\(?[a-zA-Z][)])[^\S\n]+(?=\S)")
_ENUM = regex.compile(r"\(?(?:\d{1,2}|[a-zA-Z])[.)]|[-•*·–‣◦▪]")
_NUMBERED = regex.compile(r"\d(?:[\d.,:/\-]*\d)?\s+(\p{Ll}[\p{L}\p{M}]*)")
_MARKED = regex.compile(r"(?:^|\n)[^\S\n]*\(?(?:\d{1,2}|[a-zA-Z])[.)]$")
_CONTENT = regex.compile(r"[\p{L}\p{M}\d%]$")
_ENDS = regex.compile(rf"((?:[^\S\n]?[{_END}])+)$")
_TAIL = regex.compile(rf"(\s?[{_CLOSE}]+)$")

#: Shortened words that seldom end a sentence; they only set the start of the estimation.
SHORTENED = set(
    "dr mr mrs ms prof hr fr frau mme mlle m st vs cf e g i approx incl vol pp p no nr fig figs cat lot lab ref sect wks vgl abb ca bzw z b d h s abt tel evtl ggf usw inkl "
    "núm n.º aprox máx mín ej pág ee uu sr sra dra env réf c.-à-d ex av т д е г рис см лимф стр др проф д-р सं डॉ นพ พญ د أ ext jr sr mt ft ave blvd rd".split()
)


_NOT_WORD = regex.compile(r"[\W_]+")
_IS_RUN, _IS_LOOSE = regex.compile(rf"[{_RUN}]").match, regex.compile(rf"[{_LOOSE}]").match
_FIRST_RUN = "\u0e00"  #: no script written without spaces lies below


def _loose(ch: str) -> bool:
    """Whether a character is of a script that sets spaces between phrases only."""
    return ch >= _FIRST_RUN and _IS_LOOSE(ch) is not None


def _edge(word: str, left: bool) -> str:
    """A word as context: digits as one sign, runs of unspaced scripts by their nearer end."""
    if word[0].isdigit():
        return "#"
    ch = word[-1] if left else word[0]
    if ch >= _FIRST_RUN and _IS_RUN(ch):
        n = 3 if _IS_LOOSE(ch) else 2
        return word[-2 * n :] if left else word[: 2 * n] if n == 3 else word[:n]
    return "@" if not word.isalpha() and any(ch.isdigit() for ch in word) else word


def shape(word: str) -> str:
    """What is left of a rare word."""
    ch = word[0]
    return "Xx" if ch.isupper() else "xx" if ch.islower() else "oo" if ch.isalpha() else ".."


def _last_word(left: str) -> Any:
    """The match of the last word or sign; it holds no white space, so what stands before any is not searched."""
    at = len(left) - 1
    while at > 0 and not left[at - 1].isspace():
        at -= 1
    return _LEFT.search(left, max(0, at))


def candidates(text: str) -> Iterator[tuple[int, str, str, str, bool]]:
    """(offset of what follows, word before, kind of gap, word after, forced) of each possible boundary."""
    quoted = [m.span() for m in _QUOTED.finditer(text)]
    qi = 0
    for m in _BREAK.finditer(text):
        a, at = m.span()
        if at >= len(text) or a == 0:
            continue
        while qi < len(quoted) and quoted[qi][1] <= a:
            qi += 1
        if qi < len(quoted) and quoted[qi][0] < at and at < quoted[qi][1] and quoted[qi][0] < a + (a == at):
            continue
        nxt = text[at]
        if nxt in "!?:;.,…»”)]』」。！？｡؟।%‰°" or _MARKED.search(text, max(0, a - 8), a):
            continue  # goes on the unit before, or a list mark's text
        left = text[max(0, a - 60) : a]
        if nxt in "([" and not (left[-1] in _END_SIGNS and _ENDS.search(left)):
            continue
        quote = ""
        t = _TAIL.search(left) if left[-1] in _CLOSE_SIGNS else None
        if t:
            left = left[: t.start()]
            quote = "”" if t.group(1).strip(" )]'’") else ")"
        e = _ENDS.search(left) if left and left[-1] in _END_SIGNS else None
        end = ""
        if e:
            marks = e.group(1).replace(" ", "")
            left = left[: e.start()]
            end = "c" if marks[-1] in "。！？｡" else "d" if marks[-1] in "।॥؟۔" else "..." if marks.startswith(("...", "…")) else "!" if "!" in marks or "?" in marks else "."
        w = _last_word(left)
        before = _edge(w.group(1), True) if w else ""
        if before == "#":  # a number by itself says little
            w2 = _last_word(left[: w.start()].rstrip(" ."))
            before = f"{_edge(w2.group(1), True).lower()} #" if w2 else "#"
        if not end and not quote and w and not _CONTENT.search(w.group(1)):
            end = ","
        space = text[a:at]
        listed = "\n" in space and _LIST.match(text, at)
        kind = "b" if listed else "n" if "\n" in space else "S" if len(space) > 1 else "s" if space else "0"
        r = _RIGHT.search(text, listed.end() if listed else at)
        word = r.group() if r else nxt
        if nxt in "„«“\"「『¿¡":
            cls = "q"
        else:
            ch = text[at]
            cls = "U" if ch.isupper() else "l" if ch.islower() else "d" if ch.isdigit() else "o" if ch.isalpha() else "p"
            if cls == "d" and _NUMBERED.match(text, at):
                cls = "D"  # a number with a word after it
        after = _edge(word, False)
        if after == "#":
            following = _NUMBERED.match(text, r.start() if r else at)
            after = f"# {following.group(1)}" if following else "#"
        yield at, before, f"{end}|{kind}|{cls}|{quote}", after, bool(listed)


def inner_pairs(text: str) -> Iterator[tuple[str, str]]:
    """Pairs of words with nothing but one blank between them: these lie within a unit."""
    last, end = "", -9
    for m in _WORD.finditer(text):
        word, at = m.group(), m.start()
        if word.isascii() and word.isalpha():  # the same from both sides
            before = after = word
        else:
            before, after = _edge(word, True), _edge(word, False)
        if at == end + 1 and text[end] == " ":
            yield last, after
        last, end = before, m.end()


def style(text: str) -> str:
    """'list' if every line but a title opens with a list mark, 'lines' if there are several lines and none has
    an end mark: in both each line is a unit, and these texts teach the model. Else ''."""
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    if len(lines) < 2:
        return ""
    marked = [bool(_LIST.match(x)) for x in lines]
    if len(lines) > 2 and all(marked[1:]) or all(marked):
        return "list"
    if not any(x[-1] in ".!?…。！？｡؟।" for x in lines):
        return "lines"
    return ""


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        seen: Counter[tuple[str, str, str, int]] = Counter()
        pairs: Counter[tuple[str, str]] = Counter()
        for text in b["text"]:
            how = style(text)
            for _, before, gap, after, _forced in candidates(text):
                space = gap.split("|")[1]
                sure = -1 if not how else int(space in ("b", "n"))
                seen[before, gap, after, sure] += 1
            pairs.update(p for p in inner_pairs(text) if not _loose(p[1][0]) and not _loose(p[0][-1]))
        rows = [(*k, n) for k, n in seen.items()] + [(x, "", y, 0, n) for (x, y), n in pairs.items()]
        yield pd.DataFrame(rows, columns=["before", "gap", "after", "sure", "n"])


def first_guess(before: str, gap: str) -> float:
    """Chance of a boundary before anything is learned."""
    end, space, cls, quote = gap.split("|")
    if space == "b":
        return 0.97
    if end in ("c", "d"):
        return 0.25 if quote else 0.97
    if cls == "l":
        return 0.03 if end != "!" else 0.1
    if end == "!":
        return 0.93
    if end == "...":
        return 0.7
    if end == ".":
        short = before.lower() in SHORTENED or len(before) == 1 and before.isalpha() or "." in before
        return 0.12 if short else 0.8 if cls in ("d", "D") else 0.93
    if end == ",":
        return 0.03
    if space == "n":
        return {"U": 0.5, "q": 0.5, "o": 0.5, "d": 0.2}.get(cls, 0.1)
    return 0.3 if cls == "o" else 0.08


TITLES = {"dr", "prof", "mr", "mrs", "ms", "dra", "sra", "sr", "นพ", "พญ"}  #: these end no unit


class Model:
    """Hidden-event bigram model, estimated from counted contexts (before, gap, after, sure, n): sure is 1 or 0
    where the text's lines show whether there is a boundary, -1 where it is hidden. The words of the contexts that
    are not among the known ``words`` are shapes already."""

    def __init__(self, rows: list[tuple[str, str, str, int, float]], words: set[str]):
        self.words = words
        self.fit(rows, [None if s < 0 else float(s) for _, _, _, s, _ in rows])
        for _ in range(ROUNDS):
            post = [float(s) if s >= 0 else 1 / (1 + math.exp(-self.odds(b, g, a))) for b, g, a, s, _ in rows]
            self.fit(rows, post)

    def word(self, w: str) -> str:
        return w if w in self.words or not w else shape(w)

    def fit(self, rows: list[tuple[str, str, str, int, float]], post: list[float | None]) -> None:
        """One maximisation step; hidden events count less than sure ones, and undecided ones only for the gap."""
        self.gap: dict[str, tuple[float, float]] = {}
        self.yes: dict[str, float] = defaultdict(float)
        self.no: dict[str, float] = defaultdict(float)
        self.opens: dict[str, float] = defaultdict(float)
        self.inner: dict[str, float] = defaultdict(float)
        self.pair: dict[tuple[str, str], float] = defaultdict(float)
        self.head: dict[str, float] = defaultdict(float)
        self.across: dict[tuple[str, str], float] = defaultdict(float)
        for (b, g, a, sure, n), p in zip(rows, post):
            if p is None:
                continue
            if sure < 0:
                y, z = self.gap.get(g, (0.0, 0.0))
                self.gap[g] = (y + n * p, z + n)
                if 0.02 < p < 0.9:
                    continue
                n *= HIDDEN
            if p >= 0.5:
                self.yes[b] += n
                self.opens[a] += n
                self.across[b, a] += n
            else:
                if g:
                    self.no[b] += n
                self.inner[a] += n
                self.pair[b, a] += n
                self.head[b] += n
        self.n_yes, self.n_no = sum(self.yes.values()) + 1, sum(self.no.values()) + 1
        self.n_inner = sum(self.inner.values()) + 1

    def words_odds(self, b: str, gap: str, a: str) -> float:
        """Log-odds of a boundary from the two words alone."""
        v = len(self.words) + 10
        opens = (self.opens.get(a, 0.0) + 0.3) / (self.n_yes + 0.3 * v)
        yes = self.yes.get(b, 0.0)
        known = 0.5 * yes / (yes + 5)  #: of what follows this word across a boundary
        opens = (1 - known) * opens + known * self.across.get((b, a), 0.0) / max(yes, 1.0)
        back = (self.inner.get(a, 0.0) + 0.3) / (self.n_inner + 0.3 * v)
        head = self.head.get(b, 0.0)
        trust = 0.7 * head / (head + 3)  #: in the pairs of this word, against words alone
        inside = trust * max(0.0, self.pair.get((b, a), 0.0) - 1) / max(head, 1.0) + (1 - trust) * back
        ends = (self.yes.get(b, 0.0) + 0.3) / (self.n_yes + 0.3 * v)
        stays = (self.no.get(b, 0.0) + 0.3) / (self.n_no + 0.3 * v)
        return max(-7.0, min(7.0, math.log(opens / inside))) + max(-4.0, min(4.0, math.log(ends / stays)))

    def gap_odds(self, b: str, gap: str) -> float:
        p0 = first_guess(b, gap)
        y, z = self.gap.get(gap, (0.0, 0.0))
        p = min(0.995, max(0.005, (y + 20 * p0) / (z + 20)))
        return math.log(p / (1 - p))

    def odds(self, b: str, gap: str, a: str) -> float:
        if gap.startswith(",") and b != ":":  # nothing ends with a comma or an opening sign
            return -6.0
        if gap.startswith(".|") and len(b) == 1 and b.isupper() and a == "Xx":  # an initial before a rare name
            return -4.0
        if gap.startswith(".|") and b.lower() in TITLES:
            return min(-3.0, self.gap_odds(b, gap) + self.words_odds(b, gap, a))
        bare = 0.5 if gap.startswith("|s|") else 0.0  # a blank alone needs words that speak for a boundary
        return self.gap_odds(b, gap) + self.words_odds(b, gap, a) - bare


#: The habits of lines: chance of a boundary at a line break without end mark, and the habit's own chance.
HABITS = ((0.97, 0.4), (0.05, 0.5), (0.5, 0.1))


def posteriors(text: str, model: Model, cands: list[tuple[int, str, str, str, bool]]) -> list[float]:
    """Forward-backward posteriors of the candidates' boundaries."""
    logit, lines = [], []
    for i, (_, b, g, a, forced) in enumerate(cands):
        b, a = model.word(b), model.word(a)
        if forced:
            logit.append(6.0)
        elif g.startswith("|n|"):  # its chance comes from the lines' habit
            logit.append(model.words_odds(b, g, a) - (2.0 if "|l|" in g else 0.0) - (3.0 if g.endswith("|l|)") else 0.0))
            lines.append(i)
        else:
            logit.append(model.odds(b, g, a))
    if lines:
        weights = []
        for q, prior in HABITS:
            like = math.log(prior)
            for i in lines:
                x = max(-30.0, min(30.0, logit[i]))
                like += math.log(q * math.exp(x / 2) + (1 - q) * math.exp(-x / 2))
            weights.append(like)
        top = max(weights)
        weights = [math.exp(w - top) for w in weights]
        q = sum(w * h[0] for w, h in zip(weights, HABITS)) / sum(weights)
        for i in lines:
            logit[i] += math.log(q / (1 - q))
    n = len(cands)
    start = len(text) - len(text.lstrip())
    empty = []
    for i, c in enumerate(cands):
        since = text[cands[i - 1][0] if i else start : c[0]].strip()
        empty.append(bool(_ENUM.fullmatch(since)) or not any(ch.isalnum() for ch in since))
    fw, bw = [(1.0, 1.0)] * n, [(1.0, 1.0)] * n
    on = [1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) for x in logit]
    prev = (0.0, 1.0)  # the text's start is a boundary
    for i in range(n):
        join = 0.002 if empty[i] else 1.0
        f0 = (prev[0] + prev[1]) * (1 - on[i])
        f1 = (prev[0] + prev[1] * join) * on[i]
        s = f0 + f1 or 1.0
        fw[i] = prev = (f0 / s, f1 / s)
    nxt = (1.0, 1.0)
    for i in range(n - 1, -1, -1):
        bw[i] = nxt
        join = 0.002 if empty[i] else 1.0
        b0 = nxt[0] * (1 - on[i]) + nxt[1] * on[i]
        b1 = nxt[0] * (1 - on[i]) + nxt[1] * on[i] * join
        s = b0 + b1 or 1.0
        nxt = (b0 / s, b1 / s)
    return [f[1] * b[1] / (f[0] * b[0] + f[1] * b[1] or 1.0) for f, b in zip(fw, bw)]


def plain(s: str) -> str:
    return _NOT_WORD.sub("", s.lower())


def starts(text: str, title: str | None, model: Model) -> list[int]:
    """Offsets of the first characters of the text's units."""
    first = len(text) - len(text.lstrip())
    if first == len(text):
        return []
    cands = list(candidates(text))
    head = plain(title) if isinstance(title, str) else ""
    out = [first]
    for (at, *_), p in zip(cands, posteriors(text, model, cands)):
        alone = head and "\n" in text[first:at] and plain(text[first:at]) == head
        if (p > 0.5 or alone) and at > out[-1]:
            out.append(at)
    return out


def _forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.assign(form=[w if n >= RARE or not w else shape(w) for w, n in zip(b["word"], b["n"])])


def learn(texts: DataFrame) -> Model:
    """The model of all texts (column text), from all their contexts. Rare words become shapes before the contexts
    are collected, so only those of known words grow with the texts."""
    seen = texts.select("text").mapInPandas(_count, "before string, gap string, after string, sure int, n long")
    seen = cut(seen.groupBy("before", "gap", "after", "sure").agg(F.sum("n").alias("n")))
    words = seen.select(F.explode(F.array("before", "after")).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
    forms = cut(words.mapInPandas(_forms, "word string, n long, form string"))
    form = lambda c: forms.select(F.col("word").alias(c), F.col("form").alias(f"{c}_form"))
    merged = seen.join(form("before"), "before").join(form("after"), "after").groupBy("before_form", "gap", "after_form", "sure").agg(F.sum("n").alias("n"))
    merged = merged.orderBy(F.desc("n"), "before_form", "gap", "after_form", "sure")
    known = {r.word for r in forms.where(f"n >= {RARE}").select("word").toLocalIterator()}
    return Model([(r.before_form, r.gap, r.after_form, r.sure, float(r.n)) for r in merged.toLocalIterator()], known)


def _splitter(model: Model) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple[Any, ...]] = []
            for i, title, text in zip(b["id"], b["title"], b["text"]):
                at = starts(text, title, model)
                rows += [(i, k, s, text[s:e].rstrip()) for k, (s, e) in enumerate(zip(at, [*at[1:], len(text)]))]
            if rows:
                yield pd.DataFrame(rows, columns=["id", "unit_index", "start_char", "unit"])

    return run


def units(df: DataFrame, id_col: str, text_col: str, title_col: str | None = None) -> DataFrame:
    """(id, unit_index, start_char, unit): the sentence units of every text in order."""
    title = F.col(title_col) if title_col else F.lit(None).cast("string")
    rows = df.select(F.col(id_col).cast("long").alias("id"), title.alias("title"), F.col(text_col).alias("text")).where(F.col("text").rlike(r"(?U)\S"))
    # a stated number of partitions keeps all cores busy where little text takes much work; the rows that are
    # equal lie together, so removing repeats needs no further exchange
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = cut(rows.repartition(n, "id").distinct())  # read twice: to learn and to split
    model = learn(rows)
    return rows.mapInPandas(_splitter(model), "id long, unit_index int, start_char int, unit string")


def found(sections: DataFrame) -> DataFrame:
    """(section_id, start_char) of every unit of the sections' texts."""
    return units(sections, "section_id", "text", "section_title").select(F.col("id").alias("section_id"), "start_char").distinct()
