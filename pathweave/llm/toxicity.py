"""Scores for abusive, hateful and sexually explicit language.

Method. A noisy-channel model restores disguised words: spelled-out letters are joined, look-alike letters of
another script inside a word are made equal, and every token that mixes letters with look-alike signs, masks or
repeated letters becomes a lattice of the letters each sign may stand for; the Viterbi path under a character model
of the corpus' words (counted over all documents, the lexicon's words added) is taken if it is a known word. The
restored text is then scored: phrases have weights, and the score is that of the heaviest run of words, so it
doesn't depend on how much other text there is.

The weights start from a small general lexicon, a weak prior in which hardly any word is enough by itself. The
judged documents raise the phrases that stand in abusive documents far more often than chance allows, lower the
lexicon's phrases that people let pass, and take back a word of the lexicon inside phrases that they let pass.
Self-training then counts, over all documents, in which share of the documents that hold a phrase it stands in a
sentence already found abusive, and learns the phrases that hardly occur elsewhere; this is done ROUNDS times.

The classifier is fitted on at most LABELS judged documents (chosen by hash of the id if there are more);
character statistics and self-training cover all documents. Thresholds are shares of the data, so the model stays
bounded while the data grow.

Defined results
  * Null and empty texts have score 0. Several judgements of a document count as their mean; null judgements and
    judgements of unknown documents are ignored; without judgements lexicon and self-training decide.
  * Every distinct doc_id has one row, with the highest score of its rows. A null source is reported as such.
  * Extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

LABELS = 200_000
FLAG = 2.0  #: score from which a document counts as abusive
SUSPECT = 1.4  #: score from which self-training learns from a sentence: more than one word must speak for it
STEP = -0.04  #: weight of a character between two phrases that have one
ROUNDS = 2  #: of self-training
LEAST = 3  #: documents from which a phrase can be learned
LEAST_SHARE = 2e-4  #: of the abusive documents that must hold it besides, so at most some 300,000 phrases are learned
WORD_SHARE = 2e-6  #: of all words that a word must make up to be restored: at most 500,000 words
MANY = 30  #: documents of a phrase from which numbers make no difference to its chance
#: Share of the phrases learned from judgements that may be there by chance, with and without a word of the lexicon.
FALSE = {True: 0.05, False: 0.01}
PURE = 0.8  #: share of a phrase's documents that must be abusive

Weights = dict[str, float]

#: A general lexicon: words and phrases by weight. From FLAG a phrase is enough by itself, as it has no other sense;
#: lesser ones need company.
LEXICON: dict[float, str] = {
    2.0: """fuck|fucking|motherfucker|cunt|whore|slut|faggot|nigger|dickhead|asshole|dumbass|scumbag|shithead|wanker|idiot|moron|imbecile|subhuman|kill yourself|go to hell|piece of shit|
arschloch|hurensohn|wichser|schlampe|drecksau|missgeburt|vollidiot|abschaum|gesindel|idiota|imbécil|hijo de puta|gilipollas|cabrón|muérete|salope|connard|enculé|
идиот|дебил|сука|мудак|ублюдок|мразь|сдохни|заткнись|傻逼|贱人|混蛋|蠢货|废物|去死|死ね|병신|꺼져""",
    1.6: """bitch|scum|shit|shut up|shut your mouth|trottel|fresse|verreck|krepier|mierda|cállate|puta|imbécile|merde|gueule|crétin|crève|урод|сдох|不要脸""",
    1.2: """bastard|retard|clown|filth|trash|vermin|stupid|pathetic|worthless|disgusting|loser|puke|drop dead|
versager|dreck|basura|zorra|vermine|ordure|скотина|тварь|垃圾|滚|バカ|クズ""",
    0.9: """plague|animals|rats|pigs|pig|cow|ugly|naked|nude|undress|horny|lick|suck|touch myself|your body|throat|whipped|beaten|choke|drown|drowned|slit|strangle|rape|burn|kill|killed|hate|
nackt|desnuda|déshabiller|nue|голая|ratas|plaga|грязь|тупая|裸""",
    0.7: """immigrants|foreigners|refugees|gays|muslims|jews|disabled people|old people|ausländer|flüchtlinge|inmigrantes|extranjeros|immigrés|réfugiés|étrangers|приезжие|мигранты|移民|外地人""",
    0.5: """you|your|yourself|du|dich|eres|te|tu|ты|тебя|你|お前|women|men|people|breasts|haha|lol""",
}

#: What a sign may stand for inside a word.
SIGNS = {
    "@": "aáàäа", "4": "aáàäч", "8": "bв", "3": "eéèêз", "€": "eé", "6": "gб", "9": "g", "1": "ilí", "!": "ilí", "|": "il", "0": "oóöо", "5": "s", "$": "s", "7": "t", "+": "t", "2": "z",
}
#: Cyrillic and Greek letters that look like Latin ones.
ALIKE = str.maketrans("аеорсухкміѕјԁοανε", "aeopcyxkmisjdoave")

_SIGN = r"@$*!+|€"
_IDEOGRAPH = re.compile(r"([぀-ヿ㐀-鿿가-힯])")
_TOKEN = re.compile(r"[.!?…。！？；;।\n]+|[^\W\d_]+(?:['’][^\W\d_]+)?|\d+(?:[.,:/x×-]\d+)*")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_MIXED = re.compile(r"\w*(?:[a-zß-ž][а-яіѕјԁα-ω]|[а-яіѕјԁα-ω][a-zß-ž])\w*")
_OTHER = re.compile("[Ͱ-ϿЀ-ԯ]")
_DISGUISED = re.compile(rf"(?<![\w{_SIGN}])(?=[\w{_SIGN}]*[^\W\d_])(?=[\w{_SIGN}]*(?:[{_SIGN}\d]|([^\W\d_])\1\1))[\w{_SIGN}]{{3,}}(?![@$*+|])")
_ODD = re.compile(rf"[^\W\d_][{_SIGN}\d]|[{_SIGN}\d][^\W\d_]|([^\W\d_])\1\1")
_SPELLED = re.compile(r"(?<!\S)(?:[^\W\d_]([ .\-_])\1{0,3}){3,}[^\W\d_](?![^\s.,;:!?])")


def fold(text: str) -> str:
    """Lower case without invisible characters; look-alike letters of another script inside a word are Latin."""
    if text.isascii():
        return text.lower()
    t = _INVISIBLE.sub("", text if unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)).lower()
    return _MIXED.sub(lambda m: m.group().translate(ALIKE), t) if _OTHER.search(t) else t


class Channel:
    """Character model with back-off over four letters, and the lattice decoder."""

    def __init__(self, counted: Iterable[tuple[str, float]], hidden: Iterable[str]):
        self.known: dict[str, float] = {}
        self.after: dict[str, set[str]] = defaultdict(set)  #: letters that go on a beginning of known words
        self.n: list[dict[str, float]] = [defaultdict(float) for _ in range(5)]
        for w, c in counted:
            self.known[w] = c
            s = f"^{w}$"
            for i in range(len(w)):
                self.after[w[:i]].add(w[i])
            for k in range(1, 5):
                for i in range(len(s) - k + 1):
                    self.n[k][s[i : i + k]] += c
        self.n[0][""] = sum(self.n[1].values()) or 1.0
        self.n = [dict(x) for x in self.n]
        self.hidden = set(hidden)  #: words that people disguise
        self.cache: dict[str, str] = {}

    def cost(self, past: str, ch: str) -> float:
        """-log of the back-off probability of ``ch`` after ``past``."""
        off = 0.0
        for k in range(min(3, len(past)), -1, -1):
            h = past[len(past) - k :]
            c = self.n[k + 1].get(h + ch)
            if c:
                return off - math.log(c / self.n[k].get(h, c))
            off += 0.9
        return off + 8.0

    def decode(self, token: str) -> str:
        """The most likely known word behind a disguised token, else the token itself."""
        if len(self.cache) > 100_000:
            self.cache.clear()
        if token not in self.cache:
            self.cache[token] = self._decode(token)
        return self.cache[token]

    def _decode(self, token: str) -> str:
        if token in self.known:
            return token
        lattice: list[list[tuple[str, float]] | None] = []  # None: any letter
        i, sure = 0, False
        while i < len(token):
            ch, j = token[i], i
            while j < len(token) and token[j] == ch:
                j += 1
            if ch == "*":
                lattice += [None] * (j - i)
            else:
                signs = SIGNS.get(ch, "")
                opts = [(x, 0.1) for x in signs] or [(ch, 0.0)]
                sure |= not signs
                lattice += [opts] * (j - i if j - i < 3 else 1)
                if j - i >= 3:  # drawn-out: once or twice
                    lattice.append([("", 0.0), *((x, c + 0.5) for x, c in opts)])
            i = j
        if not sure:
            return token
        # Viterbi over the lattice; paths that begin no known word are closed at once.
        states: dict[str, float] = {"": 0.0}
        for s in lattice:
            new: dict[str, float] = {}
            for out, c in states.items():
                go = self.after.get(out, ())
                for x, extra in ((x, 0.3) for x in go) if s is None else s:
                    if not x or x in go:
                        to = out + x
                        cc = c + extra + (self.cost(("^" + out)[-3:], x) if x else 0.0)
                        if cc < new.get(to, math.inf):
                            new[to] = cc
            states = new
            if not states:
                return token
        hide = 4.0 if "*" in token else 2.0  # abuse is disguised more often than other words
        ends = [(c + self.cost(("^" + out)[-3:], "$") - (hide if out in self.hidden else 0.0), out) for out, c in states.items() if out in self.known]
        return min(ends)[1] if ends else token


def _joined(spelled: str, channel: Channel) -> str:
    """A spelled-out word; a first letter that leaves a known word behind is a word of its own."""
    w = re.sub(r"[ .\-_]", "", spelled)
    return f"{w[0]} {w[1:]}" if w not in channel.known and w[1:] in channel.known else w


def restore(text: str, channel: Channel) -> str:
    """The text in lower case with disguised words restored."""
    t = fold(text)
    t = _SPELLED.sub(lambda m: " ".join(_joined(w, channel) for w in re.split(r" {2,}", m.group())), t)
    if not _ODD.search(t):
        return t

    def one(m: re.Match[str]) -> str:
        w = m.group()
        core = w.rstrip("!")
        return channel.decode(core) + w[len(core) :]

    return _DISGUISED.sub(one, t)


def line(text: str) -> str:
    """The words of a restored text, each between blanks: ideographs and kana one by one, numbers as 0, a
    sentence's end as |."""
    t = text if text.isascii() else _IDEOGRAPH.sub(r" \1 ", text)
    ws = [w if w[0].isalpha() else "0" if w[0].isdigit() else "|" for w in _TOKEN.findall(t)]
    return f" {' '.join(ws)} " if ws else ""


def lexicon_weights(lexicon: dict[float, str] | None = None) -> Weights:
    """The lexicon as phrases in the form of line()."""
    given = LEXICON if lexicon is None else lexicon
    return {x: w for w, ps in given.items() for p in ps.replace("\n", "").split("|") if (x := line(fold(p)).strip())}


def phrases(s: str, most: int = 4) -> set[str]:
    """All phrases of up to ``most`` words that no sentence's end divides; of ideographs up to six."""
    out: set[str] = set()
    for part in s.split("|"):
        ws = part.split()
        for i in range(len(ws)):
            top = 6 if len(ws[i]) == 1 and _IDEOGRAPH.match(ws[i]) else most
            for k in range(i + 1, min(len(ws), i + top) + 1):
                out.add(" ".join(ws[i:k]))
    return out


class Scorer:
    """Finds the heaviest run of words of a line."""

    def __init__(self, weights: Weights):
        self.auto = ahocorasick.Automaton()
        for p, w in weights.items():
            self.auto.add_word(f" {p} ", (w, len(p)))
        self.any = bool(weights)
        if self.any:
            self.auto.make_automaton()

    def heaviest(self, s: str) -> tuple[float, int, int]:
        """(score, start, end) of the heaviest run. A phrase weighs where it ends; of the phrases that end at one
        place the heaviest and the lightest below 0 count."""
        best = (0.0, 0, 0)
        if not self.any or not s:
            return best
        at: dict[int, tuple[float, float, int]] = {}
        for e, (w, n) in self.auto.iter(s):
            up, down, far = at.get(e, (0.0, 0.0, 0))
            at[e] = (max(up, w), min(down, w), max(far, n))
        run, begin, last = 0.0, 0, 0
        for e in sorted(at):
            up, down, n = at[e]
            run += STEP * max(0, e - n - last) if last else 0.0
            if run <= 0:
                run, begin = 0.0, e - n
            run += up + down
            last = e
            if run > best[0]:
                best = (run, begin, e)
        return best

    def suspected(self, s: str) -> list[str]:
        """The sentences of a line that score SUSPECT; if only several together do, those that its heaviest run
        touches."""
        score, a, e = self.heaviest(s)
        if score < SUSPECT:
            return []
        found = [x for x in s.split("|") if self.heaviest(x)[0] >= SUSPECT]
        right = s.find("|", e)
        return found or [s[s.rfind("|", 0, a + 1) + 1 : right if right >= 0 else len(s)]]


def _line_of(words: list[tuple[str, float]], hidden: list[str], decode: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        channel = Channel(words, hidden)
        for b in batches:
            b["line"] = [(line(restore(t, channel) if decode else fold(t)) if isinstance(t, str) and t else "") for t in b["text"]]
            yield b[["doc_id", "source", "line"]]

    return run


def _scored(weights: Weights) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(weights)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "score": [scorer.heaviest(s)[0] for s in b["line"]]})

    return run


def _judged_phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(phrase, a, b, e): judged documents that hold it, abusive and other, and how many chance makes abusive."""
    for b in batches:
        pos, neg, by_chance = Counter(), Counter(), defaultdict(float)
        for s, p, rate in zip(b["line"], b["p"], b["rate"]):
            here = phrases(s)
            (pos if p > 0.5 else neg).update(here)
            for x in here:
                by_chance[x] += rate
        keys = list(by_chance)
        yield pd.DataFrame({"phrase": keys, "a": [pos[k] for k in keys], "b": [neg[k] for k in keys], "e": [by_chance[k] for k in keys]})


def _found_phrases(weights: Weights) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """(phrase, a): documents with the phrase in a sentence found abusive; the number of such documents under ''."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(weights)
        for b in batches:
            seen: Counter[str] = Counter()
            for s in b["line"]:
                if bad := scorer.suspected(s):
                    seen.update(phrases("|".join(bad)))
                    seen[""] += 1
            yield pd.DataFrame({"phrase": list(seen), "a": list(seen.values())}, columns=["phrase", "a"]).astype({"phrase": "object"})

    return run


def _holding(wanted: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """(phrase, n): documents that hold each of the wanted phrases."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        auto = ahocorasick.Automaton()
        for p in wanted:
            auto.add_word(f" {p} ", p)
        auto.make_automaton()
        seen: Counter[str] = Counter()
        for b in batches:
            for s in b["line"]:
                seen.update({p for _, p in auto.iter(s)})
        yield pd.DataFrame({"phrase": list(seen), "n": list(seen.values())}, columns=["phrase", "n"]).astype({"phrase": "object"})

    return run


def surprise(a: float, n: float, base: float) -> float:
    """Bound of -log of the chance that ``a`` of ``n`` documents are abusive if ``base`` of all are."""
    q = a / n
    return n * ((q * math.log(q / base) if q else 0.0) + ((1 - q) * math.log((1 - q) / (1 - base)) if q < 1 else 0.0)) if q > base else 0.0


def lift(phrase: str, a: float, n: float, base: float) -> float:
    """Weight of a learned phrase; less than FLAG, so that more than one must meet."""
    return min(0.9 if " " not in phrase else 1.6, 0.5 * math.log((a - 0.5) / n / base))


def from_judgements(lines: DataFrame, labels: DataFrame, weights: Weights) -> Weights:
    """The weights after the judged documents: phrases found in abusive documents more often than chance
    makes as many phrases of that frequency (at most a share FALSE of them may be there by chance) are raised, the lexicon's phrases that people let
    pass lowered, and phrases they let pass though a word of the lexicon stands in them weigh against it."""
    judged = labels.where("toxic is not null").groupBy("doc_id").agg(F.avg("toxic").alias("p")).orderBy(F.xxhash64("doc_id")).limit(LABELS)
    judged = cut(lines.join(F.broadcast(judged), "doc_id").select("source", "p", "line"))
    bad = (F.col("p") > 0.5).cast("int")
    size = judged.agg(F.sum(bad).alias("a"), F.count(F.lit(1)).alias("n")).first()
    if not size or not size.n or size.a < 5 or size.n - size.a < 5:
        return weights
    # what chance makes of a phrase depends on the sources it stands in
    rate = judged.groupBy("source").agg(((F.sum(bad) + 5 * size.a / size.n) / (F.count(F.lit(1)) + 5)).alias("rate")).withColumnRenamed("source", "of")
    judged = judged.join(rate, F.col("source").eqNullSafe(F.col("of")))
    counts = judged.select("p", "rate", "line").mapInPandas(_judged_phrases, "phrase string, a long, b long, e double")
    counts = cut(counts.groupBy("phrase").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("e").alias("e")).where("a + b >= 2"))
    base = size.a / size.n
    prior = list(weights)
    strong = {p for p, w in weights.items() if w >= 0.9}
    known = counts.where(F.col("phrase").isin(prior)) if prior else counts.limit(0)
    # phrases with a word of the lexicon are tried apart from the rest: more of them are abusive
    hint = sorted({p for p in prior if " " not in p}) or [""]
    counts = counts.withColumns({"n": F.col("a") + F.col("b"), "hinted": F.arrays_overlap(F.split("phrase", " "), F.lit(hint))})
    pure = F.col("a") >= PURE * F.col("n")
    q, own = F.ceil(PURE * F.col("n")) / F.col("n"), F.least(F.col("e") / F.col("n"), F.lit(0.99 * PURE))
    chance = F.exp(-F.col("n") * F.when(q >= 1, -F.log(own)).otherwise(q * F.log(q / own) + (1 - q) * F.log((1 - q) / (1 - own))))
    seen = counts.groupBy("hinted", F.least("n", F.lit(MANY)).alias("n")).agg(F.sum(chance).alias("by_chance"), F.sum(pure.cast("int")).alias("kept"))
    good = {(r.hinted, r.n) for r in seen.collect() if r.by_chance <= FALSE[r.hinted] * r.kept}
    out = dict(weights)
    for r in counts.where(pure & (F.col("a") >= LEAST_SHARE * size.a)).collect():
        if (r.hinted, min(r.n, MANY)) in good and not set(r.phrase) <= set("0 "):
            out[r.phrase] = max(out.get(r.phrase, 0.0), lift(r.phrase, r.a, r.n, base))
    for r in known.collect():
        if r.b >= 4 and r.a < 2 * base * (r.a + r.b):
            out[r.phrase] = min(out[r.phrase], 0.15)
    strong = sorted(p for p in strong if " " not in p and out[p] >= 0.9)
    if strong:
        inside = F.arrays_overlap(F.split("phrase", " "), F.lit(strong)) & F.col("phrase").contains(" ")
        for r in counts.where(inside & (F.col("a") < 2 * base * F.col("n")) & (F.col("b") >= LEAST)).collect():
            out.setdefault(r.phrase, -max(weights[w] for w in r.phrase.split() if w in strong))
    return out


def self_trained(lines: DataFrame, weights: Weights, total: int) -> Weights:
    """The weights joined with phrases that, over all documents, hardly stand outside sentences found abusive."""
    a = cut(lines.mapInPandas(_found_phrases(weights), "phrase string, a long").groupBy("phrase").agg(F.sum("a").alias("a")))
    first = a.where("phrase = ''").first()
    flagged = first.a if first else 0
    if flagged < LEAST:
        return weights
    held = {r.phrase: r.a for r in a.where(f"a >= greatest({LEAST}, {LEAST_SHARE} * {flagged}) and phrase <> ''").collect()}
    if not held:
        return weights
    base, tried = flagged / total, math.log(max(2, len(held)))
    out = dict(weights)
    for r in lines.mapInPandas(_holding(sorted(held)), "phrase string, n long").groupBy("phrase").agg(F.sum("n").alias("n")).collect():
        n = max(r.n, held[r.phrase])
        if held[r.phrase] >= PURE * n and r.phrase not in weights and surprise(held[r.phrase], n, base) >= tried and not set(r.phrase) <= set("0 "):
            out[r.phrase] = lift(r.phrase, held[r.phrase], n, base)
    return out


def corpus_words(docs: DataFrame, weights: Weights, least: int = 5) -> tuple[list[tuple[str, float]], list[str]]:
    """(words with counts, words that people disguise): the words of letters that occur at least ``least`` times
    and make up WORD_SHARE of all, over all documents, joined with those of the lexicon."""
    w = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![\p{L}\p{N}@$*!+|])[\p{IsLatin}\p{IsCyrillic}]{2,}(?![\p{L}\p{N}@$*+|])"), 0)).alias("w"))
    seen = cut(w.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {least}"))
    total = seen.agg(F.sum("n")).first()[0] or 0
    count = {r.w: float(r.n) for r in seen.where(f"n >= {WORD_SHARE * total}").collect() if not re.search(r"(.)\1\1", r.w)}
    hidden = sorted({x for p, weight in weights.items() if weight >= 0.9 for x in p.split() if len(x) > 2})
    for x in hidden:
        count[x] = max(count.get(x, 0.0), total / 200, 50.0)
    return sorted(count.items()), hidden


def scores(documents: DataFrame, labels: DataFrame, lexicon: dict[float, str] | None = None, decode: bool = True) -> DataFrame:
    """(doc_id, source, score) of every document. ``decode`` False leaves disguised words as they are."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text").where("doc_id is not null")
    weights = lexicon_weights(lexicon)
    words, hidden = corpus_words(docs.where("text <> ''"), weights)
    lines = cut(docs.mapInPandas(_line_of(words, hidden, decode), "doc_id long, source string, line string"))
    total = lines.count()
    weights = from_judgements(lines, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"), weights)
    for _ in range(ROUNDS):
        weights = self_trained(lines, weights, total)
    out = lines.mapInPandas(_scored(weights), "doc_id long, source string, score double")
    return out.groupBy("doc_id").agg(F.max(F.struct("score", "source")).alias("m")).select("doc_id", "m.source", "m.score")


def found(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id) of the abusive documents."""
    return scores(documents, labels).where(F.col("score") >= FLAG).select("doc_id")


def rates(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(source, documents, flagged, rate, mean_score)."""
    s = scores(documents, labels)
    flag = (F.col("score") >= FLAG).cast("int")
    return s.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(flag).alias("flagged"), F.round(F.avg(flag), 6).alias("rate"), F.round(F.avg("score"), 4).alias("mean_score"))
