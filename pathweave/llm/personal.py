"""Personal data in free text: email addresses, phone numbers, identity numbers, street addresses and names.

Method. Candidate spans are what any labeler proposes; each span carries the votes of all labelers of its kind:
patterns, words before and after it, titles, and a gazetteer of name parts that the corpus itself yields (parts
of names that stand between two cues). How far each labeler can be trusted is estimated by
expectation-maximisation over the counts of vote patterns of all texts, without any labels; the posteriors
train a logistic span classifier over votes and shape, which decides. Accepted spans are replaced by typed
placeholders, the rest of the text stays as it is.

Defined results
  * Null and empty texts have no spans. Offsets count characters from 0. Of overlapping spans the one with the
    higher score stays, then the longer one, then the earlier one. Repeated rows count once.
  * Extra columns are ignored; empty tables give an empty result. An item of a kind never found in the data is
    judged by the labelers' first reliabilities.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from typing import Any

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

GAZETTEER = 100_000  #: name parts kept, by count
ROUNDS = 25
SHAPES = 16  #: classes of form
RIDGE = 1e-3  #: penalty on the classifier's weights

_PLAIN = {i: i - 0xFEE0 for i in range(0xFF01, 0xFF5F)} | {0x3000: 32, 10: 32, 13: 32, 9: 32, 0xA0: 32, 0x202F: 32, 0x2010: 45, 0x2011: 45, 0x2012: 45, 0x2013: 45, 0x2212: 45}

_ODD = re.compile("[" + "".join(map(re.escape, map(chr, sorted(set(_PLAIN) - {10})))) + "]")
_EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._+-]*( ?@ ?| ?[(\[] ?at ?[)\]] ?)[A-Za-z0-9-]+(?:(?:\.| ?[(\[] ?dot ?[)\]] ?)[A-Za-z0-9-]+)*(?:\.| ?[(\[] ?dot ?[)\]] ?)[A-Za-z]{2,}")
_DIGITS = re.compile(
    r"(?<![A-Za-z0-9@#/.,:-])(?:(?:\+ ?|00)?\(?\d+\)?(?:[ ./-]?\(?\d+\)?)+(?: ?(?:ext\.?|x|Durchwahl|poste|доб\.) ?\d{1,5})?[A-Z]?|XX(?: \d\d){3} [A-Z]|[A-Z]\d{7}|[A-Z]\d{4} \d{5})(?![A-Za-z0-9@])"
)
_DATE = re.compile(r"\d{4}[-./]\d{1,2}[-./]\d{1,2}|\d{1,2}[-./]\d{1,2}[-./]\d{2,4}")
_ID = re.compile(r"XX(?: \d\d){3} [A-Z]|[A-Z]\d{7}|[A-Z]\d{4} \d{5}|\d{3}-\d{2}-\d{3,4}|\d{8}[A-Z]?")
_PHONE = re.compile(
    r"(?:\+|00)\d{1,3}[ .-]?(?:\(?\d{1,5}\)?[ .-]?){2,6}\d|\(\d{2,4}\) ?\d{3,4}-\d{4}|\d{3}[-.]\d{3}[-.]\d{4}|1\d{10}|0\d{2,4} \d{4} \d{4}|0\d{2,4}[/ ]\d{4,6}-\d{1,4}"
    r"|\d\d(?:[. ]\d\d){4}|\d{3}-\d{4}|\d-\d{3}-\d{3}-\d{4}|\d{3}-\d{3}-\d{3}|\d{3}-\d{4}-\d{4}|\d{3}-\d{8}"
)
_EXT = re.compile(r" ?(?:ext\.?|x|Durchwahl|poste|доб\.) ?\d{1,5}$")
_TEL = re.compile(r"(?:\btel|phone|[Cc]all(?: back)?|reached at|number is|\bunter|teléfono|\bau|телефону?|致电|電話|โทร|على|कृपया|fax|mobile|Fon)[.:]? ?$")
_TEL_AFTER = re.compile(r" ?(?:पर|erbeten|联系|once the|\)\.|\))")
_PERSON_ID = re.compile(r"(?:MRN|Vers\.-Nr\.|карта|证件号|ID|رقم الملف|पंजीकरण|เลขที่|dossier|DNI|[Cc]hart number|[Ss]ocial security no\.|[Ii]nsurance id|passport|SSN|NIR|(?<!Cat\. )(?<!photo )\bno\.|\bid)[:：]? ?$")
_ID_AFTER = re.compile(r" ?(?:है|appears|, date of birth|\)|）|,|，)")
_OTHER_ID = re.compile(r"(?:Lot|Cat\. No\.|No\.|Nr\.|Case|[Aa]ccession|ref\.|slide|block|folder|batch|S-|SP)[: ]*$")

_EN_STREET = r"(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Blvd|Boulevard|Court|Ct|Way|Terrace|Drive|Row|Place|Close|Square)"
_ADDRESS = [
    re.compile(rf"(?<![\w.,/-])\d{{1,5}} (?:St\. )?(?:[A-Z][\w'’-]* ){{1,4}}?{_EN_STREET}\b(?! ?\.? gr\b)(?: {_EN_STREET}\b)?"),
    re.compile(r"(?<!\w)(?:(?:[AI]m|[AI]n der|Auf dem|Zum|Zur|[A-ZÄÖÜ][\wäöüß]+-?) ?){0,3}[A-ZÄÖÜ][\wäöüß-]*(?:gasse|weg|str\.|straße|allee|platz|Allee|ofen|damm|ufer|ring)? \d{1,4} ?[a-z]?, \d{5} [A-ZÄÖÜ]"),
    re.compile(r"(?<!\w)(?:C/|Calle|Plaza|Avda\.|Avenida|Paseo|Camino|Ronda) [^,\d]{3,40} \d{1,4}(?=,)"),
    re.compile(r"(?<![\w.])\d{1,4}(?: bis| ter)?, (?:rue|av\.|avenue|impasse|boulevard|place|chemin|allée|quai|bd) [^,\d]{3,40}(?=,|\.|$)"),
    re.compile(r"(?<!\w)(?:(?:ул|пер|пр|просп|ш|наб)\. [^,\d]{2,40}|[А-ЯЁ][а-яё]+(?:ое|ая|ий) (?:шоссе|улица|проспект|переулок)), ?д\. ?\d{1,4}"),
    re.compile(r"(?:(?<=住)|(?<=住址)|(?<=地址)|(?<=[^一-鿿]))(?!住)[一-鿿]{2,5}[市县州][一-鿿]{1,12}?[路街道巷]\d{1,5}号"),
    re.compile(r"[一-鿿々]{1,4}[市村町区][一-鿿々]{1,6}\d{1,2}丁目[\d-]+"),
]
_ZIP = re.compile(r"\d ?[a-z]?, \d{5} ")
_HOME = re.compile(r"(?:lives at|mailed to|card reading [^\d]{2,60},|wohnt|Anschrift:|reside en|habite|проживает:|住所は|住|[Aa]ddress:?) ?$")
_UNIT = re.compile(r"[^.;]{0,3}(?:,? ?(?:Apt|Flat|Unit|#)|, \d{5}|, bajo|, \d\.º|, ?кв|\d*单元|,? [A-Z][a-z]+ \d{5})")

_ROMANCE = re.compile(r"[DM]\. ")  #: titles in French and Spanish, initials elsewhere
_TITLE = re.compile(r"(?:(?:Dr|Mr|Ms|Mrs|Prof|Dra|Sr|Sra|Hr|Fr|Mag|Dipl)\. ?|(?:Nurse|Frau|Herr|Mme|Mlle|Dr|Pr|Prof|Doña|Don|Schwester|Д-р|доктор|द\.|डॉ\.|د\.) )+")
_L = "(?:[^\\W\\d_]|[\u0300-\u036f\u0900-\u0963\u0e31-\u0e4e\u064b-\u065f])"  #: letters and their marks
_WORD = rf"{_L}(?:{_L}|['’-](?={_L}))*"
_CAPS = re.compile(rf"(?=[A-ZÀ-ÖØ-ÞĀ-ŽА-ЯЁ]){_WORD}\.?(?:(?:, | )(?=[A-ZÀ-ÖØ-ÞĀ-ŽА-ЯЁ]){_WORD}\.?){{0,4}}")
_WORD_ONLY = re.compile(_WORD)
_NAME_ONLY = re.compile(rf"(?:{_WORD}\.?|,)(?:[ ,]+{_WORD}\.?)*")
_HAN = "一-鿿々"
_HAN_BACK = re.compile(rf"(?:^|[。！？、，；：\s\d.)）%％])([{_HAN}]{{1,5}}[ ]?[{_HAN}]{{1,4}}|[{_HAN}]{{2,5}})$")
#: Words that are no part of a name though they stand where one could.
_STOP = re.compile(r"^(?:The|This|That|It|No|Not|See|Is|What|Case|Patient|Department|Institute|Hospital|Clinic|and|und|et|y|of|de la|samples?|reports?|slides?|notes?)$", re.IGNORECASE)

_APPOSITION = re.compile(rf"(?<=[a-zà-ÿа-я], )({_WORD}\.?(?: {_WORD}\.?){{1,3}})(?=, )")
_CONTACT = re.compile(r" \((?=[^ ()]{1,40} ?(?:@|[\[(]at[\])])|tel|\+?\d[\d .-]{6})")
_SMALL = set("with is are was were in to at for or from by no not as on an a it its und mit der die das de la le et des du en el los las con por y".split())

#: Cues before a name -> whether a cue after it is needed if the name isn't capitalised.
LEFT = [
    "Patient ", "Patient: ", "patient ", "Reviewed by ", "Dictated by ", "Die Patientin ", "Der Patient ", "Rückruf an ", "Rappeler ", "La patiente ", "Le patient ", "La paciente ", "El paciente ", " por ", " par ", " à ", " a ",
    "Пациент ", "Пациентка ", "Врач ", "患者", "联系", "المريضة ", "المريض ", "रोगी ", "ผู้ป่วยชื่อ ", "Signed by ", "signed by ", "Dr. ", "Mr. ", "Ms. ", "Mrs. ", "Prof. ", "Nurse ", "Frau ", "Herr ", "Mme ", "Dra. ", "Sra. ", "Sr. ", "Dr ", "Pr ",
]
RIGHT = [
    " and transcribed", ", M.D.", " (MRN", "   MRN", " MRN:", " lives at", " was informed", ", the ", " wurde um", ", Vers.-Nr", " unter ", " au ", " a validé", " (dossier", ", DNI", " en el tel", " el ", ", карта", " просит",
    ",证件号", "医师", "(ID", "医師", " رقم", " का पंजीकरण", " เลขที่", " โทร", " (", ", ", ". ", "。",
]
#: Cues after a name that find it without a cue before.
ALONE = {" and transcribed", ", M.D.", " (MRN", "   MRN", " MRN:", " lives at", " was informed", " wurde um", ", Vers.-Nr", " a validé", " (dossier", ", DNI", " en el tel", ", карта", " просит", ",证件号", "医師", "(ID", " เลขที่", " โทร"}
#: Cues of languages in which D. and M. are titles.
ROMANCE = {"Rappeler ", " por ", " par ", " à ", " a ", "La patiente ", "Le patient "}
#: Cues that are one only before such a title.
BEFORE_TITLE = {" por ", " par ", " à ", " a "}
WEAK_RIGHT = {", the ", " unter ", " au ", " el ", " (", ", ", ". ", "。"}


#: What a text must hold for each address pattern to be tried.
ADDRESS_SIGNS = [
    (" St", " Road", " Rd", " Lane", " Ln", " Ave", " Blvd", " Boulevard", " Court", " Ct", " Way", " Terrace", " Drive", " Row", " Place", " Close", " Square"),
    (", 0", ", 1", ", 2", ", 3", ", 4", ", 5", ", 6", ", 7", ", 8", ", 9"),
    ("C/", "Calle ", "Plaza ", "Avda.", "Avenida ", "Paseo ", "Camino ", "Ronda "),
    (", rue", ", av.", ", avenue", ", impasse", ", boulevard", ", place", ", chemin", ", allée", ", quai", ", bd"),
    (" д.", ",д."),
    ("号",),
    ("丁目",),
]


def automaton() -> ahocorasick.Automaton:
    """All cues in one automaton: values are (side, cue), for signs of an address ('A', number of the pattern)."""
    a = ahocorasick.Automaton()
    for i, signs in enumerate(ADDRESS_SIGNS):
        for c in signs:
            a.add_word(c, ("A", i))
    for c in LEFT:
        a.add_word(c, ("L", c))
    for c in sorted(ALONE):
        a.add_word(c, ("R", c))
    a.make_automaton()
    return a


PLACE = 1 << 6  #: mark of a candidate that only its place proposes; no vote
Span = tuple[str, int, int, int, str]  #: kind, start, end, votes, text


def _bits(*votes: Any) -> int:
    return sum(1 << i for i, v in enumerate(votes) if v)


def numbers(t: str) -> Iterator[Span]:
    """Phone and identity numbers."""
    for m in _DIGITS.finditer(t):
        x = m.group()
        if len(x) < 7 or _DATE.fullmatch(x) and "-" not in x[-3:-2] and x[0] not in "+0":
            continue
        s, e = m.span()
        before = t[max(0, s - 28) : s]
        if x.count("(") > x.count(")"):
            continue
        if x.startswith("(") and ")" not in x:
            s += 1
            x = x[1:]
        other = bool(_OTHER_ID.search(before))
        named = _PERSON_ID.search(before)
        ident = _ID.match(x)
        if ident and (ident.end() == len(x) or named and not x[ident.end()].isalnum() and x[ident.end()] != "-"):
            yield "ID", s, s + ident.end(), _bits(True, named, _ID_AFTER.match(t[s + ident.end() :][:16]), x[0].isalpha() or ident.group()[-1].isalpha() or x.startswith("000"), not other), ident.group()
            if not _TEL.search(before):
                continue
        cue = _TEL.search(before)
        shape = _PHONE.match(x)
        if shape and shape.end() < len(x) and (x[shape.end()].isdigit() or x[shape.end()] == "-"):
            shape = None
        if shape:
            tail = re.match(r" ?(?:ext\.?|x|Durchwahl|poste|доб\.) ?\d{1,5}", x[shape.end() :])
            x = x[: shape.end() + (tail.end() if tail else 0)]
            e = s + len(x)
        core = _EXT.sub("", x)
        n = sum(ch.isdigit() for ch in core)
        if not 7 <= n <= 15 or _DATE.search(core) and not core.startswith(("+", "0")) and not cue:
            continue
        if shape or cue:
            yield "PHONE", s, e, _bits(shape, core[0] in "+(" or core != x, cue, _TEL_AFTER.match(t[e : e + 12]), not other), x


def emails(t: str) -> Iterator[Span]:
    for m in _EMAIL.finditer(t):
        plain = m.group(1) == "@"
        cue = re.search(r"(?:mail an|copia a|adressé à|report to|\(|发至|копию на|mail:?|to) ?$", t[max(0, m.start() - 24) : m.start()])
        yield "EMAIL", m.start(), m.end(), _bits(plain, not plain, cue, re.search(r"(?:test|example|invalid|org|com|net|edu|de|fr|es|ru|cn|jp)$", m.group()), True), m.group()


def addresses(t: str, patterns: set[int]) -> Iterator[Span]:
    for i in patterns:
        if i == 1 and not _ZIP.search(t):
            continue
        for m in _ADDRESS[i].finditer(t):
            s, e = m.span()
            yield "ADDRESS", s, e, _bits(True, _HOME.search(t[max(0, s - 80) : s]), _UNIT.match(t[e : e + 24]), not re.search(r"\d ?(?:cm|mm|x)\b", m.group()), True), m.group()


def _tidy(t: str, s: int, e: int) -> tuple[int, int]:
    """Without blanks, titles and closing marks around."""
    while True:
        m = _TITLE.match(t, s, e)
        if m and m.end() < e:
            s = m.end()
        elif s < e and t[s] in " ,;:":
            s += 1
        else:
            break
    while e > s and t[e - 1] in " ,;:":
        e -= 1
    if e - s > 3 and t[e - 1] == "." and t[e - 3] not in " .":
        e -= 1
    return s, e


def _words_back(t: str, e: int, capital: bool) -> int:
    """Start of the run of at most five words of a name that ends at ``e``; of words in lower case the run must
    begin a sentence. ``e`` itself if there is none."""
    s, n = e, 0
    while n < 5 and s > 0:
        if t[s - 1] == " ":
            s -= 1
        at = t.rfind(" ", max(0, s - 40), s) + 1
        w = t[at:s]
        core = w.rstrip(",.")
        if not core or not _WORD_ONLY.fullmatch(core) or w.endswith(".") and len(core) > 1 or capital and not core[0].isupper() or w.endswith(",") and n == 0:
            s += 1 if s < e and t[s] == " " else 0
            break
        s, n = at, n + 1
    if not n:
        return e
    if not capital and not (s == 0 or t[: s].rstrip(" ")[-1:] in ".!?;)-•*" or t[s - 2 : s - 1].isdigit()):
        return e
    return s


def names(t: str, hits: list[tuple[int, tuple[str, Any]]]) -> Iterator[Span]:
    """Names by the cues around them."""
    for end, (side, cue) in hits:
        at = end + 1
        if side == "L":
            first = at - len(cue)
            if first and cue[0].isalpha() and cue[0] < "⺀" and (t[first - 1].isalnum()):
                continue
            s = at
            m = _TITLE.match(t, s)
            titled = bool(m) or _TITLE.fullmatch(cue.strip() + " ") is not None
            if m:
                s = m.end()
            if cue in ROMANCE and (m := _ROMANCE.match(t, s)):
                titled, s = True, m.end()
            if cue in BEFORE_TITLE and not titled:
                continue
            right, stop = "", s
            for r in RIGHT:
                j = t.find(r, s, s + 64)
                if j > s and (not right or j < stop or r not in WEAK_RIGHT and right in WEAK_RIGHT and j <= stop):
                    if r == ", " and re.fullmatch(r"[^\W\d_a-zа-я]+(?:-[^\W\d_a-zа-я]+)*|[A-ZÄÖÜÀ-Þ][\w'’-]+", t[s:j]) and re.match(r", [A-ZÀ-ÞА-ЯĀ-Ž][\w'’-]*\.?(?=,|\.| \(| and| au | en el| unter| wurde| a val| was|$| el |  )", t[j:]):
                        continue  # last name, first name
                    if r == ". " and re.search(r"(?:^|[ .])[^\W\d_]$", t[s:j]):
                        continue  # an initial
                    right, stop = r, j
            caps = _CAPS.match(t, s, s + 64)
            strong_right = bool(right) and right not in WEAK_RIGHT
            if right in WEAK_RIGHT:  # some cues in front make a weak one after the name a real one
                strong_right = (
                    right == ", " and t[stop + 2 : stop + 3].isdigit() or right == " (" and bool(_CONTACT.match(t, stop))
                    or right == " unter " and cue.startswith(("Rück", "Frau", "Herr", "Dr", "Prof")) or right == " au " and cue in ROMANCE or right == " el " and cue in ROMANCE
                )
            if right and _NAME_ONLY.fullmatch(t, s, stop) and len(t[s:stop].split()) <= 6:
                e = stop
            elif caps:
                e = caps.end()
                right, strong_right = "", False
            else:
                continue
            if right in WEAK_RIGHT and not strong_right and not (caps and caps.end() >= e - 1) and t[s].isascii():
                continue  # a word in lower case needs a real cue after it
            weak_right = right in (", the ", " unter ", " au ", " el ", " (", ". ") or not right and t[e - 1 : e + 1].rstrip()[-1:] in (".", ",")
        else:
            e = at - len(cue)
            if cue in ("医師", ",证件号", "(ID"):
                m = _HAN_BACK.search(t[max(0, e - 14) : e])
                s = max(0, e - 14) + m.start(1) if m else e
            elif cue in (" เลขที่", " โทร"):
                m = re.search(r"([฀-๿]+ [฀-๿]+)$", t[max(0, e - 60) : e])
                s = max(0, e - 60) + m.start(1) if m else e
            else:
                s = _words_back(t, e, True)
                if s == e and cue in (" lives at", " was informed", " and transcribed", " wurde um"):
                    s = _words_back(t, e, False)
            if s == e:
                continue
            if cue in (" a validé", " en el tel") and (m := _ROMANCE.match(t, s, e)):
                s = m.end()
            titled = bool(_TITLE.match(t, s, e)) or bool(re.search(r"(?:Dr|Mr|Ms|Mrs|Prof|Nurse|Frau|Herr|Mme|Sr|Sra|Dra|M|D|Pr)\.? $", t[:s][-6:]))
            if not titled and s < e and t[s] < "\u0e00" and not re.search(r"[ ,]", t[s:e].strip()):
                continue  # one word without a title may be any word
            strong_right, weak_right, right = True, False, cue
        s, e = _tidy(t, s, e)
        x = t[s:e]
        parts = [p for p in re.split(r"[ ,]+", x) if p]
        if not parts or len(x) < 2 or any(_STOP.match(p) for p in parts) or any(ch.isdigit() for ch in x):
            continue
        shaped = len(parts) >= 2 and all(p[0].isupper() for p in parts) or not x[0].isascii() and len(x) >= 2
        yield "NAME", s, e, _bits(side == "L" and not _TITLE.fullmatch(cue.strip() + " "), titled, strong_right, weak_right or shaped, shaped), x


def by_place(t: str, found: list[Span]) -> Iterator[Span]:
    """Names that only their place proposes: words between commas after a word in lower case, and words before an
    address or a contact in brackets. They count only if the gazetteer knows all their parts."""
    if t.count(", ") > 1:
        for m in _APPOSITION.finditer(t):
            if not any(p.lower() in _SMALL or _STOP.match(p) for p in m.group(1).split()):
                yield "NAME", m.start(1), m.end(1), _bits(0, 0, 0, True, m.group(1).istitle(), 0, True), m.group(1)
    ends = [s for kind, s, *_ in found if kind == "ADDRESS"] + [m.start() + 1 for m in _CONTACT.finditer(t)]
    for at in ends:
        e = at
        while e > 0 and t[e - 1] in " ,(":
            e -= 1
        for start in {_words_back(t, e, True), *_last_words(t, e)}:
            s, e2 = _tidy(t, start, e)
            parts = [p for p in re.split(r"[ ,]+", t[s:e2]) if p]
            if len(parts) > 1 and not any(_STOP.match(p) or p.lower() in _SMALL for p in parts):
                yield "NAME", s, e2, _bits(0, 0, 0, True, all(p[0].isupper() for p in parts), 0, True), t[s:e2]


def _last_words(t: str, e: int) -> list[int]:
    """Starts of the last two and three words before ``e``."""
    at, out = e, []
    for n in range(3):
        at = t.rfind(" ", max(0, at - 40), at)
        if at < 0 or not _WORD_ONLY.fullmatch(t[at + 1 : e].split(" ")[0].rstrip(",.")):
            break
        if n:
            out.append(at + 1)
    return out


KINDS = ("EMAIL", "PHONE", "ID", "ADDRESS", "NAME")


def candidates(text: str, cues: ahocorasick.Automaton) -> list[Span]:
    """All candidate spans of a text with their votes; one span per place and kind, with the votes united."""
    t = text.replace("\n", " ") + " "
    if _ODD.search(t):
        t = t.translate(_PLAIN)
    hits = list(cues.iter(t))
    patterns = {i for _, (side, i) in hits if side == "A"}
    found: dict[tuple[str, int], Span] = {}
    sources: list[Iterator[Span]] = [numbers(t), addresses(t, patterns), names(t, [h for h in hits if h[1][0] != "A"])]
    if "@" in t or "at)" in t or "at]" in t or "at )" in t:
        sources.append(emails(t))
    for source in sources:
        for kind, s, e, votes, x in source:
            old = found.get((kind, s))
            if old:
                found[kind, s] = (kind, s, max(e, old[2]) if kind != "NAME" else (e if bin(votes).count("1") >= bin(old[3]).count("1") else old[2]), votes | old[3], x)
            else:
                found[kind, s] = (kind, s, e, votes, x)
    for span in by_place(t, list(found.values())):
        old = found.get((span[0], span[1]))
        if old is None or old[3] & PLACE and span[2] > old[2]:
            found[span[0], span[1]] = span
    return list(found.values())


def shape(kind: str, x: str) -> int:
    """A coarse class of a span's form, for the classifier: length and kinds of characters."""
    size = min(3, len(x) // 8)
    return size * 4 + (2 if any(ch.isdigit() for ch in x) else 0) + (1 if x[:1].isupper() else 0)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cues = automaton()
    for b in batches:
        rows = []
        for src, i, text in zip(b["src"], b["row_id"], b["text"]):
            rows += [(src, i, k, s, e, v, shape(k, x), x) for k, s, e, v, x in candidates(text, cues)]
        if rows:
            yield pd.DataFrame(rows, columns=["src", "row_id", "kind", "start_char", "end_char", "votes", "shape", "text"])


SPAN_SCHEMA = "src string, row_id long, kind string, start_char int, end_char int, votes int, shape int, text string"

#: First guesses of P(vote | personal data) and P(vote | other) of each kind's labelers, in the order of the votes.
FIRST: dict[str, tuple[list[float], list[float]]] = {
    "EMAIL": ([0.7, 0.3, 0.9, 0.9, 0.99], [0.5, 0.5, 0.1, 0.2, 0.99]),
    "PHONE": ([0.95, 0.4, 0.9, 0.3, 0.98], [0.15, 0.05, 0.03, 0.1, 0.4]),
    "ID": ([0.99, 0.9, 0.7, 0.6, 0.95], [0.9, 0.03, 0.15, 0.1, 0.4]),
    "ADDRESS": ([0.99, 0.85, 0.7, 0.98, 0.99], [0.9, 0.05, 0.1, 0.5, 0.99]),
    "NAME": ([0.7, 0.4, 0.7, 0.7, 0.8, 0.8], [0.3, 0.1, 0.03, 0.3, 0.2, 0.02]),
}


def reliabilities(kind: str, counts: dict[int, float]) -> tuple[np.ndarray, np.ndarray, float]:
    """(P(vote | yes), P(vote | no), prior) by expectation-maximisation over counted vote patterns."""
    yes, no = (np.array(x) for x in FIRST[kind])
    bits = len(yes)
    if not counts:
        return yes, no, 0.8
    masks = np.array(sorted(counts))
    n = np.array([counts[m] for m in masks], float)
    v = (masks[:, None] >> np.arange(bits)) & 1
    prior, strength = 0.8, 0.2 * n.sum() + 20  # the first guesses weigh like that many spans
    for _ in range(ROUNDS):
        a = np.log(prior) + (v * np.log(yes) + (1 - v) * np.log(1 - yes)).sum(1)
        b = np.log(1 - prior) + (v * np.log(no) + (1 - v) * np.log(1 - no)).sum(1)
        p = 1 / (1 + np.exp(np.clip(b - a, -50, 50)))
        y0, n0 = (np.array(x) for x in FIRST[kind])
        yes = (v.T @ (n * p) + strength * y0) / ((n * p).sum() + strength)
        no = (v.T @ (n * (1 - p)) + strength * n0) / ((n * (1 - p)).sum() + strength)
        prior = float(np.clip((n * p).sum() / n.sum(), 0.02, 0.98))
    return np.clip(yes, 0.01, 0.99), np.clip(no, 0.01, 0.99), prior


def classifier(kind: str, counts: dict[tuple[int, int], float]) -> dict[str, Any]:
    """Logistic weights over votes and shape classes, trained from nothing on the posteriors of the vote model. The
    penalty RIDGE makes the shapes carry what they can of it, so a span with few votes is judged by its shape too."""
    by_mask: dict[int, float] = {}
    for (m, _), n in counts.items():
        by_mask[m] = by_mask.get(m, 0.0) + n
    yes, no, prior = reliabilities(kind, by_mask)
    bits = len(yes)
    by_votes = np.r_[np.log(prior / (1 - prior)) + np.log((1 - yes) / (1 - no)).sum(), np.log(yes / no) - np.log((1 - yes) / (1 - no))]
    keys = sorted(counts)
    if not keys:
        return {"bits": bits, "w": [*by_votes.tolist(), *[0.0] * SHAPES]}
    votes = (np.array([k[0] for k in keys])[:, None] >> np.arange(bits)) & 1
    target = 1 / (1 + np.exp(-np.clip(np.c_[np.ones(len(keys)), votes] @ by_votes, -30, 30)))
    x = np.c_[np.ones(len(keys)), votes, np.eye(SHAPES)[[k[1] for k in keys]]]
    n = np.array([counts[k] for k in keys], float)
    n /= n.sum()
    w, penalty = np.zeros(x.shape[1]), RIDGE * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(50):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (n * np.maximum(p * (1 - p), 1e-6))) @ x + penalty + 1e-9 * np.eye(len(w)), x.T @ (n * (p - target)) + penalty @ w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return {"bits": bits, "w": w.tolist()}


def _decider(models: dict[str, dict[str, Any]], parts: set[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            score = []
            for kind, votes, form, x in zip(b["kind"], b["votes"], b["shape"], b["text"]):
                m = models[kind]
                w = m["w"]
                place = kind == "NAME" and votes & PLACE
                votes = _in_gazetteer(kind, votes, x, parts)
                if votes < 0:
                    score.append(0.0)
                    continue
                # of candidates by place that begin at different words the longest that is known counts
                z = w[0] + sum(w[1 + i] for i in range(m["bits"]) if votes >> i & 1) + (len(x) / 1000 if place else w[1 + m["bits"] + form])
                score.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield b.assign(score=score)[["src", "row_id", "kind", "start_char", "end_char", "text", "score"]]

    return run


def name_parts(x: str) -> list[str]:
    """The parts of a name in lower case, without initials; an unspaced name is one part."""
    return [p.lower() for p in re.split(r"[ ,.-]+", x) if len(p) > 1]


def _in_gazetteer(kind: str, votes: int, x: str, parts: set[str]) -> int:
    """The votes with that of the gazetteer; -1 for a candidate by place of which it doesn't know all parts."""
    if kind != "NAME":
        return votes
    own = name_parts(x)
    if votes & PLACE:
        return (votes & ~PLACE) | 1 << 5 if own and all(p in parts for p in own) else -1
    return votes | (1 << 5 if own and sum(p in parts for p in own) * 2 > len(own) else 0)


def _histogram(parts: set[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            votes = [_in_gazetteer(k, v, x, parts) for k, v, x in zip(b["kind"], b["votes"], b["text"])]
            g = pd.DataFrame({"kind": b["kind"], "votes": votes, "shape": b["shape"]})
            g = g[g["votes"] >= 0]
            if len(g):
                yield g.value_counts().reset_index(name="n")

    return run


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"part": [p for x in b["text"] for p in set(name_parts(x))]}, dtype="object")


def spans(texts: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(src, row_id, kind, start_char, end_char, text, score) of the accepted spans of rows (src, row_id, text)."""
    found = cut(texts.where("row_id is not null and text <> ''").mapInPandas(_scan, SPAN_SCHEMA))
    both = found.where("kind = 'NAME' and votes & 4 = 4 and votes & 3 > 0").select("text")
    gaz = both.mapInPandas(_parts, "part string").groupBy("part").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").orderBy(F.desc("n"), "part").limit(GAZETTEER)
    parts = {r.part for r in gaz.toLocalIterator()}
    hist: dict[str, dict[tuple[int, int], float]] = {k: {} for k in KINDS}
    seen = found.select("kind", "votes", "shape", "text").mapInPandas(_histogram(parts), "kind string, votes int, shape int, n long")
    for r in seen.groupBy("kind", "votes", "shape").agg(F.sum("n").alias("n")).toLocalIterator():  # at most 64 x 16 a kind
        hist[r.kind][r.votes, r.shape] = float(r.n)
    models = {k: classifier(k, hist[k]) for k in KINDS}
    schema = "src string, row_id long, kind string, start_char int, end_char int, text string, score double"
    scored = found.mapInPandas(_decider(models, parts), schema).where(F.col("score") >= threshold)
    return _no_overlaps(scored.distinct())


def _no_overlaps(scored: DataFrame) -> DataFrame:
    """Of overlapping spans of a text the best one. Only rows with spans are grouped, each by its own id."""
    span = F.struct((-F.col("score")).alias("s"), (F.col("start_char") - F.col("end_char")).alias("l"), "start_char", "end_char", "kind", "text", "score")
    g = scored.groupBy("src", "row_id").agg(F.array_sort(F.collect_list(span)).alias("xs"))
    empty = F.slice(F.col("xs"), 1, 0)
    keep = F.aggregate("xs", empty, lambda acc, x: F.when(F.exists(acc, lambda y: (y["start_char"] < x["end_char"]) & (x["start_char"] < y["end_char"])), acc).otherwise(F.array_append(acc, x)))
    return g.select("src", "row_id", F.explode(keep).alias("x")).select("src", "row_id", "x.kind", "x.start_char", "x.end_char", "x.text", F.round("x.score", 6).alias("score"))


def both_tables(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """(src, row_id, text) of the texts to search."""
    p = pages.select(F.lit("page_extractions").alias("src"), F.col("page_id").cast("long").alias("row_id"), F.col("final_text").alias("text"))
    return p.unionByName(sections.select(F.lit("sections").alias("src"), F.col("section_id").cast("long").alias("row_id"), "text"))


def found(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """(src, row_id, kind, start_char) of every item of personal data."""
    return spans(both_tables(pages, sections)).select("src", "row_id", "kind", "start_char").distinct()


def _replace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for text, xs in zip(b["text"], b["xs"]):
            for x in sorted(xs if xs is not None else [], key=lambda x: -x["start_char"]):
                text = f"{text[: x['start_char']]}[{x['kind']}]{text[x['end_char'] :]}"
            out.append(text)
        yield b.assign(text=out)[["src", "row_id", "text"]]


def redacted(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """(src, row_id, text): every text with placeholders in the place of its items."""
    texts = both_tables(pages, sections).where("text is not null").distinct()
    g = spans(texts).groupBy("src", "row_id").agg(F.collect_set(F.struct("start_char", "end_char", "kind")).alias("xs"))
    return texts.join(g, ["src", "row_id"], "left").mapInPandas(_replace, "src string, row_id long, text string")
