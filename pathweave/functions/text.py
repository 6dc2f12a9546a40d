"""Column expressions for cleaning, sectioning and splitting report text. All stay in the JVM; regular
expressions are Unicode-aware where the rules they stand for are."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_TITLE = "Document Body"

# Patterns of lines that carry no content, matched from the line's start without regard to case.
NOISE_PATTERNS: tuple[str, ...] = (
    r"page\s+\d+\s*(?:/|of)\s*\d+$",
    r"page\s+\d+$",
    r"END OF REPORT$",
    r"CONTACT YOUR DOCTOR WITH THIS REPORT!?$",
    r"UUID[:\s-].*$",
    r"TCGA-[A-Z0-9-]+.*REDACTED$",
    r"TCGA-[A-Z0-9-]+(?:-[A-Z0-9]+)?$",
    r"Criteria$",
    r"Diagnosis Discrepancy.*$",
    r"Primary Tumor Site Discrepancy.*$",
    r"HI.?PAA Discrepancy.*$",
    r"Prior Malignancy History.*$",
    r"Dual/Synchronous Primary.*$",
    r"Case is.*$",
    r"Review.*$",
    r"SURGICAL PATHOLOGY REPORT$",
    r"REPORT ELECTRONICALLY SIGNED OUT.*$",
    r"REVIEWED AND APPROVED THIS REPORT\.?$",
    r"RUN DATE.*$",
    r"RUN TIME.*$",
    r"RUN USER.*$",
    r"REDACTED$",
)

# Abbreviations whose full stop ends no sentence, for the two splitters.
ABBREVIATIONS_SIMPLE = ("Dr.", "No.", "Fig.", "vs.", "cm.", "mm.")
ABBREVIATIONS = ("Dr.", "No.", "Fig.", "vs.", "cm.", "mm.", "mg.", "ml.", "dept.", "approx.")

# Canonical section titles, and what a raw title in capitals must contain or begin with, in order.
CANONICAL_TITLES = (
    "Document Body", "Final Diagnosis", "Diagnosis", "Gross Description", "Microscopic Description", "Clinical Information", "Comment", "Procedure", "Synoptic Report",
    "Summary of Sections", "Specimen Submitted", "Ancillary Studies", "Intraoperative Consultation", "Patient History",
)
TITLE_RULES: tuple[tuple[str, str], ...] = (
    (r"^(?=.*FINAL)(?=.*(?:DIAGNOS|DYAGNOS))", "Final Diagnosis"),
    (r"DIAGNOSIS", "Diagnosis"),
    (r"GROSS DESCRIPTION", "Gross Description"),
    (r"MICROSCOPIC DESCRIPTION", "Microscopic Description"),
    (r"CLINICAL NOTE|CLINICAL INFORMATION", "Clinical Information"),
    (r"^SPECIMEN", "Specimen Submitted"),
    (r"CHECKLIST|SYNOPTIC|CONSOLIDATED DIAGNOSTIC PATHOLOGY FORM", "Synoptic Report"),
    (r"SUMMARY OF SECTIONS", "Summary of Sections"),
    (r"INTRAOPERATIVE CONSULTATION", "Intraoperative Consultation"),
    (r"ANCILLARY STUDIES|HER2", "Ancillary Studies"),
    (r"PATIENT HISTORY", "Patient History"),
    (r"PROCEDURE", "Procedure"),
    (r"COMMENT", "Comment"),
    (r"^(?=.*(?:PATHO|PATRFOLOGY|PLOGY))(?=.*REPORT)", DEFAULT_TITLE),
    (r"TCGA-|\b\d{2,}[A-Z-]*\b", DEFAULT_TITLE),
    (r"^(?:PAGE|PACE) ", DEFAULT_TITLE),
    (r"SURGICAL PATHOLOGY", DEFAULT_TITLE),
    (r"^(?:MRN|MR #|NAME|KARYOTYPE|I|J|E|B|SPECIMEN|[A-Z]|[A-Z0-9#/\\-]{1,8})$", DEFAULT_TITLE),
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nfkc(c: Column | str) -> Column:
    """NFKC form. Only texts with other than ASCII characters go through a Python worker."""

    @F.pandas_udf("string")
    def form(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKC")

    c = col(c)
    return F.when(c.rlike(r"[^\x00-\x7F]"), form(c)).otherwise(c)


def normalize_text(c: Column | str, compose: bool = False) -> Column:
    """Blanks and line breaks in one form: no-break and tab to blank, zero-width removed, CR to LF, at most one
    empty line in a row, no outer white space. ``compose`` adds the NFKC form."""
    x = nfkc(c) if compose else col(c)
    x = F.translate(F.coalesce(x, F.lit("")), " \r​", " \n")
    x = F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def normalize_line(c: Column | str) -> Column:
    """normalize_text with every run of white space as one blank."""
    return F.trim(F.regexp_replace(normalize_text(c), r"(?U)\s+", " "))


def lines_of(c: Column | str) -> Column:
    """The lines of a text as an array."""
    return F.split(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\r\n?", "\n"), "\n")


def is_barcode(c: Column | str) -> Column:
    """At least 16 characters, all of them bars or look-alikes."""
    x = F.trim(col(c))
    return (F.length(x) >= 16) & x.rlike(r"^[I1l| ]+$")


def is_noise(c: Column | str, more: Iterable[str] = (), normalised: bool = False) -> Column:
    """Lines without content: noise patterns, barcodes, long lines that are mostly bars. Blank lines are kept.
    A line that is normalised already is taken as it is, which spares doing so for every test."""
    x = col(c) if normalised else normalize_line(c)
    bars = F.length(x) - F.length(F.translate(x, "I1l|", ""))
    mostly = (F.length(x) > 40) & (bars / F.length(x) > 0.65)
    return (x != "") & (is_barcode(x) | x.rlike("(?i)^(?:" + "|".join([*NOISE_PATTERNS, *more]) + ")") | mostly)


def is_heading(c: Column | str, patterns: Iterable[str] = ()) -> Column:
    """Matches a heading pattern, or is at most 70 characters, all in capitals, with a Latin letter."""
    x = F.trim(col(c))
    out = (F.length(x) <= 70) & (x == F.upper(x)) & x.rlike("[A-Z]")
    rules = list(patterns)
    return (x != "") & ((x.rlike("(?iu)^(?:" + "|".join(rules) + ")") | out) if rules else out)


def starts_item(c: Column | str) -> Column:
    """Opens a list item: PART n, a letter with a full stop, a number with a bracket, stop or colon."""
    return col(c).rlike(r"(?i)^(?:PART\s+\d+|[A-Z]\.|\d+[).:])")


def joins_previous(previous: Column | str, line: Column | str, patterns: Iterable[str] = ()) -> Column:
    """Whether a line goes on the one before it. Only the last sign of that line matters."""
    p, x = col(previous), col(line)
    open_end = p.rlike(r"[-/]$")
    goes_on = x.rlike(r"^(?:\p{Ll}|[\d(<])")
    return F.coalesce((p != "") & (x != "") & ~is_heading(x, patterns) & ~starts_item(x) & ~p.endswith(":") & (open_end | (~p.rlike(r"[.!?;)]$") & goes_on)), F.lit(False))


def choose_page_text(native: Column | str, ocr: Column | str) -> Column:
    """(text, strategy) of a page: the one that is there, the recognised text if it is 15 % longer, the native
    one if both are equal, else both."""
    n, o = (F.trim(F.coalesce(col(c), F.lit(""))) for c in (native, ocr))
    both = F.concat(n, F.lit("\n"), o)
    return (
        F.when((n == "") & (o == ""), F.struct(F.lit("").alias("text"), F.lit("empty").alias("strategy")))
        .when(n == "", F.struct(o.alias("text"), F.lit("ocr_only").alias("strategy")))
        .when(o == "", F.struct(n.alias("text"), F.lit("native_text").alias("strategy")))
        .when(F.length(o) >= F.length(n) * 1.15, F.struct(o.alias("text"), F.lit("ocr_fallback").alias("strategy")))
        .when(n == o, F.struct(n.alias("text"), F.lit("native_text").alias("strategy")))
        .otherwise(F.struct(both.alias("text"), F.lit("native_plus_ocr").alias("strategy")))
    )


def text_quality(c: Column | str) -> Column:
    """Counts, share of letters and score of a page's text as a struct."""
    x = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)^\s+|\s+$", "")
    chars = F.length(x)
    letters = F.length(F.regexp_replace(x, r"\P{L}", ""))
    digits = F.length(F.regexp_replace(x, r"\P{Nd}", ""))
    filled = F.filter(F.split(x, "\n"), lambda s: F.trim(s) != "")
    bars = F.size(F.filter(filled, lambda s: (F.length(F.trim(s)) >= 18) & F.trim(s).rlike(r"^[I1l| ]+$")))
    score = chars + letters * 0.5 + F.size(filled) * 5 - bars * 120 - digits * 0.05
    return F.struct(
        chars.alias("char_count"),
        letters.alias("alpha_count"),
        digits.alias("digit_count"),
        F.size(filled).alias("line_count"),
        F.when(chars > 0, letters / chars).otherwise(0.0).alias("alpha_ratio"),
        score.alias("score"),
    )


def is_low_text(c: Column | str, chars: int = 80, ratio: float = 0.2) -> Column:
    q = text_quality(c)
    return (q["char_count"] < chars) | (q["alpha_ratio"] < ratio)


def dataset_of(path: Column | str, names: Iterable[str]) -> Column:
    """The first component of a path that is one of ``names``, whatever its case."""
    wanted = F.array(*[F.lit(n.upper()) for n in names])
    return F.element_at(F.filter(F.transform(F.split(F.translate(col(path), "\\", "/"), "/"), F.upper), lambda p: F.array_contains(wanted, p)), 1)


def section_title(c: Column | str) -> Column:
    """Canonical title of a raw section title; what is no title becomes the default one."""
    t = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)\s+", " ")), r"^[ :;,\-_/\\]+|[ :;,\-_/\\]+$", "")
    up = F.upper(t)
    letters = F.length(F.regexp_replace(t, r"\P{L}", ""))
    digits = F.length(F.regexp_replace(t, r"\P{Nd}", ""))
    odd = F.length(F.regexp_replace(t, r"[\p{L}\p{N}\s]", ""))
    out = F.when(t == "", DEFAULT_TITLE)
    for name in CANONICAL_TITLES:
        out = out.when(F.lower(t) == name.lower(), name)
    for rule, name in TITLE_RULES:
        out = out.when(up.rlike(rule), name)
    return out.when(((letters <= 4) & ((digits > 0) | (odd > 0))) | ((odd >= 2) & (digits >= 1)), DEFAULT_TITLE).otherwise(t)


def _protect(x: Column, words: Iterable[str]) -> Column:
    for w in words:
        x = F.replace(x, F.lit(w), F.lit(w[:-1] + "\u0001"))
    return x


def _pieces(x: Column, before: str) -> Column:
    cut = F.split(x, rf"(?<=[.!?])\s+(?={before})")
    return F.filter(F.transform(cut, lambda s: F.trim(F.translate(s, "\u0001", "."))), lambda s: s != "")


def split_sentences_simple(c: Column | str) -> Column:
    """Sentences of a text; a text without any is its own sentence."""
    x = normalize_text(c)
    parts = _pieces(_protect(x, ABBREVIATIONS_SIMPLE), r"[A-Z(\[]")
    return F.when(x == "", F.array().cast("array<string>")).when(F.size(parts) == 0, F.array(x)).otherwise(parts)


def paragraphs_of(c: Column | str) -> Column:
    """Paragraphs of a text, each on one line."""
    parts = F.split(normalize_text(c), r"\n\s*\n+")
    return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"\n", " "))), lambda p: p != "")


def split_sentences(c: Column | str) -> Column:
    """Sentences paragraph by paragraph; stops of abbreviations and decimals end none."""
    one = lambda p: _pieces(F.regexp_replace(_protect(p, ABBREVIATIONS), r"(?<=\d)\.(?=\d)", "\u0001"), r"[A-Z0-9(\[]")
    parts = F.flatten(F.transform(paragraphs_of(c), one))
    return F.when(F.size(parts) > 0, parts).otherwise(split_sentences_simple(c))


def case_id(c: Column | str, long_form: bool = True, prefix: str = "TCGA") -> Column:
    """Case id of a file name. The long form takes all that follows the prefix, or the whole name; the short one
    takes three groups, or the first twelve characters in capitals."""
    if not long_form:
        x = F.trim(F.coalesce(col(c), F.lit("")))
        short = F.upper(F.regexp_extract(x, rf"(?i){prefix}-[A-Z0-9]{{2}}-[A-Z0-9]{{4}}", 0))
        return F.when(short != "", short).otherwise(F.upper(F.substring(x, 1, 12)))
    pattern = rf"(?i){prefix}-[A-Z0-9-]+"
    stem = F.regexp_replace(F.regexp_replace(F.translate(col(c), "\\", "/"), r"^.*/", ""), r"\.[^.]*$", "")
    found = F.upper(F.regexp_extract(stem, pattern, 0))
    return F.when(found != "", found).otherwise(stem)


def stage_label(c: Column | str) -> Column:
    """0 for stages I and II, 1 for III and IV, null for all else."""
    token = F.upper(F.regexp_extract(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)\s+", " "), r"(?i)\bstage\s+([IVX0-9]+[A-D]?)\b", 1))
    return F.when(token.rlike("^(?:III|IV)"), 1).when(token.rlike("^I"), 0).cast("int")


def key_of(c: Column | str) -> Column:
    """A label as a key: lower case, all else than Latin letters and digits as single underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(normalize_line(c)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def file_safe(c: Column | str) -> Column:
    """A file name without signs that file systems forbid."""
    return F.regexp_replace(col(c), r'[<>:"/\\|?*\x00-\x1F]+', "_")


def truthy(c: Column | str) -> Column:
    """Permissive reading of a flag; null if it says neither."""
    x = F.lower(F.trim(col(c).cast("string")))
    return F.when(x.isin("1", "true", "yes", "y", "on", "t"), True).when(x.isin("0", "false", "no", "n", "off", "f"), False)


def sanitize(c: Column | str) -> Column:
    """Text fit for an export: line feeds only, control characters as blanks."""
    return F.regexp_replace(F.regexp_replace(col(c), r"\r\n?", "\n"), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", " ")


def fragment_of(iri: Column | str) -> Column:
    """What follows the last # or / of an IRI."""
    return F.regexp_extract(col(iri), r"[^#/]*$", 0)
