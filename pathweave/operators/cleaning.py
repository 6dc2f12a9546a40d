"""Structural cleaning of documents: lines, wrapped lines, margins, sections, sentences and masks.

Everything is a window or a higher-order function over columns; a document is the partition key, so plans scale
with the number of documents and no task sees more than one document at a time in order.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

DEFAULT_TITLE = t.DEFAULT_TITLE

# Section headings by priority, matched from a line's start without regard to case.
SECTION_RULES: tuple[tuple[str, str], ...] = (
    ("Specimen Submitted", r"SPECIMENS? SUBMITTED\b:?|SOURCE OF SPECIMEN\(S\)\b:?|SOURCE OF SPECIMENS?\b:?"),
    ("Gross Description", r"GROSS DESCRIPTION\b:?|MACROSCOPIC DESCRIPTION\b:?|[A-Z<]{0,5}OSS DESCRIPTION\b:?"),
    ("Microscopic Description", r"MICROSCOPIC DESCRIPTION\b:?"),
    ("Diagnosis", r"DIAGNOSIS\b:?|AMENDED DIAGNOSIS\b:?|PATHOLOGIC DIAGNOSIS\b:?|PATHOLOGICAL DIAGNOSIS\b:?|MICROSCOPIC DIAGNOSIS\b:?|HISTOPATHOLOGICAL DIAGNOSIS\b:?|DIAGNOSTIC INTERPRETATION\b:?"),
    ("Final Diagnosis", r"FINAL DIAGNOSIS\b:?|PATH FINAL DIAGNOSIS\b:?|POST[ -]?OP DIAGNOSIS\b:?|(?:PRE|PRO)[ -]?OP DIAGNOSIS\b:?"),
    ("Comment", r"COMMENT(?:\(S\))?\b:?"),
    ("Synoptic Report", r"SYNOPTIC(?: REPORT)?\b.*|SURGICAL PATHOLOGY CANCER CASE SUMMARY\b.*|CASE SUMMARY\b.*|CHECKLIST\b.*"),
    ("Ancillary Studies", r"ANCILLARY STUDIES\b:?"),
    ("Intraoperative Consultation", r"INTRAOPERATIVE CONSULTATION\b:?"),
    ("Summary of Sections", r"SUMMARY OF SECTIONS\b:?"),
    ("Patient History", r"PATIENT HISTORY\b:?"),
    ("Clinical Information", r"CLINICAL INFORMATION\b:?|CLINICAL DIAGNOSIS\s*&\s*HISTORY\b:?|CLINICAL HISTORY/DIAGNOSIS\b:?|CLINICAL HISTORY\b:?"),
    ("Procedure", r"PROCEDURE\b:?"),
)

# Sections that a document without diagnosis leaves out.
DIAGNOSIS_TITLES = r"\b(?:final diagnosis|diagnosis|diagnostic|pathologic(?:al)? diagnosis|diagnostic interpretation|amended diagnosis)\b"
OTHER_DROPPED_TITLES = (
    r"\b(?:synoptic(?: report)?|surgical pathology cancer case summary|case summary|checklist|cap cancer protocol)\b",
    r"\b(?:ajcc|tnm|staging summary|stage summary|pathologic stage|pathological stage|impression)\b",
    r"\b(?:intraoperative consultation|frozen section diagnosis|permanent diagnosis|summary of sections)\b",
)

# What would give a stage away, in the order in which it is masked.
MASKS: tuple[tuple[str, str, str], ...] = (
    ("ajcc_stage", r"(?iu)\bAJCC\s*stage\s*[:\-]?\s*[IVX0-9A-D]+\b", "[MASK_STAGE]"),
    ("pathologic_stage_assessment", r"(?iu)\bpatholog(?:y|ic(?:al)?)\s+stage\s+assessment\b", "[MASK_STAGE]"),
    ("pathologic_tnm_stage_heading", r"(?iu)\bpatholog(?:y|ic(?:al)?)\s+(?:tnm\s+)?stage(?:\s*\([^)]*\))?\s*:?", "[MASK_STAGE]"),
    ("pathologic_stage_heading", r"(?iu)\bpatholog(?:y|ic(?:al)?)\s+stage(?:\s*\([^)]*\))?\s*:?", "[MASK_STAGE]"),
    ("pathologic_tumor_stage", r"(?iu)\bpathologic(?:al)?\s+tumou?r\s+stage\b", "[MASK_STAGE]"),
    ("pathologic_tumor_staging", r"(?iu)\binvasive\s+pathologic\s+tumou?r\s+staging(?:\s*\([^)]*\))?", "[MASK_STAGE]"),
    ("pathologic_staging", r"(?iu)\bpathologic(?:al)?\s+staging\b", "[MASK_STAGE]"),
    ("pathologic_stage", r"(?iu)\bpathologic(?:al)?\s+stage\s*[:\-]?\s*[IVX0-9A-D]+\b", "[MASK_STAGE]"),
    ("stage", r"(?iu)\bstage\s*[:\-]?\s*[IVX0-9A-D]+\b", "[MASK_STAGE]"),
    ("ptnm", r"(?iu)\bpTNM\b", "[MASK_TNM]"),
    ("tnm", r"(?iu)\b(?:AJCC\s*)?TNM\b", "[MASK_TNM]"),
    ("ajcc_ref", r"(?iu)\bAJCC\b", "[MASK_AJCC]"),
    ("primary_t_field", r"(?iu)\bprimary tumor\s*\([cpy]?t\)\b", "[MASK_T_FIELD]"),
    ("regional_n_field", r"(?iu)\bregional lymph nodes?\s*\([cpy]?n\)\b", "[MASK_N_FIELD]"),
    ("distant_m_field", r"(?iu)\bdistant metast(?:asis|ases)\s*\([cpy]?m\)\b", "[MASK_M_FIELD]"),
    (
        "tnm_compound",
        r"(?iu)\b[cpy]?T(?:is|[x0o]|[1-4il])(?:[a-d]|mi|lc|1c)?\s*[,/;-]?\s*[cpy]?N(?:[x0o]|[1-3il])(?:[a-c]|mi|ia|ib|ic|i+)?(?:\s*\([^)]*\))?\s*[,/;-]?\s*[cpy]?M(?:[x0o]|1)\b",
        "[MASK_TNM_SEQUENCE]",
    ),
    ("t_category", r"(?iu)\b[cpy]?T(?:is|x|0|[1-4])(?:[a-d]|mi)?\b", "[MASK_T]"),
    ("n_category", r"(?iu)\b[cpy]?N(?:x|0|[1-3])(?:[a-c]|mi)?\b", "[MASK_N]"),
    ("m_category", r"(?iu)\b[cpy]?M(?:x|0|1)\b", "[MASK_M]"),
    ("t_category_loose", r"(?iu)(?<![A-Za-z0-9])[cpy]T(?:is|[x0o]|[1-4il])(?:[a-d]|mi|lc|1c)?(?![A-Za-z])(?:\s*\([^)]*\))?", "[MASK_T]"),
    ("n_category_loose", r"(?iu)(?<![A-Za-z0-9])[cpy]N(?:[x0o]|[1-3il])(?:[a-c]|mi|ia|ib|ic|i\+)?(?![A-Za-z])(?:\s*\([^)]*\))?", "[MASK_N]"),
    ("m_category_loose", r"(?iu)(?<![A-Za-z0-9])[cpy]M(?:[x0o]|1)(?![A-Za-z])(?:\s*\([^)]*\))?", "[MASK_M]"),
)
CONTEXT_MASKS: tuple[tuple[str, str, str], ...] = (
    ("stage_context_t", r"(?<![A-Za-z0-9])T(?:is|X|0|O|[1-4Il])(?:[A-Da-d]|mi|lc|1c)?(?![A-Za-z])(?:\s*\([^)]*\))?", "[MASK_T]"),
    ("stage_context_n", r"(?<![A-Za-z0-9])N(?:X|0|O|[1-3Il])(?:[A-Ca-c]|mi|ia|ib|ic|IA|IB|IC|I\+)?(?![A-Za-z])(?:\s*\([^)]*\))?", "[MASK_N]"),
    ("stage_context_m", r"(?<![A-Za-z0-9])M(?:X|0|O|1)(?![A-Za-z])(?:\s*\([^)]*\))?", "[MASK_M]"),
)
STAGE_SIGNALS: tuple[str, ...] = (
    r"(?iu)\bAJCC\s*stage\b",
    r"(?iu)\bpTNM\s*stage\b",
    r"(?iu)\bTNM\s*stage\b",
    r"(?iu)\bpatholog(?:y|ic(?:al)?)\s+stage\b",
    r"(?iu)\bclinical\s+stage\b",
    r"\b[Ss]tage\s*[IVX0-9A-D]+\b",
    r"(?iu)\b[cp]?T[0-4][a-d]?\b",
    r"(?iu)\b[cp]?N[0-3][a-c]?\b",
    r"(?iu)\b[cp]?M[0-1xX]\b",
    r"(?iu)\bT[0-4][a-d]?N[0-3][a-c]?M[0-1xX]\b",
)
KEEP_HINTS = (
    r"(?iu)\b(?:histologic(?:al)? type|tumou?r size|tumou?r site|macroscopic extent|extent of tumou?r|nuclear grade|fuhrman grade|nottingham grade|lymphovascular|transcapsular|renal vein"
    r"|vena?\s*caval|margins?|lymph nodes?|gross description|microscopic description|specimen|invasion|kidney|pelvis|vessels?|soft tissue)\b"
)


def explode_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line): the normalised lines of every text."""
    return df.select(key, F.posexplode(t.lines_of(text)).alias("line_no", "raw")).select(key, "line_no", t.normalize_line("raw").alias("line"))


def drop_noise(lines: DataFrame, more: Iterable[str] = ()) -> DataFrame:
    """Lines that carry content, and blank ones."""
    return lines.where(~t.is_noise("line", more, normalised=True))


def merge_wrapped(lines: DataFrame, key: str, patterns: Sequence[str] = ()) -> DataFrame:
    """(key, line_no, line): lines that go on the one before joined to it, without a blank after a hyphen.

    Whether a line goes on depends on it and the line before only, so runs are islands of a running sum."""
    w = Window.partitionBy(key).orderBy("line_no")
    x = lines.withColumn("before", F.lag("line", 1, "").over(w))
    x = x.withColumn("on", t.joins_previous("before", "line", patterns))
    x = x.withColumn("run", F.sum(F.when(F.col("on"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    piece = F.when(~F.col("on"), F.col("line")).when(F.col("before").endswith("-"), F.col("line")).otherwise(F.concat(F.lit(" "), "line"))
    glued = F.lead("on", 1, False).over(w) & F.col("line").endswith("-")
    x = x.withColumn("piece", F.when(glued, F.regexp_replace(piece, "-+$", "")).otherwise(piece))
    parts = F.array_sort(F.collect_list(F.struct("line_no", "piece")))
    return x.groupBy(key, "run").agg(F.min("line_no").alias("line_no"), F.concat_ws("", F.transform(parts, lambda p: p["piece"])).alias("line")).drop("run")


def compact_blanks(lines: DataFrame, key: str) -> DataFrame:
    """At most one blank line in a row, none at either end."""
    w = Window.partitionBy(key).orderBy("line_no")
    inside = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    filled = F.when(F.col("line") != "", 1)
    x = lines.withColumns({"before": F.lag("line", 1, "").over(w), "some_before": F.max(filled).over(inside[0]), "some_after": F.max(filled).over(inside[1])})
    return x.where("some_before = 1 and some_after = 1 and (line <> '' or before <> '')").drop("before", "some_before", "some_after")


def clean(df: DataFrame, key: str, text: str, patterns: Sequence[str] = ()) -> DataFrame:
    """(key, line_no, line): noise dropped, wrapped lines merged, blanks compacted."""
    return compact_blanks(merge_wrapped(drop_noise(explode_lines(df, key, text)), key, patterns), key)


def repeated_margins(pages: DataFrame, doc: str, page: str, text: str, edge: int = 3, share: float = 0.6) -> DataFrame:
    """(doc, line, pages): lines among the first and last ``edge`` filled ones of a page that recur on at least
    ``share`` of the document's pages, of which there must be three."""
    x = pages.groupBy(doc, page).agg(F.max(text).alias("text"))  # a page delivered twice counts once
    filled = F.filter(F.transform(t.lines_of("text"), t.normalize_line), lambda s: s != "")
    ends = F.array_distinct(F.concat(F.slice(filled, 1, edge), F.slice(filled, F.greatest(F.lit(1), F.size(filled) - (edge - 1)), edge)))
    n = x.groupBy(doc).agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    lines = x.select(doc, page, F.explode(ends).alias("line")).where("length(line) between 4 and 100 and line rlike '[\\\\p{L}\\\\p{N}]'")
    seen = lines.groupBy(doc, "line").agg(F.count(F.lit(1)).alias("pages"))
    return seen.join(n, doc).where(F.col("pages") >= F.greatest(F.lit(2), F.ceil(F.col("n") * share))).select(doc, "line", "pages")


def without_margins(lines: DataFrame, margins: DataFrame, doc: str) -> DataFrame:
    """Lines of a document that are not among its repeated margins."""
    return lines.join(margins.select(doc, "line"), [doc, "line"], "left_anti")


def sections_by_rules(lines: DataFrame, key: str, rules: Sequence[tuple[str, str]] = SECTION_RULES) -> DataFrame:
    """(key, section_index, section_title, text): the first matching heading rule opens a section, the rest of
    its line opens the section's text; blank lines are left out and sections without text vanish."""
    x = lines.where("line <> ''")
    title, rest = F.lit(None).cast("string"), F.col("line")
    for name, rule in reversed(rules):
        hit = F.col("line").rlike(rf"(?iu)^(?:{rule})")
        after = F.regexp_replace(F.regexp_replace("line", rf"(?iu)^(?:{rule})", ""), r"^[ :-]+|[ :-]+$", "")
        title, rest = F.when(hit, name).otherwise(title), F.when(hit, after).otherwise(rest)
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({"head": title, "rest": rest})
    x = x.withColumn("part", F.count("head").over(w))
    body = F.array_sort(F.collect_list(F.when(F.col("rest") != "", F.struct("line_no", "rest"))))
    g = x.groupBy(key, "part").agg(F.max("head").alias("head"), body.alias("body")).where(F.size("body") > 0)
    g = g.select(key, "part", F.coalesce("head", F.lit(DEFAULT_TITLE)).alias("section_title"), F.concat_ws("\n", F.transform("body", lambda b: b["rest"])).alias("text"))
    return g.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("part")) - 1).alias("section_index"), "section_title", "text")


def is_generic_heading(c: Column) -> Column:
    """At most 90 characters without a stop at the end: words before a colon that are all in capitals or
    capitalised, or a line of at most eight words in capitals."""
    prefix = F.trim(F.substring_index(c, ":", 1))
    words = F.size(F.split(prefix, r"\s+"))
    capital = ((prefix == F.upper(prefix)) & prefix.rlike(r"\p{Lu}")) | ((prefix == F.initcap(prefix)) & prefix.rlike(r"\p{L}"))
    with_colon = (prefix != "") & (F.length(prefix) <= 45) & ~prefix.rlike(r"\d") & (words <= 6) & capital
    plain = (c == F.upper(c)) & c.rlike("[A-Z]") & (F.size(F.split(c, r"\s+")) <= 8)
    return (c != "") & (F.length(c) <= 90) & ~c.endswith(".") & F.when(c.contains(":"), with_colon).otherwise(plain)


def sections_generic(lines: DataFrame, key: str) -> DataFrame:
    """(key, section_index, section_title, text): a heading directly after a blank line or at the start opens a
    section; after the first synoptic heading no other is recognised. Blank lines stay in the text."""
    w = Window.partitionBy(key).orderBy("line_no")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    known = [n for n, _ in SECTION_RULES]
    head = F.trim(F.substring_index("line", ":", 1))
    title = t.section_title(head)
    x = lines.withColumn("after_blank", F.lag("line", 1, "").over(w) == "")
    ok = F.col("after_blank") & is_generic_heading(F.col("line")) & (~F.col("line").contains(":") | title.isin(known) | (head == F.upper(head))) & ~F.upper("line").isin("PART 1", "PART 2", "PART 3")
    x = x.withColumn("head", F.when(ok, title)).withColumn("rest", F.when(ok, F.when(F.col("line").contains(":"), F.trim(F.expr("substring(line, locate(':', line) + 1)"))).otherwise("")).otherwise(F.col("line")))
    synoptic = F.max(F.when(F.col("head") == "Synoptic Report", 1)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("shut", F.coalesce(synoptic, F.lit(0)) == 1)
    x = x.withColumns({"head": F.when(~F.col("shut"), F.col("head")), "rest": F.when(F.col("shut"), F.col("line")).otherwise(F.col("rest"))})
    x = x.withColumn("part", F.count("head").over(upto))
    body = F.array_sort(F.collect_list(F.struct("line_no", "rest")))
    g = x.groupBy(key, "part").agg(F.max("head").alias("head"), F.concat_ws("\n", F.transform(body, lambda b: b["rest"])).alias("text"))
    g = g.select(key, "part", F.coalesce("head", F.lit(DEFAULT_TITLE)).alias("section_title"), F.regexp_replace("text", r"^\s+|\s+$", "").alias("text")).where("text <> ''")
    return g.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("part")) - 1).alias("section_index"), "section_title", "text")


def best_sections(by_rules: DataFrame, generic: DataFrame, key: str) -> DataFrame:
    """(key, parser, section_index, section_title, text): of both parses of a document the one with more titles,
    then more sections, then more characters; the rules win a tie."""
    both = by_rules.withColumn("parser", F.lit("rule_based")).unionByName(generic.withColumn("parser", F.lit("generic_heading_fallback")))
    score = both.groupBy(key, "parser").agg(F.struct(F.count_if(F.col("section_title") != DEFAULT_TITLE), F.count(F.lit(1)), F.sum(F.length("text")), F.max(F.col("parser") == "rule_based")).alias("s"))
    pick = score.groupBy(key).agg(F.max_by("parser", "s").alias("parser"))
    return both.join(pick, [key, "parser"]).select(key, "parser", "section_index", "section_title", "text")


def sentence_view(sections: DataFrame, key: str, index: str = "section_index", title: str = "section_title", text: str = "text") -> DataFrame:
    """(key, sentence_index, section_index, section_title, section_sentence_index, text): all sentences of a
    document in order with their ordinals in the document and in the section."""
    x = sections.select(key, index, title, F.posexplode(t.split_sentences(text)).alias("section_sentence_index", "sentence"))
    w = Window.partitionBy(key).orderBy(index, "section_sentence_index")
    return x.select(key, (F.row_number().over(w) - 1).alias("sentence_index"), index, title, "section_sentence_index", F.col("sentence").alias("text"))


def section_spans(sentences: DataFrame, key: str, index: str = "section_index", title: str = "section_title") -> DataFrame:
    """(key, section_index, section_title, sentence_start, sentence_end, sentence_count): half-open spans."""
    g = sentences.groupBy(key, index).agg(F.min(title).alias(title), F.min("sentence_index").alias("sentence_start"), (F.max("sentence_index") + 1).alias("sentence_end"), F.count(F.lit(1)).alias("sentence_count"))
    return g


def merge_same_titles(sections: DataFrame, key: str, index: str, title: str, text: str) -> DataFrame:
    """(key, section_index, section_title, text, merged): titles made canonical, empty sections dropped,
    neighbours with one title merged, sections numbered anew."""
    w = Window.partitionBy(key).orderBy(index)
    x = sections.select(key, index, t.section_title(title).alias("title"), F.trim(F.coalesce(text, F.lit(""))).alias("text")).where("text <> ''")
    x = x.withColumn("new", F.coalesce((F.lag("title").over(w) != F.col("title")).cast("int"), F.lit(1)))
    x = x.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), "text")))
    g = x.groupBy(key, "run").agg(F.max("title").alias("section_title"), F.concat_ws("\n", F.transform(parts, lambda p: p["text"])).alias("text"), (F.count(F.lit(1)) - 1).alias("merged"))
    return g.select(key, (F.col("run") - 1).cast("int").alias("section_index"), "section_title", "text", "merged")


def masked_step(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the masked sentence and a map of reasons, of the ordered chain of masks; the context masks apply
    only where a stage or sequence has been masked. One projection a mask keeps the expressions flat."""
    x = df.withColumn("masked", t.normalize_line(text))
    names = []
    for name, pattern, put in MASKS:
        x = x.withColumns({f"_{name}": F.regexp_count("masked", F.lit(pattern)), "masked": F.regexp_replace("masked", pattern, put)})
        names.append(name)
    staged = F.col("masked").rlike(r"\[MASK_(?:STAGE|TNM|TNM_SEQUENCE)\]")
    x = x.withColumn("_staged", staged).withColumn("_context", F.col("masked"))
    for name, pattern, put in CONTEXT_MASKS:
        x = x.withColumns({f"_{name}": F.regexp_count("_context", F.lit(pattern)), "_context": F.regexp_replace("_context", pattern, put)})
    counts = [F.col(f"_{n}") for n in names] + [F.when(F.col("_staged"), F.col(f"_{n}")).otherwise(0) for n, _, _ in CONTEXT_MASKS]
    names += [n for n, _, _ in CONTEXT_MASKS]
    reasons = F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*counts)), lambda _, n: n > 0)
    out = F.when(F.col("_staged"), F.col("_context")).otherwise(F.col("masked"))
    out = F.regexp_replace(F.trim(F.regexp_replace(out, r"(?U)\s{2,}", " ")), r"\s+([,.;:])", "$1")
    return x.select(*df.columns, out.alias("masked"), reasons.alias("reasons"))


def has_stage_signal(c: Column) -> Column:
    x = t.normalize_line(c)
    out = F.lit(False)
    for p in STAGE_SIGNALS:
        out = out | x.rlike(p)
    return out


def has_keep_hint(c: Column) -> Column:
    return t.normalize_line(c).rlike(KEEP_HINTS)


def drops_without_diagnosis(title: Column) -> Column:
    """Whether a section is left out where the diagnosis must not show."""
    return t.section_title(title).rlike("(?iu)" + "|".join([DIAGNOSIS_TITLES, *OTHER_DROPPED_TITLES]))


def filter_sentences(sentences: DataFrame, mode: str, text: str = "text", title: str = "section_title") -> DataFrame:
    """The four filter modes over a sentence table: full; no_diagnosis leaves out sections; masked leaves out
    sentences that only tell the stage and masks the rest; no_diagnosis_masked leaves out sections and masks
    (it keeps sentences that only tell the stage, masked). Adds masked and reasons in the masked modes."""
    if mode not in ("full", "no_diagnosis", "masked", "no_diagnosis_masked"):
        raise ValueError(f"unknown filter mode {mode}")
    x = sentences
    if mode.startswith("no_diagnosis"):
        x = x.where(~drops_without_diagnosis(F.col(title)))
    if mode == "masked":
        x = x.where(~(has_stage_signal(F.col(text)) & ~has_keep_hint(F.col(text))))
    return masked_step(x, text) if mode.endswith("masked") else x


def reason_totals(masked: DataFrame) -> DataFrame:
    """(reason, n, sentences): how often each mask applied, over all sentences."""
    x = masked.select(F.explode("reasons").alias("reason", "n"))
    return x.groupBy("reason").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("sentences"))
