"""Queries of document cleaning, sectioning, splitting and masking."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import cleaning as c
from ..registry import query
from ..runtime import table

_NOISE = "|".join(p.replace("'", "''") for p in t.NOISE_PATTERNS)
_LINE = r"trim(regexp_replace(replace(replace({0}, chr(160), ' '), chr(8203), ''), '\s+', ' ', 'g'))"
_PAGES = "p AS (SELECT DISTINCT page_id, document_id, page_number, final_text FROM page_extractions WHERE final_text <> '')"
_LINES = rf"""
{_PAGES},
raw AS (SELECT page_id, document_id, page_number, unnest(string_split(final_text, chr(10))) AS raw, generate_subscripts(string_split(final_text, chr(10)), 1) - 1 AS line_no FROM p),
l AS (SELECT page_id, document_id, page_number, CAST(line_no AS INTEGER) AS line_no, {_LINE.format("raw")} AS line FROM raw),
n AS (SELECT *, line <> '' AND ((length(line) >= 16 AND regexp_matches(line, '^[I1l| ]+$')) OR regexp_matches(line, '(?i)^(?:{_NOISE})')
      OR (length(line) > 40 AND (length(line) - length(translate(line, 'I1l|', ''))) / length(line) > 0.65)) AS noise FROM l)
"""
_HEAD = "(length({0}) <= 70 AND {0} = upper({0}) AND regexp_matches({0}, '[A-Z]') AND {0} <> '')"
_JOIN = rf"""(prev <> '' AND line <> '' AND NOT {_HEAD.format("line")} AND NOT regexp_matches(line, '(?i)^(?:PART\s+\d+|[A-Z]\.|\d+[).:])') AND NOT suffix(prev, ':')
  AND (regexp_matches(prev, '[-/]$') OR (NOT regexp_matches(prev, '[.!?;)]$') AND regexp_matches(line, '^(?:\p{{Ll}}|[\d(<])'))))"""
_MERGED = rf"""{_LINES},
k AS (SELECT page_id, line_no, line, coalesce(lag(line) OVER w, '') AS prev FROM n WHERE NOT noise WINDOW w AS (PARTITION BY page_id ORDER BY line_no)),
j AS (SELECT *, {_JOIN} AS joins FROM k),
r AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY line_no) AS run, coalesce(lead(joins) OVER (PARTITION BY page_id ORDER BY line_no), false) AS next_joins FROM j),
s AS (SELECT page_id, run, line_no, CASE WHEN NOT joins OR suffix(prev, '-') THEN '' ELSE ' ' END || CASE WHEN next_joins AND suffix(line, '-') THEN regexp_replace(line, '-+$', '') ELSE line END AS piece FROM r),
m AS (SELECT page_id, min(line_no) AS line_no, string_agg(piece, '' ORDER BY line_no) AS line FROM s GROUP BY page_id, run)
"""


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_extractions").select("page_id", "document_id", "page_number", "final_text").where("final_text <> ''").distinct()


@query(f"WITH {_LINES} SELECT page_id, line_no, line FROM n WHERE noise")
def noise_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines without content on every page."""
    return c.explode_lines(_pages(spark, d), "page_id", "final_text").where(t.is_noise("line", normalised=True))


@query(f"WITH {_MERGED} SELECT page_id, line_no, line FROM m")
def merged_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of every page without noise, wrapped lines joined."""
    return c.merge_wrapped(c.drop_noise(c.explode_lines(_pages(spark, d), "page_id", "final_text")), "page_id").select("page_id", "line_no", "line")


@query(
    f"""WITH {_MERGED},
b AS (SELECT *, lag(line, 1, '') OVER (PARTITION BY page_id ORDER BY line_no) AS before,
  max(CASE WHEN line <> '' THEN 1 END) OVER (PARTITION BY page_id ORDER BY line_no) AS up, max(CASE WHEN line <> '' THEN 1 END) OVER (PARTITION BY page_id ORDER BY line_no DESC) AS down FROM m)
SELECT page_id, count(*) AS lines, count(*) FILTER (line = '') AS blanks, CAST(sum(length(line)) AS BIGINT) AS characters FROM b WHERE up = 1 AND down = 1 AND (line <> '' OR before <> '') GROUP BY page_id"""
)
def clean_page_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Lines, blank lines and characters of every cleaned page."""
    x = c.clean(_pages(spark, d), "page_id", "final_text")
    return x.groupBy("page_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("line") == "").alias("blanks"), F.sum(F.length("line")).alias("characters"))


@query(
    rf"""WITH {_LINES},
f AS (SELECT document_id, page_number, line, row_number() OVER (PARTITION BY document_id, page_number ORDER BY page_id, line_no) AS a, row_number() OVER (PARTITION BY document_id, page_number ORDER BY page_id DESC, line_no DESC) AS z FROM n
      WHERE line <> '' AND page_id IN (SELECT max(page_id) FROM p GROUP BY document_id, page_number)),
d AS (SELECT document_id, count(DISTINCT page_number) AS n FROM p GROUP BY document_id HAVING count(DISTINCT page_number) >= 3),
e AS (SELECT DISTINCT document_id, page_number, line FROM f WHERE (a <= 3 OR z <= 3) AND length(line) BETWEEN 4 AND 100 AND regexp_matches(line, '[\p{{L}}\p{{N}}]'))
SELECT e.document_id, e.line, count(*) AS pages FROM e JOIN d USING (document_id) GROUP BY e.document_id, e.line, d.n HAVING count(*) >= greatest(2, ceil(d.n * 0.6))"""
)
def margin_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that recur at the edges of a report's pages."""
    return c.repeated_margins(_pages(spark, d), "document_id", "page_number", "final_text")


@query(
    """WITH p AS (SELECT DISTINCT page_id, trim(coalesce(native_text, '')) AS n, trim(coalesce(final_text, '')) AS o FROM page_extractions)
SELECT page_id, CASE WHEN n = '' AND o = '' THEN 'empty' WHEN n = '' THEN 'ocr_only' WHEN o = '' THEN 'native_text' WHEN length(o) >= length(n) * 1.15 THEN 'ocr_fallback' WHEN n = o THEN 'native_text' ELSE 'native_plus_ocr' END AS strategy,
  CAST(CASE WHEN n = '' THEN length(o) WHEN o = '' THEN length(n) WHEN length(o) >= length(n) * 1.15 THEN length(o) WHEN n = o THEN length(n) ELSE length(n) + length(o) + 1 END AS INTEGER) AS characters FROM p"""
)
def page_choice(spark: SparkSession, d: str) -> DataFrame:
    """Which text of a page is used, and how long it is."""
    x = table(spark, d, "page_extractions").select("page_id", "native_text", "final_text").distinct().withColumn("x", t.choose_page_text("native_text", "final_text"))
    return x.select("page_id", "x.strategy", F.length("x.text").alias("characters"))


@query(
    r"""WITH p AS (SELECT DISTINCT page_id, regexp_replace(coalesce(final_text, ''), '^\s+|\s+$', '', 'g') AS x FROM page_extractions),
q AS (SELECT page_id, length(x) AS cc, length(regexp_replace(x, '\P{L}', '', 'g')) AS ac, length(regexp_replace(x, '\P{Nd}', '', 'g')) AS dc, list_filter(string_split(x, chr(10)), lambda s: trim(s) <> '') AS f FROM p)
SELECT page_id, CAST(cc AS INTEGER) AS char_count, CAST(ac AS INTEGER) AS alpha_count, CAST(dc AS INTEGER) AS digit_count, CAST(len(f) AS INTEGER) AS line_count,
  round(cc + ac * 0.5 + len(f) * 5 - len(list_filter(f, lambda s: length(trim(s)) >= 18 AND regexp_matches(trim(s), '^[I1l| ]+$'))) * 120 - dc * 0.05, 6) AS score,
  (cc < 80 OR CASE WHEN cc > 0 THEN ac / cc ELSE 0 END < 0.2) AS low FROM q"""
)
def page_quality(spark: SparkSession, d: str) -> DataFrame:
    """Counts and score of every page's text."""
    x = table(spark, d, "page_extractions").select("page_id", "final_text").distinct().withColumn("q", t.text_quality("final_text"))
    return x.select("page_id", "q.char_count", "q.alpha_count", "q.digit_count", "q.line_count", F.round("q.score", 6).alias("score"), t.is_low_text("final_text").alias("low"))


_RULES_SQL = " ".join(f"WHEN regexp_matches(line, '(?i)^(?:{r})') THEN '{n}'" for n, r in c.SECTION_RULES)
_REST_SQL = " ".join(f"WHEN regexp_matches(line, '(?i)^(?:{r})') THEN regexp_replace(regexp_replace(line, '(?i)^(?:{r})', ''), '^[ :-]+|[ :-]+$', '', 'g')" for _, r in c.SECTION_RULES)


@query(
    f"""WITH {_MERGED},
h AS (SELECT page_id, line_no, CASE {_RULES_SQL} END AS head, CASE {_REST_SQL} ELSE line END AS rest FROM m WHERE line <> ''),
g AS (SELECT *, count(head) OVER (PARTITION BY page_id ORDER BY line_no) AS part FROM h),
sc AS (SELECT page_id, part, coalesce(max(head), 'Document Body') AS section_title, string_agg(rest, chr(10) ORDER BY line_no) FILTER (rest <> '') AS text FROM g GROUP BY page_id, part)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY part) - 1 AS INTEGER) AS section_index, section_title, text FROM sc WHERE text IS NOT NULL"""
)
def rule_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of every cleaned page by heading rules."""
    x = c.merge_wrapped(c.drop_noise(c.explode_lines(_pages(spark, d), "page_id", "final_text")), "page_id")
    return c.sections_by_rules(x, "page_id")


@query()
def best_sections(spark: SparkSession, d: str) -> DataFrame:
    """The better of two parses of every page."""
    x = c.clean(_pages(spark, d), "page_id", "final_text")
    return c.best_sections(c.sections_by_rules(x, "page_id"), c.sections_generic(x, "page_id"), "page_id")


_DOT = "chr(1)"
SENTENCES = rf"""
s0 AS (SELECT DISTINCT section_id, document_id, section_index, section_title, text FROM sections WHERE text IS NOT NULL),
s1 AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(160), ' '), chr(8203), ''), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS x FROM s0),
s2 AS (SELECT *, list_filter(list_transform(regexp_split_to_array(x, '\n\s*\n+'), lambda p: trim(replace(p, chr(10), ' '))), lambda p: p <> '') AS ps FROM s1),
s3 AS (SELECT *, flatten(list_transform(ps, lambda p: list_filter(list_transform(string_split(regexp_replace({
    "regexp_replace(" + "".join("replace(" for _ in t.ABBREVIATIONS) + "p" + "".join(f", '{w}', '{w[:-1]}' || {_DOT})" for w in t.ABBREVIATIONS) + rf", '(\d)\.(\d)', '\1' || {_DOT} || '\2', 'g')"
}, '([.!?])\s+([A-Z0-9(\[])', '\1' || chr(2) || '\2', 'g'), chr(2)), lambda q: trim(replace(q, {_DOT}, '.'))), lambda q: q <> ''))) AS ss FROM s2),
sv AS (SELECT document_id, section_id, section_index, section_title, unnest(ss) AS text, generate_subscripts(ss, 1) - 1 AS section_sentence_index FROM s3)
"""


def sentences(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sections").select("section_id", "document_id", "section_index", "section_title", "text").where("text is not null").distinct()
    return s.select("document_id", "section_id", "section_index", "section_title", F.posexplode(t.split_sentences("text")).alias("section_sentence_index", "text"))


@query(
    f"""WITH {SENTENCES} SELECT document_id, section_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY section_index, section_id, section_sentence_index) - 1 AS INTEGER) AS sentence_index,
CAST(section_sentence_index AS INTEGER) AS section_sentence_index, length(text) AS characters FROM sv"""
)
def sentence_ordinals(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence of a report with its ordinals."""
    from pyspark.sql import Window

    w = Window.partitionBy("document_id").orderBy("section_index", "section_id", "section_sentence_index")
    return sentences(spark, d).select("document_id", "section_id", (F.row_number().over(w) - 1).alias("sentence_index"), "section_sentence_index", F.length("text").cast("long").alias("characters"))


@query(
    f"""WITH {SENTENCES}, o AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY section_index, section_id, section_sentence_index) - 1 AS i FROM sv)
SELECT document_id, section_id, min(i) AS sentence_start, max(i) + 1 AS sentence_end, count(*) AS sentence_count FROM o GROUP BY document_id, section_id"""
)
def section_spans(spark: SparkSession, d: str) -> DataFrame:
    """Half-open sentence spans of every section."""
    from pyspark.sql import Window

    w = Window.partitionBy("document_id").orderBy("section_index", "section_id", "section_sentence_index")
    x = sentences(spark, d).withColumn("i", F.row_number().over(w).cast("long") - 1)
    return x.groupBy("document_id", "section_id").agg(F.min("i").alias("sentence_start"), (F.max("i") + 1).alias("sentence_end"), F.count(F.lit(1)).alias("sentence_count"))


_SIGNAL = " OR ".join(f"regexp_matches(line, '{p.replace('(?iu)', '(?i)')}')" for p in c.STAGE_SIGNALS)
_PLAIN_MASKS = [(n, p.replace("(?iu)", "(?i)"), r) for n, p, r in c.MASKS if "(?<" not in p]


def _mask_sql() -> str:
    steps, last = [], "m0"
    for i, (_, p, r) in enumerate(_PLAIN_MASKS, 1):
        steps.append(f"m{i} AS (SELECT * EXCLUDE (x, counts), list_append(counts, len(regexp_extract_all(x, '{p}'))) AS counts, regexp_replace(x, '{p}', '{r}', 'g') AS x FROM m{i - 1})")
        last = f"m{i}"
    names = "[" + ", ".join(f"'{n}'" for n, _, _ in _PLAIN_MASKS) + "]"
    return f"{', '.join(steps)}, u AS (SELECT unnest({names}) AS reason, unnest(counts) AS n FROM {last}) SELECT reason, CAST(sum(n) AS BIGINT) AS n FROM u WHERE n > 0 GROUP BY reason"


def _with_stages(spark: SparkSession, d: str) -> DataFrame:
    """The sections' sentences and the stage strings of the labels, which the masks are for."""
    stages = table(spark, d, "labels").where("pathologic_stage is not null").select("case_id", "slide_id", F.col("pathologic_stage").alias("text")).distinct()
    return sentences(spark, d).select("section_title", "text").unionByName(stages.select(F.lit("Stage").alias("section_title"), "text"))


_STAGED = "sl AS (SELECT text FROM sv UNION ALL SELECT pathologic_stage FROM (SELECT DISTINCT case_id, slide_id, pathologic_stage FROM labels WHERE pathologic_stage IS NOT NULL))"


@query(f"WITH {SENTENCES}, {_STAGED}, m0 AS (SELECT {_LINE.format('text')} AS x, CAST([] AS BIGINT[]) AS counts FROM sl), {_mask_sql()}")
def mask_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often each mask that needs no look-behind applies in the sections' sentences and the stage strings."""
    x = _with_stages(spark, d).select(t.normalize_line("text").alias("x"))
    counts = []
    for name, pattern, put in c.MASKS:
        if "(?<" not in pattern:
            x = x.withColumns({name: F.regexp_count("x", F.lit(pattern)), "x": F.regexp_replace("x", pattern, put)})
            counts.append(name)
    totals = x.agg(*[F.sum(n).alias(n) for n in counts])
    return totals.unpivot([], counts, "reason", "n").where("n > 0")


@query(
    rf"""WITH {SENTENCES}, l AS (SELECT section_id, {_LINE.format("text")} AS line FROM sv)
SELECT section_id, count(*) AS sentences, count(*) FILTER ({_SIGNAL}) AS with_stage, count(*) FILTER (regexp_matches(line, '{c.KEEP_HINTS.replace("(?iu)", "(?i)")}')) AS with_hint,
count(*) FILTER (({_SIGNAL}) AND NOT regexp_matches(line, '{c.KEEP_HINTS.replace("(?iu)", "(?i)")}')) AS stage_only FROM l GROUP BY section_id"""
)
def stage_signals(spark: SparkSession, d: str) -> DataFrame:
    """Sentences that tell a stage, that give a reason to keep them, and that are dropped, per section."""
    x = sentences(spark, d).select("section_id", c.has_stage_signal(F.col("text")).alias("a"), c.has_keep_hint(F.col("text")).alias("b"))
    return x.groupBy("section_id").agg(F.count(F.lit(1)).alias("sentences"), F.count_if("a").alias("with_stage"), F.count_if("b").alias("with_hint"), F.count_if(F.col("a") & ~F.col("b")).alias("stage_only"))


@query()
def filter_modes(spark: SparkSession, d: str) -> DataFrame:
    """Sentences and characters that each filter mode leaves."""
    s = sentences(spark, d)
    out = None
    for mode in ("full", "no_diagnosis", "masked", "no_diagnosis_masked"):
        x = c.filter_sentences(s, mode)
        text = F.col("masked" if mode.endswith("masked") else "text")
        g = x.agg(F.count(F.lit(1)).alias("sentences"), F.sum(F.length(text)).alias("characters")).withColumn("mode", F.lit(mode))
        out = g if out is None else out.unionByName(g)
    assert out is not None
    return out


@query()
def mask_reasons(spark: SparkSession, d: str) -> DataFrame:
    """How often each mask applies in the whole chain, context masks included."""
    return c.reason_totals(c.masked_step(_with_stages(spark, d), "text"))


def _rule_sql(rule: str) -> str:
    """A title rule as SQL conditions; what must occur anywhere is a condition of its own."""
    anywhere = re.findall(r"\(\?=\.\*((?:[^()]|\([^()]*\))*)\)", rule)
    rest = re.sub(r"\(\?=\.\*(?:[^()]|\([^()]*\))*\)", "", rule)
    return " AND ".join(f"regexp_matches(upper(t), '{x}')" for x in [*anywhere, *([rest] if rest not in ("", "^") else [])])


_TITLE_SQL = (
    "CASE WHEN t = '' THEN '" + t.DEFAULT_TITLE + "' " + "".join(f"WHEN lower(t) = '{n.lower()}' THEN '{n}' " for n in t.CANONICAL_TITLES)
    + "".join(f"WHEN {_rule_sql(r)} THEN '{n}' " for r, n in t.TITLE_RULES)
    + f"WHEN (letters <= 4 AND (digits > 0 OR odd > 0)) OR (odd >= 2 AND digits >= 1) THEN '{t.DEFAULT_TITLE}' ELSE t END"
)
_TITLED = rf"""ti AS (SELECT *, regexp_replace(trim(regexp_replace(coalesce(section_title, ''), '[\s\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{3000}}]+', ' ', 'g')), '^[ :;,\-_/\\]+|[ :;,\-_/\\]+$', '', 'g') AS t FROM raw),
tj AS (SELECT *, length(regexp_replace(t, '\P{{L}}', '', 'g')) AS letters, length(regexp_replace(t, '\P{{Nd}}', '', 'g')) AS digits, length(regexp_replace(t, '[\p{{L}}\p{{N}}\s]', '', 'g')) AS odd FROM ti), tk AS (SELECT *, {_TITLE_SQL} AS title FROM tj)"""


@query(
    f"""WITH raw AS (SELECT DISTINCT document_id, section_index, section_title, text FROM sections), {_TITLED}, x AS (SELECT document_id, section_index, title, trim(coalesce(text, '')) AS text FROM tk WHERE trim(coalesce(text, '')) <> ''),
n AS (SELECT *, CASE WHEN lag(title) OVER (PARTITION BY document_id ORDER BY section_index) = title THEN 0 ELSE 1 END AS new FROM x), r AS (SELECT *, sum(new) OVER (PARTITION BY document_id ORDER BY section_index ROWS UNBOUNDED PRECEDING) AS run FROM n)
SELECT document_id, CAST(run - 1 AS INTEGER) AS section_index, max(title) AS section_title, string_agg(text, chr(10) ORDER BY section_index, text) AS text, count(*) - 1 AS merged FROM r GROUP BY document_id, run"""
)
def merged_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections with canonical titles, neighbours of one title merged."""
    s = table(spark, d, "sections").select("document_id", "section_index", "section_title", "text").distinct()
    return c.merge_same_titles(s, "document_id", "section_index", "section_title", "text")


@query(
    r"""WITH l AS (SELECT DISTINCT case_id, slide_id, pathologic_stage AS p, upper(regexp_extract(regexp_replace(coalesce(pathologic_stage, ''), '\s+', ' ', 'g'), '(?i)\bstage\s+([IVX0-9]+[A-D]?)\b', 1)) AS k FROM labels)
SELECT case_id, slide_id, p AS pathologic_stage, CAST(CASE WHEN regexp_matches(k, '^(?:III|IV)') THEN 1 WHEN regexp_matches(k, '^I') THEN 0 END AS INTEGER) AS stage_label FROM l"""
)
def stage_labels(spark: SparkSession, d: str) -> DataFrame:
    """Binary labels of the stage strings."""
    x = table(spark, d, "labels").select("case_id", "slide_id", "pathologic_stage").distinct()
    return x.withColumn("stage_label", t.stage_label("pathologic_stage"))


@query(
    r"""WITH s AS (SELECT DISTINCT section_title AS raw FROM sections),
n AS (SELECT raw, lower(regexp_replace(regexp_replace(trim(regexp_replace(coalesce(raw, ''), '\s+', ' ', 'g')), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS k FROM s)
SELECT k AS title_key, count(*) AS written FROM n GROUP BY k"""
)
def title_keys(spark: SparkSession, d: str) -> DataFrame:
    """Section titles as keys, with the number of ways they are written."""
    x = table(spark, d, "sections").select("section_title").distinct()
    return x.groupBy(t.key_of("section_title").alias("title_key")).agg(F.count(F.lit(1)).alias("written"))


@query(f"WITH raw AS (SELECT DISTINCT section_id, section_title FROM sections), {_TITLED} SELECT title, count(*) AS sections FROM tk GROUP BY title")
def canonical_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections per canonical title by the rule list."""
    x = table(spark, d, "sections").select("section_id", "section_title").distinct()
    return x.groupBy(t.section_title("section_title").alias("title")).agg(F.count(F.lit(1)).alias("sections"))


@query(
    """WITH r AS (SELECT DISTINCT document_id, file_name, source_path FROM reports),
x AS (SELECT *, regexp_replace(regexp_replace(replace(file_name, chr(92), '/'), '^.*/', ''), '\\.[^.]*$', '') AS stem FROM r)
SELECT document_id, CASE WHEN regexp_extract(stem, '(?i)TCGX-[A-Z0-9-]+', 0) <> '' THEN upper(regexp_extract(stem, '(?i)TCGX-[A-Z0-9-]+', 0)) ELSE stem END AS case_key,
  list_filter(list_transform(string_split(replace(source_path, chr(92), '/'), '/'), lambda p: upper(p)), lambda p: p IN ('BRCA', 'KIRC', 'LUSC'))[1] AS path_dataset FROM x"""
)
def report_keys(spark: SparkSession, d: str) -> DataFrame:
    """Case id and data set as the file name and path tell them."""
    x = table(spark, d, "reports").select("document_id", "file_name", "source_path").distinct()
    return x.select("document_id", t.case_id("file_name", prefix="TCGX").alias("case_key"), t.dataset_of("source_path", ("BRCA", "KIRC", "LUSC")).alias("path_dataset"))
