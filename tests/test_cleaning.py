"""Hand-worked cases of cleaning, splitting and masking."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pathweave.functions import text as t
from pathweave.operators import cleaning as c


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


def merged(spark, lines):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "k int, line_no int, line string")
    return [r["line"] for r in c.merge_wrapped(df, "k").orderBy("line_no").collect()]


@pytest.mark.parametrize(
    "lines,expected",
    [
        (["infil-", "trating tumor"], ["infiltrating tumor"]),
        (["Done.", "next"], ["Done.", "next"]),
        (["Size:", "3 cm"], ["Size:", "3 cm"]),
        (["the tumor", "is large", "", "and", "more"], ["the tumor is large", "", "and more"]),
        (["one/", "Two"], ["one/ Two"]),
        (["text", "GROSS"], ["text", "GROSS"]),
        (["a-", "b-", "c"], ["abc"]),
    ],
)
def test_wrapped_lines(spark, lines, expected):
    assert merged(spark, lines) == expected


def test_noise(spark):
    df = spark.createDataFrame([("Page 1 of 3",), ("Review pending",), ("Kept",), ("",), ("I1l| I1l| I1l| I1l|",), (None,)], "x string")
    assert [r["n"] for r in df.select(t.is_noise("x").alias("n")).collect()] == [True, True, False, False, True, False]


def test_sentences(spark):
    assert one(spark, t.split_sentences, "Dr. A saw 3.5 cm. Next one? Yes.") == ["Dr. A saw 3.5 cm. Next one?", "Yes."]
    assert one(spark, t.split_sentences, None) == [] and one(spark, t.split_sentences, " \n ") == []
    assert one(spark, t.split_sentences, "one line\nmore\n\nSecond. Third") == ["one line more", "Second.", "Third"]


@pytest.mark.parametrize("text,masked,reason", [("AJCC stage: IIA", "[MASK_STAGE]", "ajcc_stage"), ("pathologic stage IIA", "[MASK_STAGE]IIA", "pathologic_tnm_stage_heading"), ("pT2 found", "[MASK_T] found", "t_category")])
def test_masks(spark, text, masked, reason):
    r = c.masked_step(spark.createDataFrame([(text,)], "text string"), "text").first()
    assert r["masked"] == masked and r["reasons"] == {reason: 1}


def test_filter_modes(spark, rows):
    s = spark.createDataFrame([("Diagnosis", "Stage II."), ("Comment", "Stage II, margin clear."), ("Comment", "Stage II."), ("Comment", "Plain.")], "section_title string, text string")
    assert c.filter_sentences(s, "full").count() == 4
    assert c.filter_sentences(s, "no_diagnosis").count() == 3
    assert rows(c.filter_sentences(s, "masked"), "masked") == [("Plain.",), ("[MASK_STAGE], margin clear.",)]
    assert c.filter_sentences(s, "no_diagnosis_masked").count() == 3
    with pytest.raises(ValueError):
        c.filter_sentences(s, "other")


def test_page_choice(spark):
    df = spark.createDataFrame([("x" * 100, "y" * 115), ("x" * 100, "y" * 114), ("a", None), (None, "b"), (None, None), ("s", "s")], "n string, o string")
    assert [r["s"]["strategy"] for r in df.select(t.choose_page_text("n", "o").alias("s")).collect()] == ["ocr_fallback", "native_plus_ocr", "native_text", "ocr_only", "empty", "native_text"]


@pytest.mark.parametrize("stage,label", [("Stage IIB", 0), ("Stage IIIA", 1), ("stage iv", 1), ("Stage X", None), ("Stage 2", None), (None, None), ("", None), ("Stage I", 0)])
def test_stage_labels(spark, stage, label):
    assert one(spark, t.stage_label, stage) == label


def test_margins_need_three_pages(spark, rows):
    page = lambda d, n, *ls: (d, n, "\n".join(ls))
    data = [page("a", 1, "Head", "body one", "x1"), page("a", 2, "Head", "body two", "x2"), page("a", 3, "Other", "body three", "x3"), page("a", 3, "Other", "body three", "x3"), page("b", 1, "Same"), page("b", 2, "Same")]
    assert rows(c.repeated_margins(spark.createDataFrame(data, "d string, p int, text string"), "d", "p", "text")) == [("a", "Head", 2)]


def test_sections(spark, rows):
    df = spark.createDataFrame([("d", "intro\nGROSS DESCRIPTION: big\nred\n\nFINAL DIAGNOSIS\nCOMMENT\nfine")], "k string, text string")
    lines = c.explode_lines(df, "k", "text")
    assert rows(c.sections_by_rules(lines, "k"), "section_index", "section_title", "text") == [(0, "Document Body", "intro"), (1, "Gross Description", "big\nred"), (2, "Comment", "fine")]
    g = c.sections_generic(spark.createDataFrame([("d", i, x) for i, x in enumerate(["GROSS DESCRIPTION: big", "red", "", "SYNOPTIC REPORT", "a", "", "COMMENT", "b"])], "k string, line_no int, line string"), "k")
    assert rows(g, "section_title", "text") == [("Gross Description", "big\nred"), ("Synoptic Report", "a\n\nCOMMENT\nb")]
    assert rows(c.best_sections(c.sections_by_rules(lines, "k"), c.sections_generic(lines, "k"), "k"), "parser")[0] == ("rule_based",)


def test_merge_same_titles(spark, rows):
    df = spark.createDataFrame([("d", 0, "FINAL DIAGNOSIS", "a"), ("d", 1, "Final Diagnosis", "b"), ("d", 2, "x", None), ("d", 3, "COMMENT", "c")], "k string, i int, title string, text string")
    assert rows(c.merge_same_titles(df, "k", "i", "title", "text")) == [("d", 0, "Final Diagnosis", "a\nb", 1), ("d", 1, "Comment", "c", 0)]


def test_empty_tables(spark):
    e = spark.createDataFrame([], "k string, text string")
    assert c.clean(e, "k", "text").count() == c.sections_by_rules(c.explode_lines(e, "k", "text"), "k").count() == 0
