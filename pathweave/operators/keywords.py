"""Keyword rules over sentences, and filters of concept names."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Keyword, category, pattern (matched without regard to case) and weight.
RULES: tuple[tuple[str, str, str, float], ...] = (
    ("tnm_code", "tnm", r"\b[ypra]?[tnm](?:is|x|[0-4][a-d]?)(?:\([a-z+]+\))?\b", 1.4),
    ("ajcc_stage", "stage", r"\b(?:ajcc\s*)?stage\s*(?:0|i{1,3}|iv|[1-4])\s*[abc]?\b", 1.5),
    ("pathologic_stage", "stage", r"\bpatholog(?:ic|ical)?\s+stage\b", 1.5),
    ("tnm", "stage", r"\btnm\b", 1.3),
    ("tumor", "tumor", r"\btumou?r\b", 1.0),
    ("carcinoma", "tumor", r"\bcarcinoma\b", 1.0),
    ("adenocarcinoma", "tumor", r"\badenocarcinoma\b", 1.0),
    ("squamous_cell_carcinoma", "tumor", r"\bsquamous\s+cell\s+carcinoma\b", 1.1),
    ("clear_cell", "tumor", r"\bclear\s+cell\b", 1.0),
    ("invasive", "invasion", r"\binvas(?:ive|ion|ion[s]?)\b", 1.2),
    ("microinvasion", "invasion", r"\bmicroinvas(?:ion|ive)\b", 1.2),
    ("lymphovascular_invasion", "invasion", r"\blymphovascular\s+invasion\b", 1.5),
    ("vascular_invasion", "invasion", r"\bvascular\s+invasion\b", 1.3),
    ("perineural_invasion", "invasion", r"\bperineural\s+invasion\b", 1.2),
    ("pleural_invasion", "invasion", r"\b(?:visceral\s+)?pleural\s+invasion\b", 1.3),
    ("extension", "invasion", r"\bextension\b", 1.0),
    ("extracapsular_extension", "invasion", r"\bextracapsular\s+extension\b", 1.3),
    ("metastasis", "metastasis", r"\bmetasta(?:sis|tic|ses|sized|size)\b", 1.4),
    ("lymph_node", "node", r"\blymph\s+node[s]?\b", 1.4),
    ("sentinel_node", "node", r"\bsentinel\s+(?:lymph\s+)?node[s]?\b", 1.3),
    ("nodal", "node", r"\bnodal\b", 1.2),
    ("extranodal_extension", "node", r"\bextranodal\s+extension\b", 1.3),
    ("margin", "margin", r"\bmargin[s]?\b", 1.1),
    ("positive", "status", r"\bpositive\b", 0.9),
    ("negative", "status", r"\bnegative\b", 0.9),
    ("involved", "status", r"\binvolved\b", 1.0),
    ("uninvolved", "status", r"\buninvolved\b", 1.0),
    ("grade", "grade", r"\b(?:histologic\s+|nuclear\s+|nottingham\s+|fuhrman\s+)?grade\s*(?:[1-4]|i{1,3}|iv)?\b", 1.2),
    ("differentiation", "grade", r"\b(?:well|moderately|poorly)\s+differentiated\b", 1.0),
    ("size", "size", r"\b(?:size|dimension|diameter|greatest\s+dimension)\b", 1.0),
    ("measurement", "size", r"\b\d+(?:\.\d+)?\s*(?:cm|mm)\b", 1.0),
    ("depth", "size", r"\bdepth\b", 0.9),
    ("necrosis", "aggressive_feature", r"\bnecrosis\b", 0.9),
    ("sarcomatoid", "aggressive_feature", r"\bsarcomatoid\b", 1.1),
    ("rhabdoid", "aggressive_feature", r"\brhabdoid\b", 1.1),
    ("renal_vein", "anatomic_extent", r"\brenal\s+vein\b", 1.2),
    ("sinus", "anatomic_extent", r"\b(?:renal\s+)?sinus\b", 1.1),
    ("perirenal_fat", "anatomic_extent", r"\bperirenal\s+fat\b", 1.1),
    ("adrenal", "anatomic_extent", r"\badrenal\b", 0.9),
    ("chest_wall", "anatomic_extent", r"\bchest\s+wall\b", 1.1),
    ("skin", "anatomic_extent", r"\bskin\b", 0.8),
    ("nipple", "anatomic_extent", r"\bnipple\b", 0.8),
)
#: Rules whose matched text is itself the keyword.
OPEN_RULES = ("tnm_code", "ajcc_stage", "measurement")

# Concept names that are too general, that give a stage away, that count as evidence, that do not.
GENERIC_NAMES = ("disease", "neoplasm", "patient", "procedure", "finding", "clinical finding", "body structure", "anatomical structure", "anatomic structure")
LEAKING_NAMES = ("stage", "staging", "pathologic stage", "pathological stage", "tnm", "ajcc", "grade")
EVIDENCE = (
    "tumor size", "size", "invasion", "invasive", "lymph node", "lymph nodes", "lymphatic", "nodal", "margin", "margins", "metastasis", "metastatic", "anatomic extent", "extension", "extranodal", "capsule",
    "vascular invasion", "lymphovascular invasion", "perineural invasion",
)
NO_EVIDENCE = ("estrogen receptor", "progesterone receptor", "hormone receptor", " er ", " pr ", "her2", "immunohistochemistry", "procedure", "mastectomy", "biopsy", "carcinoma", "adenocarcinoma", "neoplasm")
LEAKING_CODE = r"(?i)\b(?:pt?[1-4][a-z]?|n[0-3][a-z]?|m[01][a-z]?|t[1-4][a-z]?)\b"


def _quoted(words: Sequence[str]) -> str:
    return "|".join(re.escape(w) for w in words)


def squeezed(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))


def is_denied(name: Column, generic: Sequence[str] = GENERIC_NAMES, leaking: Sequence[str] = LEAKING_NAMES) -> Column:
    """Whether a concept's name is a general term or ends with one, contains a stage term, or a stage code."""
    x = squeezed(name)
    return x.rlike(rf"(?:^| )(?:{_quoted(generic)})$") | x.rlike(_quoted(leaking)) | x.rlike(LEAKING_CODE)


def is_evidence(name: Column, keywords: Sequence[str] = EVIDENCE, deny: Sequence[str] = NO_EVIDENCE) -> Column:
    """Whether a concept's name holds an evidence term and none of the denied words."""
    x = F.concat(F.lit(" "), squeezed(name), F.lit(" "))
    no = "|".join(re.escape(w if w != w.strip() else f" {w} ") for w in deny)
    return ~x.rlike(no) & x.rlike(_quoted(keywords))


def counts(df: DataFrame, keys: list[str], text: str, rules: Sequence[tuple[str, str, str, float]] = RULES) -> DataFrame:
    """(keys, keyword, category, weight, n): matches of every rule in every text; stays in the JVM."""
    per = F.array(*[F.struct(F.lit(k).alias("keyword"), F.lit(c).alias("category"), F.lit(w).alias("weight"), F.regexp_count(text, F.lit("(?i)" + p)).alias("n")) for k, c, p, w in rules])
    x = df.where(F.col(text).isNotNull()).select(*keys, F.explode(F.filter(per, lambda r: r["n"] > 0)).alias("r"))
    return x.select(*keys, "r.keyword", "r.category", "r.weight", "r.n")


def spans(df: DataFrame, key: str, text: str, rules: Sequence[tuple[str, str, str, float]] = RULES) -> DataFrame:
    """(key, keyword, category, weight, start_char, end_char, matched): every match with its place; of the same
    keyword at the same place the first rule's."""
    compiled = [(k, c, re.compile(p, re.IGNORECASE), w) for k, c, p, w in rules]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b["key"], b["text"]):
                seen = set()
                for name, cat, p, w in compiled:
                    for m in p.finditer(t):
                        word = re.sub(r"\s+", "_", m.group().lower()) if name in OPEN_RULES else name
                        if (word, m.span()) not in seen:
                            seen.add((word, m.span()))
                            rows.append((i, word, cat, w, m.start(), m.end(), m.group()))
            yield pd.DataFrame(rows, columns=["key", "keyword", "category", "weight", "start_char", "end_char", "matched"])

    x = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where("key is not null and text is not null")
    out = x.mapInPandas(run, "key long, keyword string, category string, weight double, start_char int, end_char int, matched string")
    return out.withColumnRenamed("key", key)


def per_text(found: DataFrame, key: str) -> DataFrame:
    """(key, keyword, category, n, weight, first): a keyword once a text, with its count and its first form."""
    return found.groupBy(key, "keyword", "category").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight"), F.min_by("matched", F.struct("start_char", "end_char")).alias("first"))


def select_texts(df: DataFrame, key: str, found: DataFrame, least: int = 1) -> DataFrame:
    """Rows of ``df`` with at least ``least`` different keywords."""
    return df.join(found.groupBy(key).agg(F.count_distinct("keyword").alias("_n")).where(F.col("_n") >= least).select(key), key, "left_semi")


def word_graph(sentences: DataFrame, found: DataFrame, doc: str, least: int = 1, keep_all: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, states) of the graph of documents, sections, sentences and keywords. ``sentences`` are rows
    (doc, section, sentence_index), ``found`` rows (doc, sentence_index, keyword, weight), a keyword once a sentence.

    Sentences without keyword are left out unless ``keep_all``; sections and sentences are numbered anew. Nodes are
    (doc, node_index, node_type, level, section, sentence, keyword); a word node stands for a keyword in a sentence.
    Edges (doc, source, target, edge_type, weight) are parent edges down to the words, whose weight is the keyword's,
    and next edges between neighbours of a level, words within their sentence. States (doc, state) are 'ok',
    'no_stage_keywords' (fewer than ``least`` different ones) or 'no_keyword_sentences'."""
    per = found.groupBy(doc).agg(F.count_distinct("keyword").alias("_k"))
    kept = sentences if keep_all else sentences.join(found.select(doc, "sentence_index").distinct(), [doc, "sentence_index"], "left_semi")
    n = kept.groupBy(doc).agg(F.count(F.lit(1)).alias("_n"))
    states = sentences.select(doc).distinct().join(per, doc, "left").join(n, doc, "left").na.fill(0, ["_k", "_n"])
    states = states.select(doc, F.when(F.col("_k") < least, "no_stage_keywords").when(F.col("_n") == 0, "no_keyword_sentences").otherwise("ok").alias("state"))
    ok = states.where("state = 'ok'").select(doc)
    w = Window.partitionBy(doc).orderBy("sentence_index")
    s = kept.join(ok, doc, "left_semi").withColumn("sentence", F.row_number().over(w) - 1)
    first = s.groupBy(doc, "section").agg(F.min("sentence").alias("_first"))
    first = first.withColumn("new_section", F.row_number().over(Window.partitionBy(doc).orderBy("_first")) - 1)
    s = s.join(first, [doc, "section"]).select(doc, "sentence_index", "sentence", "new_section")
    words = found.join(s, [doc, "sentence_index"]).withColumn("_o", F.row_number().over(Window.partitionBy(doc).orderBy("sentence", "keyword")) - 1)
    none = F.lit(None)
    row = lambda df, kind, level, order, sec, sen, kw, weight: df.select(doc, F.lit(kind).alias("node_type"), F.lit(level).alias("level"), order.alias("_o"), sec.alias("section"), sen.alias("sentence"), kw.alias("keyword"), weight.alias("_w"))
    i, text, one = none.cast("int"), none.cast("string"), F.lit(1.0)
    all_ = row(ok, "document", 0, F.lit(0), i, i, text, one)
    all_ = all_.unionByName(row(first.select(doc, "new_section"), "section", 1, F.col("new_section"), F.col("new_section"), i, text, one))
    all_ = all_.unionByName(row(s, "sentence", 2, F.col("sentence"), F.col("new_section"), F.col("sentence"), text, one))
    all_ = all_.unionByName(row(words, "word", 3, F.col("_o"), F.col("new_section"), F.col("sentence"), F.col("keyword"), F.col("weight").cast("double")))
    nodes = all_.withColumn("node_index", F.row_number().over(Window.partitionBy(doc).orderBy("level", "_o")) - 1)
    at = lambda kind, *keys: nodes.where(F.col("node_type") == kind).select(doc, *keys, F.col("node_index").alias("source"))
    down = lambda kind, *keys: nodes.where(F.col("node_type") == kind).select(doc, *keys, F.col("node_index").alias("target"), F.col("_w").alias("weight"))
    edges = at("document").join(down("section"), doc).unionByName(at("section", "section").join(down("sentence", "section"), [doc, "section"]).drop("section"))
    edges = edges.unionByName(at("sentence", "sentence").join(down("word", "sentence"), [doc, "sentence"]).drop("sentence")).select(doc, "source", "target", F.lit("parent").alias("edge_type"), "weight")
    inside = F.when(F.col("node_type") == "word", F.col("sentence"))
    nxt = nodes.where("level > 0").withColumn("target", F.lead("node_index").over(Window.partitionBy(doc, "node_type", inside).orderBy("_o"))).where("target is not null")
    edges = edges.unionByName(nxt.select(doc, F.col("node_index").alias("source"), "target", F.lit("next").alias("edge_type"), F.lit(0.25).alias("weight")))
    return nodes.drop("_o", "_w"), edges, states
