"""Sinks. All write through Spark's committers, so a lost task leaves nothing half written."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import sanitize

MANIFEST_COLUMNS = (
    "case_id", "slide_id", "label", "split", "dataset", "report_id", "file_name", "filter_mode", "graph_pt", "graph_json", "source_embedding_pt", "source_concept_json",
    "source_sentence_view_json", "source_preprocessed_json", "source_pdf", "node_count", "edge_count", "section_count", "sentence_count", "concept_count", "has_concept_level", "image_pt", "image_exists",
)


def clean_json(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """JSON with sanitised strings; only partitions that the data have are replaced."""
    out = df.select(*[sanitize(c).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])
    w = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(*partition_by) if partition_by else w).json(path)


def csv_table(df: DataFrame, path: str, columns: tuple[str, ...] | None = None) -> None:
    """CSV with a header and fixed columns; missing columns and nulls are empty."""
    cols = columns or tuple(df.columns)
    out = df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in cols]).na.fill("")
    out.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def sentence_text(sentences: DataFrame, doc: str) -> DataFrame:
    """(doc, text): a document's sentences to be read: its titles as blocks, numbered lines, empty ones marked."""
    w = Window.partitionBy(doc).orderBy("sentence_index")
    x = sentences.withColumn("head", F.coalesce(F.lag("section_title").over(w) != F.col("section_title"), F.lit(True)))
    line = F.format_string("%04d\t%s", F.col("sentence_index"), F.when(F.trim("text") == "", "[EMPTY]").otherwise(F.col("text")))
    piece = F.when(F.col("head"), F.concat(F.lit("["), "section_title", F.lit("]\n"), line)).otherwise(line)
    parts = F.array_sort(F.collect_list(F.struct("sentence_index", "p")))
    return x.withColumn("p", piece).groupBy(doc).agg(F.array_join(F.transform(parts, lambda s: s["p"]), "\n").alias("text"))


def stage_summary(rows: DataFrame, dataset: str = "dataset", status: str = "status") -> DataFrame:
    """(dataset, total, success, failed, skipped) of a stage's per-document rows."""
    k = F.coalesce(F.nullif(F.trim(dataset), F.lit("")), F.lit("UNKNOWN"))
    return rows.groupBy(k.alias("dataset")).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(status) == s).alias(s) for s in ("success", "failed", "skipped")])


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown; more than ``most`` rows are an error, as such a report has a bounded size."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows for a Markdown table")
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns) + "\n"
    return head + "".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |\n" for r in got)


def append_records(records: DataFrame, path: str, checkpoint: str | None = None) -> Any:
    """Records as JSON lines after those that are there; of a stream the running query is returned."""
    if records.isStreaming:
        return records.writeStream.format("json").outputMode("append").option("checkpointLocation", checkpoint or f"{path}/_checkpoint").start(path)
    records.write.mode("append").json(path)
    return None


def compact_log(records: DataFrame, fields: Sequence[str] = ("target.analysis.sample_details",)) -> DataFrame:
    """Log records without the given nested fields; a field that a log has not is no error."""

    def has(t: Any, parts: list[str]) -> bool:
        for p in parts:
            if not isinstance(t, StructType) or p not in t.names:
                return False
            t = t[p].dataType
        return True

    out = records
    for f in fields:
        top, *rest = f.split(".")
        if has(records.schema, [top, *rest]):
            out = out.withColumn(top, F.col(top).dropFields(".".join(rest))) if rest else out.drop(top)
    return out
