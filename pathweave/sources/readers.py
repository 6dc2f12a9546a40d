"""Readers of the file formats that feed the engine. Every one declares its schema and stays lazy."""

from __future__ import annotations

import os
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABELS = T.StructType([T.StructField("case_id", T.StringType()), T.StructField("slide_id", T.StringType()), T.StructField("label", T.IntegerType())])
RUN_EVENTS = "type STRING, epoch INT, best_epoch INT, train MAP<STRING,DOUBLE>, target STRUCT<acc:DOUBLE,auc:DOUBLE>, best_metric_so_far DOUBLE, early_stop BOOLEAN, _corrupt_record STRING"
CONCEPT = "id STRING, concept_id STRING, name STRING, synonyms ARRAY<STRING>, parents ARRAY<STRING>, ic DOUBLE, xrefs MAP<STRING,ARRAY<STRING>>, source_terminology STRING, match_enabled BOOLEAN, definition STRING"
SENTENCE_VIEW = (
    "document_id STRING, source_json STRING, dataset STRING, sections ARRAY<STRUCT<section_index:INT,section_title:STRING,sentence_start:INT,sentence_end:INT,sentence_count:INT>>, "
    "sentence_records ARRAY<STRUCT<sentence_index:INT,section_index:INT,section_title:STRING,section_sentence_index:INT,text:STRING>>"
)


def files(spark: SparkSession, root: str, extension: str) -> DataFrame:
    """(path, length, modificationTime, content) of all files below ``root``, whatever the case of the extension."""
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in extension)
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)


def json_documents(spark: SparkSession, root: str, schema: str = SENTENCE_VIEW, skip: tuple[str, ...] = ("run_summary.json",)) -> DataFrame:
    """One row a JSON file below ``root``, summaries left out, with the file's path."""
    d = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root)
    name = F.col("_metadata.file_name")
    d = d.select("*", F.col("_metadata.file_path").alias("path"), name.alias("_name"))
    return d.where(~F.col("_name").isin(*skip) & ~F.col("_name").startswith("pipeline_run_summary_")).drop("_name")


def ontology(spark: SparkSession, path: str) -> DataFrame:
    """Concepts of a JSON ontology in any of its three shapes: an object by id, an object with a list of concepts,
    or a list. Items that are no objects and items without an id are left out."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("j"))
    as_list = F.from_json("j", f"ARRAY<STRUCT<{_struct(CONCEPT)}>>")
    inner = F.coalesce(F.get_json_object("j", "$.concepts"), F.col("j"))
    as_map = F.map_values(F.map_zip_with(F.from_json(inner, f"MAP<STRING,STRUCT<{_struct(CONCEPT)}>>"), F.from_json(inner, "MAP<STRING,STRING>"), lambda k, a, b: a.withField("id", F.coalesce(a["id"], a["concept_id"], k))))
    items = F.when(F.ltrim("j").startswith("["), as_list).when(F.ltrim(inner).startswith("["), F.from_json(inner, f"ARRAY<STRUCT<{_struct(CONCEPT)}>>")).otherwise(as_map)
    x = raw.select(F.explode(items).alias("c")).where("c is not null").select("c.*")
    return x.withColumn("id", F.coalesce("id", "concept_id")).drop("concept_id").where("trim(id) <> ''").withColumn("match_enabled", F.coalesce("match_enabled", F.lit(True)))


def _struct(ddl: str) -> str:
    out, depth, word = [], 0, ""
    for ch in ddl + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            name, kind = word.strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            word = ""
        else:
            word += ch
    return ",".join(out)


def owl_classes(spark: SparkSession, path: str, class_tag: str = "owl:Class") -> DataFrame:
    """One row an OWL class of an RDF/XML file, with attributes and children as the file has them."""
    return spark.read.format("xml").option("rowTag", class_tag).load(path)


def umls_names(spark: SparkSession, path: str, concepts: DataFrame | None = None) -> DataFrame:
    """(cui, source, code) of English rows of a pipe-delimited name file; of ``concepts`` (cui) only if given."""
    raw = spark.read.text(path).select(F.split("value", r"\|").alias("f")).where((F.size("f") >= 15) & (F.col("f")[1] == "ENG"))
    x = raw.select(F.col("f")[0].alias("cui"), F.col("f")[11].alias("source"), F.col("f")[13].alias("code"))
    keep = (F.col("source").isin("NCI", "NCIT") & F.col("code").rlike(r"^C\d+$")) | (F.col("source").startswith("SNOMEDCT") & F.col("code").rlike(r"^\d+$")) | (F.col("code").startswith("DOID"))
    x = x.where(keep).distinct()
    return x.join(concepts.select("cui").distinct(), "cui", "left_semi") if concepts is not None else x


def snomed_active(spark: SparkSession, path: str) -> DataFrame:
    """(concept_id) of the active rows of a tab-separated concept snapshot."""
    d = spark.read.csv(path, sep="\t", header=True, quote="")
    return d.where(F.col(d.columns[2]) == "1").select(F.col(d.columns[0]).alias("concept_id"))


def snomed_descriptions(spark: SparkSession, path: str, active: DataFrame) -> DataFrame:
    """(concept_id, term, is_full_name, tag): active English descriptions of active concepts; a full name is split
    into term and semantic tag."""
    d = spark.read.csv(path, sep="\t", header=True, quote="")
    c = d.columns
    x = d.where((F.col(c[2]) == "1") & (F.col(c[5]) == "en")).select(F.col(c[4]).alias("concept_id"), F.col(c[6]).alias("type"), F.trim(c[7]).alias("raw")).join(active, "concept_id", "left_semi")
    full = F.col("type") == "900000000000003001"
    tag = F.when(full, F.regexp_extract("raw", r"\(([^()]*)\)\s*$", 1)).otherwise("")
    return x.select("concept_id", F.when(full, F.trim(F.regexp_replace("raw", r"\s*\([^()]*\)\s*$", ""))).otherwise(F.col("raw")).alias("term"), full.alias("is_full_name"), tag.alias("tag"))


def clinical_stages(spark: SparkSession, root: str) -> DataFrame:
    """(case_id, stage): barcode and stage of clinical XML files by local element name; of several files of a case
    the last path counts. Files that are no XML are left out."""
    x = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.xml").select("value", F.col("_metadata.file_path").alias("path"))
    x = x.where(F.col("value").rlike(r"^\s*(?:<\?xml|<\w)") & F.col("value").rlike(r">\s*$"))
    first = lambda n: F.trim(F.regexp_extract("value", rf"<(?:[\w.-]+:)?{n}\b[^>/]*>\s*([^<\s][^<]*)<", 1))
    x = x.select(F.upper(first("bcr_patient_barcode")).alias("case_id"), first("pathologic_stage").alias("stage"), "path").where("case_id <> ''")
    return x.groupBy("case_id").agg(F.max_by("stage", "path").alias("stage"))


def labels_csv(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, slide_id, label); a file without these columns is an error."""
    d = spark.read.csv(path, header=True, encoding="UTF-8")
    names = {c.lstrip("﻿").strip(): c for c in d.columns}
    missing = [f.name for f in LABELS if f.name not in names]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    return d.select(*[F.trim(F.col(f"`{names[f.name]}`")).cast(f.dataType).alias(f.name) for f in LABELS])


def splits_csv(spark: SparkSession, path: str) -> DataFrame:
    """(kind, key, split) of a split file in any of three layouts: slide and split, case and split, or a column of
    slides for each split."""
    d = spark.read.csv(path, header=True, encoding="UTF-8")
    d = d.toDF(*[c.lstrip("﻿").strip() for c in d.columns])
    for kind in ("slide", "case"):
        if {f"{kind}_id", "split"} <= set(d.columns):
            return d.select(F.lit(kind).alias("kind"), F.trim(f"{kind}_id").alias("key"), F.trim("split").alias("split")).where("key <> ''")
    cols = [c for c in ("train", "val", "test") if c in d.columns]
    if not cols:
        raise ValueError(f"{path} has none of the known split layouts")
    return d.select(*cols).unpivot([], cols, "split", "key").select(F.lit("slide").alias("kind"), F.trim("key").alias("key"), "split").where("key <> ''")


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """Events of JSON-lines logs with their run's path; lines that are no JSON objects are left out."""
    d = spark.read.schema(RUN_EVENTS).option("mode", "PERMISSIVE").json(path)
    return d.select("*", F.col("_metadata.file_path").alias("run")).where("_corrupt_record is null").drop("_corrupt_record")


def last_record(events: DataFrame, run: str, order: str) -> DataFrame:
    """The last record of each run."""
    return events.groupBy(run).agg(F.max_by(F.struct(*[c for c in events.columns if c != run]), order).alias("r")).select(run, "r.*")


def _texts(column: str, available: list[str]) -> Column:
    """All values of a repeated XML element as an array of texts without blanks; empty if the file has none."""
    if column not in available:
        return F.array().cast("array<string>")
    as_json = F.to_json(F.struct(F.col(f"`{column}`").alias("v")))
    # an element is a text, a struct with attributes, or an array of either
    many = F.coalesce(F.from_json(F.get_json_object(as_json, "$.v[*]"), "array<string>"), F.array(F.get_json_object(as_json, "$.v")))
    plain = F.transform(many, lambda x: F.trim(F.coalesce(F.get_json_object(x, "$._VALUE"), x)))
    return F.filter(plain, lambda x: x.isNotNull() & (x != ""))


def _resources(column: str, available: list[str]) -> Column:
    """The last parts of the references of a repeated XML element."""
    if column not in available:
        return F.array().cast("array<string>")
    found = F.regexp_extract_all(F.to_json(F.struct(F.col(f"`{column}`"))), F.lit(r'"_rdf:resource":"([^"]*)"'), 1)
    return F.transform(found, lambda x: F.regexp_extract(x, r"([^#/\\]+)$", 1))


def ncit_concepts(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, parents, synonyms, definition, cuis) of an NCIt OWL file: code or last part of the class address,
    label, parents, both synonym kinds, first definition and UMLS codes; only classes with a code C<digits> and a
    label."""
    d = owl_classes(spark, path)
    has = d.columns
    about = F.regexp_extract(F.coalesce(F.col("`_rdf:about`"), F.lit("")), r"([^#/]+)$", 1) if "_rdf:about" in has else F.lit("")
    code = F.coalesce(F.try_element_at(_texts("NHC0", has), F.lit(1)), about)
    x = d.select(
        code.alias("id"), F.try_element_at(_texts("rdfs:label", has), F.lit(1)).alias("name"), F.filter(_resources("rdfs:subClassOf", has), lambda p: p.rlike(r"^C\d+$")).alias("parents"),
        F.array_distinct(F.concat(_texts("P90", has), _texts("P108", has))).alias("synonyms"), F.try_element_at(_texts("P97", has), F.lit(1)).alias("definition"), F.array_distinct(_texts("P207", has)).alias("cuis"),
    )
    return x.where(F.col("id").rlike(r"^C\d+$") & (F.coalesce("name", F.lit("")) != ""))


def disease_concepts(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, parents, synonyms, definition, xrefs, match_enabled) of a disease ontology's OWL file: identifier,
    label, parents, four kinds of synonyms, first definition and cross-references; only DOID: with a label, none of
    them matched in texts."""
    d = owl_classes(spark, path)
    has = d.columns
    kinds = [f"oboInOwl:has{k}Synonym" for k in ("Exact", "Related", "Narrow", "Broad")]
    names = F.array_distinct(F.concat(*[_texts(k, has) for k in kinds]))
    parents = F.transform(_resources("rdfs:subClassOf", has), lambda p: F.replace(p, F.lit("DOID_"), F.lit("DOID:")))
    x = d.select(
        F.try_element_at(_texts("oboInOwl:id", has), F.lit(1)).alias("id"), F.try_element_at(_texts("rdfs:label", has), F.lit(1)).alias("name"), F.filter(parents, lambda p: p.startswith("DOID:")).alias("parents"),
        names.alias("synonyms"), F.try_element_at(_texts("obo:IAO_0000115", has), F.lit(1)).alias("definition"), F.array_distinct(_texts("oboInOwl:hasDbXref", has)).alias("xrefs"), F.lit(False).alias("match_enabled"),
    )
    return x.where(F.col("id").startswith("DOID:") & (F.coalesce("name", F.lit("")) != ""))


def owl_version(spark: SparkSession, path: str) -> str | None:
    """The first version of an OWL file's header; None without one."""
    d = owl_classes(spark, path, "owl:Ontology")
    if "owl:versionInfo" not in d.columns:
        return None
    r = d.select(F.try_element_at(_texts("owl:versionInfo", d.columns), F.lit(1)).alias("v")).first()
    return r["v"] if r else None


def yaml_config(path: str) -> dict[str, Any]:
    """A YAML configuration; values of keys that end in _dir, _path or _root and are relative are taken from the
    file's folder. Read on the driver."""
    import yaml

    with open(path, encoding="utf-8") as f:
        config = yaml.safe_load(f) or {}
    if not isinstance(config, dict):
        raise ValueError(f"{path} holds no mapping")
    base = os.path.dirname(os.path.abspath(path))

    def resolve(x: Any, key: str = "") -> Any:
        if isinstance(x, dict):
            return {k: resolve(v, str(k)) for k, v in x.items()}
        if isinstance(x, str) and x and key.endswith(("_dir", "_path", "_root")) and not os.path.isabs(x) and "://" not in x:
            return os.path.normpath(os.path.join(base, x))
        return x

    return resolve(config)
