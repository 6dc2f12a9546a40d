"""Ontology resources: normalised references, subsets, merged bundles, crosswalks through shared codes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from . import hierarchy


def sorted_distinct(c: Column | str) -> Column:
    """Distinct values without regard to case, sorted so; of several forms the first in plain order."""
    c = F.col(c) if isinstance(c, str) else c
    trimmed = F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    pairs = F.array_sort(F.transform(F.array_distinct(trimmed), lambda x: F.struct(F.lower(x).alias("k"), x.alias("v"))))
    empty = F.slice(pairs, 1, 0)
    once = F.aggregate(pairs, empty, lambda acc, p: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["k"] == p["k"]), acc).otherwise(F.array_append(acc, p)))
    return F.transform(once, lambda p: p["v"])


def doid(c: Column | str) -> Column:
    """A disease id in its colon form."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.trim(c), r"^DOID_", "DOID:")


def xref(c: Column | str) -> Column:
    """(system, code) of a cross-reference by its prefix; null without one."""
    x = F.trim(F.col(c) if isinstance(c, str) else c)
    prefix, code = F.upper(F.split_part(x, F.lit(":"), F.lit(1))), F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1))
    system = F.when(prefix.isin("NCI", "NCIT"), "ncit").when(prefix.startswith("SNOMEDCT"), "snomedct").when(prefix == "UMLS_CUI", "umls").when(prefix == "MESH", "mesh").otherwise("other")
    return F.when(code != "", F.struct(system.alias("system"), code.alias("code")))


def full_name(c: Column | str) -> Column:
    """(label, tag) of a fully specified name."""
    c = F.col(c) if isinstance(c, str) else c
    tag = F.regexp_extract(c, r"\(([^()]*)\)\s*$", 1)
    return F.struct(F.trim(F.regexp_replace(c, r"\s*\([^()]*\)\s*$", "")).alias("label"), tag.alias("tag"))


def subset(concepts: DataFrame, include: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """Concepts whose name, or else a synonym, holds an included cue and whose name holds no excluded one, with
    all their ancestors; parents are kept only inside the subset."""
    has = lambda c, cues: F.coalesce(F.lower(c).rlike("|".join(cues)), F.lit(False)) if cues else F.lit(False)
    seed = (has(F.col("name"), include) | F.coalesce(F.exists("synonyms", lambda s: has(s, include)), F.lit(False))) & ~has(F.col("name"), exclude)
    ids, edges = hierarchy.links(concepts)
    up = hierarchy.closure(cut(edges))
    own = concepts.where(seed).select(F.lower(F.trim("id")).alias("k")).distinct()
    keep = cut(own.unionByName(own.join(up, own.k == up.node).select(F.col("ancestor").alias("k"))).distinct())
    x = concepts.withColumn("k", F.lower(F.trim("id"))).join(keep, "k", "left_semi")
    inside = edges.join(keep.select(F.col("k").alias("child")), "child", "left_semi").join(keep.select(F.col("k").alias("parent")), "parent", "left_semi")
    names = ids.groupBy(F.col("key").alias("parent")).agg(F.min("id").alias("pid"))
    ps = inside.join(names, "parent").groupBy(F.col("child").alias("k")).agg(F.array_sort(F.collect_set("pid")).alias("kept"))
    return x.join(ps, "k", "left").withColumn("parents", F.coalesce("kept", F.array().cast("array<string>"))).drop("k", "kept")


def bundle(concepts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Concepts with mapped ones merged in: rows of ``pairs`` (id, other_id) fold the other concept's parents,
    synonyms and name into the first's; merged concepts disappear, all others stay."""
    x = concepts.select("id", "name", F.coalesce("synonyms", F.array().cast("array<string>")).alias("synonyms"), F.coalesce("parents", F.array().cast("array<string>")).alias("parents"), "source_terminology")
    one = x.groupBy("id").agg(F.max("name").alias("name"), F.flatten(F.collect_list("synonyms")).alias("synonyms"), F.flatten(F.collect_list("parents")).alias("parents"), F.max("source_terminology").alias("source"))
    best = pairs.groupBy("other_id").agg(F.min("id").alias("id"))  # a concept folds into one other
    gone = best.select(F.col("other_id").alias("id"))
    others = best.join(one.select(F.col("id").alias("other_id"), F.array_append("synonyms", F.col("name")).alias("s"), F.col("parents").alias("p"), F.col("source").alias("t")), "other_id")
    add = others.groupBy("id").agg(F.flatten(F.collect_list("s")).alias("s"), F.flatten(F.collect_list("p")).alias("p"), F.collect_set("t").alias("t"))
    none = F.array().cast("array<string>")
    y = one.join(gone, "id", "left_anti").join(add, "id", "left")
    return y.select(
        "id", "name", sorted_distinct(F.concat("synonyms", F.coalesce("s", none))).alias("synonyms"), sorted_distinct(F.concat("parents", F.coalesce("p", none))).alias("parents"),
        F.array_sort(F.array_distinct(F.concat(F.array("source"), F.coalesce("t", none)))).alias("sources"),
    )


def overlay(older: DataFrame, newer: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): both maps, the newer one's value where it has one."""
    a, b = older.select(key, F.col(value).alias("_a")), newer.select(key, F.col(value).alias("_b"))
    return a.join(b, key, "full").select(key, F.coalesce("_b", "_a").alias(value))


def relevant_codes(concepts: DataFrame, system: str) -> DataFrame:
    """(code): all codes of one system."""
    return concepts.select(F.explode(F.try_element_at("xrefs", F.lit(system))).alias("code")).where("trim(code) <> ''").distinct()


def synonym_records(concepts: DataFrame) -> DataFrame:
    """(id, term, source_terminology, origin): a concept's name and synonyms as records with their provenance, without
    blanks around; of records that agree in all parts (letter case of the term aside) the first by term stays."""
    name = concepts.select("id", F.trim("name").alias("term"), F.coalesce("source_terminology", F.lit("")).alias("source_terminology"), F.lit("name").alias("origin"))
    more = concepts.select("id", F.explode("synonyms").alias("term"), F.coalesce("source_terminology", F.lit("")).alias("source_terminology"), F.lit("synonym").alias("origin")).withColumn("term", F.trim("term"))
    x = name.unionByName(more).where("term <> ''")
    return x.groupBy("id", F.lower("term").alias("_t"), "source_terminology", "origin").agg(F.min("term").alias("term")).select("id", "term", "source_terminology", "origin")


def tagged_subset(descriptions: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """(concept_id, label, terms) of descriptions (concept_id, term, is_full_name, tag): concepts whose full names
    have an allowed tag or none; the label is the first full name, else the first term."""
    tags = descriptions.where("is_full_name").groupBy("concept_id").agg(F.max((~F.col("tag").isin("", *allowed)).cast("int")).alias("_bad"), F.min("term").alias("_full"))
    x = descriptions.join(tags, "concept_id", "left").where(F.coalesce("_bad", F.lit(0)) == 0)
    return x.groupBy("concept_id").agg(F.coalesce(F.max("_full"), F.min("term")).alias("label"), F.array_sort(F.collect_set("term")).alias("terms"))


def variant(name: str, bundles: Mapping[str, DataFrame]) -> DataFrame:
    """The bundle of a variant; an unknown name is an error."""
    if name not in bundles:
        raise ValueError(f"unknown variant {name!r}; there are {sorted(bundles)}")
    return bundles[name]
