"""Linking of text to an ontology: lexicon, phrase join, longest matches, depths, information content, expansion."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import cut, small_side
from . import hierarchy

# Words too general to link by themselves.
STOP_TERMS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "m", "n", "no", "not", "of", "on", "or", "r", "s", "t", "the", "to")

#: Codes of a concept up to which they travel with each of them in a crosswalk, and its pairs that one task makes.
CODES, PAIRS = 32, 20_000_000

#: A small example ontology: id, name, synonyms, parents.
BUILT_IN: tuple[tuple[str, str, tuple[str, ...], tuple[str, ...]], ...] = (
    ("ONT:neoplasm", "neoplasm", ("tumor", "tumour"), ()),
    ("ONT:carcinoma", "carcinoma", (), ("ONT:neoplasm",)),
    ("ONT:adenocarcinoma", "adenocarcinoma", (), ("ONT:carcinoma",)),
    ("ONT:ductal", "ductal carcinoma", (), ("ONT:carcinoma",)),
    ("ONT:invasive_ductal", "invasive ductal carcinoma", (), ("ONT:ductal",)),
    ("ONT:necrosis", "necrosis", (), ()),
)

#: The ontology used where there is no other, the reference's twelve concepts: id, name, synonyms, parents, ic.
FALLBACK: tuple[tuple[str, str, tuple[str, ...], tuple[str, ...], float], ...] = (
    ("ONT:NEOPLASM", "Neoplasm", ("neoplasm", "tumor", "tumour"), (), 1.1),
    ("ONT:CARCINOMA", "Carcinoma", ("carcinoma",), ("ONT:NEOPLASM",), 1.7),
    ("ONT:ADENOCARCINOMA", "Adenocarcinoma", ("adenocarcinoma",), ("ONT:CARCINOMA",), 2.2),
    ("ONT:SQUAMOUS_CELL_CARCINOMA", "Squamous Cell Carcinoma", ("squamous cell carcinoma", "squamous carcinoma"), ("ONT:CARCINOMA",), 2.4),
    ("ONT:INVASIVE_DUCTAL_CARCINOMA", "Invasive Ductal Carcinoma", ("invasive ductal carcinoma", "ductal carcinoma"), ("ONT:CARCINOMA",), 2.6),
    ("ONT:CLEAR_CELL_RENAL_CELL_CARCINOMA", "Clear Cell Renal Cell Carcinoma", ("clear cell renal cell carcinoma", "clear cell renal carcinoma", "clear cell rcc", "clear cell carcinoma"), ("ONT:CARCINOMA",), 2.8),
    ("ONT:PAPILLARY_RENAL_CELL_CARCINOMA", "Papillary Renal Cell Carcinoma", ("papillary renal cell carcinoma", "papillary renal carcinoma", "papillary rcc"), ("ONT:CARCINOMA",), 2.8),
    ("ONT:METASTASIS", "Metastasis", ("metastasis", "metastatic", "metastases"), ("ONT:NEOPLASM",), 2.1),
    ("ONT:NECROSIS", "Necrosis", ("necrosis", "necrotic"), ("ONT:NEOPLASM",), 1.9),
    ("ONT:LYMPHOVASCULAR_INVASION", "Lymphovascular Invasion", ("lymphovascular invasion", "vascular invasion", "lymphatic invasion"), ("ONT:NEOPLASM",), 2.5),
    ("ONT:MARGIN_POSITIVE", "Positive Margin", ("positive margin", "margin involved", "involved margin"), ("ONT:NEOPLASM",), 2.3),
    ("ONT:LYMPH_NODE_INVOLVEMENT", "Lymph Node Involvement", ("lymph node involvement", "lymph node metastasis", "nodal metastasis", "positive lymph node"), ("ONT:METASTASIS",), 2.7),
)


def fallback(spark: SparkSession) -> DataFrame:
    """(id, name, synonyms, parents, ic, match_enabled) of the fallback ontology."""
    rows = [(i, n, list(s), list(p), ic, True) for i, n, s, p, ic in FALLBACK]
    return spark.createDataFrame(rows, "id string, name string, synonyms array<string>, parents array<string>, ic double, match_enabled boolean")


def tokens(c: Column | str) -> Column:
    """Lower-case words of Latin letters and digits."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]+"), 0)


def lexicon(concepts: DataFrame, stop: Iterable[str] = STOP_TERMS) -> DataFrame:
    """(phrase, n, concept_id, concept_name, term): for every phrase of a matchable concept's name and synonyms
    the best concept: named exactly so, containing it, with fewer words, first by name and id."""
    on = concepts.where("match_enabled and name is not null").select("id", "name", F.explode(F.concat(F.array("name"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("term"))
    x = on.withColumn("ts", tokens("term")).where(F.size("ts") > 0).withColumn("phrase", F.array_join("ts", " ")).withColumn("n", F.size("ts"))
    x = x.where(~((F.col("n") == 1) & (F.col("phrase").isin(*stop) | (F.length("phrase") < 4) | F.col("phrase").rlike(r"^\d+$"))))
    own = F.array_join(tokens("name"), " ")
    rank = F.struct((own != F.col("phrase")).cast("int"), (~own.contains(F.col("phrase"))).cast("int"), F.size(tokens("name")), own, "id")
    return x.groupBy("phrase", "n").agg(F.min_by(F.struct("id", "name", "term"), rank).alias("m")).select("phrase", "n", F.col("m.id").alias("concept_id"), F.col("m.name").alias("concept_name"), F.col("m.term").alias("term"))


def phrase_hits(texts: DataFrame, key: str, text: str, lex: DataFrame) -> DataFrame:
    """(key, start, n, concept_id): every run of words of a text that is a phrase of the lexicon.

    Only lengths that the lexicon has are built; the lexicon is broadcast if its counted size allows."""
    lex = cut(lex.select("phrase", "n", "concept_id"))
    lengths = sorted(r.n for r in lex.select("n").distinct().collect())
    if not lengths:
        return texts.select(key, F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit("").alias("concept_id")).limit(0)
    t = texts.select(key, tokens(text).alias("ts")).where(F.size("ts") > 0)

    def runs(k: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size("ts") - k + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.struct((i - 1).alias("start"), F.lit(k).alias("n"), F.array_join(F.slice("ts", i, k), " ").alias("phrase")))

    grams = [runs(k) for k in lengths]
    return t.select(key, F.explode(F.concat(*grams)).alias("g")).select(key, "g.start", "g.n", "g.phrase").join(small_side(lex, lex.count()), ["phrase", "n"]).select(key, "start", "n", "concept_id")


def longest_matches(hits: DataFrame, key: str) -> DataFrame:
    """(key, start, n, concept_id): of overlapping hits the first, then the longest, then the smaller id."""
    h = F.array_sort(F.collect_list(F.struct("start", (-F.col("n")).alias("minus"), "concept_id")))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,minus:int,concept_id:string>>").alias("kept"))
    step = lambda acc, x: F.when(x["start"] >= acc["end"], F.struct((x["start"] - x["minus"]).alias("end"), F.array_append(acc["kept"], x).alias("kept"))).otherwise(acc)
    g = hits.groupBy(key).agg(h.alias("h"))
    return g.select(key, F.explode(F.aggregate("h", start, step, lambda acc: acc["kept"])).alias("m")).select(key, "m.start", (-F.col("m.minus")).alias("n"), "m.concept_id")


def longest_depths(concepts: DataFrame) -> DataFrame:
    """(id, depth): longest way from a root; null for concepts on a loop or below one only.

    One round a level; a round extends only the concepts whose depth grew."""
    f = hierarchy.resolve(concepts)
    safe = f.edges.join(f.cycles.select(F.col("key").alias("child")), "child", "left_anti").join(f.cycles.select(F.col("key").alias("parent")), "parent", "left_anti")
    safe = cut(safe.select("child", "parent"))
    depth = front = cut(f.rooted.where("depth = 0").select(F.col("key").alias("node"), F.lit(0).alias("depth")))
    level = 0
    while not front.isEmpty():
        level += 1
        front = cut(front.join(safe, front.node == safe.parent).select(F.col("child").alias("node")).distinct().withColumn("depth", F.lit(level)))
        depth = depth.unionByName(front)
        if level % 20 == 0:
            depth = cut(depth.groupBy("node").agg(F.max("depth").alias("depth")))
    best = depth.groupBy("node").agg(F.max("depth").alias("depth"))
    return f.ids.join(best, f.ids.key == best.node, "left").select("id", "depth")


def information_content(concepts: DataFrame) -> DataFrame:
    """(id, descendants, ic): number of distinct descendants and ln((N + 1) / (descendants + 1)) to six places."""
    ids, edges = hierarchy.links(concepts)
    ids, edges = cut(ids), cut(edges)
    n = ids.select("key").distinct().count()
    d = hierarchy.closure(edges).groupBy(F.col("ancestor").alias("key")).agg(F.count(F.lit(1)).alias("descendants"))
    x = ids.join(d, "key", "left").select("id", F.coalesce("descendants", F.lit(0)).alias("descendants"))
    return x.withColumn("ic", F.bround(F.log((F.lit(n) + 1) / (F.col("descendants") + 1)), 6))


def true_path(mentions: DataFrame, doc: str, concepts: DataFrame, hops: int | None = 2) -> DataFrame:
    """(doc, concept_id, direct, hops): the concepts of a document and their ancestors within ``hops`` links
    (None: all), with the least number of links. Ancestors inherit from direct mentions only."""
    ids, edges = hierarchy.links(concepts)
    edges = cut(edges)
    key = ids.select("key", F.col("id").alias("concept_id"))
    own = mentions.select(doc, F.lower(F.trim("concept_id")).alias("key")).where("key is not null").distinct().join(key.select("key").distinct(), "key", "left_semi")
    up = hierarchy.closure(edges) if hops is None else _within(edges, hops)
    anc = own.join(up, own.key == up.node).select(doc, F.col("ancestor").alias("key"), "distance")
    all_ = own.select(doc, "key", F.lit(0).alias("distance")).unionByName(anc)
    g = all_.groupBy(doc, "key").agg(F.min("distance").cast("int").alias("hops"))
    return g.join(key, "key").select(doc, "concept_id", (F.col("hops") == 0).alias("direct"), "hops")


def _within(edges: DataFrame, hops: int) -> DataFrame:
    """(node, ancestor, distance) up to ``hops`` links."""
    out = step = edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("distance"))
    for d in range(2, hops + 1):
        step = step.select("node", F.col("ancestor").alias("child")).join(edges, "child").select("node", F.col("parent").alias("ancestor")).distinct().withColumn("distance", F.lit(d).cast("long"))
        out = out.unionByName(step)
    return out.where("node <> ancestor").groupBy("node", "ancestor").agg(F.min("distance").alias("distance")) if hops > 0 else out.limit(0)


def _coded(concepts: DataFrame, terminology: str, side: str, tasks: int = 1) -> DataFrame:
    """(side_id, side_n, side_codes, system, code): a row for each code of a concept of a terminology, with their
    number and, if they are 2 to CODES, all of them."""
    x = concepts.where(F.col("source_terminology") == terminology).select("id", F.explode("xrefs").alias("system", "codes")).select("id", "system", F.explode("codes").alias("code")).where("code is not null")
    x = x.repartition(tasks, "id") if tasks > 1 else x
    g = x.groupBy("id").agg(F.collect_set(F.struct("system", "code")).alias("codes")).withColumn("n", F.size("codes"))
    carried = F.when((F.col("n") > 1) & (F.col("n") <= CODES), F.col("codes"))
    return g.select(F.col("id").alias(f"{side}_id"), F.col("n").alias(f"{side}_n"), carried.alias(f"{side}_codes"), F.inline("codes"))


def crosswalk(concepts: DataFrame, left: str, right: str) -> DataFrame:
    """(left_id, right_id): concepts of two terminologies that share a code of any system.

    A pair comes from the least code it shares, so pairs need no exchange to be distinct; only those of two concepts
    with several codes, one of them with more than CODES, are made distinct afterwards. The smaller side goes to all
    tasks, the larger one to as many tasks as its pairs need; both are counted first."""
    sums = lambda k: (F.count(f"{k}_n").alias(f"{k}_rows"), F.coalesce(F.sum(F.size(f"{k}_codes")), F.lit(0)).alias(f"{k}_carried"), F.coalesce(F.max(f"{k}_n"), F.lit(0)).alias(f"{k}_most"))
    each = _coded(concepts, left, "left").unionByName(_coded(concepts, right, "right"), allowMissingColumns=True)
    per = each.groupBy("system", "code").agg(*sums("left"), *sums("right"))
    total = lambda k: (F.coalesce(F.sum(F.col(f"{k}_rows") + F.col(f"{k}_carried")), F.lit(0)).alias(f"{k}_size"), F.coalesce(F.max(f"{k}_most"), F.lit(0)).alias(f"{k}_most"))
    n = per.agg(*total("left"), *total("right"), F.coalesce(F.sum(F.col("left_rows").cast("double") * F.col("right_rows")), F.lit(0.0)).alias("pairs")).first()
    small, large = ("left", "right") if n.left_size <= n.right_size else ("right", "left")
    terminology = {"left": left, "right": right}
    a = small_side(_coded(concepts, terminology[small], small), n[f"{small}_size"])
    tasks = 1 + int(min(n.pairs / PAIRS, 10_000))
    b = _coded(concepts, terminology[large], large, tasks)
    # the same partners in a row are written in a fraction of the space; a sort that isn't cut off is dropped below a join
    b = cut(b.sortWithinPartitions("system", "code")) if tasks > 1 else b
    x = b.join(a, ["system", "code"])
    one = (F.col("left_n") == 1) | (F.col("right_n") == 1)
    out = x.where(one | (F.struct("system", "code") == F.array_min(F.array_intersect("left_codes", "right_codes")))).select("left_id", "right_id")
    if max(n.left_most, n.right_most) > CODES and min(n.left_most, n.right_most) > 1:
        out = out.unionByName(x.where(~one & (F.col("left_codes").isNull() | F.col("right_codes").isNull())).select("left_id", "right_id").distinct())
    return out


def document_frequency(mentions: DataFrame, doc: str, concept: str) -> DataFrame:
    """(concept, documents, mentions, ratio): frequencies over the documents that have any mention."""
    n = mentions.agg(F.count_distinct(doc).alias("total"))
    g = mentions.groupBy(concept).agg(F.count_distinct(doc).alias("documents"), F.count(F.lit(1)).alias("mentions"))
    return g.crossJoin(F.broadcast(n)).select(concept, "documents", "mentions", F.round(F.col("documents") / F.col("total"), 6).alias("ratio"))


def compare_cohorts(mentions: DataFrame, cohort: str, doc: str, concept: str) -> DataFrame:
    """(left, right, concept, left_ratio, right_ratio, ratio_diff): document frequencies of every pair of cohorts."""
    total = mentions.groupBy(cohort).agg(F.count_distinct(doc).alias("total"))
    g = mentions.groupBy(cohort, concept).agg(F.count_distinct(doc).alias("df")).join(total, cohort).select(cohort, concept, (F.col("df") / F.col("total")).alias("ratio"))
    # pairs of cohort names only; each pair meets the concepts of its two cohorts
    names = total.select(F.col(cohort).alias("l")).join(total.select(F.col(cohort).alias("r")), F.col("l") < F.col("r"))
    zero = F.lit(0.0)
    a = names.join(g.withColumnRenamed(cohort, "l"), "l").select("l", "r", concept, F.col("ratio").alias("a"), zero.alias("b"))
    b = names.join(g.withColumnRenamed(cohort, "r"), "r").select("l", "r", concept, zero.alias("a"), F.col("ratio").alias("b"))
    x = a.unionByName(b).groupBy("l", "r", concept).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return x.select(F.col("l").alias("left"), F.col("r").alias("right"), concept, F.round("a", 6).alias("left_ratio"), F.round("b", 6).alias("right_ratio"), F.round(F.col("a") - F.col("b"), 6).alias("ratio_diff"))


def co_occurrence(mentions: DataFrame, doc: str, context: list[str], concept: str) -> DataFrame:
    """(doc, a, b, contexts): pairs of different concepts, a < b, that share a context of a document.

    A context is a sentence or section: the pairs are bounded by what one holds."""
    m = mentions.select(doc, *context, F.col(concept).alias("c")).where(F.col("c").isNotNull()).distinct()
    g = m.groupBy(doc, *context).agg(F.array_sort(F.collect_set("c")).alias("cs")).where(F.size("cs") > 1)
    pair = F.flatten(F.transform("cs", lambda a, i: F.transform(F.slice("cs", i + 2, F.size("cs")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return g.select(doc, F.explode(pair).alias("p")).groupBy(doc, "p.a", "p.b").agg(F.count(F.lit(1)).alias("contexts"))


def top_concepts(nodes: DataFrame, doc: str, k: int) -> DataFrame:
    """The k concepts of each document with the highest direct + 0.1 ic + 0.05 depth, ties by id."""
    score = F.col("mentions") + 0.1 * F.coalesce("ic", F.lit(0.0)) + 0.05 * F.coalesce("depth", F.lit(0))
    w = Window.partitionBy(doc).orderBy(F.desc("score"), "concept_id")
    return nodes.withColumn("score", F.round(score, 9)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
