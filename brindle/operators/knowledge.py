"""Domains, entities, types, schemas, communities and their validation."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions import wording
from brindle.operators import phrases


def load_ontology(spark: SparkSession, path: str) -> DataFrame:
    """``domain, keyword`` from a JSON object of keyword lists; a keyword that a list repeats counts twice."""
    rows = spark.read.text(path, wholetext=True).first()[0]
    return spark.createDataFrame([(d, k.lower()) for d, ks in json.loads(rows).items() for k in ks], "domain string, keyword string")


def domain_scores(docs: DataFrame, ontology: DataFrame, top: int = 5, most_keywords: int = 5_000, id_col: str = "doc_id") -> DataFrame:
    """``id, domain, score, evidence, rank``: per keyword min(0.1 count, 0.5), summed by domain, over the document's best; the best ``top``.

    Keywords are matched as they are written, marks included, between borders of
    words (see ``phrases``); one that a domain lists twice scores twice. The
    ontology is a parameter table: up to ``most_keywords`` distinct keywords are
    broadcast, a larger one is joined; the result is the same.
    """
    onto = ontology.select("domain", F.lower("keyword").alias("keyword")).groupBy("domain", "keyword").agg(F.count(F.lit(1)).alias("times"))
    counted = phrases.counts(docs, ontology, most_keywords, id_col, "text", "keyword").withColumnRenamed("phrase", "keyword")
    hits = counted.join(F.broadcast(onto) if onto.limit(most_keywords + 1).count() <= most_keywords else onto, "keyword")
    scored = hits.groupBy("id", "domain").agg(F.sum(F.col("times") * F.least(F.col("n") * 0.1, F.lit(0.5))).alias("raw"), F.array_sort(F.collect_list(F.concat_ws(": ", "keyword", F.col("n").cast("string")))).alias("e"))
    best = F.col("raw") / F.max("raw").over(Window.partitionBy("id"))
    out = scored.select("id", "domain", F.round(best, 6).alias("score"), F.array_join("e", ", ").alias("evidence"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "domain")).cast("bigint")).where(F.col("rank") <= top)


def primary_domain(docs: DataFrame, scores: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id, primary_domain, is_multi``: the best domain, GENERAL without one; several if the second exceeds 0.7 of the first."""
    two = scores.groupBy("id").agg(F.max(F.when(F.col("rank") == 1, F.col("domain"))).alias("d"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("b"))
    return docs.select(F.col(id_col).alias("id")).join(two, "id", "left").select("id", F.coalesce("d", F.lit("GENERAL")).alias("primary_domain"), F.coalesce(F.col("b") > 0.7 * F.col("a"), F.lit(False)).alias("is_multi"))


def blend(keyword: Column, model: Column) -> Column:
    """0.4 of the keyword score and 0.6 of a model's."""
    return 0.4 * F.coalesce(keyword, F.lit(0.0)) + 0.6 * F.coalesce(model, F.lit(0.0))


def calibrated(scores: DataFrame, model: DataFrame) -> DataFrame:
    """``id, domain, score, rank``: keyword scores (``id, domain, score``) and a model's (``id, domain, confidence``) as one ranking; a domain that only one of them names keeps its score."""
    k = scores.select("id", "domain", F.col("score").alias("_k"))
    m = model.groupBy("id", "domain").agg(F.max(F.least(F.greatest(F.col("confidence"), F.lit(0.0)), F.lit(1.0))).alias("_m"))
    both = k.join(m, ["id", "domain"], "full_outer")
    score = F.when(F.col("_k").isNotNull() & F.col("_m").isNotNull(), blend(F.col("_k"), F.col("_m"))).otherwise(F.coalesce("_k", "_m"))
    out = both.select("id", "domain", F.round(score, 6).alias("score"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "domain")).cast("bigint"))


def detect(docs: DataFrame, ontology: DataFrame, model: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """``id, primary_domain, confidence, is_multi, method`` of every document, from keywords and, if given, a model's ``id, domain, confidence``.

    ``method`` is hybrid, keyword or model by what spoke for the document; if
    nothing did it is fallback, and the domain GENERAL at 0.5, or at 1 for a text
    without words. Several domains if the second exceeds 0.7 of the first.
    """
    scores = domain_scores(docs, ontology, id_col=id_col)
    model = model.where("domain is not null and confidence is not null") if model is not None else scores.select("id", "domain", F.col("score").alias("confidence")).where("false")
    ranked = calibrated(scores, model)
    at = lambda r, c: F.max(F.when(F.col("rank") == r, F.col(c)))
    two = ranked.groupBy("id").agg(at(1, "domain").alias("d"), at(1, "score").alias("a"), at(2, "score").alias("b"))
    said = scores.select("id", F.lit(1).alias("k"), F.lit(0).alias("m")).union(model.select("id", F.lit(0), F.lit(1))).groupBy("id").agg(F.max("k").alias("k"), F.max("m").alias("m"))
    method = F.when((F.col("k") == 1) & (F.col("m") == 1), "hybrid").when(F.col("k") == 1, "keyword").when(F.col("m") == 1, "model").otherwise("fallback")
    blank = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", "") == ""
    out = docs.select(F.col(id_col).alias("id"), blank.alias("_blank")).join(two, "id", "left").join(said, "id", "left")
    return out.select("id", F.coalesce("d", F.lit("GENERAL")).alias("primary_domain"), F.coalesce("a", F.when(F.col("_blank"), 1.0).otherwise(0.5)).alias("confidence"), F.coalesce(F.col("b") > 0.7 * F.col("a"), F.lit(False)).alias("is_multi"), method.alias("method"))


def propagate_domains(mentions: DataFrame, docs: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``entity_id, domain`` and ``src, dst, domain``: an entity takes the domain most frequent among the documents that mention it (ties: the first by name), an edge its source's; edges without one are left out.

    ``mentions`` has ``doc_id, entity_id``, ``docs`` ``doc_id, domain``, ``edges`` ``src, dst``.
    """
    n = mentions.join(docs.where("domain is not null"), "doc_id").groupBy("entity_id", "domain").agg(F.count_distinct("doc_id").alias("n"))
    of = n.groupBy("entity_id").agg(F.min_by("domain", F.struct(-F.col("n"), "domain")).alias("domain"))
    return of, edges.select("src", "dst").join(of.withColumnRenamed("entity_id", "src"), "src").select("src", "dst", "domain")


def dedup_entities(entities: DataFrame) -> DataFrame:
    """Entities of equal lower-case name and type as one: mentions counted, properties merged with the last winning, first non-empty source text.

    From ``seq, name, entity_type, properties, source_text``, ``seq`` giving the order.
    """
    keyed = entities.withColumn("k1", F.lower("name")).withColumn("k2", F.lower("entity_type"))
    out = keyed.groupBy("k1", "k2").agg(F.min_by("name", "seq").alias("name"), F.min_by("entity_type", "seq").alias("entity_type"), F.count(F.lit(1)).alias("mention_count"), F.min_by("source_text", F.when(F.col("source_text") != "", F.col("seq"))).alias("source_text"))
    # one row per property, so a frequent entity's mentions never meet in one list
    props = keyed.select("k1", "k2", "seq", F.explode("properties").alias("p", "v")).groupBy("k1", "k2", "p").agg(F.max_by("v", "seq").alias("v"))
    maps = props.groupBy("k1", "k2").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "v")))).alias("properties"))
    return out.join(maps, ["k1", "k2"], "left").select("name", "entity_type", "mention_count", F.coalesce("properties", F.create_map().cast("map<string,string>")).alias("properties"), "source_text")


def type_confidence(frequency: Column, examples: Column, properties: Column) -> Column:
    ex = F.when(examples == 0, 0.3).otherwise(0.7 + 0.3 * F.least(examples / 10, F.lit(1.0)))
    pr = F.when(properties == 0, 0.2).otherwise(F.least(properties / 5, F.lit(1.0)))
    return 0.4 * F.least(frequency / 10, F.lit(1.0)) + 0.4 * ex + 0.2 * pr


def discover_types(entities: DataFrame, known: list[str], min_frequency: int = 2, promote: float = 0.9, most: int = 20) -> DataFrame:
    """``entity_type, frequency, n_examples, n_properties, confidence, promoted`` of types seen often enough, the ``most`` best.

    ``entities`` has ``entity_type, name, properties`` (a map).
    """
    freq = entities.groupBy("entity_type").agg(F.count(F.lit(1)).alias("frequency"), F.least(F.count_distinct("name"), F.lit(20)).alias("n_examples")).where(F.col("frequency") >= min_frequency)
    props = entities.select("entity_type", F.explode(F.map_keys("properties")).alias("p")).groupBy("entity_type").agg(F.count_distinct("p").alias("n_properties"))
    d = freq.join(props, "entity_type", "left").fillna(0, ["n_properties"]).withColumn("confidence", F.round(type_confidence(F.col("frequency"), F.col("n_examples"), F.col("n_properties")), 6))
    d = d.withColumn("promoted", (F.col("confidence") >= promote) & ~F.col("entity_type").isin(*known) if known else F.col("confidence") >= promote)
    return d.orderBy(F.desc("confidence"), "entity_type").limit(most)


def required_properties(entities: DataFrame, share: float = 0.8) -> DataFrame:
    """``entity_type, property, presence`` of properties that at least ``share`` of a type's entities have."""
    total = entities.where("properties is not null").groupBy("entity_type").agg(F.count(F.lit(1)).alias("total"))
    have = entities.select("entity_type", F.explode(F.map_keys("properties")).alias("property")).groupBy("entity_type", "property").agg(F.count(F.lit(1)).alias("n"))
    return have.join(total, "entity_type").withColumn("presence", F.round(F.col("n") / F.col("total"), 6)).where(F.col("n") / F.col("total") >= share).select("entity_type", "property", "presence")


def edge_schema(edges: DataFrame) -> DataFrame:
    """``relation_type, source_types, target_types`` as sorted lists, from typed edges."""
    g = edges.groupBy("relation_type").agg(F.array_sort(F.collect_set("source_type")).alias("s"), F.array_sort(F.collect_set("target_type")).alias("t"))
    return g.select("relation_type", F.array_join("s", ",").alias("source_types"), F.array_join("t", ",").alias("target_types"))


def type_parents(types: DataFrame) -> DataFrame:
    """``entity_type, parent``: the most frequent other type whose name begins this one's. Every proper prefix of a name meets the types by equality."""
    other = types.select(F.col("entity_type").alias("parent"), F.col("frequency").alias("pf"))
    prefixes = types.where(F.length("entity_type") > 1).select("entity_type", F.explode(F.transform(F.sequence(F.lit(1), F.length("entity_type") - 1), lambda i: F.substring(F.col("entity_type"), F.lit(1), i))).alias("parent"))
    w = Window.partitionBy("entity_type").orderBy(F.desc("pf"), "parent")
    return prefixes.join(other, "parent").withColumn("_r", F.row_number().over(w)).where("_r = 1").select("entity_type", "parent")


def entity_errors(entities: DataFrame, types: list[str], required: dict[str, list[str]]) -> DataFrame:
    """``id, error``: a missing or unknown type, or a required property that is not there."""
    unknown = F.when(F.col("entity_type").isNull(), F.array(F.lit(wording.NO_TYPE))).when(~F.col("entity_type").isin(*types), F.array(F.concat(F.lit(wording.UNKNOWN_TYPE), "entity_type"))).otherwise(F.array().cast("array<string>"))
    rules = [F.when((F.col("entity_type") == t) & ~F.coalesce(F.map_contains_key("properties", F.lit(p)), F.lit(False)), F.lit(f"{t} missing required property: {p}")) for t, ps in required.items() for p in ps]
    found = F.filter(F.array(*rules), lambda x: x.isNotNull()) if rules else F.array().cast("array<string>")
    return entities.select("id", F.explode(F.concat(unknown, found)).alias("error"))


def edge_errors(edges: DataFrame, types: list[str]) -> DataFrame:
    """``src, dst, error`` of edges with an unknown type or without an end."""
    e = F.array(
        F.when(~F.coalesce(F.col("relation_type").isin(*types), F.lit(False)), F.concat(F.lit(wording.UNKNOWN_EDGE), F.coalesce("relation_type", F.lit("null")))),
        F.when(F.coalesce("src", F.lit("")) == "", F.lit(wording.NO_SOURCE)),
        F.when(F.coalesce("dst", F.lit("")) == "", F.lit(wording.NO_TARGET)),
    )
    return edges.select("src", "dst", F.explode(F.filter(e, lambda x: x.isNotNull())).alias("error"))


def community_names(entities: DataFrame, key: list[str], n_names: int, least: int = 1) -> DataFrame:
    """``key, entity_count, key_entities`` of groups with at least ``least`` members; the first names in order."""
    g = Window.partitionBy(*key)
    counts = entities.groupBy(*key).agg(F.count(F.lit(1)).alias("entity_count")).where(F.col("entity_count") >= least)
    first = entities.withColumn("_r", F.row_number().over(g.orderBy("name", "id"))).where(F.col("_r") <= n_names)
    names = first.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_r", "name"))).alias("l")).select(*key, F.array_join(F.transform("l", lambda x: x["name"]), ", ").alias("key_entities"))
    return counts.join(names, key)


def parent_scores(children: DataFrame, parents: DataFrame) -> DataFrame:
    """``child, parent, score``: 0.3 a shared name + 0.3 min(child size / parent size, 1) + 0.4, at most 1; best score, then the parent's position.

    Parents with a shared name meet the child by it. Of the others the score
    falls with the parent's size, up to the child's own, and the position
    decides beyond; so the best of them is the least position among those no
    larger than the child, or else the smallest, and no child meets them all.
    A parent without a shared name that is among those with one scores less there.
    """
    low = lambda a: F.array_distinct(F.transform(a, F.lower))
    c = children.select(F.col("community_id").alias("child"), low(F.col("names")).alias("cn"), F.col("entity_count").alias("cc"))
    p = parents.select(F.col("community_id").alias("parent"), low(F.col("names")).alias("pn"), F.greatest("entity_count", F.lit(1)).alias("pc"), "position")
    share = c.select("child", "cc", F.explode("cn").alias("n")).join(p.select("parent", "pc", "position", F.explode("pn").alias("n")), "n")
    share = share.groupBy("child", "parent", "cc", "pc", "position").agg(F.count(F.lit(1)).alias("names"))
    # the parents' sizes and the children's, in one order: the least position so far is the best parent no larger, and the next parent is the smallest that is larger
    sized = p.groupBy("pc").agg(F.min(F.struct("position", "parent")).alias("x")).select("pc", F.struct("x.position", "x.parent", "pc").alias("x"))
    wanted = c.select("cc").distinct()
    both = sized.select(F.col("pc").alias("at"), F.lit(0).alias("is_child"), "x").union(wanted.select("cc", F.lit(1), F.lit(None).cast(sized.schema["x"].dataType)))
    # distinct sizes only: n of them have n (n + 1) / 2 members at least, so ten billion entities give 141,000 rows at most
    up, down = Window.orderBy("at", "is_child"), Window.orderBy(F.desc("at"), F.desc("is_child"))
    looked = both.select("at", "is_child", F.min("x").over(up.rowsBetween(Window.unboundedPreceding, 0)).alias("low"), F.last("x", True).over(down.rowsBetween(Window.unboundedPreceding, -1)).alias("high"))
    best = looked.where("is_child = 1").select(F.col("at").alias("cc"), F.coalesce("low", "high").alias("b")).where("b is not null")
    plain = c.select("child", "cc").join(F.broadcast(best), "cc").select("child", F.col("b.parent").alias("parent"), "cc", F.col("b.pc").alias("pc"), F.col("b.position").alias("position"), F.lit(0).alias("names"))
    score = F.least(F.lit(1.0), F.col("names") * 0.3 + F.least(F.col("cc") / F.col("pc"), F.lit(1.0)) * 0.3 + 0.4)
    found = share.select("child", "parent", "cc", "pc", "position", "names").union(plain.select("child", "parent", "cc", "pc", "position", "names")).withColumn("score", F.round(score, 6))
    return found.withColumn("_r", F.row_number().over(Window.partitionBy("child").orderBy(F.desc("score"), "position"))).where("_r = 1").select("child", "parent", "score")


def merge_schemas(old: DataFrame, new: DataFrame) -> DataFrame:
    """``entity_type, examples, properties, relationships`` of two schemas: the union of examples and of properties, sorted; of relationships of one name the old schema's stay.

    Examples and properties are arrays, relationships a map of name to target.
    """
    a, b = old.select("entity_type", *(F.col(c).alias(f"old_{c}") for c in ("examples", "properties", "relationships"))), new.select("entity_type", *(F.col(c).alias(f"new_{c}") for c in ("examples", "properties", "relationships")))
    d = a.join(b, "entity_type", "full_outer")
    none = F.array().cast("array<string>")
    both = lambda c: F.array_sort(F.array_union(F.coalesce(f"old_{c}", none), F.coalesce(f"new_{c}", none))).alias(c)
    empty = F.create_map().cast("map<string,string>")
    kept = F.map_concat(F.map_filter(F.coalesce("new_relationships", empty), lambda k, v: ~F.map_contains_key(F.coalesce("old_relationships", empty), k)), F.coalesce("old_relationships", empty))
    return d.select("entity_type", both("examples"), both("properties"), kept.alias("relationships"))


def schema_template(schema: DataFrame) -> DataFrame:
    """``entity_type, template``: a JSON object to fill in for each type, with an empty value for each of its properties, in order of the alphabet."""
    names = F.array_sort("properties")
    empty = F.map_from_arrays(names, F.transform(names, lambda _: F.lit(None).cast("string"))).alias("properties"), F.array().cast("array<string>").alias("required")
    return schema.select("entity_type", F.to_json(F.struct(F.col("entity_type").alias("type"), F.concat(F.lit(wording.TEMPLATE), "entity_type").alias("description"), *empty), {"ignoreNullFields": "false"}).alias("template"))


def induce_schema(entities: DataFrame, edges: DataFrame, share: float = 0.8) -> DataFrame:
    """``kind, name, detail``: required properties of types and end types of edges in one table."""
    t = required_properties(entities, share).groupBy("entity_type").agg(F.array_join(F.array_sort(F.collect_list("property")), ",").alias("detail")).select(F.lit("type").alias("kind"), F.col("entity_type").alias("name"), "detail")
    return t.union(edge_schema(edges).select(F.lit("edge"), "relation_type", F.concat_ws(">", "source_types", "target_types")))


def summaries(entities: DataFrame, key: str = "community") -> DataFrame:
    """``key, summary``: how many entities of which types a community has, and its first five names by id."""
    first = entities.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("id"))).where("_r <= 5").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_r", "name"))).alias("names"))
    counts = entities.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.coalesce("entity_type", F.lit("Unknown")))).alias("types"))
    names = F.array_join(F.transform("names", lambda x: x["name"]), ", ")
    return counts.join(first, key).select(key, F.concat(F.lit(wording.SUMMARY[0]), F.col("n").cast("string"), F.lit(wording.SUMMARY[1]), F.array_join("types", ", "), F.lit(wording.SUMMARY[2]), F.when(names == "", wording.SUMMARY[3]).otherwise(names)).alias("summary"))


def naming_prompts(communities: DataFrame) -> DataFrame:
    """``community_id, prompt`` from ``community_id, level, summary, key_entities, entity_count``."""
    what = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in wording.LEVELS.items() for x in kv)), F.col("level")), F.lit("category"))
    return communities.select(
        "community_id",
        F.concat(
            F.lit(wording.NAMING[0]), what, F.lit(wording.NAMING[1]), "summary", F.lit(wording.NAMING[2]), F.array_join(F.slice("key_entities", 1, 5), ", "), F.lit(wording.NAMING[3]), F.col("entity_count").cast("string"), F.lit(wording.NAMING[4]),
        ).alias("prompt"),
    )


def named(communities: DataFrame, answers: DataFrame) -> DataFrame:
    """``community_id, name, coherence``: names out of a model's JSON answers; a broken answer leaves what there was."""
    said = answers.select("community_id", F.from_json("answer", "name string, confidence double").alias("a"))
    return communities.join(said, "community_id", "left").select("community_id", F.coalesce(F.nullif("a.name", F.lit("")), "name").alias("name"), F.coalesce("a.confidence", "coherence").alias("coherence"))


def in_order(communities: DataFrame, limit: int | None = None) -> DataFrame:
    """Communities by falling number of entities, then id."""
    out = communities.orderBy(F.desc("entity_count"), "community_id")
    return out.limit(limit) if limit else out
