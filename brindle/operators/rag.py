"""Retrieval modes and context building."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import wording
from brindle.functions.text import contains_any, token_estimate
from brindle.operators import parts
from brindle.operators.firsts import first_of
from brindle.operators.graph import either_way, top_per
from brindle.shared import Written

#: Ids that are broadcast at most.
FEW = 1_000_000


def corrective_buckets(hits: DataFrame, correct: float = 0.7, ambiguous: float = 0.4) -> DataFrame:
    """``id, relevance, verdict``: scores over the largest, cut into three."""
    rel = F.round(F.col("score") / F.max("score").over(Window.partitionBy()), 6)
    out = hits.select("id", rel.alias("relevance"))
    return out.withColumn("verdict", F.when(F.col("relevance") >= correct, "correct").when(F.col("relevance") >= ambiguous, "ambiguous").otherwise("incorrect"))


def jaccard_over(sets: DataFrame, least: float) -> DataFrame:
    """``a, b, jaccard`` from ``id, w``: pairs of sets whose Jaccard similarity exceeds ``least``, and who has the same set.

    Equal sets are one: the least id stands for all, each other is paired with
    it at 1.0, and pairs of different sets are pairs of those that stand for
    them, ``a < b``. Sets over the limit share a key of ``parts`` and so a group,
    in which whole sets meet. Sets are shuffled only if they share a key, once
    for each of their groups; of the others go a digest and the keys.
    """
    work = Written(sets.sparkSession, "jaccard")
    made = work.table(parts.keyed(sets, least), "keys")
    alike = made.groupBy("digest").agg(F.min("id").alias("rep"))
    stars = made.select("id", "digest").join(alike, "digest").where("id != rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("jaccard"))
    reps = made.join(alike, (made.digest == alike.digest) & (made.id == alike.rep), "left_semi")
    groups = parts.groups(work, reps.select("id", F.explode("keys").alias("key")))
    ids = work.table(groups.select("id").distinct(), "ids")
    whole = work.table(sets.select("id", "w").join(F.broadcast(ids) if ids.count() <= FEW else ids, "id", "left_semi"), "sets")
    j = F.col("shared") / (F.col("n") + F.col("n2") - F.col("shared"))
    return parts.met(groups, whole, least).where(j > least).select(F.col("id").alias("a"), F.col("id2").alias("b"), F.round(j, 6).alias("jaccard")).distinct().union(stars)


def greedy_dedup(hits: DataFrame, least: float = 0.9) -> DataFrame:
    """From ``query_id, rank, id, w`` (word arrays): the hits kept when each is compared to all kept before it.

    The hits of a query are a short list; the fold stays in the JVM. Sizes come
    first: sets whose sizes differ by more than the limit allows are not met.
    """
    item = F.struct("rank", "id", F.size("w").alias("n"), "w")

    def similar(x, y):
        shared = F.size(F.array_intersect(x["w"], y["w"]))
        return (x["n"] > 0) & (F.least(x["n"], y["n"]) > least * F.greatest(x["n"], y["n"])) & (shared > least * (x["n"] + y["n"] - shared))

    lists = hits.withColumn("w", F.array_distinct("w")).groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("l"))
    kept = F.aggregate("l", F.slice("l", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: similar(x, y)), acc).otherwise(F.concat(acc, F.array(x))))
    return lists.select("query_id", F.explode(kept).alias("x")).select("query_id", F.col("x.rank").alias("rank"), F.col("x.id").alias("id"))


def dedup_hits(hits: DataFrame, sets: DataFrame, least: float = 0.9) -> DataFrame:
    """``greedy_dedup`` of ``query_id, rank, id`` over the sets ``id, w``, whose words go only with hits that it can drop, or that can drop one.

    Sets over the limit share a key of ``parts`` or their digest and so a group;
    a hit without another of its group among its query's hits is kept as it is.
    Groups are found once for all queries.
    """
    work = Written(hits.sparkSession, "dedup")
    hits = work.table(hits.select("query_id", "rank", "id"), "hits")
    ids = work.table(hits.select("id").distinct(), "ids")
    own = sets.select("id", F.array_distinct("w").alias("w")).join(F.broadcast(ids) if ids.count() <= FEW else ids, "id", "left_semi")
    made = work.table(parts.keyed(own, least), "keys")
    groups = parts.groups(work, made.select("id", F.explode(F.concat("keys", F.array(F.xxhash64("digest")))).alias("key")))
    of = hits.join(groups, "id").select("query_id", "rank", "id", "label")
    several = of.groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    close = work.table(of.join(several, ["query_id", "label"], "left_semi").select("query_id", "rank", "id").distinct(), "close")
    alone = hits.join(close, ["query_id", "rank", "id"], "left_anti")
    return alone.union(greedy_dedup(close.join(sets, "id"), least))


def pack_context(hits: DataFrame, max_tokens: int = 4000, max_chunks: int = 20, room: int = 100) -> DataFrame:
    """From ``query_id, rank, id, text``: the chunks that fit the token budget, the first that does not cut to what is left.

    The cut chunk is added only if more than ``room`` tokens are left, and is
    not a source. Columns ``query_id, rank, id, text, tokens, is_source``.
    """
    d = hits.where(F.col("rank") <= max_chunks).withColumn("tokens", token_estimate(F.col("text")))
    w = Window.partitionBy("query_id").orderBy("rank")
    d = d.withColumn("upto", F.sum("tokens").over(w)).withColumn("over", F.col("upto") > max_tokens)
    d = d.withColumn("first_over", F.min(F.when(F.col("over"), F.col("rank"))).over(Window.partitionBy("query_id")))
    left = F.lit(max_tokens) - (F.col("upto") - F.col("tokens"))
    fits, cut = F.col("first_over").isNull() | (F.col("rank") < F.col("first_over")), (F.col("rank") == F.col("first_over")) & (left > room)
    text = F.when(cut, F.concat(F.substring(F.col("text"), F.lit(1), (left * 4).cast("int")), F.lit("..."))).otherwise(F.col("text"))
    return d.where(fits | cut).select("query_id", "rank", "id", text.alias("text"), F.when(cut, left).otherwise(F.col("tokens")).cast("bigint").alias("tokens"), (~cut | fits).alias("is_source"))


def render_context(chunks: DataFrame) -> DataFrame:
    """``query_id, prompt``: ``[Source i - name]`` blocks joined by a rule, from ``query_id, rank, name, text``."""
    block = F.struct("rank", F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit(" - "), F.col("name"), F.lit("]\n"), F.col("text")).alias("b"))
    return chunks.groupBy("query_id").agg(F.array_sort(F.collect_list(block)).alias("l")).select("query_id", F.array_join(F.transform("l", lambda x: x["b"]), "\n---\n").alias("prompt"))


# fixed values: phrases that say an answer is uncertain
UNCERTAIN = ["i don't have enough information", "the context doesn't mention", "not specified in the context", "unclear from the provided"]


def answer_confidence(text):
    """0.9, 0.6 or 0.3 by the phrase in an answer, bold or plain; 0.4 if it says that it is uncertain, else 0.7."""
    low = F.replace(F.lower(text), F.lit("**"), F.lit(""))
    has = lambda level: low.contains(f"{level} confidence") | low.contains(f"confidence: {level}")
    return F.when(has("high"), 0.9).when(has("medium"), 0.6).when(has("low"), 0.3).when(contains_any(low, UNCERTAIN), 0.4).otherwise(0.7)


def feed_by_graph(seeds: DataFrame, reached: DataFrame, mentions: DataFrame, chunks_per_node: int = 3, score: float = 0.5) -> DataFrame:
    """Chunks of the nodes that a traversal reached, some per node, appended to the direct hits unless they are among them.

    ``seeds`` is ``chunk_id, score``; ``reached`` has ``id`` and ``mentions`` ``chunk_id, entity_id``.
    """
    near = mentions.join(reached.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("entity_id").orderBy("chunk_id"))).where(F.col("r") <= chunks_per_node)
    more = near.select("chunk_id").distinct().join(seeds, "chunk_id", "left_anti").withColumn("score", F.lit(score)).withColumn("origin", F.lit("graph"))
    return seeds.select("chunk_id", "score", F.lit("direct").alias("origin")).unionByName(more.select("chunk_id", "score", "origin"))


def community_chunks(sizes: DataFrame, members: DataFrame, mentions: DataFrame, communities: int = 3, per_community: int = 5, per_entity: int = 5) -> DataFrame:
    """``chunk_id``: chunks of the leading entities of the largest communities, some for each.

    ``sizes`` is ``community_id, entity_count``, ``members`` ``community_id,
    entity_id, weight`` and ``mentions`` ``chunk_id, entity_id``. Ties go by id.
    """
    top = sizes.orderBy(F.desc("entity_count"), "community_id").limit(communities).select("community_id")
    of = members.join(F.broadcast(top), "community_id", "left_semi")
    lead = top_per(of, "community_id", [F.desc("weight"), "entity_id"], per_community).select("entity_id").distinct()
    return top_per(mentions.join(lead, "entity_id", "left_semi"), "entity_id", ["chunk_id"], per_entity).select("chunk_id").distinct()


def graph_enhanced(hits: DataFrame, mentions: DataFrame, relations: DataFrame, n_seeds: int = 5, depth: int = 2, nodes: int = 10, chunks_per_node: int = 3, most: int = 20) -> DataFrame:
    """Direct hits, then chunks of what a traversal reaches from the first ``n_seeds`` entities that the hits mention.

    ``hits`` is ``chunk_id, score``. From each seed the first ``nodes`` nodes by
    depth and id count, itself included, ``depth`` undirected steps away at most.
    Each level is written, so that none computes those before again.
    """
    work = Written(hits.sparkSession, "graph-enhanced")
    of = work.table(unique_entities(hits, mentions, n_seeds), "seeds")
    ends = either_way(relations).distinct()
    seen = front = of.select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth"))
    for d in range(1, depth + 1):
        step = ends.join(front.select("seed", F.col("id").alias("a")), "a").select("seed", F.col("b").alias("id")).distinct()
        front = work.table(step.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").select("seed", "id", F.lit(d).alias("depth")), "level")
        seen = seen.union(front)
    reached = seen.withColumn("r", F.row_number().over(Window.partitionBy("seed").orderBy("depth", "id"))).where(F.col("r") <= nodes).select("id").distinct()
    return feed_by_graph(hits, reached, mentions, chunks_per_node).orderBy(F.when(F.col("origin") == "direct", 0).otherwise(1), F.desc("score"), "chunk_id").limit(most)


def unique_entities(hits: DataFrame, mentions: DataFrame, most: int = 5) -> DataFrame:
    """``id``: the first distinct entities that the hits mention, by id."""
    return mentions.join(hits.select("chunk_id"), "chunk_id", "left_semi").select(F.col("entity_id").alias("id")).distinct().orderBy("id").limit(most)


def context_totals(packed: DataFrame, per_token: int = 4) -> DataFrame:
    """``query_id, chars, tokens, sources`` of a packed context: the mark of a cut chunk counts for nothing, and it is no source."""
    n = F.when(F.col("is_source"), F.length("text")).otherwise(F.length("text") - 3)
    return packed.groupBy("query_id").agg(F.sum(n).cast("bigint").alias("chars"), F.sum("tokens").cast("bigint").alias("tokens"), F.count_distinct(F.when(F.col("is_source"), F.col("id"))).alias("sources"))


def entity_preamble(entities: DataFrame, most: int = 10) -> DataFrame:
    """``query_id, text``: a query's first entities, from ``query_id, position, name, entity_type, description``."""
    line = F.concat(F.lit("- **"), F.coalesce("name", F.lit("Unknown")), F.lit("** ("), F.coalesce("entity_type", F.lit("entity")), F.lit(")"), F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit("\n  "), "description")).otherwise(""))
    lists = first_of(entities, "query_id", "position", most).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("_r", line.alias("l")))).alias("x"))
    return lists.select("query_id", F.concat(F.lit(wording.ENTITIES_HEAD), F.array_join(F.transform("x", lambda x: x["l"]), "\n"), F.lit("\n\n")).alias("text"))


def graph_preamble(nodes: DataFrame, edges: DataFrame, most_nodes: int = 15, most_edges: int = 10) -> DataFrame:
    """``query_id, text``: a traversal's first nodes and edges, from ``query_id, position, name, type`` and ``query_id, position, source, relation_type, target``."""
    n = F.concat(F.lit("- "), "name", F.lit(" ("), F.coalesce("type", F.lit("entity")), F.lit(")"))
    e = F.concat(F.lit("- "), "source", F.lit(" → "), F.coalesce("relation_type", F.lit("relates to")), F.lit(" → "), "target")

    def block(d: DataFrame, line: Column, most: int, name: str) -> DataFrame:
        return first_of(d, "query_id", "position", most).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("_r", line.alias("l")))).alias("x")).select("query_id", F.array_join(F.transform("x", lambda x: x["l"]), "\n").alias(name))

    both = block(nodes, n, most_nodes, "n").join(block(edges, e, most_edges, "e"), "query_id", "left")
    return both.select("query_id", F.concat(F.lit(wording.GRAPH_HEAD), "n", F.when(F.col("e").isNotNull(), F.concat(F.lit(wording.RELATIONS_HEAD), "e")).otherwise(""), F.lit("\n\n")).alias("text"))


def with_preamble(chunks: DataFrame, preamble: DataFrame, name: str, chunk_id: str) -> DataFrame:
    """``query_id, rank, id, name, text`` of a context with a text before its chunks, at rank 0; a context without chunks stays empty."""
    first = preamble.join(chunks.select("query_id").distinct(), "query_id", "left_semi").select("query_id", F.lit(0).alias("rank"), F.lit(chunk_id).alias("id"), F.lit(name).alias("name"), "text")
    return first.union(chunks.select("query_id", "rank", F.col("id").cast("string"), "name", "text"))


def split_reasoning(answer: Column) -> Column:
    """A struct of ``reasoning`` and ``answer`` of a model's answer in marked parts; a text that is not in such parts is all answer."""
    parts = F.split(answer, r"\*\*Answer:\*\*", -1)
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    marked = answer.contains("**Reasoning:**") & (F.size(parts) == 2)
    said = trim(F.split(F.get(parts, F.lit(1)), r"\*\*Confidence:\*\*", 2)[0])
    return F.struct(F.when(marked, trim(F.replace(F.get(parts, F.lit(0)), F.lit("**Reasoning:**"), F.lit("")))).alias("reasoning"), F.when(marked, said).otherwise(answer).alias("answer"))


def follow_ups(answer: Column, most: int = 3) -> Column:
    """The first questions of a model's JSON list; what is no text is left out, and a broken list is empty."""
    items = F.try_variant_get(F.try_parse_json(answer), "$", "array<variant>")
    texts = F.filter(items, lambda x: F.schema_of_variant(x) == "STRING")
    return F.coalesce(F.slice(F.transform(texts, lambda x: F.try_variant_get(x, "$", "string")), 1, most), F.array().cast("array<string>"))
