"""Ranking and fusion: BM25, vector neighbours, reciprocal ranks, reranking."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from brindle.functions import wording
from brindle.functions.text import squash, tokens
from brindle.functions.vector import cosine
from brindle.shared import Written

K1, B, FLOOR = 1.2, 0.75, 1e-6


def bm25(docs: DataFrame, terms: list[str], mode: str = "and", limit: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, raw, score`` of documents that hold all (``and``) or any (``or``) of the terms.

    Texts are read once, when this is called: term counts are taken inside each
    row, the corpus statistics are observed on the way, and the counts of what
    matches are written. For more than a query or two over one corpus there is
    ``operators.index``.
    """
    terms = list(dict.fromkeys(t.lower() for t in terms))
    if not terms or mode not in ("and", "or"):
        raise ValueError("terms and mode must be given")
    d = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("t"))
    d = d.select("id", F.size("t").alias("dl"), *(_count("t", t).alias(f"tf{i}") for i, t in enumerate(terms)))
    seen = Observation()
    d = d.observe(seen, F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *(F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"n{i}") for i in range(len(terms))))
    hits = [F.col(f"tf{i}") > 0 for i in range(len(terms))]
    found = Written(docs.sparkSession, "bm25").table(d.where(reduce(lambda a, b: a & b if mode == "and" else a | b, hits)), "hits")
    g = seen.get

    def part(i: int) -> Column:
        tf, n = F.col(f"tf{i}"), g[f"n{i}"]
        idf = math.log((g["n"] - n + 0.5) / (n + 0.5))
        return (idf if idf > 0 else FLOOR) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / (g["avgdl"] or 1.0)))

    out = found.select("id", F.round(reduce(lambda a, b: a + b, map(part, range(len(terms)))), 6).alias("raw"))
    out = out.select("id", "raw", F.round(squash(F.col("raw")), 6).alias("score"))
    return out.orderBy(F.desc("raw"), "id").limit(limit) if limit else out


def _count(column: str, term: str) -> Column:
    return F.size(column) - F.size(F.array_remove(column, term))


def nearest(vectors: DataFrame, query: DataFrame, limit: int | None = None, least: float | None = None, id_col: str = "vec_id") -> DataFrame:
    """``id, score``: cosine similarity of every vector to the one row of ``query`` (``q``), at least ``least``, best first."""
    out = vectors.join(F.broadcast(query.limit(1))).select(F.col(id_col).alias("id"), F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
    out = out.where(F.col("score") >= least) if least is not None else out
    return out.orderBy(F.desc("score"), "id").limit(limit) if limit else out


def ranked(d: DataFrame, score: str = "score", by: tuple[str, ...] = (), most: int = 1000) -> DataFrame:
    """``rank`` from 1 by falling score, then id, within ``by``; cut at ``most``. Meant for top-k lists, which are short."""
    return d.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), "id"))).where(F.col("rank") <= most)


def rrf(rankings: DataFrame, k: int = 60, normalise: bool = True, top_k: int = 0) -> DataFrame:
    """``id, rrf, rank, sources`` from ``source, id, score``: the sum of 1 / (k + rank), divided by the largest."""
    lists = ranked(rankings, by=("source",))
    out = lists.groupBy("id").agg(F.sum(1 / (F.lit(float(k)) + F.col("rank"))).alias("rrf"), F.array_sort(F.collect_list(F.concat_ws(":", "source", F.col("rank").cast("string")))).alias("sources"))
    if normalise:
        out = out.withColumn("rrf", F.col("rrf") / F.max("rrf").over(Window.partitionBy()))
    out = out.select("id", F.round("rrf", 8).alias("rrf"), F.array_join("sources", ",").alias("sources"))
    out = out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("rrf"), "id")))
    return out.where(F.col("rank") <= top_k) if top_k else out


def interpolate(rankings: DataFrame, weights: dict[str, float], k: int = 60) -> DataFrame:
    """``id, weighted, rrf``, ordered by rrf: both the weighted sum of scores and the rank sum are returned."""
    if abs(sum(weights.values()) - 1) > 1e-6:
        raise ValueError("weights must sum to 1")
    lists = ranked(rankings.where(F.col("source").isin(*weights)), by=("source",))
    w = reduce(lambda c, x: c.when(F.col("source") == x[0], x[1]), list(weights.items())[1:], F.when(F.col("source") == next(iter(weights)), next(iter(weights.values()))))
    out = lists.groupBy("id").agg(F.sum(w * F.col("score")).alias("weighted"), F.sum(1 / (F.lit(float(k)) + F.col("rank"))).alias("rrf"))
    return out.select("id", F.round("weighted", 6).alias("weighted"), F.round("rrf", 8).alias("rrf"))


def hybrid(text_hits: DataFrame, vector_hits: DataFrame, limit: int = 10, k: int = 60, weights: tuple[float, float] = (0.5, 0.5), min_score: float = 0.0) -> DataFrame:
    """Weighted reciprocal ranks of two legs, each cut at twice the limit; the threshold applies after the cut to ``limit``."""
    a = ranked(text_hits, most=2 * limit).select("id", F.col("rank").alias("bm25_rank"), F.col("score").alias("bm25_score"))
    b = ranked(vector_hits, most=2 * limit).select("id", F.col("rank").alias("vector_rank"), F.col("score").alias("vector_score"))
    both = a.join(b, "id", "full_outer")
    part = lambda c, w: F.coalesce(w / (k + F.col(c)), F.lit(0.0))
    out = both.withColumn("score", F.round(part("bm25_rank", weights[0]) + part("vector_rank", weights[1]), 8))
    source = F.when(F.col("bm25_rank").isNotNull() & F.col("vector_rank").isNotNull(), "hybrid").when(F.col("bm25_rank").isNotNull(), "bm25").otherwise("vector")
    out = out.select("id", "score", F.coalesce("bm25_score", F.lit(0.0)).alias("bm25_score"), F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"), source.alias("source"))
    return out.orderBy(F.desc("score"), "id").limit(limit).where(F.col("score") >= min_score)


def overlap_scorer(text: Column, terms: list[str]) -> Column:
    """A deterministic pair scorer: the share of the query's terms that the text holds."""
    own = list(dict.fromkeys(terms))
    return F.size(F.array_intersect(tokens(text), F.array(*map(F.lit, own)))) / len(own)


def rerank(hits: DataFrame, docs: DataFrame, terms: list[str], top_k: int = 10, scorer=overlap_scorer, id_col: str = "doc_id") -> DataFrame:
    """``0.7 * scorer + 0.3 * min(1, hybrid)`` for hits ``id, score``; the hits are a short list."""
    texts = docs.select(F.col(id_col).alias("id"), "text")
    out = texts.join(F.broadcast(hits), "id").withColumn("ce", F.round(scorer(F.col("text"), terms), 6)).drop("text")
    out = out.withColumn("reranked", F.round(0.7 * F.col("ce") + 0.3 * F.least(F.lit(1.0), F.col("score")), 6))
    return out.orderBy(F.desc("reranked"), "id").limit(top_k)


def rerank_many(lists: dict[str, tuple[DataFrame, list[str]]], docs: DataFrame, top_k: int = 10, scorer=overlap_scorer, id_col: str = "doc_id") -> DataFrame:
    """Reranked lists of several wordings (name to hits and terms), fused by reciprocal ranks: ``id, rrf, rank, sources``."""
    one = lambda name, hits, terms: rerank(hits, docs, terms, top_k, scorer, id_col).select(F.lit(name).alias("source"), "id", F.col("reranked").alias("score"))
    return rrf(reduce(lambda a, b: a.union(b), (one(n, *x) for n, x in lists.items())))


def explain_rank(vector: Column, bm25_: Column, ce: Column, source: Column) -> Column:
    """The reasons for a rank, in words."""
    parts = F.concat_ws(
        ", ",
        F.when(vector > 0.5, wording.RANK_VECTOR),
        F.when(bm25_ > 0.5, wording.RANK_KEYWORD),
        F.when(ce > 0.5, wording.RANK_HIGH).when(ce < 0.1, wording.RANK_LOW),
        F.when(source == "hybrid", wording.RANK_BOTH),
    )
    why = F.when(parts == "", wording.RANK_ELSE).otherwise(parts)
    return F.concat(F.lit(wording.RANK_HEAD), why, F.lit(wording.RANK_TAIL), F.format_string("%.3f", ce), F.lit("."))


def rank_factors(weight: float = 0.7) -> Column:
    """A map of what a rank was made of, from ``vector_score, bm25_score, score, ce``."""
    return F.create_map(F.lit("vector_score"), "vector_score", F.lit("bm25_score"), "bm25_score", F.lit("hybrid_fusion"), "score", F.lit("cross_encoder"), "ce", F.lit("rerank_weight"), F.lit(weight))


def multi_query(lists: DataFrame, k: int = 60) -> DataFrame:
    """From ``query, id, score``: the score in the first query's list that has the id, plus 1 / (k + rank) for each list."""
    r = ranked(lists, by=("query",))
    out = r.groupBy("id").agg(F.min(F.struct("query", "score")).alias("first"), F.sum(1 / (F.lit(float(k)) + F.col("rank"))).alias("s"))
    return out.select("id", F.round(F.col("first.score") + F.col("s"), 8).alias("score"))
