"""Search, fusion and reranking over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.text import tokens
from brindle.operators import modularity, search, vectors
from brindle.plans.catalog import query
from brindle.plans.fixtures import NEAREST, TOKENS, bm25_sql, hybrid_sql, table

ANY, ALL, OTHER = ["ach", "ado"], ["del", "su"], ["aiai", "aielle", "aian"]


def _bm25(spark: SparkSession, sf: str, terms: list[str], mode: str = "or", limit: int | None = None) -> DataFrame:
    return search.bm25(table(spark, sf, "documents"), terms, mode, limit)


def _near(spark: SparkSession, sf: str, limit: int | None = None, least: float | None = None) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return search.nearest(e, e.where("vec_id = 0").select(F.col("embedding").alias("q")), limit, least)


def _hybrid(spark: SparkSession, sf: str, terms: list[str] = ANY, limit: int = 10) -> DataFrame:
    return search.hybrid(_bm25(spark, sf, terms), _near(spark, sf), limit)


@query("bm25_search", f"WITH {bm25_sql(ALL)} SELECT id, raw, score, source AS doc_source FROM bm25 JOIN documents ON doc_id = id ORDER BY raw DESC, id LIMIT 20")
def bm25_search(spark, sf):
    hits = _bm25(spark, sf, ALL, "and", 20)
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("doc_source")).join(F.broadcast(hits), "id").select("id", "raw", "score", "doc_source")


@query("bm25_any", f"WITH {bm25_sql(ANY, 'or')} SELECT id, raw, score FROM bm25")
def bm25_any(spark, sf):
    return _bm25(spark, sf, ANY, "or")


@query("vector_search", f"WITH {NEAREST} SELECT id, score FROM nearest ORDER BY score DESC, id LIMIT 10")
def vector_search(spark, sf):
    return _near(spark, sf, 10)


@query("vector_threshold", f"WITH {NEAREST} SELECT id, score FROM nearest WHERE score >= 0.2")
def vector_threshold(spark, sf):
    """Keeps what is at least as similar as the threshold."""
    return _near(spark, sf, None, 0.2)


@query(
    "vector_filtered",
    """SELECT e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
       FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label IN (1, 3, 5) AND e.vec_id >= 10 ORDER BY score DESC, id LIMIT 10""",
)
def vector_filtered(spark, sf):
    from brindle.operators.store import metadata_filter

    e = table(spark, sf, "embeddings")
    return search.nearest(e.where(metadata_filter({"label": {"$in": [1, 3, 5]}, "vec_id": {"$gte": 10}})), e.where("vec_id = 0").select(F.col("embedding").alias("q")), 10)


@query("hybrid_rrf", f"WITH {bm25_sql(ANY, 'or')}, {NEAREST}, {hybrid_sql('bm25')} SELECT * FROM hybrid")
def hybrid_rrf(spark, sf):
    """Documents and vectors have ids of their own; equal numbers are taken for one item."""
    return _hybrid(spark, sf)


@query(
    "hybrid_filtered",
    f"""WITH docs AS (SELECT * FROM documents WHERE lang = 'en'), {bm25_sql(["the", "ouer"], "or", source="docs")}, {NEAREST},
    near AS (SELECT n.* FROM nearest n JOIN docs ON doc_id = id), {hybrid_sql("bm25", "near")} SELECT * FROM hybrid""",
)
def hybrid_filtered(spark, sf):
    """Both legs are filtered on the document's columns before they rank."""
    docs = table(spark, sf, "documents").where("lang = 'en'")
    near = _near(spark, sf).join(docs.select(F.col("doc_id").alias("id")), "id", "left_semi")
    return search.hybrid(search.bm25(docs, ["the", "ouer"], "or"), near)


_LISTS = """lists AS (
  SELECT 'chars' AS source, doc_id AS id, CAST(n_chars AS DOUBLE) AS score FROM (SELECT * FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50)
  UNION ALL SELECT 'lines', doc_id, CAST(n AS DOUBLE) FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents ORDER BY n DESC, doc_id LIMIT 50)
  UNION ALL SELECT 'commas', doc_id, CAST(n AS DOUBLE) FROM (SELECT doc_id, length(text) - length(replace(text, ',', '')) AS n FROM documents ORDER BY n DESC, doc_id LIMIT 50)),
  ranks AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, id) AS r FROM lists)"""


def _lists(spark, sf):
    d = table(spark, sf, "documents")
    made = {"chars": F.col("n_chars"), "lines": F.size(F.split("text", "\n", -1)), "commas": F.length("text") - F.length(F.replace("text", F.lit(","), F.lit("")))}
    parts = [d.select(F.lit(k).alias("source"), F.col("doc_id").alias("id"), c.cast("double").alias("score")).orderBy(F.desc("score"), "id").limit(50) for k, c in made.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("rrf_fuse", f"WITH {_LISTS}, s AS (SELECT id, round(sum(1.0::DOUBLE / (60 + r)), 8) AS rrf FROM ranks GROUP BY id) SELECT id, rrf, row_number() OVER (ORDER BY rrf DESC, id) AS rank FROM s ORDER BY rank LIMIT 20")
def rrf_fuse(spark, sf):
    return search.rrf(_lists(spark, sf), normalise=False, top_k=20).select("id", "rrf", F.col("rank").cast("bigint").alias("rank"))


@query("rrf_normalised", f"WITH {_LISTS}, s AS (SELECT id, sum(1.0::DOUBLE / (60 + r)) AS x FROM ranks GROUP BY id) SELECT id, round(x / max(x) OVER (), 8) AS rrf FROM s")
def rrf_normalised(spark, sf):
    return search.rrf(_lists(spark, sf)).select("id", "rrf")


@query("rrf_named", f"WITH {_LISTS} SELECT id, round(sum(1.0::DOUBLE / (60 + r)), 8) AS rrf, string_agg(source || ':' || r, ',' ORDER BY source || ':' || r) AS sources FROM ranks GROUP BY id")
def rrf_named(spark, sf):
    return search.rrf(_lists(spark, sf), normalise=False).select("id", "rrf", "sources")


@query(
    "rrf_interpolate",
    f"WITH {_LISTS} SELECT id, round(sum(score * CASE source WHEN 'chars' THEN 0.5::DOUBLE WHEN 'lines' THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END), 6) AS weighted, round(sum(1.0::DOUBLE / (60 + r)), 8) AS rrf FROM ranks GROUP BY id ORDER BY rrf DESC, id LIMIT 25",
)
def rrf_interpolate(spark, sf):
    return search.interpolate(_lists(spark, sf), {"chars": 0.5, "lines": 0.3, "commas": 0.2}).orderBy(F.desc("rrf"), "id").limit(25)


_MULTI = f"""{bm25_sql(ANY, "or", "b1")}, {bm25_sql(OTHER, "or", "b2")}, {NEAREST}, {hybrid_sql("b1", limit=20, name="h1")}, {hybrid_sql("b2", limit=20, name="h2")},
  ls AS (SELECT 1 AS q, id, score FROM h1 UNION ALL SELECT 2, id, score FROM h2),
  rk AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS r FROM ls)"""


def _two(spark, sf):
    return _hybrid(spark, sf, ANY, 20).select(F.lit(1).alias("query"), "id", "score").union(_hybrid(spark, sf, OTHER, 20).select(F.lit(2), "id", "score"))


@query("multi_query", f"WITH {_MULTI}, s AS (SELECT id, round(arg_min(score, q) + sum(1.0::DOUBLE / (60 + r)), 8) AS score FROM rk GROUP BY id) SELECT id, score FROM s ORDER BY score DESC, id LIMIT 10")
def multi_query(spark, sf):
    """An id's first list gives its base score, every list adds its reciprocal rank."""
    return search.multi_query(_two(spark, sf)).orderBy(F.desc("score"), "id").limit(10)


def _ce(terms):
    return f"round(len(list_intersect(list_distinct({TOKENS}), {terms})) / {len(terms)}::DOUBLE, 6)"


_RERANK = f"""{bm25_sql(ANY, "or")}, {NEAREST}, {hybrid_sql("bm25", limit=50)},
  rr AS (SELECT h.*, {_ce(ANY)} AS ce FROM hybrid h JOIN documents ON doc_id = id),
  fin AS (SELECT id, score, bm25_score, vector_score, source, ce, round(0.7::DOUBLE * ce + 0.3::DOUBLE * least(1.0, score), 6) AS reranked FROM rr)"""


@query("rerank", f"WITH {_RERANK} SELECT id, score, ce, reranked FROM fin ORDER BY reranked DESC, id LIMIT 10")
def rerank(spark, sf):
    return search.rerank(_hybrid(spark, sf, ANY, 50), table(spark, sf, "documents"), ANY).select("id", "score", "ce", "reranked")


@query(
    "rerank_explain",
    f"""WITH {_RERANK}, top AS (SELECT * FROM fin ORDER BY reranked DESC, id LIMIT 10),
    p AS (SELECT *, concat_ws(', ', CASE WHEN vector_score > 0.5 THEN 'strong semantic match (high vector score)' END, CASE WHEN bm25_score > 0.5 THEN 'relevant keyword match (BM25)' END,
      CASE WHEN ce > 0.5 THEN 'high cross-encoder relevance' WHEN ce < 0.1 THEN 'low cross-encoder relevance' END, CASE WHEN source = 'hybrid' THEN 'found by both vector and keyword search' END) AS w FROM top)
    SELECT id, reranked, 'Document ranked highly due to: ' || CASE WHEN w = '' THEN 'moderate relevance across methods' ELSE w END || '. Cross-encoder relevance: ' || printf('%.3f', ce) || '.' AS explanation FROM p""",
)
def rerank_explain(spark, sf):
    """Explanations are joined to results by id."""
    top = search.rerank(_hybrid(spark, sf, ANY, 50), table(spark, sf, "documents"), ANY)
    return top.select("id", "reranked", search.explain_rank(F.col("vector_score"), F.col("bm25_score"), F.col("ce"), F.col("source")).alias("explanation"))


@query(
    "rerank_rrf",
    f"""WITH {bm25_sql(ANY, "or", "b1")}, {bm25_sql(OTHER, "or", "b2")}, {NEAREST}, {hybrid_sql("b1", limit=50, name="h1")}, {hybrid_sql("b2", limit=50, name="h2")},
    r1 AS (SELECT 1 AS q, h.id, round(0.7::DOUBLE * {_ce(ANY)} + 0.3::DOUBLE * least(1.0, score), 6) AS s FROM h1 h JOIN documents ON doc_id = h.id ORDER BY s DESC, h.id LIMIT 10),
    r2 AS (SELECT 2 AS q, h.id, round(0.7::DOUBLE * {_ce(OTHER)} + 0.3::DOUBLE * least(1.0, score), 6) AS s FROM h2 h JOIN documents ON doc_id = h.id ORDER BY s DESC, h.id LIMIT 10),
    u AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, id) AS r FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2)), f AS (SELECT id, sum(1.0::DOUBLE / (60 + r)) AS x FROM u GROUP BY id)
    SELECT id, round(x / max(x) OVER (), 8) AS rrf FROM f""",
)
def rerank_rrf(spark, sf):
    docs = table(spark, sf, "documents")
    return search.rerank_many({"1": (_hybrid(spark, sf, ANY, 50), ANY), "2": (_hybrid(spark, sf, OTHER, 50), OTHER)}, docs).select("id", "rrf")


@query(
    "corrective",
    f"""WITH {bm25_sql(ANY, "or")}, {NEAREST}, {hybrid_sql("bm25", limit=20)}, n AS (SELECT id, round(score / max(score) OVER (), 6) AS relevance FROM hybrid)
    SELECT id, relevance, CASE WHEN relevance >= 0.7 THEN 'correct' WHEN relevance >= 0.4 THEN 'ambiguous' ELSE 'incorrect' END AS verdict FROM n""",
)
def corrective(spark, sf):
    """Thresholds apply to scores divided by the largest, so that they can be reached."""
    from brindle.operators.rag import corrective_buckets

    return corrective_buckets(_hybrid(spark, sf, ANY, 20))


@query(
    "jaccard_pairs",
    f"""WITH s AS (SELECT doc_id AS id, list_sort(list_distinct({TOKENS})) AS w FROM documents), g AS (SELECT id, w, min(id) OVER (PARTITION BY w) AS rep FROM s WHERE len(w) > 0), u AS (SELECT id, len(w) AS n, unnest(w) AS t FROM g WHERE id = rep),
    p AS (SELECT a.id AS a, b.id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM u a JOIN u b ON a.t = b.t AND a.id < b.id AND least(a.n, b.n) >= 0.9 * greatest(a.n, b.n) GROUP BY 1, 2)
    SELECT a, b, round(c / (na + nb - c)::DOUBLE, 6) AS jaccard FROM p WHERE c / (na + nb - c)::DOUBLE > 0.9 UNION ALL SELECT rep, id, 1.0::DOUBLE FROM g WHERE id <> rep""",
)
def jaccard_pairs(spark, sf):
    """Pairs of documents with different word sets, and who has the same; a shared rare word makes a pair a candidate, so no cross join is needed."""
    from brindle.operators.rag import jaccard_over

    return jaccard_over(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.array_distinct(tokens(F.col("text"))).alias("w")), 0.9)


def _asked(spark, sf):
    return table(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def _index(spark, sf):
    return vectors.build(table(spark, sf, "embeddings"), keep=["label"])


_EXACT = """x AS (SELECT q.vec_id AS query_id, e.vec_id AS id, e.label, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)"""


@query("ann_exact", f"WITH {_EXACT} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM x QUALIFY rank <= 10")
def ann_exact(spark, sf):
    """The ten nearest of all vectors for every vector whose id is divisible by 50, compared with all."""
    return vectors.exact(table(spark, sf, "embeddings"), _asked(spark, sf))


@query("ann_search")
def ann_search(spark, sf):
    """The same through the index; its recall is what ``ann_recall`` reports."""
    return vectors.search(_index(spark, sf), _asked(spark, sf))


@query("ann_recall")
def ann_recall(spark, sf):
    """Recall at 10 of every query against the exact scan."""
    return vectors.recall(ann_search(spark, sf), ann_exact(spark, sf))


@query("ann_filtered", f"WITH {_EXACT} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM x WHERE label IN (1, 3) QUALIFY rank <= 5")
def ann_filtered(spark, sf):
    """With a filter on a kept column, and every cell probed: the exact result."""
    return vectors.search(_index(spark, sf), _asked(spark, sf), 5, 1 << 20, F.col("label").isin(1, 3), over=8)


@query("community_modularity")
def community_modularity(spark, sf):
    """Communities of the graph of every vector's five nearest, found through the index, at two resolutions."""
    e = table(spark, sf, "embeddings")
    near = vectors.search(_index(spark, sf), e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 6, probes=8)
    edges = near.where("query_id != id").select(F.col("query_id").alias("src"), F.col("id").alias("dst"), F.greatest("score", F.lit(0.0)).alias("weight"))
    return modularity.communities(edges, (1.2, 0.8), refine=6)[0]
