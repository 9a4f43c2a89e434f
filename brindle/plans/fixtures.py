"""The given tables read as this engine's data model, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """``id, name, entity_type, community``: customers, suppliers and parts; a community is a nation, none for parts."""
    c, s, p = (table(spark, sf, n) for n in ("customer", "supplier", "part"))
    key = lambda prefix, col: F.concat(F.lit(prefix), F.col(col).cast("string")).alias("id")
    return (
        c.select(key("c:", "c_custkey"), F.col("c_name").alias("name"), F.lit("customer").alias("entity_type"), F.col("c_nationkey").cast("string").alias("community"))
        .union(s.select(key("s:", "s_suppkey"), "s_name", F.lit("supplier"), F.col("s_nationkey").cast("string")))
        .union(p.select(key("p:", "p_partkey"), "p_name", F.lit("part"), F.lit(None).cast("string")))
    )


def relations(spark: SparkSession, sf: str) -> DataFrame:
    """``src, dst, relation_type, confidence``: customers order parts, suppliers supply them."""
    o, i = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    ordered = i.join(o, i.l_orderkey == o.o_orderkey).groupBy("o_custkey", "l_partkey").agg(F.max("l_discount").alias("confidence"))
    supplied = i.groupBy("l_suppkey", "l_partkey").agg(F.max("l_discount").alias("confidence"))
    key = lambda prefix, col, name: F.concat(F.lit(prefix), F.col(col).cast("string")).alias(name)
    return ordered.select(key("c:", "o_custkey", "src"), key("p:", "l_partkey", "dst"), F.lit("ORDERED").alias("relation_type"), "confidence").union(
        supplied.select(key("s:", "l_suppkey", "src"), key("p:", "l_partkey", "dst"), F.lit("SUPPLIES"), "confidence")
    )


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """``chunk_id, doc_id, chunk_index, text``: the lines of a document that hold more than spaces."""
    d = table(spark, sf, "documents")
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")
    return d.select("doc_id", F.posexplode(lines).alias("chunk_index", "text")).select(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), "doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "text")


TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')"
ENTITIES = """entities AS (
  SELECT 'c:' || c_custkey AS id, c_name AS name, 'customer' AS entity_type, CAST(c_nationkey AS VARCHAR) AS community FROM customer
  UNION ALL SELECT 's:' || s_suppkey, s_name, 'supplier', CAST(s_nationkey AS VARCHAR) FROM supplier
  UNION ALL SELECT 'p:' || p_partkey, p_name, 'part', NULL FROM part)"""
RELATIONS = """relations AS (
  SELECT 'c:' || o_custkey AS src, 'p:' || l_partkey AS dst, 'ORDERED' AS relation_type, max(l_discount) AS confidence FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL
  UNION ALL SELECT 's:' || l_suppkey, 'p:' || l_partkey, 'SUPPLIES', max(l_discount) FROM lineitem GROUP BY ALL)"""
CHUNKS = """chunks AS (
  SELECT doc_id || ':' || (i - 1) AS chunk_id, doc_id, CAST(i - 1 AS BIGINT) AS chunk_index, a[i] AS text
  FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i
        FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS a FROM documents)))"""


def bm25_sql(terms: list[str], mode: str = "and", name: str = "bm25", source: str = "documents") -> str:
    """CTEs that end in ``name`` with ``id, raw, score``."""
    tf = ", ".join(f"len(list_filter(toks, lambda t: t = '{t}')) AS tf{i}" for i, t in enumerate(terms))
    ns = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS n{i}" for i in range(len(terms)))
    idf = lambda i: f"(CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) <= 0 THEN 0.000001::DOUBLE ELSE ln((n - n{i} + 0.5) / (n{i} + 0.5)) END)"
    part = lambda i: f"{idf(i)} * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))"
    cond = f" {mode} ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""{name}_t AS (SELECT doc_id AS id, {TOKENS} AS toks FROM {source}),
    {name}_d AS (SELECT id, len(toks) AS dl, {tf} FROM {name}_t),
    {name}_g AS (SELECT count(*) AS n, avg(dl) AS avgdl, {ns} FROM {name}_d),
    {name}_r AS (SELECT id, round({" + ".join(map(part, range(len(terms))))}, 6) AS raw FROM {name}_d, {name}_g WHERE {cond}),
    {name} AS (SELECT id, raw, round(raw / (raw + 1), 6) AS score FROM {name}_r)"""


NEAREST = """nearest AS (
  SELECT e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
  FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"""


def hybrid_sql(text: str, vector: str = "nearest", limit: int = 10, name: str = "hybrid") -> str:
    return f"""{name}_a AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS r FROM {text} QUALIFY r <= {2 * limit}),
    {name}_b AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS r FROM {vector} QUALIFY r <= {2 * limit}),
    {name}_f AS (SELECT coalesce(a.id, b.id) AS id, round(coalesce(0.5::DOUBLE / (60 + a.r), 0) + coalesce(0.5::DOUBLE / (60 + b.r), 0), 8) AS score,
      coalesce(a.score, 0) AS bm25_score, coalesce(b.score, 0) AS vector_score,
      CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN 'hybrid' WHEN a.id IS NOT NULL THEN 'bm25' ELSE 'vector' END AS source
      FROM {name}_a a FULL OUTER JOIN {name}_b b ON a.id = b.id),
    {name} AS (SELECT * FROM {name}_f ORDER BY score DESC, id LIMIT {limit})"""
