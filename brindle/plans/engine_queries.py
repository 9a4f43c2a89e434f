"""Sources, indexes, batches, contexts and models over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from brindle.engine import fallback, provider, recommend
from brindle.functions.text import tokens
from brindle.functions.vector import cosine, hashing_embedder
from brindle.operators import graph, index, metrics, rag, records, search, store
from brindle.operators.segments import IndexStore
from brindle.operators.snapshots import Snapshots
from brindle.plans.base_queries import _BLANK, _html_sql
from brindle.plans.catalog import query
from brindle.plans.fixtures import ENTITIES, NEAREST, RELATIONS, TOKENS, bm25_sql, chunks, entities, relations, table
from brindle.plans.graph_queries import _MENTIONS, _mentions
from brindle.plans.search_queries import ANY, _RERANK, _hybrid, _near
from brindle.plans.text_queries import _HITS, _hits
from brindle.shared import Written, small_batches
from brindle.sources import files

# files

_FILES = f"f AS (SELECT doc_id, doc_id || ext AS path, ext, CASE ext WHEN '.json' THEN CASE WHEN doc_id % 4 = 0 THEN '{{\"n\": ' || doc_id || '}}' ELSE text END WHEN '.csv' THEN 'id,n' || chr(10) || doc_id || ',\"a, b\"' || chr(10) ELSE text END AS text FROM documents, (VALUES ('.md'), ('.txt'), ('.json'), ('.csv'), ('.xyz'), ('.html')) AS k(ext))"


def _files(spark, sf):
    """Every document as a file of each of six extensions, some of which cannot be read."""
    ext = F.col("ext")
    text = F.when(ext == ".json", F.when(F.col("doc_id") % 4 == 0, F.format_string('{"n": %s}', F.col("doc_id").cast("string"))).otherwise(F.col("text"))).when(ext == ".csv", F.format_string('id,n\n%s,"a, b"\n', F.col("doc_id").cast("string"))).otherwise(F.col("text"))
    content = F.encode(text, "utf-8")
    kinds = F.explode(F.array(*map(F.lit, (".md", ".txt", ".json", ".csv", ".xyz", ".html"))))
    return table(spark, sf, "documents").withColumn("ext", kinds).select(F.concat(F.col("doc_id").cast("string"), ext).alias("path"), F.length(content).cast("bigint").alias("length"), content.alias("content"))


@query(
    "file_validation",
    f"WITH {_FILES} SELECT path, CASE WHEN octet_length(encode(text)) > 104857 THEN 'file too large' WHEN ext = '.xyz' THEN 'unsupported extension' WHEN text = '' THEN 'empty file' WHEN ext = '.json' AND NOT json_valid(text) THEN 'not json' END AS error FROM f",
)
def file_validation(spark, sf):
    """Every file with what is wrong with it."""
    return files.checked(_files(spark, sf), 0.1).select("path", "error")


@query(
    "file_route",
    f"""WITH {_FILES}, g AS (SELECT *, text AS html FROM f WHERE ext <> '.xyz' AND text <> '' AND (ext <> '.json' OR json_valid(text)))
    SELECT path, CASE ext WHEN '.html' THEN 'html' WHEN '.json' THEN 'json' WHEN '.csv' THEN 'csv' ELSE 'text' END AS processor, sha256(text) AS raw_hash,
    CASE ext WHEN '.html' THEN {_html_sql()} WHEN '.json' THEN '# Data' || chr(10) || chr(10) || '```json' || chr(10) || '{{' || chr(10) || '  "n": ' || doc_id || chr(10) || '}}' || chr(10) || '```' || chr(10)
      WHEN '.csv' THEN '# ' || doc_id || chr(10) || chr(10) || '| id | n |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || doc_id || ' | a, b |' || chr(10)
      WHEN '.md' THEN CASE WHEN starts_with(text, '---') THEN text ELSE '---' || chr(10) || 'source: ' || path || chr(10) || 'processed: T' || chr(10) || '---' || chr(10) || chr(10) || text END ELSE text END AS content FROM g""",
)
def file_route(spark, sf):
    """Every readable file through the converter of its type."""
    return files.route(files.checked(_files(spark, sf)), "T").select("path", "processor", "raw_hash", "content")


@query("batch_results", "SELECT count(*) AS total, count(*) FILTER (WHERE text <> '' AND n_chars >= 200) AS done, count(*) FILTER (WHERE NOT (text <> '' AND n_chars >= 200)) AS failed, round(avg(CASE WHEN text <> '' AND n_chars >= 200 THEN 1 ELSE 0 END), 6) AS success_rate FROM documents")
def batch_results(spark, sf):
    """A batch over all documents that fails on short ones."""
    return records.progress(records.batch(table(spark, sf, "documents"), lambda t: F.when((t != "") & (F.length(t) >= 200), F.length(t))))


@query("append_documents", "SELECT 'old' AS origin, count(*) AS n FROM documents WHERE lang <> 'en' UNION ALL SELECT 'new', count(*) FROM documents WHERE lang = 'en' UNION ALL SELECT 'all', count(*) FROM documents")
def append_documents(spark, sf):
    """A table of documents that grows by an append."""

    d, at = table(spark, sf, "documents"), Written(spark, "append").path("documents")
    for origin, cond in (("old", "lang <> 'en'"), ("new", "lang = 'en'")):
        store.append(d.where(cond).select(F.lit(origin).alias("origin"), "doc_id", "text"), at)
    got = spark.read.parquet(at)
    return got.groupBy("origin").agg(F.count(F.lit(1)).alias("n")).union(got.select(F.lit("all").alias("origin")).groupBy("origin").agg(F.count(F.lit(1)).alias("n")))


@query(
    "ingest_documents",
    rf"""WITH t AS (SELECT DISTINCT text FROM documents WHERE text <> ''), d AS (SELECT 'doc_' || substring(sha256(text), 1, 16) AS document_id, {_BLANK} AS text FROM t)
    SELECT document_id, sum(len(list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '')))::BIGINT AS paragraphs FROM d GROUP BY 1""",
)
def ingest_documents(spark, sf):
    """Each content once, by the hash of what the file holds, with its paragraphs: chunks of one paragraph each."""
    from brindle.config import Settings
    from brindle.engine import Engine

    e = Engine(spark, settings=Settings(chunk_size=1, max_chunk_size=1, chunk_overlap=0))
    raw = table(spark, sf, "documents").where("text <> ''").select(F.col("text"), F.sha2("text", 256).alias("raw_hash"))
    new = e.fresh(raw.withColumn("content", F.replace("text", F.lit("\n"), F.lit("\n\n"))).withColumn("path", F.lit("x")))
    return e.chunk(new).groupBy("document_id").agg(F.count(F.lit(1)).alias("paragraphs"))


# models

_MODELS = "m AS (SELECT CASE p_partkey % 5 WHEN 0 THEN 'gpt-' WHEN 1 THEN 'Kimi-' WHEN 2 THEN 'x-' WHEN 3 THEN 'glm-' ELSE 'own-' END || p_partkey AS name, CASE WHEN p_partkey % 10 = 4 THEN 'meta/llama' WHEN p_partkey % 10 = 9 THEN 'lab/one' ELSE 'z' END AS owner, p_type AS task, p_size AS priority, p_partkey % 3 = 0 AS healthy FROM part)"
_PROVIDER = "CASE WHEN starts_with(name, 'gpt') THEN 'gpt' WHEN starts_with(name, 'Kimi') THEN 'kimi' WHEN starts_with(name, 'glm') THEN 'glm' WHEN owner = 'meta/llama' THEN 'llama' WHEN owner = 'lab/one' THEN 'lab' ELSE 'z' END"


def _models(spark, sf):
    k = F.col("p_partkey")
    name = F.concat(F.when(k % 5 == 0, "gpt-").when(k % 5 == 1, "Kimi-").when(k % 5 == 2, "x-").when(k % 5 == 3, "glm-").otherwise("own-"), k.cast("string"))
    owner = F.when(k % 10 == 4, "meta/llama").when(k % 10 == 9, "lab/one").otherwise("z")
    return table(spark, sf, "part").select(name.alias("name"), owner.alias("owner"), F.col("p_type").alias("task"), F.col("p_size").alias("priority"), (k % 3 == 0).alias("healthy"))


@query("model_provider", f"WITH {_MODELS} SELECT name, {_PROVIDER} AS provider FROM m")
def model_provider(spark, sf):
    return _models(spark, sf).select("name", provider(F.col("name"), F.col("owner")).alias("provider"))


@query("model_recommend", f"WITH {_MODELS} SELECT task, arg_min(name, (NOT healthy, priority, name)) AS name FROM m GROUP BY task")
def model_recommend(spark, sf):
    return recommend(_models(spark, sf))


@query("model_fallback", f"WITH {_MODELS}, p AS (SELECT *, {_PROVIDER} AS provider FROM m) SELECT name, provider FROM p WHERE provider <> 'gpt' ORDER BY priority, provider, healthy DESC, name LIMIT 1")
def model_fallback(spark, sf):
    d = _models(spark, sf).withColumn("provider", provider(F.col("name"), F.col("owner")))
    return fallback(d, "GPT").select("name", "provider")


_VECTORS = f"""tk AS (SELECT conv_id, turn, unnest({TOKENS}) AS t FROM conversations), sl AS (SELECT conv_id, turn, CAST(('0x' || substring(md5(t), 1, 8))::BIGINT % 64 AS INT) AS slot, sum(CASE WHEN substring(md5(t), 9, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') THEN -1.0 ELSE 1.0 END)::DOUBLE AS value FROM tk GROUP BY ALL),
  em AS (SELECT * FROM sl WHERE value <> 0)"""


def _embedded(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", hashing_embedder(tokens(F.col("text"))).alias("embedding"))


@query("embed_texts", f"WITH {_VECTORS} SELECT conv_id, turn, slot, value FROM em")
def embed_texts(spark, sf):
    """Every turn's vector, by its slots that are not zero."""
    return _embedded(spark, sf).select("conv_id", "turn", F.posexplode("embedding").alias("slot", "value")).where("value <> 0")


@query(
    "semantic_text",
    f"""WITH {_VECTORS}, q AS (SELECT slot, value FROM em WHERE conv_id = 0 AND turn = 0), n AS (SELECT conv_id, turn, sqrt(sum(value * value)) AS n FROM em GROUP BY ALL),
    d AS (SELECT em.conv_id, em.turn, sum(em.value * q.value) AS d FROM em JOIN q USING (slot) GROUP BY ALL)
    SELECT n.conv_id * 1000 + n.turn AS id, round(coalesce(d, 0) / (n * (SELECT sqrt(sum(value * value)) FROM q)), 6) AS score FROM n LEFT JOIN d ON d.conv_id = n.conv_id AND d.turn = n.turn ORDER BY score DESC, id LIMIT 10""",
)
def semantic_text(spark, sf):
    """A text embedded and compared to every turn."""
    e = _embedded(spark, sf).withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    return search.nearest(e, e.where("id = 0").select(F.col("embedding").alias("q")), 10, id_col="id")


# search

@query("vector_documents", f"WITH {NEAREST}, t AS (SELECT * FROM nearest JOIN documents ON doc_id = id ORDER BY score DESC, id LIMIT 10) SELECT id, score, lang, source, n_chars FROM t")
def vector_documents(spark, sf):
    """Vector hits with their documents; vectors without one are no hits."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "n_chars")
    return store.with_documents(_near(spark, sf), d, limit=10)


@query("vector_get", "SELECT vec_id, label, list_extract(embedding, 1)::DOUBLE AS first FROM embeddings WHERE vec_id IN (3, 5, 8, 13, 100000) AND label >= 0 ORDER BY vec_id LIMIT 3")
def vector_get(spark, sf):
    return store.get_vectors(table(spark, sf, "embeddings"), [3, 5, 8, 13, 100000], {"label": {"$gte": 0}}, 3).select("vec_id", "label", F.col("embedding")[0].cast("double").alias("first"))


@query("vector_metrics", "SELECT e.vec_id AS id, round(1 / (1 + list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6) AS l2, round(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS ip FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q")
def vector_metrics(spark, sf):
    """Similarity of every vector to one by distance and by inner product."""
    from brindle.functions.vector import dot, inverse_distance, norm

    e = table(spark, sf, "embeddings")
    d = e.join(F.broadcast(e.where("vec_id = 0").select(F.col("embedding").alias("q"))))
    away = F.zip_with("embedding", "q", lambda x, y: x.cast("double") - y.cast("double"))
    return d.select(F.col("vec_id").alias("id"), F.round(inverse_distance(norm(away)), 6).alias("l2"), F.round(dot(F.col("embedding"), F.col("q")), 6).alias("ip"))


@query("rank_cut", "SELECT lang, doc_id, rank FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 40")
def rank_cut(spark, sf):
    """Ranks within each language, cut at 40."""
    d = table(spark, sf, "documents").select("lang", F.col("doc_id").alias("id"), F.col("n_chars").alias("score"))
    return search.ranked(d, by=("lang",), most=40).select("lang", F.col("id").alias("doc_id"), F.col("rank").cast("bigint").alias("rank"))


_MIN = f"WITH {bm25_sql(ANY, 'or')}, {NEAREST}, h AS (SELECT coalesce(a.id, b.id) AS id, round(coalesce(0.5::DOUBLE / (60 + a.r), 0) + coalesce(0.5::DOUBLE / (60 + b.r), 0), 8) AS score FROM (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM bm25 QUALIFY row_number() OVER (ORDER BY score DESC, id) <= 20) a FULL OUTER JOIN (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM nearest QUALIFY row_number() OVER (ORDER BY score DESC, id) <= 20) b ON a.id = b.id)"


@query("hybrid_min_score", f"{_MIN}, t AS (SELECT * FROM h ORDER BY score DESC, id LIMIT 10) SELECT id, score FROM t WHERE score >= 0.0079")
def hybrid_min_score(spark, sf):
    """The threshold applies after the cut."""
    return search.hybrid(search.bm25(table(spark, sf, "documents"), ANY, "or"), _near(spark, sf), 10, min_score=0.0079).select("id", "score")


def _phrase_sql(source: str, id_: str, tf: str, name: str) -> str:
    return f"""d AS (SELECT {id_} AS id, {TOKENS} AS toks FROM {source}), c AS (SELECT id, len(toks) AS dl, {tf} AS tf FROM d), g AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (WHERE tf > 0) AS df FROM c),
  {name} AS (SELECT id, round((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 0.000001::DOUBLE ELSE ln((n - df + 0.5) / (df + 0.5)) END) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)), 6) AS raw FROM c, g WHERE tf > 0)"""


@query("fts_phrase", f"""WITH {_phrase_sql("documents", "doc_id", "len(list_filter(range(1, len(toks)), lambda i: toks[i] = 'of' AND toks[i + 1] = 'the'))", "r")} SELECT id, raw, round(raw / (raw + 1), 6) AS score FROM r""")
def fts_phrase(spark, sf):
    """Documents with a phrase, through the index."""
    return index.search(index.build(table(spark, sf, "documents"), stemmed=False), '"of the"', limit=None)


@query("fts_prefix", f"""WITH {_phrase_sql("documents", "doc_id", "len(list_filter(toks, lambda t: starts_with(t, 'ach')))", "r")} SELECT id, raw, round(raw / (raw + 1), 6) AS score FROM r""")
def fts_prefix(spark, sf):
    return index.search(index.build(table(spark, sf, "documents"), stemmed=False), "ach*", limit=None)


@query("fts_index", f"WITH t AS (SELECT doc_id AS id, unnest({TOKENS}) AS term FROM documents) SELECT term, id, count(*)::INT AS tf FROM t GROUP BY ALL")
def fts_index(spark, sf):
    """The index's postings."""
    return index.build(table(spark, sf, "documents"), stemmed=False).postings.select("term", "id", "tf")


@query("fts_stemmed")
def fts_stemmed(spark, sf):
    """A stemmed query over the index; tested against another full-text engine."""
    return index.search(index.build(table(spark, sf, "documents")), "ached thinging", "or", None)


_BATCH = f"""d AS (SELECT doc_id AS id, {TOKENS} AS toks FROM documents), l AS (SELECT id, len(toks) AS dl FROM d), g AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l), p AS (SELECT id, unnest(toks) AS t FROM d),
  tf AS (SELECT id, t, count(*) AS tf FROM p GROUP BY ALL), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t), q AS (SELECT DISTINCT conv_id * 1000 + turn AS query_id, t FROM (SELECT conv_id, turn, unnest({TOKENS}) AS t FROM conversations WHERE role = 'user')),
  w AS (SELECT id, t, (CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 0.000001::DOUBLE ELSE ln((n - df + 0.5) / (df + 0.5)) END) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS w FROM tf JOIN df USING (t) JOIN l USING (id), g),
  r AS (SELECT query_id, id, round(sum(w), 6) AS raw FROM q JOIN w USING (t) GROUP BY ALL)"""


@query("batch_search", f"WITH {_BATCH} SELECT query_id, id, raw, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, id) AS rank FROM r) WHERE rank <= 5")
def batch_search(spark, sf):
    """Every user turn as a query, all in one job."""
    q = table(spark, sf, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    return index.search_many(index.build(table(spark, sf, "documents"), stemmed=False), q, 5).withColumn("rank", F.col("rank").cast("bigint"))


@query("rerank_factors", f"WITH {_RERANK}, t AS (SELECT * FROM fin ORDER BY reranked DESC, id LIMIT 10), u AS (SELECT id, unnest([('vector_score', vector_score), ('bm25_score', bm25_score), ('hybrid_fusion', score), ('cross_encoder', ce), ('rerank_weight', 0.7::DOUBLE)]) AS x FROM t) SELECT id, x[1] AS factor, x[2] AS value FROM u")
def rerank_factors(spark, sf):
    """The factors of each rank, one row each."""
    top = search.rerank(_hybrid(spark, sf, ANY, 50), table(spark, sf, "documents"), ANY)
    return top.select("id", F.explode(search.rank_factors()).alias("factor", "value"))


# contexts and answers

@query(
    "context_totals",
    f"""WITH {_HITS}, t AS (SELECT *, length(text) // 4 AS tokens FROM hits WHERE rank <= 20), u AS (SELECT *, sum(tokens) OVER (ORDER BY rank) AS upto FROM t), v AS (SELECT *, min(CASE WHEN upto > 4000 THEN rank END) OVER () AS fo, 4000 - (upto - tokens) AS lft FROM u)
    SELECT CAST(sum(CASE WHEN rank = fo THEN least(lft * 4, length(text)) ELSE length(text) END) AS BIGINT) AS chars, CAST(sum(CASE WHEN rank = fo THEN lft ELSE tokens END) AS BIGINT) AS tokens, count(*) FILTER (WHERE fo IS NULL OR rank < fo) AS sources
    FROM v WHERE fo IS NULL OR rank < fo OR (rank = fo AND lft > 100)""",
)
def context_totals(spark, sf):
    return rag.context_totals(rag.pack_context(_hits(spark, sf))).drop("query_id")


@query("unique_entities", f"WITH {_MENTIONS}, texts AS (SELECT chunk_id AS doc_id, text FROM chunks), {bm25_sql(ANY, 'or', source='texts')}, h AS (SELECT id FROM bm25 ORDER BY raw DESC, id LIMIT 20) SELECT DISTINCT entity_id AS id FROM mentions WHERE chunk_id IN (SELECT id FROM h) ORDER BY 1 LIMIT 5")
def unique_entities(spark, sf):
    """The first entities that the hits mention."""
    hits = search.bm25(chunks(spark, sf), ANY, "or", 20, id_col="chunk_id").select(F.col("id").alias("chunk_id"))
    return rag.unique_entities(hits, _mentions(spark, sf))


@query("context_entities", f"WITH {ENTITIES}, e AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY id) AS i FROM entities WHERE community IS NOT NULL) SELECT community AS query_id, '## Relevant Entities' || chr(10) || chr(10) || string_agg('- **' || name || '** (' || entity_type || ')' || CASE WHEN entity_type = 'supplier' THEN chr(10) || '  ' || id ELSE '' END, chr(10) ORDER BY i) FILTER (WHERE i <= 10) || chr(10) || chr(10) AS text FROM e GROUP BY community")
def context_entities(spark, sf):
    """The preamble of every community's first entities."""
    e = entities(spark, sf).where("community is not null")
    return rag.entity_preamble(e.select(F.col("community").alias("query_id"), F.col("id").alias("position"), "name", "entity_type", F.when(F.col("entity_type") == "supplier", F.col("id")).alias("description")))


@query(
    "context_graph",
    f"""WITH {ENTITIES}, {RELATIONS}, n AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY id) AS i FROM entities WHERE community IS NOT NULL),
    nn AS (SELECT community, string_agg('- ' || name || ' (' || entity_type || ')', chr(10) ORDER BY i) FILTER (WHERE i <= 15) AS t FROM n GROUP BY community), e AS (SELECT community, src, relation_type, dst, row_number() OVER (PARTITION BY community ORDER BY src, dst) AS i FROM relations JOIN entities ON id = src WHERE community IS NOT NULL),
    ee AS (SELECT community, string_agg('- ' || src || ' → ' || relation_type || ' → ' || dst, chr(10) ORDER BY i) FILTER (WHERE i <= 10) AS t FROM e GROUP BY community)
    SELECT nn.community AS query_id, '## Related Knowledge' || chr(10) || chr(10) || '### Entities' || chr(10) || nn.t || CASE WHEN ee.t IS NOT NULL THEN chr(10) || chr(10) || '### Relationships' || chr(10) || ee.t ELSE '' END || chr(10) || chr(10) AS text FROM nn LEFT JOIN ee ON ee.community = nn.community""",
)
def context_graph(spark, sf):
    """The preamble of every community's first entities and their relations."""
    e = entities(spark, sf).where("community is not null")
    nodes = e.select(F.col("community").alias("query_id"), F.col("id").alias("position"), "name", F.col("entity_type").alias("type"))
    edges = relations(spark, sf).join(e.select(F.col("id").alias("src"), "community"), "src").select(F.col("community").alias("query_id"), F.struct("src", "dst").alias("position"), F.col("src").alias("source"), "relation_type", F.col("dst").alias("target"))
    return rag.graph_preamble(nodes, edges)


@query("context_with_preamble", f"WITH {_HITS} SELECT 0 AS rank, 'entities' AS id, 'Entity Context' AS name, '## Relevant Entities' || chr(10) || chr(10) || '- **ach** (word)' || chr(10) || chr(10) AS text UNION ALL SELECT rank, id::VARCHAR, 'doc ' || id, text FROM hits")
def context_with_preamble(spark, sf):
    """A context whose first block tells of an entity."""
    d = _hits(spark, sf).withColumn("name", F.concat(F.lit("doc "), F.col("id").cast("string")))
    first = rag.entity_preamble(spark.createDataFrame([(1, 1, "ach", "word", None)], "query_id int, position int, name string, entity_type string, description string"))
    return rag.with_preamble(d.select("query_id", "rank", "id", "name", "text"), first, "Entity Context", "entities").select(F.col("rank").cast("bigint").alias("rank"), "id", "name", "text")


@query(
    "reasoning_split",
    r"""SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN regexp_replace(text, '^\s+|\s+$', '', 'g') END AS reasoning, CASE WHEN conv_id % 3 = 0 THEN 'turn ' || turn ELSE text END AS answer FROM conversations""",
)
def reasoning_split(spark, sf):
    """Answers in marked parts, and plain ones."""
    said = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("**Reasoning:** "), "text", F.lit("\n**Answer:** turn "), F.col("turn").cast("string"), F.lit("\n**Confidence:** high"))).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", rag.split_reasoning(said).alias("x")).select("conv_id", "turn", "x.reasoning", "x.answer")


@query("follow_ups", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN 'a' || event_id || '|b|c' ELSE event_type END AS questions FROM events")
def follow_ups(spark, sf):
    """Questions out of model answers: a broken list, one that is too long and holds a number, and a short one."""
    k = F.col("event_id") % 3
    said = F.when(k == 0, F.lit("[1, ")).when(k == 1, F.format_string('["a%s", 7, "b", "c", "d"]', F.col("event_id").cast("string"))).otherwise(F.format_string('["%s"]', "event_type"))
    return table(spark, sf, "events").select("event_id", F.array_join(rag.follow_ups(said), "|").alias("questions"))


# extraction

_NOTES = "n AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'BTC target ' || o_custkey || '.5 and buy ETH, strategy: patience' WHEN 1 THEN 'ETH follows BTC; sell SOL' WHEN 2 THEN 'indicator: momentum, pattern: flag' ELSE '' END AS text FROM orders)"


def _notes(spark, sf):
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.format_string("BTC target %s.5 and buy ETH, strategy: patience", F.col("o_custkey").cast("string"))).when(k == 1, "ETH follows BTC; sell SOL").when(k == 2, "indicator: momentum, pattern: flag").otherwise("")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), text.alias("text"))


@query(
    "extract_records",
    f"""WITH {_NOTES}, r AS (SELECT id, 'price_targets' AS kind, regexp_extract(text, '^BTC') || ' ' || CAST(CAST(regexp_extract(text, 'target ([0-9.]+)', 1) AS DOUBLE) AS VARCHAR) AS record FROM n WHERE contains(text, 'target') UNION ALL SELECT id, 'trading_setups', 'ETH buy' FROM n WHERE contains(text, 'buy') UNION ALL SELECT id, 'trading_setups', 'SOL sell' FROM n WHERE contains(text, 'sell')
    UNION ALL SELECT id, 'entities', unnest(regexp_extract_all(text, '\\b[A-Z]{{2,6}}\\b')) FROM n UNION ALL SELECT id, 'concepts', 'patience strategy' FROM n WHERE contains(text, 'patience') UNION ALL SELECT id, 'concepts', 'momentum indicator' FROM n WHERE contains(text, 'momentum') UNION ALL SELECT id, 'concepts', 'flag pattern' FROM n WHERE contains(text, 'flag')
    UNION ALL SELECT id, 'relationships', 'ETH BTC follows' FROM n WHERE contains(text, 'follows')) SELECT * FROM r""",
)
def extract_records(spark, sf):
    """Five kinds of records out of every note, one row each."""
    d = records.extract(_notes(spark, sf))
    said = {"price_targets": ["symbol", "price"], "trading_setups": ["symbol", "setup_type"], "entities": ["name"], "concepts": ["name", "category"], "relationships": ["source", "target", "relation_type"]}
    return d.select("id", F.explode(F.concat(*(_told(kind, names) for kind, names in said.items()))).alias("x")).select("id", "x.kind", "x.record")


def _told(kind: str, names: list[str]):
    return F.transform(kind, lambda x: F.struct(F.lit(kind).alias("kind"), F.concat_ws(" ", *(x[n].cast("string") for n in names)).alias("record")))


@query("concept_names", f"WITH {_NOTES} SELECT id, CASE id % 4 WHEN 0 THEN 'patience' WHEN 2 THEN 'flag,momentum' ELSE '' END AS names FROM n")
def concept_names(spark, sf):
    """The distinct concepts of every note."""
    return records.extract(_notes(spark, sf)).select("id", F.array_join(records.first_names(F.col("concepts")), ",").alias("names"))


# metrics and functions

_RUNS = "runs AS (SELECT event_type AS domain, value >= 10 AS ok, CAST(event_id % 7 AS BIGINT) AS entities, CAST(event_id % 3 AS BIGINT) AS relations, value AS ms FROM events)"
_PROCESSED = f"""{_RUNS}, pr AS (SELECT domain, count(*) FILTER (WHERE ok) AS processed, count(*) FILTER (WHERE NOT ok) AS failed, CAST(coalesce(sum(entities) FILTER (WHERE ok), 0) AS BIGINT) AS entities, CAST(coalesce(sum(relations) FILTER (WHERE ok), 0) AS BIGINT) AS relations, count(*) AS domain_count, round(avg(ms), 4) AS mean_ms FROM runs GROUP BY ROLLUP (domain)),
  pm AS (SELECT *, round(1 - failed / greatest(processed, 1), 6) AS success_rate FROM pr)"""


def _processed(spark, sf):
    e = table(spark, sf, "events")
    return metrics.processing(e.select(F.col("event_type").alias("domain"), (F.col("value") >= 10).alias("ok"), (F.col("event_id") % 7).alias("entities"), (F.col("event_id") % 3).alias("relations"), F.col("value").alias("ms")))


@query("processing_metrics", f"WITH {_PROCESSED} SELECT domain, processed, failed, success_rate, entities, relations, domain_count, mean_ms FROM pm")
def processing_metrics(spark, sf):
    """Counts, rates and means of every domain and of all."""
    return _processed(spark, sf)


@query(
    "prometheus_text",
    f"""WITH {_PROCESSED}, t AS (SELECT * FROM pm WHERE domain IS NULL), v AS (SELECT unnest([('documents_processed_total', 'counter', 'Total documents processed', processed::VARCHAR), ('documents_failed_total', 'counter', 'Total documents failed', failed::VARCHAR), ('entities_extracted_total', 'counter', 'Total entities extracted', entities::VARCHAR),
    ('relationships_extracted_total', 'counter', 'Total relationships extracted', relations::VARCHAR), ('success_rate', 'gauge', 'Share of documents that succeeded', printf('%.4f', success_rate)), ('processing_ms_avg', 'gauge', 'Average processing time', printf('%.4f', mean_ms))]) AS x FROM t)
    SELECT '# HELP brindle_' || x[1] || ' ' || x[3] AS line FROM v UNION ALL SELECT '# TYPE brindle_' || x[1] || ' ' || x[2] FROM v UNION ALL SELECT 'brindle_' || x[1] || ' ' || x[4] FROM v UNION ALL SELECT 'brindle_documents_by_domain{{domain="' || domain || '"}} ' || domain_count FROM pm WHERE domain IS NOT NULL""",
)
def prometheus_text(spark, sf):
    return metrics.exposition(_processed(spark, sf))


@query("sql_functions", f"SELECT doc_id, len({TOKENS}) AS n_tokens, CAST(length(text) // 4 AS BIGINT) AS estimate, CASE WHEN length(text) > 50 THEN substring(text, 1, 50) || '...' ELSE text END AS preview, 'doc_' || substring(sha256(text), 1, 16) AS document_id, n_chars / (n_chars + 1.0::DOUBLE) AS squashed FROM documents")
def sql_functions(spark, sf):
    """The engine's functions called from SQL."""
    from brindle.functions.sql import register

    register(spark)
    d = table(spark, sf, "documents")
    return spark.sql("SELECT doc_id, CAST(size(br_tokens(text)) AS BIGINT) AS n_tokens, br_token_estimate(text) AS estimate, br_preview(text, 50) AS preview, br_document_id(text) AS document_id, br_squash(CAST(n_chars AS DOUBLE)) AS squashed FROM {d}", d=d)


# the engine object over the conversations, each turn a chunk

_TURNS = f"""turns AS (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations), {bm25_sql(["ach", "ou"], "or", "kw", "turns")}, {_VECTORS}, qt AS (SELECT unnest(['ach', 'ou']) AS t), qv AS (SELECT CAST(('0x' || substring(md5(t), 1, 8))::BIGINT % 64 AS INT) AS slot, sum(CASE WHEN substring(md5(t), 9, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') THEN -1.0 ELSE 1.0 END)::DOUBLE AS value FROM qt GROUP BY ALL),
  nv AS (SELECT conv_id * 1000 + turn AS id, sqrt(sum(value * value)) AS n FROM em GROUP BY ALL), dv AS (SELECT conv_id * 1000 + turn AS id, sum(em.value * qv.value) AS d FROM em JOIN qv USING (slot) GROUP BY ALL),
  sem AS (SELECT nv.id, round(coalesce(d, 0) / (n * (SELECT sqrt(sum(value * value)) FROM qv)), 6) AS score FROM nv LEFT JOIN dv ON dv.id = nv.id),
  ka AS (SELECT id::VARCHAR AS id, score, row_number() OVER (ORDER BY raw DESC, id::VARCHAR) AS r FROM kw), sa AS (SELECT id::VARCHAR AS id, score, row_number() OVER (ORDER BY score DESC, id::VARCHAR) AS r FROM sem)"""


def _fused(limit: int) -> str:
    top = lambda t: f"(SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS r FROM {t} WHERE r <= {2 * limit})"
    return f"(SELECT coalesce(a.id, b.id) AS id, round(coalesce(0.5::DOUBLE / (60 + a.r), 0) + coalesce(0.5::DOUBLE / (60 + b.r), 0), 8) AS score FROM {top('ka')} a FULL OUTER JOIN {top('sa')} b ON a.id = b.id ORDER BY score DESC, id LIMIT {limit})"


def _engine(spark, sf):
    from brindle.engine import Engine

    small_batches(spark)  # whole texts go to the embedder
    c = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("chunk_id"), F.col("role").alias("document_id"), "text")
    return Engine(spark, {"chunks": c.withColumn("embedding", hashing_embedder(tokens(F.col("text"))))})


@query("engine_modes", f"WITH {_TURNS} SELECT 'keyword' AS mode, id, score FROM ka WHERE r <= 10 UNION ALL SELECT 'semantic', id, score FROM sa WHERE r <= 10 UNION ALL SELECT 'hybrid', id, score FROM {_fused(10)}")
def engine_modes(spark, sf):
    """One question in three modes of the engine."""
    e = _engine(spark, sf)
    parts = [e.search("Ach, ou?", mode).select(F.lit(mode).alias("mode"), "id", "score") for mode in ("keyword", "semantic", "hybrid")]
    return parts[0].union(parts[1]).union(parts[2])


@query("engine_reranked", f"WITH {_TURNS}, h AS (SELECT * FROM {_fused(50)}), r AS (SELECT h.id, round(len(list_intersect(list_distinct({TOKENS}), ['ach', 'ou'])) / 2::DOUBLE, 6) AS ce, score FROM h JOIN turns ON doc_id::VARCHAR = h.id) SELECT id, ce, round(0.7::DOUBLE * ce + 0.3::DOUBLE * least(1.0, score), 6) AS reranked FROM r ORDER BY reranked DESC, id LIMIT 10")
def engine_reranked(spark, sf):
    """The engine's candidates in the scorer's order."""
    return _engine(spark, sf).reranked("Ach, ou?").select("id", "ce", "reranked")


@query("raw_sql", "SELECT role AS document_id, count(*) AS n FROM conversations WHERE length(text) > 100 GROUP BY role")
def raw_sql(spark, sf):
    """Any SQL over the engine's tables, with parameters."""
    return _engine(spark, sf).query("SELECT document_id, count(*) AS n FROM chunks WHERE length(text) > :least GROUP BY document_id", least=100)


@query("entity_detail", f"WITH {ENTITIES}, {RELATIONS}, r AS (SELECT 'out' AS direction, dst AS other, relation_type FROM relations WHERE src = 'c:1' UNION ALL SELECT 'in', src, relation_type FROM relations WHERE dst = 'c:1') SELECT e.id, e.name, e.entity_type, direction, other, relation_type FROM entities e LEFT JOIN r ON true WHERE e.id = 'c:1'")
def entity_detail(spark, sf):
    """An entity with its relations."""
    from brindle.engine import Engine

    found, near = Engine(spark, {"entities": entities(spark, sf), "relations": relations(spark, sf)}).entity("c:1", 1000)
    return found.select("id", "name", "entity_type").join(F.broadcast(near.select(F.lit("c:1").alias("id"), "direction", "other", "relation_type")), "id", "left")


@query("domain_blend", f"WITH h AS (SELECT doc_id AS id, least(0.1::DOUBLE * len(list_filter({TOKENS}, lambda t: t = 'ach')), 0.5::DOUBLE) AS k FROM documents) SELECT id, round(0.4::DOUBLE * k + 0.6::DOUBLE * (id % 10) / 10, 6) AS score FROM h")
def domain_blend(spark, sf):
    """Keyword scores blended with a model's."""
    from brindle.operators.knowledge import blend

    t = tokens(F.col("text"))
    n = F.size(t) - F.size(F.array_remove(t, "ach"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.round(blend(F.least(0.1 * n, F.lit(0.5)), (F.col("doc_id") % 10) / 10), 6).alias("score"))


_STORED = ["region", "nation", "supplier", "customer"]


@query("collections", " UNION ALL ".join(f"SELECT '{t}' AS collection, count(*) AS n, true AS listed, true AS dropped FROM {t}" for t in _STORED))
def collections(spark, sf):
    """Tables made collections, listed, counted as they are stored, and dropped."""
    import uuid

    from brindle.engine import Engine

    e, names = Engine(spark), {t: f"c{uuid.uuid4().hex}" for t in _STORED}
    for t, name in names.items():
        e.create(name, table(spark, sf, t))
    listed = set(e.collections())
    counts = [spark.table(name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("collection"), "n", F.lit(name in listed).alias("listed")) for t, name in names.items()]
    out = Written(spark, "collections").table(reduce(lambda a, b: a.union(b), counts), "counts")
    for name in names.values():
        e.drop(name)
    left = set(e.collections())
    return out.withColumn("dropped", F.lit(left.isdisjoint(names.values())))


@query(
    "store_snapshots",
    """WITH v0 AS (SELECT c_custkey, c_mktsegment FROM customer), v1 AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'REVIEW' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT -1 - s_suppkey, 'SUPPLIER' FROM supplier),
    v2 AS (SELECT * FROM v1 WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3))
    SELECT 0 AS version, * FROM v0 UNION ALL SELECT 1, * FROM v1 UNION ALL SELECT 2, * FROM v2""",
)
def store_snapshots(spark, sf):
    """A stored table of customers: changed and added to, then deleted from; all three versions as they are read."""
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    kept = c.select("c_custkey", "c_mktsegment")
    t = Snapshots.create(kept, Written(spark, "snapshots").path("customer"), "c_custkey", buckets=8)
    changed = c.where("c_acctbal < 0").select("c_custkey", F.lit("REVIEW").alias("c_mktsegment"))
    t.upsert(changed.union(s.select(-1 - F.col("s_suppkey"), F.lit("SUPPLIER"))))
    t.delete(c.where("c_nationkey = 3").select("c_custkey"))
    return reduce(lambda a, b: a.union(b), (t.read(v).select(F.lit(v).alias("version"), "c_custkey", "c_mktsegment") for v in t.versions()))


@query("index_follows", f"WITH live AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN text || ' ach ado' ELSE text END AS text FROM documents WHERE n_chars >= 100), {bm25_sql(ANY, 'or', source='live')} SELECT id, raw, score FROM bm25")
def index_follows(spark, sf):
    """A stored index of all documents, made in two parts, with short documents deleted and French ones changed, searched as it is then."""
    d = table(spark, sf, "documents")
    store_ = IndexStore(spark, Written(spark, "segments").path("index"), stemmed=False)
    store_.append(d.where("lang = 'en'"))
    store_.append(d.where("lang is null or lang != 'en'"))
    store_.update(d.where("lang = 'fr'").withColumn("text", F.concat("text", F.lit(" ach ado"))))
    store_.delete(d.where("n_chars < 100").select(F.col("doc_id").alias("id")))
    return index.search(store_.index(), " ".join(ANY), "or", None)
