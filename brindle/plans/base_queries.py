"""Sources, stores and plain text operators over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import text as tx
from brindle.operators import chunking, graph, store
from brindle.plans.catalog import query
from brindle.plans.fixtures import CHUNKS, TOKENS, bm25_sql, chunks, entities, ENTITIES, table
from brindle.sources import files

_MIME = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in files.MIME.items())


@query("mime_detect", rf"SELECT page_id, CASE regexp_extract(lower(url), '(\.[a-z0-9]+)$', 1) {_MIME} ELSE '{files.OTHER}' END AS mime FROM pages UNION ALL SELECT -1 - rowid, CASE regexp_extract(lower(x), '(\.[a-z0-9]+)$', 1) {_MIME} ELSE '{files.OTHER}' END FROM (SELECT row_number() OVER () - 1 AS rowid, x FROM (SELECT unnest(['a.PDF', 'b.md', 'c.tar.gz', 'd.json']) AS x))")
def mime_detect(spark, sf):
    own = spark.createDataFrame([(-1, "a.PDF"), (-2, "b.md"), (-3, "c.tar.gz"), (-4, "d.json")], "page_id bigint, url string")
    d = table(spark, sf, "pages").select("page_id", "url").union(own)
    return d.select("page_id", files.mime_type(F.col("url")).alias("mime"))


@query("frontmatter", "SELECT doc_id, CASE WHEN starts_with(text, '---') THEN text ELSE '---' || chr(10) || 'source: ' || doc_id || '.md' || chr(10) || 'processed: 2024-01-01T00:00:00' || chr(10) || '---' || chr(10) || chr(10) || text END AS content FROM documents")
def frontmatter(spark, sf):
    return table(spark, sf, "documents").select("doc_id", files.frontmatter(F.col("text"), F.concat(F.col("doc_id").cast("string"), F.lit(".md")), "2024-01-01T00:00:00").alias("content"))


def _html_sql() -> str:
    out = "html"
    for tag in ("script", "style", "nav", "footer"):
        out = f"regexp_replace({out}, '(?is)<{tag}[^>]*>.*?</{tag}>', chr(10), 'g')"
    out = f"regexp_replace(regexp_replace({out}, '(?s)<!--.*?-->', chr(10), 'g'), '(?s)<[^>]*>', chr(10), 'g')"
    for k, v in files.ENTITIES.items():
        v = v.replace("'", "''")
        out = f"replace({out}, '{k}', '{v}')"
    return rf"regexp_replace(regexp_replace({out}, '[ \t\r\n]*\n[ \t\r\n]*', chr(10), 'g'), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')"


@query("html_to_text", f"SELECT page_id, {_html_sql()} AS content FROM pages")
def html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", files.html_text(F.col("html")).alias("content"))


@query("json_to_markdown", """SELECT event_id, '# Data' || chr(10) || chr(10) || '```json' || chr(10) || '{' || chr(10) || '  "k": ' || json_extract_string(props, '$.k') || chr(10) || '}' || chr(10) || '```' || chr(10) AS content FROM events""")
def json_to_markdown(spark, sf):
    return table(spark, sf, "events").select("event_id", files.json_markdown(F.col("props")).alias("content"))


@query(
    "csv_to_markdown",
    """WITH r AS (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS i, count(*) OVER () AS n FROM supplier)
    SELECT '# supplier' || chr(10) || chr(10) || '| s_suppkey | s_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || s_suppkey || ' | ' || s_name || ' |' || chr(10), '' ORDER BY i) FILTER (WHERE i <= 99)
      || CASE WHEN max(n) > 99 THEN chr(10) || '*...and ' || (max(n) - 99) || ' more rows*' || chr(10) ELSE '' END AS content FROM r""",
)
def csv_to_markdown(spark, sf):
    """The footer counts the data rows that are not shown."""
    return files.table_markdown(table(spark, sf, "supplier"), "supplier", ["s_suppkey", "s_name"], ["s_suppkey"])


@query("vector_upsert", "SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN -1 ELSE label END AS label FROM embeddings UNION ALL SELECT 1000000, 7")
def vector_upsert(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    new = spark.createDataFrame([(1000000, 7)], "vec_id bigint, label int")
    return store.upsert(e, e.where("vec_id % 10 = 0").withColumn("label", F.lit(-1)).union(new), "vec_id")


@query("edge_insert_resolve", "SELECT 's:' || s_suppkey AS src, 'n:' || n_nationkey AS dst, 'BASED_IN' AS relation_type FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 7 <> 0")
def edge_insert_resolve(spark, sf):
    """Edges come with names; those with an unknown end vanish."""
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    wrong = F.when(F.col("s_suppkey") % 7 == 0, F.concat(F.lit("?"), "s_name")).otherwise(F.col("s_name"))
    edges = s.join(n, s.s_nationkey == n.n_nationkey).select(wrong.alias("src_name"), F.col("n_name").alias("dst_name"), F.lit("BASED_IN").alias("relation_type"))
    nodes = s.select(F.col("s_name").alias("name"), F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("id")).union(n.select("n_name", F.concat(F.lit("n:"), F.col("n_nationkey").cast("string"))))
    return store.resolve_edges(edges, nodes).select("src", "dst", "relation_type")


@query("doc_lookup", "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 42")
def doc_lookup(spark, sf):
    return table(spark, sf, "documents").where("doc_id = 42").select("doc_id", "lang", "source", "n_chars")


@query("list_documents", "SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en' AND n_chars > 200 ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 10")
def list_documents(spark, sf):
    d = table(spark, sf, "documents").where("lang = 'en' and n_chars > 200").select("doc_id", "lang", "source", "n_chars")
    return store.page(d, [F.desc("n_chars"), "doc_id"], 10, 20)


@query("search_entities", f"WITH {ENTITIES} SELECT id, name FROM entities WHERE name LIKE '%00%' AND entity_type = 'customer' ORDER BY id LIMIT 50")
def search_entities(spark, sf):
    return graph.search_entities(entities(spark, sf), "00", "customer", limit=50).select("id", "name")


@query("entity_project", f"WITH {ENTITIES} SELECT id, name, entity_type AS type FROM entities WHERE community = '3'")
def entity_project(spark, sf):
    return entities(spark, sf).where("community = '3'").select("id", "name", F.col("entity_type").alias("type"))


@query("json_path_filter", "SELECT event_id, event_type FROM events WHERE json_extract_string(props, '$.k') = '7'")
def json_path_filter(spark, sf):
    return table(spark, sf, "events").where(F.get_json_object("props", "$.k") == "7").select("event_id", "event_type")


@query("status_update", "SELECT doc_id, CASE WHEN n_chars > 1000 THEN 'completed' ELSE 'pending' END AS status FROM documents")
def status_update(spark, sf):
    return table(spark, sf, "documents").withColumn("status", F.lit("pending")).withColumn("status", F.when(F.col("n_chars") > 1000, "completed").otherwise(F.col("status"))).select("doc_id", "status")


@query(
    "delete_cascade",
    f"""WITH {CHUNKS}, gone AS (SELECT doc_id FROM documents WHERE lang = 'fr')
    SELECT 'documents' AS name, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM gone) UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM gone)
    UNION ALL SELECT 'vectors', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM gone)""",
)
def delete_cascade(spark, sf):
    """A deleted document takes its chunks and vectors along."""
    d = table(spark, sf, "documents")
    left = store.delete_cascade(d, d.where("lang = 'fr'"), "doc_id", chunks(spark, sf), table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id"))
    counts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, t in zip(("documents", "chunks", "vectors"), left, strict=True)]
    return counts[0].union(counts[1]).union(counts[2])


@query("text_preview", "SELECT doc_id, CASE WHEN length(text) > 500 THEN substring(text, 1, 500) || '...' ELSE text END AS preview FROM documents")
def text_preview(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.preview(F.col("text")).alias("preview"))


@query("store_stats", f"WITH {CHUNKS} SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'chunks', count(*) FROM chunks UNION ALL SELECT 'vectors', count(*) FROM embeddings UNION ALL SELECT 'tokens', CAST(sum(len({TOKENS})) AS BIGINT) FROM documents")
def store_stats(spark, sf):
    d = table(spark, sf, "documents")
    one = lambda name, t, c=F.count(F.lit(1)): t.agg(c.cast("bigint").alias("n")).select(F.lit(name).alias("name"), "n")  # noqa: E731, B008
    return one("documents", d).union(one("chunks", chunks(spark, sf))).union(one("vectors", table(spark, sf, "embeddings"))).union(one("tokens", d, F.sum(F.size(tx.tokens(F.col("text"))))))


@query("pagination", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 200")
def pagination(spark, sf):
    return store.page(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 200, 50)


@query("page_count", "SELECT count(*) AS total, CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages, count(*) > 50 AS has_more FROM orders")
def page_count(spark, sf):
    return store.page_numbers(table(spark, sf, "orders"), 50)


@query("union_dedup", f"WITH {bm25_sql(['ach', 'ado'], 'or')}, l AS (SELECT * FROM documents ORDER BY n_chars DESC, doc_id LIMIT 40) SELECT id, origin FROM (SELECT id, 'text' AS origin FROM bm25 UNION ALL SELECT doc_id, 'length' FROM l WHERE doc_id NOT IN (SELECT id FROM bm25))")
def union_dedup(spark, sf):
    from brindle.operators.search import bm25

    d = table(spark, sf, "documents")
    return store.union_first([bm25(d, ["ach", "ado"], "or").select("id", F.lit("text").alias("origin")), d.orderBy(F.desc("n_chars"), "doc_id").limit(40).select(F.col("doc_id").alias("id"), F.lit("length").alias("origin"))], "id")


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash, 'doc_' || substring(sha256(text), 1, 16) AS document_id FROM documents")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("content_hash"), tx.document_id(F.col("text")).alias("document_id"))


@query("exact_dedup", "SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def exact_dedup(spark, sf):
    return table(spark, sf, "documents").groupBy(tx.content_hash(F.col("text")).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("token_estimate", "SELECT doc_id, CAST(length(text) // 4 AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


_BLANK = "replace(text, chr(10), chr(10) || chr(10))"
_PARTS = rf"list_filter(list_transform(regexp_split_to_array({_BLANK}, '\n\s*\n'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '')"


def _blank(spark, sf):
    """No document has a blank line, so each line break is doubled."""
    return table(spark, sf, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))


@query("split_paragraphs", f"SELECT doc_id, CAST(i - 1 AS BIGINT) AS position, a[i] AS content FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT doc_id, {_PARTS} AS a FROM documents))")
def split_paragraphs(spark, sf):
    return _blank(spark, sf).select("doc_id", F.posexplode(chunking.paragraphs(F.col("text"))).alias("position", "content")).withColumn("position", F.col("position").cast("bigint"))


@query(
    "split_elements",
    r"""WITH a AS (SELECT doc_id, list_filter([('header', '# Title ' || doc_id), ('paragraph', regexp_replace(text, '^\s+|\s+$', '', 'g')), ('code_block', '```' || chr(10) || '# no header' || chr(10) || '```'), ('table', '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 | 2 |'), ('paragraph', 'end')], lambda x: x[2] <> '') AS a FROM documents),
    u AS (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM a) SELECT doc_id, CAST(i - 1 AS BIGINT) AS position, a[i][1] AS type, a[i][2] AS content, 'Title ' || doc_id AS section FROM u""",
)
def split_elements(spark, sf):
    """Every document with a header, a fence and a table around its lines, none of which has marks of its own."""
    text = F.concat(F.lit("# Title "), F.col("doc_id").cast("string"), F.lit("\n\n"), F.col("text"), F.lit("\n\n```\n# no header\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\nend"))
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(chunking.elements(text)).alias("position", "x"))
    return d.select("doc_id", F.col("position").cast("bigint").alias("position"), "x.type", "x.content", "x.section")


@query(
    "chunk_documents",
    f"""WITH RECURSIVE p AS (SELECT doc_id, {_PARTS} AS a FROM documents),
    f AS (
      SELECT doc_id, a, 0::BIGINT AS i, CAST([] AS VARCHAR[]) AS cur, CAST(NULL AS VARCHAR[]) AS done, 0::BIGINT AS k FROM p
      UNION ALL
      SELECT doc_id, a, i + 1,
        CASE WHEN fl THEN list_append(cur[len(cur) - t + 1:len(cur)], a[i + 1]) ELSE list_append(cur, a[i + 1]) END,
        CASE WHEN fl THEN cur END, CASE WHEN fl THEN k + 1 ELSE k END
      FROM (SELECT *, (n >= 1000 AND (n >= 2000 OR n + length(a[i + 1]) > 2000)) AS fl,
              list_max(list_filter(range(0, len(cur) + 1), lambda q: coalesce(list_sum(list_transform(cur[len(cur) - q + 1:len(cur)], lambda z: length(z))), 0) <= 150)) AS t
            FROM (SELECT *, coalesce(list_sum(list_transform(cur, lambda z: length(z))), 0) AS n FROM f WHERE i < len(a)))),
    o AS (SELECT doc_id, k - 1 AS chunk_index, done AS parts FROM f WHERE done IS NOT NULL UNION ALL SELECT doc_id, k, cur FROM f WHERE i = len(a) AND len(cur) > 0)
    SELECT doc_id, chunk_index, array_to_string(parts, chr(10) || chr(10)) AS text, length(array_to_string(parts, chr(10) || chr(10))) AS char_count, length(array_to_string(parts, chr(10) || chr(10))) // 4 AS token_count FROM o""",
)
def chunk_documents(spark, sf):
    return chunking.chunk_documents(_blank(spark, sf))


@query("chunk_stats", f"WITH {CHUNKS} SELECT count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(floor(avg(length(text))) AS BIGINT) AS mean, min(length(text)) AS low, max(length(text)) AS high FROM chunks")
def chunk_stats(spark, sf):
    n = F.length("text").cast("bigint")
    return chunks(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.sum(n).alias("chars"), F.floor(F.avg(n)).cast("bigint").alias("mean"), F.min(n).alias("low"), F.max(n).alias("high"))


@query("chunk_links", f"WITH {CHUNKS} SELECT chunk_id, lag(chunk_id) OVER w AS previous_chunk_id, lead(chunk_id) OVER w AS next_chunk_id FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)")
def chunk_links(spark, sf):
    return chunking.link(chunks(spark, sf)).select("chunk_id", "previous_chunk_id", "next_chunk_id")


_OFFSETS = f"{CHUNKS}, placed AS (SELECT *, CAST(coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM chunks)"


@query("chunk_offsets", f"WITH {_OFFSETS} SELECT chunk_id, start FROM placed")
def chunk_offsets(spark, sf):
    return chunking.offsets(chunks(spark, sf)).select("chunk_id", "start")


@query(
    "json_salvage",
    """SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN props END AS salvaged FROM events""",
)
def json_salvage(spark, sf):
    """An object inside other text; a broken one gives null."""
    broken = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("see {"), "props")).otherwise(F.concat(F.lit("Here:\n"), "props", F.lit("\nDone.")))
    return table(spark, sf, "events").select("event_id", tx.json_salvage(broken).alias("salvaged"))
