"""Context, answers, spans, quotes and time over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions.text import tokens
from brindle.operators import annotate, chunking, metrics, rag, search, temporal
from brindle.plans.base_queries import _OFFSETS
from brindle.plans.catalog import query
from brindle.plans.fixtures import TOKENS, bm25_sql, chunks, table


def _hits(spark, sf, k=25):
    """The best documents for a few words, as ranked texts of one query."""
    d = table(spark, sf, "documents")
    top = search.ranked(search.bm25(d, ["ach", "ado", "aiai"], "or", k))
    return d.join(F.broadcast(top.select(F.col("id").alias("doc_id"), "rank")), "doc_id").select(F.lit(1).alias("query_id"), "rank", F.col("doc_id").alias("id"), "text")


_HITS = f"{bm25_sql(['ach', 'ado', 'aiai'], 'or')}, hits AS (SELECT id, text, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT * FROM bm25 ORDER BY raw DESC, id LIMIT 25) JOIN documents ON doc_id = id)"


@query(
    "context_pack",
    f"""WITH {_HITS}, t AS (SELECT *, length(text) // 4 AS tokens FROM hits WHERE rank <= 20), u AS (SELECT *, sum(tokens) OVER (ORDER BY rank) AS upto FROM t),
    v AS (SELECT *, min(CASE WHEN upto > 4000 THEN rank END) OVER () AS fo, 4000 - (upto - tokens) AS lft FROM u)
    SELECT rank, id, CASE WHEN rank = fo THEN substring(text, 1, CAST(lft * 4 AS BIGINT)) || '...' ELSE text END AS text, CAST(CASE WHEN rank = fo THEN lft ELSE tokens END AS BIGINT) AS tokens, fo IS NULL OR rank < fo AS is_source
    FROM v WHERE fo IS NULL OR rank < fo OR (rank = fo AND lft > 100)""",
)
def context_pack(spark, sf):
    return rag.pack_context(_hits(spark, sf)).select(F.col("rank").cast("bigint").alias("rank"), "id", "text", "tokens", "is_source")


@query("context_render", f"WITH {_HITS} SELECT string_agg('[Source ' || rank || ' - doc ' || id || ']' || chr(10) || text, chr(10) || '---' || chr(10) ORDER BY rank) AS prompt FROM hits")
def context_render(spark, sf):
    return rag.render_context(_hits(spark, sf).withColumn("name", F.concat(F.lit("doc "), F.col("id").cast("string")))).select("prompt")


@query("jaccard_dedup")
def jaccard_dedup(spark, sf):
    """The greedy fold over the twenty hits of every user turn, each turn a query; tested against a plain Python fold."""
    from brindle.operators import index

    d = table(spark, sf, "documents")
    q = table(spark, sf, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    hits = index.search_many(index.build(d, stemmed=False), q, 20)
    texts = d.select(F.col("doc_id").alias("id"), F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")).alias("w"))
    return rag.dedup_hits(hits, texts)


_ANSWERS = """a AS (SELECT conv_id, turn, text || CASE conv_id % 5 WHEN 0 THEN ' Confidence: high' WHEN 1 THEN ' **Confidence:** medium' WHEN 2 THEN ' low confidence' WHEN 3 THEN ' It is not specified in the context.' ELSE '' END AS t FROM conversations)"""


@query(
    "answer_confidence",
    f"""WITH {_ANSWERS}, b AS (SELECT *, replace(lower(t), '**', '') AS l FROM a)
    SELECT conv_id, turn, CAST(CASE WHEN contains(l, 'high confidence') OR contains(l, 'confidence: high') THEN 0.9 WHEN contains(l, 'medium confidence') OR contains(l, 'confidence: medium') THEN 0.6
      WHEN contains(l, 'low confidence') OR contains(l, 'confidence: low') THEN 0.3 WHEN contains(l, 'not specified in the context') OR contains(l, 'unclear from the provided') THEN 0.4 ELSE 0.7 END AS DOUBLE) AS confidence FROM b""",
)
def answer_confidence(spark, sf):
    end = F.expr("case conv_id % 5 when 0 then ' Confidence: high' when 1 then ' **Confidence:** medium' when 2 then ' low confidence' when 3 then ' It is not specified in the context.' else '' end")
    return table(spark, sf, "conversations").select("conv_id", "turn", rag.answer_confidence(F.concat("text", end)).cast("double").alias("confidence"))


_SPANS = f"{_OFFSETS}, spans AS (SELECT doc_id, start AS s, start + length(text) + CASE WHEN chunk_index % 2 = 0 THEN 5 ELSE -3 END AS e FROM placed WHERE length(text) > 4)"
_MERGED = f"""{_SPANS}, r AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
  i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM r),
  m AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM i GROUP BY doc_id, k)"""


def _spans(spark, sf):
    d = chunking.offsets(chunks(spark, sf)).where(F.length("text") > 4)
    return d.select("doc_id", "start", (F.col("start") + F.length("text") + F.when(F.col("chunk_index") % 2 == 0, 5).otherwise(-3)).alias("end"))


@query("span_merge", f'WITH {_MERGED} SELECT doc_id, s AS start, e AS "end" FROM m')
def span_merge(spark, sf):
    return annotate.merge_spans(_spans(spark, sf))


@query(
    "highlight_regions",
    """WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents),
    s AS (SELECT doc_id, text, n, k, 12 * k + 2 AS a, 12 * k + 6 + doc_id % 5 AS b FROM d, (SELECT unnest(range(0, 5)) AS k) WHERE 12 * k + 6 + doc_id % 5 <= n),
    p AS (SELECT doc_id, text, a AS f, b AS t, true AS highlighted FROM s UNION ALL SELECT doc_id, text, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY k), a, false FROM s
      UNION ALL SELECT d.doc_id, any_value(d.text), coalesce(max(b), 0), any_value(d.n), false FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id)
    SELECT doc_id, CAST(f AS BIGINT) AS start, substring(text, CAST(f AS BIGINT) + 1, CAST(t - f AS BIGINT)) AS part, highlighted FROM p WHERE f < t""",
)
def highlight_regions(spark, sf):
    """Every document cut at up to five spans; one without spans is one plain part."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    end = 12 * F.col("k") + 6 + F.col("doc_id") % 5
    spans = d.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")).where(end <= F.length("text"))
    return annotate.highlight(d, spans.select("doc_id", (12 * F.col("k") + 2).cast("int").alias("start"), end.cast("int").alias("end")))


@query(
    "grounding_offsets",
    f"""WITH {_OFFSETS}, q AS (SELECT *, substring(text, 5, 12) AS quote FROM placed WHERE length(text) > 20), l AS (SELECT *, instr(text, quote) - 1 AS p FROM q)
    SELECT chunk_id, doc_id, quote, CAST(start + p AS BIGINT) AS start, CAST(start + p + length(quote) AS BIGINT) AS "end", substring(text, greatest(p - 50, 0) + 1, p - greatest(p - 50, 0)) AS prefix, substring(text, p + length(quote) + 1, 50) AS suffix FROM l""",
)
def grounding_offsets(spark, sf):
    """A quote in every chunk that is long enough to hold one."""
    c = chunking.offsets(chunks(spark, sf))
    return annotate.ground(c, c.where(F.length("text") > 20).select("chunk_id", F.substring("text", 5, 12).alias("quote")))


@query(
    "fuzzy_locate",
    """WITH q AS (SELECT conv_id * 1000 + turn AS id, text, substring(text, 11, 25) AS q FROM conversations)
    SELECT id, CAST(CASE WHEN contains(text, q || '#') THEN instr(text, q || '#') - 1 WHEN length(q) > 0.8 * (length(q) + 1) THEN instr(text, q) - 1 ELSE -1 END AS BIGINT) AS "at" FROM q""",
)
def fuzzy_locate(spark, sf):
    """A slightly wrong quote in every conversation turn."""
    d = table(spark, sf, "conversations")
    return annotate.fuzzy_locate(d.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", F.concat(F.substring("text", 11, 25), F.lit("#")).alias("quote")))


_CLAIMS = """claims AS (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'As of ' || strftime(o_orderdate, '%Y-%m-%d') || ' customer ' || o_custkey || ' ordered' WHEN 1 THEN 'Founded in ' || strftime(o_orderdate, '%m/%d/%Y') WHEN 2 THEN 'Customer ' || (o_custkey % 900) || ' is a buyer'
  WHEN 3 THEN 'It will rise' WHEN 4 THEN 'He was born there' ELSE (o_orderkey % 50) || ' days ago' END AS text FROM orders)"""


def _claims(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = (
        F.when(F.col("o_orderkey") % 6 == 0, F.concat(F.lit("As of "), day, F.lit(" customer "), F.col("o_custkey").cast("string"), F.lit(" ordered"))).when(F.col("o_orderkey") % 6 == 1, F.concat(F.lit("Founded in "), F.date_format("o_orderdate", "MM/dd/yyyy")))
        .when(F.col("o_orderkey") % 6 == 2, F.concat(F.lit("Customer "), (F.col("o_custkey") % 900).cast("string"), F.lit(" is a buyer"))).when(F.col("o_orderkey") % 6 == 3, "It will rise").when(F.col("o_orderkey") % 6 == 4, "He was born there")
        .otherwise(F.concat((F.col("o_orderkey") % 50).cast("string"), F.lit(" days ago")))
    )
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), text.alias("text"))


def _any(phrases):
    return "(" + " OR ".join(f"contains(lower(text), '{p}')" for p in phrases) + ")"


_DATED = "(" + " OR ".join(f"regexp_matches(lower(text), '{p}')" for p in temporal.DATES) + ")"


@query(
    "temporal_classify",
    f"""WITH {_CLAIMS} SELECT id, CASE WHEN {_DATED} AND {_any(temporal.DYNAMIC)} THEN 'DYNAMIC' WHEN {_DATED} THEN 'STATIC' WHEN {_any(temporal.ATEMPORAL)} THEN 'ATEMPORAL' WHEN {_any(temporal.DYNAMIC)} THEN 'DYNAMIC'
    WHEN {_any(temporal.STATIC)} THEN 'STATIC' WHEN {_any(temporal.RELATIVE)} THEN 'DYNAMIC' ELSE 'ATEMPORAL' END AS temporal_type FROM claims""",
)
def temporal_classify(spark, sf):
    return _claims(spark, sf).select("id", temporal.temporal_class(F.col("text")).alias("temporal_type"))


@query(
    "temporal_extract",
    f"""WITH {_CLAIMS} SELECT id, CASE WHEN id % 6 = 0 THEN regexp_extract(text, '\\d{{4}}-\\d\\d-\\d\\d') WHEN id % 6 = 1 THEN strftime(strptime(regexp_extract(text, '\\d\\d/\\d\\d/\\d{{4}}'), '%m/%d/%Y'), '%Y-%m-%d')
    WHEN id % 6 = 5 THEN strftime(DATE '2024-03-01' - CAST(regexp_extract(text, '(\\d+) days', 1) AS INTEGER), '%Y-%m-%d') END AS iso_date FROM claims""",
)
def temporal_extract(spark, sf):
    return _claims(spark, sf).select("id", temporal.claim_date(F.col("text"), F.to_date(F.lit("2024-03-01"))).alias("iso_date"))


@query(
    "claim_invalidation",
    """WITH c AS (SELECT o_custkey AS custkey, o_orderkey AS orderkey, o_orderdate AS at FROM orders)
    SELECT custkey, orderkey, strftime(replaced_at, '%Y-%m-%d') AS replaced_at FROM (SELECT *, (SELECT min(n.at) FROM c n WHERE n.custkey = c.custkey AND n.at > c.at) AS replaced_at FROM c) WHERE replaced_at IS NOT NULL""",
)
def claim_invalidation(spark, sf):
    """Every order is a claim about its customer, which the customer's next order replaces."""
    c = table(spark, sf, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), F.col("o_orderdate").alias("at"), F.lit("DYNAMIC").alias("temporal_type"))
    return temporal.superseded(c, "custkey", "at").select("custkey", "orderkey", F.date_format("replaced_at", "yyyy-MM-dd").alias("replaced_at"))


@query("metrics_rollup", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, round(sum(CASE WHEN value > 0 THEN 1 ELSE 0 END) / count(*), 6) AS hit_rate FROM events GROUP BY event_type")
def metrics_rollup(spark, sf):
    return metrics.rollup(table(spark, sf, "events"))


@query("prometheus_export", """SELECT 'brindle_events_total{type="' || event_type || '"} ' || count(*) AS line FROM events GROUP BY event_type""")
def prometheus_export(spark, sf):
    n = table(spark, sf, "events").groupBy(F.col("event_type").alias("label")).agg(F.count(F.lit(1)).cast("string").alias("value"))
    return metrics.prometheus(n.withColumn("name", F.lit("events_total")))


@query("metric_ring", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 1000")
def metric_ring(spark, sf):
    return metrics.ring(table(spark, sf, "events"), "event_type", [F.desc("ts"), F.desc("event_id")]).select("event_type", "event_id")


@query(
    "windowed_metrics",
    "SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
)
def windowed_metrics(spark, sf):
    """The batch twin of the streaming rollup by day."""
    d = table(spark, sf, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    "normalize_records",
    """SELECT p_partkey, upper(trim(p_brand)) AS symbol, round(p_retailprice, 2) AS price, CASE WHEN p_size < 10 THEN 'bullish' WHEN p_size < 20 THEN 'bearish' WHEN p_size < 30 THEN 'neutral' ELSE 'unclear' END AS bias,
    CASE p_partkey % 4 WHEN 0 THEN 'risk_management' WHEN 1 THEN 'strategy' ELSE 'general' END AS category, CASE p_partkey % 5 WHEN 0 THEN 'long' WHEN 1 THEN 'short' WHEN 2 THEN 'breakout' ELSE 'other name' END AS setup,
    CASE WHEN p_partkey % 3 = 0 THEN 'asset' ELSE 'concept' END AS entity_type FROM part WHERE p_retailprice > 0""",
)
def normalize_records(spark, sf):
    """Every part as a record with fields as a model writes them."""
    from brindle.operators import records

    k = F.col("p_partkey")
    raw = table(spark, sf, "part").select(
        "p_partkey", F.concat(F.lit(" "), F.lower("p_brand"), F.lit(" ")).alias("symbol"), F.col("p_retailprice").alias("price"), F.when(F.col("p_size") < 10, "BULLISH").when(F.col("p_size") < 20, "Bearish").when(F.col("p_size") < 30, "neutral").otherwise("long").alias("bias"),
        F.when(k % 4 == 0, "Risk Management").when(k % 4 == 1, "STRATEGY").when(k % 4 == 2, "risk").alias("category"), F.when(k % 5 == 0, "Buy").when(k % 5 == 1, "SHORT position").when(k % 5 == 2, "Breakout").otherwise("Other name").alias("setup"), F.when(k % 3 == 0, "Asset").otherwise("thing").alias("entity_type"),
    )
    out = records.normalise(raw).withColumn("setup", records.setup_type(F.col("setup"))).withColumn("entity_type", records.entity_type(F.col("entity_type"), ["asset", "person"]))
    return out.select("p_partkey", "symbol", "price", "bias", "category", "setup", "entity_type")


@query(
    "parse_extractions",
    "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN 'E' || event_type END AS name, CASE WHEN event_id % 4 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events",
)
def parse_extractions(spark, sf):
    """Model output as JSON rows; a broken row gives nulls and does not stop the others."""
    from brindle.operators.records import parse

    raw = F.when(F.col("event_id") % 4 == 0, F.lit("{broken")).otherwise(F.format_string('{"name":"E%s","k":%s}', "event_type", F.get_json_object("props", "$.k")))
    return parse(table(spark, sf, "events").select("event_id", raw.alias("raw")), "name string, k bigint").select("event_id", "x.name", "x.k")


_RANGE = "min(CAST(ts AS DATE)) + 3 AS first, max(CAST(ts AS DATE)) - 3 AS last FROM events"


@query(
    "metric_range",
    f"""WITH b AS (SELECT {_RANGE}) SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high, true AS users_close, true AS quantiles_close
    FROM events, b WHERE CAST(ts AS DATE) BETWEEN first AND last GROUP BY event_type""",
)
def metric_range(spark, sf):
    """A range of days out of stored sketches: exact numbers, and whether users and quantiles lie within five hundredths of the truth."""
    from brindle.operators import sketches
    from brindle.shared import Written

    e = table(spark, sf, "events")
    path = Written(spark, "sketches").path("daily")
    sketches.save(sketches.daily(e, ["event_type"]), path)
    first, last = (str(x) for x in e.agg(F.date_add(F.min(F.to_date("ts")), 3), F.date_sub(F.max(F.to_date("ts")), 3)).first())
    got = sketches.over(spark.read.parquet(path), first, last, ["event_type"])
    off = sketches.error(e, got, first, last, "event_type")
    close = off.select("event_type", (F.col("users_error") <= 0.05).alias("users_close"), (F.greatest("p50_error", "p95_error") <= 0.05).alias("quantiles_close"))
    return got.select("event_type", "n", F.round("total", 4).alias("total"), "low", "high").join(close, "event_type")
