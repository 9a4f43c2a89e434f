"""Graph, communities, domains, types and validation over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.operators import graph, knowledge, phrases, rag, search
from brindle.plans.catalog import query
from brindle.plans.fixtures import CHUNKS, ENTITIES, NEAREST, RELATIONS, TOKENS, bm25_sql, chunks, entities, hybrid_sql, relations, table
from brindle.plans.search_queries import ANY, _hybrid

UNITS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+')"
NAMES = ["ach", "ado", "aiai", "aian", "aich", "aielle"]
_NAMES = "names AS (SELECT 'e:' || x AS id, x AS name FROM (SELECT unnest(['" + "', '".join(NAMES) + "']) AS x))"
_MENTIONS = f"{CHUNKS}, {_NAMES}, mentions AS (SELECT DISTINCT chunk_id, doc_id, id AS entity_id FROM (SELECT chunk_id, doc_id, unnest({TOKENS}) AS t FROM chunks) JOIN names ON t = name)"


def _names(spark):
    return spark.createDataFrame([(f"e:{n}", n) for n in NAMES], "id string, name string")


def _mentions(spark, sf):
    return graph.build_mentions(chunks(spark, sf), _names(spark))


@query("mention_build", f"WITH {_MENTIONS} SELECT chunk_id, entity_id FROM mentions")
def mention_build(spark, sf):
    return _mentions(spark, sf)


_PHRASES = f"""{CHUNKS}, w AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark), names AS (SELECT 'b:' || item_id || ':' || k AS id, lower(array_to_string(w[1:k], ' ')) AS name FROM w, (VALUES (2), (4)) AS t(k)),
  nm AS (SELECT id, name, len(regexp_extract_all(name, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+')) AS k FROM names),
  u AS (SELECT chunk_id, {{units}} AS u FROM chunks), sp AS (SELECT DISTINCT k FROM nm),
  o AS (SELECT chunk_id, nm.id, i, i + nm.k - 1 AS j FROM (SELECT chunk_id, k, unnest(range(1, len(u) - k + 2)) AS i, u FROM u, sp) AS s JOIN nm ON nm.k = s.k AND nm.name = array_to_string(u[i:i + s.k - 1], ''))""".replace("{units}", UNITS)


@query("mention_names", f"WITH {_PHRASES} SELECT DISTINCT chunk_id, id AS entity_id FROM o WHERE NOT EXISTS (SELECT 1 FROM o AS p WHERE p.chunk_id = o.chunk_id AND p.i <= o.i AND p.j >= o.j AND p.j - p.i > o.j - o.i)")
def mention_names(spark, sf):
    """Names of two and four words, the first of every benchmark item, in all chunks; of nested ones the longer."""
    w = table(spark, sf, "benchmark").select("item_id", F.split("text", " ", -1).alias("w"), F.explode(F.array(F.lit(2), F.lit(4))).alias("k"))
    names = w.select(F.concat(F.lit("b:"), F.col("item_id").cast("string"), F.lit(":"), F.col("k").cast("string")).alias("id"), F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("name"))
    return graph.build_mentions(chunks(spark, sf), names)


@query("entity_chunks_topk", f"WITH {_MENTIONS} SELECT entity_id, chunk_id FROM mentions QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY chunk_id) <= 5")
def entity_chunks_topk(spark, sf):
    return graph.top_per(_mentions(spark, sf), "entity_id", ["chunk_id"], 5).select("entity_id", "chunk_id")


@query(
    "expand_graph",
    f"""WITH {_MENTIONS}, {bm25_sql(ANY, 'or')}, h AS (SELECT * FROM bm25 ORDER BY raw DESC, id LIMIT 20), m AS (SELECT DISTINCT doc_id, entity_id FROM mentions)
    SELECT h.id, h.score, coalesce(string_agg(entity_id, ',' ORDER BY entity_id), '') AS entities FROM h LEFT JOIN m ON m.doc_id = h.id GROUP BY h.id, h.score""",
)
def expand_graph(spark, sf):
    """Hits with the entities that their documents mention."""
    h = search.bm25(table(spark, sf, "documents"), ANY, "or", 20).select("id", "score")
    m = _mentions(spark, sf).withColumn("id", F.split("chunk_id", ":")[0].cast("bigint")).select("id", "entity_id").distinct()
    return h.join(m, "id", "left").groupBy("id", "score").agg(F.array_join(F.array_sort(F.collect_list("entity_id")), ",").alias("entities"))


@query("community_members", "SELECT 's:' || s_suppkey AS id, n_name AS community FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'c:' || c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def community_members(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("community"), F.col("n_name").alias("name"))
    return entities(spark, sf).where("community is not null").drop("name").join(n, "community").select("id", F.col("name").alias("community"))


@query("entity_relationships", f"WITH {RELATIONS}, r AS (SELECT 'out' AS direction, dst AS other, relation_type, confidence FROM relations WHERE src = 's:1' UNION ALL SELECT 'in', src, relation_type, confidence FROM relations WHERE dst = 's:1') SELECT * FROM r ORDER BY direction, other, relation_type LIMIT 100")
def entity_relationships(spark, sf):
    return graph.relationships(relations(spark, sf), "s:1")


@query("relationship_semi", f"WITH {RELATIONS}, {ENTITIES}, f AS (SELECT id FROM entities WHERE entity_type = 'customer' ORDER BY id LIMIT 20) SELECT src, dst, relation_type FROM relations WHERE src IN (SELECT id FROM f) AND dst IN (SELECT id FROM entities)")
def relationship_semi(spark, sf):
    """Relations whose ends are both known."""
    e = entities(spark, sf)
    return graph.between_known(relations(spark, sf), e.where("entity_type = 'customer'").orderBy("id").limit(20), e)


_BFS = f"""{RELATIONS}, b AS (SELECT src AS a, dst AS b FROM relations UNION SELECT dst, src FROM relations), d0 AS (SELECT 'c:1' AS id),
  d1 AS (SELECT DISTINCT b AS id FROM b WHERE a IN (SELECT id FROM d0) AND b NOT IN (SELECT id FROM d0)),
  d2 AS (SELECT DISTINCT b AS id FROM b WHERE a IN (SELECT id FROM d1) AND b NOT IN (SELECT id FROM d0 UNION SELECT id FROM d1)),
  reached AS (SELECT id, 0 AS depth FROM d0 UNION ALL SELECT id, 1 FROM d1 UNION ALL SELECT id, 2 FROM d2)"""


def _start(spark):
    return spark.createDataFrame([("c:1",)], "id string")


@query("graph_bfs", f"WITH {_BFS} SELECT id, depth FROM reached ORDER BY depth, id LIMIT 500")
def graph_bfs(spark, sf):
    return graph.bfs(relations(spark, sf), _start(spark), 2, limit=500)


@query("graph_edges", f"WITH {_BFS}, n AS (SELECT id FROM reached WHERE depth <= 1) SELECT DISTINCT src, dst, relation_type FROM relations WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)")
def graph_edges(spark, sf):
    """The edges of a traversal, each once."""
    r = relations(spark, sf)
    return graph.edges_between(r, graph.bfs(r, _start(spark), 1))


_LINKS = "links AS (SELECT 'e:' || a AS src, 'e:' || b AS dst FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in zip(NAMES, NAMES[1:], strict=False)) + ") AS t(a, b)), ends AS (SELECT src AS a, dst AS b FROM links UNION SELECT dst, src FROM links)"


@query(
    "graph_enhanced",
    f"""WITH {_MENTIONS}, {_LINKS}, texts AS (SELECT chunk_id AS doc_id, text FROM chunks), {bm25_sql(["ach"], "or", source="texts")}, h AS (SELECT id AS chunk_id, score FROM bm25 ORDER BY raw DESC, id LIMIT 10),
    d0 AS (SELECT DISTINCT entity_id AS seed, entity_id AS id FROM mentions WHERE chunk_id IN (SELECT chunk_id FROM h) ORDER BY 1 LIMIT 5), d1 AS (SELECT DISTINCT seed, b AS id FROM d0 JOIN ends ON a = id EXCEPT SELECT seed, id FROM d0), d2 AS (SELECT DISTINCT seed, b AS id FROM d1 JOIN ends ON a = id EXCEPT (SELECT seed, id FROM d0 UNION SELECT seed, id FROM d1)),
    n AS (SELECT seed, id, 0 AS depth FROM d0 UNION ALL SELECT seed, id, 1 FROM d1 UNION ALL SELECT seed, id, 2 FROM d2), r AS (SELECT DISTINCT id FROM (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY seed ORDER BY depth, id) <= 10)),
    m AS (SELECT entity_id, chunk_id FROM mentions WHERE entity_id IN (SELECT id FROM r) QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY chunk_id) <= 3),
    u AS (SELECT chunk_id, score, 'direct' AS origin FROM h UNION ALL SELECT DISTINCT chunk_id, 0.5::DOUBLE, 'graph' FROM m WHERE chunk_id NOT IN (SELECT chunk_id FROM h))
    SELECT * FROM u ORDER BY origin, score DESC, chunk_id LIMIT 20""",
)
def graph_enhanced(spark, sf):
    """Direct hits among all chunks, and chunks of the entities two steps from those that the hits mention, at a constant score."""
    c = chunks(spark, sf)
    hits = search.bm25(c, ["ach"], "or", 10, id_col="chunk_id").select(F.col("id").alias("chunk_id"), "score")
    links = spark.createDataFrame([(f"e:{a}", f"e:{b}") for a, b in zip(NAMES, NAMES[1:], strict=False)], "src string, dst string")
    return rag.graph_enhanced(hits, _mentions(spark, sf), links)


@query("dual_level", f"WITH {bm25_sql(ANY, 'or')}, {NEAREST}, {hybrid_sql('bm25')}, {_MENTIONS}, top3 AS (SELECT lang FROM documents GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 3), cm AS (SELECT lang, entity_id, count(*) AS n FROM mentions JOIN documents USING (doc_id) WHERE lang IN (SELECT lang FROM top3) GROUP BY lang, entity_id), cx AS (SELECT * FROM cm QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, entity_id) <= 5), ce AS (SELECT DISTINCT entity_id FROM cx), ch AS (SELECT doc_id FROM mentions WHERE entity_id IN (SELECT entity_id FROM ce) QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY chunk_id) <= 5) SELECT id, score, 'hybrid' AS level FROM hybrid UNION ALL SELECT DISTINCT doc_id, 0.5::DOUBLE, 'community' FROM ch WHERE doc_id NOT IN (SELECT id FROM hybrid)")
def dual_level(spark, sf):
    """Direct hits, and documents of the five leading entities of the three largest communities at a constant score; languages stand for communities."""
    d, m = table(spark, sf, "documents"), _mentions(spark, sf).withColumn("doc_id", F.split("chunk_id", ":")[0].cast("bigint"))
    hits = _hybrid(spark, sf).select("id", "score")
    sizes = d.groupBy(F.col("lang").alias("community_id")).agg(F.count(F.lit(1)).alias("entity_count"))
    members = m.join(d.select("doc_id", F.col("lang").alias("community_id")), "doc_id").groupBy("community_id", "entity_id").agg(F.count(F.lit(1)).alias("weight"))
    more = rag.community_chunks(sizes, members, m).select(F.split("chunk_id", ":")[0].cast("bigint").alias("id")).distinct().join(hits, "id", "left_anti")
    return hits.withColumn("level", F.lit("hybrid")).union(more.select("id", F.lit(0.5), F.lit("community")))


@query("community_search", "SELECT n_nationkey AS id, n_name AS name FROM nation WHERE contains(n_name, '12') OR contains('region ' || n_regionkey, '12') OR contains(n_name, 'n 2') OR contains('region ' || n_regionkey, 'n 2') ORDER BY id LIMIT 10")
def community_search(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("summary"))
    return graph.search_communities(n, ["12", "n 2"])


def _tree(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return n.select(key("n:", "n_nationkey").alias("community_id"), key("r:", "n_regionkey").alias("parent_id")).union(r.select(key("r:", "r_regionkey"), F.lit("world"))).union(r.select(F.lit("world"), F.lit(None).cast("string")).limit(1))


_TREE = "tree AS (SELECT 'n:' || n_nationkey AS community_id, 'r:' || n_regionkey AS parent_id FROM nation UNION ALL SELECT 'r:' || r_regionkey, 'world' FROM region UNION ALL SELECT 'world', NULL)"


@query("hierarchy_tree", f"WITH {_TREE} SELECT t.community_id, t.parent_id, coalesce((SELECT string_agg(c.community_id, ',' ORDER BY c.community_id) FROM tree c WHERE c.parent_id = t.community_id), '') AS children FROM tree t")
def hierarchy_tree(spark, sf):
    return graph.children(_tree(spark, sf))


@query("community_path", f"WITH RECURSIVE {_TREE}, p AS (SELECT 0 AS step, community_id, parent_id FROM tree WHERE community_id = 'n:7' UNION ALL SELECT step + 1, t.community_id, t.parent_id FROM p JOIN tree t ON t.community_id = p.parent_id) SELECT step, community_id FROM p")
def community_path(spark, sf):
    return graph.path_to_root(_tree(spark, sf), "n:7")


@query("community_roots", "SELECT o_orderkey AS community_id, first_value(o_orderkey) OVER w AS root, row_number() OVER w - 1 AS depth FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def community_roots(spark, sf):
    """Every order hung below its customer's order before: the root and depth of each."""
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return graph.roots(table(spark, sf, "orders").select(F.col("o_orderkey").alias("community_id"), before.alias("parent_id")))


@query("micro_edges", f"WITH {RELATIONS}, {ENTITIES}, m AS (SELECT id FROM entities WHERE community = '5') SELECT src, dst, relation_type FROM relations WHERE src IN (SELECT id FROM m) OR dst IN (SELECT id FROM m)")
def micro_edges(spark, sf):
    """Edges that touch a community."""
    return graph.touching(relations(spark, sf), entities(spark, sf).where("community = '5'"))


@query("community_groups", f"WITH {ENTITIES} SELECT coalesce(community, 'unassigned') AS community, count(*) AS n FROM entities GROUP BY 1")
def community_groups(spark, sf):
    return entities(spark, sf).groupBy(F.coalesce("community", F.lit("unassigned")).alias("community")).agg(F.count(F.lit(1)).alias("n"))


def _first_sql(key: str, n: int, least: int, extra: str = "") -> str:
    return f"WITH {ENTITIES}, r AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY name, id) AS i FROM entities {extra}) SELECT {key}, count(*) AS entity_count, string_agg(name, ', ' ORDER BY i) FILTER (WHERE i <= {n}) AS key_entities FROM r GROUP BY {key} HAVING count(*) >= {least}"


@query("macro_communities", _first_sql("entity_type", 10, 1))
def macro_communities(spark, sf):
    return knowledge.community_names(entities(spark, sf), ["entity_type"], 10)


@query("meso_communities", _first_sql("community", 5, 2, "WHERE community IS NOT NULL"))
def meso_communities(spark, sf):
    return knowledge.community_names(entities(spark, sf).where("community is not null"), ["community"], 5, 2)


@query(
    "micro_communities",
    f"""WITH {ENTITIES}, {RELATIONS}, f AS (SELECT community, id FROM entities WHERE community IS NOT NULL QUALIFY row_number() OVER (PARTITION BY community ORDER BY id) <= 30), g AS (SELECT * FROM f ORDER BY community, id LIMIT 100),
    x AS (SELECT g.community, g.id, r.dst, row_number() OVER (PARTITION BY g.id ORDER BY r.dst) AS i FROM g LEFT JOIN relations r ON r.src = g.id)
    SELECT community, id, coalesce(string_agg(dst, ',' ORDER BY i) FILTER (WHERE i <= 3), '') AS neighbours FROM x GROUP BY community, id""",
)
def micro_communities(spark, sf):
    """The first 30 entities of each community, 100 in all, with three neighbours each."""
    g = graph.top_per(entities(spark, sf).where("community is not null"), "community", ["id"], 30).select("community", "id").orderBy("community", "id").limit(100)
    near = relations(spark, sf).join(F.broadcast(g.select(F.col("id").alias("src"))), "src", "left_semi")
    near = graph.top_per(near, "src", ["dst"], 3).groupBy(F.col("src").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("dst")), ",").alias("neighbours"))
    return g.join(near, "id", "left").select("community", "id", F.coalesce("neighbours", F.lit("")).alias("neighbours"))


@query(
    "community_parent",
    """WITH c AS (SELECT n_nationkey AS child, count(*) AS cc, list(lower(c_name) ORDER BY c_custkey)[1:5] AS cn FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
    p AS (SELECT n_regionkey AS parent, count(*) AS pc, list(lower(c_name) ORDER BY c_custkey)[1:10] AS pn FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
    s AS (SELECT child, parent, round(least(1.0::DOUBLE, len(list_intersect(cn, pn)) * 0.3::DOUBLE + least(cc::DOUBLE / greatest(pc, 1), 1.0) * 0.3::DOUBLE + 0.4::DOUBLE), 6) AS score FROM c, p)
    SELECT child, parent, score FROM s QUALIFY row_number() OVER (PARTITION BY child ORDER BY score DESC, parent) = 1""",
)
def community_parent(spark, sf):
    c = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))

    def level(key: str, n: int):
        first = graph.top_per(c, key, ["c_custkey"], n).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: x["c_name"]).alias("names"))
        return c.groupBy(key).agg(F.count(F.lit(1)).alias("entity_count")).join(first, key).withColumnRenamed(key, "community_id")

    return knowledge.parent_scores(level("n_nationkey", 5), level("n_regionkey", 10).withColumn("position", F.col("community_id")))


ONTOLOGY = [("A", "ach"), ("A", "ado"), ("A", "ado"), ("B", "aiai"), ("B", "aian"), ("B", "of the"), ("C", "aich"), ("C", "aielle"), ("C", "ouer")]
_ONTO = "onto AS (SELECT * FROM (VALUES " + ", ".join(f"('{d}', '{k}')" for d, k in ONTOLOGY) + ") AS t(domain, keyword))"
_HITS = f"""{_ONTO}, tk AS (SELECT doc_id, {UNITS} AS t FROM documents), g AS (SELECT doc_id, unnest(t || list_transform(range(1, len(t) - 1), lambda i: t[i] || t[i + 1] || t[i + 2])) AS k FROM tk),
  c AS (SELECT doc_id AS id, k AS keyword, count(*) AS n FROM g WHERE k IN (SELECT keyword FROM onto) GROUP BY ALL),
  raw AS (SELECT id, domain, sum(least(n * 0.1::DOUBLE, 0.5::DOUBLE)) AS r FROM c JOIN onto USING (keyword) GROUP BY ALL),
  sc AS (SELECT id, domain, round(r / max(r) OVER (PARTITION BY id), 6) AS score FROM raw),
  rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, domain) AS rank FROM sc)"""


def _domains(spark, sf):
    return knowledge.domain_scores(table(spark, sf, "documents"), spark.createDataFrame(ONTOLOGY, "domain string, keyword string"))


@query("domain_keywords", f"WITH {_HITS} SELECT id, keyword, n FROM c")
def domain_keywords(spark, sf):
    """Counts of ontology keywords as written, of one word or several, in every document."""
    return phrases.counts(table(spark, sf, "documents"), spark.createDataFrame(ONTOLOGY, "domain string, keyword string"), id_col="doc_id", phrase_col="keyword").withColumnRenamed("phrase", "keyword")


@query("domain_detect", f"WITH {_HITS} SELECT id, domain, score, rank FROM rk WHERE rank <= 5")
def domain_detect(spark, sf):
    return _domains(spark, sf).select("id", "domain", "score", "rank")


@query("domain_primary", f"WITH {_HITS}, w AS (SELECT id, max(domain) FILTER (WHERE rank = 1) AS d, max(score) FILTER (WHERE rank = 1) AS a, max(score) FILTER (WHERE rank = 2) AS b FROM rk GROUP BY id) SELECT doc_id AS id, coalesce(d, 'GENERAL') AS primary_domain, coalesce(b > 0.7 * a, false) AS is_multi FROM documents LEFT JOIN w ON id = doc_id")
def domain_primary(spark, sf):
    return knowledge.primary_domain(table(spark, sf, "documents"), _domains(spark, sf))


_MODEL = "model AS (SELECT doc_id AS id, CASE lang WHEN 'en' THEN 'A' WHEN 'fr' THEN 'B' WHEN 'de' THEN 'D' END AS domain, (n_chars % 11) / 10::DOUBLE AS confidence FROM documents)"


@query(
    "domain_detection",
    f"""WITH {_HITS}, {_MODEL}, ks AS (SELECT id, domain, score FROM rk WHERE rank <= 5), ms AS (SELECT * FROM model WHERE domain IS NOT NULL AND confidence IS NOT NULL),
    bl AS (SELECT coalesce(k.id, m.id) AS id, coalesce(k.domain, m.domain) AS domain, round(CASE WHEN k.id IS NOT NULL AND m.id IS NOT NULL THEN 0.4::DOUBLE * k.score + 0.6::DOUBLE * confidence ELSE coalesce(k.score, confidence) END, 6) AS s FROM ks k FULL OUTER JOIN ms m ON m.id = k.id AND m.domain = k.domain),
    o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, domain) AS r FROM bl), w AS (SELECT id, max(domain) FILTER (WHERE r = 1) AS d, max(s) FILTER (WHERE r = 1) AS a, max(s) FILTER (WHERE r = 2) AS b FROM o GROUP BY id)
    SELECT doc_id AS id, coalesce(d, 'GENERAL') AS primary_domain, coalesce(a, CASE WHEN regexp_replace(coalesce(text, ''), '\\s', '', 'g') = '' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) AS confidence, coalesce(b > 0.7::DOUBLE * a, false) AS is_multi,
      CASE WHEN doc_id IN (SELECT id FROM ks) AND doc_id IN (SELECT id FROM ms) THEN 'hybrid' WHEN doc_id IN (SELECT id FROM ks) THEN 'keyword' WHEN doc_id IN (SELECT id FROM ms) THEN 'model' ELSE 'fallback' END AS method
    FROM documents LEFT JOIN w ON id = doc_id""",
)
def domain_detection(spark, sf):
    """Every document's domain from keywords and a model's verdicts, here a stand-in by language and length."""
    d = table(spark, sf, "documents")
    model = d.select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "en", "A").when(F.col("lang") == "fr", "B").when(F.col("lang") == "de", "D").alias("domain"), (F.col("n_chars") % 11 / 10).alias("confidence"))
    return knowledge.detect(d, spark.createDataFrame(ONTOLOGY, "domain string, keyword string"), model)


@query(
    "domain_propagate",
    f"""WITH {_PHRASES}, m AS (SELECT DISTINCT chunk_id, id AS entity_id FROM o WHERE NOT EXISTS (SELECT 1 FROM o AS p WHERE p.chunk_id = o.chunk_id AND p.i <= o.i AND p.j >= o.j AND p.j - p.i > o.j - o.i)),
    n AS (SELECT entity_id, lang AS domain, count(DISTINCT doc_id) AS n FROM m JOIN documents ON doc_id = CAST(split_part(chunk_id, ':', 1) AS BIGINT) WHERE lang IS NOT NULL GROUP BY ALL), e AS (SELECT entity_id, arg_min(domain, (-n, domain)) AS domain FROM n GROUP BY 1),
    l AS (SELECT 'b:' || item_id || ':2' AS src, 'b:' || item_id || ':4' AS dst FROM benchmark UNION ALL SELECT 'b:' || item_id || ':4', 'b:' || (item_id + 1) || ':2' FROM benchmark)
    SELECT l.src, l.dst, e.domain FROM l JOIN e ON e.entity_id = l.src""",
)
def domain_propagate(spark, sf):
    """Document to entity to edge: an entity takes the commonest language of its documents, an edge that of its source. Edges tie each benchmark item's names to each other and to the next item's."""
    d = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("domain"))
    m = mention_names(spark, sf).select(F.split("chunk_id", ":")[0].cast("bigint").alias("doc_id"), "entity_id")
    name = lambda n, k: F.concat(F.lit("b:"), n.cast("string"), F.lit(f":{k}"))
    i = F.col("item_id")
    edges = table(spark, sf, "benchmark").select(F.inline(F.array(F.struct(name(i, 2).alias("src"), name(i, 4).alias("dst")), F.struct(name(i, 4).alias("src"), name(i + 1, 2).alias("dst")))))
    return knowledge.propagate_domains(m, d, edges)[1]


def _parts(spark, sf):
    p = table(spark, sf, "part")
    props = F.map_filter(F.create_map(F.lit("name"), F.col("p_name"), F.lit("type"), F.col("p_type"), F.lit("size"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_size").cast("string")), F.lit("note"), F.when(F.col("p_partkey") % 3 == 0, F.lit("x"))), lambda k, v: v.isNotNull())
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("entity_type"), props.alias("properties"))


_PROPS = """props AS (SELECT p_partkey AS id, p_name AS name, p_brand AS entity_type, unnest(list_filter(['name', 'type', CASE WHEN p_partkey % 7 <> 0 THEN 'size' END, CASE WHEN p_partkey % 3 = 0 THEN 'note' END], lambda x: x IS NOT NULL)) AS property FROM part)"""


@query("type_frequency", "SELECT p_brand AS entity_type, count(*) AS frequency FROM part GROUP BY 1 HAVING count(*) >= 2")
def type_frequency(spark, sf):
    return _parts(spark, sf).groupBy("entity_type").agg(F.count(F.lit(1)).alias("frequency")).where("frequency >= 2")


@query("type_properties", f"WITH {_PROPS} SELECT entity_type, string_agg(DISTINCT property, ',' ORDER BY property) AS properties FROM props GROUP BY 1")
def type_properties(spark, sf):
    return _parts(spark, sf).select("entity_type", F.explode(F.map_keys("properties")).alias("p")).groupBy("entity_type").agg(F.array_join(F.array_sort(F.collect_set("p")), ",").alias("properties"))


_REQUIRED = f"WITH {_PROPS}, t AS (SELECT p_brand AS entity_type, count(*) AS total FROM part GROUP BY 1) SELECT entity_type, property, round(count(*)::DOUBLE / max(total), 6) AS presence FROM props JOIN t USING (entity_type) GROUP BY 1, 2 HAVING count(*)::DOUBLE / max(total) >= 0.8"


@query("required_props", _REQUIRED)
def required_props(spark, sf):
    return knowledge.required_properties(_parts(spark, sf))


@query(
    "type_discovery",
    f"""WITH {_PROPS}, f AS (SELECT p_brand AS entity_type, count(*) AS frequency, least(count(DISTINCT p_name), 20) AS n_examples FROM part GROUP BY 1 HAVING count(*) >= 2), p AS (SELECT entity_type, count(DISTINCT property) AS n_properties FROM props GROUP BY 1),
    c AS (SELECT *, round(0.4::DOUBLE * least(frequency / 10.0::DOUBLE, 1.0) + 0.4::DOUBLE * (0.7::DOUBLE + 0.3::DOUBLE * least(n_examples / 10.0::DOUBLE, 1.0)) + 0.2::DOUBLE * least(n_properties / 5.0::DOUBLE, 1.0), 6) AS confidence FROM f JOIN p USING (entity_type))
    SELECT entity_type, frequency, CAST(n_examples AS BIGINT) AS n_examples, n_properties, confidence, confidence >= 0.9 AND entity_type <> 'Brand#11' AS promoted FROM c ORDER BY confidence DESC, entity_type LIMIT 20""",
)
def type_discovery(spark, sf):
    return knowledge.discover_types(_parts(spark, sf), ["Brand#11"]).withColumn("n_examples", F.col("n_examples").cast("bigint"))


def _types(spark, sf):
    p = table(spark, sf, "part")
    both = p.select(F.col("p_type").alias("entity_type")).union(p.select(F.split("p_type", " ")[0])).union(p.select(F.substring("p_type", 1, 3)))
    return both.groupBy("entity_type").agg(F.count(F.lit(1)).alias("frequency"))


@query(
    "type_hierarchy",
    """WITH t AS (SELECT entity_type, count(*) AS f FROM (SELECT p_type AS entity_type FROM part UNION ALL SELECT split_part(p_type, ' ', 1) FROM part UNION ALL SELECT substring(p_type, 1, 3) FROM part) GROUP BY 1)
    SELECT a.entity_type, b.entity_type AS parent FROM t a JOIN t b ON starts_with(a.entity_type, b.entity_type) AND a.entity_type <> b.entity_type QUALIFY row_number() OVER (PARTITION BY a.entity_type ORDER BY b.f DESC, b.entity_type) = 1""",
)
def type_hierarchy(spark, sf):
    return knowledge.type_parents(_types(spark, sf))


_TYPED = f"{RELATIONS}, typed AS (SELECT relation_type, CASE substring(src, 1, 1) WHEN 'c' THEN 'customer' ELSE 'supplier' END AS st, 'part' AS tt FROM relations)"


def _typed(spark, sf):
    kind = lambda c: F.when(F.col(c).startswith("c:"), "customer").when(F.col(c).startswith("s:"), "supplier").otherwise("part")
    return relations(spark, sf).select("relation_type", kind("src").alias("source_type"), kind("dst").alias("target_type"))


@query("edge_type_schema", f"WITH {_TYPED} SELECT relation_type, string_agg(DISTINCT st, ',' ORDER BY st) AS source_types, string_agg(DISTINCT tt, ',' ORDER BY tt) AS target_types FROM typed GROUP BY 1")
def edge_type_schema(spark, sf):
    return knowledge.edge_schema(_typed(spark, sf))


@query("schema_induce", f"WITH {_TYPED}, q AS ({_REQUIRED}) SELECT 'type' AS kind, entity_type AS name, string_agg(property, ',' ORDER BY property) AS detail FROM q GROUP BY 2 UNION ALL SELECT 'edge', relation_type, string_agg(DISTINCT st || '>' || tt, ',') FROM typed GROUP BY 2")
def schema_induce(spark, sf):
    return knowledge.induce_schema(_parts(spark, sf), _typed(spark, sf))


_HALVES = """a AS (SELECT p_brand AS b, list_sort(list_distinct(list(p_size::VARCHAR))) AS x, list_sort(list_distinct(list(p_type))) AS y, 'old' AS r FROM part WHERE p_partkey % 2 = 0 GROUP BY 1),
  c AS (SELECT p_brand AS b, list_sort(list_distinct(list(p_size::VARCHAR))) AS x, list_sort(list_distinct(list(p_name))) AS y, 'new' AS r FROM part WHERE p_partkey % 5 = 0 GROUP BY 1),
  m AS (SELECT coalesce(a.b, c.b) AS entity_type, list_sort(list_distinct(coalesce(a.x, []) || coalesce(c.x, []))) AS examples, list_sort(list_distinct(coalesce(a.y, []) || coalesce(c.y, []))) AS properties, coalesce(a.r, c.r) AS of FROM a FULL OUTER JOIN c ON a.b = c.b)"""


def _merged(spark, sf):
    p = table(spark, sf, "part")

    def side(cond: str, prop: str, of: str):
        return p.where(cond).groupBy(F.col("p_brand").alias("entity_type")).agg(F.collect_set(F.col("p_size").cast("string")).alias("examples"), F.collect_set(prop).alias("properties")).withColumn("relationships", F.create_map(F.lit("of"), F.lit(of)))

    return knowledge.merge_schemas(side("p_partkey % 2 = 0", "p_type", "old"), side("p_partkey % 5 = 0", "p_name", "new"))


@query("schema_merge", f"WITH {_HALVES} SELECT entity_type, array_to_string(examples, ',') AS examples, array_to_string(properties, ',') AS properties, of FROM m")
def schema_merge(spark, sf):
    """Two schemas as one: unions of examples and properties, the old one's relationships."""
    return _merged(spark, sf).select("entity_type", F.array_join("examples", ",").alias("examples"), F.array_join("properties", ",").alias("properties"), F.col("relationships")["of"].alias("of"))


@query("schema_template", f"""WITH {_HALVES} SELECT entity_type, CAST(json_object('type', entity_type, 'description', 'Description for ' || entity_type, 'properties', json('{{' || array_to_string(list_transform(properties, lambda p: to_json(p) || ':null'), ',') || '}}'), 'required', json('[]')) AS VARCHAR) AS template FROM m""")
def schema_template(spark, sf):
    return knowledge.schema_template(_merged(spark, sf))


@query(
    "validate_entities",
    """SELECT p_partkey AS id, unnest(list_filter([CASE WHEN p_partkey % 11 = 0 THEN 'Entity missing entity_type' WHEN p_brand NOT IN ('Brand#11', 'Brand#12', 'Brand#1', 'Brand#2', 'Brand#3') THEN 'Unknown entity type: ' || p_brand END,
    CASE WHEN p_partkey % 11 <> 0 AND p_brand IN ('Brand#11', 'Brand#1') AND p_partkey % 7 = 0 THEN p_brand || ' missing required property: size' END], lambda x: x IS NOT NULL)) AS error FROM part""",
)
def validate_entities(spark, sf):
    d = _parts(spark, sf).withColumn("entity_type", F.when(F.col("id") % 11 != 0, F.col("entity_type")))
    return knowledge.entity_errors(d, ["Brand#11", "Brand#12", "Brand#1", "Brand#2", "Brand#3"], {"Brand#11": ["size"], "Brand#1": ["size"]})


@query("validate_edges", f"WITH {RELATIONS} SELECT src, dst, 'Unknown edge type: SUPPLIES' AS error FROM relations WHERE relation_type = 'SUPPLIES'")
def validate_edges(spark, sf):
    return knowledge.edge_errors(relations(spark, sf), ["ORDERED"])


@query("edge_type_fallback", f"WITH {RELATIONS} SELECT src, dst, CASE WHEN relation_type = 'ORDERED' THEN relation_type ELSE 'RELATED_TO' END AS relation_type FROM relations")
def edge_type_fallback(spark, sf):
    return relations(spark, sf).select("src", "dst", graph.fallback_type(F.col("relation_type"), ["ORDERED"]).alias("relation_type"))


@query(
    "entity_dedup",
    """SELECT arg_min(CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) END, c_custkey) AS name, count(*) AS mention_count, CAST(arg_max(c_nationkey, c_custkey) AS VARCHAR) AS nation, min(c_name) FILTER (WHERE c_custkey = f) AS source_text
    FROM (SELECT *, min(c_custkey) FILTER (WHERE c_custkey % 3 <> 0) OVER (PARTITION BY c_mktsegment) AS f FROM customer) GROUP BY c_mktsegment""",
)
def entity_dedup(spark, sf):
    c = table(spark, sf, "customer")
    name = F.when(F.col("c_custkey") % 2 == 0, F.upper("c_mktsegment")).otherwise(F.lower("c_mktsegment"))
    d = c.select(F.col("c_custkey").alias("seq"), name.alias("name"), F.lit("segment").alias("entity_type"), F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string")).alias("properties"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).otherwise("").alias("source_text"))
    return knowledge.dedup_entities(d).select("name", "mention_count", F.col("properties")["nation"].alias("nation"), "source_text")


@query(
    "entity_resolution",
    """WITH RECURSIVE p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) >= 0.36),
    e AS (SELECT x, y FROM p UNION SELECT y, x FROM p), r AS (SELECT x AS id, x AS c FROM e UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.id) SELECT id, min(c) AS component FROM r GROUP BY id""",
)
def entity_resolution(spark, sf):
    """Vectors of a label (the block) that are near enough are one entity, over any chain."""
    return graph.components(graph.similar_within(table(spark, sf, "embeddings"), "label", 0.36))


@query(
    "entity_merge",
    f"""WITH {ENTITIES}, {RELATIONS}, one AS (SELECT id, min(id) OVER (PARTITION BY entity_type, community) AS component FROM entities WHERE community IS NOT NULL)
    SELECT DISTINCT coalesce(a.component, r.src) AS src, coalesce(b.component, r.dst) AS dst, relation_type FROM relations r LEFT JOIN one a ON a.id = r.src LEFT JOIN one b ON b.id = r.dst WHERE coalesce(a.component, r.src) <> coalesce(b.component, r.dst)""",
)
def entity_merge(spark, sf):
    """Customers and suppliers of a nation as one entity each, with their edges."""
    from pyspark.sql import Window

    e = entities(spark, sf)
    same = e.where("community is not null").select("id", F.min("id").over(Window.partitionBy("entity_type", "community")).alias("component"))
    return graph.merge_entities(e, relations(spark, sf), same)[1]


@query("merge_buckets", "WITH s AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0) SELECT a, b, score, CASE WHEN score >= 0.3 THEN 'merge' WHEN score >= 0.1 THEN 'review' ELSE 'keep' END AS action FROM s")
def merge_buckets(spark, sf):
    """What is done with each vector and the first one: a stated query against all rows."""
    e = table(spark, sf, "embeddings")
    s = search.nearest(e, e.where("vec_id = 0").select(F.col("embedding").alias("q"))).select(F.lit(0).cast("bigint").alias("a"), F.col("id").alias("b"), "score")
    return s.withColumn("action", graph.bucket(F.col("score"), 0.3, 0.1))


@query("relation_types", f"WITH {RELATIONS}, r AS (SELECT 'out' AS direction, dst AS other, relation_type, confidence FROM relations WHERE src = 's:1' UNION ALL SELECT 'in', src, relation_type, confidence FROM relations WHERE dst = 's:1') SELECT * FROM r WHERE relation_type = 'SUPPLIES' AND direction = 'out' ORDER BY other LIMIT 100")
def relation_types(spark, sf):
    """One direction and one type of an entity's relations."""
    return graph.relationships(relations(spark, sf), "s:1", "out", ["SUPPLIES"])


@query("edge_scan", f"WITH {RELATIONS} SELECT src, dst, relation_type FROM relations ORDER BY ALL LIMIT 500")
def edge_scan(spark, sf):
    return graph.edge_scan(relations(spark, sf))


@query("community_assign", "SELECT 'c:' || c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'overdrawn' ELSE CAST(c_nationkey AS VARCHAR) END AS community_id FROM customer")
def community_assign(spark, sf):
    """Customers move from their nation's community to another."""
    c = table(spark, sf, "customer").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_nationkey").cast("string").alias("community_id"), "c_acctbal")
    return graph.assign(c, c.where("c_acctbal < 0").withColumn("community_id", F.lit("overdrawn")))


_LEVELS = f"""{ENTITIES}, lv AS (SELECT 'macro' AS level, entity_type AS community_id, count(*) AS entity_count FROM entities GROUP BY 2 UNION ALL SELECT 'meso', community, count(*) FROM entities WHERE community IS NOT NULL GROUP BY 2)"""


def _levels(spark, sf):
    e = entities(spark, sf)
    count = lambda d, key, level: d.groupBy(F.col(key).alias("community_id")).agg(F.count(F.lit(1)).alias("entity_count")).select(F.lit(level).alias("level"), "community_id", "entity_count")
    return count(e, "entity_type", "macro").union(count(e.where("community is not null"), "community", "meso"))


@query("community_list", f"WITH {_LEVELS} SELECT * FROM lv ORDER BY entity_count DESC, community_id LIMIT 20")
def community_list(spark, sf):
    """The largest communities of all levels."""
    return knowledge.in_order(_levels(spark, sf), 20)


@query("community_level", f"WITH {_LEVELS} SELECT * FROM lv WHERE level = 'meso'")
def community_level(spark, sf):
    return graph.at_level(_levels(spark, sf), "meso")


_SUMMARIES = f"""{ENTITIES}, r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY id) AS i FROM entities WHERE community IS NOT NULL),
  sm AS (SELECT community, count(*) AS n, 'Contains ' || count(*) || ' entities of types: ' || string_agg(DISTINCT entity_type, ', ' ORDER BY entity_type) || '. Key entities: ' || string_agg(name, ', ' ORDER BY i) FILTER (WHERE i <= 5) AS summary, string_agg(name, ', ' ORDER BY i) FILTER (WHERE i <= 5) AS names FROM r GROUP BY community)"""


@query("community_summaries", f"WITH {_SUMMARIES} SELECT community, summary FROM sm")
def community_summaries(spark, sf):
    return knowledge.summaries(entities(spark, sf).where("community is not null"))


@query(
    "naming_prompts",
    f"""WITH {_SUMMARIES} SELECT community AS community_id, 'Generate a concise name (2-5 words) for this sub-topic or theme:' || chr(10) || chr(10) || 'Summary: ' || summary || chr(10) || 'Key entities: ' || names || chr(10) || 'Entity count: ' || n || chr(10) || chr(10) ||
    'Respond with a JSON object with keys ''name'' (string) and ''confidence'' (number 0.0-1.0).' || chr(10) || 'Example: {{"name": "Machine Learning Systems", "confidence": 0.85}}' AS prompt FROM sm""",
)
def naming_prompts(spark, sf):
    e = entities(spark, sf).where("community is not null")
    names = graph.top_per(e, "community", ["id"], 5).groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "name"))), lambda x: x["name"]).alias("key_entities"))
    c = knowledge.summaries(e).join(names, "community").join(e.groupBy("community").agg(F.count(F.lit(1)).alias("entity_count")), "community")
    return knowledge.naming_prompts(c.withColumnRenamed("community", "community_id").withColumn("level", F.lit("meso")))


@query(
    "community_hierarchy",
    """WITH RECURSIVE p AS (SELECT a.vec_id AS x, b.vec_id AS y, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id),
    e1 AS (SELECT x, y FROM p WHERE s >= 0.4 UNION SELECT y, x FROM p WHERE s >= 0.4), e2 AS (SELECT x, y FROM p WHERE s >= 0.34 UNION SELECT y, x FROM p WHERE s >= 0.34),
    r1 AS (SELECT x AS id, x AS c FROM e1 UNION SELECT e1.y, r1.c FROM r1 JOIN e1 ON e1.x = r1.id), r2 AS (SELECT x AS id, x AS c FROM e2 UNION SELECT e2.y, r2.c FROM r2 JOIN e2 ON e2.x = r2.id),
    c1 AS (SELECT id, min(c) AS c FROM r1 GROUP BY id), c2 AS (SELECT id, min(c) AS c FROM r2 GROUP BY id)
    SELECT 0 AS level, c1.id, c1.c AS community_id, c2.c AS parent_id FROM c1 JOIN c2 ON c2.id = c1.c UNION ALL SELECT 1, id, c, NULL FROM c2""",
)
def community_hierarchy(spark, sf):
    """Vectors of a label clustered at two thresholds."""
    return graph.hierarchy(table(spark, sf, "embeddings"), "label", [0.4, 0.34])
