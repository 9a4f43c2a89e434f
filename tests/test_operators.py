"""Hand cases of the engine's operators."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from brindle.functions import text as tx
from brindle.functions.vector import cosine
from brindle.operators import annotate, chunking, graph, knowledge, metrics, rag, records, search, store, temporal
from brindle.sources import files


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


@pytest.fixture(scope="module")
def six(spark):
    texts = ["bitcoin price target price", "ethereum price rally", "bitcoin mining", "running miners mine bitcoin blocks slowly", "defi yield", "nothing here at all"]
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id bigint, text string")


@pytest.mark.parametrize(
    "terms,mode,want",
    [
        (["price"], "and", {1: 0.776988, 2: 0.624270}),
        (["bitcoin", "price"], "and", {1: 0.776989}),
        (["bitcoin", "price"], "or", {1: 0.776989, 2: 0.624270, 3: 1e-6, 4: 1e-6}),
        (["mine"], "and", {4: 1.005475}),
        (["yield"], "and", {5: 1.575509}),
    ],
)
def test_bm25_hand_case(six, terms, mode, want):
    # FTS5 keeps its floored idf unsquashed by length, which is below the rounding here
    got = {r["id"]: r["raw"] for r in search.bm25(six, terms, mode).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_bm25_edges(spark, six):
    empty = six.where("doc_id < 0")
    assert search.bm25(empty, ["price"]).count() == 0
    assert search.bm25(spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string"), ["price"], "or").count() == 0
    with pytest.raises(ValueError):
        search.bm25(six, [])


def test_weighted_fusion_hand_case(spark):
    a = spark.createDataFrame([("d1", 3.0), ("d2", 2.0), ("d3", 1.0)], "id string, score double")
    b = spark.createDataFrame([("d2", 3.0), ("d3", 2.0), ("d4", 1.0)], "id string, score double")
    got = [(r["id"], r["score"]) for r in search.hybrid(a, b).collect()]
    assert got == [("d2", 0.01626124), ("d3", 0.01600102), ("d1", 0.00819672), ("d4", 0.00793651)]


def test_interpolation_checks_weights(spark):
    with pytest.raises(ValueError):
        search.interpolate(spark.createDataFrame([("a", 1, 1.0)], "source string, id int, score double"), {"a": 0.7})


def test_type_confidence_hand_case(spark):
    d = spark.createDataFrame([(2, 2, 0), (10, 10, 5), (12, 20, 3), (9, 9, 5)], "f int, e int, p int")
    got = [round(r[0], 6) for r in d.select(knowledge.type_confidence(F.col("f"), F.col("e"), F.col("p"))).collect()]
    assert got == [0.424, 1.0, 0.92, 0.948]


def test_parent_score_hand_case(spark):
    kind = "community_id string, names array<string>, entity_count int"
    c = spark.createDataFrame([("x", ["A"], 2), ("y", ["B"], 1)], kind)
    p = spark.createDataFrame([("p", ["a"], 4)], kind).withColumn("position", F.lit(0))
    q = spark.createDataFrame([("q", ["z"], 5)], kind).withColumn("position", F.lit(0))
    assert dict(rows(knowledge.parent_scores(c, p), "child", "score"))["x"] == 0.85
    assert dict(rows(knowledge.parent_scores(c, q), "child", "score"))["y"] == 0.46


@pytest.mark.parametrize(
    "text,want",
    [("Founded in 2009", "STATIC"), ("As of 2024-01-05 rates are up", "DYNAMIC"), ("Bitcoin is a currency", "ATEMPORAL"), ("It will rise", "DYNAMIC"), ("He was born there", "STATIC"), ("two days ago", "DYNAMIC"), ("", "ATEMPORAL")],
)
def test_temporal_class(spark, text, want):
    assert spark.range(1).select(temporal.temporal_class(F.lit(text))).first()[0] == want


@pytest.mark.parametrize("text,want", [("Aug 1, 2023 it began", "2023-08-01"), ("May 2023", "2023-05-01"), ("on 3/4/2021", "2021-03-04"), ("2020-02-30", None), ("yesterday", "2024-02-29"), ("nothing", None)])
def test_claim_date(spark, text, want):
    assert spark.range(1).select(temporal.claim_date(F.lit(text), F.to_date(F.lit("2024-03-01")))).first()[0] == want


def test_span_merge_hand_case(spark):
    d = spark.createDataFrame([(1, 0, 5), (1, 3, 8), (1, 8, 10), (1, 12, 14)], "doc_id int, start int, end int")
    assert rows(annotate.merge_spans(d), "start", "end") == [(0, 10), (12, 14)]


def test_split_elements(spark):
    text = "intro\n\n# One\n\npara a\n\npara b\n```\n# not a header\n\nx\n```\n| a | b |\n|---|---|\n| 1 | 2 |\n\n## Two\nlast"
    got = spark.createDataFrame([(text,)], "t string").select(chunking.elements(F.col("t"))).first()[0]
    assert [(x["type"], x["section"]) for x in got] == [("paragraph", None), ("header", "One"), ("paragraph", "One"), ("paragraph", "One"), ("code_block", "One"), ("table", "One"), ("header", "Two"), ("paragraph", "Two")]
    assert got[4]["content"].startswith("```\n# not a header")


def test_chunking_groups_and_overlaps(spark):
    parts = ["a" * 600, "b" * 500, "c" * 100, "d" * 950, "e" * 10]
    got = spark.createDataFrame([(1, "\n\n".join(parts))], "doc_id int, text string")
    out = [r["text"] for r in chunking.chunk_documents(got).orderBy("chunk_index").collect()]
    assert out == ["\n\n".join(parts[:3]), "\n\n".join(parts[2:])]
    assert chunking.chunk_documents(spark.createDataFrame([(1, ""), (2, None)], "doc_id int, text string")).count() == 0


def test_greedy_fold_matches_python(spark):
    texts = ["a b c d e f g h i j", "a b c d e f g h i j k", "a b c d e f g h i j k l", "x", "", "", "x"]
    want, kept = [], []
    for i, t in enumerate(texts):
        w = set(t.split())
        if not any(w and k and len(w & k) > 0.9 * len(w | k) for k in kept):
            kept.append(w)
            want.append(i)
    d = spark.createDataFrame([(1, i, i, sorted(set(t.split()))) for i, t in enumerate(texts)], "query_id int, rank int, id int, w array<string>")
    assert [x for (x,) in rows(rag.greedy_dedup(d), "id")] == want


def test_jaccard_pairs_match_all_pairs(spark):
    sets = [(i, [f"w{j}" for j in range(20) if (i * 7 + j) % 11 or i % 3]) for i in range(30)]
    rep = {i: min(k for k, x in sets if set(x) == set(w)) for i, w in sets}
    want = {(a, b) for a, x in sets for b, y in sets if a < b and rep[a] == a and rep[b] == b and len(set(x) & set(y)) / len(set(x) | set(y)) > 0.9} | {(r, i) for i, r in rep.items() if i != r}
    assert any(r != i for i, r in rep.items())
    got = rag.jaccard_over(spark.createDataFrame(sets, "id int, w array<string>"), 0.9)
    assert set(rows(got, "a", "b")) == want


def test_fuzzy_locate_matches_difflib(spark):
    pairs = [(1, "the quick brown fox", "quick brown"), (2, "the quick brown fox", "quack brewn"), (3, "", "x"), (4, "abc", "")]
    got = dict(rows(annotate.fuzzy_locate(spark.createDataFrame(pairs, "id bigint, text string, quote string")), "id", "at"))
    for i, t, q in pairs:
        m = difflib.SequenceMatcher(None, q, t, autojunk=False).find_longest_match()
        assert got[i] == (m.b if q and m.size > 0.8 * len(q) else -1)


def test_bfs_and_components(spark):
    e = spark.createDataFrame([("a", "b", "R", 1.0), ("b", "c", "R", 1.0), ("c", "a", "R", 1.0), ("x", "y", "S", 1.0)], "src string, dst string, relation_type string, confidence double")
    start = spark.createDataFrame([("a",)], "id string")
    assert rows(graph.bfs(e, start, 3), "id", "depth") == [("a", 0), ("b", 1), ("c", 1)]
    assert rows(graph.bfs(e, start, 3, ["S"]), "id") == [("a",)]
    assert rows(graph.components(e.select("src", "dst")), "id", "component") == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]
    assert graph.relationships(e, "a", "both").count() == 2


def test_path_stops_at_a_cycle(spark):
    t = spark.createDataFrame([("a", "b"), ("b", "a")], "community_id string, parent_id string")
    assert rows(graph.path_to_root(t, "a"), "step", "community_id") == [(0, "a"), (1, "b")]


def test_store_operators(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert rows(store.upsert(base, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), "k"), "k", "v") == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(base.where(store.metadata_filter({"k": {"$gte": 2, "$lte": 5}, "v": {"$contains": "b"}})), "k") == [(2,)]
    assert rows(base.where(store.metadata_filter({})), "k") == [(1,), (2,)]
    with pytest.raises(ValueError):
        store.page(base, ["k"], 0, 0)


def test_domains_count_repeated_keywords_twice(spark):
    docs = spark.createDataFrame([(1, "Bitcoin hash rate up, bitcoin down"), (2, ""), (3, None)], "doc_id bigint, text string")
    onto = spark.createDataFrame([("BTC", "bitcoin"), ("BTC", "hash rate"), ("M", "hash rate"), ("M", "hash rate")], "domain string, keyword string")
    s = knowledge.domain_scores(docs, onto)
    assert rows(s, "id", "domain", "score") == [(1, "BTC", 1.0), (1, "M", round(0.2 / 0.3, 6))]
    assert rows(knowledge.primary_domain(docs, s), "id", "primary_domain") == [(1, "BTC"), (2, "GENERAL"), (3, "GENERAL")]


def test_json_and_csv_to_markdown(spark):
    d = spark.createDataFrame([('{"a": 1, "b": "x"}',), ("[1, {\"c\": 2}]",), ("7",)], "t string").select(files.json_markdown(F.col("t")))
    assert [r[0] for r in d.collect()] == ['# Data\n\n```json\n{\n  "a": 1,\n  "b": "x"\n}\n```\n', '# Data\n\n## Item 1\n\n```json\n1\n```\n\n## Item 2\n\n```json\n{\n  "c": 2\n}\n```\n\n', "# Data\n\n7"]
    c = spark.createDataFrame([('h1,h2\n1,"a, ""b"""\n2,\n',)], "t string").select(files.csv_text_markdown(F.lit("x.csv"), F.col("t"))).first()[0]
    assert c == '# x\n\n| h1 | h2 |\n| --- | --- |\n| 1 | a, "b" |\n| 2 |  |\n'


def test_folder_scan_and_routes(spark, tmp_path):
    (tmp_path / "a.md").write_text("# hi")
    (tmp_path / "b.html").write_text("<p>x &amp; y</p><script>z</script>")
    (tmp_path / "c.bin").write_bytes(b"\0")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    found = files.scan(spark, str(tmp_path))
    assert sorted((r["path"].rsplit("/", 1)[1], r["ok"]) for r in found.collect()) == [("a.md", True), ("b.html", True), ("c.bin", False), ("d.pdf", True)]
    out = {r["path"].rsplit("/", 1)[1]: r["content"] for r in files.route(found, "T", lambda d: d.withColumn("content", F.lit("seen"))).collect()}
    assert out == {"a.md": "---\nsource: a.md\nprocessed: T\n---\n\n# hi", "b.html": "x & y", "d.pdf": "seen"}


def test_records(spark):
    d = spark.createDataFrame([('{"n": "x"}',), ("{bad",), (None,)], "raw string")
    assert [r["x"] and r["x"]["n"] for r in records.parse(d, "n string").collect()] == ["x", None, None]
    d = spark.createDataFrame([("Buy",), ("SHORT POSITION",), ("Breakout",), ("scalp",), ("break out",)], "t string")
    assert [r[0] for r in d.select(records.setup_type(F.col("t"))).collect()] == ["long", "short", "breakout", "scalp", "break out"]
    d = spark.createDataFrame([(" btc ", 1.239, "LONG", "Risk Management"), ("ETH", 2.0, "Bearish", "risk"), ("x", 0.0, "bullish", None), ("y", 3.0, None, None)], "symbol string, price double, bias string, category string")
    got = [tuple(r) for r in records.normalise(d).collect()]
    assert got == [("BTC", 1.24, "unclear", "risk_management"), ("ETH", 2.0, "bearish", "general"), ("Y", 3.0, "unclear", "general")]


def test_fixed_record_values():
    assert records.BIASES == ["bullish", "bearish", "neutral", "unclear"]
    assert records.SETUP_ALIASES == {"buy": "long", "sell": "short", "long position": "long", "short position": "short"}
    assert records.CATEGORIES[:4] == ["strategy", "indicator", "pattern", "risk_management"] and len(records.CATEGORIES) == 9


def test_extraction_keeps_what_does_not_fail(spark):
    d = spark.createDataFrame([(1, "buy BTC now, BTC target 61000.5 as strategy: scalping; ETH follows BTC"), (2, None), (3, "nothing")], "id int, text string")
    got = {r["id"]: r for r in records.extract(d).collect()}
    assert [tuple(x) for x in got[1]["price_targets"]] == [("BTC", 61000.5)] and [tuple(x) for x in got[1]["trading_setups"]] == [("BTC", "buy")]
    assert [x["name"] for x in got[1]["entities"]] == ["BTC", "BTC", "ETH", "BTC"] and [tuple(x) for x in got[1]["relationships"]] == [("ETH", "BTC", "follows")]
    assert [tuple(x) for x in got[1]["concepts"]] == [("scalping", "strategy")]
    assert all(got[i][k] == [] for i in (2, 3) for k in records.KINDS)
    broken = records.rule_extractors() | {"entities": lambda t: F.lit("{no list")}
    again = {r["id"]: r for r in records.extract(d, broken).collect()}
    assert again[1]["entities"] == [] and again[1]["price_targets"] == got[1]["price_targets"]
    b = records.batch(d, lambda t: F.when(t != "nothing", F.length(t)))
    assert tuple(records.progress(b).first()) == (3, 1, 2, 0.333333)


def test_text_functions(spark):
    d = spark.createDataFrame([("see {\"a\": 1} ok",), ("{x",), ("none",)], "t string").select(tx.json_salvage(F.col("t")))
    assert [r[0] for r in d.collect()] == ['{"a": 1}', None, None]
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [r[0] for r in v.select(cosine(F.col("a"), F.col("b"))).collect()] == [1.0, None, None]


def test_csv_with_line_breaks_in_quotes(spark):
    c = spark.createDataFrame([('h,i\n"a\nb",1\nc,"d ""q""\n"\n',)], "t string").select(files.csv_text_markdown(F.lit("x.csv"), F.col("t"))).first()[0]
    assert c == '# x\n\n| h | i |\n| --- | --- |\n| a\nb | 1 |\n| c | d "q"\n |\n'
    assert spark.range(1).select(files.csv_text_markdown(F.lit("x.csv"), F.lit("only,header"))).first()[0] == "# x\n\n| only | header |\n| --- | --- |\n"


def test_files_that_cannot_be_read_are_told(spark):
    d = spark.createDataFrame([("a.json", 3, b"{x}"), ("b.txt", 2, b"\xff\xfe"), ("c.txt", 0, b""), ("d.json", 2, b"{}"), ("e.md", 2, b"hi")], "path string, length bigint, content binary")
    assert [r["error"] for r in files.checked(d).orderBy("path").collect()] == ["not json", "not utf-8", "empty file", None, None]


def test_types_of_one_letter_and_many_types(spark):
    t = spark.createDataFrame([("x", 5), ("xy", 3), ("xyz", 1), ("z", 9)] + [(f"q{i:05d}", 1) for i in range(10_001)], "entity_type string, frequency int")
    assert rows(knowledge.type_parents(t), "entity_type", "parent") == [("xy", "x"), ("xyz", "x")]


def test_parent_scores_match_all_pairs(spark):
    import random

    rng = random.Random(2)
    c = [(f"c{i}", [f"N{rng.randrange(30)}" for _ in range(3)], rng.randrange(1, 40)) for i in range(60)]
    p = [(f"p{i:02d}", [f"n{rng.randrange(30)}" for _ in range(3)], rng.randrange(0, 40), i) for i in range(25)]
    want = {}
    for k, names, n in c:
        scored = [(-round(min(1.0, 0.3 * len({x.lower() for x in names} & {x.lower() for x in q}) + 0.3 * min(n / max(m, 1), 1.0) + 0.4), 6), at, j) for j, q, m, at in p]
        want[k] = (min(scored)[2], -min(scored)[0])
    kind = "community_id string, names array<string>, entity_count int"
    got = knowledge.parent_scores(spark.createDataFrame(c, kind), spark.createDataFrame(p, kind + ", position int"))
    assert {r["child"]: (r["parent"], r["score"]) for r in got.collect()} == want


def test_superseded_within_a_second_and_hot_keys(spark):
    d = spark.sql("SELECT 1 AS k, id, timestamp_micros(1700000000000000 + id * 1000) AS at, 'DYNAMIC' AS temporal_type FROM range(3) UNION ALL SELECT 1, 9, timestamp_micros(1700000000000000), 'DYNAMIC'")
    got = {r["id"]: r["replaced_at"] for r in temporal.superseded(d, "k", "at").collect()}
    assert got.keys() == {0, 1, 9} and got[0] == got[9] < got[1]


def test_longest_block_matches_difflib():
    import random

    rng = random.Random(4)
    for _ in range(300):
        t, q = ("".join(rng.choice("ab ") for _ in range(rng.randrange(40))) for _ in range(2))
        m = difflib.SequenceMatcher(None, q, t, autojunk=False).find_longest_match()
        least = rng.randrange(1, 6)
        assert annotate.longest_block(q, t, least) == ((m.size, m.b) if m.size >= least else (0, -1))


def test_similar_within_splits_large_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 4))
    d = spark.createDataFrame([(i, i % 2, x.tolist()) for i, x in enumerate(v)] + [(60, 0, [0.0] * 4), (61, 1, None), (62, None, [1.0] * 4)], "vec_id bigint, label int, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1)[:, None]
    e = [(i, j) for i in range(60) for j in range(i + 1, 60) if i % 2 == j % 2 and round(float(u[i] @ u[j]), 6) >= 0.8]
    part = {i: i for i in range(60)}
    for a, b in e:
        low, high = sorted((part[a], part[b]))
        part = {k: low if x == high else x for k, x in part.items()}
    for block in (4, 1024):
        got = dict(rows(graph.components(graph.similar_within(d, "label", 0.8, block=block)), "id", "component"))
        assert got == {i: c for i, c in part.items() if any(i in x for x in e)}


def test_merging_points_edges_to_what_stays(spark):
    e = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    r = spark.createDataFrame([("a", "b", "R"), ("b", "c", "R"), ("a", "c", "R"), ("c", "b", "S")], "src string, dst string, relation_type string")
    left, moved = graph.merge_entities(e, r, spark.createDataFrame([("a", "a"), ("b", "a")], "id string, component string"))
    assert rows(left, "id") == [("a",), ("c",)] and rows(moved, "src", "dst", "relation_type") == [("a", "c", "R"), ("c", "a", "S")]


def test_context_preambles(spark):
    e = spark.createDataFrame([(1, 1, "A", "asset", "one"), (1, 2, None, None, None)], "query_id int, position int, name string, entity_type string, description string")
    assert rag.entity_preamble(e).first()["text"] == "## Relevant Entities\n\n- **A** (asset)\n  one\n- **Unknown** (entity)\n\n"
    n = spark.createDataFrame([(1, 1, "A", None)], "query_id int, position int, name string, type string")
    g = spark.createDataFrame([(1, 1, "A", None, "B")], "query_id int, position int, source string, relation_type string, target string")
    text = "## Related Knowledge\n\n### Entities\n- A (entity)"
    assert rag.graph_preamble(n, g).first()["text"] == text + "\n\n### Relationships\n- A → relates to → B\n\n"
    assert rag.graph_preamble(n, g.where("false")).first()["text"] == text + "\n\n"


def test_answers_in_parts(spark):
    d = spark.createDataFrame([("**Reasoning:** because\n**Answer:** yes **Confidence:** high",), ("plain",), ("**Reasoning:** a **Answer:** b **Answer:** c",)], "t string")
    got = [tuple(r[0]) for r in d.select(rag.split_reasoning(F.col("t"))).collect()]
    assert got == [("because", "yes"), (None, "plain"), (None, "**Reasoning:** a **Answer:** b **Answer:** c")]
    d = spark.createDataFrame([('["a?", 1, "b?", "c?", "d?"]',), ("{}",), ("x",), (None,)], "t string")
    assert [r[0] for r in d.select(rag.follow_ups(F.col("t"))).collect()] == [["a?", "b?", "c?"], [], [], []]


def test_metric_ring(spark):
    d = spark.range(10).select((F.col("id") % 2).alias("k"), "id")
    assert rows(metrics.ring(d, "k", [F.desc("id")], 2), "id") == [(6,), (7,), (8,), (9,)]


def test_chunking_takes_time_in_proportion(spark):
    """Four times the headings and paragraphs take about four times as long, and nothing is lost."""
    import time

    def took(n):
        text = "".join(f"# Head {i}\n\nSome words of paragraph {i}.\n\n" for i in range(n))
        d = spark.createDataFrame([(1, text)], "doc_id int, text string")
        began = time.time()
        found = d.select(F.explode(chunking.elements(F.col("text"))).alias("e")).select("e.*").collect()
        assert len(found) == 2 * n and found[-1]["section"] == f"Head {n - 1}" and found[1]["section"] == "Head 0"
        made = chunking.chunk_documents(d, 200, 300, 40).collect()
        assert sum(f"# Head {i}\n" in "\n".join(r["text"] + "\n" for r in made) for i in range(0, n, 997)) == len(range(0, n, 997))
        return time.time() - began

    took(100)
    assert took(16_000) < 5 * max(took(4_000), 1.5)


def test_groups_match_a_plain_fold(spark):
    rng = random.Random(8)

    def plain(parts, target, most, overlap):
        out, cur = [], []
        for x in parts:
            n = sum(map(len, cur))
            if cur and n >= target and (n >= most or n + len(x) > most):
                out.append(cur)
                tail = []
                for y in reversed(cur):
                    if sum(map(len, tail)) + len(y) > overlap:
                        break
                    tail.insert(0, y)
                cur = tail
            cur = [*cur, x]
        return [*out, cur] if cur else out

    lists = [["x" * rng.choice([0, 1, 3, 10, 60, 200]) for _ in range(rng.randint(0, 700))] for _ in range(30)] + [[], None]
    d = spark.createDataFrame(list(enumerate(lists)), "id int, parts array<string>")
    for by in ((50, 100, 20), (100, 100, 0), (1, 5, 500)):
        got = {r["id"]: r["g"] for r in d.select("id", chunking.group_elements(F.col("parts"), *by).alias("g")).collect()}
        assert all(got[i] == (None if p is None else plain(p, *by)) for i, p in enumerate(lists))


def test_detection_of_keywords_and_a_model(spark):
    docs = spark.createDataFrame([(1, "bitcoin bitcoin"), (2, "bitcoin and a patient"), (3, "nothing"), (4, " \n"), (5, None), (6, "nothing either")], "doc_id bigint, text string")
    onto = spark.createDataFrame([("BTC", "bitcoin"), ("MED", "patient")], "domain string, keyword string")
    model = spark.createDataFrame([(1, "BTC", 0.5), (2, "MED", 7.0), (3, "LAW", 0.6), (6, None, 0.9), (6, "X", None)], "id bigint, domain string, confidence double")
    got = rows(knowledge.detect(docs, onto, model), "id", "primary_domain", "confidence", "is_multi", "method")
    assert got == [(1, "BTC", 0.7, False, "hybrid"), (2, "BTC", 1.0, True, "hybrid"), (3, "LAW", 0.6, False, "model"), (4, "GENERAL", 1.0, False, "fallback"), (5, "GENERAL", 1.0, False, "fallback"), (6, "GENERAL", 0.5, False, "fallback")]
    assert rows(knowledge.detect(docs, onto), "id", "method") == [(1, "keyword"), (2, "keyword"), (3, "fallback"), (4, "fallback"), (5, "fallback"), (6, "fallback")]


def test_entities_by_name_and_documents_of_hits(spark):
    e = spark.createDataFrame([("a", "Ann Lee", "p", "x"), ("b", "Lee & Co", "o", "x"), ("c", "Lee", "p", "y")], "id string, name string, entity_type string, domain string")
    assert [r.id for r in graph.search_entities(e, "Lee", "p").collect()] == ["a", "c"] and [r.id for r in graph.search_entities(e, domain="x", limit=1).collect()] == ["a"]
    hits = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.7)], "id int, score double")
    assert [tuple(r) for r in store.with_documents(hits, spark.createDataFrame([(1, "x"), (3, "y")], "id int, t string"), limit=5).collect()] == [(3, 0.7, "y"), (1, 0.5, "x")]
