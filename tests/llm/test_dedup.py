"""Exact, near and suffix deduplication against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from brindle.llm.components import connected_components
from brindle.llm.common import Written
from brindle.llm.exact_dedup import exact_dedup
from brindle.llm.minhash import forest, linked, near_duplicates, shingle_set, signature
from brindle.llm.suffix_dedup import anchors_of, suffix_dedup
from tests.llm.fixtures import documents, empty


def strip(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


@pytest.mark.parametrize("digest", [None, lambda c: F.substring(F.sha2(c, 256), 1, 1)])
def test_exact_dedup_matches_brute_force(spark, digest):
    """With a digest of one hex digit nearly all digests stand for several contents."""
    d, rows = documents(spark)
    groups = defaultdict(list)
    for r in rows:
        groups[strip(r[1])].append((-len(r[1] or ""), r[0] is None, r[0] or 0))
    want = Counter()
    for r in rows:
        g = groups[strip(r[1])]
        best = min(g)
        keep = None if best[1] else best[2]
        want[(r[0], keep, len(g), r[0] == keep and len(r[1] or "") == -best[0], hashlib.sha256(strip(r[1]).encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in exact_dedup(d, digest=digest).collect()) == want


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup(empty(spark)).count() == 0


def _components(rows, percent=80):
    sets = [(r[0], shingle_set(r[1] or "")) for r in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and len(a) and len(b) and 100 * len(set(a.tolist()) & set(b.tolist())) >= percent * len(set(a.tolist()) | set(b.tolist())):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return Counter((i, len(a), None if i is None else find(i), i is None or i == find(i)) for i, a in sets)


def test_near_duplicates_match_brute_force(spark):
    d, rows = documents(spark)
    assert Counter(tuple(r) for r in near_duplicates(d).collect()) == _components(rows)
    assert near_duplicates(empty(spark)).count() == 0


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """More members than a block holds, linked in chains."""
    import random

    from brindle.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(3)
    base = [f"v{i}" for i in range(80)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(80)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert Counter(tuple(r) for r in got.collect()) == _components(rows)


def test_a_hub_is_verified_in_parts(spark, monkeypatch):
    """A bucket of several blocks by size, and a text with more partners than one group takes."""
    from brindle.llm import minhash

    monkeypatch.setattr(minhash, "WEIGHT", 300)
    monkeypatch.setattr(minhash, "PARTNERS", 3)
    base = [f"v{i}" for i in range(90)]
    rows = [(i, " ".join(base[:45] + [f"e{i}"] * (i > 0) + base[45:])) for i in range(40)] + [(90, "q " * 30), (91, None)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert Counter(tuple(r) for r in got.collect()) == _components(rows)


def test_long_unlike_texts_agree_nowhere(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    a, b = (np.unique(rng.integers(0, 1 << 63, 1_000_000).astype(np.uint64)) for _ in range(2))
    x, y = signature(a), signature(b)
    assert (x == y).sum() <= 1
    assert abs((x == signature(np.concatenate((a[:900_000], b[:100_000])))).mean() - 900 / 1100) < 0.15


def test_permutations_are_one_to_one():
    import numpy as np

    from brindle.llm import minhash

    x = np.arange(1 << 20, dtype=np.uint32) * np.uint32(4099)
    for by in (minhash.FIRST, minhash.SECOND):
        y = minhash.permuted(x.copy(), by, np.empty_like(x))
        assert len(np.unique(y)) == len(x)


def test_recall_on_the_given_documents(spark):
    """Every link of sf0.01, found by counting shared shingles, lies inside a component."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    part = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs).collect()}
    sets = {r["doc_id"]: set(shingle_set(r["text"] or "").tolist()) for r in docs.collect()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common = Counter((a, b) for h in holders.values() if len(h) > 1 for k, b in enumerate(h) for a in h[:k])
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    assert len(links) > 100 and all(part[a] == part[b] for a, b in links)


def test_signature_is_circulant_and_estimates(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64))
    b = np.unique(np.concatenate((a[:360], rng.integers(0, 1 << 63, 40).astype(np.uint64))))
    j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((signature(a) == signature(b)).mean() - j) < 0.15
    assert linked(a, a, 80) and linked(np.arange(4, dtype=np.uint64), np.arange(5, dtype=np.uint64), 80) and not linked(np.arange(3, dtype=np.uint64), np.arange(4, dtype=np.uint64), 80)


def test_forest_spans_what_is_near():
    import numpy as np

    x = np.zeros((4, 10), np.uint16)
    x[3] = 5
    n = np.array([10, 10, 10, 10])
    assert sorted(map(sorted, forest(x, n, 0.6, 80))) == [[0, 1], [0, 2]] or len(forest(x, n, 0.6, 80)) == 2


def test_components_of_a_chain_and_a_star(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(e, "a bigint, b bigint"), Written(spark, "t")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint"), Written(spark, "t")).count() == 0


def _removed(rows, length):
    count = Counter()
    raws = [(r[0], (r[1] or "").encode("utf-8", "replace")) for r in rows]
    for _, b in raws:
        count.update(b[p : p + length] for p in range(len(b) - length + 1))
    covered = defaultdict(set)
    for i, b in raws:
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                covered[i].update(range(p, p + length))
    out = Counter()
    for i, b in raws:
        gone = {x for x in covered[i] if x < len(b)}
        kept = bytes(c for k, c in enumerate(b) if k not in gone)
        spans = sum(1 for x in gone if x - 1 not in gone)
        out[(i, len(b), len(gone), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("length", [50, 200])
def test_suffix_dedup_matches_brute_force(spark, length):
    d, rows = documents(spark)
    got = suffix_dedup(d, length=length, with_text=True).collect()
    assert Counter(tuple(r)[:5] for r in got) == _removed(rows, length)
    assert suffix_dedup(empty(spark)).count() == 0


def test_periodic_and_long_texts(spark, monkeypatch):
    """Texts that repeat inside themselves and texts of several segments."""
    from brindle.llm import suffix_dedup as sd

    rng = __import__("random").Random(4)
    body = "".join(rng.choice("abcdefgh") for _ in range(2600))
    rows = [(1, "ab" * 300), (2, "ab" * 100), (3, "ab" * 101), (4, "c" * 199), (5, "c" * 200), (6, body), (7, "zz" + body[700:2300] + "yy"), (8, body[100:299]), (9, body[100:301])]
    monkeypatch.setattr(sd, "SEGMENT", 500)
    got = suffix_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert Counter(tuple(r) for r in got.collect()) == _removed(rows, 200)
    spans = [x for _, f, t, _ in anchors_of(body.encode(), 200) for x in zip(f.tolist(), t.tolist(), strict=True)]
    assert spans[0][0] == 0 and spans[-1][1] == len(body) - 200 and all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_rows_without_or_with_the_same_id_lose_their_own_bytes_only(spark):
    rng = __import__("random").Random(6)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    shared, alone = text(300), text(900)
    rows = [(None, alone), (None, text(100) + shared), (7, shared + text(80)), (7, text(500)), (8, text(400)), (None, None), (-(1 << 63), text(20) + shared)]
    got = Counter(tuple(r)[:4] for r in suffix_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    want = [(i, len(t or ""), 300 if t and shared in t else 0, int(bool(t) and shared in t)) for i, t in rows]
    assert got == Counter(want)


def test_hot_cores_are_ranked_by_spark(spark, monkeypatch):
    from brindle.llm import suffix_dedup as sd

    d, rows = documents(spark)
    for hot in (1, 3):
        monkeypatch.setattr(sd, "HOT", hot)
        assert Counter(tuple(r) for r in suffix_dedup(d).collect()) == _removed(rows, 200)


def test_rows_go_through_with_their_columns(spark):
    from brindle.llm.suffix_dedup import without_repeats

    d, _ = documents(spark)
    d = d.withColumn("spans", F.create_map(F.lit("a"), F.col("doc_id"))).withColumn("row", F.struct("lang", "doc_id")).withColumn("sum", F.lit(1))
    got, want = without_repeats(d), suffix_dedup(d, with_text=True)
    assert got.columns == d.columns
    assert Counter((r["doc_id"], r["text"], r["lang"], (r["spans"] or {}).get("a"), r["row"]["doc_id"]) for r in got.collect()) == Counter(
        (r["doc_id"], t, r["lang"], r["doc_id"], r["doc_id"]) for r, t in _joined(d, want)
    )


def _joined(d, cut):
    left = defaultdict(list)
    for r in cut.collect():
        left[r["doc_id"], r["n_bytes"]].append(r["text"])
    return [(r, left[r["doc_id"], len((r["text"] or "").encode("utf-8", "replace"))].pop()) for r in d.collect()]


def test_remaining_text_has_whole_characters(spark):
    rows = [(1, "x" + "é" * 150 + "tail"), (2, "yy" + "é" * 150 + "end")]
    got = {r["doc_id"]: r["text"] for r in suffix_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), with_text=True).collect()}
    assert got == {1: "xtail", 2: "yyend"}
