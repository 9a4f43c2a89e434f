"""SimHash components against brute force over all pairs."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from brindle.llm import queries, simhash
from brindle.llm.common import Written
from brindle.llm.components import connected_components
from tests.llm.fixtures import documents, empty


def plain_print(text, size=3):
    """As the contract words it, one shingle at a time."""
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = [w for w in words.translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, most=2):
    """Component of every fingerprint: a flood over all pairs."""
    left, out = set(prints), {}
    while left:
        front = part = {left.pop()}
        while front:
            front = {y for y in left for x in front if (x ^ y).bit_count() <= most}
            left -= front
            part = part | front
        for x in part:
            out[x] = part
    return out


def expected(rows):
    prints = [plain_print(r[1] or "") for r in rows]
    part, low = plain_components(prints), {}
    for r, x in zip(rows, prints, strict=True):
        key = min(part[x])
        low[key] = min((i for i in (low.get(key), r[0]) if i is not None), default=None)
    return Counter((r[0], f"{x:016x}", low[min(part[x])]) for r, x in zip(rows, prints, strict=True))


def test_fingerprints_are_the_contracts(monkeypatch):
    monkeypatch.setattr(simhash, "_BLOCK", 64)  # texts of many blocks
    rng = random.Random(4)
    texts = ["", " \t\n", "One", "one TWO", "a b c", "İΣ\x1cq\x85 z é", "日本語 " * 90, "ab " * 400, " ".join(f"w{rng.randrange(50)}" for _ in range(3000)), "x" * 5000 + " y"]
    for t in texts:
        assert simhash.fingerprint(t) == plain_print(t), t[:30]


@pytest.mark.parametrize(("limit", "few"), [(simhash.LIMIT, 1 << 18), (3, 0)])
def test_components_match_brute_force(spark, limit, few):
    """With a limit of three members nearly every bucket is met again by its free bits."""
    d, rows = documents(spark)
    assert Counter(tuple(r) for r in simhash.simhash_clusters(d, limit=limit, few=few).collect()) == expected(rows)


@pytest.mark.parametrize("most", [0, 1, 2, 3, 4])
@pytest.mark.parametrize("limit", [1024, 4])
def test_links_tie_together_what_all_pairs_do(spark, most, limit):
    """Dense neighbourhoods: seeds, and walks of a few flipped bits from them, some in one half of the bits only."""
    rng = random.Random(most)
    prints = {0, (1 << 64) - 1}
    for _ in range(25):
        x = rng.getrandbits(64)
        prints.add(x)
        for _ in range(12):
            for _ in range(rng.randint(1, most + 2)):
                x ^= 1 << rng.randrange(rng.choice([8, 64]))
            prints.add(x)
    frame = spark.createDataFrame([(simhash.signed(x),) for x in prints], "print bigint")
    work = Written(spark, "t")
    parts = {r.id & (1 << 64) - 1: r.component for r in connected_components(simhash.links(frame, work, most, limit), work, few=1000 if limit == 4 else 0).collect()}
    want = plain_components(prints, most)
    for x in prints:
        assert {y for y in prints if parts.get(y, simhash.signed(y)) == parts.get(x, simhash.signed(x))} == want[x]


def test_every_near_pair_keeps_a_chains_budgets():
    """The pigeonring promise, and that the filter cuts pairs that share two segments only."""
    rng, cut = random.Random(3), 0
    for most in (1, 2, 3):
        for _ in range(3000):
            diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, most + 3)))
            met = [k for k in simhash.keys(0, most) if not diff & k]
            passed = [k for k in met if len(simhash.chained(np.array([diff], np.uint64), 0, k, most))]
            assert passed or diff.bit_count() > most
            cut += len(met) - len(passed)
    assert cut > 1000


def test_buckets_halve_until_they_are_small():
    mask = 0
    for free in (32, 16, 8):
        mask = next(iter(simhash.keys(mask, 2)))
        assert 64 - mask.bit_count() == free


def test_nothing_and_the_given_documents(spark):
    assert simhash.simhash_clusters(empty(spark)).count() == 0
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in queries.op11_simhash(spark, sf).collect()) == expected(rows)
