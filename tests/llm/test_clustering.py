"""Clusters against a plain loop over all vectors and centroids."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from brindle.llm import clustering, queries
from tests.oracle import both

KIND = "vec_id bigint, embedding array<float>, cluster int, distance double, v string"


def plain_clusters(rows, k=40, rounds=5, width=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v):
            kept.append((i, [math.floor(256 * float(np.float32(c))) for c in v]))
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = [v for _, v in start]
    if not c:
        return Counter((i, None, None, None, None, None) for i, _ in kept)
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        best = [min((dist(v, y), n) for n, y in enumerate(c)) for _, v in kept]
        if turn < rounds:
            for n in range(len(c)):
                mine = [v for (_, v), (_, m) in zip(kept, best, strict=True) if m == n]
                if mine:
                    c[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    inertia = Counter()
    for s, n in best:
        inertia[n] += s
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return Counter((i, n, s, inertia[n], sum(inertia.values()), sha[n]) for (i, _), (s, n) in zip(kept, best, strict=True))


def fixture(n=260, grid=False):
    """Blobs, or few values on a coarse grid so that distances tie; with unusable, repeated and unnamed vectors."""
    rng = random.Random(7)
    hubs = [[rng.uniform(-0.4, 0.4) for _ in range(64)] for _ in range(9)]
    rows = []
    for i in range(n):
        h = rng.choice(hubs)
        rows.append((i, [rng.choice([-0.5, 0.0, 0.25]) if grid and d < 3 else 0.1 if grid else x + rng.gauss(0, 0.05) for d, x in enumerate(h)]))
    bad = [(900, None), (901, []), (902, [0.1] * 63), (903, [0.1] * 65), (904, [None] + [0.1] * 63), (905, [float("nan")] + [0.1] * 63), (906, [float("-inf")] + [0.1] * 63)]
    return rows + bad + [rows[0], rows[0], (5, rows[9][1]), (None, rows[3][1])]


def run(spark, rows, **by):
    d = spark.createDataFrame([(*r, 1, 0.5, "x") for r in rows], KIND).repartition(3)
    return Counter(tuple(r) for r in clustering.cluster(d, **by).collect())


@pytest.mark.parametrize("rows", [fixture(), fixture(grid=True), fixture(12), fixture(12)[12:19], [(None, [0.1] * 64)]])
def test_clusters_match_a_plain_loop(spark, rows):
    assert run(spark, rows) == plain_clusters(rows)


def test_no_vectors(spark):
    assert run(spark, []) == Counter()


def test_other_parameters(spark):
    rows = [(i, [float(i % 7), float(i * i % 11), 0.5]) for i in range(50)]
    assert run(spark, rows, k=4, rounds=2, width=3) == plain_clusters(rows, 4, 2, 3)


def test_components_too_large_for_exact_distances_stop_the_job(spark):
    with pytest.raises(Exception, match="beyond"):
        run(spark, [(1, [1e9] * 64)])


def test_partial_distances_abandon_no_nearest_centroid():
    """Ties and near ties in the last dimensions, every order of dimensions."""
    rng = np.random.default_rng(2)
    for _ in range(30):
        x, c = rng.integers(-3, 4, (200, 64)), rng.integers(-3, 4, (30, 64))
        c[7], c[20] = c[3], c[11]
        whole = ((x[:, None, :] - c[None, :, :]) ** 2).sum(2)
        number, best = clustering.nearest(x, c, rng.permutation(64))
        assert (number == whole.argmin(1)).all() and (best == whole.min(1)).all()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_the_given_vectors_match_sql(spark, sf):
    ours, theirs = both(spark, queries.op12_clusters, queries.ORACLES["op12_clusters"], f"/root/testdata/{sf}")
    assert ours == theirs
