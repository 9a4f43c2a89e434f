"""Communities by modularity: planted ones are found, no merge is left that gains, levels nest."""

import itertools
import random

import pytest

from brindle.operators import modularity


def plain(edges, at, r):
    m = sum(w for *_, w in edges)
    inside = sum(w for u, v, w in edges if at[u] == at[v])
    k = {}
    for u, v, w in edges:
        k[at[u]] = k.get(at[u], 0) + w
        k[at[v]] = k.get(at[v], 0) + w
    return inside / m - r * sum((x / (2 * m)) ** 2 for x in k.values())


def cliques(n=8, size=6):
    """Cliques in a ring, each tied to the next by one edge."""
    edges = [(c * size + a, c * size + b, 1.0) for c in range(n) for a, b in itertools.combinations(range(size), 2)]
    return edges + [(c * size, (c + 1) % n * size + 1, 1.0) for c in range(n)]


def planted(groups=5, size=16, seed=3):
    rng = random.Random(seed)
    return [(u, v, rng.choice([0.5, 1.0])) for u, v in itertools.combinations(range(groups * size), 2) if rng.random() < (0.5 if u // size == v // size else 0.03)]


def star(n=40):
    return [(0, i, 1.0) for i in range(1, n)] + [(1, 2, 1.0)]


def run(spark, edges, **by):
    d, report = modularity.communities(spark.createDataFrame(edges, "src bigint, dst bigint, weight double"), **by)
    rows = d.collect()
    assert len({(r.level, r.id) for r in rows}) == len(rows)
    levels = sorted({r.level for r in rows})
    return [{r.id: r.community_id for r in rows if r.level == n} for n in levels], {(r.level, r.community_id): r.parent_id for r in rows}, rows, report


@pytest.mark.parametrize(("edges", "resolutions"), [(planted(4, 12), (1.2, 0.8)), (star(), (1.0,))])
def test_levels(spark, edges, resolutions):
    found, parents, rows, report = run(spark, edges, resolutions=resolutions)
    ids = {x for u, v, _ in edges for x in (u, v)}
    for level, at in enumerate(found):
        assert set(at) == ids and all(at[c] == c and c == min(i for i in at if at[i] == c) for c in set(at.values()))
        steps = [r["modularity"] for r in report if r["level"] == level]
        assert all(b >= a - 1e-9 for a, b in zip(steps, steps[1:], strict=False))
        assert steps[-1] == pytest.approx(plain(edges, at, resolutions[level]))
    # each lies inside its parent
    top = len(resolutions) - 1
    assert all(parents[n, found[n][i]] == found[n + 1][i] for n in range(top) for i in ids) and all(r.parent_id is None for r in rows if r.level == top)


def test_planted_communities_are_found(spark):
    edges = cliques()
    (at,), _, _, report = run(spark, edges, resolutions=(1.0,))
    assert at == {i: i // 6 * 6 for i in range(48)}
    edges = planted(4, 12)
    (at,), _, _, report = run(spark, edges, resolutions=(1.0,))
    want = {i: i // 12 for i in range(48)}
    assert report[-1]["modularity"] >= plain(edges, want, 1.0) - 0.02
    q = plain(edges, at, 1.0)
    for a, b in itertools.combinations(sorted(set(at.values())), 2):  # no two communities gain by merging
        assert plain(edges, {i: a if c == b else c for i, c in at.items()}, 1.0) <= q + 1e-9


def test_odd_edges(spark):
    d = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 2.0), ("a", "a", 1.0), ("c", None, 1.0), ("d", "e", -1.0), ("f", "g", None), ("h", "h", 1.0), ("x", "y", 1.0)], "src string, dst string, weight double")
    rows = {(r.level, r.id): r.community_id for r in modularity.communities(d, (1.0,))[0].collect()}
    assert rows == {(0, "a"): "a", (0, "b"): "a", (0, "h"): "h", (0, "x"): "x", (0, "y"): "x"}
    assert modularity.communities(d.where("false"))[0].count() == 0
    with pytest.raises(ValueError):
        modularity.communities(d, (0.8, 1.2))
