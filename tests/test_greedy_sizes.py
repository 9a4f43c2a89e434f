"""The fold over hits of very different and of nearly equal sizes, against a plain one."""

import random

from brindle.operators import rag


def test_jaccard_dedup_keeps_what_a_plain_fold_keeps(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    sets = [base[: rng.choice([0, 1, 10, 18, 19, 20, 54, 57, 60])] + rng.choices(["x", "y"], k=rng.choice([0, 0, 1])) for _ in range(40)]
    hits = [(q, r, i, sets[i]) for q in range(6) for r, i in enumerate(rng.sample(range(40), 20), 1)]
    want = set()
    for q in range(6):
        kept = []
        for _, r, i, w in (h for h in hits if h[0] == q):
            w = set(w)
            if not any(w and k and len(w & k) > 0.9 * len(w | k) for k in kept):
                kept.append(w)
                want.add((q, r, i))
    d = spark.createDataFrame(hits, "query_id int, rank int, id int, w array<string>")
    assert 6 < len(want) < len(hits)
    assert {tuple(r) for r in rag.greedy_dedup(d).collect()} == want


def test_words_go_only_with_hits_that_may_be_close(spark, monkeypatch):
    rng, folded = random.Random(5), []
    far = [[f"a{i}-{k}" for k in range(30)] for i in range(40)]
    base = [f"w{i}" for i in range(60)]
    near = [rng.sample(base, rng.choice([57, 58, 60])) + rng.choices(["x", "y"], k=rng.choice([0, 1])) for _ in range(8)]
    few = [["one"], ["one"], ["one", "two"], ["two", "one", "two"], [], []]
    sets = far + near + few
    hits = [(q, r, i) for q in range(9) for r, i in enumerate(rng.sample(range(len(sets)), 20), 1)]
    want = set()
    for q in range(9):
        kept = []
        for _, r, i in (h for h in hits if h[0] == q):
            w = set(sets[i])
            if not any(w and k and len(w & k) > 0.9 * len(w | k) for k in kept):
                kept.append(w)
                want.add((q, r, i))
    fold = rag.greedy_dedup
    monkeypatch.setattr(rag, "greedy_dedup", lambda h, least: folded.extend(h.select("id").collect()) or fold(h, least))
    got = rag.dedup_hits(spark.createDataFrame(hits, "query_id int, rank int, id int"), spark.createDataFrame(list(enumerate(sets)), "id int, w array<string>"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) < len(hits)
    assert folded and all(r.id >= 40 for r in folded)
