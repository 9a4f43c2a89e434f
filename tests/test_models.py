"""Model calls that fail: only their own rows are touched."""

import hashlib

import pytest
from pyspark.sql import functions as F

from brindle.functions import models


def unlucky(share):
    """An embedder that fails by the text's hash, and the first time for some others."""
    seen = set()

    def call(texts):
        for t in texts:
            h = int(hashlib.md5(t.encode()).hexdigest(), 16)
            if h % 100 < share:
                raise RuntimeError("cannot embed")
            if h % 100 > 95 and t not in seen:
                seen.add(t)
                raise TimeoutError("slow")
        return [[float(len(t)), 1.0] for t in texts]

    return call


def test_other_rows_are_untouched(spark):
    texts = [f"text {i} " + "x" * (i % 7) for i in range(200)] + [None, " ", "text 0 "]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(3)
    caller = models.Caller(unlucky(10), 2, batch=16, concurrency=4, retries=1, pause=0)
    rows = {r.id: r.e for r in d.select("id", models.embedded(F.col("t"), caller).alias("e")).collect()}
    for i, t in enumerate(texts):
        bad = t is not None and t.strip() and int(hashlib.md5(t.encode()).hexdigest(), 16) % 100 < 10
        if t is None or not t.strip():
            assert tuple(rows[i]) == ([0.0, 0.0], None, 0)
        elif bad:
            assert rows[i].vector == [0.0, 0.0] and rows[i].error == "RuntimeError: cannot embed"
        else:
            assert rows[i].vector == [float(len(t)), 1.0] and rows[i].error is None
    assert any(r.error for r in rows.values()) and any(r.tries > 1 for r in rows.values() if not r.error)


def test_wrong_lengths_rates_and_arguments():
    import time

    assert models.Caller(lambda t: [[1.0]] * len(t), 2, retries=0).calls(["a"])[0][1].startswith("ValueError")
    assert models.Caller(lambda t: [], 2, retries=0).calls([]) == []
    began = time.monotonic()
    models.Caller(lambda t: [[1.0]] * len(t), 1, batch=1, rate=20).calls([str(i) for i in range(9)])
    assert time.monotonic() - began >= 0.35
    running, most = [0], [0]

    def slow(t):
        running[0] += 1
        most[0] = max(most[0], running[0])
        time.sleep(0.02)
        running[0] -= 1
        return [[1.0]] * len(t)

    models.Caller(slow, 1, batch=1, concurrency=3).calls([str(i) for i in range(20)])
    assert 1 < most[0] <= 3
    with pytest.raises(ValueError):
        models.Caller(slow, 0)


def test_models_rotate_and_recover():
    now, broken, asked = [0.0], {"a"}, []

    def model(name):
        def call(texts):
            asked.append(name)
            if name in broken:
                raise ConnectionError(name)
            return [[1.0]] * len(texts)

        return call

    r = models.Rotation({n: model(n) for n in "abc"}, recover=10, clock=lambda: now[0])
    assert r(["x"]) == [[1.0]] and asked == ["a", "b"] and r.healthy() == ["b", "c"]
    r(["x"])
    assert asked[2:] == ["b"]
    now[0] = 11  # tried again, fails again, and is left alone twice as long
    r(["x"])
    assert asked[3:] == ["a", "b"]
    now[0] = 25
    broken.clear()
    r(["x"])
    assert asked[5:] == ["b"] and r.healthy() == ["b", "c"]
    now[0] = 32
    r(["x"])
    assert asked[6:] == ["a"] and r.healthy() == ["a", "b", "c"]
    broken |= {"a", "b", "c"}
    with pytest.raises(ConnectionError):
        models.Rotation({n: model(n) for n in "abc"}, clock=lambda: now[0])(["x"])
    with pytest.raises(ValueError):
        models.Rotation({})
