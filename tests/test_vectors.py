"""The vector index against the exact scan, and that against a plain loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import vectors
from brindle.plans.catalog import QUERIES


def blobs(spark, n=3000, d=16, hubs=20, seed=5):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(hubs, d))
    x = centre[rng.integers(0, hubs, n)] + rng.normal(scale=0.4, size=(n, d))
    x[n // 2 : n // 2 + n // 3] = x[n // 2]  # a third of all vectors are one
    rows = [(i, v.tolist(), i % 4) for i, v in enumerate(x)]
    odd = [(n, None, 0), (n + 1, [], 0), (n + 2, [0.0] * d, 0), (n + 3, [float("nan")] * d, 0), (None, [1.0] * d, 0), (n + 4, [None] + [1.0] * (d - 1), 0)]
    return x, spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>, label int").repartition(6)


def asked(d, by=97):
    return d.where(F.col("vec_id") % by == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def plain(x, queries, metric, limit):
    out = set()
    for q in queries:
        if metric == "cosine":
            s = np.round(x @ x[q] / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[q])), 6)
        else:
            s = np.round(1 / (1 + np.linalg.norm(x - x[q], axis=1)), 6)
        for rank, i in enumerate(sorted(range(len(x)), key=lambda i: (-s[i], i))[:limit]):
            out.add((q, i, rank + 1))
    return out


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_exact_scan_and_index(spark, metric, monkeypatch):
    """Small parts and blocks, so that every cell and every set of queries is cut."""
    monkeypatch.setattr(vectors, "PART", 500)
    monkeypatch.setattr(vectors, "BLOCK", 7)
    x, d = blobs(spark)
    want = vectors.exact(d, asked(d), 10, metric)
    assert {(r.query_id, r.id, r.rank) for r in want.collect()} == plain(x, range(0, 3000, 97), metric, 10)
    index = vectors.build(d, cells=40, metric=metric, keep=["label"])
    assert index.codes.count() == index.vectors.count() == 3000 + (metric == "l2")  # a zero vector has no cosine
    found = vectors.search(index, asked(d), 10, probes=6)
    recalls = [r.recall for r in vectors.recall(found, want).collect()]
    assert len(recalls) == 31 and np.mean(recalls) >= 0.9
    # all cells probed: what the exact scan finds, filters included
    some = vectors.search(index, asked(d), 5, probes=99, where=F.col("label") == 1, over=40)
    exact = vectors.exact(d.where("label = 1"), asked(d), 5, metric)
    key = lambda t: sorted((r.query_id, r.rank, r.score) for r in t.collect())
    assert key(some) == key(exact)


def test_index_is_read_again_and_small_tables(spark, tmp_path):
    d = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.1]), (4, [1.0, 0.0])], "vec_id bigint, embedding array<float>")
    q = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None)], "query_id string, q array<double>")
    vectors.build(d, str(tmp_path / "ix"), cells=2)
    found = vectors.search(vectors.load(spark, str(tmp_path / "ix")), q, 3, probes=2).collect()
    assert [(r.query_id, r.id, r.score) for r in sorted(found, key=lambda r: r.rank)] == [("a", 1, 1.0), ("a", 4, 1.0), ("a", 3, 0.995037)]
    assert vectors.exact(d.where("false"), q).count() == 0
    assert vectors.search(vectors.build(d.where("false")), q).count() == 0
    with pytest.raises(ValueError):
        vectors.build(d, metric="ip")


def test_recall_on_the_given_vectors(spark):
    for sf in ("sf0.01", "sf0.1"):
        r = [x.recall for x in QUERIES["ann_recall"](spark, f"/root/testdata/{sf}").collect()]
        assert len(r) == (10 if sf == "sf0.01" else 40) and np.mean(r) >= 0.9


def test_embedding_whole_turns_takes_small_batches(spark):
    """A worker holds one batch, so its memory does not grow with the table."""
    from brindle.plans import catalog
    from brindle.shared import setting

    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"):
        d = catalog.QUERIES["engine_reranked"](spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 256
        assert d.count() == 10
