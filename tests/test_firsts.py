"""The first rows of each key: rows are cut before they are sorted, and the rows are those of a plain sort."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.operators import firsts, rag


def wanted(rows, most):
    order = lambda p: (p is not None, tuple((x is not None, x or "") for x in p or ()))
    out = {}
    for k, p in sorted(rows, key=lambda r: order(r[1])):
        out.setdefault(k, []).append(p)
    return sorted(((k, i + 1, p) for k, ps in out.items() for i, p in enumerate(ps[:most])), key=str)


def test_the_rows_are_those_of_a_sort(spark):
    rng = random.Random(1)
    text = lambda: rng.choice([None, "", "a", "é", "Z", "\U0001f600"]) if rng.random() < 0.05 else f"{rng.randrange(10**6)}"
    rows = list({(rng.choice([None, "x", "y", "z"]), None if rng.random() < 0.001 else (text(), text())) for _ in range(3000)})
    d = spark.createDataFrame(rows, "query_id string, position struct<src: string, dst: string>").repartition(3)
    got = [(r.query_id, r._r, tuple(r.position) if r.position is not None else None) for r in firsts.first_of(d, "query_id", "position", 7).collect()]
    assert sorted(got, key=str) == wanted(rows, 7)


def test_kinds_of_another_order_are_not_cut(spark):
    d = spark.createDataFrame([(1, float("nan")), (1, 2.0), (1, None)], "query_id int, position double")
    assert [(r._r, r.position) for r in firsts.first_of(d, "query_id", "position", 2).orderBy("_r").collect()] == [(1, None), (2, 2.0)]


@pytest.mark.parametrize(("keys", "held"), [(3, 64), (500, 64), (1, 10)])
def test_tasks_hold_few_rows(monkeypatch, keys, held):
    monkeypatch.setattr(firsts, "HELD", held)
    rng = random.Random(2)
    rows = [(rng.randrange(keys), True, rng.choice([None, rng.randrange(1000)]), rng.randrange(10**9)) for _ in range(4000)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("k", "f", "a", "b"), r, strict=True)) for r in rows[i : i + 20]], pa.schema([("k", pa.int32()), ("f", pa.bool_()), ("a", pa.int32()), ("b", pa.int64())])) for i in range(0, 4000, 20)]
    out = [r for b in firsts._cut_batches(iter(batches), "k", ["f", "a", "b"], 5) for r in b.to_pylist()]
    order = lambda r: (r["a"] is not None, r["a"] or 0, r["b"])
    first = lambda rs: sorted([x for k in range(keys) for x in sorted((r for r in rs if r["k"] == k), key=order)[:5]], key=str)
    assert first(out) == first([dict(zip(("k", "f", "a", "b"), r, strict=True)) for r in rows])
    assert keys > held or len(out) <= 5 * keys


@pytest.mark.parametrize("edges", [False, True])
def test_preambles_cut_rows_before_the_sort(spark, edges):
    n = spark.range(1000).select((F.col("id") % 3).cast("string").alias("query_id"), F.col("id").alias("position"), F.col("id").cast("string").alias("name"), F.lit("t").alias("type"))
    e = n.select("query_id", F.struct("position", "name").alias("position"), F.col("name").alias("source"), F.lit("r").alias("relation_type"), F.col("name").alias("target"))
    d = rag.graph_preamble(n, e) if edges else rag.entity_preamble(n.select("query_id", "position", "name", F.col("type").alias("entity_type"), F.lit(None).cast("string").alias("description")))
    assert "MapInArrow" in d._jdf.queryExecution().executedPlan().toString()
    assert d.count() == 3 and "- 27" in d.orderBy("query_id").first().text.replace("**", "")
