"""Connected components by alternating large-star and small-star steps, on Spark tables alone."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import Written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step: every neighbour on one side of ``u`` is tied to the least of u and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    side = both if large else both.where("v < u")
    least = side.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = side.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else side.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges of one task: every id tied to the least of its component."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    ids = [x for x in root if find(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(map(find, ids), pa.int64())], names=["u", "v"])


def connected_components(edges: DataFrame, work: Written, most: int = 60, few: int = 0) -> DataFrame:
    """``id, component`` for every id of the edges ``a, b``; a component is its smallest id.

    Up to ``few`` distinct edges are tied in one task, as rounds over so few cost
    more than they do; the result is the same.

    A hub's edges are narrow rows whose join Spark splits at run time. Each
    round is written to the shared folder and the round before is deleted.
    """
    now = work.table(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if few and now.count() <= few:
        tied = work.table(now.coalesce(1).mapInArrow(_tied, "u bigint, v bigint"), "edges")
        work.drop(now)
    else:
        tied = _settled(now, work, most)
    return tied.select(F.col("u").alias("id"), F.col("v").alias("component")).union(tied.select("v", "v").distinct())


def _settled(now: DataFrame, work: Written, most: int) -> DataFrame:
    """Rounds of both steps until no edge changes."""
    state = None
    for _ in range(most):
        after = work.table(_stars(_stars(now, True), False), "edges")
        work.drop(now)
        now, before = after, state
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now
    raise RuntimeError("components did not settle")
