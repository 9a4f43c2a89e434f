"""Centroid clustering in exact integers, with partial-distance search.

Vectors become integers once and are written. In every round each task assigns
its vectors and adds them up by centroid, so a round shuffles a row per task,
centroid and dimension, however hot a cluster is; centroids, ``k`` rows of
``width`` integers, travel with the tasks' code.

The search accumulates squared differences over a few dimensions at a time,
those of highest variance first. A centroid is abandoned for a vector once its
partial distance lies strictly above the vector's best complete one; what is
left finishes all dimensions, so ties are seen and go to the smaller number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import Written

#: Dimensions of a step, and pairs of vector and centroid of a block.
STEP, PAIRS = 8, 1 << 16
#: Integers beyond this could overflow a squared distance over 64 dimensions.
LARGEST = 1 << 27


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each vector's nearest centroid; of equal distances the smaller number."""
    x, c = x[:, order], centroids[:, order]
    rows, partial = np.arange(len(x)), np.zeros((len(x), len(c)), np.int64)
    for d in range(min(STEP, x.shape[1])):
        step = x[:, d, None] - c[None, :, d]
        partial += step * step
    first = partial.argmin(1)
    best = ((x - c[first]) ** 2).sum(1)
    v, k = np.nonzero(partial <= best[:, None])
    sums = partial[v, k]
    for d in range(STEP, x.shape[1], STEP):
        sums = sums + ((x[v, d : d + STEP] - c[k, d : d + STEP]) ** 2).sum(1)
        left = sums <= best[v]
        v, k, sums = v[left], k[left], sums[left]
    np.minimum.at(best, v, sums)
    at = sums == best[v]
    number = np.full(len(rows), len(c), np.int64)
    np.minimum.at(number, v[at], k[at])
    return number, best


def _blocks(column: pa.Array, width: int, k: int) -> Iterator[np.ndarray]:
    x, rows = _matrix(column, width), max(1, PAIRS // k)
    return (x[i : i + rows] for i in range(0, len(x), rows))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def integers(vectors: DataFrame, id_col: str, vector_col: str, width: int, scale: int) -> DataFrame:
    """``vec_id, v``: the kept vectors, each component floor(scale * x) of x as a double."""
    x = vectors[vector_col].cast("array<double>")
    usable = F.coalesce((F.size(x) == width) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    whole = F.transform("_x", lambda c: F.floor(c * F.lit(float(scale))))
    checked = F.transform(whole, lambda c: F.when(F.abs(c) <= LARGEST, c.cast("bigint")).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST} after scaling"))))
    return vectors.where(usable).select(vectors[id_col].cast("bigint").alias("vec_id"), x.alias("_x")).select("vec_id", checked.cast("array<bigint>").alias("v"))


def seeds(kept: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors of least SHA-256 of ``seed:id``; of repeated ids the least vector first. k rows reach the driver."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [r.v for r in kept.where("vec_id is not null").orderBy(key, "v").limit(k).select("v").collect()]


def spread(kept: DataFrame, width: int) -> np.ndarray:
    """Dimensions by falling variance over all vectors; the order bears on the time and never on the result."""
    variance = kept.agg(*(F.coalesce(F.var_pop(F.col("v")[d]), F.lit(0.0)) for d in range(width))).first()
    return np.array(sorted(range(width), key=lambda d: -variance[d]), np.int64)


def updated(kept: DataFrame, centroids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Each centroid as the floor of its vectors' mean in every dimension; one without vectors stays."""
    width = centroids.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for some in _blocks(batch.column(0), width, len(centroids)):
                number, _ = nearest(some, centroids, order)
                np.add.at(sums, number, some)
                counts += np.bincount(number, minlength=len(centroids))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at]), pa.array(sums[at].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    made = kept.select("v").mapInArrow(work, "cluster bigint, n bigint, sums array<bigint>")
    total = made.select("cluster", "n", F.posexplode("sums").alias("d", "s")).groupBy("cluster", "d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in total.collect():  # k * width rows
        out[r.cluster, r.d] = int(r.s) // r.n
    return out


def cluster(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, seed: int = 2
) -> DataFrame:
    """One row per kept vector: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``.

    Kept are vectors of exactly ``width`` components, none null or non-finite;
    others have no row. Centroids start as the ``k`` kept vectors with the least
    hash of seed and id, fewer if there are fewer; each round assigns all and
    moves every centroid that has vectors to the floor of their mean. Rows that
    repeat an id or a vector count as often as they come. Vectors without an id
    are assigned but start no centroid; if nothing can start one, cluster,
    distance and what follows from them are null. A component beyond 2**27 after
    scaling stops the job with an error, as distances would not fit a long. An
    empty table gives an empty result; other columns are ignored.
    """
    spark, work = vectors.sparkSession, Written(vectors.sparkSession, "clustering")
    kept = work.table(integers(vectors, id_col, vector_col, width, scale), "integers")
    start = seeds(kept, k, seed)
    if not start:
        nothing = {"cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"}
        return kept.select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in nothing.items()))
    centroids, order = np.array(start, np.int64), spread(kept, width)
    for _ in range(rounds):
        centroids = updated(kept, centroids, order)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [nearest(x, centroids, order) for x in _blocks(batch.column(1), width, len(centroids))]
            number, distance = (np.concatenate([f[s] for f in found]) if found else np.empty(0, np.int64) for s in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    assigned = work.table(kept.mapInArrow(assign, "vec_id bigint, cluster int, distance bigint"), "assigned")
    totals = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(i, totals.get(i, 0), sum(totals.values()), d) for i, d in enumerate(digests)]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    work.drop(kept)
    return assigned.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
