"""Near-duplicates by circulant MinHash, banding and exact verification.

A document's set is hashed to 64 bits a shingle, of which 32 name its place in
the universe. The first permutation spreads the places; coordinate k of the
signature is the least value of the second permutation shifted by k places, so
two permutations give all coordinates. Both are arithmetic (odd multiplications
and folded shifts are one-to-one), so the universe has 2**32 places and unlike
sets of a million shingles still agree nowhere. Equal sets are one text from
here on. Texts that agree in a band are candidates; nothing decides but the
exact comparison of full sets:

1. in every bucket the maximum spanning forest of the estimated similarities is
   proposed and verified, which ties a group together with about as many
   comparisons as it has members;
2. then, in every bucket that still holds several components, every pair across
   components whose estimate reaches ``0.8 - 4.5`` standard errors is verified,
   each pair in the first band it shares. No link between components is lost,
   and no pair inside one is spent.

A bucket is cut into blocks of at most ``BLOCK`` members and about ``WEIGHT``
shingles. In step 1 a block meets itself, and one member of each block the
others'; so a bucket of one component costs as many rows as it has members. In
step 2 pairs of blocks meet, and no task holds more than two. Components come
from ``connected_components``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import Written, small_batches, text_of
from brindle.llm.components import connected_components

BANDS, ROWS, BLOCK, WEIGHT = 32, 4, 2048, 2_000_000
WIDTH = BANDS * ROWS
#: Partners of one text that are verified in one group, and their shingles.
PARTNERS, PARTNERS_WEIGHT = 128, 1_000_000
#: Estimates of a pair at the limit fall below this once in about 300,000 pairs.
ERRORS = 4.5
#: Shift, odd factor, shift, odd factor, shift of the two permutations of 32-bit places.
FIRST, SECOND = (15, 0x2C1B3C6D, 12, 0x297A2D39, 15), (16, 0x7FEB352D, 15, 0x846CA68B, 16)
_STEP = 512


def shingle_set(text: str, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; the whole sequence is one if there are fewer words."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, grams), np.uint64))


def permuted(x: np.ndarray, by: tuple[int, int, int, int, int], spare: np.ndarray) -> np.ndarray:
    """A one-to-one map of 32-bit integers, in place."""
    for k, shift in enumerate(by[::2]):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        if k < 2:
            np.multiply(x, np.uint32(by[2 * k + 1]), out=x)
    return x


@lru_cache(1)
def _buffers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.arange(WIDTH, dtype=np.uint32), np.empty((_STEP, WIDTH), np.uint32), np.empty((_STEP, WIDTH), np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """All coordinates: least values of the second permutation at the first one's places, shifted around the circle."""
    shifts, values, spare = _buffers()
    places = shingles.astype(np.uint32)
    permuted(places, FIRST, np.empty_like(places))
    out = np.full(WIDTH, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(places), _STEP):
        some = places[i : i + _STEP, None]
        x = values[: len(some)]
        np.add(some, shifts, out=x)
        np.minimum(out, permuted(x, SECOND, spare[: len(some)]).min(0), out=out)
    return out


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on full sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _signatures(docs: DataFrame, size: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, bands, sketch = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, size)
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                c = signature(s) if len(s) else np.empty(0, np.uint32)
                bands.append([xxhash.xxh3_64_intdigest(c[i : i + ROWS].tobytes(), i) - (1 << 63) for i in range(0, len(c), ROWS)])
                sketch.append(c.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], names=["doc_id", "n_shingles", "digest", "bands", "sketch"]
            )

    return docs.mapInArrow(work, "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>, sketch binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), -1)


def _near(x: np.ndarray, n: np.ndarray, k: int, cut: float, percent: int) -> np.ndarray:
    """Estimated similarity of member k to all, 0 where sizes or the estimate rule a link out."""
    e = (x == x[k]).mean(1)
    e[(e < cut) | (100 * np.minimum(n, n[k]) < percent * np.maximum(n, n[k]))] = 0
    e[k] = 0
    return e


def forest(x: np.ndarray, n: np.ndarray, cut: float, percent: int) -> list[tuple[int, int]]:
    """A maximum spanning forest of the members' estimates, by Prim's steps: memory grows with the members, not with the pairs."""
    m, out = len(x), []
    best, origin, left = np.zeros(m), np.zeros(m, np.int64), np.ones(m, bool)
    for _ in range(m):
        k = int(np.where(left, best, -1).argmax())
        if best[k] > 0:
            out.append((int(origin[k]), k))
        left[k] = False
        e = _near(x, n, k, cut, percent)
        nearer = left & (e > best)
        best[nearer], origin[nearer] = e[nearer], k
    return out


def _verify(pairs: DataFrame, pool: DataFrame, sizes: DataFrame, size: int, percent: int) -> DataFrame:
    """Of the pairs ``a, b`` those that are linked. A text meets about ``PARTNERS`` of its partners in one group, fewer if they are long."""
    load = pairs.join(sizes, F.col("b") == F.col("id")).groupBy("a").agg(F.ceil(F.greatest(F.count(F.lit(1)) / PARTNERS, F.sum("n") / PARTNERS_WEIGHT)).alias("groups"))
    salted = pairs.join(load, "a").select(F.col("a").alias("owner"), F.pmod(F.xxhash64("b"), F.col("groups")).alias("salt"), F.col("b").alias("id"))
    rows = salted.union(salted.select("owner", "salt", F.col("owner").alias("id")).distinct()).join(pool, "id").select("owner", "salt", "id", "text")

    def work(table: pa.Table) -> pa.Table:
        owner = table.column("owner")[0].as_py()
        ids, texts = table.column("id").to_pylist(), table.column("text").to_pylist()
        own = shingle_set(texts[ids.index(owner)], size)
        b = [i for i, t in zip(ids, texts, strict=True) if i != owner and linked(own, shingle_set(t, size), percent)]
        return pa.table({"a": pa.array([owner] * len(b), pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("owner", "salt").applyInArrow(work, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Two documents are linked when 100 * intersection >= percent * union of their
    shingle sets; ``component_id`` is the smallest id reachable over links.
    Null, empty and blank texts have no shingle, are linked with nothing and
    stay. Rows that repeat an id count as one document each and are linked if
    their texts are; with a null id a row is its own component and stays. An
    empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    work = Written(spark, "minhash")
    share = percent / 100
    cut = share - ERRORS * (share * (1 - share) / WIDTH) ** 0.5
    docs = docs.select(docs[id_col].cast("bigint").alias("doc_id"), text_of(docs, text_col).alias("text"))
    signed = work.table(_signatures(docs, size), "signatures")
    some = signed.where("digest is not null and doc_id is not null")
    firsts = some.groupBy("digest", "n_shingles").agg(F.min("doc_id").alias("rep"))
    sets = work.table(some.join(firsts.select("digest", "rep"), "digest").where("doc_id = rep").select("rep", "n_shingles", "bands", "sketch").dropDuplicates(["rep"]), "sets")

    places = sets.select(F.col("rep").alias("id"), "n_shingles", F.posexplode("bands").alias("band", "key"))
    buckets = places.groupBy("band", "key").agg(F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("weight"), F.min("id").alias("low"), F.max("id").alias("high")).where("members > 1")
    buckets = work.table(buckets, "buckets")
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("weight") / WEIGHT)).cast("bigint")
    members = work.table(places.drop("n_shingles").join(buckets.select("band", "key", "members", blocks.alias("blocks")), ["band", "key"]), "members")
    sketches = sets.select(F.col("rep").alias("id"), F.col("n_shingles").alias("n"), "sketch")
    candidates = members.select("id").distinct()
    pool = work.table(docs.join(candidates, docs.doc_id == candidates.id, "left_semi").select(F.col("doc_id").alias("id"), "text").dropDuplicates(["id"]), "pool")

    def estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                good = (_matrix(batch.column(4)) == _matrix(batch.column(5))).mean(1) >= cut
                good &= 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], names=["a", "b"])

    twos = buckets.where("members = 2").select(F.col("low").alias("a"), F.col("high").alias("b")).distinct()
    twos = twos.join(sketches.toDF("a", "na", "sa"), "a").join(sketches.toDF("b", "nb", "sb"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(estimated, "a bigint, b bigint")

    mine = members.where("members > 2").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")))
    # a block meets itself; its first member meets those of other blocks
    first = mine.where("blocks > 1").groupBy("band", "key", "mine").agg(F.min("id").alias("id")).select("band", "key", "id", "mine", *(-1 - F.floor(F.col("mine") / BLOCK).cast("bigint") for _ in "ij"))
    met = mine.select("band", "key", "id", "mine", F.col("mine").alias("i"), F.col("mine").alias("j")).union(first)

    def proposed(table: pa.Table) -> pa.Table:
        ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
        at = np.argsort(ids)
        x, mine = _matrix(table.column("sketch").combine_chunks())[at], table.column("mine").to_numpy()[at]
        # a forest's path has no worse estimate than an edge, so an edge that an earlier band or the block itself also sees is left to them
        pairs = [p for p in forest(x, n[at], cut, percent) if len(_met_here(table, x, mine, p[0], np.array([p[1]])))]
        a, b = (np.array([p[s] for p in pairs], np.int64) for s in (0, 1))
        ids = ids[at]
        return pa.table({"a": np.minimum(ids[a], ids[b]), "b": np.maximum(ids[a], ids[b])})

    grouped = met.join(sketches, "id").groupBy("band", "key", "i", "j").applyInArrow(proposed, "a bigint, b bigint")
    links = work.table(_verify(work.table(twos.union(grouped).distinct(), "proposed"), pool, sketches.select("id", "n"), size, percent), "links")
    parts = connected_components(links, work)

    # the second step: buckets of several components, block i of which meets every block j >= i
    placed = mine.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_ = placed.groupBy("band", "key").agg((F.min("component") < F.max("component")).alias("several")).where("several").drop("several")
    placed = placed.join(open_, ["band", "key"], "left_semi").withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    placed = placed.select("band", "key", "id", "mine", "component", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    open_ = placed.groupBy("band", "key", "i", "j").agg((F.min("component") < F.max("component")).alias("several")).where("several").drop("several")
    placed = placed.join(open_, ["band", "key", "i", "j"], "left_semi")

    def across(table: pa.Table) -> pa.Table:
        """The members that have a pair to verify here: other component, near enough, first band in common."""
        ids, n, part, x = table.column("id").to_numpy(), table.column("n").to_numpy(), table.column("component").to_numpy(), _matrix(table.column("sketch").combine_chunks())
        mine, need = table.column("mine").to_numpy(), np.zeros(len(ids), bool)
        for k in range(len(ids)):
            near = np.flatnonzero((_near(x, n, k, cut, percent) > 0) & (part != part[k]))
            need[k] = bool(len(_met_here(table, x, mine, k, near)))
        return table.select(["band", "key", "i", "j", "mine", "id"]).filter(pa.array(need))

    keys = "band int, key bigint, i bigint, j bigint, mine bigint"
    needed = work.table(placed.join(sketches, "id").groupBy("band", "key", "i", "j").applyInArrow(across, f"{keys}, id bigint"), "needed")

    def compared(table: pa.Table) -> pa.Table:
        ids, n, part, x = table.column("id").to_numpy(), table.column("n").to_numpy(), table.column("component").to_numpy().copy(), _matrix(table.column("sketch").combine_chunks())
        mine, sets_, out = table.column("mine").to_numpy(), [shingle_set(t, size) for t in table.column("text").to_pylist()], []
        for k in range(len(ids)):
            for q in _met_here(table, x, mine, k, np.flatnonzero(_near(x, n, k, cut, percent) > 0)):
                if part[q] != part[k] and linked(sets_[k], sets_[q], percent):
                    out.append((ids[k], ids[q]))
                    part[part == part[q]] = part[k]
        return pa.table({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})

    rows = needed.join(sketches, "id").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id")).join(pool, "id")
    more = work.table(rows.groupBy("band", "key", "i", "j").applyInArrow(compared, "a bigint, b bigint"), "links")
    if not more.isEmpty():
        parts = connected_components(links.union(more), work)
    # the result reads the signatures and the components
    for written in (sets, buckets, members, pool, needed, links, more):
        work.drop(written)

    out = signed.where("digest is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = out.union(some.select("doc_id", "digest", "n_shingles").join(firsts.select("digest", "rep"), "digest").join(parts, F.col("rep") == parts.id, "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _met_here(table: pa.Table, x: np.ndarray, mine: np.ndarray, k: int, near: np.ndarray) -> np.ndarray:
    """Of the members ``near`` those that meet k in this group and no other: this is the first band in common, and a pair of one block meets in that block's own group."""
    if not len(near):
        return near
    band, i, j = (table.column(c)[0].as_py() for c in ("band", "i", "j"))
    same = (x[near] == x[k]).reshape(len(near), BANDS, ROWS).all(2)
    return near[(same.argmax(1) == band) & ((i == j) | (mine[near] != mine[k]))]
