"""Near-duplicates by SimHash fingerprints, candidates cut down by the pigeonring filter.

Two fingerprints link at ``most`` or fewer differing bits. The bits lie on a
ring of ``m = most + 2`` segments with differences d_0 ... d_(m-1). If their sum
is at most ``most``, some start i has every chain within its proportional
budget: d_i + ... + d_(i+l-1) <= l * most / m for all l, rounded down. The first
budget is 0 and the chain's second equal segment lies at most ``most / 2 + 1``
places on, so (i, i+j) are the pairs of segments by which candidates meet: with
two bits of difference six keys of 32 bits each. Only pairs whose chain keeps
its budgets reach the full Hamming check.

Equal fingerprints are one from the start, so copies cost one row. A bucket of
two is a pair; one of at most ``LIMIT`` members is compared in one task, which
emits a forest and never all pairs. A larger bucket is a smaller problem of the
same kind: its free bits form a ring of their own and its members meet again by
two segments of that. Each turn halves the free bits (64, 32, 16, 8), so
no bucket stays large: eight free bits have 256 values.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import Written, small_batches, text_of
from brindle.llm.components import connected_components

LIMIT = 1024
WIDTH = 64
_BLOCK = 1 << 20
_SPACES = frozenset(b" \t\n\x0b\x0c\r")


def _words(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, about a megabyte at a time; no word is cut."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + _BLOCK)
        while end < len(raw) and raw[end] not in _SPACES:
            end += 1
        yield raw[at:end].split()
        at = end


def fingerprint(text: str, size: int = 3, seed: int = 42) -> int:
    """Bit b is 1 if it is set in over half of the shingles' XXH64 hashes, repeats included; 0 without words."""
    ones, n, tail = np.zeros(WIDTH, np.int64), 0, []
    for words in _words(text.encode("utf-8", "replace").lower()):
        tail += words
        grams = [b" ".join(g) for g in zip(*(tail[i:] for i in range(size)), strict=False)]
        tail = tail[len(grams) :]
        if grams:
            h = np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), np.dtype("<u8"), len(grams))
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            n += len(grams)
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(tail), seed) if tail else 0
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def signed(x: int) -> int:
    return x - (1 << WIDTH) if x >> (WIDTH - 1) else x


@lru_cache(4096)
def segments(mask: int, most: int) -> tuple[int, ...]:
    """The bits that ``mask`` leaves free, cut into ``most + 2`` consecutive segments of nearly equal length."""
    free, m = [b for b in range(WIDTH) if not mask >> b & 1], most + 2
    return tuple(sum(1 << b for b in free[len(free) * i // m : len(free) * (i + 1) // m]) for i in range(m))


@lru_cache(4096)
def keys(mask: int, most: int) -> dict[int, tuple[int, ...]]:
    """The masks by which candidates meet inside a bucket of ``mask``, each with the starts of its chains."""
    ring, m, out = segments(mask, most), most + 2, {}
    for i in range(m):
        for j in range(1, most // 2 + 2):
            out.setdefault(mask | ring[i] | ring[(i + j) % m], set()).add(i)
    return {k: tuple(sorted(v)) for k, v in sorted(out.items())}


def chained(diff: np.ndarray, mask: int, key: int, most: int) -> np.ndarray:
    """Places of the differences that some chain of the bucket ``key`` inside ``mask`` lets through."""
    ring, m = segments(mask, most), most + 2
    found = np.zeros(len(diff), bool)
    for start in keys(mask, most)[key]:
        left, bits = np.flatnonzero(~found), 0
        for length in range(1, m):
            bits |= ring[(start + length - 1) % m]
            left = left[np.bitwise_count(diff[left] & np.uint64(bits)) <= length * most // m]
        found[left] = True
    return np.flatnonzero(found)


def linked(diff: np.ndarray, mask: int, key: int, most: int) -> np.ndarray:
    """Places of the pairs that pass the chain filter and then the check of all bits."""
    near = chained(diff, mask, key, most)
    return near[np.bitwise_count(diff[near]) <= most]


def forest(prints: np.ndarray, mask: int, key: int, most: int) -> list[tuple[int, int]]:
    """Links that tie together what one bucket links, one fewer than the members of each part."""
    part, out = np.arange(len(prints)), []
    for k in range(len(prints) - 1):
        later = k + 1 + np.flatnonzero(part[k + 1 :] != part[k])
        for q in later[linked(prints[later] ^ prints[k], mask, key, most)]:
            if part[q] != part[k]:
                out.append((k, int(q)))
                part[part == part[q]] = part[k]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """``doc_id, print``: the fingerprint of every row as a signed long."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [signed(fingerprint(t.as_py(), size)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=["doc_id", "print"])

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), text_of(docs, text_col).alias("text")).mapInArrow(work, "doc_id bigint, print bigint")


def _unsigned(column) -> np.ndarray:
    return column.to_numpy().astype(np.int64).view(np.uint64)


def links(prints: DataFrame, work: Written, most: int = 2, limit: int = LIMIT) -> DataFrame:
    """``a, b``: links between the distinct fingerprints of ``print`` that tie together all that lie within ``most`` bits, over any chain."""
    full = (1 << WIDTH) - 1

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ring, mask, low, high = (_unsigned(batch.column(c)) for c in ("ring", "mask", "low", "high"))
            good = np.zeros(len(low), bool)
            for r, k in {(int(r), int(k)) for r, k in zip(ring, mask, strict=True)}:
                at = np.flatnonzero((ring == r) & (mask == k))
                good[at[linked(low[at] ^ high[at], r, k, most)]] = True
            yield pa.RecordBatch.from_arrays([batch.column("low").filter(pa.array(good)), batch.column("high").filter(pa.array(good))], names=["a", "b"])

    def group(table: pa.Table) -> pa.Table:
        x = np.sort(_unsigned(table.column("print")))
        ring, mask = (int(table.column(c)[0].as_py()) & full for c in ("ring", "mask"))
        found = np.array(forest(x, ring, mask, most), np.int64).reshape(-1, 2)
        x = x.view(np.int64)
        return pa.table({"a": x[found[:, 0]], "b": x[found[:, 1]]})

    open_, rings, out = prints.select("print", F.lit(0).cast("bigint").alias("mask")), [0], None
    big = (F.col("members") > limit) & (F.bit_count("mask") <= WIDTH - most - 2)
    while rings:
        rows = [(signed(r), [signed(k) for k in keys(r, most)]) for r in rings]
        turn = prints.sparkSession.createDataFrame(rows, "ring bigint, masks array<bigint>")  # at most 1, 6, 36, 216 rows for two bits
        placed = open_.join(F.broadcast(turn), open_.mask == turn.ring).select("print", "ring", F.explode("masks").alias("mask"))
        placed = placed.withColumn("key", F.col("print").bitwiseAND(F.col("mask")))
        buckets = placed.groupBy("ring", "mask", "key").agg(F.count(F.lit(1)).alias("members"), F.min("print").alias("low"), F.max("print").alias("high")).where("members > 1")
        buckets = work.table(buckets, "buckets")
        here = placed.join(buckets.where("members > 2").select("ring", "mask", "key", "members"), ["ring", "mask", "key"])
        twos = buckets.where("members = 2").select("ring", "mask", "low", "high").mapInArrow(pairs, "a bigint, b bigint")
        small = here.where(~big).groupBy("ring", "mask", "key").applyInArrow(group, "a bigint, b bigint")
        found = work.table(twos.union(small).distinct(), "links")
        out = found if out is None else out.union(found)
        rings = sorted(r.mask & full for r in buckets.where((F.col("members") > 2) & big).select("mask").distinct().collect())
        if rings:
            open_ = work.table(here.where(big).select("print", "mask").distinct(), "open")
        work.drop(buckets)
    return out


def simhash_clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, most: int = 2, limit: int = LIMIT, few: int = 1 << 18) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id``.

    Fingerprints of ``size``-word shingles link at ``most`` or fewer differing
    bits; ``component_id`` is the smallest id reachable over links, the row's own
    included. Texts of fewer words are one shingle; null, empty and blank texts
    have fingerprint 0 and link like any other. Rows that repeat an id are rows
    of their own. A row without an id is linked too but names no component: its
    ``component_id`` is the smallest id that it reaches, null if there is none.
    An empty table gives an empty result; other columns are ignored. ``limit`` and
    ``few`` bear on the plan only.
    """
    work = Written(docs.sparkSession, "simhash")
    signed_ = work.table(fingerprints(docs, id_col, text_col, size), "fingerprints")
    firsts = work.table(signed_.groupBy("print").agg(F.min("doc_id").alias("low")), "firsts")
    parts = connected_components(links(firsts, work, most, limit), work, few=few)
    named = firsts.join(parts, F.col("print") == F.col("id"), "left").select("print", "low", F.coalesce("component", "print").alias("component"))
    named = work.table(named.join(named.groupBy("component").agg(F.min("low").alias("component_id")), "component").select("print", "component_id"), "components")
    work.drop(firsts)
    return signed_.join(named, "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
