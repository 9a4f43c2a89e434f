"""Removal of bytes covered by long strings that start more than once anywhere in the corpus.

Positions are ranked by growing lengths, as in prefix doubling, and a position
leaves once its rank is unique; Spark groups the (rank, position) pairs of each
length. What differs from doubling over every byte is which positions take part:

1. *Sampling.* Of every window of ``length`` bytes the gram with the least hash
   is its anchor. Equal windows have equal anchors at equal places, so a window
   can repeat only where its anchor's gram does. Anchors whose gram is unique
   leave, and with them all their windows.
2. *Whole runs.* One anchor stands for a run of consecutive windows; the string
   that holds the run is ranked at once. Runs whose string repeats are done.
3. *Cores.* What is left, one run for each distinct string, is ranked by the
   strings that ``STEP`` neighbouring windows have in common; a core takes the
   bytes beside it along.
4. *Windows.* Windows whose core repeats are ranked by the pair of their core's
   rank and the bytes beside it that they hold, which is their whole ``length``.

Steps 1 and 2 leave a few per cent of the positions, 3 and 4 work at the ends of
repeated passages only. Texts are read twice after that, to cut out cores and to
cut out what is removed, and are never written. Equality of cores is equality of
128-bit hashes (of 64 bits within one gram, for runs). The result is that of
ranking every position.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import Written, small_batches, text_of

GRAM, STEP, SEGMENT = 40, 25, 1 << 18
#: Rows and bytes after which a worker hands its results on.
_ROWS, _BYTES = 20_000, 4 << 20
_BITS = np.uint64((1 << 24) - 1)
COVERED, SHOWN, OPEN = 0, 1, 2
#: Rows of one core above which its windows are ranked by Spark and not within a task.
HOT = 1_000
_RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values = np.random.default_rng(77).integers(0, 1 << 64, 256, np.uint64, endpoint=False)
    base, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    size = SEGMENT + 4096
    powers = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, b, np.uint64)))) for b in (base, inverse)]
    return values, powers[0], powers[1]


def gram_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each run of ``GRAM`` bytes; ``raw`` is one segment."""
    values, powers, inverse = _tables()
    b = np.frombuffer(raw, np.uint8)
    c = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(values[b] * powers[: len(b)], out=c[1:])
    g = (c[GRAM:] - c[:-GRAM]) * inverse[: len(b) - GRAM + 1]
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    return g ^ g >> np.uint64(32)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    rows = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    rows[: len(x)] = x
    rows = rows.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors_of(raw: bytes, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``gram hash, first window, last window, anchor`` of the runs of windows of one text, as arrays for each segment."""
    for s in range(0, len(raw) - length + 1, SEGMENT):
        part = raw[s : s + SEGMENT + length - 1]
        h = gram_hashes(part)
        least = sliding_min(h & ~_BITS | np.arange(len(h), dtype=np.uint64), length - GRAM + 1)
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        last = np.concatenate((first[1:], [len(least)])) - 1
        anchor = (least[first] & _BITS).astype(np.int64)
        yield h[anchor].view(np.int64), first + s, last + s, anchor + s


def _unpacked(at: int) -> tuple[int, int, int]:
    first = at >> 20
    return first, first + (at >> 10 & 1023), first + (at & 1023)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, rows = ["gram", "run", "doc", "sum", "at"], [[] for _ in range(5)], 0

        def packed() -> pa.RecordBatch:
            docs_, sums, counts = held[2], held[3], held[0]
            n = [len(x) for x in counts]
            ids = pa.array(docs_, pa.int64()).take(pa.array(np.repeat(np.arange(len(n)), n)))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(held[0])), pa.array(np.concatenate(held[1])), ids, pa.array(np.repeat(np.array(sums, np.int64), n)), pa.array(np.concatenate(held[4]))], names=names)

        for batch in batches:
            for k in range(batch.num_rows):
                doc, own, raw = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), batch.column(2)[k].as_py().encode("utf-8", "replace")
                for gram, first, last, anchor in anchors_of(raw, length):
                    ends = zip(first.tolist(), (last + length).tolist(), strict=True)
                    run = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in ends), np.uint64, len(first)).view(np.int64)
                    for c, x in zip(held, (gram, run, doc, own, first << 20 | (last - first) << 10 | (anchor - first)), strict=True):
                        c.append(x)
                    rows += len(first)
                if rows > _ROWS:
                    yield packed()
                    held, rows = [[] for _ in range(5)], 0
        if rows:
            yield packed()

    return docs.mapInArrow(work, "gram bigint, run bigint, doc bigint, sum bigint, at bigint")


def merged(spans: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        b = min(b, n)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        elif a < b:
            out.append((a, b))
    return out


def batch_of(rows: list, kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``raw`` less the merged spans."""
    if not spans:
        return raw
    ends = [0, *(b for _, b in spans)]
    return b"".join(raw[a:b] for a, b in zip(ends, [*(a for a, _ in spans), len(raw)], strict=True))


def _cores(raw: bytes, at: int, length: int) -> Iterator[tuple[bytes, int, int, int, bytes, bytes]]:
    """``core, start, fewest, most, before, after``: the strings common to ``STEP`` neighbouring windows of a run.

    A core's windows begin from ``fewest`` to ``most`` bytes before it; ``before``
    and ``after`` are the ``STEP - 1`` bytes beside it, filled up at a text's ends.
    """
    first, last, anchor = _unpacked(at)
    side, size = STEP - 1, length - STEP + 1
    for i in range((anchor - last) // STEP, (anchor - first) // STEP + 1):
        start = anchor - i * STEP
        core = xxhash.xxh3_128_digest(raw[start : start + size], i)
        before, after = raw[max(0, start - side) : start], raw[start + size : start + size + side]
        yield core, start, max(0, start - last), min(side, start - first), before.rjust(side, b"\0"), after.ljust(side, b"\0")


def _repeats(rows: pa.Table) -> list[tuple[int, int, int]]:
    """Windows of cores that come again, as ``row, first window, last window`` of runs, for rows that are open. Rows of one core must all be there."""
    side, n = STEP - 1, rows.num_rows
    matrix = lambda c, w: np.frombuffer(b"".join(rows.column(c).to_pylist()), np.uint8).reshape(n, w)
    core, before, after = matrix("core", 16), matrix("before", side), matrix("after", side)
    low, high, open_ = rows.column("low").to_numpy(), rows.column("high").to_numpy(), rows.column("open").to_numpy(zero_copy_only=False)
    hit = np.zeros((n, STEP), bool)
    for ahead in range(STEP):
        some = np.flatnonzero((low <= ahead) & (ahead <= high))
        key = np.ascontiguousarray(np.hstack((core[some], before[some, side - ahead :], after[some, : side - ahead])))
        _, group, count = np.unique(key.view(f"V{key.shape[1]}").ravel(), return_inverse=True, return_counts=True)
        hit[some, ahead] = (count[group] > 1) & open_[some]
    start, out = rows.column("start").to_numpy(), []
    edge = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    for (r, a), (_, b) in zip(np.argwhere(edge == 1).tolist(), np.argwhere(edge == -1).tolist(), strict=True):
        out.append((r, int(start[r]) - b + 1, int(start[r]) - a))
    return out


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Spans of repeated windows, from rows sorted by core."""
    held: list[pa.RecordBatch] = []

    def spans(rows: pa.Table) -> pa.RecordBatch:
        found = _repeats(rows)
        at = pa.array([r for r, _, _ in found], pa.int64())
        columns = [rows.column(c).combine_chunks().take(at) for c in ("doc", "sum")] + [pa.array([a for _, a, _ in found], pa.int64()), pa.array([b + length for _, _, b in found], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["doc", "sum", "a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= _ROWS:
            rows = pa.Table.from_batches(held).combine_chunks()
            last = rows.column("core")[rows.num_rows - 1]
            # the last core's rows wait for more of it
            ends = rows.num_rows
            while ends and rows.column("core")[ends - 1] == last:
                ends -= 1
            if ends:
                yield spans(rows.slice(0, ends).combine_chunks())
            held = rows.slice(ends).combine_chunks().to_batches()
    if held:
        yield spans(pa.Table.from_batches(held).combine_chunks())


def _named(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """``doc, sum, text``: a row is named by its id and its text's hash. Rows equal in both have equal spans."""
    text = text_of(docs, text_col)
    return docs.select(docs[id_col].cast("bigint").alias("doc"), F.xxhash64(text).alias("sum"), text.alias("text"), *more)


def _with(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    lists = lists.withColumnsRenamed({"doc": "_doc", "sum": "_sum"})
    return docs.join(lists, docs["doc"].eqNullSafe(F.col("_doc")) & (docs["sum"] == F.col("_sum")), how)


def repeated_spans(docs: DataFrame, length: int = 200) -> DataFrame:
    """From ``doc, sum, text`` (null ids allowed, no null texts): ``doc, sum, spans``, the byte ranges to remove, for texts that have any."""
    if length <= max(GRAM, STEP) or length > 1000:
        raise ValueError("length must lie between the gram's and 1000 bytes")
    work = Written(docs.sparkSession, "suffix-dedup")
    key = ["doc", "sum"]
    anchors = work.table(_anchors(docs, length), "anchors")
    # what is joined back to the rows it was counted from is written first: a join of two plain
    # shuffles has its hot keys split by Spark, one with an aggregate on a side has not
    grams = work.table(anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "grams")
    repeated = work.table(anchors.join(grams, "gram"), "repeated")
    work.drop(anchors)
    work.drop(grams)
    runs = repeated.groupBy("gram", "run").agg(F.count(F.lit(1)).alias("n"), F.min(F.xxhash64("doc", "sum", "at")).alias("least"))
    runs = work.table(runs, "runs")
    # of a gram with one run every place is covered, and no other run needs to see it
    mixed = work.table(runs.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram", F.lit(True).alias("mixed")), "mixed")
    kind = F.when(F.col("n") == 1, OPEN).when(F.col("mixed") & (F.xxhash64("doc", "sum", "at") == F.col("least")), SHOWN).otherwise(COVERED)
    marks = work.table(repeated.join(runs.join(mixed, "gram", "left"), ["gram", "run"]).select(*key, "at", kind.alias("kind")), "marks")
    for written in (repeated, runs, mixed):
        work.drop(written)
    first = F.shiftright("at", 20)
    covered = marks.where(F.col("kind") != OPEN).select(*key, first.alias("a"), (first + F.shiftright("at", 10).bitwiseAND(1023) + length).alias("b"))

    # the texts with open runs, for their cores
    lists = marks.where(F.col("kind") != COVERED).groupBy(*key).agg(F.collect_set(F.col("at") * 2 + (F.col("kind") == OPEN).cast("int")).alias("marks"))
    core_names = ["core", "doc", "sum", "start", "low", "high", "before", "after", "open"]
    core_kinds = [pa.binary(), *[pa.int64()] * 5, pa.binary(), pa.binary(), pa.bool_()]

    def cores_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for k in range(batch.num_rows):
                doc, own, text, found = (batch.column(i)[k].as_py() for i in range(4))
                raw = text.encode("utf-8", "replace")
                for mark in found:
                    rows += [(core, doc, own, start, low, high, before, after, bool(mark & 1)) for core, start, low, high, before, after in _cores(raw, mark >> 1, length)]
                if len(rows) > _ROWS:
                    yield batch_of(rows, core_kinds, core_names)
                    rows = []
        if rows:
            yield batch_of(rows, core_kinds, core_names)

    cores = _with(docs, lists, "inner").select("doc", "sum", "text", "marks").mapInArrow(cores_of, "core binary, doc bigint, sum bigint, start bigint, low bigint, high bigint, before binary, after binary, open boolean")
    cores = work.table(cores, "cores")
    again = work.table(cores.groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.max("open").alias("some")).where("n > 1 and some").select("core", "n"), "again")
    left = work.table(cores.join(again, "core"), "left")
    work.drop(cores)
    work.drop(again)
    few = left.where(F.col("n") <= HOT).drop("n").repartition("core").sortWithinPartitions("core")
    found = few.mapInArrow(lambda batches: _windows(batches, length), "doc bigint, sum bigint, a bigint, b bigint")
    hot = left.where(F.col("n") > HOT).withColumn("ahead", F.explode(F.sequence("low", "high")))
    name = ["core", "ahead", "x", "y"]
    side = STEP - 1
    ahead = F.col("ahead").cast("int")
    hot = hot.select("doc", "sum", "start", "open", "core", "ahead", F.substring("before", side + 1 - ahead, ahead).alias("x"), F.substring("after", F.lit(1), side - ahead).alias("y"))
    twice = work.table(hot.groupBy(*name).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"), "twice")
    hot = hot.where("open").join(twice, name).select(*key, (F.col("start") - F.col("ahead")).alias("a"), (F.col("start") - F.col("ahead") + length).alias("b"))
    spans = work.table(covered.union(found).union(hot), "spans")
    work.drop(marks)
    work.drop(left)

    return spans.groupBy(*key).agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def _cut(text: str, found: list | None) -> tuple[bytes, bytes, list[tuple[int, int]]]:
    raw = text.encode("utf-8", "replace")
    gone = merged([(x["a"], x["b"]) for x in found or ()], len(raw))
    return raw, without(raw, gone), gone


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, with_text: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, asked for, the remaining ``text``.

    A byte goes if a string of ``length`` bytes that covers it starts anywhere
    else too, in this document or another; strings are those of the input. Null
    text is empty; a text shorter than ``length`` stays whole. In the remaining
    text the bytes of a character that was cut in two are left out; the sum
    covers them. Rows that repeat an id, or have none, are documents of their
    own: each loses what repeats in it and nothing else. An empty table gives an
    empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    names = [x.split()[0] for x in _RESULT.split(", ")] + ["text"] * with_text
    kinds = [*[pa.int64()] * 4, pa.string(), *[pa.string()] * with_text]

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for doc, text, found in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw, kept, gone = _cut(text, found)
                row = (doc, len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest())
                # a span may begin or end inside a character, whose other bytes then stand alone and are left out of a string
                rows.append((*row, kept.decode("utf-8", "ignore")) if with_text else row)
                size += len(raw)
                if len(rows) > _ROWS or size > _BYTES:
                    yield batch_of(rows, kinds, names)
                    rows, size = [], 0
        if rows:
            yield batch_of(rows, kinds, names)

    named = _named(docs, id_col, text_col)
    return _with(named, repeated_spans(named, length), "left").select("doc", "text", "spans").mapInArrow(final, _RESULT + ", text string" * with_text)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """The rows of ``docs``, all columns, each with its remaining text (see ``suffix_dedup``); a null text becomes an empty one."""
    small_batches(docs.sparkSession)
    named = _named(docs, id_col, text_col, F.struct("*").alias("row"))
    cut = _with(named, repeated_spans(named.drop("row"), length), "left").select("text", "spans", "row")
    names, place = docs.columns, docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [_cut(text, found)[1].decode("utf-8", "ignore") for text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            columns = batch.column(2).flatten()
            columns[place] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = T.StructType([T.StructField(x.name, T.StringType() if x.name == text_col else x.dataType, True) for x in docs.schema])
    return cut.mapInArrow(work, schema)
