"""Harmonic packing of token sequences, independently in every task.

The capacity C is split into reciprocal classes: class k takes lengths in
(C / (k + 1), C / k], and a bin of class k is closed by exactly k documents, so
no bin looks at another. A document longer than C gives its full sequences
first; its rest is a leftover. A closed bin has a gap of less than C / (k + 1),
which is topped up from leftovers, cut to fit: those rests and, where none is
left while ``WAITING`` closed bins wait for one, the next whole document. So
whole documents are cut only to close the gaps of others. What a task has at its
end - waiting bins, open bins, leftovers - is poured, cutting freely, into full
sequences and then into sequences of falling powers of two, which need no
padding. No task waits for another: a sequence's number is its task's number
times 2**40 plus a counter, so the same splits always give the same sequences.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from brindle.llm.common import small_batches, text_of
from brindle.llm.token_cache import encoder_for

_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, padded_length bigint"


class Harmonic:
    """Packs one task's documents; ``add`` and ``finish`` give finished sequences, each a list of pieces (doc, start, ids, doc_tokens)."""

    #: Closed bins that wait for a leftover, and leftovers in stock, in capacities, beyond which rests take part as documents do.
    WAITING, STOCK = 32, 8

    def __init__(self, capacity: int):
        self.capacity = capacity
        #: Documents of each open bin, by class.
        self.open: dict[int, list] = {}
        self.waiting: deque[tuple[list, int]] = deque()
        self.leftovers: deque[tuple] = deque()
        self.stock = 0

    def add(self, doc, ids: np.ndarray) -> Iterator[list]:
        at, n, c = 0, len(ids), self.capacity
        while n - at >= c:
            yield [(doc, at, ids[at : at + c], n)]
            at += c
        rest = n - at
        if not rest:
            return
        if at and self.stock < self.STOCK * c or len(self.waiting) >= self.WAITING:
            self.leftovers.append((doc, at, ids[at:], n))
            self.stock += rest
        else:
            k = c // rest
            held = self.open.setdefault(k, [])
            held.append((doc, at, ids[at:], n))
            if len(held) == k:
                del self.open[k]
                self.waiting.append((held, c - sum(len(p[2]) for p in held)))
        yield from self._top_up()

    def _top_up(self) -> Iterator[list]:
        while self.waiting and self.waiting[0][1] <= self.stock:
            held, gap = self.waiting.popleft()
            self.stock -= gap
            while gap:
                doc, at, ids, n = self.leftovers.popleft()
                if len(ids) > gap:
                    self.leftovers.appendleft((doc, at + gap, ids[gap:], n))
                    ids = ids[:gap]
                held.append((doc, at, ids, n))
                gap -= len(ids)
            yield held

    def finish(self) -> Iterator[list]:
        left = [p for held, _ in self.waiting for p in held] + [p for k in sorted(self.open) for p in self.open[k]] + list(self.leftovers)
        total = sum(len(p[2]) for p in left)
        left.reverse()
        while total:
            room = self.capacity if total >= self.capacity else 1 << (total.bit_length() - 1)
            total -= room
            sequence = []
            while room:
                doc, at, ids, n = left.pop()
                if len(ids) > room:
                    left.append((doc, at + room, ids[room:], n))
                    ids = ids[:room]
                sequence.append((doc, at, ids, n))
                room -= len(ids)
            yield sequence


def padded_length(used: int, capacity: int) -> int:
    """A sequence of a power of two stays as it is; any other is padded to the capacity."""
    return used if used & (used - 1) == 0 else capacity


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int | None = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", specials: bool = True) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length`` and, asked for, ``ids``.

    A sequence's pieces lie one behind the other from offset 0 and hold at most
    ``capacity`` ids. A null text is empty and is its end id alone; without an
    end id an empty document has no piece. Null ids stay null, repeated rows are
    documents of their own (tell them apart by the piece's place), an empty
    table gives no piece, other columns are ignored. There is no shuffle; a task
    holds at most one open bin for each class that occurs, ``WAITING`` closed
    ones and ``STOCK`` capacities of leftovers with one document over. Strings of
    special tokens in a text give their ids, unless ``specials`` is False.
    """
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([] if end_id is None else [end_id], "<u4").tobytes()
        base, number, rows, encoder, packer = TaskContext.get().partitionId() << 40, 0, [], None, Harmonic(capacity)

        def lay(sequence: list) -> None:
            nonlocal number
            offset, length = 0, padded_length(sum(len(p[2]) for p in sequence), capacity)
            for doc, at, ids, n in sequence:
                rows.append((doc, at, len(ids), zlib.crc32(raw := ids.tobytes()), n, base + number, offset, length, *[raw] * with_ids))
                offset += len(ids)
            number += 1

        def packed() -> pa.RecordBatch:
            kinds = [pa.int64()] * 8 + [pa.binary()] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*(x.split()[0] for x in _PIECES.split(", ")), "ids"][: len(kinds)])

        for batch in batches:
            encoder = encoder or encoder_for(tokenizer, specials)
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for sequence in packer.add(doc, np.frombuffer(encoder.ids(text) + end, "<u4")):
                    lay(sequence)
            if len(rows) > 4000:
                yield packed()
                rows.clear()
        for sequence in packer.finish():
            lay(sequence)
        if rows:
            yield packed()

    d = docs.select(docs[id_col].cast("bigint").alias("doc_id"), text_of(docs, text_col).alias("text"))
    return d.mapInArrow(work, _PIECES + ", ids binary" * with_ids)
