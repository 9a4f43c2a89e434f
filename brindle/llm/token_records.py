"""Token ids in length-delimited binary record files, with an offset index for shuffled reads.

A record is framed as ``length (u64) | masked crc of the length (u32) |
payload | masked crc of the payload (u32)``, all little-endian. The checksum is
CRC-32 as zlib has it, masked by a rotation of 15 bits and a constant, so that a
checksum of data that holds checksums stays useful. A payload is ``doc_id (i64)
| flags (u8) | ids``; bit 0 of the flags marks a null doc_id, bit 1 ids of four
bytes instead of two (two if all ids of the tokenizer fit).

Documents are range-partitioned and sorted by doc_id, so the files in order of
their part hold the documents in ascending order. Beside each file lies its
index: for each record offset, payload length and number of ids, each a u64.
A task writes to a name of its own attempt and reports it; the manifest names
the files of the attempts that counted, so a repeated task does no harm.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import Written, small_batches, text_of
from brindle.llm.token_cache import CachedEncoder, encoder_for

_HEAD, _TAG, _ENTRY = struct.Struct("<QI"), struct.Struct("<qB"), struct.Struct("<QQQ")
_MANIFEST = "part bigint, path string, docs bigint, tokens bigint"
_DOCS = "part bigint, record bigint, doc_id bigint, start bigint, n_tokens bigint, ids binary"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def entry(at: int, length: int, n_ids: int) -> bytes:
    return _ENTRY.pack(at, length, n_ids)


def encode_payload(doc_id: int | None, ids: bytes, width: int = 4) -> bytes:
    """``ids`` are little-endian unsigned integers of ``width`` bytes."""
    return _TAG.pack(doc_id or 0, (doc_id is None) | (width == 4) << 1) + ids


def decode_payload(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, flags = _TAG.unpack_from(payload)
    return None if flags & 1 else doc_id, np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=_TAG.size).astype("<u4")


def read_frame(f) -> bytes | None:
    """The next payload of an open file, None at its end; ValueError if it is damaged."""
    head = f.read(_HEAD.size)
    if not head:
        return None
    if len(head) < _HEAD.size or masked(head[:8]) != _HEAD.unpack(head)[1]:
        raise ValueError("damaged record length")
    payload = f.read(_HEAD.unpack(head)[0])
    tail = f.read(4)
    if len(payload) != _HEAD.unpack(head)[0] or len(tail) < 4 or masked(payload) != struct.unpack("<I", tail)[0]:
        raise ValueError("damaged record")
    return payload


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def read_record(path: str, number: int) -> tuple[int | None, np.ndarray]:
    """Record ``number`` of a file, by its index alone: what a shuffled reader does."""
    fs, at = file_system(path)
    with fs.open_input_file(at + ".idx") as index:
        index.seek(number * _ENTRY.size)
        found = index.read(_ENTRY.size)
    if len(found) < _ENTRY.size:
        raise IndexError(number)
    with fs.open_input_file(at) as f:
        f.seek(_ENTRY.unpack(found)[0])
        return decode_payload(read_frame(f))


def write_token_records(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", specials: bool = True) -> DataFrame:
    """Write record files into ``folder`` when the result, the manifest ``part, path, docs, tokens``, is computed.

    Null text is empty and gives a record with the end id alone (or no id, with
    ``end_id`` None). Null ids come first; rows that repeat an id are records
    one after the other, in the order of their text. An empty table writes no
    file. Other columns are ignored. Strings of special tokens in a text give their
    ids, unless ``specials`` is False.
    """
    small_batches(docs.sparkSession)
    width = CachedEncoder.narrow(tokenizer, end_id or 0)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        path = f"{folder}/part-{context.partitionId():05d}-{context.taskAttemptId()}.rec"
        end = b"" if end_id is None else end_id.to_bytes(width, "little")
        encoder = out = index = None
        n = tokens = at = 0
        for batch in batches:
            if encoder is None and batch.num_rows:
                encoder = encoder_for(tokenizer, specials, width)
                fs, name = file_system(path)
                fs.create_dir(name.rpartition("/")[0], recursive=True)
                out, index = fs.open_output_stream(name), fs.open_output_stream(name + ".idx")
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.ids(text) + end
                framed = frame(payload := encode_payload(doc_id, ids, width))
                index.write(entry(at, len(payload), len(ids) // width))
                out.write(framed)
                n, tokens, at = n + 1, tokens + len(ids) // width, at + len(framed)
        if out is not None:
            out.close()
            index.close()
            yield pa.RecordBatch.from_pydict({"part": [context.partitionId()], "path": [path], "docs": [n], "tokens": [tokens]})

    d = docs.select(docs[id_col].cast("bigint").alias("doc_id"), text_of(docs, text_col).alias("text"))
    return d.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(write, _MANIFEST)


def read_token_records(manifest: DataFrame) -> DataFrame:
    """Every record of the manifest's files: ``part, record, doc_id, start, n_tokens, ids`` (little-endian u32).

    ``start`` is the number of ids in all records before, by a running sum over
    the files (one row each) and then inside each file. A damaged record is an
    error.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list) -> pa.RecordBatch:
            kinds = [pa.int64()] * 5 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _DOCS.split(", ")])

        for batch in batches:
            for row in batch.to_pylist():
                fs, at = file_system(row["path"])
                rows, size, start, number = [], 0, row["before"], 0
                with fs.open_input_stream(at, buffer_size=1 << 20) as f:
                    while (payload := read_frame(f)) is not None:
                        doc_id, ids = decode_payload(payload)
                        rows.append((row["part"], number, doc_id, start, len(ids), ids.tobytes()))
                        number, start, size = number + 1, start + len(ids), size + len(payload)
                        if size > 1 << 22:
                            yield packed(rows)
                            rows, size = [], 0
                if rows:
                    yield packed(rows)

    files = max(1, manifest.count())
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    placed = manifest.select("part", "path", F.coalesce(before, F.lit(0)).alias("before"))
    return placed.repartitionByRange(files, "part").mapInArrow(read, _DOCS)


def token_records(docs: DataFrame, tokenizer: str, end_id: int | None = 1, specials: bool = True) -> tuple[DataFrame, DataFrame]:
    """Write all documents to the shared folder; return the manifest and what the files read back hold."""
    work = Written(docs.sparkSession, "token-records")
    manifest = work.table(write_token_records(docs, tokenizer, f"{work.root}/files", end_id, specials=specials), "manifest")
    return manifest, read_token_records(manifest)
