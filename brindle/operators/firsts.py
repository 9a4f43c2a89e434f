"""The first rows of each key, found before rows are sorted or shuffled."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

#: Rows that a task holds before it cuts them.
HELD = 65_536
#: Kinds whose order in Arrow is Spark's.
ORDERED = ("string", "binary", "boolean", "tinyint", "smallint", "int", "bigint", "date", "timestamp")


def first_of(d: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """Rows of ``d`` with ``_r``, their place by ``order`` among those of their ``key``, as far as ``most``.

    Each task first drops, in Arrow batches, rows that ``most`` others of its own
    precede, so that the sort for the exact places meets few rows and a task's
    memory does not grow with the table. Many keys pass a task as they come.
    """
    parts = _parts(F.col(order), d.schema[order].dataType)
    if all(kind in ORDERED for _, kind in parts) and d.schema[key].dataType.simpleString() in ORDERED:
        names = [f"_o{i}" for i in range(len(parts))]
        wide = d.select("*", *(c.alias(n) for n, (c, _) in zip(names, parts, strict=True)))
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wide.schema)
        d = wide.mapInArrow(partial(_cut_batches, key=key, order=names, most=most), kinds).drop(*names)
    return d.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_r") <= most)


def _parts(c: Column, kind: DataType) -> list[tuple[Column, str]]:
    """What a value is ordered by, one after the other, with the kinds; a null comes before a struct of nulls."""
    if isinstance(kind, StructType):
        return [(c.isNotNull(), "boolean"), *(p for f in kind.fields for p in _parts(c[f.name], f.dataType))]
    return [(c, kind.simpleString())]


def _cut(rows: pa.Table, key: str, order: list[str], most: int) -> tuple[pa.Table, pa.Table]:
    """The first ``most`` rows of each key, and the last of them where a key has so many."""
    rows = rows.combine_chunks()
    rows = rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in (key, *order)], null_placement="at_start")).combine_chunks()
    if not len(rows):
        return rows, rows
    codes = pc.fill_null(rows.column(key).combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    at = np.arange(len(codes))
    place = at - np.maximum.accumulate(np.where(np.diff(codes, prepend=-2) != 0, at, 0))
    return rows.take(pa.array(np.flatnonzero(place < most))), rows.take(pa.array(np.flatnonzero(place == most - 1)))


def _may(b: pa.RecordBatch, last: pa.Table, key: str, lead: str) -> pa.RecordBatch:
    """Rows that are not behind the last row of their key by ``lead`` alone; nulls stay."""
    limit = last.column(lead).combine_chunks().take(pc.index_in(b[key], value_set=last.column(key).combine_chunks()))
    return b.filter(pc.fill_null(pc.less_equal(b[lead], limit), True))


def _cut_batches(batches: Iterator[pa.RecordBatch], key: str, order: list[str], most: int) -> Iterator[pa.RecordBatch]:
    held, n, last = [], 0, None
    for b in batches:
        # the flags that tell nulls from structs come before the first value
        lead = next((c for c in order if not pa.types.is_boolean(b.schema.field(c).type)), None)
        b = _may(b, last, key, lead) if last is not None and lead else b
        held.append(b)
        n += len(b)
        if n >= HELD:
            rows, last = _cut(pa.Table.from_batches(held), key, order, most)
            held, n = rows.to_batches(), len(rows)
            if 2 * n > HELD:
                yield from held
                held, n, last = [], 0, None
    if held:
        yield from _cut(pa.Table.from_batches(held), key, order, most)[0].to_batches()
