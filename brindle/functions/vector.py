"""Vector expressions over arrays, computed in double precision."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a zero vector or unlike lengths."""
    return F.when((F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b)))


def inverse_distance(distance: Column) -> Column:
    """Similarity from an l2 or inner-product distance."""
    return 1 / (1 + distance)


def unit(a: Column) -> Column:
    """The vector at length one; null for a zero vector."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def hashing_embedder(tokens: Column, size: int = 64) -> Column:
    """A deterministic stand-in for a model: counts of token hashes, signed, by slot; zeros where there is no token.

    A token's slot is the first eight hexadecimal digits of its MD5 modulo
    ``size``; it counts negatively if the ninth digit is odd.
    """

    # words stay in Arrow's own memory, hashed once for each distinct word of a batch
    @F.arrow_udf("array<double>")
    def embed(lists: pa.Array) -> pa.Array:
        rows = len(lists)
        words = lists.flatten().dictionary_encode()
        hashes = [hashlib.md5(w.encode()).hexdigest() for w in words.dictionary.to_pylist()]
        slot = np.array([int(h[:8], 16) % size for h in hashes], np.int64)
        sign = np.array([-1.0 if int(h[8], 16) % 2 else 1.0 for h in hashes])
        code, row = words.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        out = np.bincount(row * size + slot[code], sign[code], rows * size) if len(code) else np.zeros(rows * size)
        return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * size, pa.int32()), pa.array(out))

    return embed(F.coalesce(tokens, F.array().cast("array<string>")))
