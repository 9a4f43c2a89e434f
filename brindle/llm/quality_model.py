"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed once for every whole text. Trees are grown on a bounded
sample of labelled rows (``max_rows``, those with the smallest hash of the id),
level by level over binned features with Newton leaves for the logistic loss.
They are complete binary trees and so plain arrays: the children of node i are
2 i + 1 and 2 i + 2, and numpy walks all documents down one tree at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import Written, small_batches, text_of

_UPPER, _LOWER, _DIGIT, _BREAK = slice(65, 91), slice(97, 123), slice(48, 58), slice(9, 14)
FEATURES = (
    "log_bytes log_words mean_word sd_word max_word short_words long_words upper lower digits non_ascii spaces breaks commas stops bangs questions pipes "
    "symbols quotes brackets slashes byte_entropy distinct_words top_word top_pair word_entropy repeated_pairs dup_lines mean_line upper_words title_words symbol_words sentence_words ascii_words"
).split()


def statistics(text: str) -> list[float]:
    """``FEATURES`` of one whole text; an empty text has zeros."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, w = len(raw), len(words)
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    p = h[h > 0] / n
    lengths = np.fromiter(map(len, words), np.int64, w)
    of = lambda chars: h[list(chars)].sum() / n
    counts = Counter(words)
    c = np.fromiter(counts.values(), np.float64, len(counts))
    pairs = Counter(zip(words, words[1:], strict=False))
    pair = np.fromiter(pairs.values(), np.float64, len(pairs))
    lines = [x for x in raw.split(b"\n") if x]
    stops = h[46] + h[33] + h[63]
    return [
        np.log1p(n), np.log1p(w), lengths.mean(), lengths.std(), np.log1p(lengths.max()), (lengths <= 3).mean(), (lengths >= 12).mean(),
        h[_UPPER].sum() / n, h[_LOWER].sum() / n, h[_DIGIT].sum() / n, h[128:].sum() / n, h[32] / n, h[_BREAK].sum() / n, h[44] / w, h[46] / w, h[33] / w, h[63] / w, h[124] / w,
        of(b"#*$%&<>@^~") * n / w, of(b"\"'"), of(b"()[]{}"), of(b"/\\_="), float(-(p * np.log2(p)).sum()), len(counts) / w, c.max() / w, pair.max() / w if len(pairs) else 0.0,
        float(np.log2(w) - (c * np.log2(c)).sum() / w), pair[pair > 1].sum() / w, (len(lines) - len(set(lines))) / max(1, len(lines)), np.log1p(w / max(1, len(lines))),
        sum(map(bytes.isupper, words)) / w, sum(map(bytes.istitle, words)) / w, float(sum(1 for x in words if not x[-1:].isalpha() and x[-1] not in b".,!?;:" and x[-1] < 128) / w), np.log1p(w / max(1, stops)), sum(map(bytes.isascii, words)) / w,
    ]


class Trees:
    """``feature[t, i]``, ``cut[t, i]`` of the inner nodes and ``leaf[t, k]``; a value above the cut goes right."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.cut, self.leaf = base, feature, cut, leaf

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while at.size and at[0] < len(feature):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - len(feature)] if at.size else 0
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, l2: float = 1.0, least: float = 3.0) -> Trees:
    """Grow trees on rows ``x`` with labels 0 and 1. Labels of one kind, or none, give the constant score (n1 + 1) / (n + 2)."""
    inner = (1 << depth) - 1
    prior = (y.sum() + 1) / (len(y) + 2)
    empty = Trees(float(np.log(prior / (1 - prior))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if len(y) == 0 or y.min() == y.max():
        return empty
    d = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(d)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(d)], 1)
    cuts = np.full((d, bins), np.inf)
    for j, e in enumerate(edges):
        cuts[j, : len(e)] = e
    spread = binned + np.arange(d) * bins
    margin, features, limits, leaves = np.full(len(y), empty.base), [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, hess = p - y, p * (1 - p)
        feature, cut, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            cell = ((at - first)[:, None] * (d * bins) + spread).ravel()
            size = width * d * bins
            cum = lambda v: np.cumsum(np.bincount(cell, np.repeat(v, d), size).reshape(width, d, bins), 2)  # noqa: E731, B023
            gl, hl = cum(g), cum(hess)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(hl < least) | (ht - hl < least) | ~np.isfinite(cuts)[None]] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-9:
                    feature[first + k], cut[first + k] = j, cuts[j, b]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > cut[at])
        where = at - inner
        leaf = -rate * np.bincount(where, g, inner + 1) / (np.bincount(where, hess, inner + 1) + l2)
        margin = margin + leaf[where]
        features.append(feature)
        limits.append(cut)
        leaves.append(leaf)
    return Trees(empty.base, np.array(features), np.array(limits), np.array(leaves))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: a fifth, by checksum of the id's text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, x`` with the statistics of each whole text."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([statistics(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), x], names=["doc_id", "x"])

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), text_of(docs, text_col).alias("text")).mapInArrow(work, "doc_id bigint, x array<double>")


def learnable(labels: DataFrame, max_rows: int) -> DataFrame:
    """``doc_id, y``: at most ``max_rows`` labelled ids that are not held out, those with the smallest hash. This bounds what is broadcast and learned from."""
    marks = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").alias("low"), F.max("quality").alias("y"))
    rows = marks.where("low = y and doc_id is not null").where(~held_out(F.col("doc_id")))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select("doc_id", "y")


def train(stats: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Trees:
    """Trees from the labelled rows among ``stats``."""
    rows = stats.join(F.broadcast(learnable(labels, max_rows)), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(max_rows)
    found = rows.select("x", "y").toArrow()
    x = np.array(found.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    return fit(x, np.array(found.column("y").to_pylist(), np.float64))


def accept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3, max_rows: int = 20_000) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches ``cut``: each row by its own text, whatever its id.

    Null texts are scored as empty ones and stay null; rows without an id are
    scored and never learned from; repeated rows stay or go together. Without
    labels every score is the prior, 0.5, and all rows stay. Columns of any kind
    go through; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    sample = docs.join(F.broadcast(learnable(labels, max_rows).select(F.col("doc_id").alias("_learn"))), docs[id_col].cast("bigint") == F.col("_learn"), "left_semi")
    trees = train(document_statistics(sample, id_col, text_col), labels, max_rows)
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t or "") for t in batch.column(at).to_pylist()], np.float64).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(trees.score(x) >= cut))

    return docs.mapInArrow(work, docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3, max_rows: int = 20_000) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.

    ``labels`` has ``doc_id, quality``; values other than 0 and 1 and ids that
    are labelled both ways are not learned from, nor is any held-out row. Only
    the text makes the score: null and empty texts share one. Without labels
    every score is the prior. A null id is never held out; repeated rows give
    repeated rows, an empty table an empty result; other columns are ignored.
    """
    work = Written(docs.sparkSession, "quality-model")
    stats = work.table(document_statistics(docs, id_col, text_col), "statistics")
    trees = train(stats, labels, max_rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees.score(x))], names=["doc_id", "score"])

    scored = stats.mapInArrow(score, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
