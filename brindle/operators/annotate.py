"""Spans of text: merging, highlighting, locating quotes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_spans(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, start, end`` of the union of ``[start, end)`` intervals; touching ones merge."""
    order = Window.partitionBy(key).orderBy("start", "end")
    d = spans.select(key, "start", "end").withColumn("reach", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    d = d.withColumn("island", F.sum(F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach")), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def highlight(texts: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, start, part, highlighted``: a text cut into marked and plain parts, in order, from merged spans; a text without spans is one plain part."""
    lists = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("s"))
    d = texts.join(lists, key, "left").withColumn("s", F.coalesce("s", F.from_json(F.lit("[]"), lists.schema["s"].dataType)))
    part = lambda a, b, on: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(on).alias("highlighted"))
    gaps = F.transform("s", lambda x, i: F.array(part(F.when(i == 0, F.lit(0)).otherwise(F.get("s", i - 1)["end"]), x["start"], False), part(x["start"], x["end"], True)))
    rest = F.array(part(F.coalesce(F.try_element_at("s", F.lit(-1))["end"], F.lit(0)), F.length("text"), False))
    d = d.select(key, "text", F.explode(F.concat(F.flatten(gaps), rest)).alias("p")).where("p.start < p.end")
    return d.select(key, F.col("p.start").cast("bigint").alias("start"), F.substring("text", F.col("p.start") + 1, F.col("p.end") - F.col("p.start")).alias("part"), F.col("p.highlighted").alias("highlighted"))


def ground(chunks: DataFrame, quotes: DataFrame, around: int = 50) -> DataFrame:
    """Offsets of exact quotes in their chunk and document with up to ``around`` characters before and after.

    ``chunks`` has ``chunk_id, doc_id, text, start``; ``quotes`` has ``chunk_id, quote``. Quotes that do not occur are left out.
    """
    d = chunks.join(quotes, "chunk_id").withColumn("at", F.expr("locate(quote, text)") - 1).where("at >= 0")
    end = F.col("at") + F.length("quote")
    before = F.greatest(F.col("at") - around, F.lit(0))
    return d.select(
        "chunk_id", "doc_id", "quote", (F.col("start") + F.col("at")).cast("bigint").alias("start"), (F.col("start") + end).cast("bigint").alias("end"),
        F.substring("text", before + 1, F.col("at") - before).alias("prefix"), F.substring("text", end + 1, F.lit(around)).alias("suffix"),
    )


def longest_block(quote: str, text: str, least: int) -> tuple[int, int]:
    """``size, place in text`` of the longest string in common, of several the first in the quote, then the first in the text; (0, -1) below ``least``.

    Common strings of a length are looked up in a set of the quote's, and the
    length is found by halving: time is that of a few passes over the text.
    """

    def at(n: int) -> int:
        parts = {quote[i : i + n] for i in range(len(quote) - n + 1)}
        return any(text[j : j + n] in parts for j in range(len(text) - n + 1))

    low, high = max(1, least), min(len(quote), len(text))
    if low > high or not at(low):
        return 0, -1
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if at(middle) else (low, middle - 1)
    for i in range(len(quote) - low + 1):
        if (place := text.find(quote[i : i + low])) >= 0:
            return low, place
    raise AssertionError("a string in common was found before")


def fuzzy_locate(pairs: DataFrame, share: float = 0.8) -> DataFrame:
    """From ``id, text, quote``: the place in the text of the longest block in common, if it covers more than ``share`` of the quote, else -1.

    The longest common block has no built-in; whole texts go through Arrow
    batches. Memory grows with the quote, of which all substrings of one length
    are held at a time: this is for quotes, not for whole texts as quotes.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = [longest_block(quote or "", text or "", int(share * len(quote or "")) + 1)[1] for text, quote in zip(b["text"], b["quote"], strict=True)]
            yield pd.DataFrame({"id": b["id"], "at": at})

    return pairs.select("id", "text", "quote").mapInPandas(work, "id bigint, at bigint")
