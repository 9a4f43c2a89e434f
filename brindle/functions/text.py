"""Text expressions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_WORD = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def token_estimate(text: Column, per_token: int = 4) -> Column:
    """Characters over four, floored."""
    return F.floor(F.length(text) / per_token).cast("bigint")


def preview(text: Column, n: int = 500) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def document_id(text: Column) -> Column:
    """``doc_`` and 16 hex digits of the raw content's hash, so it is stable under rewriting of the frontmatter."""
    return F.concat(F.lit("doc_"), F.substring(content_hash(text), 1, 16))


def squash(score: Column) -> Column:
    return F.when(score > 0, score / (score + 1)).otherwise(F.lit(0.0))


def contains_any(text: Column, phrases: list[str]) -> Column:
    """Plain substring tests, case as given."""
    out = F.lit(False)
    for p in phrases:
        out = out | text.contains(p)
    return out


def json_salvage(text: Column) -> Column:
    """The widest braced part of a text if it is valid JSON, else null."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when((found != "") & F.try_parse_json(found).isNotNull(), found)
