"""The engine's scalar functions under SQL names, as SQL functions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "br_tokens(t STRING) RETURNS ARRAY<STRING>": r"filter(split(lower(coalesce(t, '')), '[^\\p{L}\\p{N}]+'), x -> x <> '')",
    "br_token_estimate(t STRING) RETURNS BIGINT": "CAST(floor(length(t) / 4) AS BIGINT)",
    "br_preview(t STRING, n INT) RETURNS STRING": "CASE WHEN length(t) > n THEN concat(substring(t, 1, n), '...') ELSE t END",
    "br_document_id(t STRING) RETURNS STRING": "concat('doc_', substring(sha2(coalesce(t, ''), 256), 1, 16))",
    "br_squash(s DOUBLE) RETURNS DOUBLE": "CASE WHEN s > 0 THEN s / (s + 1) ELSE 0.0D END",
    "br_jaccard(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE": "CASE WHEN size(array_union(a, b)) > 0 THEN size(array_intersect(a, b)) / size(array_union(a, b)) END",
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to a session; returns their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in FUNCTIONS]
