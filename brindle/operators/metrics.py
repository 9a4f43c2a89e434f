"""Operational metrics from an event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import wording


def rollup(events: DataFrame, key: str = "event_type", value: str = "value") -> DataFrame:
    """Per key: count, sum, mean, extremes and the hit rate (the share of values above zero)."""
    return events.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total"), F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"),
        F.round(F.sum(F.when(F.col(value) > 0, 1).otherwise(0)) / F.count(F.lit(1)), 6).alias("hit_rate"),
    )


def processing(runs: DataFrame) -> DataFrame:
    """From ``domain, ok, entities, relations, ms`` one row for each domain and one, with a null domain, for all.

    ``processed, failed, success_rate`` (1 - failed / max(processed, 1)),
    ``entities, relations`` of what was processed, ``domain_count`` and ``mean_ms``.
    """
    good = F.when(F.col("ok"), 1)
    failed, done = F.count(F.when(~F.col("ok"), 1)), F.count(good)
    return runs.rollup("domain").agg(
        done.alias("processed"), failed.alias("failed"), F.round(1.0 - failed / F.greatest(done, F.lit(1)), 6).alias("success_rate"),
        F.coalesce(F.sum(good * F.col("entities")), F.lit(0)).alias("entities"), F.coalesce(F.sum(good * F.col("relations")), F.lit(0)).alias("relations"),
        F.count(F.lit(1)).alias("domain_count"), F.round(F.avg("ms"), 4).alias("mean_ms"),
    )


def prometheus(values: DataFrame, prefix: str = "brindle") -> DataFrame:
    """``line``: text exposition of ``name, label, value`` rows."""
    return values.select(F.concat(F.lit(f"{prefix}_"), "name", F.lit('{type="'), "label", F.lit('"} '), "value").alias("line"))


def exposition(totals: DataFrame, prefix: str = "brindle") -> DataFrame:
    """``line``: help, type and value of every number of one row of totals, and ``documents_by_domain`` for each other row.

    ``totals`` is what ``processing`` gives. Counters end in ``_total``, rates and means are gauges with four digits.
    """
    counters = {n: (c, wording.METRICS[n]) for n, c in {"documents_processed_total": "processed", "documents_failed_total": "failed", "entities_extracted_total": "entities", "relationships_extracted_total": "relations"}.items()}
    gauges = {n: (c, wording.METRICS[n]) for n, c in {"success_rate": "success_rate", "processing_ms_avg": "mean_ms"}.items()}
    block = lambda name, kind, text, value: F.array(F.lit(f"# HELP {prefix}_{name} {text}"), F.lit(f"# TYPE {prefix}_{name} {kind}"), F.concat(F.lit(f"{prefix}_{name} "), value))
    parts = [block(n, "counter", t, F.col(c).cast("string")) for n, (c, t) in counters.items()] + [block(n, "gauge", t, F.format_string("%.4f", F.col(c).cast("double"))) for n, (c, t) in gauges.items()]
    whole = totals.where("domain is null").select(F.explode(F.concat(*parts)).alias("line"))
    by = totals.where("domain is not null").select(F.concat(F.lit(f'{prefix}_documents_by_domain{{domain="'), "domain", F.lit('"} '), F.col("domain_count").cast("string")).alias("line"))
    return whole.union(by)


def ring(events: DataFrame, key: str, order: list, size: int = 1000) -> DataFrame:
    """The last ``size`` rows of each key."""
    return events.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") <= size).drop("_r")
