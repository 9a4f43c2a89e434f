"""Temporal class and dates of claims, and which claims newer ones supersede."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import contains_any

# fixed values: phrases and date patterns, in the order in which they are tried
ATEMPORAL = ["is a", "are a", "is defined as", "refers to", "means", "definition"]
STATIC = ["was born", "died", "founded", "established", "created", "invented"]
DYNAMIC = ["currently", "now", "recently", "as of", "plans to", "will", "going to", "expects to"]
RELATIVE = ["yesterday", "today", "tomorrow", "last week", "next month", "ago"]
DATES = [r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{4}\b", r"\b\d{1,2}/\d{1,2}/\d{4}\b", r"\b\d{4}-\d{1,2}-\d{1,2}\b", r"\b\d{4}\b"]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def temporal_class(text: Column) -> Column:
    """STATIC, DYNAMIC or ATEMPORAL: dates first, then phrases as plain substrings in fixed precedence."""
    low = F.lower(text)
    dated = low.rlike("|".join(DATES))
    return (
        F.when(dated & contains_any(low, DYNAMIC), "DYNAMIC").when(dated, "STATIC").when(contains_any(low, ATEMPORAL), "ATEMPORAL")
        .when(contains_any(low, DYNAMIC), "DYNAMIC").when(contains_any(low, STATIC), "STATIC").when(contains_any(low, RELATIVE), "DYNAMIC").otherwise("ATEMPORAL")
    )


def claim_date(text: Column, reference: Column | None = None) -> Column:
    """The date of a claim as ``yyyy-MM-dd``: ISO, then m/d/y, then month [day,] year; yesterday, today, tomorrow and ``n days ago`` against ``reference``; else null."""
    low = F.lower(text)
    iso = F.regexp_extract(low, r"\b(\d{4}-\d{1,2}-\d{1,2})\b", 1)
    us = F.regexp_extract(low, r"\b(\d{1,2}/\d{1,2}/\d{4})\b", 1)
    pattern = r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+(?:(\d{1,2}),\s+)?(\d{4})\b"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(low, pattern, 1)).cast("int")
    day = F.regexp_extract(low, pattern, 2)
    named = F.when(month > 0, F.concat_ws("-", F.regexp_extract(low, pattern, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.when(day == "", "1").otherwise(day), 2, "0")))
    out = F.coalesce(F.to_date(F.try_to_timestamp(F.when(iso != "", iso), F.lit("yyyy-M-d"))), F.to_date(F.try_to_timestamp(F.when(us != "", us), F.lit("M/d/yyyy"))), F.to_date(F.try_to_timestamp(named, F.lit("yyyy-MM-dd"))))
    if reference is not None:
        back = F.regexp_extract(low, r"\b(\d{1,4}) days? ago\b", 1)
        by = F.when(back != "", -back.cast("int")).when(low.contains("yesterday"), -1).when(low.contains("today"), 0).when(low.contains("tomorrow"), 1)
        out = F.coalesce(out, F.date_add(reference, by))
    return F.date_format(out, "yyyy-MM-dd")


def superseded(claims: DataFrame, key: str, at: str, kind: str = "temporal_type") -> DataFrame:
    """Dynamic dated claims that a later dynamic claim of the same key replaces, with the time of the next one.

    A claim is replaced if a strictly later one exists. The distinct times of a
    key are put in order once, and each claim looks up the time after its own.
    """
    d = claims.where((F.col(kind) == "DYNAMIC") & F.col(at).isNotNull())
    times = d.select(F.col(key).alias("_key"), F.col(at).alias("_at")).distinct()
    times = times.withColumn("replaced_at", F.lead("_at").over(Window.partitionBy("_key").orderBy("_at"))).where("replaced_at is not null")
    return d.join(times, (F.col(key) == F.col("_key")) & (F.col(at) == F.col("_at"))).drop("_key", "_at")
