"""Sketches of days, merged for a range, against the events."""

import random

import pytest
from pyspark.sql import functions as F

from brindle.operators import sketches


def test_ranges_from_stored_days(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.randrange(3000), rng.choice("ab"), rng.gauss(0, 10), rng.randrange(10 * 86400)) for _ in range(20_000)] + [(None, "a", 1.0, 5), (7, "a", None, 6), (8, "c", None, 7), (9, "a", 3.0, None)]
    e = spark.createDataFrame(rows, "user_id bigint, event_type string, value double, s bigint").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    path = str(tmp_path / "days")
    sketches.save(sketches.daily(e.where("ts < '1970-01-06'"), ["event_type"]), path)
    sketches.save(sketches.daily(e.where("ts >= '1970-01-05'"), ["event_type"]), path)  # one day again: it replaces the first
    stored = spark.read.parquet(path)
    for first, last in (("1970-01-01", "1970-01-10"), ("1970-01-03", "1970-01-05")):
        got = sketches.over(stored, first, last, ["event_type"])
        exact = {r.event_type: r for r in e.where(F.to_date("ts").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high")).collect()}
        for r in got.collect():
            x = exact[r.event_type]
            assert (r.n, r.low, r.high) == (x.n, x.low, x.high) and (r.total == pytest.approx(x.total) if x.total is not None else r.total is None)
        off = sketches.error(e, got.where("event_type != 'c'"), first, last, "event_type").collect()
        assert len(off) == 2 and all(r.users_error <= 0.05 and r.p50_error <= 0.03 and r.p95_error <= 0.03 for r in off)
    assert sketches.over(stored, "1980-01-01", "1980-01-02", ["event_type"]).count() == 0
    none = sketches.over(stored, "1970-01-01", "1970-01-01", ["event_type"]).where("event_type = 'c'").first()
    assert none.p50 is None and none.users == 1
