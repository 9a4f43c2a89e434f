"""Streams over files with one trigger, so that results are those of a batch."""

from pyspark.sql import functions as F

from brindle.streaming import jobs
from brindle.streaming.progress import Progress


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


def test_windowed_rollup_equals_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    got = run(spark, jobs.windowed(s), "windowed", "complete").agg(F.sum("n")).first()[0]
    assert got == e.count()


def test_ingest_drops_copies(spark, tmp_path):
    d = spark.createDataFrame([("a",), ("a",), ("b",)], "text string").withColumn("arrived", F.lit("2024-01-01").cast("timestamp"))
    d.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    assert run(spark, jobs.ingest(s), "ingested").count() == 2


def claims(spark, rows):
    return spark.createDataFrame(rows, "key bigint, claim_id bigint, s bigint").select("key", "claim_id", F.timestamp_seconds("s").alias("at"))


def test_supersede_keeps_the_newest(spark, tmp_path):
    d = claims(spark, [(1, 10, 100), (1, 11, 200), (2, 12, 100), (1, 13, 200)])
    d.repartition(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    got = run(spark, jobs.supersede(s), "superseded").collect()
    assert [(r["key"], r["claim_id"], r["replaced_by"]) for r in got] == [(1, 10, 11)]


def test_a_late_claim_is_replaced_too(spark, tmp_path):
    """The older claim comes in a later batch."""
    for i, rows in enumerate([[(1, 10, 500)], [(1, 11, 100), (2, 20, 50)], [(1, 12, 900)]]):
        claims(spark, rows).repartition(1).write.mode("append").parquet(str(tmp_path / f"in{i}"))
    schema = claims(spark, []).schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(*[str(tmp_path / "in*")])
    got = {(r["claim_id"], r["replaced_by"]) for r in run(spark, jobs.supersede(s), "late").collect()}
    assert {a for a, _ in got} == {10, 11} and got in ({(11, 10), (10, 12)}, {(11, 12), (10, 12)})


def events(spark, rows):
    return spark.createDataFrame(rows, "user_id bigint, event_type string, value double, s bigint").withColumn("ts", F.timestamp_seconds("s")).drop("s")


def test_sliding_windows_and_sessions_equal_a_batch(spark, tmp_path):
    e = events(spark, [(u, "a" if i % 3 else "b", float(i), 100_000 + 700 * i * (u + 1)) for u in range(3) for i in range(25)])
    e.repartition(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    got = run(spark, jobs.windowed(s, every="2 hours", slide="30 minutes"), "sliding", "complete")
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(got) == key(jobs.windowed(e, every="2 hours", slide="30 minutes")) and got.agg(F.sum("n")).first()[0] == 4 * e.count()
    got = run(spark, jobs.sessions(s, gap="20 minutes"), "sessions", "complete")
    assert key(got) == key(jobs.sessions(e, gap="20 minutes"))
    # gaps of 700, 1,400 and 2,100 seconds: one session of 25 events, then each event alone
    assert sorted(r["n"] for r in got.collect()) == [1] * 50 + [25]


def test_claims_meet_evidence_within_a_range_and_progress_is_told(spark, tmp_path):
    c = claims(spark, [(1, 10, 1000), (1, 11, 5000), (2, 20, 1000), (3, 30, 10)])
    v = spark.createDataFrame([(1, 100, 1000), (1, 101, 4600), (1, 102, 4601), (2, 200, 999), (3, 300, 60), (4, 400, 60)], "key bigint, evidence_id bigint, s bigint").select("key", "evidence_id", F.timestamp_seconds("s").alias("seen"))
    c.repartition(1).write.parquet(str(tmp_path / "c"))
    v.repartition(1).write.parquet(str(tmp_path / "v"))
    progress = Progress()
    spark.streams.addListener(progress)
    try:
        joined = jobs.confirmed(spark.readStream.schema(c.schema).parquet(str(tmp_path / "c")), spark.readStream.schema(v.schema).parquet(str(tmp_path / "v")))
        got = {(r["claim_id"], r["evidence_id"]) for r in run(spark, joined, "confirmed").collect()}
        assert got == {(10, 100), (10, 101), (30, 300)}
        import time

        for _ in range(50):  # events reach the listener a little later
            if any("confirmed" in x for x in progress.lines()):
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(progress)
    assert 'brindle_stream_rows_total{query="confirmed"} 10' in progress.lines()
    assert progress.table(spark).where("query = 'confirmed'").agg(F.sum("rows")).first()[0] == 10


def test_a_restart_gives_the_rows_of_one_run(spark, tmp_path):
    """Two runs over one checkpoint, with files that come in between, against one run over all."""
    parts = [[(1, 10, 100), (2, 20, 50)], [(1, 11, 200), (2, 21, 60)], [(1, 12, 300)]]
    schema = claims(spark, []).schema

    def once(source, name, check):
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        q = jobs.supersede(s).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    for name, stops in (("one", 1), ("two", 3)):
        source = str(tmp_path / f"in-{name}")
        for i, rows in enumerate(parts):
            claims(spark, rows).repartition(1).write.mode("append").parquet(source)
            if stops > 1 or i == len(parts) - 1:
                once(source, name, str(tmp_path / f"check-{name}"))
    key = lambda n: sorted(map(tuple, spark.read.parquet(str(tmp_path / n)).collect()))
    assert key("two") == key("one") == [(1, 10, 11), (1, 11, 12), (2, 20, 21)]
