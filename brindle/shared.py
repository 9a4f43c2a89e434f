"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; set here only where it is unset and Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isEmpty():
            if spark.sparkContext.master.split("[")[0] != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="brindle-"))
            own = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = own.get()
    return found.rstrip("/")


_roots: list[str] = []
_own = threading.local()


def clean(spark: SparkSession) -> None:
    """Delete every intermediate table that this process has written. To be called once no result made from them is needed."""
    while _roots:
        delete(spark, _roots.pop())


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables that this thread writes inside the block are deleted at its end; for callers that collect their results inside."""
    outer, _own.roots = getattr(_own, "roots", None), []
    try:
        yield
    finally:
        for root in _own.roots:
            delete(spark, root)
        _own.roots = outer


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for as long as the block runs."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@contextmanager
def small_broadcasts(spark: SparkSession, most: int) -> Iterator[None]:
    """Joins broadcast tables of at most ``most`` bytes inside the block, and none where the session has that turned off; for many rounds of joins, as each table broadcast passes the driver."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    limit = spark.conf.get(key) if spark.conf.get(key).startswith("-") else str(most)
    with setting(spark, key, limit), setting(spark, "spark.sql.adaptive.autoBroadcastJoinThreshold", limit):
        yield


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Lower the Arrow batch size, so that a batch of long documents fits a worker's memory."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


class Written:
    """Intermediate tables in the shared folder. Each is a Parquet table, so a lost executor costs a reread and not a recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: list[str] = []
        held = getattr(_own, "roots", None)
        (_roots if held is None else held).append(self.root)

    def path(self, name: str) -> str:
        out = f"{self.root}/{len(self.paths):03d}-{name}"
        self.paths.append(out)
        return out

    def table(self, df: DataFrame, name: str, **options) -> DataFrame:
        """Write ``df``, with options of the writer; the files of its shuffles go once it is written."""
        out = self.path(name)
        with setting(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            df.write.options(**({"compression": "zstd"} | options)).parquet(out)
        read = self.spark.read.schema(df.schema).parquet(out)
        read.written_at = out
        return read

    def drop(self, df: DataFrame) -> None:
        """Delete a table written here that no later step reads."""
        delete(self.spark, df.written_at)
