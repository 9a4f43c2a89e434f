"""Stored tables that change by snapshots: upserts and deletes rewrite the buckets that they touch and nothing else.

A table is a folder of Parquet data and of manifests. Rows lie in buckets by
their key's hash; a manifest lists the files' folders of every bucket. A change
writes new folders under a name of its own and then creates the next manifest,
which fails if someone else has made it; so readers see whole snapshots, earlier
ones stay readable, and a repeated or failed change leaves the table as it was.
Manifests have one line a bucket and are what the driver reads.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.errors import AlreadyExists, NotFound


class Manifests:
    """Numbered JSON files in a folder, each created once and for all; any file system that Hadoop reads."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        jvm = spark.sparkContext._jvm
        self.path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}" if name else folder)
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        at = self.path("")
        names = [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def read(self, version: int | None = None) -> tuple[int, dict]:
        found = self.versions()
        if not found or version is not None and version not in found:
            raise NotFound(f"no version {'' if version is None else version} of {self.folder}")
        version = found[-1] if version is None else version
        text = self.spark.read.text(f"{self.folder}/{version:010d}.json", wholetext=True).first()[0]
        return version, json.loads(text)

    def write(self, version: int, what: dict) -> None:
        """Create a version; an error if it is there."""
        try:
            out = self.fs.create(self.path(f"{version:010d}.json"), False)
        except Exception as e:  # the file system's own error says that the file is there
            if self.fs.exists(self.path(f"{version:010d}.json")):
                raise AlreadyExists(f"version {version} of {self.folder} was made by someone else") from e
            raise
        try:
            out.write(bytearray(json.dumps(what).encode()))
        finally:
            out.close()


class Snapshots:
    """A stored table with a key; null keys are one key. ``buckets`` is fixed when it is made."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.manifests = spark, path.rstrip("/"), Manifests(spark, f"{path.rstrip('/')}/_manifests")

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str, buckets: int = 64) -> Snapshots:
        """Store the rows as version 0; keys must be unique, which is left to the caller."""
        out = cls(rows.sparkSession, path)
        if out.manifests.versions():
            raise AlreadyExists(f"{path} is a stored table")
        what = {"key": key, "buckets": buckets, "schema": rows.schema.json(), "at": {}}
        out.manifests.write(0, what | {"at": out._written(rows, what)})
        return out

    def _bucket(self, key: str, buckets: int):
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def _written(self, rows: DataFrame, what: dict) -> dict[str, list[str]]:
        """Write rows by bucket under a new name; the folders of the buckets that have any."""
        at = f"data/{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self._bucket(what["key"], what["buckets"])).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{at}")
        folder = self.manifests.path("").getParent().suffix(f"/{at}")
        names = [s.getPath().getName() for s in self.manifests.fs.listStatus(folder)]
        return {n.removeprefix("_bucket="): [f"{at}/{n}"] for n in names if n.startswith("_bucket=")}

    def _read(self, what: dict, buckets: list[int] | None = None) -> DataFrame:
        from pyspark.sql.types import StructType

        folders = [f"{self.path}/{f}" for b, at in sorted(what["at"].items()) if buckets is None or int(b) in buckets for f in at]
        schema = StructType.fromJson(json.loads(what["schema"]))
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The table as it was at a version, the last one unless given."""
        return self._read(self.manifests.read(version)[1])

    def versions(self) -> list[int]:
        return self.manifests.versions()

    def _change(self, keys: DataFrame, added: DataFrame | None) -> int:
        version, what = self.manifests.read()
        key = what["key"]
        touched = [r[0] for r in keys.select(self._bucket(key, what["buckets"])).distinct().collect()]  # at most one a bucket
        if not touched:
            return version
        old, gone = self._read(what, touched), keys.select(F.col(key).alias("_gone")).distinct()
        left = old.join(gone, old[key].eqNullSafe(gone["_gone"]), "left_anti")
        now = left if added is None else left.unionByName(added.select(*old.columns))
        at = {b: f for b, f in what["at"].items() if int(b) not in touched} | self._written(now, what)
        self.manifests.write(version + 1, what | {"at": at})
        return version + 1

    def upsert(self, rows: DataFrame) -> int:
        """Rows in place of those of their keys; returns the new version. No rows, no version."""
        return self._change(rows, rows)

    def delete(self, keys: DataFrame) -> int:
        """The table without the rows of these keys; returns the new version."""
        return self._change(keys, None)
