"""Session defaults: adaptive execution, UTC, Arrow; sizes are left to the cluster's own settings."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf) -> SparkSession:
    b = SparkSession.builder.appName("brindle")
    if master:
        b = b.master(master)
    base = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    return b.config(map=base | {k: str(v) for k, v in conf.items()}).getOrCreate()
