"""The streaming twins: incremental ingest, windowed metrics with late data, superseded claims, alerts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from brindle.functions.text import content_hash, document_id


def ingest(files: DataFrame, text_col: str = "text", arrived: str = "arrived", late: str = "1 day") -> DataFrame:
    """New documents of a stream, each content once within the watermark; ids come from the content."""
    d = files.withColumn("content_hash", content_hash(F.col(text_col))).withColumn("document_id", document_id(F.col(text_col)))
    return d.withWatermark(arrived, late).dropDuplicatesWithinWatermark(["content_hash"])


def windowed(events: DataFrame, ts: str = "ts", every: str = "1 day", slide: str | None = None, late: str = "1 hour", key: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and sums of tumbling or sliding windows; what comes later than the watermark is dropped."""
    w = F.window(ts, every, slide) if slide else F.window(ts, every)
    out = events.withWatermark(ts, late).groupBy(w, key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n", "total")


def sessions(events: DataFrame, ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour", key: str = "user_id") -> DataFrame:
    out = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def supersede(claims: DataFrame, late: str = "30 days") -> DataFrame:
    """From ``key, claim_id, at`` (a timestamp): each claim that a later one of its key replaces, with the next one's id.

    A key keeps its claims of the last ``late`` before the watermark, so a claim
    that comes late is still reported as replaced, by the next one in time. A claim
    is reported once, by the next one known at that moment. Claims at one time do
    not replace each other. A key that is silent for ``late`` is forgotten.
    """
    seconds = pd.Timedelta(late).total_seconds()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(zip(*state.get, strict=True)) if state.exists else []
        held += [(int(at.value // 1000), int(c), False) for f in frames for at, c in f[["at", "claim_id"]].itertuples(index=False, name=None)]
        held.sort()
        out, kept = [], []
        for i, (at, claim, told) in enumerate(held):
            later = next((c for t, c, _ in held[i + 1 :] if t > at), None)
            if later is not None and not told:
                out.append((key[0], claim, later))
            kept.append((at, claim, told or later is not None))
        newest = kept[-1][0]
        kept = [x for x in kept if x[0] >= newest - seconds * 1e6 or not x[2]]
        state.update(tuple(list(c) for c in zip(*kept, strict=True)))
        state.setTimeoutTimestamp(max(newest // 1000 + int(seconds * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "claim_id", "replaced_by"])

    dated = claims.withWatermark("at", late).groupBy("key")
    return dated.applyInPandasWithState(step, "key bigint, claim_id bigint, replaced_by bigint", "at array<bigint>, claim array<bigint>, told array<boolean>", "append", GroupStateTimeout.EventTimeTimeout)


def alerts(events: DataFrame, levels: DataFrame, key: str = "event_type") -> DataFrame:
    """Events that reach their key's watched level: a stream joined with a table."""
    return events.join(levels, key).where(F.col("value") >= F.col("level"))


def confirmed(claims: DataFrame, evidence: DataFrame, within: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """``key, claim_id, evidence_id, at, seen``: claims (``key, claim_id, at``) with the evidence (``key, evidence_id, seen``) of their key that comes at the same time or within a range after them.

    A join of two streams: both have watermarks and the range bounds what is
    kept, so state goes when neither side can match any more.
    """
    a = claims.select(F.col("key").alias("_k"), "claim_id", "at").withWatermark("at", late)
    b = evidence.select("key", "evidence_id", "seen").withWatermark("seen", late)
    return a.join(b, F.expr(f"key = _k AND seen >= at AND seen <= at + INTERVAL {within}")).select("key", "claim_id", "evidence_id", "at", "seen")
