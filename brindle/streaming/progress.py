"""Progress of streams as metrics: a listener that keeps the last rows and writes them out."""

from __future__ import annotations

import json
import threading
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

_KIND = "query string, batch bigint, at string, rows bigint, rows_per_second double, ms bigint, watermark string, state_rows bigint, dropped_late bigint"


class Progress(StreamingQueryListener):
    """Keeps one row for each batch of every query, the last ``most``, and how each query ended."""

    def __init__(self, most: int = 10_000):
        self.rows: deque = deque(maxlen=most)
        self.ended: dict[str, str | None] = {}
        self.lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        state = p.get("stateOperators") or []
        row = (
            p.get("name") or p["id"], p["batchId"], p["timestamp"], p.get("numInputRows", 0), float(p.get("processedRowsPerSecond") or 0.0), p.get("durationMs", {}).get("triggerExecution", 0),
            p.get("eventTime", {}).get("watermark"), sum(s.get("numRowsTotal", 0) for s in state), sum(s.get("numRowsDroppedByWatermark", 0) for s in state),
        )
        with self.lock:
            self.rows.append(row)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.id)] = event.exception

    def table(self, spark: SparkSession) -> DataFrame:
        """The kept rows as a table."""
        with self.lock:
            return spark.createDataFrame(list(self.rows), _KIND)

    def lines(self, prefix: str = "brindle_stream") -> list[str]:
        """Counters of every query in the text exposition format."""
        with self.lock:
            rows = list(self.rows)
        out = []
        for name in sorted({r[0] for r in rows}):
            own = [r for r in rows if r[0] == name]
            for metric, value in (("batches_total", len(own)), ("rows_total", sum(r[3] for r in own)), ("late_rows_total", sum(r[8] for r in own)), ("state_rows", own[-1][7])):
                out.append(f'{prefix}_{metric}{{query="{name}"}} {value}')
        return out
