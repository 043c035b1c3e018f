"""What a stream has done: rates and latencies of its micro-batches."""

from __future__ import annotations

import json
import logging
import threading
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

log = logging.getLogger(__name__)
SCHEMA = "query string, batch bigint, rows bigint, rows_per_s double, millis bigint, state_rows bigint"


class Status(StreamingQueryListener):
    """Keeps the last ``most`` micro-batches of all queries of a session and logs each."""

    def __init__(self, spark: SparkSession, *, most: int = 1000):
        self.spark, self.most = spark, most
        self._batches: list[tuple[Any, ...]] = []
        self._lock = threading.Lock()
        spark.streams.addListener(self)

    def onQueryStarted(self, event: Any) -> None:
        log.info("stream %s started", event.name or event.id)

    def onQueryProgress(self, event: Any) -> None:
        p = json.loads(event.progress.json)
        row = (p.get("name") or p["id"], p["batchId"], p.get("numInputRows", 0), float(p.get("processedRowsPerSecond") or 0), p.get("batchDuration", 0), sum(s.get("numRowsTotal", 0) for s in p.get("stateOperators", [])))
        log.info("stream %s batch %d: %d rows, %.0f a second", *row[:4])
        with self._lock:
            self._batches = [*self._batches, row][-self.most :]

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        log.info("stream %s ended%s", event.id, f": {event.exception}" if event.exception else "")

    def batches(self) -> DataFrame:
        """(query, batch, rows, rows_per_s, millis, state_rows)."""
        with self._lock:
            return self.spark.createDataFrame(self._batches, SCHEMA)

    def close(self) -> None:
        self.spark.streams.removeListener(self)
