"""Replaying a stream of writes into current state.

A late write never beats a newer one: the order is that of seq, not of arrival.  Removed keys
stay in the state as tombstones, else a late older write would bring them back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loamgraph.operators import changelog
from loamgraph.operators.store import Store


def streaming_latest(log: DataFrame) -> DataFrame:
    """(k, seq, op, v): newest write of each key of a streaming log; for the output modes complete and update."""
    return changelog.latest(log)


def streaming_updates(log: DataFrame) -> DataFrame:
    """(k, seq, op, v) of the keys whose newest write has changed, in update mode.

    The state of a key is its newest write.  Keys and values are text.
    """
    schema = "k string, seq bigint, op string, v string"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old: Any = state.get if state.exists else None
        top = old
        for pdf in batches:
            if len(pdf):
                at = int(pdf["seq"].to_numpy(np.int64).argmax())
                if top is None or pdf["seq"].iat[at] > top[0]:
                    v = pdf["v"].iat[at]
                    top = (int(pdf["seq"].iat[at]), pdf["op"].iat[at], None if pd.isna(v) else v)
        if top is not None and top != old:
            state.update(top)
            yield pd.DataFrame([(key[0], *top)], columns=["k", "seq", "op", "v"])

    rows = log.select(F.col("k").cast("string").alias("k"), "seq", "op", F.col("v").cast("string").alias("v")).where("k IS NOT NULL AND seq IS NOT NULL")
    return rows.groupBy("k").applyInPandasWithState(step, schema, "seq bigint, op string, v string", "update", GroupStateTimeout.NoTimeout)


def into_store(log: DataFrame, store: Store, checkpoint: str) -> Callable[[], StreamingQuery]:
    """A query that appends each micro-batch to the store in the order of seq.

    Levels that have grown too large are compacted on the way, so what a batch rewrites does not grow
    with the whole log; tombstones stay, since an older write may still arrive.  A micro-batch that is run
    again after a failure changes nothing, as its writes have the same seq.  Returns what starts the query.
    """

    def write(batch: DataFrame, number: int) -> None:
        store.append_log(batch)
        while store.compact_step(keep_tombstones=True) is not None:
            pass

    return lambda: log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def throughput(events: DataFrame, ts: str, every: str = "1 hour", late: str | None = None) -> DataFrame:
    """(start, n) per interval of time, batch or stream; ``late`` is the watermark of a stream."""
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(F.window(ts, every).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")
