"""Sequences of streamed events: gaps and order by key, with state between micro-batches.

For each key the greatest number seen so far is state. Numbers of a micro-batch are taken in order: one that doesn't follow its
predecessor by one is a `gap`, one at or below the state is out of `order` and moves nothing. Rows later than the watermark are
dropped by Spark; a key without rows for `idle` of event time is `closed`, which frees its state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pactlake.operators.lineage import shared_dir


def sequence_breaks(events: DataFrame, key: str, seq: str, ts: str, delay: str = "1 hour", idle_seconds: int = 3600) -> DataFrame:
    """A stream (key, seq, ts, ...) -> key, kind (gap, order, closed), seq, step: the distance to the number before; closed ones have the
    last number and how many there were."""
    kind = dict(events.dtypes)[key]
    rows = events.select(F.col(key).alias("key"), F.col(seq).cast("long").alias("seq"), F.col(ts).cast("timestamp").alias("ts")).where("key IS NOT NULL AND seq IS NOT NULL AND ts IS NOT NULL")

    def follow(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = lambda kind, numbers, steps: pd.DataFrame({"key": k[0], "kind": kind, "seq": numbers, "step": steps})
        if state.hasTimedOut:
            last, n = state.get
            state.remove()
            yield out("closed", [last], [n])
            return
        slim = [(p["seq"].to_numpy(np.int64), p["ts"].max()) for p in parts]
        numbers = np.sort(np.concatenate([s for s, _ in slim]))
        last, n = state.get if state.exists else (None, 0)
        behind = numbers[:0] if last is None else numbers[numbers <= last]
        if len(behind):
            yield out("order", behind, behind - last)
        ahead = numbers[len(behind) :]
        if len(ahead):
            before = np.concatenate([[ahead[0] - 1 if last is None else last], ahead[:-1]])
            steps = ahead - before
            if (steps != 1).any():
                yield out("gap", ahead[steps != 1], steps[steps != 1])
            last = int(ahead[-1])
        state.update((last, n + len(numbers)))
        until = int(max(t for _, t in slim).timestamp() * 1000) + idle_seconds * 1000
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))

    grouped = rows.withWatermark("ts", delay).groupBy("key")
    return grouped.applyInPandasWithState(follow, f"key {kind}, kind string, seq long, step long", "last long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """What a stream yields over all that is there now, as a table of the shared folder."""
    import uuid

    path = f"{shared_dir(stream.sparkSession)}/pactlake-{name}-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")
