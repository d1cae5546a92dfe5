"""Validation of streams: contract checks per micro-batch, and violation rates by event-time window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pactlake.contract import Contract
from pactlake.operators.checks import validate


def windowed_rate(events: DataFrame, ts: str, bad: Column, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """window_start, total, bad, rate by event time; the same for tables and, with a watermark, for streams."""
    rows = events.withWatermark(ts, late) if late else events
    out = rows.groupBy(F.window(ts, width)).agg(F.count("*").alias("total"), F.count_if(bad).alias("bad"))
    return out.select(F.col("window.start").alias("window_start"), "total", "bad", (F.col("bad") / F.col("total")).alias("rate"))


def validate_stream(stream: DataFrame, contract: Contract, sink: Callable[[DataFrame, int], None], checkpoint: str, **options) -> StreamingQuery:
    """Run the contract on each micro-batch; sink(results, batch_id) gets one row a check."""

    def each(batch: DataFrame, batch_id: int) -> None:
        sink(validate(batch, contract).withColumn("batch_id", F.lit(batch_id)), batch_id)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).options(**options).trigger(availableNow=True).start()
