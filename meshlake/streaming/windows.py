"""Mergeable statistics over event time, as Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_stats(stream: DataFrame, time: str, value: str, by: str, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """min, max, count and sum of ``value`` per tumbling window and group.

    State is one row per open window and group; rows later than ``delay`` are dropped, and a window
    is emitted once, when the watermark has passed its end.
    """
    timed = stream.withWatermark(time, delay)
    out = timed.groupBy(F.window(time, width), by).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), by, "low", "high", "n", "total")


def first_seen(stream: DataFrame, time: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """Rows whose ``keys`` were not seen within the watermark; state is bounded by the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def drained(stream: DataFrame, shared: str, name: str) -> DataFrame:
    """Run ``stream`` over all that its source has now, into a Parquet table of the shared folder, and read it.

    Progress and state are kept beside the table, so a lost driver or executor takes up where it was.
    """
    at = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start(f"{at}/rows")
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/rows")
