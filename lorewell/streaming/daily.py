"""Incremental daily counts of an interaction stream (an extension: the batch form is operators.statistics.by_day)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(day, event_type, count) of a stream with columns ts and event_type; rows later than `late` after the watermark are dropped by Spark."""
    days = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("count"))
    return days.select(F.to_date("w.start").alias("day"), "event_type", "count")


def start(events: DataFrame, path: str, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """Appends finished days to a Parquet folder."""
    return daily_counts(events, late).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
