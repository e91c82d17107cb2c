"""Bursts of events: a trailing debounce as session windows, in batch and in streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GAP_MS = 60


def bursts(events: DataFrame, gap: str, key: str = "user_id", time: str = "ts", late: str | None = None) -> DataFrame:
    """One row for each burst of a key: its start, its last event and the number of events.

    A burst ends when no event comes for ``gap``. With ``late``, a stream forgets bursts that
    ended so long ago (its watermark), and drops events that come later still.
    """
    e = events.withWatermark(time, late) if late else events
    w = e.groupBy(F.col(key), F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"), F.max(time).alias("last"))
    return w.select(key, F.col("w.start").alias("start"), "last", "n")


def watch(spark: SparkSession, path: str, schema: str, gap: str, late: str, key: str = "user_id") -> DataFrame:
    """Bursts over files that appear in a folder; write with ``writeStream`` in append mode."""
    return bursts(spark.readStream.schema(schema).parquet(path), gap, key, late=late)


def windows(events: DataFrame, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts and sums by event type in fixed windows of event time."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
