"""Event-time aggregation of a stream of arriving rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, keys: list[str], value: str, size: str, late: str, slide: str | None = None) -> DataFrame:
    """(window_start, keys, n, total) of tumbling or sliding windows; rows later than the watermark are dropped by a stream.

    The same plan serves a stream and a batch.
    """
    window = F.window(time, size, slide) if slide else F.window(time, size)
    grouped = events.withWatermark(time, late).groupBy(window.alias("w"), *keys)
    return grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """(session_start, session_end, keys, n) of runs of events with no gap of that length."""
    grouped = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys)
    return grouped.agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def first_arrivals(events: DataFrame, time: str, key: str, late: str) -> DataFrame:
    """Each key once within the watermark, as it first arrives."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
