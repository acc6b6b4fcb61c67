"""Windowed aggregates that run alike over tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, late: str | None = None) -> DataFrame:
    """events with a proper timestamp, and for streams a watermark."""
    out = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return out.withWatermark("ts", late) if late else out


def windowed(events: DataFrame, length: str, slide: str | None = None, by: str = "event_type") -> DataFrame:
    """window_start, by, n, value: tumbling windows, or sliding ones."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = events.groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return out.select(F.col("w.start").alias("window_start"), by, "n", "value")


def sessions(events: DataFrame, gap: str, by: str = "user_id") -> DataFrame:
    """by, session_start, session_end, n: runs of events less than a gap apart."""
    out = events.groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return out.select(by, F.col("w.start").alias("session_start"), F.col("last").alias("session_end"), "n")
