"""Extension: event-time aggregation and deduplication over streams (the batch operators need neither)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, at: str, by: list[str], width: str, late: str, value: str) -> DataFrame:
    """Counts and sums per tumbling window and key; rows later than ``late`` behind the watermark are left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, at: str, by: list[str], gap: str, late: str) -> DataFrame:
    """Sessions of a key: runs of events without a gap."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def first_seen(events: DataFrame, at: str, keys: list[str], late: str) -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
