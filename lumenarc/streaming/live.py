"""Streams: pages not seen before and counters over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(pages: DataFrame, key: str = "url", time: str = "seen_at", keep: str = "30 days") -> DataFrame:
    """Each key once; keys are remembered as long as late rows may come."""
    return pages.withWatermark(time, keep).dropDuplicatesWithinWatermark([key])


def counts(events: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "5 minutes", by: str = "event_type") -> DataFrame:
    """Counts and sums by event-time window; rows later than `late` are left out."""
    windows = events.withWatermark(time, late).groupBy(F.window(time, width), by)
    return windows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")
