"""Counts over a stream: an addition, the same vocabulary counts as a streaming aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, item: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, item, cn of each tumbling window; rows later than `late` are dropped, so that state stays bounded."""
    kept = events.withWatermark(time, late).groupBy(F.window(time, width), item).agg(F.count("*").alias("cn"))
    return kept.select(F.col("window.start").alias("start"), item, "cn")
