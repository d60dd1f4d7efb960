"""Captures as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def arrival_counts(stream: DataFrame, at: str, key: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows per window and key of a stream; rows later than ``late`` behind the newest are dropped with their window's state."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
