"""Trailing sender counts on a stream: sliding windows behind a watermark.

A sliding window approximates the trailing frame; the exact count is the batch
operator ``boards.sender_rate``. Rows later than the watermark are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def sender_windows(events: DataFrame, sender: str, ts: str, length: str = "1 hour", slide: str = "10 minutes",
                   late: str = "1 day") -> DataFrame:
    """Rows per sender and window. The same plan runs on a batch, where the watermark is ignored."""
    return (events.withWatermark(ts, late).groupBy(F.window(ts, length, slide), F.col(sender))
            .agg(F.count("*").cast("int").alias("n"))
            .select(F.col("window.start").alias("starts_at"), F.col("window.end").alias("ends_at"), sender, "n"))
