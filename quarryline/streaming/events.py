"""Streaming forms of two operators, as extensions: first row of a key, and counts in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_of_key(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Drops rows whose key came before, within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def unsafe_share(stream: DataFrame, time: str, unsafe: str, window: str, delay: str) -> DataFrame:
    """Attempts and unsafe ones per event-time window."""
    counts = stream.withWatermark(time, delay).groupBy(F.window(time, window))
    return counts.agg(F.count(F.lit(1)).alias("attempts"), F.sum(F.col(unsafe).cast("long")).alias("unsafe")).select(
        F.col("window.start").alias("start"), "attempts", "unsafe"
    )
