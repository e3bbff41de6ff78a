"""Windowed counts and deduplication; each works on a batch and on a stream alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(df: DataFrame, at: str, key: str, every: str = "1 day", late: str = "3 days") -> DataFrame:
    """Counts by window and key; rows later than the watermark are dropped from a stream only."""
    timed = df.withColumn("_at", F.col(at).cast("timestamp"))
    timed = timed.withWatermark("_at", late) if df.isStreaming else timed
    return timed.groupBy(F.window("_at", every).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("starts"), key, "n")


def distinct_signals(df: DataFrame, key: str, at: str, late: str = "14 days") -> DataFrame:
    """One row an id; a stream remembers ids as long as the watermark allows."""
    if not df.isStreaming:
        return df.dropDuplicates([key])
    return df.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late).dropDuplicatesWithinWatermark([key]).drop("_at")
