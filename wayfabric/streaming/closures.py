"""Streaming extension: windowed counts of closure events, late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closure_rates(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """Rows (start, kind, n, total) per tumbling window of a batch or a stream with (ts, event_type, value)."""
    timed = events.withColumn("_t", F.col(ts).cast("timestamp"))
    timed = timed.withWatermark("_t", late) if events.isStreaming else timed
    grouped = timed.groupBy(F.window("_t", window).alias("w"), F.col(kind).alias("kind"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "kind", "n", "total")
