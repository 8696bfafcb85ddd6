"""Windowed audit of events, for tables and for streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def audit(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and mean values for each window and type; late rows of a stream are dropped by the watermark."""
    # a watermark needs timestamps of the session's zone
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    got = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))
    return got.select(F.col("w.start").alias("start"), "event_type", "n", "mean_value")
