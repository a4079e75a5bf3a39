"""Event-time roll-ups, an extension: batch tables and streams take the same path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, length: str, late: str = "10 minutes") -> DataFrame:
    """Count and sum of values per event type and window; rows later than `late` are left out of a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
