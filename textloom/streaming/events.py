"""Windows, sessions and rates over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event id once among those within the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events and total value of each window and type; rows later than the watermark are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    got = timed.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "events", "total")


def sessions(events: DataFrame, gap: str = "4 hours", late: str = "1 hour") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    got = timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events"))
    return got.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
