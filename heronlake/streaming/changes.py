"""The change feed and event windows as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def change_stream(spark: SparkSession, root: str) -> DataFrame:
    """Changes of a database as they are committed: collection, key, kind, version."""
    return spark.readStream.schema("collection string, key string, kind string, version int").option("recursiveFileLookup", "true").parquet(f"{root.rstrip('/')}/changes")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Events by window and type with count and sum of values; rows later than the watermark are left out of a stream."""
    at = F.window("ts", width, slide) if slide else F.window("ts", width)
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(at.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    rows = events.withWatermark("ts", gap) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
