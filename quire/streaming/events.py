"""Streams of edits and statuses (extras: the inventory has no streaming).

State is bounded by the watermark in windowed counts, and by the number of projects in the latest status.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def source(spark, path: str, schema) -> DataFrame:
    """A stream over a folder of Parquet files."""
    return spark.readStream.schema(schema).parquet(path)


def windowed_counts(events: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by window and type; rows later than `late` are left out."""
    at = events.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    return at.groupBy(F.window("_at", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def latest_status(events: DataFrame, key: str = "user_id") -> DataFrame:
    """The last event of each key (X10 on a stream): an update mode aggregate of one row a key."""
    last = F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id"))
    return events.groupBy(key).agg(last.alias("last")).select(key, "last.event_id", "last.event_type")
