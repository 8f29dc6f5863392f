"""Caption-shaped tables: ``media_id``, ``start_ms``, ``end_ms`` and what they carry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as captions: a user is a medium, an event lasts ``value`` seconds from its timestamp."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    start = F.unix_millis(F.col("ts").cast("timestamp"))
    return events.select(
        F.col("user_id").alias("media_id"), "event_id", "event_type", start.alias("start_ms"),
        (start + F.floor(F.col("value") * 1000)).alias("end_ms"),
    )
