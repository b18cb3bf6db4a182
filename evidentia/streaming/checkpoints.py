"""The checkpoint operators on a stream of events: windowed counts with a watermark, and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of event files; the time is a timestamp with a zone, as watermarks need."""
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_risk(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events and those of medium or high risk by day and checkpoint; events later than ``late`` are left out."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    rows = rows.groupBy(F.window("ts", "1 day").alias("w"), F.col("event_type").alias("checkpoint"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") >= 60).alias("n_risky")).select(F.col("w.start").alias("day"), "checkpoint", "n", "n_risky")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of a user's events with no pause of ``gap`` or longer."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    rows = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n_events"))
    return rows.select("user_id", F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), "n_events")
