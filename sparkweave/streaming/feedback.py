"""Feedback as a stream: rates by hour, with late events up to a bound."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def hourly_rates(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """(hour, events, ctr) of (created_at timestamp, feedback_type)."""
    hit = F.when(F.col("feedback_type").isin("clicked", "selected"), 1.0).otherwise(0.0)
    by = events.withWatermark("created_at", late).groupBy(F.window("created_at", "1 hour").alias("w"))
    return by.agg(F.count("*").alias("events"), F.avg(hit).alias("ctr")).select(F.col("w.start").alias("hour"), "events", "ctr")
