"""Latency of requests as they arrive: an extension, as there is no streaming to match."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """New Parquet files of a folder, a bounded number at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(path)


def windowed(events: DataFrame, ts: str = "ts", kind: str = "event_type", value: str = "value", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, sum and largest value by window and kind; rows later than the watermark are dropped, so state is bounded."""
    return (
        events.withWatermark(ts, late).groupBy(F.window(ts, width), kind)
        .agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("largest"))
        .select(F.col("window.start").alias("start"), kind, "n", "total", "largest")
    )
