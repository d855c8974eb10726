"""Windowed counts and sessions over an event stream; the same functions serve batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(df: DataFrame, ts: str, keys: list[str], value: str, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums in tumbling or sliding windows; rows later than ``late`` are dropped
    by a stream and kept by a batch."""
    if df.isStreaming:
        df = df.withWatermark(ts, late)
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = df.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def sessions(df: DataFrame, ts: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Runs of a key's events with no pause as long as ``gap``."""
    if df.isStreaming:
        df = df.withWatermark(ts, late)
    out = df.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def deduplicated(df: DataFrame, ts: str, key: str, late: str = "10 minutes") -> DataFrame:
    """First event of each key; a stream forgets keys once the watermark has passed."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark([key]) if df.isStreaming else df.dropDuplicates([key])
