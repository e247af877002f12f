"""Structured Streaming forms of batch operators; an extension, the batch results are the measure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Parquet files of a folder as a stream, one file a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 day", late: str = "7 days") -> DataFrame:
    """Rows per key and window; rows later than ``late`` are dropped with their window's state."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def first_arrivals(stream: DataFrame, key: list[str], time: str, late: str = "7 days") -> DataFrame:
    """Each key's first row within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)
