"""Structured Streaming: deduplicated document ingest and windowed query statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_documents(stream: DataFrame, text_col: str = "text", time_col: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The stream with content_hash, each text once within the watermark."""
    return stream.withColumn(time_col, F.col(time_col).cast("timestamp")).withColumn("content_hash", F.md5(F.coalesce(F.col(text_col), F.lit("")))).withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["content_hash"])


def windowed_stats(stream: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Count and mean value per event type and window of event time."""
    out = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(F.window("ts", window), "event_type")
    return out.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean")).select("window.start", "window.end", "event_type", "n", "mean")


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends finished rows as Parquet, exactly once, and stops when the input is used up."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
