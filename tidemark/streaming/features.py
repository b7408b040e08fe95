"""Structured Streaming: windowed mention counts, late duplicates, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def timed(rows: DataFrame, delay: str) -> DataFrame:
    """With a watermark; it needs a timestamp with time zone."""
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Mentions of each source in tumbling or sliding windows, in batch and in streams."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    counts = timed(events, delay).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def without_repeats(events: DataFrame, key: str = "event_id", delay: str = "10 minutes") -> DataFrame:
    """Each key once, as long as its repeats arrive within the watermark."""
    return timed(events, delay).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    grouped = timed(events, delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_once(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed windows as Parquet and stop when the input is used up."""
    return counts.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
