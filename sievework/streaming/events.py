"""Event-time operators by Structured Streaming; the same functions take batch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.schemas import struct

EVENTS = struct("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def timed(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """With an event time that watermarks take."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    return rows.withWatermark("at", late)


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums by type and window."""
    grouped = timed(events, late).groupBy(F.window("at", width).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day", late: str = "1 hour") -> DataFrame:
    grouped = timed(events, late).groupBy(F.window("at", width, step).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a user: runs of events less than ``gap`` apart."""
    grouped = timed(events, late).groupBy(F.session_window("at", gap).alias("s"), "user_id")
    return grouped.agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def first_seen(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each key once; a stream forgets keys older than the watermark."""
    rows = timed(events, late)
    return rows.dropDuplicatesWithinWatermark([key]) if rows.isStreaming else rows.dropDuplicates([key])


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; a restart goes on from the checkpoint."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
