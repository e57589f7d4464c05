"""Progress-event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from panelflow.functions.values import half_even, mean


def bounded(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Drop repeated events; events later than the delay are ignored, which bounds the state."""
    keys = [c for c in ("job_id", "type", "timestamp", "page_number", "bubble_index", "event_id") if c in events.columns]
    return events.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(keys)


def job_room(events: DataFrame, job_id=None) -> DataFrame:
    """Events of one job, or of all."""
    return events if job_id is None else events.filter(F.col("job_id") == job_id)


def page_throughput(events: DataFrame, width: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Pages, mean milliseconds and bubbles per job and tumbling window."""
    pages = events.filter("type = 'page_processed'")
    if pages.isStreaming:
        pages = pages.withWatermark("timestamp", delay)
    return pages.groupBy(F.window("timestamp", width), "job_id").agg(
        F.count("*").alias("pages"), half_even(mean(F.col("processing_time_ms")), 2).alias("mean_ms"),
        F.sum("bubbles_detected").alias("bubbles")).select(
        F.col("window.start").alias("window_start"), "job_id", "pages", "mean_ms", "bubbles")


def resource_windows(snapshots: DataFrame, width: str = "30 minutes", slide: str = "1 minute",
                     delay: str = "10 minutes") -> DataFrame:
    """Trailing mean and maximum per host over sliding windows."""
    if snapshots.isStreaming:
        snapshots = snapshots.withWatermark("ts", delay)
    return snapshots.groupBy(F.window("ts", width, slide), "host").agg(
        half_even(mean(F.col("cpu_percent")), 1).alias("avg_cpu"), half_even(mean(F.col("ram_used_mb")), 1).alias("avg_ram_mb"),
        F.max("ram_used_mb").alias("max_ram_mb"), F.count("*").alias("samples")).select(
        F.col("window.end").alias("window_end"), "host", "avg_cpu", "avg_ram_mb", "max_ram_mb", "samples")


def activity_spans(events: DataFrame, gap: str = "30 seconds", delay: str = "10 minutes") -> DataFrame:
    """Spans of activity per job; a job is idle from the end of one span to the next."""
    if events.isStreaming:
        events = events.withWatermark("timestamp", delay)
    return events.groupBy(F.session_window("timestamp", gap), "job_id").agg(F.count("*").alias("events")).select(
        "job_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("idle_since"), "events")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there into parquet files and stop. With the same checkpoint a later call
    goes on where this one ended, also after a crash."""
    query = df.writeStream.outputMode(mode).format("parquet").option("path", path).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_batches(df: DataFrame, each, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there with ``each(batch, batch_id)`` and stop."""
    query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each).trigger(
        availableNow=True).start()
    query.awaitTermination()
    return query


run_resumable = run_available


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table of a folder as a stream, be it one file or a folder of files."""
    kind = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # A pattern, because Spark takes a plain path for the base folder, which a single file cannot be.
    return spark.readStream.schema(kind).parquet(f"{folder}/{name}[.]parquet")
