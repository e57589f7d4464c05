"""Progress events as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelflow import schema

KEEPALIVE = ["heartbeat", "pong"]


def clean_events(events: DataFrame) -> DataFrame:
    """Without keep-alive messages and without lines that could not be read."""
    return events.filter(F.col("type").isNotNull() & ~F.col("type").isin(KEEPALIVE))


def read_progress_events(spark: SparkSession, path: str, stream: bool = True) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return clean_events(reader.schema(schema.PROGRESS_EVENT).option("mode", "PERMISSIVE").json(path))
