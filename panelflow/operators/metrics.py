"""Requests, resource snapshots and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow import schema
from panelflow.operators.skew import first_rows
from panelflow.functions.values import half_even, mean


def slow_requests(requests: DataFrame, ms: float = 1000.0) -> DataFrame:
    """Requests slower than the limit, without health, info and static paths."""
    path = F.col("path")
    return requests.filter((F.col("duration_ms") > ms) & ~path.isin(schema.UNPROFILED_PATHS) & ~path.startswith("/static/"))


def memory_warnings(snapshots: DataFrame, ram_mb: float = 1024.0) -> DataFrame:
    return snapshots.filter(F.col("ram_used_mb") > ram_mb)


def memory_heavy_requests(requests: DataFrame, delta_mb: float = 50.0) -> DataFrame:
    return requests.filter(F.col("memory_delta_mb") > delta_mb)


def resource_summary(snapshots: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means, maximum, sample count, span and the latest sample (per host when ``by`` is given)."""
    span = half_even(F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")) / 1e6, 0).cast("long")
    latest = F.struct("ts", "id")
    return snapshots.groupBy(*(by or [])).agg(
        half_even(mean(F.col("cpu_percent")), 1).alias("avg_cpu"), half_even(mean(F.col("ram_used_mb")), 1).alias("avg_ram_mb"),
        half_even(F.max("ram_used_mb"), 1).alias("max_ram_mb"), F.count("*").alias("samples"),
        span.alias("span_seconds"),
        F.max_by("cpu_percent", latest).alias("current_cpu"), F.max_by("ram_used_mb", latest).alias("current_ram_mb"))


def recent_snapshots(snapshots: DataFrame, now: Column, seconds: int = 60, keep: int = 360,
                     host: str = "host") -> DataFrame:
    """Samples of the last seconds among the newest ``keep`` of each host."""
    newest = first_rows(snapshots, [host], [F.col("ts").desc(), F.col("id").desc()], keep)
    return newest.filter(F.col("ts") >= now - F.make_dt_interval(secs=F.lit(seconds)))


def filter_logs(logs: DataFrame, level: str | None = None, search: str | None = None) -> DataFrame:
    """Lines of one level with a text in message or module, ignoring case."""
    if level and level != "all":
        logs = logs.filter(F.col("level") == level)
    if search:
        term = search.lower()
        logs = logs.filter(F.lower("message").contains(term) | F.lower("module").contains(term))
    return logs


def log_lines(logs: DataFrame) -> DataFrame:
    """One text line per entry, in export format."""
    return logs.select(F.format_string(
        "[%s] [%s] [%s] %s", F.col("timestamp").cast("string"), "level", "module", "message").alias("value"))
