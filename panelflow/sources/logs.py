"""Application logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelflow.operators.metrics import log_lines

# Fixed value: "time - module - level - message".
LINE = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(?:,\d+)?) - (.+?) - ([A-Z]+) - (.*)$"


def parse_log_lines(lines: DataFrame) -> DataFrame:
    """timestamp, module, level, message; other lines stay whole as message with null level."""
    v = F.col("value")
    hit = v.rlike(LINE)

    def part(i: int):
        return F.when(hit, F.regexp_extract(v, LINE, i))

    return lines.select(
        F.to_timestamp_ntz(F.replace(part(1), F.lit(","), F.lit("."))).alias("timestamp"),
        part(2).alias("module"), part(3).alias("level"), F.coalesce(part(4), v).alias("message"))


def read_logs(spark: SparkSession, glob: str) -> DataFrame:
    """A log file and its rotations, for example 'logs/*.log*'."""
    return parse_log_lines(spark.read.text(glob))


def export_logs(logs: DataFrame, path: str) -> None:
    log_lines(logs).write.mode("overwrite").text(path)
