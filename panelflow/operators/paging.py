"""An order-statistics index for listings: page k reads only the range that holds it.

The rows are written once in ranges of the sort key, with the number of rows of each range. A page adds those numbers up
to its offset and reads the one or two ranges it falls into, instead of sorting all rows before it again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANGES = 256
_PLACE = ("range", "at")


def write_listing(df: DataFrame, order: list[Column], path: str, ranges: int = RANGES) -> None:
    """Write rows for paging in the given order, which must tell all rows apart (end it with the id).

    Rows are range-partitioned by a sample of the key, so a range has about the same number of rows whatever the key's
    distribution; a key of one value is split by what follows it in the order. Columns ``range`` and ``at`` are taken.
    """
    ranged = df.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id())
    # Within a range, rows are numbered from 0; each range is one file.
    placed = ranged.withColumn("at", F.row_number().over(W.partitionBy("range").orderBy(*order)) - 1)
    placed.write.mode("overwrite").partitionBy("range").parquet(f"{path}/rows")
    held = df.sparkSession.read.parquet(f"{path}/rows").groupBy("range").agg(F.count("*").alias("n"))
    held.coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges")


def listing_info(spark: SparkSession, path: str, limit: int, offset: int = 0) -> DataFrame:
    """One row with total and has_more, from the ranges' counts alone."""
    return spark.read.parquet(f"{path}/ranges").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).select(
        "total", F.lit(limit).alias("limit"), F.lit(offset).alias("offset"), (F.lit(offset + limit) < F.col("total")).alias("has_more"))


def listing_page(spark: SparkSession, path: str, limit: int, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of the listing, in order.

    The counts of the ranges, at most as many small rows as there are ranges, are added up by the driver; the rows come
    from the files of the ranges the page falls into and are picked by their number, without a sort of the range.
    """
    if limit < 1 or offset < 0:
        raise ValueError("limit starts at 1 and offset is not negative")
    rows = spark.read.parquet(f"{path}/rows")
    before, wanted = 0, []
    for number, n in sorted((r["range"], r["n"]) for r in spark.read.parquet(f"{path}/ranges").collect()):
        first, last = max(offset - before, 0), min(offset + limit - before, n)
        if first < last:
            wanted.append((number, first, last))
        before += n
    columns = [c for c in rows.columns if c not in _PLACE]
    if not wanted:
        return rows.limit(0).select(*columns)
    picked = F.lit(False)
    for number, first, last in wanted:
        picked = picked | ((F.col("range") == number) & (F.col("at") >= first) & (F.col("at") < last))
    # The ranges by name, so that files of others are never opened.
    return rows.filter(F.col("range").isin([w[0] for w in wanted]) & picked).orderBy(*_PLACE).select(*columns)
