"""Ways to keep one huge group from landing in one task.

Plain windows and joins send every row of a key to one place. The helpers here
first count rows per key (map-side combined, key columns only). Keys under the
limit take the plain plan; the few keys above it are split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelflow.session import cut

HOT_ROWS = 1_000_000
BROADCAST_ROWS = 10_000
SALTS = 32


def hot_keys(df: DataFrame, keys: list[str], limit: int) -> DataFrame | None:
    """Keys holding more than ``limit`` rows, or None when there are none. Several key columns are counted only
    where the first alone holds so many: its values are fewer, so there is less to shuffle."""
    if len(keys) > 1 and hot_keys(df, keys[:1], limit) is None:
        return None
    heavy = df.groupBy(*keys).count().filter(F.col("count") > limit).select(*keys)
    return None if heavy.isEmpty() else cut(heavy)


def split_hot(df: DataFrame, keys: list[str], limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary keys, and rows of hot keys (None when there are none)."""
    heavy = hot_keys(df, keys, limit)
    if heavy is None:
        return df, None
    heavy = sized_broadcast(heavy.select(*[F.col(k).alias(f"__h_{k}") for k in keys]))
    same = [F.col(k).eqNullSafe(F.col(f"__h_{k}")) for k in keys]
    return df.join(heavy, same, "left_anti"), df.join(heavy, same, "left_semi")


def sized_broadcast(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only after counting at most ``rows`` rows; else the planner decides."""
    fits = small.limit(rows + 1).count() <= rows
    return F.broadcast(small) if fits else small


def salted_lookup(left: DataFrame, right: DataFrame, keys: list[str], salts: int = SALTS) -> DataFrame:
    """Left join to a table with one row per key when left keys are very uneven:
    each right row is repeated per salt, so a hot key's left rows spread over tasks."""
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "__salt"], "left").drop("__salt")


def running(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    totals: dict[str, Column],
    hot_rows: int | None = HOT_ROWS,
    pieces: int | None = None,
) -> DataFrame:
    """Running sums per key in the given order, current row included.

    ``hot_rows=None`` skips the count, for rows whose keys are known to be bounded.

    ``row number`` is the running sum of 1. Hot keys are range-split on the
    order, summed per piece, and each piece continues from the sum of the
    pieces before it; only per-piece sums ever meet in one group.
    """
    normal, hot = (df, None) if hot_rows is None else split_hot(df, keys, hot_rows)
    window = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = normal.select("*", *[F.sum(c).over(window).alias(n) for n, c in totals.items()])
    if hot is None:
        return out
    # After the checkpoint a row keeps its id, so equal order values still split.
    hot = cut(hot.select("*", *[c.alias(f"__v_{n}") for n, c in totals.items()]))
    hot = hot.withColumn("__id", F.monotonically_increasing_id())
    by = [*order, F.col("__id")]
    ranged = hot.repartitionByRange(pieces, *keys, *by) if pieces else hot.repartitionByRange(*keys, *by)
    ranged = cut(ranged.withColumn("__piece", F.spark_partition_id()))
    sums = ranged.groupBy(*keys, "__piece").agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in totals])
    earlier = W.partitionBy(*keys).orderBy("__piece").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select(
        *keys, "__piece", *[F.sum(f"__s_{n}").over(earlier).alias(f"__b_{n}") for n in totals]
    )
    within = W.partitionBy(*keys, "__piece").orderBy(*by).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = ranged.select("*", *[F.sum(f"__v_{n}").over(within).alias(f"__l_{n}") for n in totals])
    joined = local.alias("l").join(
        before.alias("b"),
        [F.col("l.__piece") == F.col("b.__piece")] + [F.col(f"l.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys],
        "left",
    )
    done = joined.select(
        *[F.col(f"l.{c}") for c in df.columns],
        *[(F.coalesce(F.col(f"b.__b_{n}"), F.lit(0)) + F.col(f"l.__l_{n}")).alias(n) for n in totals],
    )
    return out.unionByName(done)


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "rn", **kw) -> DataFrame:
    """Row numbers 1..n per key (long)."""
    return running(df, keys, order, {name: F.lit(1).cast("long")}, **kw)


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First n rows per key. The rank filter lets Spark cut every map task's
    rows to n per key before the shuffle, so a hot key never arrives whole.
    Spark does so up to a session limit, which ``session.tune`` sets."""
    ranked = df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("__rn") <= n).drop("__rn")
