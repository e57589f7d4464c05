"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelflow.operators.skew import sized_broadcast
from panelflow.session import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
KEY_SLICES = 256
TIME_SLICES = 1024


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Targets of sources: (source, source_size) to (source, source_size, source_rank, target double).

    Sources in code-point order, null last, weigh ``weights``, repeating, and share the sum of all sizes. No target
    is above ``most`` times its source's size; the excess goes to the others by weight. In order of size per weight
    the capped sources come first, so the common level is the largest one that stays under its own source's cap.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    by_ratio = W.orderBy("ratio", "source_rank")
    all_rows = by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    w = sizes.withColumn("source_rank", F.row_number().over(order)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]),
                               ((F.col("source_rank") - 1) % len(weights) + 1).cast("int")))
    w = w.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    total = F.sum("source_size").over(all_rows)
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing))
    w = w.withColumn("level", (total - before) / rest)
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(all_rows)
    return w.select("source", "source_size", "source_rank",
                    F.least(F.col("cap").cast("double"), level * F.col("weight")).alias("target"))


def _positions(rows: DataFrame, sums: DataFrame, source: str, names: dict[str, str]) -> DataFrame:
    """Rows with their source's target and their running size within the shuffled source."""
    size, key, piece, rank, run = (names[k] for k in ("size", "key", "slice", "rank", "run"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")))
    earlier = W.partitionBy("source").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("source", "piece", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # One small row per source and slice; within a slice only that slice's rows are ordered.
    within = W.partitionBy(source, piece).orderBy(key, *names["ties"]).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn(run, F.sum(size).over(within))
    starts = starts.alias("p")
    rows = rows.join(starts, rows[source].eqNullSafe(F.col("p.source")) & (rows[piece] == F.col("p.piece"))).select(
        *[rows[c] for c in rows.columns if c != run], (F.col("p.before") + rows[run]).alias(run))
    few = sized_broadcast(targets).alias("t")
    rows = rows.join(few, rows[source].eqNullSafe(F.col("t.source"))).select(
        *[rows[c] for c in rows.columns], F.col("t.source_size").alias(names["source_size"]),
        F.col("t.target").alias(names["target"]), F.col("t.source_rank").alias(rank))
    return rows


def mix_sources(segments: DataFrame, id: str = "id", text: str = "original_text", source: str = "project_id",
                seed: str = "", keep: bool = False) -> DataFrame:
    """How much of every segment a mix of sources takes: (id, size, source_size, target, taken).

    A segment's size is its number of words. Within a source, segments are shuffled by the MD5 of their id, and up
    to three passes over the source are queued. A segment's virtual finish time is the source's size up to and with
    it, divided by the source's target. All passes of all sources are sorted by that time over ranges of it, and the
    queue is cut where it reaches the sum of all sizes. taken is the size times the passes before the cut, so whole
    texts only, at most three times the size. The same rows give the same mix in every run (``seed`` gives another).

    A null text has size 0 and nothing taken; a null source is a source of its own, ordered last; null ids share one
    place in the shuffle and repeated rows are taken one after the other. Without rows there is no result row.
    With ``keep`` the segments' own columns are returned instead, each row as many times as it is taken; other
    columns never matter.
    """
    own = segments.columns
    names = {k: f"__mix_{k}" for k in ("size", "key", "slice", "rank", "run", "source_size", "target", "source", "id")}
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id).cast("string"), F.lit(""))))
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    piece = F.floor(F.conv(F.substring(names["key"], 1, 4), 16, 10).cast("long") * KEY_SLICES / 65536)
    rows = segments.select(*(own if keep else []), F.col(id).alias(names["id"]), F.col(source).alias(names["source"]),
                           size.alias(names["size"]), key.alias(names["key"])).withColumn(names["slice"], piece)
    rows = rows if keep else cut(rows)
    narrow = cut(rows.select(*[names[k] for k in ("source", "size", "key", "slice")])) if keep else rows
    places = {**names, "ties": [names["size"]]}
    sums = narrow.groupBy(F.col(names["source"]).alias("source"), F.col(names["slice"]).alias("piece")).agg(
        F.sum(names["size"]).alias("n"))
    sums = cut(sums)
    rows, narrow = (_positions(r, sums, names["source"], places) for r in (rows, narrow))

    n, run, whole, target = (F.col(names[k]) for k in ("size", "run", "source_size", "target"))

    def time(turn: Column | int) -> Column:
        return (turn * whole + run).cast("double") / target

    turns = narrow.filter((n > 0) & (target > 0)).select(
        n.alias("size"), whole, run, target, F.col(names["rank"]).alias("rank"), F.col(names["key"]).alias("key"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(MOST_COPIES - 1).cast("long"))).alias("turn"))
    turns = turns.select("size", "rank", "key", "turn", time(F.col("turn")).alias("time")).withColumn(
        "span", F.floor(F.col("time") * TIME_SLICES))
    spans = turns.groupBy("span").agg(F.sum("size").alias("n"))
    up_to = W.orderBy("span").rowsBetween(W.unboundedPreceding, W.currentRow)
    budget = narrow.agg(F.sum(n)).first()[0] or 0
    crossing = (spans.withColumn("end", F.sum("n").over(up_to)).filter(F.col("end") > budget).orderBy("span").limit(1)
                .select("span", (F.col("end") - F.col("n")).alias("start")))
    order = ("time", "rank", "key")
    inside = turns.join(F.broadcast(crossing), "span").withColumn(
        "queued", F.col("start") + F.sum("size").over(W.partitionBy("span").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)))
    # The first place of the queue that is not taken: one row.
    end = inside.filter(F.col("queued") > budget).agg(F.min(F.struct(*order)).alias("end")).first()["end"]

    def taken_in(turn: int) -> Column:
        place = F.struct(time(turn).alias("time"), F.col(names["rank"]).alias("rank"), F.col(names["key"]).alias("key"))
        if end is None:
            return F.lit(1)
        last = F.struct(F.lit(end["time"]).alias("time"), F.lit(end["rank"]).alias("rank"), F.lit(end["key"]).alias("key"))
        return (place < last).cast("long")

    copies = F.when((n > 0) & (target > 0), sum((taken_in(t) for t in range(MOST_COPIES)), F.lit(0))).otherwise(0)
    if keep:
        return rows.select(*own, F.explode(F.array_repeat(F.lit(1), copies.cast("int"))).alias("__copy")).drop("__copy")
    return rows.select(F.col(names["id"]).alias("id"), n.alias("size"), whole.alias("source_size"),
                       target.alias("target"), (n * copies).cast("long").alias("taken"))
