"""Text layer: best-of-engines selection per OCR call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow import schema
from panelflow.functions import text as t
from panelflow.functions.values import clamp_confidence, half_even
from panelflow.operators.greedy import FOLD_ROWS, Rule, greedy_lists, placed_rows
from panelflow.operators.regions import rank_of
from panelflow.operators.skew import first_rows, numbered
from panelflow.session import cut

WHOLE_PAGE = -1
PART_ROWS = 10_000
CALL = ["page_id", "region_index"]


def normalize_confidence(df: DataFrame) -> DataFrame:
    """Tesseract rows (conf as text, percent): no-box and blank rows go, bad numbers become 0."""
    kept = df.filter(t.has_text(F.col("text")) & (F.col("conf") != "-1"))
    share = F.coalesce(F.col("conf").try_cast("double") / 100.0, F.lit(0.0))
    return kept.withColumns({"text": t.strip(F.col("text")), "confidence": clamp_confidence(share)}).drop("conf")


def page_position(priority: list[str] | None = None) -> list[Column]:
    """Sort columns top to bottom, then left to right, a missing box counting as (0, 0);
    ties go by confidence, engine and text."""
    return [F.coalesce("y", F.lit(0.0)), F.coalesce("x", F.lit(0.0)), -F.col("confidence"),
            rank_of("engine", priority or schema.OCR_PRIORITY), F.col("text")]


def best_ocr(ocr: DataFrame, overlap: float = 0.5, priority: list[str] | None = None,
             fold_rows: int = FOLD_ROWS, **kw) -> DataFrame:
    """Keep the most confident of overlapping results per call (page_id, region_index), with
    undecided language tags replaced. A whole-page call has region_index null, here -1."""
    lists, hot, columns = _best_lists(ocr, overlap, priority, fold_rows, **kw)
    rows = lists.select(*CALL, F.posexplode("__rows").alias("__pos", "__row"))
    if hot is not None:
        rows = rows.unionByName(hot)
    return _retagged(placed_rows(rows, columns, CALL))


def _best_lists(ocr: DataFrame, overlap: float, priority: list[str] | None, fold_rows: int,
                **kw) -> tuple[DataFrame, DataFrame | None, list[str]]:
    """``greedy_lists`` of OCR results, and the columns of a result."""
    priority = priority or schema.OCR_PRIORITY
    called = ocr.filter(t.has_text(F.col("text"))).withColumn(
        "region_index", F.coalesce("region_index", F.lit(WHOLE_PAGE)))
    rest = ["x", "y", "w", "h", "text", "rotation", "language"]
    no_box = F.col("x").isNull() | F.col("y").isNull() | F.col("w").isNull() | F.col("h").isNull()
    return *greedy_lists(
        called, CALL, [-F.col("confidence"), rank_of("engine", priority), *rest],
        Rule(False, overlap), never=no_box | (F.col("w") * F.col("h") <= 0), fold_rows=fold_rows, **kw), called.columns


def _retagged(rows: DataFrame) -> DataFrame:
    return rows.withColumn("language", t.retag_language(F.col("language"), F.col("text")))


def cap_results(best: DataFrame, n: int = schema.MAX_OCR_REGIONS_PER_CALL) -> DataFrame:
    return first_rows(best, CALL, page_position(), n)


def call_text(best: DataFrame, part_rows: int = PART_ROWS, **kw) -> DataFrame:
    """Joined text of each call in page order, mean confidence, first rotation, kept results.

    Texts are put in order and joined in parts of ``part_rows``, so a call with
    very many results is sorted and joined by many tasks; only its finished
    parts meet. The keyword arguments go to ``numbered``.
    """
    rows = numbered(best, CALL, [*page_position(), F.col("rotation")], "__n", **kw)
    parts = rows.groupBy(*CALL, F.floor((F.col("__n") - 1) / part_rows).alias("__part")).agg(
        F.sort_array(F.collect_list(F.struct("__n", "text"))).alias("__texts"),
        F.sum(F.col("confidence").cast("decimal(30,12)")).alias("__sum"), F.count("*").alias("__rows"),
        F.min_by("rotation", "__n").alias("rotation")
    ).withColumn("__text", F.array_join(F.transform("__texts", lambda p: p["text"]), "\n"))
    return parts.groupBy(*CALL).agg(
        F.sort_array(F.collect_list(F.struct("__part", "__text"))).alias("__texts"),
        half_even(F.sum("__sum").cast("double") / F.sum("__rows"), 4).alias("confidence"),
        F.min_by("rotation", "__part").alias("rotation"),
        F.least(F.sum("__rows"), F.lit(schema.MAX_OCR_REGIONS_PER_CALL)).alias("region_count"),
    ).select(
        *CALL, t.strip(F.array_join(F.transform("__texts", lambda p: p["__text"]), "\n")).alias("text"),
        "confidence", "rotation", "region_count")


def read_calls(ocr: DataFrame, overlap: float = 0.5, priority: list[str] | None = None, fold_rows: int = FOLD_ROWS,
               **kw) -> DataFrame:
    """``call_text`` of ``best_ocr``. The kept results of an ordinary call are one list already, so its text is joined
    there; only calls of more than ``fold_rows`` results are numbered and joined in parts. The keyword arguments go to
    the rounds of hot calls."""
    lists, hot, columns = _best_lists(ocr, overlap, priority, fold_rows, **kw)

    def placed(row: Column) -> Column:
        return F.struct(
            F.coalesce(row["y"], F.lit(0.0)).alias("y"), F.coalesce(row["x"], F.lit(0.0)).alias("x"), (-row["confidence"]).alias("sure"),
            rank_of(row["engine"], schema.OCR_PRIORITY).alias("rank"), row["text"].alias("text"), row["rotation"].alias("rotation"),
            row["confidence"].alias("confidence"))

    read = lists.select(*CALL, F.sort_array(F.transform("__rows", placed)).alias("__rows"))
    shares = F.filter(F.transform("__rows", lambda r: r["confidence"].cast("decimal(30,12)")), lambda c: c.isNotNull())
    # As wide as a list of ``fold_rows`` needs, and no wider: a wider sum would lose digits.
    total = F.aggregate(shares, F.lit(0).cast("decimal(36,12)"), lambda held, c: (held + c).cast("decimal(36,12)"))
    joined = read.select(
        *CALL, t.strip(F.array_join(F.transform("__rows", lambda r: r["text"]), "\n")).alias("text"),
        half_even(F.when(F.exists("__rows", lambda r: r["confidence"].isNotNull()), total).cast("double") / F.size("__rows"), 4).alias("confidence"),
        F.get("__rows", F.lit(0))["rotation"].alias("rotation"),
        F.least(F.size("__rows").cast("long"), F.lit(schema.MAX_OCR_REGIONS_PER_CALL)).alias("region_count"))
    return joined if hot is None else joined.unionByName(call_text(cut(_retagged(placed_rows(hot, columns, CALL)))))


def best_engine(ocr: DataFrame, priority: list[str] | None = None) -> DataFrame:
    """Engine with the highest confidence sum over its non-blank results per call."""
    priority = priority or schema.OCR_PRIORITY
    score = F.sum(F.when(t.has_text(F.col("text")), F.col("confidence")).otherwise(0.0))
    sums = ocr.groupBy(*CALL, "engine").agg(half_even(score, 6).alias("score"))
    return sums.groupBy(*CALL).agg(
        F.max_by("engine", F.struct("score", -rank_of("engine", priority))).alias("engine"), F.max("score").alias("score"))


def ocr_batch_summary(calls: DataFrame) -> DataFrame:
    return calls.agg(
        F.countDistinct("page_id").alias("total_pages"), F.sum("region_count").alias("total_regions"),
        F.coalesce(F.sum("time_ms"), F.lit(0.0)).alias("total_time_ms"),
        F.sort_array(F.collect_set("engine")).alias("engines_used"))
