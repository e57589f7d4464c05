"""The whole page workflow as one job over all pages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow import schema
from panelflow.operators import catalog as C
from panelflow.operators import jobs as J
from panelflow.operators import ocr as O
from panelflow.operators import regions as R
from panelflow.operators import translate as X
from panelflow.session import cut


@dataclass
class Localized:
    regions: DataFrame
    calls: DataFrame
    segments: DataFrame
    bubbles: DataFrame
    page_status: DataFrame
    learned: DataFrame
    jobs: DataFrame


def run_engine(pages: DataFrame, engine, out) -> DataFrame:
    """A detector or OCR engine supplied by the user: a batch function from page rows to region rows."""
    return pages.mapInPandas(engine, out)


def localize_corpus(raw: DataFrame, pages: DataFrame, ocr: Callable[[DataFrame], DataFrame], memory: DataFrame,
                    provider: X.Provider, now: Column, fallback: DataFrame | None = None, failed: DataFrame | None = None,
                    ties: list[Column] | None = None, **kw) -> Localized:
    """Detect, merge and order regions; read, translate and align their texts; report each page and job.

    pages: page_id, job_id, source_language, target_language, context. ``ocr`` turns ordered
    regions (page_id, region_index, box) into engine results per call. ``failed`` lists pages (page_id)
    given up after their retries: they are not translated, and their job counts them. ``ties`` goes to ``reading_order``.
    """
    kept = R.filter_regions(raw)
    if fallback is not None:
        kept = R.with_fallback(kept, fallback)
    merged = R.reading_order(R.merge_regions(kept, position="merge_rank"), ties=ties, hot_rows=None)
    given = [F.lit(None).cast(k).alias(c) for c, k in (("text_prompt", "string"), ("time_ms", "double")) if c not in merged.columns]
    # Read by OCR, bubbles and page status: written once, without the JSON texts, which bubbles alone have.
    regions = cut(merged.select("*", *given).withColumn("region_index", F.col("reading_order").cast("int")))
    calls = cut(O.read_calls(ocr(regions)))
    described = R.region_json(R.with_polygon(regions)).withColumn("polygon_json", F.to_json(F.transform(
        "polygon", lambda p: F.array(p["x"], p["y"])))).select(*merged.columns, "metadata_json", "polygon_json", "region_index")
    bubbles = described.filter(F.col("region_index") < schema.MAX_REGIONS_PER_PAGE).select(
        F.concat_ws("-", F.lit("bub"), F.col("page_id").cast("string"), F.col("region_index").cast("string")).alias("id"),
        "page_id", "region_index", "bubble_type", "x", "y", "w", "h", "confidence",
        F.lit(None).cast("string").alias("original_text"), F.lit(None).cast("string").alias("translated_text"),
        F.lit(False).alias("is_translated"), F.lit(0.0).alias("rotation"), "polygon_json",
        F.col("region_index").alias("reading_order"), F.col("engine").alias("detector_engine"),
        F.coalesce("has_mask", F.lit(False)).alias("has_precise_mask"), "metadata_json",
        now.cast("timestamp_ntz").alias("created_at"))
    asked = calls.filter(F.col("text") != "").select("page_id", "region_index", F.col("text").alias("original_text")).join(
        pages.select("page_id", "source_language", "target_language", "context"), "page_id")
    done, learned = X.translate_segments(asked, memory, provider, now, **kw)
    translated = done.select("page_id", "region_index", "translated_text")
    segments, updated = C.build_segments(bubbles, calls, translated, pages)
    counts = regions.groupBy("page_id").agg(F.count("*").alias("regions"))
    texts = segments.groupBy("page_id").agg(F.count("*").alias("segments"))
    lost = (failed if failed is not None else pages.limit(0)).select("page_id").distinct().withColumn("__lost", F.lit(True))
    status = pages.select("page_id", "job_id").join(counts, "page_id", "left").join(texts, "page_id", "left").join(
        lost, "page_id", "left").select(
        "page_id", "job_id", F.coalesce("regions", F.lit(0)).alias("regions"), F.coalesce("segments", F.lit(0)).alias("segments"),
        F.col("__lost").isNull().alias("is_translated"))
    jobs = J.job_rollup(status.select("job_id", F.col("is_translated").alias("ok")))
    return Localized(described, calls, segments, updated, status.drop("job_id"), learned, jobs)
