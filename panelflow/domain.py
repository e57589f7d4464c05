"""Domain tables projected from the driver tables (see FIXTURES.md)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE_LANGUAGES = ["ja", "ko", "zh", "fr"]
TARGET_LANGUAGES = ["en", "es"]
EPOCH = "2024-01-01 00:00:00"


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


class Domain:
    """Lazy projections; every property is a DataFrame over the parquet files of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def projects(self) -> DataFrame:
        created = F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("c_custkey") % 9000).cast("int"))
        return self.table("customer").select(
            F.col("c_custkey").alias("id"),
            F.col("c_name").alias("title"),
            F.upper("c_name").alias("title_original"),
            F.col("c_mktsegment").alias("author"),
            _pick(SOURCE_LANGUAGES, F.col("c_nationkey")).alias("source_language"),
            _pick(TARGET_LANGUAGES, F.col("c_custkey")).alias("target_language"),
            created.alias("created_at"),
            (created + F.make_dt_interval(days=F.lit(1))).alias("updated_at"),
        )

    @cached_property
    def chapters(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("project_id"),
            (F.col("o_orderkey") % 100).cast("double").alias("chapter_number"),
            F.col("o_orderpriority").alias("title"),
            (F.col("o_orderstatus") == "F").alias("is_translated"),
            F.col("o_orderdate").alias("created_at"),
        )

    @cached_property
    def pages(self) -> DataFrame:
        return self.table("lineitem").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
            F.col("l_orderkey").alias("chapter_id"),
            F.col("l_linenumber").alias("page_number"),
            (F.col("l_linestatus") == "F").alias("is_translated"),
            F.col("l_extendedprice").alias("processing_time_ms"),
            F.col("l_shipdate").alias("created_at"),
        )

    @cached_property
    def jobs(self) -> DataFrame:
        lines = self.table("lineitem").groupBy("l_orderkey").agg(
            F.count("*").alias("total_pages"),
            F.count_if(F.col("l_linestatus") == "F").alias("completed_pages"),
            F.count_if(F.col("l_returnflag") == "R").alias("failed_pages"),
        )
        status = (F.when(F.col("o_orderstatus") == "F", "completed")
                  .when(F.col("o_orderstatus") == "O", "processing").otherwise("failed"))
        done = F.col("o_orderdate") + F.make_dt_interval(secs=F.col("o_orderkey") % 3600)
        return self.table("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
            F.col("o_orderkey").alias("id"),
            F.col("o_orderkey").alias("chapter_id"),
            status.alias("status"),
            "total_pages", "completed_pages", "failed_pages",
            F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 2 == 0),
                   F.concat(F.lit("error "), F.col("o_orderpriority"))).alias("error_message"),
            _pick(SOURCE_LANGUAGES, F.col("o_custkey")).alias("source_language"),
            _pick(TARGET_LANGUAGES, F.col("o_custkey")).alias("target_language"),
            F.col("o_orderdate").alias("created_at"),
            F.col("o_orderdate").alias("started_at"),
            F.when(F.col("o_orderstatus") != "O", done).alias("completed_at"),
        )

    def _boxes(self) -> list[Column]:
        return [
            (F.col("l_partkey") % 700).cast("double").alias("x"),
            (F.col("l_suppkey") * 11 % 1100).cast("double").alias("y"),
            (40 + F.col("l_quantity") * 3).alias("w"),
            (30 + F.col("l_linenumber") * 15).cast("double").alias("h"),
        ]

    @cached_property
    def raw_regions(self) -> DataFrame:
        engine = (F.when(F.col("l_returnflag") == "A", "yolo")
                  .when(F.col("l_returnflag") == "N", "groundingdino").otherwise("sam2"))
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("page_id"),
            engine.alias("engine"),
            F.bround(F.col("l_discount") * 10, 2).alias("confidence"),
            *self._boxes(),
            F.element_at(F.array(F.lit("speech"), F.lit("thought"), F.lit("sfx")),
                         F.col("l_linenumber") % 3 + 1).alias("bubble_type"),
            (F.col("l_returnflag") == "R").alias("has_mask"),
            F.col("l_extendedprice").alias("time_ms"),
        )

    @cached_property
    def ocr_regions(self) -> DataFrame:
        engine = (F.when(F.col("l_returnflag") == "A", "paddleocr")
                  .when(F.col("l_returnflag") == "N", "easyocr").otherwise("tesseract"))
        part = self.table("part").select("p_partkey", "p_name")
        return self.table("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("l_orderkey").alias("page_id"),
            F.lit(None).cast("int").alias("region_index"),
            engine.alias("engine"),
            F.bround(F.col("l_discount") * 10, 2).alias("confidence"),
            *self._boxes(),
            F.col("p_name").alias("text"),
            F.lit("unknown").alias("language"),
            F.col("l_tax").alias("rotation"),
        )

    @cached_property
    def bubbles(self) -> DataFrame:
        kind = (F.when(F.col("role") == "user", "speech").when(F.col("role") == "assistant", "thought")
                .otherwise("narration"))
        return self.table("conversations").select(
            (F.col("conv_id") * 100 + F.col("turn")).alias("id"),
            F.col("conv_id").alias("page_id"),
            F.col("turn").alias("reading_order"),
            kind.alias("bubble_type"),
            F.col("text").alias("original_text"),
            (F.col("turn") * 37 % 500).cast("double").alias("x"),
            (F.col("conv_id") * 13 % 900).cast("double").alias("y"),
            (40 + F.col("turn") * 30).cast("double").alias("width"),
            (60 + F.col("conv_id") % 50 * 8).cast("double").alias("height"),
        )

    @cached_property
    def segments(self) -> DataFrame:
        return self.table("documents").select(
            F.col("doc_id").alias("id"),
            F.col("source").alias("batch"),
            F.col("text").alias("original_text"),
            F.col("lang").alias("source_language"),
            F.lit("en").alias("target_language"),
        )

    @cached_property
    def memory(self) -> DataFrame:
        """Translated texts known already: benchmark passages and even-numbered documents."""
        passages = self.table("benchmark").select(F.col("item_id").alias("n"), "text", F.lit("en").alias("lang"))
        known = self.table("documents").filter("doc_id % 2 = 0").select(F.col("doc_id").alias("n"), "text", "lang")
        both = passages.unionByName(known)
        return both.select(
            F.concat(F.lit("trans:"), F.md5("text"), F.lit(":"), F.col("lang"), F.lit(":en")).alias("key"),
            F.concat(F.lit("T: "), "text").alias("translated_text"),
            F.lit("google").alias("engine"),
            F.octet_length("text").cast("long").alias("size"),
            (F.lit(EPOCH).cast("timestamp_ntz") - F.make_dt_interval(secs=F.col("n") * 7 % 7200)).alias("created_at"),
            (F.lit(EPOCH).cast("timestamp_ntz") - F.make_dt_interval(secs=F.col("n") * 3 % 3600)).alias("accessed_at"),
            F.when(F.col("n") % 10 != 4, F.lit(3600.0)).alias("ttl"),
        )

    @cached_property
    def progress_events(self) -> DataFrame:
        return events_to_progress(self.table("events"))

    @cached_property
    def request_log(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("id"),
            F.concat(F.lit("/"), F.when(F.col("event_type") == "view", "health").otherwise(F.col("event_type"))).alias("path"),
            F.col("ts"),
            F.bround(F.col("value") * 5, 4).alias("duration_ms"),
            F.bround(F.col("value") / 5 - 20, 4).alias("memory_delta_mb"),
        )

    @cached_property
    def snapshots(self) -> DataFrame:
        """Resource samples: one per event, host by user."""
        return events_to_snapshots(self.table("events"))

    @cached_property
    def file_listing(self) -> DataFrame:
        path = F.regexp_replace("url", r"[?#].*$", "")
        return self.table("pages").select(
            F.col("page_id").alias("id"),
            F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("source"),
            path.alias("path"),
            F.concat(F.regexp_extract(path, r"([^/]*)$", 1), F.lit("_p"), (F.col("page_id") % 40).cast("string"),
                     F.when(F.col("page_id") % 5 == 0, ".PNG").when(F.col("page_id") % 5 == 1, ".txt")
                     .otherwise(".jpg")).alias("filename"),
            F.octet_length("html").cast("long").alias("size"),
        )


def events_to_snapshots(events: DataFrame) -> DataFrame:
    return events.select(
        (F.col("user_id") % 7).alias("host"),
        F.col("event_id").alias("id"),
        "ts",
        F.bround(F.col("value") / 5, 4).alias("cpu_percent"),
        F.bround(F.col("value") * 3, 4).alias("ram_used_mb"),
    )


def events_to_progress(events: DataFrame) -> DataFrame:
    """Progress events from the events table, batch or stream."""
    kind = (F.when(F.col("event_type") == "signup", "job_progress")
            .when(F.col("event_type") == "view", "page_processed")
            .when(F.col("event_type") == "click", "bubble_translated")
            .when(F.col("event_type") == "purchase", "job_completed")
            .otherwise("job_error"))
    k = F.from_json("props", "k INT")["k"]
    return events.select(
        F.col("event_id"),
        kind.alias("type"),
        F.col("user_id").alias("job_id"),
        F.when(kind == "job_progress", "processing").when(kind == "job_completed", "completed")
        .when(kind == "job_error", "error").alias("status"),
        F.when(kind == "job_progress", F.bround(F.col("value") / 4.9002, 2))
        .when(kind == "job_completed", F.lit(100.0)).alias("progress"),
        F.when(kind == "job_progress", k).alias("current_page"),
        F.when(kind.isin("job_progress", "job_completed"), k + 100).alias("total_pages"),
        F.when(kind == "page_processed", F.col("value")).alias("processing_time_ms"),
        F.when(kind == "page_processed", k).alias("bubbles_detected"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )
