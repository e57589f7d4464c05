"""Registration of named queries with their DuckDB twins over the driver tables."""

from __future__ import annotations

from collections.abc import Callable
from textwrap import dedent

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelflow.domain import EPOCH, SOURCE_LANGUAGES, TARGET_LANGUAGES, Domain
from panelflow.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def quoted(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# Domain tables in SQL, as in panelflow.domain.
TABLES = {
    "projects": f"""
        SELECT c_custkey AS id, c_name AS title, upper(c_name) AS title_original, c_mktsegment AS author,
          {quoted(SOURCE_LANGUAGES)}[c_nationkey % 4 + 1] AS source_language,
          {quoted(TARGET_LANGUAGES)}[c_custkey % 2 + 1] AS target_language,
          TIMESTAMP '{EPOCH}' + to_hours(CAST(c_custkey % 9000 AS INTEGER)) AS created_at,
          TIMESTAMP '{EPOCH}' + to_hours(CAST(c_custkey % 9000 AS INTEGER)) + INTERVAL 1 DAY AS updated_at
        FROM customer""",
    "chapters": """
        SELECT o_orderkey AS id, o_custkey AS project_id, CAST(o_orderkey % 100 AS DOUBLE) AS chapter_number,
          o_orderpriority AS title, o_orderstatus = 'F' AS is_translated, o_orderdate AS created_at
        FROM orders""",
    "page_rows": """
        SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS chapter_id, l_linenumber AS page_number,
          l_linestatus = 'F' AS is_translated, l_extendedprice AS processing_time_ms, l_shipdate AS created_at
        FROM lineitem""",
    "jobs": f"""
        SELECT o_orderkey AS id, o_orderkey AS chapter_id,
          CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'failed' END AS status,
          total_pages, completed_pages, failed_pages,
          CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 'error ' || o_orderpriority END AS error_message,
          {quoted(SOURCE_LANGUAGES)}[o_custkey % 4 + 1] AS source_language,
          {quoted(TARGET_LANGUAGES)}[o_custkey % 2 + 1] AS target_language,
          o_orderdate AS created_at, o_orderdate AS started_at,
          CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + to_seconds(CAST(o_orderkey % 3600 AS INTEGER)) END AS completed_at
        FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS total_pages,
            count(*) FILTER (l_linestatus = 'F') AS completed_pages,
            count(*) FILTER (l_returnflag = 'R') AS failed_pages FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""",
    "raw_regions": """
        SELECT l_orderkey AS page_id,
          CASE l_returnflag WHEN 'A' THEN 'yolo' WHEN 'N' THEN 'groundingdino' ELSE 'sam2' END AS engine,
          round_even(l_discount * 10, 2) AS confidence, CAST(l_partkey % 700 AS DOUBLE) AS x,
          CAST(l_suppkey * 11 % 1100 AS DOUBLE) AS y, 40 + l_quantity * 3 AS w,
          CAST(30 + l_linenumber * 15 AS DOUBLE) AS h,
          ['speech', 'thought', 'sfx'][l_linenumber % 3 + 1] AS bubble_type, l_returnflag = 'R' AS has_mask,
          l_extendedprice AS time_ms
        FROM lineitem""",
    "ocr_regions": """
        SELECT l_orderkey AS page_id, -1 AS region_index,
          CASE l_returnflag WHEN 'A' THEN 'paddleocr' WHEN 'N' THEN 'easyocr' ELSE 'tesseract' END AS engine,
          round_even(l_discount * 10, 2) AS confidence, CAST(l_partkey % 700 AS DOUBLE) AS x,
          CAST(l_suppkey * 11 % 1100 AS DOUBLE) AS y, 40 + l_quantity * 3 AS w,
          CAST(30 + l_linenumber * 15 AS DOUBLE) AS h, p_name AS text, 'unknown' AS language, l_tax AS rotation
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "bubbles": """
        SELECT conv_id * 100 + turn AS id, conv_id AS page_id, turn AS reading_order,
          CASE role WHEN 'user' THEN 'speech' WHEN 'assistant' THEN 'thought' ELSE 'narration' END AS bubble_type,
          text AS original_text, CAST(turn * 37 % 500 AS DOUBLE) AS x, CAST(conv_id * 13 % 900 AS DOUBLE) AS y,
          CAST(40 + turn * 30 AS DOUBLE) AS width, CAST(60 + conv_id % 50 * 8 AS DOUBLE) AS height
        FROM conversations""",
    "segments": """
        SELECT doc_id AS id, source AS batch, text AS original_text, lang AS source_language, 'en' AS target_language
        FROM documents""",
    "memory": f"""
        SELECT 'trans:' || md5(text) || ':' || lang || ':en' AS key, 'T: ' || text AS translated_text, 'google' AS engine,
          CAST(strlen(text) AS BIGINT) AS size,
          TIMESTAMP '{EPOCH}' - to_seconds(CAST(n * 7 % 7200 AS INTEGER)) AS created_at,
          TIMESTAMP '{EPOCH}' - to_seconds(CAST(n * 3 % 3600 AS INTEGER)) AS accessed_at,
          CASE WHEN n % 10 <> 4 THEN 3600.0::DOUBLE END AS ttl
        FROM (SELECT item_id AS n, text, 'en' AS lang FROM benchmark
          UNION ALL SELECT doc_id, text, lang FROM documents WHERE doc_id % 2 = 0)""",
    "progress_events": """
        SELECT event_id, kind AS type, user_id AS job_id,
          CASE kind WHEN 'job_progress' THEN 'processing' WHEN 'job_completed' THEN 'completed'
            WHEN 'job_error' THEN 'error' END AS status,
          CASE kind WHEN 'job_progress' THEN round_even(value / 4.9002, 2) WHEN 'job_completed' THEN 100.0 END AS progress,
          CASE WHEN kind = 'job_progress' THEN k END AS current_page,
          CASE WHEN kind IN ('job_progress', 'job_completed') THEN k + 100 END AS total_pages,
          CASE WHEN kind = 'page_processed' THEN value END AS processing_time_ms,
          CASE WHEN kind = 'page_processed' THEN k END AS bubbles_detected, ts AS timestamp
        FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k, CASE event_type WHEN 'signup' THEN 'job_progress'
            WHEN 'view' THEN 'page_processed' WHEN 'click' THEN 'bubble_translated'
            WHEN 'purchase' THEN 'job_completed' ELSE 'job_error' END AS kind FROM events)""",
    "request_log": """
        SELECT event_id AS id, '/' || CASE WHEN event_type = 'view' THEN 'health' ELSE event_type END AS path, ts,
          round_even(value * 5, 4) AS duration_ms, round_even(value / 5 - 20, 4) AS memory_delta_mb
        FROM events""",
    "snapshots": """
        SELECT user_id % 7 AS host, event_id AS id, ts, round_even(value / 5, 4) AS cpu_percent,
          round_even(value * 3, 4) AS ram_used_mb FROM events""",
    "file_listing": """
        SELECT page_id AS id, regexp_extract(url, '^https?://([^/]+)', 1) AS source,
          regexp_replace(url, '[?#].*$', '') AS path,
          regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) || '_p' || (page_id % 40)
            || CASE page_id % 5 WHEN 0 THEN '.PNG' WHEN 1 THEN '.txt' ELSE '.jpg' END AS filename,
          CAST(strlen(html) AS BIGINT) AS size
        FROM pages""",
}
STRIP = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def sql(body: str, *tables: str, extra: str = "") -> str:
    """A statement with the domain tables it names in front."""
    parts = [f"{name} AS ({TABLES[name]})" for name in tables]
    if extra:
        parts.append(dedent(extra).strip())
    head = f"WITH {', '.join(parts)} " if parts else ""
    return head + dedent(body).strip()


def rounded(expr: str, digits: int) -> str:
    """panelflow.functions.values.half_even in SQL."""
    p = f"{float(10 ** digits)}::DOUBLE"
    x = "q__.v"
    head = f"({x} * 134217729.0::DOUBLE - ({x} * 134217729.0::DOUBLE - {x}))"
    rest = f"(({head} * {p} - {x} * {p}) + ({x} - {head}) * {p})"
    low, part = f"floor({x} * {p})", f"({x} * {p} - floor({x} * {p}))"
    return (f"list_transform([{{'v': CAST({expr} AS DOUBLE)}}], lambda q__: ({low} + CASE WHEN {part} > 0.5 OR ({part} = 0.5 AND "
            f"({rest} > 0 OR ({rest} = 0 AND {low} % 2 <> 0))) THEN 1 ELSE 0 END) / {p})[1]")


def mean_sql(column: str, digits: int) -> str:
    """Rounded mean of values with at most four digits, from exact integers."""
    return rounded(f"sum(CAST(round({column} * 10000) AS BIGINT))::DOUBLE / (10000 * count({column}))", digits)


def percent_sql(part: str, whole: str, digits: int = 1) -> str:
    return f"CASE WHEN {whole} > 0 THEN {rounded(f'CAST({part} AS DOUBLE) / {whole} * 100', digits)} ELSE 0.0 END"


def _plain_times(df: DataFrame) -> DataFrame:
    """Timestamps without zone, so that a result reads the same in every client time zone."""
    zoned = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp"]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned}) if zoned else df


def query(statement: str | None = None):
    """Register ``fn(domain)`` under its own name, with SQL when the result has a SQL twin."""
    def add(fn: Callable[[Domain], DataFrame]):
        name = fn.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return _plain_times(fn(Domain(tune(spark), folder)))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if statement:
            SQL[name] = statement
        return fn

    return add


def flat(counts: Column) -> Column:
    """A map as text 'a=1,b=2' in key order, for comparing."""
    entries = F.array_sort(F.map_entries(counts))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def now() -> Column:
    return ts(EPOCH)
