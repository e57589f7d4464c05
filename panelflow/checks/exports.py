"""Queries of the export side."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelflow.checks.base import query, quoted, rounded, sql, ts
from panelflow.checks.regions import MERGED
from panelflow.operators import exports as E

SPECS = ["1-2,2,5", "", "x,3", "2 - 4", "-1", "7,1-1", "3-1", "0"]


@query(sql("SELECT id, page_number, processing_time_ms FROM page_rows WHERE page_number BETWEEN 1 AND 2 OR page_number IN (4) OR page_number BETWEEN 6 AND 9", "page_rows"))
def select_page_range(d):
    return E.select_page_range(d.pages, "1-2,4,bad,6-9,2").select("id", "page_number", "processing_time_ms")


SPEC_SQL = f"{quoted(SPECS)}[CAST(chapter_id % {len(SPECS)} + 1 AS INTEGER)]"


def _spec(key: str):
    return F.element_at(F.array(*[F.lit(s) for s in SPECS]), (F.col(key) % len(SPECS) + 1).cast("int"))


@query(sql(f"""SELECT id, page_number, processing_time_ms FROM (SELECT *, {SPEC_SQL} AS s FROM page_rows) WHERE CASE s WHEN '1-2,2,5' THEN page_number IN (1, 2, 5) WHEN '' THEN true
    WHEN 'x,3' THEN page_number = 3 WHEN '2 - 4' THEN page_number BETWEEN 2 AND 4 WHEN '7,1-1' THEN page_number IN (1, 7) WHEN '0' THEN page_number = 0 ELSE false END""", "page_rows"))
def page_range_by_row(d):
    return E.select_page_range(d.pages, _spec("chapter_id")).select("id", "page_number", "processing_time_ms")


@query(sql(f"""SELECT id, s AS spec, CASE s WHEN 'x,3' THEN 'Invalid page number: ''x''' WHEN '-1' THEN 'Invalid range: ''-1''' WHEN '3-1' THEN 'Invalid range: ''3-1'''
    WHEN '0' THEN 'Invalid page number: ''0''' END AS error FROM (SELECT id, {SPEC_SQL.replace('chapter_id', 'id')} AS s FROM chapters)""", "chapters"))
def validate_page_range(d):
    return E.validate_page_range(d.chapters.select("id", _spec("id").alias("spec")), "spec")


@query(sql("""SELECT c.id, coalesce(n, 0) AS page_count FROM chapters c LEFT JOIN (SELECT chapter_id, count(*) AS n FROM page_rows WHERE page_number BETWEEN 2 AND 4
    GROUP BY 1) ON c.id = chapter_id""", "chapters", "page_rows"))
def count_selected(d):
    return E.count_selected(d.chapters, d.pages, "2-4,3").select("id", "page_count")


@query(sql(f"""SELECT export_id, page_range, estimated_pages, {rounded('estimated_pages * (0.5::DOUBLE * (quality / 90.0::DOUBLE))', 1)} AS estimated_mb FROM
    (SELECT export_id, page_range, quality, CAST(CASE page_range WHEN '1-2,2,5' THEN 4 * chapters WHEN 'x,3' THEN 2 * chapters WHEN '2 - 4' THEN 3 * chapters
      WHEN '7,1-1' THEN 2 * chapters WHEN '3-1' THEN -1 * chapters WHEN '0' THEN chapters ELSE all_pages END AS BIGINT) AS estimated_pages FROM
      (SELECT p.id AS export_id, {quoted(SPECS)}[CAST(p.id % {len(SPECS)} + 1 AS INTEGER)] AS page_range, 50 + p.id % 50 AS quality, count(c.id) AS chapters,
         sum(coalesce(n, 0)) AS all_pages FROM projects p JOIN chapters c ON c.project_id = p.id
         LEFT JOIN (SELECT chapter_id, count(*) AS n FROM page_rows GROUP BY 1) ON chapter_id = c.id GROUP BY ALL))""", "projects", "chapters", "page_rows"))
def export_estimate(d):
    counts = d.pages.groupBy("chapter_id").agg(F.count("*").alias("n"))
    chapters = d.chapters.join(counts, d.chapters["id"] == counts["chapter_id"], "left").select(
        F.col("project_id").alias("export_id"), F.coalesce("n", F.lit(0)).alias("pages"))
    requests = d.projects.join(d.chapters.select(F.col("project_id").alias("id")).distinct(), "id", "left_semi").select(
        F.col("id").alias("export_id"), _spec("id").alias("page_range"), (50 + F.col("id") % 50).alias("quality"))
    return E.export_estimate(requests, chapters).drop("quality")


def _placed(d):
    ch = d.chapters.select(F.col("id").alias("chapter_id"), "project_id", "chapter_number")
    return d.pages.join(ch, "chapter_id")


@query(sql("""SELECT r.id, project_id || '/' || chapter_id || '/page_' || lpad(page_number::VARCHAR, 4, '0') || '.jpg' AS path FROM page_rows r
    JOIN chapters c ON chapter_id = c.id WHERE r.is_translated""", "page_rows", "chapters"))
def import_paths(d):
    return E.plan_page_paths(_placed(d).withColumn("success", F.col("is_translated"))).select("id", "path")


@query(sql("""SELECT r.id, 'Chapter_' || lpad(CAST(chapter_number AS INTEGER)::VARCHAR, 2, '0') || '/page_' || lpad(page_number::VARCHAR, 4, '0') || '.jpg' AS path
    FROM page_rows r JOIN chapters c ON chapter_id = c.id""", "page_rows", "chapters"))
def export_paths(d):
    return E.plan_page_paths(_placed(d), "export", "JPEG").select("id", "path")


def _titled(d):
    pr = d.projects.select(F.col("id").alias("project_id"), F.col("title").alias("project_title"))
    return d.chapters.join(pr, "project_id")


COUNTS = """counted AS (SELECT c.*, p.title AS project_title, coalesce(n, 0) AS page_count FROM chapters c JOIN projects p ON project_id = p.id
    LEFT JOIN (SELECT chapter_id, count(*) AS n FROM page_rows WHERE page_number <= 3 GROUP BY 1) ON c.id = chapter_id)"""


@query(sql("""SELECT id AS chapter_id, '{"manga_title":"' || project_title || '","chapter_number":' || chapter_number || ',"chapter_title":"' || title || '","page_count":'
    || page_count || ',"format":"PNG","generated_at":"2024-01-01T00:00:00"}' AS manifest FROM counted""", "chapters", "projects", "page_rows", extra=COUNTS))
def chapter_manifest(d):
    per_chapter, _ = E.export_manifest(_titled(d), d.pages, "1-3", "png", ts("2024-01-01 00:00:00"))
    return per_chapter.select("chapter_id", "manifest")


@query(sql("""SELECT project_id, '{"manga_title":"' || first(project_title) || '","chapters":[' || string_agg('{"number":' || chapter_number || ',"title":"' || title || '","pages":'
    || page_count || '}', ',' ORDER BY chapter_number, id) || '],"total_chapters":' || count(*) || ',"total_pages":' || CAST(sum(page_count) AS BIGINT)
    || ',"format":"PNG","generated_at":"2024-01-01T00:00:00"}' AS manifest FROM counted GROUP BY 1""", "chapters", "projects", "page_rows", extra=COUNTS))
def root_manifest(d):
    _, roots = E.export_manifest(_titled(d), d.pages, "1-3", "png", ts("2024-01-01 00:00:00"))
    return roots


@query(sql("""SELECT project_id, '{"series":"' || first(project_title) || '","format":"CBZ","pages":' || CAST(sum(page_count) AS BIGINT) || '}' AS comic_book_info,
    '{"generated_at":"2024-01-01T00:00:00","manga_title":"' || first(project_title) || '","chapters":[' || string_agg('{"id":"' || id || '","number":' || chapter_number
      || ',"title":"' || title || '","page_count":' || page_count || '}', ',' ORDER BY chapter_number, id) || '],"total_chapters":' || count(*)
      || ',"quality":90,"comic_book_info":' || comic_book_info || ',"ComicRack":{"series":"' || first(project_title) || '","title":"' || first(project_title)
      || '","genre":"Manga","language":"en"}}' AS metadata
    FROM counted GROUP BY 1""", "chapters", "projects", "page_rows", extra=COUNTS))
def archive_manifest(d):
    return E.archive_manifest(_titled(d), d.pages, "1-3", generated_at=ts("2024-01-01 00:00:00"))


@query(sql("""SELECT 'file' AS kind, id FROM page_rows WHERE created_at < TIMESTAMP '1998-07-01' - INTERVAL 24 HOUR
    UNION ALL SELECT 'task', id FROM jobs WHERE status IN ('completed', 'failed', 'cancelled') AND completed_at < TIMESTAMP '1998-07-01' - INTERVAL 24 HOUR""",
           "page_rows", "jobs"))
def expired_exports(d):
    at = ts("1998-07-01 00:00:00")
    files = E.expired_exports(d.pages.select("id", F.col("created_at").alias("modified_at")), at)
    tasks = E.expired_exports(d.jobs, at)
    return files.select(F.lit("file").alias("kind"), "id").unionByName(tasks.select(F.lit("task").alias("kind"), "id"))


@query(sql("""SELECT page_id, count(*) AS regions, count(*) AS segments, page_id % 7 <> 3 AS is_translated FROM
    (SELECT page_id FROM merged) GROUP BY page_id UNION ALL
    SELECT id, 0, 0, id % 7 <> 3 FROM jobs WHERE id NOT IN (SELECT page_id FROM merged)""", "raw_regions", "jobs",
           extra=MERGED))
def localize_corpus(d):
    """The whole page workflow: one text per merged region, read by one engine."""
    return localized(d).page_status


@query(sql("SELECT page_id, engine || ' ' || has_mask AS original_text, 'en: ' || engine || ' ' || has_mask AS translated_text FROM merged", "raw_regions",
           extra=MERGED))
def localized_segments(d):
    return localized(d).segments.select("page_id", "original_text", "translated_text")


def localized(d):
    from panelflow.checks.base import now
    from panelflow.checks.translation import batch_provider
    from panelflow.plans.localize import localize_corpus as run

    def read(regions):
        text = F.concat("engine", F.lit(" "), F.col("has_mask").cast("string"))
        return regions.select("page_id", "region_index", F.lit("paddleocr").alias("engine"), "confidence", "x", "y", "w", "h",
                              text.alias("text"), F.lit("unknown").alias("language"), F.lit(0.0).alias("rotation"))

    pages = d.jobs.select(F.col("id").alias("page_id"), F.col("id").alias("job_id"), F.lit("ko").alias("source_language"),
                          F.lit("en").alias("target_language"), F.lit(None).cast("string").alias("context"))
    failed = d.jobs.filter("id % 7 = 3").select(F.col("id").alias("page_id"))
    return run(d.raw_regions, pages, read, d.memory, batch_provider(), now(), failed=failed,
               ties=[F.col("confidence").desc(), F.col("engine")])


@query(sql("""SELECT id AS job_id, 1 AS total_pages, CASE WHEN id % 7 <> 3 THEN 1 ELSE 0 END AS completed_pages, CASE WHEN id % 7 = 3 THEN 1 ELSE 0 END AS failed_pages,
    'completed' AS status FROM jobs""", "jobs"))
def localized_jobs(d):
    return localized(d).jobs.select("job_id", *[F.col(c).cast("int").alias(c) for c in ("total_pages", "completed_pages", "failed_pages")], "status")


@query(sql("""SELECT 'bub-' || page_id || '-' || (n - 1) AS id, page_id, CAST(n - 1 AS INTEGER) AS reading_order, engine AS detector_engine, has_mask AS has_precise_mask,
    '[[' || x || ',' || y || '],[' || x + w || ',' || y || '],[' || x + w || ',' || y + h || '],[' || x || ',' || y + h || ']]' AS polygon_json,
    '{"engine":"' || engine || '","has_mask":' || has_mask || ',"polygon_vertices":4,"area":' || w * h || '}' AS metadata_json FROM
    (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY x + w / 2 DESC, y, confidence DESC, engine) AS n FROM merged) WHERE n <= 200""",
           "raw_regions", extra=MERGED))
def localized_bubbles(d):
    return localized(d).bubbles.select("id", "page_id", "reading_order", "detector_engine", "has_precise_mask", "polygon_json", "metadata_json")
