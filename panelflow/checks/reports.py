"""Queries of project, chapter, history and queue reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelflow import schema
from panelflow.checks.base import flat, mean_sql, percent_sql, query, rounded, sql, ts
from panelflow.operators import metrics as M
from panelflow.operators import reports as R
from panelflow.operators.paging import listing_page, write_listing
from panelflow.session import scratch_path

TOTALS = """per_chapter AS (SELECT chapter_id, count(*) AS n, count(*) FILTER (is_translated) AS done, sum(processing_time_ms) AS ms FROM page_rows GROUP BY 1),
page_totals AS (SELECT project_id, count(*) AS chapter_count, count(*) FILTER (is_translated) AS translated_chapters,
    CAST(sum(coalesce(n, 0)) AS BIGINT) AS total_pages, CAST(sum(coalesce(done, 0)) AS BIGINT) AS translated_pages, sum(coalesce(ms, 0)) AS ms
    FROM chapters LEFT JOIN per_chapter ON chapters.id = chapter_id GROUP BY 1),
job_totals AS (SELECT project_id, count(*) AS total_jobs, count(*) FILTER (status = 'completed') AS completed_jobs,
    count(*) FILTER (status = 'failed') AS failed_jobs, max(jobs.created_at) AS last_job_at,
    max(completed_at) FILTER (status = 'completed') AS last_translated_at
    FROM jobs JOIN chapters ON chapter_id = chapters.id GROUP BY 1),
summary AS (SELECT p.*, coalesce(chapter_count, 0) AS chapter_count, coalesce(total_pages, 0) AS total_pages,
    coalesce(translated_pages, 0) AS translated_pages, coalesce(last_job_at, updated_at) AS last_activity, last_translated_at
    FROM projects p LEFT JOIN page_totals t ON p.id = t.project_id LEFT JOIN job_totals j ON p.id = j.project_id)"""
ALL = ("projects", "chapters", "page_rows", "jobs")


def _summary(d):
    return R.project_summary(d.projects, d.chapters, d.pages, d.jobs)


@query(sql(f"""SELECT id, title, title_original, author, source_language, target_language, created_at, updated_at, chapter_count, total_pages, translated_pages,
    {percent_sql('translated_pages', 'total_pages')} AS translation_progress, last_activity FROM summary""", *ALL, extra=TOTALS))
def project_summary(d):
    return _summary(d)


@query(sql(f"""SELECT id, chapter_count, total_pages, {percent_sql('translated_pages', 'total_pages')} AS translation_progress, last_translated_at
    FROM summary""", *ALL, extra=TOTALS))
def project_detail(d):
    return R.project_detail(d.projects, d.chapters, d.pages, d.jobs).select(
        "id", "chapter_count", "total_pages", "translation_progress", "last_translated_at")


@query(sql(f"""SELECT p.id AS project_id, title, coalesce(chapter_count, 0) AS total_chapters, coalesce(total_pages, 0) AS total_pages,
    coalesce(translated_chapters, 0) AS translated_chapters, coalesce(translated_pages, 0) AS translated_pages,
    {percent_sql('coalesce(translated_pages, 0)', 'coalesce(total_pages, 0)')} AS translation_progress, coalesce(bubbles, 0) AS total_bubbles,
    coalesce(total_jobs, 0) AS total_jobs, coalesce(completed_jobs, 0) AS completed_jobs, coalesce(failed_jobs, 0) AS failed_jobs,
    round(coalesce(ms, 0), 2) AS total_processing_time_ms, coalesce(storage_bytes, 0) AS storage_size_bytes
    FROM projects p LEFT JOIN page_totals t ON p.id = t.project_id LEFT JOIN job_totals j ON p.id = j.project_id
    LEFT JOIN (SELECT project_id, count(*) AS bubbles FROM bubbles JOIN page_rows r ON bubbles.page_id = r.id JOIN chapters c ON r.chapter_id = c.id GROUP BY 1) b
      ON p.id = b.project_id
    LEFT JOIN (SELECT page_id AS project_id, strlen(html)::BIGINT AS storage_bytes FROM pages) s ON p.id = s.project_id""",
           *ALL, "bubbles", extra=TOTALS))
def project_stats(d):
    storage = d.table("pages").select(F.col("page_id").alias("project_id"), F.octet_length("html").cast("long").alias("storage_bytes"))
    s = R.project_stats(d.projects, d.chapters, d.pages, d.bubbles, d.jobs, storage)
    return s.withColumn("total_processing_time_ms", F.round("total_processing_time_ms", 2))


@query(sql(f"""SELECT *, {percent_sql('translated_pages', 'total_pages')} AS overall_progress FROM (SELECT (SELECT count(*) FROM projects) AS total_projects,
    (SELECT count(*) FROM chapters) AS total_chapters, (SELECT count(*) FROM page_rows) AS total_pages,
    (SELECT count(*) FILTER (is_translated) FROM page_rows) AS translated_pages,
    (SELECT string_agg(p || '=' || n, ',' ORDER BY p) FROM (SELECT source_language || '→' || target_language AS p, count(*) AS n FROM projects GROUP BY 1))
      AS projects_by_language)""", "projects", "chapters", "page_rows"))
def overview(d):
    o = R.overview(d.projects, d.chapters, d.pages)
    return o.withColumn("projects_by_language", flat(F.col("projects_by_language")))


@query(sql(f"""SELECT *, {percent_sql('translated_pages', 'total_pages')} AS progress FROM (SELECT coalesce(project_id, -1) AS project_id, coalesce(chapter_id, -1) AS chapter_id,
    CAST(grouping_id(project_id, chapter_id) AS BIGINT) AS level, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_pages, CAST(coalesce(sum(done), 0) AS BIGINT) AS translated_pages
    FROM (SELECT p.id AS project_id, c.id AS chapter_id, n, done FROM projects p LEFT JOIN chapters c ON c.project_id = p.id
      LEFT JOIN per_chapter t ON t.chapter_id = c.id) GROUP BY ROLLUP (project_id, chapter_id)) WHERE level <> 0 OR chapter_id <> -1""", *ALL, extra=TOTALS))
def progress_rollup(d):
    return R.progress_rollup(d.projects, d.chapters, d.pages).fillna(-1, ["project_id", "chapter_id"])


@query(sql("""SELECT c.id, coalesce(n, 0) AS page_count, coalesce(done, 0) AS translated_pages FROM chapters c LEFT JOIN per_chapter ON c.id = chapter_id""",
           *ALL, extra=TOTALS))
def chapter_pages(d):
    return R.chapter_pages(d.chapters, d.pages).select("id", "page_count", "translated_pages")


@query(sql("""SELECT p.id, page_number, coalesce(n, 0) AS bubble_count FROM page_rows p LEFT JOIN (SELECT page_id, count(*) AS n FROM bubbles GROUP BY 1) b
    ON p.id = b.page_id""", "page_rows", "bubbles"))
def page_bubbles(d):
    return R.page_bubbles(d.pages, d.bubbles).select("id", "page_number", "bubble_count")


@query(sql("SELECT r.id, project_id, chapter_id FROM page_rows r JOIN chapters c ON r.chapter_id = c.id", "page_rows", "chapters"))
def pages_of_projects(d):
    return R.pages_of(d.chapters, d.pages).select("id", "project_id", "chapter_id")


@query(sql("SELECT j.id, project_id, status FROM jobs j JOIN chapters c ON chapter_id = c.id", "jobs", "chapters"))
def jobs_of_projects(d):
    return R.jobs_of(d.chapters, d.jobs).select("id", "project_id", "status")


@query(sql("SELECT id, page_id FROM bubbles WHERE page_id IN (SELECT id FROM page_rows WHERE is_translated)", "bubbles", "page_rows"))
def bubbles_of_pages(d):
    return R.bubbles_for(d.pages.filter("is_translated"), d.bubbles).select("id", "page_id")


HISTORY = """ctx AS (SELECT j.*, project_id, p.title AS project_title, chapter_number, c.title AS chapter_title FROM
    (SELECT * REPLACE (CASE WHEN id % 50 <> 7 THEN chapter_id END AS chapter_id) FROM jobs) j
    LEFT JOIN chapters c ON j.chapter_id = c.id LEFT JOIN projects p ON project_id = p.id),
history AS (SELECT id AS job_id, project_id, coalesce(project_title, 'Unknown') AS project_title, coalesce(chapter_number, 0) AS chapter_number, chapter_title,
    CASE status WHEN 'processing' THEN 'started' ELSE status END AS action, status, coalesce(total_pages, 0) AS pages_total,
    coalesce(completed_pages, 0) AS pages_completed, coalesce(failed_pages, 0) AS pages_failed,
    CAST(epoch_us(completed_at) - epoch_us(started_at) AS DOUBLE) / 1000 AS processing_time_ms, error_message, source_language, target_language,
    created_at, completed_at FROM ctx)"""
H = ("jobs", "chapters", "projects")


def _jobs(d):
    """Jobs, some of which have lost their chapter."""
    return d.jobs.withColumn("chapter_id", F.when(F.col("id") % 50 != 7, F.col("chapter_id")))


def _history(d):
    return R.history(_jobs(d), d.chapters, d.projects)


@query(sql("SELECT * REPLACE (coalesce(project_id, -1) AS project_id) FROM history", *H, extra=HISTORY))
def history(d):
    return _history(d).fillna(-1, ["project_id"])


@query(sql("""SELECT job_id, project_title, created_at FROM history WHERE action = 'failed' AND source_language = 'ja'
    AND created_at BETWEEN '1996-01-01' AND '1998-06-30 12:00:00' AND (project_title ILIKE '%er#0000_0%' OR chapter_title ILIKE '%er#0000_0%')""", *H, extra=HISTORY))
def filter_history(d):
    f = R.filter_history(_history(d), action="failed", source_language="ja", date_from="1996-01-01",
                         date_to="1998-06-30T12:00:00", search="er#0000_0")
    return f.select("job_id", "project_title", "created_at")


@query(sql("SELECT job_id, created_at FROM history ORDER BY created_at DESC, job_id DESC LIMIT 50 OFFSET 100", *H, extra=HISTORY))
def newest_history(d):
    return R.newest_history(_history(d), 50, 100).select("job_id", "created_at")


@query(sql("""SELECT job_id, created_at FROM (SELECT job_id, created_at, row_number() OVER (ORDER BY created_at DESC, job_id DESC) AS n FROM history)
    WHERE n <= 50 OR (n > 700 AND n <= 750) OR (n > 1400 AND n <= 1450)""", *H, extra=HISTORY))
def indexed_history(d):
    """The first page and two deep ones of the whole history, from a listing written once."""
    path = scratch_path(d.spark, "history")
    write_listing(_history(d).select("job_id", "created_at"), [F.col("created_at").desc(), F.col("job_id").desc()], path, ranges=32)
    pages = [listing_page(d.spark, path, 50, offset) for offset in (0, 700, 1400)]
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


@query(sql("SELECT count(*) AS total, 50 AS \"limit\", 100 AS \"offset\", 150 < count(*) AS has_more FROM history WHERE status = 'completed'", *H, extra=HISTORY))
def history_page_info(d):
    _, info = R.paginate(R.filter_history(_history(d), status="completed"), [F.col("job_id")], 50, 100)
    return info


NOW_SQL = "TIMESTAMP '1998-07-01 00:00:00'"


@query(sql(f"""SELECT count(*) AS total_jobs, count(*) FILTER (status = 'completed') AS completed_jobs, count(*) FILTER (status = 'failed') AS failed_jobs,
    CAST(sum(coalesce(total_pages, 0)) AS BIGINT) AS total_pages, coalesce(sum(ms), 0) AS total_time_ms,
    round(coalesce(sum(ms), 0) / sum(coalesce(total_pages, 0)), 6) AS avg_time_per_page_ms,
    (SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM (SELECT source_language || '→' || target_language AS k, CAST(sum(coalesce(total_pages, 0)) AS BIGINT) AS n
      FROM recent GROUP BY 1)) AS pages_by_language FROM recent""", "jobs",
           extra=f"""recent AS (SELECT *, CAST(epoch_us(completed_at) - epoch_us(started_at) AS DOUBLE) / 1000 AS ms FROM jobs
    WHERE created_at >= {NOW_SQL} - INTERVAL 60 DAY)"""))
def activity_summary(d):
    s = R.activity_summary(d.jobs, ts("1998-07-01 00:00:00"), 60)
    return s.withColumns({"pages_by_language": flat(F.col("pages_by_language")),
                          "avg_time_per_page_ms": F.round("avg_time_per_page_ms", 6)})


@query(sql(f"""SELECT id AS job_id, coalesce(project_title, 'Unknown') AS project_title, coalesce(chapter_number, 0) AS chapter_number, chapter_title,
    CASE WHEN status = 'completed' THEN 'completed' ELSE 'updated' END AS action, status, created_at, completed_at FROM ctx
    WHERE created_at >= {NOW_SQL} - INTERVAL 60 DAY ORDER BY created_at DESC, id DESC LIMIT 10""", *H, extra=HISTORY))
def recent_activity(d):
    return R.recent_activity(_jobs(d), d.chapters, d.projects, ts("1998-07-01 00:00:00"), 60)


@query(sql("SELECT id, title FROM projects WHERE (title ILIKE '%00_1%' OR title_original ILIKE '%00_1%' OR author ILIKE '%00_1%') "
           "AND (source_language = 'ja' OR target_language = 'ja')", "projects"))
def search_projects(d):
    return R.search_projects(d.projects, "00_1", "ja").select("id", "title")


@query(sql("SELECT id, title FROM projects WHERE contains(lower(title), '00_1') OR contains(lower(author), 'mach')", "projects"))
def search_projects_literal(d):
    a = R.search_projects(d.projects, "00_1", literal=True)
    return a.unionByName(R.search_projects(d.projects, "MACH", columns=["author"])).select("id", "title").distinct()


@query(sql("SELECT id, title, chapter_count FROM summary ORDER BY chapter_count DESC, id LIMIT 20 OFFSET 20", *ALL, extra=TOTALS))
def list_projects(d):
    return R.list_projects(_summary(d), "chapter_count", page=2).select("id", "title", "chapter_count")


@query(sql("SELECT id, chapter_number FROM chapters WHERE project_id = 7 AND is_translated ORDER BY chapter_number, id", "chapters"))
def list_chapters(d):
    return R.list_chapters(d.chapters, 7, True).select("id", "chapter_number")


@query(sql("SELECT id, status FROM jobs WHERE status = 'failed' AND chapter_id IN (SELECT id FROM chapters WHERE project_id = 7)", "jobs", "chapters"))
def filter_jobs(d):
    return R.filter_jobs(d.jobs, d.chapters, status="failed", project_id=7).select("id", "status")


@query(sql("SELECT id, created_at FROM jobs ORDER BY created_at DESC, id DESC LIMIT 100", "jobs"))
def latest_jobs(d):
    return R.latest_jobs(d.jobs, 100).select("id", "created_at")


@query(sql("""SELECT project_id, j.id, j.created_at, status FROM jobs j JOIN chapters c ON chapter_id = c.id
    QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY j.created_at DESC, j.id DESC) = 1""", "jobs", "chapters"))
def latest_job(d):
    return R.latest_job(R.jobs_of(d.chapters, d.jobs), "project_id").select("project_id", "id", "created_at", "status")


@query(sql("SELECT b.id, page_number, reading_order FROM bubbles b JOIN page_rows p ON page_id = p.id", "bubbles", "page_rows"))
def ordered_bubbles(d):
    return R.ordered_bubbles(d.bubbles, d.pages).select("id", "page_number", "reading_order")


@query(sql("SELECT count(*) FILTER (status = 'processing') AS active, count(*) FILTER (status IN ('queued', 'pending')) AS waiting, "
           + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in schema.JOB_STATUSES) + " FROM jobs", "jobs"))
def queue_counts(d):
    return R.queue_counts(d.jobs)


@query(sql("""SELECT projects, CAST(total_pages AS BIGINT) AS total_pages, CAST(translated_pages AS BIGINT) AS translated_pages, active_jobs, failed_jobs FROM
    (SELECT count(*) AS projects, sum(total_pages) AS total_pages, sum(translated_pages) AS translated_pages FROM
      (SELECT * FROM summary ORDER BY updated_at DESC, id LIMIT 4)),
    (SELECT count(*) FILTER (status = 'processing') AS active_jobs, count(*) FILTER (status = 'failed') AS failed_jobs FROM
      (SELECT * FROM jobs ORDER BY created_at DESC, id DESC LIMIT 5))""", *ALL, extra=TOTALS))
def dashboard(d):
    return R.dashboard(_summary(d), d.jobs)


# --- requests, snapshots, logs ----------------------------------------------

@query(sql("SELECT id, path, duration_ms FROM request_log WHERE duration_ms > 1000 AND path NOT IN ('/api/v1/health', '/health', '/api/v1/info') "
           "AND path NOT LIKE '/static/%'", "request_log"))
def slow_requests(d):
    return M.slow_requests(d.request_log).select("id", "path", "duration_ms")


@query(sql("SELECT host, id, ram_used_mb FROM snapshots WHERE ram_used_mb > 1024", "snapshots"))
def memory_warnings(d):
    return M.memory_warnings(d.snapshots).select("host", "id", "ram_used_mb")


@query(sql("SELECT id, memory_delta_mb FROM request_log WHERE memory_delta_mb > 50", "request_log"))
def memory_heavy_requests(d):
    return M.memory_heavy_requests(d.request_log).select("id", "memory_delta_mb")


@query(sql(f"""SELECT host, {mean_sql('cpu_percent', 1)} AS avg_cpu, {mean_sql('ram_used_mb', 1)} AS avg_ram_mb, {rounded('max(ram_used_mb)', 1)} AS max_ram_mb,
    count(*) AS samples, CAST({rounded('(epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE', 0)} AS BIGINT) AS span_seconds,
    arg_max(cpu_percent, ts) AS current_cpu, arg_max(ram_used_mb, ts) AS current_ram_mb FROM snapshots GROUP BY host""", "snapshots"))
def resource_summary(d):
    return M.resource_summary(d.snapshots, ["host"])


@query(sql("""SELECT host, id, ts FROM (SELECT * FROM snapshots QUALIFY row_number() OVER (PARTITION BY host ORDER BY ts DESC, id DESC) <= 360)
    WHERE ts >= TIMESTAMP '2024-01-28'""", "snapshots"))
def recent_snapshots(d):
    return M.recent_snapshots(d.snapshots, ts("2024-01-31 00:00:00"), seconds=3 * 86400).select("host", "id", "ts")


LOGS = """logs AS (SELECT event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t, 'backend.' || event_type AS module,
    ['INFO', 'DEBUG', 'WARNING', 'ERROR'][CAST(user_id % 4 + 1 AS INTEGER)] AS level, 'props ' || props AS message FROM events)"""


def log_lines(d):
    """Log lines made from the events, every tenth without the log format."""
    level = F.element_at(F.array(*[F.lit(x) for x in ("INFO", "DEBUG", "WARNING", "ERROR")]), (F.col("user_id") % 4 + 1).cast("int"))
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(",000 - backend."), "event_type", F.lit(" - "), level,
                    F.lit(" - props "), "props")
    return d.table("events").select(F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("  at "), "props")).otherwise(line).alias("value"))


@query(sql("""SELECT CASE WHEN id % 10 <> 0 THEN CAST(t AS TIMESTAMP) END AS timestamp, CASE WHEN id % 10 <> 0 THEN module END AS module,
    CASE WHEN id % 10 <> 0 THEN level END AS level, CASE WHEN id % 10 <> 0 THEN message ELSE '  at ' || substring(message, 7) END AS message FROM logs""", extra=LOGS))
def parse_logs(d):
    from panelflow.sources.logs import parse_log_lines
    return parse_log_lines(log_lines(d))


@query(sql("SELECT '[' || t || '] [' || level || '] [' || module || '] ' || message AS value FROM logs "
           "WHERE id % 10 <> 0 AND level = 'ERROR' AND (contains(lower(message), 'click') OR contains(lower(module), 'click'))", extra=LOGS))
def export_log_lines(d):
    from panelflow.sources.logs import parse_log_lines
    return M.log_lines(M.filter_logs(parse_log_lines(log_lines(d)), "ERROR", "CLICK"))
