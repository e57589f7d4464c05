"""Project, chapter, history and queue reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow import schema
from panelflow.functions.text import status_action
from panelflow.functions.values import counts_map, elapsed_ms, iso_time, percent, since_days, zero
from panelflow.operators.regions import one_row


# --- joins along the hierarchy ----------------------------------------------

def pages_of(chapters: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages with their project: (project_id, chapter_id, page columns)."""
    return pages.join(chapters.select(F.col("id").alias("chapter_id"), "project_id"), "chapter_id")


def jobs_of(chapters: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs with their project."""
    return jobs.join(chapters.select(F.col("id").alias("chapter_id"), "project_id"), "chapter_id")


def bubbles_for(pages: DataFrame, bubbles: DataFrame) -> DataFrame:
    return bubbles.join(pages.select(F.col("id").alias("page_id")), "page_id", "left_semi")


def job_context(jobs: DataFrame, chapters: DataFrame, projects: DataFrame) -> DataFrame:
    """Jobs with chapter and project names; jobs without a chapter stay."""
    ch = chapters.select(F.col("id").alias("chapter_id"), "project_id", "chapter_number",
                         F.col("title").alias("chapter_title"))
    pr = projects.select(F.col("id").alias("project_id"), F.col("title").alias("project_title"))
    return jobs.join(ch, "chapter_id", "left").join(pr, "project_id", "left")


# --- progress ---------------------------------------------------------------

def _page_totals(chapters: DataFrame, pages: DataFrame) -> DataFrame:
    """Totals per project; pages are counted per chapter before the join."""
    per_chapter = pages.groupBy("chapter_id").agg(
        F.count("*").alias("total_pages"), F.count_if("is_translated").alias("translated_pages"),
        F.sum("processing_time_ms").alias("time_ms"))
    return chapters.join(per_chapter, chapters["id"] == per_chapter["chapter_id"], "left").groupBy("project_id").agg(
        F.count("*").alias("chapter_count"), F.count_if("is_translated").alias("translated_chapters"),
        F.sum(zero(F.col("total_pages"))).alias("total_pages"),
        F.sum(zero(F.col("translated_pages"))).alias("translated_pages"),
        F.sum(F.coalesce("time_ms", F.lit(0.0))).alias("total_processing_time_ms"))


def _job_totals(chapters: DataFrame, jobs: DataFrame) -> DataFrame:
    done = F.col("status") == "completed"
    return jobs_of(chapters, jobs).groupBy("project_id").agg(
        F.count("*").alias("total_jobs"), F.count_if(done).alias("completed_jobs"),
        F.count_if(F.col("status") == "failed").alias("failed_jobs"),
        F.max("created_at").alias("last_job_at"),
        F.max(F.when(done, F.col("completed_at"))).alias("last_translated_at"))


def _with_totals(projects: DataFrame, *totals: DataFrame) -> DataFrame:
    out = projects.withColumnRenamed("id", "project_id")
    for frame in totals:
        out = out.join(frame, "project_id", "left")
    return out


def project_summary(projects: DataFrame, chapters: DataFrame, pages: DataFrame, jobs: DataFrame) -> DataFrame:
    out = _with_totals(projects, _page_totals(chapters, pages), _job_totals(chapters, jobs))
    total, done = zero(F.col("total_pages")), zero(F.col("translated_pages"))
    return out.select(
        *[F.col("project_id").alias(c) if c == "id" else F.col(c) for c in projects.columns],
        zero(F.col("chapter_count")).alias("chapter_count"), total.alias("total_pages"),
        done.alias("translated_pages"), percent(done, total).alias("translation_progress"),
        F.coalesce("last_job_at", "updated_at").alias("last_activity"))


def project_detail(projects: DataFrame, chapters: DataFrame, pages: DataFrame, jobs: DataFrame) -> DataFrame:
    out = _with_totals(projects, _page_totals(chapters, pages), _job_totals(chapters, jobs))
    total, done = zero(F.col("total_pages")), zero(F.col("translated_pages"))
    return out.select(
        *[F.col("project_id").alias(c) if c == "id" else F.col(c) for c in projects.columns],
        zero(F.col("chapter_count")).alias("chapter_count"), total.alias("total_pages"),
        done.alias("translated_pages"), percent(done, total).alias("translation_progress"), "last_translated_at")


def project_stats(projects: DataFrame, chapters: DataFrame, pages: DataFrame, bubbles: DataFrame,
                  jobs: DataFrame, storage: DataFrame) -> DataFrame:
    """All counters of a project; storage has (project_id, storage_bytes)."""
    per_page = bubbles.groupBy("page_id").agg(F.count("*").alias("n"))
    bubble_counts = (
        pages.select(F.col("id").alias("page_id"), "chapter_id").join(per_page, "page_id")
        .groupBy("chapter_id").agg(F.sum("n").alias("n"))
        .join(chapters.select(F.col("id").alias("chapter_id"), "project_id"), "chapter_id")
        .groupBy("project_id").agg(F.sum("n").alias("total_bubbles")))
    out = _with_totals(projects, _page_totals(chapters, pages), _job_totals(chapters, jobs), bubble_counts, storage)

    def n(name: str, alias: str | None = None) -> Column:
        return zero(F.col(name)).alias(alias or name)

    return out.select(
        "project_id", "title", n("chapter_count", "total_chapters"), n("total_pages"), n("translated_chapters"),
        n("translated_pages"),
        percent(zero(F.col("translated_pages")), zero(F.col("total_pages"))).alias("translation_progress"),
        n("total_bubbles"), n("total_jobs"), n("completed_jobs"), n("failed_jobs"),
        F.coalesce("total_processing_time_ms", F.lit(0.0)).alias("total_processing_time_ms"),
        n("storage_bytes", "storage_size_bytes"))


def overview(projects: DataFrame, chapters: DataFrame, pages: DataFrame) -> DataFrame:
    """One row over the whole catalog, with projects counted by language pair."""
    pair = F.concat("source_language", F.lit("→"), "target_language")
    pairs = projects.groupBy(pair.alias("pair")).agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_projects"),
        counts_map(F.col("pair"), F.col("n")).alias("projects_by_language"))
    page_row = pages.agg(F.count("*").alias("total_pages"), F.count_if("is_translated").alias("translated_pages"))
    out = one_row(pairs, chapters.agg(F.count("*").alias("total_chapters")), page_row)
    return out.withColumn("overall_progress", percent(F.col("translated_pages"), F.col("total_pages")))


def progress_rollup(projects: DataFrame, chapters: DataFrame, pages: DataFrame) -> DataFrame:
    """Progress of every chapter, every project and the corpus in one pass (level 0, 1, 3).

    Pages are reduced to one row per chapter first, so the rollup expands chapters, not pages.
    Chapters without pages and projects without chapters count with 0.
    """
    per_chapter = pages.groupBy("chapter_id").agg(
        F.count("*").alias("pages"), F.count_if("is_translated").alias("translated"))
    total, done = F.coalesce(F.sum("pages"), F.lit(0)), F.coalesce(F.sum("translated"), F.lit(0))
    listed = chapters.select("project_id", F.col("id").alias("chapter_id")).join(per_chapter, "chapter_id", "left")
    listed = projects.select(F.col("id").alias("project_id")).join(listed, "project_id", "left")
    out = listed.rollup("project_id", "chapter_id").agg(
        F.grouping_id().alias("level"), total.alias("total_pages"), done.alias("translated_pages"),
        percent(done, total).alias("progress"))
    return out.filter("level <> 0 OR chapter_id IS NOT NULL")


def chapter_pages(chapters: DataFrame, pages: DataFrame) -> DataFrame:
    counts = pages.groupBy("chapter_id").agg(
        F.count("*").alias("page_count"), F.count_if("is_translated").alias("translated_pages"))
    return chapters.join(counts, chapters["id"] == counts["chapter_id"], "left").select(
        *[chapters[c] for c in chapters.columns], zero(F.col("page_count")).alias("page_count"),
        zero(F.col("translated_pages")).alias("translated_pages"))


def page_bubbles(pages: DataFrame, bubbles: DataFrame) -> DataFrame:
    counts = bubbles.groupBy("page_id").agg(F.count("*").alias("bubble_count"))
    return pages.join(counts, pages["id"] == counts["page_id"], "left").select(
        *[pages[c] for c in pages.columns], zero(F.col("bubble_count")).alias("bubble_count"))


# --- history ----------------------------------------------------------------

def history(jobs: DataFrame, chapters: DataFrame, projects: DataFrame) -> DataFrame:
    """History entries of all jobs."""
    return job_context(jobs, chapters, projects).select(
        F.col("id").alias("job_id"), "project_id",
        F.coalesce("project_title", F.lit("Unknown")).alias("project_title"),
        F.coalesce("chapter_number", F.lit(0.0)).alias("chapter_number"), "chapter_title",
        status_action(F.col("status")).alias("action"), "status",
        zero(F.col("total_pages")).alias("pages_total"), zero(F.col("completed_pages")).alias("pages_completed"),
        zero(F.col("failed_pages")).alias("pages_failed"),
        elapsed_ms(F.col("started_at"), F.col("completed_at")).alias("processing_time_ms"),
        "error_message", "source_language", "target_language", "created_at", "completed_at")


def filter_history(entries: DataFrame, project_id=None, status: str | None = None, action: str | None = None,
                   source_language: str | None = None, target_language: str | None = None,
                   date_from: str | None = None, date_to: str | None = None, search: str | None = None,
                   literal: bool = False) -> DataFrame:
    """Apply the history filters that are set; dates are inclusive ISO-8601 texts."""
    if status is not None and status not in schema.JOB_STATUSES:
        raise ValueError(f"Invalid status: {status}")
    equal = {"project_id": project_id, "status": status, "action": action,
             "source_language": source_language, "target_language": target_language}
    for name, value in equal.items():
        if value is not None and value != "":
            entries = entries.filter(F.col(name) == value)
    if date_from:
        entries = entries.filter(F.col("created_at") >= iso_time(date_from))
    if date_to:
        entries = entries.filter(F.col("created_at") <= iso_time(date_to))
    if search:
        entries = entries.filter(contains_term(["project_title", "chapter_title"], search, literal))
    return entries


def contains_term(columns: list[str], term: str, literal: bool = False) -> Column:
    """Case-insensitive substring in any column; % and _ are wildcards unless literal."""
    pattern = term.replace("\\", "\\\\")
    if literal:
        pattern = pattern.replace("%", r"\%").replace("_", r"\_")
    hit = F.lit(False)
    for name in columns:
        hit = hit | F.coalesce(F.col(name).ilike(f"%{pattern}%"), F.lit(False))
    return hit


def newest_history(entries: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must be 1..200 and offset not negative")
    return entries.orderBy(F.col("created_at").desc(), F.col("job_id").desc()).offset(offset).limit(limit)


def paginate(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """A page of rows, and one row with total and has_more."""
    info = df.agg(F.count("*").alias("total")).select(
        "total", F.lit(limit).alias("limit"), F.lit(offset).alias("offset"),
        (F.lit(offset + limit) < F.col("total")).alias("has_more"))
    return df.orderBy(*order).offset(offset).limit(limit), info


def activity_summary(jobs: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Counters of the jobs created in the last days; pages count over all of them."""
    recent = jobs.filter(F.col("created_at") >= since_days(now, days))
    pair = F.concat("source_language", F.lit("→"), "target_language")
    groups = recent.groupBy(pair.alias("pair")).agg(
        F.count("*").alias("jobs"), F.count_if(F.col("status") == "completed").alias("done"),
        F.count_if(F.col("status") == "failed").alias("failed"), F.sum(zero(F.col("total_pages"))).alias("n"),
        F.sum(elapsed_ms(F.col("started_at"), F.col("completed_at"))).alias("ms"))
    one = groups.agg(
        zero(F.sum("jobs")).alias("total_jobs"), zero(F.sum("done")).alias("completed_jobs"),
        zero(F.sum("failed")).alias("failed_jobs"), zero(F.sum("n")).alias("total_pages"),
        F.coalesce(F.sum("ms"), F.lit(0.0)).alias("total_time_ms"),
        counts_map(F.col("pair"), F.col("n")).alias("pages_by_language"))
    mean = F.when(F.col("total_pages") > 0, F.col("total_time_ms") / F.col("total_pages")).otherwise(F.lit(0.0))
    return one.withColumn("avg_time_per_page_ms", mean)


def recent_activity(jobs: DataFrame, chapters: DataFrame, projects: DataFrame, now: Column,
                    days: int = 7, n: int = 10) -> DataFrame:
    """The n newest jobs of the window. Jobs are cut to n before the joins."""
    newest = jobs.filter(F.col("created_at") >= since_days(now, days)).orderBy(
        F.col("created_at").desc(), F.col("id").desc()).limit(n)
    action = F.when(F.col("status") == "completed", "completed").otherwise("updated")
    return job_context(newest, chapters, projects).select(
        F.col("id").alias("job_id"), F.coalesce("project_title", F.lit("Unknown")).alias("project_title"),
        F.coalesce("chapter_number", F.lit(0.0)).alias("chapter_number"), "chapter_title", action.alias("action"),
        "status", "created_at", "completed_at").orderBy(F.col("created_at").desc(), F.col("job_id").desc())


# --- lists and searches -----------------------------------------------------

def search_projects(projects: DataFrame, search: str | None = None, language: str | None = None,
                    columns: list[str] | None = None, literal: bool = False) -> DataFrame:
    if search:
        projects = projects.filter(contains_term(columns or ["title", "title_original", "author"], search, literal))
    if language:
        projects = projects.filter((F.col("source_language") == language) | (F.col("target_language") == language))
    return projects


def list_projects(summary: DataFrame, sort_by: str = "updated_at", desc: bool = True,
                  page: int = 1, per_page: int = 20) -> DataFrame:
    if sort_by not in ("title", "created_at", "updated_at", "chapter_count"):
        raise ValueError(f"cannot sort by {sort_by}")
    if page < 1 or not 1 <= per_page <= 100:
        raise ValueError("page starts at 1 and per_page is 1..100")
    key = F.col(sort_by).desc() if desc else F.col(sort_by).asc()
    return summary.orderBy(key, "id").offset((page - 1) * per_page).limit(per_page)


def list_chapters(chapters: DataFrame, project_id=None, translated_only: bool = False) -> DataFrame:
    if project_id is not None:
        chapters = chapters.filter(F.col("project_id") == project_id)
    if translated_only:
        chapters = chapters.filter("is_translated")
    return chapters.orderBy("chapter_number", "id")


def filter_jobs(jobs: DataFrame, chapters: DataFrame | None = None, status: str | None = None,
                chapter_id=None, project_id=None) -> DataFrame:
    if status is not None:
        jobs = jobs.filter(F.col("status") == status)
    if chapter_id is not None:
        jobs = jobs.filter(F.col("chapter_id") == chapter_id)
    if project_id is not None:
        own = chapters.filter(F.col("project_id") == project_id).select(F.col("id").alias("chapter_id"))
        jobs = jobs.join(own, "chapter_id", "left_semi")
    return jobs


def latest_jobs(jobs: DataFrame, n: int = 20) -> DataFrame:
    if not 1 <= n <= 100:
        raise ValueError("n must be 1..100")
    return jobs.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)


def latest_job(jobs: DataFrame, key: str = "chapter_id") -> DataFrame:
    """Newest job per key as one max over a struct; no sort of a key's jobs."""
    rest = [c for c in jobs.columns if c not in (key, "created_at", "id")]
    return jobs.groupBy(key).agg(F.max(F.struct("created_at", "id", *rest)).alias("j")).select(key, "j.*")


def ordered_bubbles(bubbles: DataFrame, pages: DataFrame) -> DataFrame:
    numbers = pages.select(F.col("id").alias("page_id"), "page_number")
    return bubbles.join(numbers, "page_id").orderBy("page_number", "reading_order", "page_id", "id")


# --- queue and dashboard ----------------------------------------------------

def queue_counts(jobs: DataFrame) -> DataFrame:
    """One row: active, queued and failed, then one count per status."""
    s = F.col("status")
    return jobs.agg(
        F.count_if(s == "processing").alias("active"), F.count_if(s.isin("queued", "pending")).alias("waiting"),
        *[F.count_if(s == name).alias(name) for name in schema.JOB_STATUSES])


def dashboard(summary: DataFrame, jobs: DataFrame, n_projects: int = 4, n_jobs: int = 5) -> DataFrame:
    """Totals over the listed projects and jobs only."""
    listed = list_projects(summary, per_page=n_projects)
    left = listed.agg(
        F.count("*").alias("projects"), zero(F.sum("total_pages")).alias("total_pages"),
        zero(F.sum("translated_pages")).alias("translated_pages"))
    right = latest_jobs(jobs, n_jobs).agg(
        F.count_if(F.col("status") == "processing").alias("active_jobs"),
        F.count_if(F.col("status") == "failed").alias("failed_jobs"))
    return one_row(left, right)
