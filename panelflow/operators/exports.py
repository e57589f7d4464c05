"""Export side: page ranges, paths, manifests, estimates, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.functions.text import strip
from panelflow.functions.values import half_even

WHOLE = r"^[+-]?[0-9]+$"


def _number(c: Column) -> Column:
    trimmed = strip(c)
    return F.when(trimmed.rlike(WHOLE), trimmed.try_cast("long"))


def _bounds(spec: Column) -> Column:
    """Array of (lo, hi, ranged, part); a bound that is no integer is null."""
    def bound(part: Column) -> Column:
        ranged = part.contains("-")
        halves = F.split(part, "-", 2)
        lo, hi = _number(F.element_at(halves, 1)), _number(F.element_at(halves, -1))
        return F.struct(lo.alias("lo"), F.when(ranged, hi).otherwise(lo).alias("hi"),
                        ranged.alias("ranged"), part.alias("part"))

    return F.transform(F.transform(F.split(spec, ","), strip), bound)


def in_page_range(page: Column, spec: Column) -> Column:
    """Whether a page number is in a spec like '1-5,8,10-15'; a blank spec holds every page,
    parts that cannot be read are skipped."""
    blank = F.coalesce(strip(spec), F.lit("")) == ""
    return blank | F.exists(_bounds(spec), lambda b: F.coalesce(page.between(b["lo"], b["hi"]), F.lit(False)))


def select_page_range(pages: DataFrame, spec: str | Column) -> DataFrame:
    """Pages in the range. With a text the ranges become plain comparisons that reach the scan."""
    number = F.col("page_number")
    if isinstance(spec, Column):
        return pages.filter(in_page_range(number, spec))
    if not spec.strip():
        return pages
    keep = F.lit(False)
    for part in spec.split(","):
        low, dash, high = part.strip().partition("-")
        try:
            keep = keep | number.between(int(low), int(high if dash else low))
        except ValueError:
            continue
    return pages.filter(keep)


def validate_page_range(df: DataFrame, column: str) -> DataFrame:
    """Add the first error of the spec as column ``error``, null when it is valid."""
    def problem(b: Column) -> Column:
        ok = (b["lo"] >= 1) & (b["hi"] >= b["lo"])
        head = F.when(b["ranged"], "Invalid range: '").otherwise("Invalid page number: '")
        return F.when(b["part"] == "", F.lit(None)).when(
            F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.concat(head, b["part"], F.lit("'")))

    errors = F.filter(F.transform(_bounds(F.col(column)), problem), lambda e: e.isNotNull())
    return df.withColumn("error", F.try_element_at(errors, F.lit(1)))


def count_selected(chapters: DataFrame, pages: DataFrame, spec: str) -> DataFrame:
    """Pages left per chapter after the range, 0 when none."""
    counts = select_page_range(pages, spec).groupBy("chapter_id").agg(F.count("*").alias("n"))
    return chapters.join(counts, chapters["id"] == counts["chapter_id"], "left").select(
        *[chapters[c] for c in chapters.columns], F.coalesce("n", F.lit(0)).alias("page_count"))


def export_estimate(requests: DataFrame, chapters: DataFrame) -> DataFrame:
    """Estimated pages and megabytes per export.

    requests: export_id, page_range, quality. chapters: export_id, pages.
    Range lengths are added up (an overlap counts twice) and taken for every
    chapter; a range that cannot be read falls back to all pages.
    """
    totals = chapters.groupBy("export_id").agg(F.count("*").alias("chapters"), F.sum("pages").alias("all_pages"))
    bounds = _bounds(F.col("page_range"))
    length = F.aggregate(
        bounds, F.lit(0).cast("long"),
        lambda acc, b: acc + F.when(b["ranged"], b["hi"] - b["lo"] + 1).otherwise(F.lit(1).cast("long")))
    given = F.coalesce(F.col("page_range"), F.lit("")) != ""
    pages = F.coalesce(F.when(given, length * F.col("chapters")), "all_pages", F.lit(0))
    return requests.join(totals, "export_id", "left").select(
        *requests.columns, pages.alias("estimated_pages"),
        half_even(pages * (0.5 * (F.col("quality") / 90)), 1).alias("estimated_mb"))


def plan_page_paths(pages: DataFrame, layout: str = "import", image_format: str = "jpg") -> DataFrame:
    """Target path of each good page, as folder/name for the import or the export layout."""
    number = F.col("page_number").cast("int")
    ext = {"jpeg": "jpg"}.get(image_format.lower(), image_format.lower())
    if layout == "import":
        folder = F.concat_ws("/", F.col("project_id").cast("string"), F.col("chapter_id").cast("string"))
        ext = "jpg"
    else:
        folder = F.format_string("Chapter_%02d", F.col("chapter_number").cast("int"))
    good = pages.filter("success") if "success" in pages.columns else pages
    return good.withColumn("path", F.concat(folder, F.lit("/"), F.format_string(f"page_%04d.{ext}", number)))


def export_manifest(chapters: DataFrame, pages: DataFrame, page_range: str = "", image_format: str = "jpg",
                    generated_at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """JSON of every chapter, and the root JSON of every project.

    chapters: id, project_id, project_title, chapter_number, title. A root is one document that lists
    the project's chapters by number, so its size is that of one row.
    """
    stamp = F.date_format(generated_at if generated_at is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    fmt = F.lit(image_format.upper())
    counted = count_selected(chapters, pages, page_range)
    meta = F.to_json(F.struct(
        F.col("project_title").alias("manga_title"), "chapter_number", F.col("title").alias("chapter_title"),
        "page_count", fmt.alias("format"), stamp.alias("generated_at")))
    per_chapter = counted.select("project_id", F.col("id").alias("chapter_id"), meta.alias("manifest"))
    item = F.struct("chapter_number", "id", F.struct(
        F.col("chapter_number").alias("number"), "title", F.col("page_count").alias("pages")).alias("c"))
    roots = counted.groupBy("project_id").agg(
        F.max("project_title").alias("manga_title"), F.sort_array(F.collect_list(item)).alias("cs"),
        F.sum("page_count").alias("total_pages"), F.count("*").alias("total_chapters"))
    root = F.to_json(F.struct(
        "manga_title", F.transform("cs", lambda c: c["c"]).alias("chapters"), "total_chapters", "total_pages",
        fmt.alias("format"), stamp.alias("generated_at")))
    return per_chapter, roots.select("project_id", root.alias("manifest"))


def archive_manifest(chapters: DataFrame, pages: DataFrame, page_range: str = "", quality: int = 90,
                     language: str = "en", generated_at: Column | None = None) -> DataFrame:
    """Metadata of every project's comic archive: its chapters and totals, and the series blocks of comic readers.

    Returns project_id, comic_book_info (series block alone) and metadata (the whole document).
    """
    stamp = F.date_format(generated_at if generated_at is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    counted = count_selected(chapters, pages, page_range)
    item = F.struct("chapter_number", F.col("id").alias("by"), F.struct(
        F.col("id").cast("string").alias("id"), F.col("chapter_number").alias("number"), "title", "page_count").alias("c"))
    whole = counted.groupBy("project_id").agg(
        F.max("project_title").alias("manga_title"), F.sort_array(F.collect_list(item)).alias("cs"),
        F.sum("page_count").alias("n_pages"), F.count("*").alias("total_chapters"))
    series = F.struct(F.col("manga_title").alias("series"), F.lit("CBZ").alias("format"), F.col("n_pages").alias("pages"))
    reader = F.struct(F.col("manga_title").alias("series"), F.col("manga_title").alias("title"), F.lit("Manga").alias("genre"),
                      F.lit(language).alias("language"))
    return whole.select("project_id", F.to_json(series).alias("comic_book_info"), F.to_json(F.struct(
        stamp.alias("generated_at"), "manga_title", F.transform("cs", lambda c: c["c"]).alias("chapters"), "total_chapters",
        F.lit(quality).alias("quality"), series.alias("comic_book_info"), reader.alias("ComicRack"))).alias("metadata"))


def expired_exports(files: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Export files, or finished export tasks, strictly older than the given hours."""
    limit = now - F.make_dt_interval(hours=F.lit(hours))
    if "status" in files.columns:
        return files.filter(F.col("status").isin("completed", "failed", "cancelled") & (F.col("completed_at") < limit))
    return files.filter(F.col("modified_at") < limit)
