"""Imports and bulk changes of the catalog tables.

A catalog is a dict of DataFrames named projects, chapters, pages, bubbles,
jobs and segments. Every function returns new DataFrames; writing them is
:mod:`panelflow.sources.tables`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow import schema
from panelflow.functions import geometry as g
from panelflow.functions import text as t
from panelflow.functions.values import counts_map, half_even
from panelflow.operators.skew import first_rows, numbered, sized_broadcast
from panelflow.session import cut

Catalog = dict[str, DataFrame]


# --- decoding and uniting ---------------------------------------------------

def decode_json_columns(df: DataFrame) -> DataFrame:
    """Typed values for the JSON text columns present; a missing polygon becomes the box's corners."""
    out = df
    if "tags" in df.columns:
        out = out.withColumn("tags", F.from_json("tags", "array<string>"))
    for name in ("metadata_json", "options_json"):
        if name in df.columns:
            out = out.withColumn(name, F.from_json(name, "map<string,string>"))
    if "polygon_json" in df.columns:
        points = F.transform(F.from_json("polygon_json", "array<array<double>>"), lambda p: g.point(p[0], p[1]))
        corners = g.polygon_from_bbox(*[F.col(c) for c in ("x", "y", "width", "height")])
        out = out.withColumn("polygon", F.coalesce(points, corners)).drop("polygon_json")
    return out


def union_engine_outputs(outputs: dict[str, DataFrame]) -> DataFrame:
    """One table of all engines' rows; columns an engine lacks are null."""
    frames = [df.withColumn("engine", F.lit(name)) for name, df in outputs.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


# --- files ------------------------------------------------------------------

def number_pages(files: DataFrame, source: str = "source", name: str = "filename", **kw) -> DataFrame:
    """Page numbers 1..n per source in natural order of the name."""
    ties = [F.col(name)] + ([F.col("id")] if "id" in files.columns else [])
    return numbered(files, [source], [t.natural_key(F.col(name)), *ties], "page_number", **kw)


def append_pages(existing: DataFrame, new: DataFrame, **kw) -> DataFrame:
    """New pages numbered after the highest existing number of their chapter."""
    last = existing.groupBy("chapter_id").agg(F.max("page_number").alias("last"))
    rows = numbered(new, ["chapter_id"], [t.natural_key(F.col("filename")), F.col("filename"), F.col("id")], "__n", **kw)
    return rows.join(last, "chapter_id", "left").withColumn(
        "page_number", F.coalesce("last", F.lit(0)) + F.col("__n")).drop("last", "__n")


def refresh_page_counts(chapters: DataFrame, pages: DataFrame) -> DataFrame:
    """Chapters with page_count as their pages now say, for use after pages were appended or removed."""
    counts = pages.groupBy("chapter_id").agg(F.count("*").cast("int").alias("__n"))
    return chapters.join(counts, chapters["id"] == counts["chapter_id"], "left").select(
        *[chapters[c] for c in chapters.columns if c != "page_count"], F.coalesce("__n", F.lit(0)).alias("page_count"))


def validate_uploads(files: DataFrame, batch: str = "batch") -> DataFrame:
    """Error text per file (null when fine) and whether the whole batch is accepted."""
    ext = t.extension(F.col("filename"))
    mb = F.format_string("%.1f", half_even(F.col("size") / (1024 * 1024), 1))  # format_string alone takes ties up
    error = (
        F.when(~ext.isin([f".{e}" for e in schema.IMAGE_EXTENSIONS]), F.concat(F.lit("Unsupported file type: "), ext))
        .when(F.col("size") > schema.MAX_PAGE_BYTES, F.concat(F.lit("File too large: "), mb, F.lit(" MB. Max: 50 MB")))
        .when((F.col("width") > schema.MAX_DIMENSION) | (F.col("height") > schema.MAX_DIMENSION),
              F.lit("Image dimensions too large")))
    checked = files.withColumn("error", error)
    bad = checked.filter(F.col("error").isNotNull()).select(batch).distinct().withColumn("__bad", F.lit(True))
    return checked.join(bad, batch, "left").withColumn("accepted", F.col("__bad").isNull()).drop("__bad")


def import_summary(files: DataFrame, source: str = "source", max_errors: int | None = 50) -> DataFrame:
    """Totals, format counts, first errors (None: all of them) and first page sizes per source."""
    fmt = F.coalesce(F.nullif(F.col("original_format"), F.lit("")), F.lit("unknown"))
    totals = files.groupBy(source).agg(
        F.count("*").alias("total_pages"), F.count_if("success").alias("successful_pages"),
        F.count_if(~F.col("success")).alias("failed_pages"), F.sum("size").alias("total_bytes"))
    formats = files.groupBy(source, fmt.alias("fmt")).agg(F.count("*").alias("n")).groupBy(source).agg(
        counts_map(F.col("fmt"), F.col("n")).alias("formats"))

    def in_order(rows: DataFrame, value: Column, name: str) -> DataFrame:
        pairs = F.sort_array(F.collect_list(F.struct("page_number", value.alias("v"))))
        return rows.groupBy(source).agg(F.transform(pairs, lambda p: p["v"]).alias(name))

    failed = files.filter(~F.col("success"))
    errors = in_order(failed if max_errors is None else first_rows(failed, [source], [F.col("page_number")], max_errors),
                      F.col("error"), "errors")
    five = files.filter((F.col("page_number") <= 5) & F.col("success"))
    sizes = in_order(five, F.struct("width", "height"), "sizes").select(
        source, F.transform("sizes", lambda s: s["width"]).alias("page_widths"),
        F.transform("sizes", lambda s: s["height"]).alias("page_heights"))
    out = totals
    for frame in (formats, errors, sizes):
        out = out.join(frame, source, "left")
    none = F.array().cast("array<string>")
    return out.withColumn("errors", F.coalesce("errors", none))


def import_metadata(sources: DataFrame, name: str = "filename") -> DataFrame:
    """Chapter number, title and format read from an import's file name."""
    c = F.col(name)
    return sources.withColumns({
        "original_format": F.regexp_replace(t.extension(c), r"^\.", ""),
        "detected_chapter": t.detected_chapter(c), "detected_title": t.detected_title(c)})


def import_report(files: DataFrame, source: str = "source", pages: int = 200, errors: int = 50) -> DataFrame:
    """Rows shown for an import: its first pages, and its first failures."""
    order = [F.col("page_number")]
    shown = first_rows(files, [source], order, pages).withColumn("section", F.lit("page"))
    failed = first_rows(files.filter(~F.col("success")), [source], order, errors).withColumn("section", F.lit("error"))
    return shown.unionByName(failed)


def thumbnail_candidates(files: DataFrame, source: str = "source", n: int = 10) -> DataFrame:
    """Successful pages among the first n."""
    return first_rows(files, [source], [F.col("page_number")], n).filter("success")


def storage_usage(files: DataFrame, level: int = -3) -> DataFrame:
    """Bytes and files per project; the project is the path part at ``level`` (project/chapter/file)."""
    parts = F.split("path", "/")
    return files.groupBy(F.try_element_at(parts, F.lit(level)).alias("project_id")).agg(
        F.sum("length").alias("storage_bytes"), F.count("*").alias("file_count"))


# --- find or create ---------------------------------------------------------

def earliest_containing(patterns: DataFrame, titles: DataFrame) -> DataFrame:
    """For each (pattern) the smallest ``pick`` of the (title, pick) rows whose title contains it.

    Case-insensitive, with % and _ in a pattern as wildcards. No pattern meets
    a title it does not share text with: titles are indexed by their
    substrings of the lengths that patterns have, each substring keeping only
    its smallest pick, so a plain pattern meets exactly one index row. A
    pattern with wildcards looks up its longest plain run and is then tested.
    """
    p = patterns.select(F.lower("pattern").alias("p")).distinct().withColumn(
        "run", F.array_max(F.transform(F.split("p", "[%_]+"), lambda s: F.struct(F.length(s).alias("n"), s.alias("s")))))
    p = p.select("p", F.col("run.n").alias("n"), F.col("run.s").alias("run"))
    tt = titles.groupBy(F.lower("title").alias("title")).agg(F.min("pick").alias("pick"))
    # The distinct lengths of patterns come to the driver: small integers, as many as the longest title has letters.
    lengths = sorted(r[0] for r in p.select("n").distinct().collect() if r[0] > 0)
    spans = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("title"))
    index = tt.withColumn("__n", F.explode(spans)).withColumn(
        "__at", F.explode(F.sequence(F.lit(1), F.length("title") - F.col("__n") + 1))).select(
        F.col("title").substr(F.col("__at"), F.col("__n")).alias("run"), "title", "pick")
    plain = p.filter((F.col("n") > 0) & (F.col("p") == F.col("run")))
    wanted = index.join(sized_broadcast(plain.select("run")), "run", "left_semi")
    found = plain.join(wanted.groupBy("run").agg(F.min("pick").alias("pick")), "run").select("p", "pick")
    wild = p.filter((F.col("n") > 0) & (F.col("p") != F.col("run")))
    test = F.like("title", F.concat(F.lit("%"), F.replace("p", F.lit("\\"), F.lit("\\\\")), F.lit("%")))
    near = index.join(sized_broadcast(wild.select("run").distinct()), "run", "left_semi").distinct()
    tested = wild.join(near, "run").filter(test).groupBy("p").agg(F.min("pick").alias("pick"))
    # Only wildcards: the number of _ is the least title length.
    bare = p.filter(F.col("n") == 0).select("p", F.length(F.replace("p", F.lit("%"), F.lit(""))).alias("least"))
    by_length = tt.groupBy(F.length("title").alias("len")).agg(F.min("pick").alias("pick"))
    least = by_length.withColumn("least", F.explode(F.sequence(F.lit(0), "len"))).groupBy("least").agg(
        F.min("pick").alias("pick"))
    return found.unionByName(tested).unionByName(bare.join(least, "least").select("p", "pick"))


def match_projects(imports: DataFrame, projects: DataFrame, title: str = "title") -> DataFrame:
    """Add the project whose title contains the import's title: the earliest made, then the lowest id."""
    picks = projects.select("title", F.struct("created_at", "id").alias("pick"))
    best = earliest_containing(imports.select(F.col(title).alias("pattern")), picks)
    return imports.withColumn("p", F.lower(title)).join(best, "p", "left").withColumn(
        "project_id", F.col("pick.id")).drop("p", "pick")


ACTIVE = ["pending", "queued", "processing"]


def active_job_conflicts(new_jobs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Mark new jobs whose chapter has an unfinished job already, also one earlier in the batch."""
    busy = jobs.filter(F.col("status").isin(ACTIVE)).select("chapter_id").distinct().withColumn("__busy", F.lit(True))
    first = new_jobs.groupBy("chapter_id").agg(F.min("id").alias("__first"))
    return new_jobs.join(first, "chapter_id", "left").join(busy, "chapter_id", "left").withColumn(
        "conflict", F.col("__busy").isNotNull() | F.coalesce(F.col("id") != F.col("__first"), F.lit(False))
    ).drop("__first", "__busy")


def chapter_conflicts(new: DataFrame, chapters: DataFrame) -> DataFrame:
    """Mark new chapters whose (project, number) exists already, also earlier in the batch."""
    keys = ["project_id", "chapter_number"]
    known = chapters.select(*keys).distinct().withColumn("__known", F.lit(True))
    first = new.groupBy(*keys).agg(F.min("id").alias("__first"))
    return new.join(first, keys, "left").join(known, keys, "left").withColumn(
        "conflict", F.col("__known").isNotNull() | (F.col("id") != F.col("__first"))).drop("__first", "__known")


def upsert_imports(catalog: Catalog, imports: DataFrame, files: DataFrame) -> Catalog:
    """Add imported archives: find or create the project, one new chapter, a page per good file.

    imports: id, filename, project_title, chapter_number, author, source_language,
    target_language, created_at. files: import_id, page_number, path, success, width, height.
    Among imports of one batch the earliest id whose title contains the title makes the project.
    """
    titled = imports.withColumn("title", F.coalesce(t.detected_title(F.col("filename")), F.col("project_title")))
    # Import-sized tables with several readers are written once.
    matched = cut(match_projects(titled, catalog["projects"]))
    fresh = matched.filter(F.col("project_id").isNull())
    makers = earliest_containing(
        fresh.select(F.col("title").alias("pattern")), fresh.select("title", F.struct("id").alias("pick")))
    placed = matched.withColumn("p", F.lower("title")).join(makers, "p", "left").withColumn(
        "maker", F.when(F.col("project_id").isNull(), F.coalesce("pick.id", "id"))).drop("p", "pick")
    placed = cut(placed.withColumn("project_id", F.coalesce("project_id", F.concat(F.lit("prj-"), F.col("maker")))))
    projects = placed.filter(F.col("maker") == F.col("id")).select(
        F.col("project_id").alias("id"), "title", F.coalesce("author", "filename").alias("author"),
        "source_language", "target_language", "created_at", F.col("created_at").alias("updated_at"))
    good = files.filter("success")
    counts = good.groupBy("import_id").agg(F.count("*").alias("page_count"))
    chapter_id = F.concat(F.lit("chp-"), F.col("id"))
    number = F.coalesce("chapter_number", t.detected_chapter(F.col("filename")))
    chapters = placed.join(counts, F.col("id") == F.col("import_id"), "left").select(
        chapter_id.alias("id"), "project_id",
        F.coalesce(F.nullif(number, F.lit(0.0)), F.lit(1.0)).alias("chapter_number"),
        F.substring(t.stem(F.col("filename")), 1, 255).alias("title"),
        F.coalesce("page_count", F.lit(0)).cast("int").alias("page_count"), F.lit(False).alias("is_translated"),
        "created_at")
    stamp = imports.select(F.col("id").alias("import_id"), "created_at")
    pages = good.join(stamp, "import_id").select(
        F.concat(F.lit("pg-"), "import_id", F.lit("-"), F.col("page_number").cast("string")).alias("id"),
        F.concat(F.lit("chp-"), "import_id").alias("chapter_id"), F.col("page_number").cast("int").alias("page_number"),
        F.col("path").alias("original_image_path"), "width", "height", "created_at")
    added = {"projects": projects, "chapters": chapters, "pages": pages}
    return {n: df.unionByName(added[n], allowMissingColumns=True) if n in added else df for n, df in catalog.items()}


# --- bulk changes -----------------------------------------------------------

def cascade_delete(catalog: Catalog, project_ids: DataFrame | None = None,
                   chapter_ids: DataFrame | None = None) -> Catalog:
    """Delete projects and/or chapters with everything under them. Jobs stay, without chapter;
    segments go with their page. The large tables stream past the deleted ids, which a task holds
    hashed; to merge the two, a task would hold its share of the large table to sort it."""
    out = dict(catalog)
    chapters = catalog["chapters"]
    gone = None
    if project_ids is not None:
        doomed = project_ids.select("id").hint("shuffle_hash")
        out["projects"] = catalog["projects"].join(doomed, "id", "left_anti")
        gone = chapters.join(doomed.withColumnRenamed("id", "project_id").hint("shuffle_hash"), "project_id", "left_semi").select("id")
    if chapter_ids is not None:
        named = chapters.join(chapter_ids.select("id").hint("shuffle_hash"), "id", "left_semi").select("id")
        gone = named if gone is None else gone.unionByName(named).distinct()
    gone = gone.hint("shuffle_hash")
    out["chapters"] = chapters.join(gone, "id", "left_anti")
    gone = gone.withColumnRenamed("id", "chapter_id").hint("shuffle_hash")
    gone_pages = catalog["pages"].join(gone, "chapter_id", "left_semi").select(F.col("id").alias("page_id")).hint("shuffle_hash")
    out["pages"] = catalog["pages"].join(gone, "chapter_id", "left_anti")
    for name in ("bubbles", "segments"):
        if name in catalog:
            out[name] = catalog[name].join(gone_pages, "page_id", "left_anti")
    if "jobs" in catalog:
        jobs, lost = catalog["jobs"], gone.withColumn("__gone", F.lit(True)).hint("shuffle_hash")
        out["jobs"] = jobs.join(lost, "chapter_id", "left").withColumn(
            "chapter_id", F.when(F.col("__gone").isNull(), F.col("chapter_id"))).select(*jobs.columns)
    return out


def duplicate_projects(catalog: Catalog, ids: DataFrame, now: Column, new_title: str | None = None,
                       new_id: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Copies of projects and of their chapters (number and title only).

    Ids derive from the old id and the time, so a retried task makes the same ones;
    ``new_id`` (over columns id and now) replaces that rule.
    """
    def fresh(column: str) -> Column:
        return new_id if new_id is not None else F.md5(F.concat_ws(
            ":", F.lit("copy"), F.col(column).cast("string"), now.cast("string")))

    title = F.lit(new_title) if new_title else F.concat("title", F.lit(" (Copy)"))
    chosen = catalog["projects"].join(ids.select("id"), "id", "left_semi")
    projects = chosen.withColumns({"old_id": F.col("id"), "id": fresh("id"), "title": title,
                                   "created_at": now, "updated_at": now})
    links = projects.select(F.col("old_id").alias("project_id"), F.col("id").alias("__new"))
    chapters = catalog["chapters"].join(links, "project_id").select(
        fresh("id").alias("id"), F.col("__new").alias("project_id"), "chapter_number", "title",
        F.lit(0).alias("page_count"), F.lit(False).alias("is_translated"), now.alias("created_at"))
    return projects.drop("old_id"), chapters


def apply_updates(table: DataFrame, updates: DataFrame, key: str, now: Column) -> DataFrame:
    """Change only provided values. ``updates`` has the key and any of the table's columns;
    null means not provided. A column listed in its array column ``cleared`` is set to null."""
    fields = [c for c in updates.columns if c not in (key, "cleared")]
    renamed = updates.select(key, *[F.col(c).alias(f"__u_{c}") for c in fields],
                             F.col("cleared").alias("__cleared") if "cleared" in updates.columns
                             else F.array().cast("array<string>").alias("__cleared"), F.lit(True).alias("__hit"))
    joined = table.join(renamed, key, "left")
    new = {c: F.when(F.coalesce(F.array_contains("__cleared", c), F.lit(False)), F.lit(None))
           .otherwise(F.coalesce(f"__u_{c}", c)) for c in fields}
    if "updated_at" in table.columns:
        new["updated_at"] = F.when(F.col("__hit"), now).otherwise(F.col("updated_at"))
    return joined.withColumns(new).select(*table.columns)


def align_texts(bubbles: DataFrame, calls: DataFrame, translations: DataFrame) -> DataFrame:
    """OCR calls with the bubble and translation of the same (page_id, region_index).
    Bubbles are capped per page, so later calls have no bubble."""
    own = bubbles.select("page_id", "region_index", F.col("id").alias("bubble_id"))
    return calls.join(own, ["page_id", "region_index"], "left").join(
        translations.select("page_id", "region_index", "translated_text"), ["page_id", "region_index"], "left")


def build_segments(bubbles: DataFrame, calls: DataFrame, translations: DataFrame,
                   pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments of all non-blank calls, and the bubbles updated from them.

    pages: page_id, job_id, source_language, target_language (of the project).
    """
    aligned = align_texts(bubbles, calls, translations)
    spoken = aligned.filter(t.has_text(F.col("text")))
    language = [F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d)).alias(c)
                for c, d in (("source_language", "ja"), ("target_language", "en"))]
    segments = spoken.join(pages, "page_id").select(
        F.concat_ws("-", F.lit("seg"), F.col("page_id").cast("string"), F.col("region_index").cast("string")).alias("id"),
        "job_id", "page_id", "bubble_id", F.col("text").alias("original_text"),
        F.coalesce("translated_text", F.lit("")).alias("translated_text"),
        F.col("confidence").alias("ocr_confidence"), *language, F.lit("completed").alias("status"),
        (F.coalesce("processing_time_ms", F.lit(0.0)) if "processing_time_ms" in spoken.columns else F.lit(0.0)).alias(
            "processing_time_ms"))
    new = aligned.filter(F.col("bubble_id").isNotNull()).select(
        "bubble_id", F.col("text").alias("__text"), F.col("confidence").alias("__conf"),
        F.coalesce("translated_text", F.lit("")).alias("__tr"), F.col("rotation").alias("__rot"))
    said = t.has_text(F.col("__text"))

    def pick(new_value: Column, old: str) -> Column:
        return F.when(said, new_value).otherwise(F.col(old))

    updated = bubbles.join(new, bubbles["id"] == new["bubble_id"], "left").withColumns({
        "original_text": pick(F.col("__text"), "original_text"),
        "translated_text": pick(F.col("__tr"), "translated_text"),
        "is_translated": F.when(said, True).otherwise(F.col("is_translated")),
        "confidence": pick(F.col("__conf"), "confidence"),
        "rotation": F.when(F.col("__rot") != 0, F.col("__rot")).otherwise(F.col("rotation")),
    }).select(*bubbles.columns)
    return segments, updated
