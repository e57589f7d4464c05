"""Queries of page files, archives, sinks and supplied engines. Their files are written by Spark tasks from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow import schema
from panelflow.checks.base import query, sql
from panelflow.plans.localize import run_engine
from panelflow.session import scratch_path
from panelflow.sources import files, sinks
from panelflow.sources.tables import CatalogStore, load_catalog
from panelflow.streaming import events as S


def _put(rows: DataFrame, folder: str) -> None:
    """Write (name, content) rows as files."""
    def run(batches):
        import pandas as pd

        from panelflow.sources.files import open_files
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                fs, place = open_files(f"{folder}/{name}")
                fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(place) as out:
                    out.write(content)
            yield pd.DataFrame({"files": [len(batch)]})

    rows.mapInPandas(run, "files long").agg(F.sum("files")).collect()


NAMED = """named AS (SELECT page_id, 'page_' || page_id || CASE page_id % 5 WHEN 0 THEN '.PNG' WHEN 1 THEN '.txt' ELSE '.jpg' END AS filename,
    CAST(strlen(html) AS BIGINT) AS length FROM pages)"""


def _named(d):
    ending = F.when(F.col("page_id") % 5 == 0, ".PNG").when(F.col("page_id") % 5 == 1, ".txt").otherwise(".jpg")
    return d.table("pages").select("page_id", F.concat(F.lit("page_"), F.col("page_id").cast("string"), ending).alias("name"),
                                   F.col("html").cast("binary").alias("content"))


@query(sql("SELECT filename, lower(right(filename, 3)) AS extension, length FROM named WHERE filename NOT LIKE '%.txt'", extra=NAMED))
def read_page_files(d):
    folder = scratch_path(d.spark, "files")
    _put(_named(d), folder)
    return files.read_page_files(d.spark, folder).select("filename", "extension", "length")


@query(sql("SELECT filename, length FROM named WHERE filename NOT LIKE '%.txt'", extra=NAMED))
def stream_page_files(d):
    """Half of the files are there at the first start of the stream, the rest at the second."""
    root = scratch_path(d.spark, "filestream")
    for half in (0, 1):
        _put(_named(d).filter(F.col("page_id") % 2 == half), f"{root}/in")
        S.run_available(files.stream_page_files(d.spark, f"{root}/in").select("filename", "length"), f"{root}/out", f"{root}/checkpoint")
    return d.spark.read.parquet(f"{root}/out")


@query(sql("""SELECT archive, row_number() OVER (PARTITION BY archive ORDER BY page_id, n)::INTEGER AS page_number, 'p' || page_id || '_' || n || '.png' AS filename,
    strlen(html)::BIGINT + n AS size, md5(html || repeat('x', n::INTEGER)) AS digest
    FROM (SELECT page_id % 5 AS archive, page_id, html, unnest([1, 2, 3]) AS n FROM pages)"""))
def read_archive_pages(d):
    """Five archives of all pages, written page by page, read entry by entry in splits of 16 KB."""
    folder = scratch_path(d.spark, "archives")

    def pack(batches):
        import zipfile

        import pandas as pd

        from panelflow.sources.files import open_files
        at, out, archive = None, None, None
        for batch in batches:
            for number, page_id, html in zip(batch["archive"], batch["page_id"], batch["html"], strict=True):
                if number != at:
                    if archive:
                        archive.close()
                        out.close()
                    fs, place = open_files(f"{folder}/a{number}.cbz")
                    fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
                    at, out = number, fs.open_output_stream(place)
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                for n in (3, 1, 2):
                    archive.writestr(f"d/p{page_id}_{n}.png", html.encode() + b"x" * n)
            yield pd.DataFrame({"pages": [len(batch)]})
        if archive:
            archive.close()
            out.close()

    # More partitions than archives, so that few of these share one.
    dealt = d.table("pages").select("page_id", "html", (F.col("page_id") % 5).alias("archive")).repartition(40, "archive")
    dealt.sortWithinPartitions("archive").mapInPandas(pack, "pages long").agg(F.sum("pages")).collect()
    found = files.read_archive_pages(d.spark, folder, split_bytes=16_384)
    return found.select(F.regexp_extract("archive_path", r"a(\d+)\.cbz$", 1).cast("long").alias("archive"), "page_number", "filename", "size",
                        F.md5("content").alias("digest"))


@query(sql("""SELECT (page_id % 7) || '/' || (page_id % 31) || '/page_' || lpad(page_id::VARCHAR, 6, '0') || '.jpg' AS path, strlen(html)::BIGINT AS size,
    sha256(html) AS sha256 FROM pages"""))
def page_sink(d):
    """Page files written in two phases and read back through their manifest."""
    folder, k = scratch_path(d.spark, "pages"), F.col("page_id")
    path = F.concat_ws("/", (k % 7).cast("string"), (k % 31).cast("string"), F.concat(F.lit("page_"), F.lpad(k.cast("string"), 6, "0"), F.lit(".jpg")))
    sinks.write_pages(d.table("pages").select(path.alias("path"), F.col("html").cast("binary").alias("content")), folder)
    return sinks.read_pages(d.spark, folder).select("path", "size", "sha256")


@query(sql("""SELECT 'projects' AS name, id::VARCHAR AS id, title FROM projects UNION ALL SELECT 'chapters', id::VARCHAR, title FROM chapters""", "projects", "chapters"))
def load_catalog_tables(d):
    """Projects and chapters stored, then loaded with the catalogue's fixed schemas."""
    store = CatalogStore(d.spark, scratch_path(d.spark, "catalogue"))
    for name, df in (("projects", d.projects), ("chapters", d.chapters)):
        given = {f.name: f for f in schema.CATALOG[name].fields}
        store.save(df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(f.dataType).alias(c) for c, f in given.items()]), name)
    loaded = load_catalog(d.spark, store.root)
    return loaded["projects"].select(F.lit("projects").alias("name"), "id", "title").unionByName(
        loaded["chapters"].select(F.lit("chapters").alias("name"), "id", "title"))


@query(sql("""SELECT page_id, 'blocks' AS engine, len(regexp_extract_all(html, '<p')) AS regions, strlen(html)::BIGINT AS size FROM pages"""))
def run_supplied_engine(d):
    """A detector given as a function over batches of page rows."""
    def engine(batches):
        for b in batches:
            yield b[["page_id"]].assign(engine="blocks", regions=b["html"].str.count("<p"), size=[len(h.encode()) for h in b["html"]])

    return run_engine(d.table("pages").select("page_id", "html"), engine, "page_id long, engine string, regions long, size long")
