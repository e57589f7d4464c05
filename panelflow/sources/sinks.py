"""Page and manifest writers."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from panelflow.operators.exports import export_manifest, plan_page_paths
from panelflow.sources.files import open_files

LISTED = "path string, file string, size long, sha256 string"


def write_page_table(pages: DataFrame, path: str, layout: str = "import") -> None:
    """Pages with their target names, partitioned by project and chapter."""
    planned = plan_page_paths(pages, layout)
    # A chapter's pages come from one task, so that a folder has one file.
    planned.repartition("project_id", "chapter_id").write.mode("overwrite").partitionBy("project_id", "chapter_id").parquet(path)


def write_manifests(chapters: DataFrame, pages: DataFrame, path: str, page_range: str = "",
                    image_format: str = "jpg") -> None:
    """Chapter and root manifests as JSON lines under path/chapters and path/roots."""
    per_chapter, roots = export_manifest(chapters, pages, page_range, image_format)
    per_chapter.select("manifest").write.mode("overwrite").text(f"{path}/chapters")
    roots.select("manifest").write.mode("overwrite").text(f"{path}/roots")


@dataclass
class _Staged(WriterCommitMessage):
    """A task's list of the page files it wrote."""
    listing: str | None
    pages: int


class _PageWriter(DataSourceWriter):
    """Tasks write page files and a list of them under a folder of this job; the manifest that names the lists comes last."""

    def __init__(self, root: str):
        self.root, self.job = root.rstrip("/"), f"pages/{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> _Staged:
        import hashlib

        lines, task = [], uuid.uuid4().hex  # a task that is tried again writes other files
        for row in iterator:
            file = f"{self.job}/{task}/{row.path}"
            fs, place = open_files(f"{self.root}/{file}")
            fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
            content = bytes(row.content)
            with fs.open_output_stream(place) as out:
                out.write(content)
            lines.append(json.dumps({"path": row.path, "file": file, "size": len(content), "sha256": hashlib.sha256(content).hexdigest()}))
        if not lines:
            return _Staged(None, 0)
        listing = f"{self.job}/{task}.jsonl"
        fs, place = open_files(f"{self.root}/{listing}")
        with fs.open_output_stream(place) as out:
            out.write("\n".join(lines).encode())
        return _Staged(listing, len(lines))

    def commit(self, messages: list[_Staged | None]) -> None:
        done = [m for m in messages if m and m.listing]
        fs, folder = open_files(f"{self.root}/_manifests")
        fs.create_dir(folder, recursive=True)
        name = self.job.rsplit("/", 1)[1]
        with fs.open_output_stream(f"{folder}/.{name}") as out:
            out.write(json.dumps({"pages": sum(m.pages for m in done), "listings": [m.listing for m in done]}).encode())
        fs.move(f"{folder}/.{name}", f"{folder}/{name}.json")

    def abort(self, messages: list[_Staged | None]) -> None:
        from pyarrow.fs import FileType

        fs, folder = open_files(f"{self.root}/{self.job}")
        if fs.get_file_info(folder).type == FileType.Directory:
            fs.delete_dir(folder)


class PageSink(DataSource):
    """Write-only source ``panelflow_pages`` for rows (path string, content binary); option ``path`` is the root folder."""

    @classmethod
    def name(cls) -> str:
        return "panelflow_pages"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _PageWriter(self.options["path"])


def write_pages(pages: DataFrame, root: str) -> None:
    """Write page files (path, content) in two phases.

    Tasks stage files in a folder of the job; one manifest, published last by a rename, makes all of them visible at once.
    A job that fails shows no page and removes what it staged; a task that is tried again, or an executor that is lost,
    leaves files that no manifest names. The driver handles one message for each task.
    """
    pages.sparkSession.dataSource.register(PageSink)
    pages.select("path", "content").write.format(PageSink.name()).mode("append").save(root)


def read_pages(spark: SparkSession, root: str) -> DataFrame:
    """The pages that manifests of a root folder name: (path, file, size, sha256). Of a path written twice both are listed."""
    root = root.rstrip("/")
    fs, folder = open_files(f"{root}/_manifests")
    from pyarrow.fs import FileSelector
    listings = []
    for info in fs.get_file_info(FileSelector(folder, allow_not_found=True)):
        if info.base_name.endswith(".json"):
            with fs.open_input_file(info.path) as held:
                listings += json.loads(held.read())["listings"]
    paths = [f"{root}/{listing}" for listing in sorted(listings)]
    return spark.read.schema(LISTED).json(paths) if paths else spark.createDataFrame([], LISTED)
