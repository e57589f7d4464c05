"""Page files and page archives."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from itertools import islice
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelflow import schema
from panelflow.functions import text as t
from panelflow.session import cut

ENTRY = ("archive_path string, page_number int, entry_name string, filename string, size long, "
         "format string, content binary, success boolean, error string")
SPLIT_BYTES = 64 * 2**20
MOST_TASKS = 20_000
LISTED_ROWS = 10_000
# Where an entry lies in its archive and how it is packed: what its directory says.
PLACE = "raw_name string, header_offset long, packed long, method int, flags int, crc long, end_offset long"
_LISTED = ["path", "length", "modificationTime"]
_IMAGE_SUFFIXES = {f".{e}" for e in schema.IMAGE_EXTENSIONS}


def _images(files: DataFrame) -> DataFrame:
    ext = F.regexp_replace(t.extension(F.col("path")), r"^\.", "")
    return files.withColumns({"filename": t.basename(F.col("path")), "extension": ext}).filter(
        F.col("extension").isin(schema.IMAGE_EXTENSIONS))


def read_page_files(spark: SparkSession, path: str, recursive: bool = False, content: bool = False) -> DataFrame:
    """Image files of a folder. Bytes are read only when asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return _images(files if content else files.select(*_LISTED))


def stream_page_files(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """The same listing as a stream that picks up new files."""
    fixed = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(fixed).load(path)
    return _images(files if content else files.select(*_LISTED))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return files.filter(t.extension(F.col("path")).isin(".zip", ".cbz", ".cbr"))


def _natural(name: str) -> list:
    """Same order as functions.text.natural_key, for the entries inside one archive."""
    runs = re.findall(r"[^0-9]+[0-9]*|[0-9]+", name)
    parts = [re.fullmatch(r"([^0-9]*)([0-9]*)", run).groups() for run in runs]
    return [(text.lower(), len(n.lstrip("0") or "0") if n else 0, n.lstrip("0") or "0" if n else "") for text, n in parts]


def _entries(path: str, content: bytes, max_entry: int) -> Iterator[tuple]:
    name = PurePosixPath(path).name

    def broken(error: str) -> tuple:
        return path, None, None, name, None, None, None, False, error

    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except Exception as e:
        if name.lower().endswith(".cbr"):
            yield broken("No RAR library available")
        else:
            yield broken(f"Corrupted archive file: {e}")
        return
    with archive:
        images = [n for n in archive.namelist() if PurePosixPath(n.lower()).suffix in _IMAGE_SUFFIXES]
        if not images:
            yield broken(f"No supported images found in {name}")
        for number, entry in enumerate(sorted(images, key=_natural), 1):
            base, size = PurePosixPath(entry).name, archive.getinfo(entry).file_size
            kind = PurePosixPath(entry).suffix.lower().lstrip(".")
            if size > max_entry:
                yield path, number, entry, base, size, "", None, False, f"Page too large: {size / 2**20:.1f} MB"
                continue
            try:
                yield path, number, entry, base, size, kind, archive.read(entry), True, None
            except Exception as e:
                yield path, number, entry, base, 0, "", None, False, f"Failed to extract {entry}: {str(e)[:100]}"


def open_files(uri: str):
    """File system and path of a URI, as Spark writes paths (blanks and the like unescaped), for reads and writes inside tasks."""
    from urllib.parse import quote

    from pyarrow import fs

    local = re.match(r"(?:file:)?(?://)?(/.*)", uri, re.S)
    return (fs.LocalFileSystem(), local[1]) if local else fs.FileSystem.from_uri(quote(uri, safe=":/%?=&@+~,;"))


def archive_entries(spark: SparkSession, path: str, max_entry: int = schema.MAX_PAGE_BYTES, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Image entries of all archives of a folder, from their directories alone: the columns of ``explode_archives`` without
    content, ``split``, which changes after every ``split_bytes`` of compressed entries in natural order, and those of ``PLACE``."""
    listed = read_archives(spark, path).select("path")
    kind = ", ".join([*(c for c in ENTRY.split(", ") if not c.startswith("content")), "split long", *PLACE.split(", ")])
    columns = [c.split()[0] for c in kind.split(", ")]
    whole = {c.split()[0]: "Int32" if c.endswith(" int") else "Int64" for c in kind.split(", ") if c.endswith((" int", " long"))}
    nowhere = (None,) * len(PLACE.split(", "))

    def entries(path: str) -> Iterator[tuple]:
        name = PurePosixPath(path).name
        try:
            fs, place = open_files(path)
            opened = fs.open_input_file(place)
            try:
                archive = zipfile.ZipFile(opened)
            except (OSError, ValueError) as e:  # too short to look for a directory
                raise zipfile.BadZipFile("File is not a zip file") from e
        except Exception as e:
            error = "No RAR library available" if name.lower().endswith(".cbr") else f"Corrupted archive file: {e}"
            yield path, None, None, name, None, None, False, error, 0, *nowhere
            return
        with archive:
            images = [n for n in archive.namelist() if PurePosixPath(n.lower()).suffix in _IMAGE_SUFFIXES]
            if not images:
                yield path, None, None, name, None, None, False, f"No supported images found in {name}", 0, *nowhere
            packed = 0
            for number, entry in enumerate(sorted(images, key=_natural), 1):
                info, kind = archive.getinfo(entry), PurePosixPath(entry).suffix.lower().lstrip(".")
                large = info.file_size > max_entry
                yield (path, number, entry, PurePosixPath(entry).name, info.file_size, "" if large else kind, not large,
                       f"Page too large: {info.file_size / 2**20:.1f} MB" if large else None, packed // split_bytes,
                       info.orig_filename, info.header_offset, info.compress_size, info.compress_type, info.flag_bits, info.CRC,
                       getattr(info, "_end_offset", None))
                packed += info.compress_size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                found = entries(path)
                while rows := list(islice(found, LISTED_ROWS)):
                    yield pd.DataFrame(rows, columns=columns).astype(whole)

    return listed.mapInPandas(run, kind)


def _read_entry(archive: zipfile.ZipFile, r) -> bytes:
    """An entry by its place from the listing, without its archive's directory."""
    info = zipfile.ZipInfo(r.raw_name)
    info.header_offset, info.compress_size, info.file_size = int(r.header_offset), int(r.packed), int(r.size_)
    info.compress_type, info.flag_bits, info.CRC = int(r.method), int(r.flags), int(r.crc)
    if not pd.isna(r.end_offset):
        info._end_offset = int(r.end_offset)
    return archive.read(info)


def read_archive_pages(spark: SparkSession, path: str, max_entry: int = schema.MAX_PAGE_BYTES, split_bytes: int = SPLIT_BYTES,
                       batch_bytes: int = 16 * 2**20) -> DataFrame:
    """As ``explode_archives``, read entry by entry: an archive is never held whole and its splits go to different tasks,
    so its size is not bounded by a row or a task. A directory is read once, by the listing; the tasks that read its
    entries know their places from there, so the work grows with the entries, not with entries times splits."""
    columns = [c.split()[0] for c in ENTRY.split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns).astype({"page_number": "Int32", "size": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened, rows, held = None, [], 0
        archive = zipfile.ZipFile(io.BytesIO(b"PK\5\6" + bytes(18)))  # without entries; reads those of the file put under it
        for batch in batches:
            for r in batch.itertuples(index=False):
                number, size = (None if pd.isna(v) else int(v) for v in (r.page_number, r.size_))
                row = (r.archive_path, number, r.entry_name, r.filename, size, r.format, None, bool(r.success), r.error)
                if r.success:
                    if opened != r.archive_path:
                        fs, place = open_files(r.archive_path)
                        opened, archive.fp = r.archive_path, fs.open_input_file(place)
                    try:
                        row = (*row[:6], _read_entry(archive, r), True, None)
                    except Exception as e:
                        row = (*row[:4], 0, "", None, False, f"Failed to extract {r.entry_name}: {str(e)[:100]}")
                rows.append(row)
                held += len(row[6] or b"")
                if held >= batch_bytes:
                    yield frame(rows)
                    rows, held = [], 0
        if rows:
            yield frame(rows)

    # Each directory is read once; its entries are written before they are dealt out.
    entries = cut(archive_entries(spark, path, max_entry, split_bytes)).withColumnRenamed("size", "size_")
    # The listing itself is small, so Spark would not spread it by its size: as many tasks as splits, but where these are
    # small no more than keep all cores busy or SPLIT_BYTES a task ask for.
    splits, packed = entries.agg(F.count_distinct("archive_path", "split"), F.coalesce(F.sum("packed"), F.lit(0))).first()
    most = min(max(4 * spark.sparkContext.defaultParallelism, -(-packed // SPLIT_BYTES)), MOST_TASKS)
    dealt = entries.repartition(max(1, min(splits, most)), "archive_path", "split").sortWithinPartitions("archive_path", "page_number")
    return dealt.mapInPandas(run, ENTRY)


def explode_archives(binary_df: DataFrame, max_entry: int = schema.MAX_PAGE_BYTES,
                     batch_bytes: int = 16 * 2**20, batch_rows: int = 256) -> DataFrame:
    """One row per image entry of each archive, numbered in natural order. Entries leave in small batches."""
    columns = [c.split()[0] for c in ENTRY.split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns).astype({"page_number": "Int32", "size": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                for row in _entries(path, content, max_entry):
                    rows.append(row)
                    held += len(row[6] or b"")
                    if held >= batch_bytes or len(rows) >= batch_rows:
                        yield frame(rows)
                        rows, held = [], 0
        if rows:
            yield frame(rows)

    return binary_df.select("path", "content").mapInPandas(run, ENTRY)
