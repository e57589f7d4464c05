"""Catalog tables that change without being rewritten: parts, bitmaps of deleted rows, and a log of versions.

A table folder holds parquet parts, deletion parts and ``_log/<version>.json``. A deletion part has a bitmap of row
positions for every 32,768 rows of a data file that lost any; reading leaves those rows out. A version names the parts it
consists of and is published by one rename that fails where the version is taken, so of two writers that started from one
version only one succeeds. Nothing that an older version reads is touched, so older versions stay readable.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelflow.functions.values import bit_set
from panelflow.operators.catalog import apply_updates
from panelflow.operators.skew import sized_broadcast
from panelflow.session import cut

_FILE, _AT = "__file", "__at"
NAMED_FILES = 500
BROADCAST_BITMAPS = 2000  # of 4 KB each


class Conflict(Exception):
    """Another writer published a version since this one read the table."""


class ChangeTable:
    """A table under ``root/name``. Every change gives the number of the version it published."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.name, self.path = spark, name, f"{root.rstrip('/')}/{name}"
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _hadoop(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def version(self) -> int | None:
        """Newest version, or None before the first."""
        folder = self._hadoop(f"{self.path}/_log")
        fs = folder.getFileSystem(self._conf)
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        found = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        return max(found, default=None)

    def state(self, version: int | None = None) -> dict:
        """What a version consists of: its schema, data parts, deletion parts and the files that lost rows."""
        version = self.version() if version is None else version
        if version is None:
            return {"version": None, "parts": [], "deletes": [], "files": [], "kind": None}
        text = self.spark.read.text(f"{self.path}/_log/{version:020d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _publish(self, base: dict, **changed) -> int:
        """Make the next version of ``base`` the current one, or raise Conflict."""
        number = 0 if base["version"] is None else base["version"] + 1
        text = json.dumps({**base, **changed, "version": number})
        target = self._hadoop(f"{self.path}/_log/{number:020d}.json")
        draft = self._hadoop(f"{self.path}/_log/.{uuid.uuid4().hex}")
        out = draft.getFileSystem(self._conf).create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(draft, target, none)
        except Exception as e:
            files.delete(draft, False)
            if "FileAlreadyExistsException" in str(e):
                raise Conflict(f"{self.name}: version {number} was published by another writer") from e
            raise
        return number

    def _write(self, df: DataFrame, kind: str) -> str:
        part = f"{kind}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{part}")
        return part

    def _placed(self, state: dict) -> DataFrame:
        """Rows of all parts with their file and position, deleted ones left out."""
        kind = T.StructType.fromJson(json.loads(state["kind"]))
        if not state["parts"]:
            return self.spark.createDataFrame([], kind).withColumns({_FILE: F.lit(""), _AT: F.lit(0).cast("long")})
        rows = self.spark.read.schema(kind).parquet(*[f"{self.path}/{p}" for p in state["parts"]])
        rows = rows.select("*", F.col("_metadata.file_name").alias(_FILE), F.col("_metadata.row_index").alias(_AT))
        if not state["deletes"]:
            return rows
        gone = self.spark.read.parquet(*[f"{self.path}/{d}" for d in state["deletes"]]).groupBy("file", "bucket").agg(
            F.bitmap_or_agg("bitmap").alias("__bitmap"))
        gone = sized_broadcast(gone, BROADCAST_BITMAPS)
        named = len(state["files"]) <= NAMED_FILES
        touched = F.col(_FILE).isin(state["files"]) if named else F.lit(True)
        masked = rows.filter(touched).join(gone, (F.col(_FILE) == gone["file"]) & (F.bitmap_bucket_number(_AT) == gone["bucket"]), "left")
        masked = masked.filter(F.col("__bitmap").isNull() | ~bit_set(F.col("__bitmap"), F.bitmap_bit_position(_AT))).select(*rows.columns)
        return masked.unionByName(rows.filter(~touched)) if named else masked

    def load(self, version: int | None = None) -> DataFrame:
        """Rows of the current version, or of an older one."""
        return self._placed(self.state(version)).drop(_FILE, _AT)

    def append(self, rows: DataFrame, base: dict | None = None) -> int:
        """Add rows. Without ``base`` an append that meets another writer is tried again: appends do not depend on rows."""
        state = base or self.state()
        if state["kind"] is None:
            state = {**state, "kind": json.dumps(rows.schema.jsonValue())}
        part = self._write(rows, "part")
        while True:
            try:
                return self._publish(state, parts=[*state["parts"], part])
            except Conflict:
                if base is not None:
                    raise
                state = self.state()

    def _deleted(self, state: dict, hits: DataFrame) -> dict:
        """Write the bitmaps of rows (file, at); what changes in the state."""
        bitmaps = hits.groupBy(F.col(_FILE).alias("file"), F.bitmap_bucket_number(_AT).alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(_AT)).alias("bitmap"))
        part = self._write(bitmaps, "gone")
        names = self.spark.read.parquet(f"{self.path}/{part}").select("file").distinct().limit(NAMED_FILES + 1).collect()
        return {"deletes": [*state["deletes"], part], "files": sorted({*state["files"], *(r["file"] for r in names)})}

    def delete(self, keys: DataFrame, key: str = "id", base: dict | None = None) -> int | None:
        """Delete the rows whose ``key`` is in ``keys``; reads that column only and writes bitmaps only. None if no row has one."""
        state = base or self.state()
        hits = cut(self._placed(state).select(key, _FILE, _AT).join(keys.select(key).distinct(), key, "left_semi").select(_FILE, _AT))
        return None if hits.isEmpty() else self._publish(state, **self._deleted(state, hits))

    def update(self, updates: DataFrame, key: str, now: Column, base: dict | None = None) -> int | None:
        """Change provided values (see ``operators.catalog.apply_updates``): the changed rows are written anew, their old
        places marked, all other rows left alone. None if no row has a key."""
        state = base or self.state()
        hits = cut(self._placed(state).join(updates.select(key).distinct(), key, "left_semi"))
        if hits.isEmpty():
            return None
        changed = apply_updates(hits.drop(_FILE, _AT), updates, key, now)
        part = self._write(changed, "part")
        return self._publish(state, parts=[*state["parts"], part], **self._deleted(state, hits.select(_FILE, _AT)))

    def compact(self) -> int:
        """Write the current rows as one part without deletions; older versions stay."""
        state = self.state()
        part = self._write(self._placed(state).drop(_FILE, _AT), "part")
        return self._publish(state, parts=[part], deletes=[], files=[])


def delete_projects(tables: dict[str, ChangeTable], project_ids: DataFrame | None = None, chapter_ids: DataFrame | None = None,
                    now: Column | None = None) -> dict[str, int | None]:
    """``operators.catalog.cascade_delete`` on change tables: only key columns are read and only bitmaps and the jobs that
    lose their chapter are written. Children go before parents, so a run that stops midway can be repeated."""
    chapters = tables["chapters"].load()
    gone = None
    if project_ids is not None:
        gone = chapters.join(project_ids.select(F.col("id").alias("project_id")).distinct(), "project_id", "left_semi").select("id")
    if chapter_ids is not None:
        named = chapters.join(chapter_ids.select("id"), "id", "left_semi").select("id")
        gone = named if gone is None else gone.unionByName(named).distinct()
    if gone is None:
        return {}
    gone = cut(gone.withColumnRenamed("id", "chapter_id"))
    pages = cut(tables["pages"].load().join(gone, "chapter_id", "left_semi").select(F.col("id").alias("page_id")).distinct())
    out = {n: tables[n].delete(pages, "page_id") for n in ("segments", "bubbles") if n in tables}
    out["pages"] = tables["pages"].delete(gone, "chapter_id")
    if "jobs" in tables:
        lost = tables["jobs"].load().join(gone, "chapter_id", "left_semi").select("id", F.array(F.lit("chapter_id")).alias("cleared"))
        lost = lost.withColumn("chapter_id", F.lit(None).cast(tables["jobs"].load().schema["chapter_id"].dataType))
        out["jobs"] = tables["jobs"].update(cut(lost), "id", F.current_timestamp() if now is None else now)
    out["chapters"] = tables["chapters"].delete(gone.withColumnRenamed("chapter_id", "id"), "id")
    if project_ids is not None:
        out["projects"] = tables["projects"].delete(project_ids, "id")
    return out
