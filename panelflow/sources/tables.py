"""Catalog tables as versioned parquet folders.

A table folder holds version folders, or parts written by micro-batches. Spark writes its success marker last, so
the newest version with a marker is the current state; a writer that dies
leaves a version nobody reads, and no plan overwrites files it still reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelflow import schema


class CatalogStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self, table: str) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        found = []
        for status in fs.listStatus(folder):
            name = status.getPath().getName()
            marker = jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
            if name.startswith("v") and name[1:].isdigit() and fs.exists(marker):
                found.append(int(name[1:]))
        return sorted(found)

    def current(self, table: str) -> str | None:
        versions = self._versions(table)
        return f"{self.root}/{table}/v{versions[-1]:08d}" if versions else None

    def load(self, table: str, like: DataFrame | None = None) -> DataFrame:
        """Current rows; with the fixed schema for catalog tables, else as written. An unwritten
        table is empty in the catalog's schema (or in that of ``like``)."""
        path, fixed = self.current(table), schema.CATALOG.get(table)
        if path is None:
            kind = like.schema if like is not None else fixed
            return self.spark.createDataFrame([], kind)
        reader = self.spark.read.schema(fixed) if fixed is not None and like is None else self.spark.read
        return reader.parquet(path)

    def part(self, batch: DataFrame, batch_id: int) -> str:
        """Name of a micro-batch's own part: the stream's id and the batch's number."""
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        return f"stream={stream}/batch={batch_id}"

    def save_part(self, df: DataFrame, table: str, part: str) -> str:
        """Write one part of a table that grows by parts; the same part again replaces itself."""
        path = f"{self.root}/{table}/{part}"
        df.write.mode("overwrite").parquet(path)
        return path

    def parts(self, table: str, without: str | None = None) -> DataFrame | None:
        """All rows of a table that grows by parts, but for one part; None before the first is written."""
        jvm = self.spark.sparkContext._jvm
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}/stream=*/batch=*/_SUCCESS")
        fs = pattern.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        done = [s.getPath().getParent().toString() for s in fs.globStatus(pattern)]
        done = sorted(p for p in done if without is None or not p.endswith(f"/{without}"))
        return self.spark.read.option("basePath", f"{self.root}/{table}").parquet(*done) if done else None

    def _claim(self, table: str, number: int) -> bool:
        """Take a version number for this writer alone; False where another one has it."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}/_claims/{number:08d}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            fs.create(path, False).close()
        except Exception as e:
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        return True

    def save(self, df: DataFrame, table: str, version: int | None = None) -> str:
        """Write the next version (or the given one, for replays) and make it current.

        A new version's number is claimed first, so writers that meet write versions of their own and none erases
        another's; the greater number is current. Where a change depends on what was read, use a ``ChangeTable``.
        """
        if version is None:
            versions = self._versions(table)
            version = versions[-1] + 1 if versions else 0
            while not self._claim(table, version):
                version += 1
        path = f"{self.root}/{table}/v{version:08d}"
        df.write.mode("overwrite").parquet(path)
        return path


def load_catalog(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    store = CatalogStore(spark, root)
    return {name: store.load(name) for name in schema.CATALOG}
