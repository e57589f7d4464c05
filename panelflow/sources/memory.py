"""A translation memory in buckets, with a Bloom filter for every bucket of every part.

A lookup asks the filters first and then reads only the buckets that may hold a wanted key, so a micro-batch of new texts
reads next to nothing of a large memory. What is learned becomes a part of its own with its own filters; compaction
merges the parts into one and leaves them out from then on.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelflow.functions.values import bit_set
from panelflow.operators.skew import sized_broadcast
from panelflow.session import cut
from panelflow.sources.changes import ChangeTable, Conflict

BUCKETS = 64
BITS_PER_KEY = 10
HASHES = 4
SLOT_BITS = 32_768


def _bits(slots: Column) -> Column:
    """Places of a key in a filter of so many slots: (slot, bit), one for each hash."""
    places = [F.pmod(F.xxhash64("key", F.lit(k)), slots * SLOT_BITS) for k in range(HASHES)]
    return F.explode(F.array(*[F.struct(F.floor(p / SLOT_BITS).alias("slot"), F.pmod(p, F.lit(SLOT_BITS)).alias("bit")) for p in places]))


class MemoryStore(ChangeTable):
    """Memory rows (any columns with a string ``key``) under ``root/name``; versions are published as by a change table."""

    def __init__(self, spark: SparkSession, root: str, name: str = "memory", buckets: int = BUCKETS):
        super().__init__(spark, root, name)
        self.buckets = buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")

    def _write_buckets(self, rows: DataFrame, part: str) -> None:
        """The rows of a part by bucket, a file each, and the filters of its buckets; the same part again replaces itself."""
        dealt = cut(rows.withColumn("bucket", self._bucket()))
        dealt.repartition(self.buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/{part}")
        keys = dealt.select("bucket", "key").distinct()
        sizes = keys.groupBy("bucket").agg(F.ceil(F.count("*") * BITS_PER_KEY / SLOT_BITS).alias("slots"))
        bits = keys.join(F.broadcast(sizes), "bucket").select("bucket", "slots", _bits(F.col("slots")).alias("p"))  # a row for each bucket
        filters = bits.groupBy("bucket", "slots", F.col("p.slot").alias("slot")).agg(F.bitmap_construct_agg(F.col("p.bit")).alias("bitmap"))
        filters.write.mode("overwrite").parquet(f"{self.path}/filters/{part}")

    def learn(self, rows: DataFrame, part: str) -> int | None:
        """Add rows as a part of that name. A replayed part replaces itself and publishes nothing new."""
        self._write_buckets(rows, part)
        while True:
            state = self.state()
            if part in state["parts"]:
                return state["version"]
            kind = state["kind"] or json.dumps(rows.schema.jsonValue())
            try:
                return self._publish({**state, "kind": kind, "buckets": self.buckets}, parts=[*state["parts"], part])
            except Conflict:
                continue

    def _read(self, state: dict, part: str, buckets: list[int] | None = None) -> DataFrame:
        kind = T.StructType.fromJson(json.loads(state["kind"]))
        rows = self.spark.read.schema(T.StructType([*kind.fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{self.path}/rows/{part}")
        return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))

    def load(self, version: int | None = None, without: str | None = None) -> DataFrame:
        """All rows, but for those of one part."""
        state = self.state(version)
        out = None
        for part in state["parts"]:
            if part != without:
                rows = self._read(state, part).drop("bucket")
                out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.spark.createDataFrame([], T.StructType.fromJson(json.loads(state["kind"])))

    def places(self, keys: DataFrame, without: str | None = None) -> DataFrame:
        """Parts and buckets that may hold keys: (part, bucket, key). A key that is there is always among them, another one
        with a chance of about one in eighty for each part."""
        state = self.state()
        wanted = keys.select("key").filter("key IS NOT NULL").distinct().withColumn("bucket", self._bucket())
        out = self.spark.createDataFrame([], "part string, bucket int, key string")
        for part in state["parts"]:
            if part == without:
                continue
            filters = self.spark.read.parquet(f"{self.path}/filters/{part}")
            slots = filters.select("bucket", "slots").distinct()
            asked = wanted.join(F.broadcast(slots), "bucket").select("bucket", "key", _bits(F.col("slots")).alias("p"))  # a row for each bucket
            hit = asked.join(filters, (asked["bucket"] == filters["bucket"]) & (asked["p.slot"] == filters["slot"]))
            sure = hit.filter(bit_set(F.col("bitmap"), F.col("p.bit"))).groupBy(asked["bucket"], "key").agg(F.count("*").alias("n"))
            out = out.unionByName(sure.filter(F.col("n") == HASHES).select(F.lit(part).alias("part"), "bucket", "key"))
        return out

    def rows_for(self, keys: DataFrame, without: str | None = None) -> DataFrame:
        """The memory's rows of the given keys, reading only buckets that may hold one of them."""
        state = self.state()
        found = cut(self.places(keys, without))
        touched: dict[str, list[int]] = {}
        for r in found.select("part", "bucket").distinct().collect():  # at most parts times buckets
            touched.setdefault(r["part"], []).append(r["bucket"])
        out = None
        for part, buckets in touched.items():
            rows = self._read(state, part, sorted(buckets))
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            return self.spark.createDataFrame([], T.StructType.fromJson(json.loads(state["kind"])))
        return out.join(sized_broadcast(found.select("bucket", "key").distinct()), ["bucket", "key"], "left_semi").select(
            *[f.name for f in T.StructType.fromJson(json.loads(state["kind"])).fields])

    def compact(self) -> int:
        """Merge all parts into one with the newest row of every key. Parts learned meanwhile stay parts."""
        state = self.state()
        rows = self.load()
        others = [c for c in rows.columns if c != "key"]
        newest = rows.groupBy("key").agg(F.max_by(F.struct(*others), F.struct("created_at", "translated_text")).alias("m")).select("key", "m.*")
        part = f"merged-{state['version'] + 1:08d}"
        self._write_buckets(newest.select(*rows.columns), part)
        while True:
            now = self.state()
            try:
                return self._publish(now, parts=[part, *(p for p in now["parts"] if p not in state["parts"])])
            except Conflict:
                continue
