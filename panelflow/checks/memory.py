"""Queries of the bucketed memory, compared with the plain lookup."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelflow.checks.base import now, query, sql
from panelflow.checks.translation import REQUESTS
from panelflow.operators import translate as X
from panelflow.session import scratch_path
from panelflow.sources.memory import MemoryStore


def _memory(d):
    """The memory in three parts, one of which repeats rows of the first."""
    memory = MemoryStore(d.spark, scratch_path(d.spark, "memory"))
    memory.learn(d.memory.filter("size % 2 = 0"), "even")
    memory.learn(d.memory.filter("size % 2 = 1"), "odd")
    memory.learn(d.memory.filter("size % 10 = 0"), "again")
    return memory


FEW = "few AS (SELECT * FROM segments WHERE id % 20 < 2)"


@query(sql("SELECT key, n, translated_text, created_at, created_at IS NOT NULL AS hit FROM requests LEFT JOIN live USING (key)",
           "segments", "memory", extra=FEW + ", " + REQUESTS.replace("FROM segments", "FROM few")))
def memory_lookup(d):
    """Hits of a tenth of the segments, from the buckets that may hold their keys."""
    asked = X.distinct_requests(d.segments.filter("id % 20 < 2"))
    return X.memory_hits(asked, _memory(d).rows_for(asked), now()).select("key", "n", "translated_text", "created_at", "hit")


@query(sql("""SELECT key, translated_text, created_at FROM memory
    QUALIFY row_number() OVER (PARTITION BY key ORDER BY created_at DESC, translated_text DESC) = 1""", "memory"))
def memory_compacted(d):
    """The newest row of every key after compaction, asked for by key."""
    memory = _memory(d)
    memory.compact()
    return memory.rows_for(d.memory.select("key")).select("key", "translated_text", "created_at")


@query(sql("""SELECT key FROM (SELECT DISTINCT key FROM memory) WHERE key LIKE '%1%'""", "memory"))
def memory_places(d):
    """Keys that the filters let through: all that are there; absent ones were added and are mostly refused."""
    memory = _memory(d)
    there = d.memory.select("key").filter(F.col("key").contains("1")).distinct()
    absent = there.select(F.concat(F.lit("no "), "key").alias("key"))
    return memory.places(there.unionByName(absent)).select("key").distinct().filter("key NOT LIKE 'no %'")
