"""The bucketed memory: filters, buckets read, replays, compaction."""

from pyspark.sql import functions as F

from panelflow.sources.memory import MemoryStore

KIND = "key string, translated_text string, engine string, size long, created_at timestamp_ntz, accessed_at timestamp_ntz, ttl double"


def rows(spark, keys):
    return keys.select(F.concat(F.lit("trans:"), F.md5(F.col("id").cast("string"))).alias("key"), F.concat(F.lit("T "), F.col("id").cast("string")).alias("translated_text"),
                       F.lit("google").alias("engine"), F.lit(1).cast("long").alias("size"), F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at"),
                       F.lit("2024-01-01").cast("timestamp_ntz").alias("accessed_at"), F.lit(60.0).alias("ttl"))


def test_only_buckets_that_may_hold_a_key_are_read(spark, tmp_path):
    memory = MemoryStore(spark, str(tmp_path), buckets=32)
    memory.learn(rows(spark, spark.range(50_000)), "a")
    known, unknown = rows(spark, spark.range(7, 12)).select("key"), rows(spark, spark.range(10**6, 10**6 + 2000)).select("key")
    got = memory.rows_for(known)
    assert {r["translated_text"] for r in got.collect()} == {f"T {k}" for k in range(7, 12)}
    assert memory.places(known).select("bucket").distinct().count() <= 5
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    refused = memory.places(unknown).count()
    assert refused < 2000 * 0.03  # 10 bits a key and four hashes
    assert memory.rows_for(unknown).collect() == [] and memory.rows_for(known.limit(0)).collect() == []
    assert memory.places(rows(spark, spark.range(50_000)).select("key")).count() == 50_000  # none is missed


def test_replayed_parts_and_compaction(spark, tmp_path):
    memory = MemoryStore(spark, str(tmp_path), buckets=4)
    memory.learn(spark.createDataFrame([], KIND), "none")
    assert memory.learn(rows(spark, spark.range(10)), "b") == memory.learn(rows(spark, spark.range(10)), "b") == 1
    newer = rows(spark, spark.range(5, 15)).withColumns({"translated_text": F.lit("new"), "created_at": F.lit("2024-02-01").cast("timestamp_ntz")})
    memory.learn(newer, "c")
    keys = rows(spark, spark.range(20)).select("key")
    assert memory.rows_for(keys).count() == 20 and memory.rows_for(keys, without="c").count() == 10
    memory.compact()
    got = memory.rows_for(keys)
    assert got.count() == 15 and got.filter("translated_text = 'new'").count() == 10
    assert len(memory.state()["parts"]) == 1 and memory.load(2).count() == 20
