import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from panelflow.llm.quality import rank_quality

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no driver tables")


def test_every_stage_does_its_work(spark, tmp_path):
    from test_near import similar
    from test_repeats import brute
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("component_id", F.lit(1))
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "repeated_passages", "mixing", "packing"]
    kept = {"documents": docs}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{name}")
        docs = kept[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == kept["documents"].columns
    rows = {n: {r["doc_id"]: r for r in kept[n].collect()} for n in names[:4]}
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").filter("crc32(cast(doc_id as string)) % 4 <> 2")
    good = rank_quality(kept["documents"], labels.withColumnRenamed("doc_id", "doc_id"), id="doc_id", text="text").filter("predicted = 1")
    assert set(rows["quality"]) == {r["id"] for r in good.collect()}
    assert set(rows["near_duplicates"]) == similar([(i, r["text"]) for i, r in rows["quality"].items()])[0]
    cleaned = brute([(i, r["text"]) for i, r in rows["near_duplicates"].items()])
    for i, text, _ in cleaned:
        got = rows["repeated_passages"][i]["text"]
        assert got == text.decode("utf-8", "ignore") and rows["repeated_passages"][i]["n_chars"] == len(got)
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for i, r in rows["repeated_passages"].items()}
    copies = {r["doc_id"]: r["count"] for r in kept["mixing"].groupBy("doc_id").count().collect()}
    assert max(copies.values()) <= 3 and sum(sizes[i] * n for i, n in copies.items()) <= sum(sizes.values())
    pieces = kept["packing"].filter("start = 0").groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in pieces} == copies


def test_run_gives_the_last_stage(spark):
    got = pipeline.run(spark, FOLDER)
    assert got.count() > 0 and "sequence_id" in got.columns and pipeline.ORACLE_SQL is None
