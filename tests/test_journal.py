"""A provider with a journal is asked once per key, whatever fails."""

import os

import pytest
from pyspark.sql import functions as F

from panelflow.checks.base import now
from panelflow.operators import translate as X

MEMORY = "key string, translated_text string, engine string, size long, created_at timestamp_ntz, accessed_at timestamp_ntz, ttl double"


def counting(folder, fail_after=None):
    """Notes every key it is asked for; breaks once after so many calls."""
    def answer(batches):
        import os
        import uuid
        for batch in batches:
            calls = len(os.listdir(f"{folder}/calls"))
            if fail_after is not None and calls >= fail_after and not os.path.exists(f"{folder}/broken"):
                open(f"{folder}/broken", "w").close()
                raise RuntimeError("the service broke down")
            with open(f"{folder}/calls/{uuid.uuid4().hex}", "w") as f:
                f.write("\n".join(batch["key"]))
            kept = batch[~batch["original_text"].str.endswith("7")]
            yield kept[["key"]].assign(engine="google", text="T " + kept["original_text"], confidence=0.9)
    return answer


def asked(folder):
    return sorted(k for n in os.listdir(f"{folder}/calls") for k in open(f"{folder}/calls/{n}").read().split("\n"))


def test_a_broken_job_goes_on_where_it_was(spark, tmp_path):
    os.mkdir(tmp_path / "calls")
    rows = spark.range(900).select(F.concat(F.lit("k"), "id").alias("key"), F.concat(F.lit("text "), "id").alias("original_text"),
                                   F.lit("fr").alias("source_language"), F.lit("en").alias("target_language"))
    def run():
        return {r["key"]: r["text"] for r in X.run_provider(rows, counting(str(tmp_path), 9), journal=f"{tmp_path}/journal").collect()}
    with pytest.raises(Exception, match="broke down"):
        run()
    before = asked(tmp_path)
    assert 0 < len(before) < 900
    got = run()
    assert got == {f"k{k}": f"T text {k}" for k in range(900) if k % 10 != 7}
    assert asked(tmp_path) == sorted(f"k{k}" for k in range(900))  # each once, also those without an answer
    assert run() == got and len(asked(tmp_path)) == 900


def test_segments_with_a_journal(spark, tmp_path):
    os.mkdir(tmp_path / "calls")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "17")], "id int, original_text string").select(
        "*", F.lit("fr").alias("source_language"), F.lit("en").alias("target_language"))
    memory = spark.createDataFrame([], MEMORY)
    for _ in range(2):
        done, _ = X.translate_segments(df, memory, counting(str(tmp_path)), now(), journal=f"{tmp_path}/journal", parallelism=2)
        assert {r["id"]: (r["translated_text"], r["engine"]) for r in done.collect()} == {
            1: ("T a", "google"), 2: ("T b", "google"), 3: ("T a", "google"), 4: ("17", "fallback")}
    assert len(asked(tmp_path)) == 3
