"""State that survives restarts, long inputs, and catalog rows without children."""

from pyspark.sql import functions as F

from panelflow.checks.base import now
from panelflow.operators import catalog as C
from panelflow.operators import jobs as J
from panelflow.operators import reports as P
from panelflow.operators import translate as X
from panelflow.sources.memory import MemoryStore
from panelflow.sources.tables import CatalogStore
from panelflow.streaming import events as S
from panelflow.streaming.translate import translate_batches

MEMORY = "key string, translated_text string, engine string, size long, created_at timestamp_ntz, accessed_at timestamp_ntz, ttl double"


def shout():
    def answer(batches):  # local, so that it travels to the workers with the plan
        for b in batches:
            yield b[["key"]].assign(engine="google", text=b["source_language"] + ":" + b["original_text"], confidence=0.95)
    return answer


def test_translation_goes_on_after_a_new_checkpoint(spark, tmp_path):
    store = CatalogStore(spark, f"{tmp_path}/store")
    memory = MemoryStore(spark, store.root, buckets=4)
    memory.learn(spark.createDataFrame([], MEMORY), "none")
    schema = "id long, original_text string, source_language string, target_language string"

    def feed(k, text):
        spark.createDataFrame([(k, text, "fr", "en")], schema).write.mode("append").parquet(f"{tmp_path}/in{'' if k < 3 else 2}")

    def run(folder, checkpoint):
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/{folder}")
        S.run_batches(stream, translate_batches(store, memory, shout(), now()), f"{tmp_path}/{checkpoint}")

    for k, text in ((1, "a"), (2, "b")):
        feed(k, text)
        run("in", "first")
    for k, text in ((3, "a"), (4, "c")):
        feed(k, text)
    run("in2", "second")
    out = spark.read.parquet(f"{store.root}/translated")
    got = {r["id"]: (r["translated_text"], r["from_memory"]) for r in out.collect()}
    assert got == {1: ("fr:a", False), 2: ("fr:b", False), 3: ("fr:a", True), 4: ("fr:c", False)}
    assert memory.load().count() == 3 and len(memory.state()["parts"]) > 3
    memory.compact()
    assert memory.load().count() == 3 and len(memory.state()["parts"]) == 1
    feed(5, "c")
    run("in2", "second")
    assert spark.read.parquet(f"{store.root}/translated").filter("id = 5").first()["from_memory"]


def test_auto_is_detected_for_each_text(spark):
    rows = [(1, "こんにちは", "auto"), (2, "hello there", "auto"), (3, "12 34", "auto"), (4, "bonjour", "fr")]
    df = spark.createDataFrame(rows, "id int, original_text string, source_language string").withColumn("target_language", F.lit("en"))
    done, learned = X.translate_segments(df, spark.createDataFrame([], MEMORY), shout(), now())
    got = {r["id"]: (r["translated_text"].split(":")[0], r["detected_source_language"]) for r in done.collect()}
    assert got == {1: ("ja", "ja"), 2: ("en", "en"), 3: ("auto", "unknown"), 4: ("fr", "")}
    assert learned.filter("key LIKE '%:auto:en'").count() == 3


def test_titles_of_any_length_are_matched(spark):
    titles = spark.createDataFrame([("x" * 300, 1), ("short", 2)], "title string, id int").select("title", F.struct("id").alias("pick"))
    patterns = spark.createDataFrame([("x" * 260,), ("hor",), ("y" * 280,)], "pattern string")
    got = {r["p"]: r["pick"]["id"] for r in C.earliest_containing(patterns, titles).collect()}
    assert got == {"x" * 260: 1, "hor": 2}


def test_rollup_counts_chapters_and_projects_without_pages(spark):
    projects = spark.createDataFrame([("p",), ("q",), ("r",)], "id string")
    chapters = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "q")], "id string, project_id string")
    pages = spark.createDataFrame([("a", True), ("a", False)], "chapter_id string, is_translated boolean")
    got = {(r["level"], r["project_id"], r["chapter_id"]): (r["total_pages"], r["translated_pages"]) for r in P.progress_rollup(projects, chapters, pages).collect()}
    assert got == {(0, "p", "a"): (2, 1), (0, "p", "b"): (0, 0), (0, "q", "c"): (0, 0), (1, "p", None): (2, 1), (1, "q", None): (0, 0),
                   (1, "r", None): (0, 0), (3, None, None): (2, 1)}


def test_long_histories_are_replayed_in_spans(spark):
    order = ["stop", "resume", "cancel", "retry", "resume"]
    jobs = spark.createDataFrame([("j", "processing"), ("k", "failed")], "id string, status string")
    actions = spark.range(240).select(F.when(F.col("id") % 2 == 0, "j").otherwise("k").alias("job_id"), F.element_at(
        F.array(*[F.lit(a) for a in order]), (F.col("id") % 5 + 1).cast("int")).alias("action"), F.col("id").alias("at"), F.col("id").alias("action_id"))
    want, *others = [sorted(map(tuple, J.replay_actions(jobs, actions, chunk_rows=n).collect())) for n in (1000, 7, 2, 1)]
    assert len(want) == 240 and all(o == want for o in others)
