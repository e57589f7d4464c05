"""Findings of round 3 on small tables."""

import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry
from compare import compare

PAGES = "page_id long, url string, html string"


def same_as_sql(spark, folder, name):
    con = duckdb.connect()
    for p in Path(folder).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return compare(entry.queries()[name](spark, str(folder)).toPandas(), con.sql(entry.oracle_sql()[name]).df())


@pytest.mark.parametrize("files", [1, 3])
def test_f3_a_table_of_one_or_more_files_is_a_stream(spark, tmp_path, files):
    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 7).cast("string")).alias("text"),
                                  F.when(F.col("id") % 3 == 0, "de").otherwise("fr").alias("lang"), F.lit("s").alias("source"))
    docs.repartition(files).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "text 1")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    if files == 1:
        made = next((tmp_path / "documents.parquet").glob("part-*")).read_bytes()
        lone = tmp_path / "lone"
        lone.mkdir()
        (lone / "documents.parquet").write_bytes(made)
        (lone / "benchmark.parquet").write_bytes(next((tmp_path / "benchmark.parquet").glob("part-*")).read_bytes())
        assert same_as_sql(spark, lone, "stream_translation") == ""
    else:
        assert same_as_sql(spark, tmp_path, "stream_translation") == ""


def pages(spark, rows, folder):
    spark.createDataFrame(rows, PAGES).write.parquet(str(folder / "pages.parquet"))
    return folder


def test_f4_long_pages_are_under_the_limit_of_entries(spark, tmp_path):
    folder = pages(spark, [(1, "http://a.b/c", "é" * 60_000), (2, "http://a.b/d", "short")], tmp_path)
    assert same_as_sql(spark, folder, "explode_archives") == ""


def test_f5_all_errors_of_a_source_are_listed(spark, tmp_path):
    folder = pages(spark, [(7 * n, f"http://a.b/c{n}", "x") for n in range(60)], tmp_path)
    assert same_as_sql(spark, folder, "import_summary") == ""


def test_f7_megabytes_halfway_between_two_tenths(spark, tmp_path):
    folder = pages(spark, [(n, "http://a.b/c", "x" * (8192 * n)) for n in (2, 3, 5, 7, 9)] + [(10, "http://a.b/c", "x" * 8192)], tmp_path)
    assert same_as_sql(spark, folder, "validate_uploads") == ""


def test_f1_tiles_are_not_broadcast(spark):
    df = entry.queries()["regions_to_tiles"](spark, "/root/testdata/sf0.001")
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_f2_entries_are_read_without_their_directory(spark, tmp_path):
    import zipfile

    from panelflow.sources import files
    with zipfile.ZipFile(tmp_path / "é a.cbz", "w", zipfile.ZIP_DEFLATED) as z:
        for n in range(500):
            z.writestr(f"x/ü{n}.png", bytes([n % 256]) * n)
        z.writestr("stored.jpg", b"12345", zipfile.ZIP_STORED)
        z.writestr("packed.png", b"12345" * 99, zipfile.ZIP_BZIP2)
        z.writestr("broken.png", b"unlike anything else")
    made = tmp_path / "é a.cbz"
    at = made.read_bytes().rindex(b"broken.png", 0, made.read_bytes().index(b"PK\1\2")) + 10
    made.write_bytes(made.read_bytes()[:at] + b"\xff\xff" + made.read_bytes()[at + 2:])
    parts = files.read_archive_pages(spark, str(tmp_path), split_bytes=100)
    whole = files.explode_archives(files.read_archives(spark, str(tmp_path)))
    assert sorted(map(str, map(tuple, parts.collect()))) == sorted(map(str, map(tuple, whole.collect())))
    assert parts.filter("NOT success").count() == 1
    # A directory is opened by the listing alone: the plan of the reading side deals out at most four tasks a core.
    assert parts.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert {"header_offset", "packed", "crc"} <= set(files.archive_entries(spark, str(tmp_path)).columns)


def test_f8_quality_learns_from_all_labelled_rows(spark):
    import numpy as np

    from panelflow.llm import quality as Q
    rows = [(k, ("|| ## " if k % 4 == 0 else "plain words, ") * (1 + k % 9) + f"no {k}") for k in range(30_000)]
    labels = spark.createDataFrame([(k, int(k % 4 != 0)) for k, _ in rows], "id long, quality int")
    measured = Q._measured(spark.createDataFrame(rows, "id long, text string"))
    model = Q._model(measured, labels, "id", "quality")
    x = Q._unpacked(measured.select("features").toArrow().column("features")).astype(float)
    assert np.allclose(model["mean"], x.mean(0)) and np.allclose(model["scale"], x.std(0) + 1e-9, atol=1e-6)
    strength = np.sort(np.clip((x - model["mean"]) / model["scale"], -20, 20) @ model["w"])
    assert np.isclose(model["cut"], (strength[7499] + strength[7500]) / 2)


def test_f8_every_row_is_in_a_pair():
    import numpy as np

    from panelflow.llm.quality import _pairs
    better = np.arange(50) % 5 != 0
    x = np.eye(50)
    found = np.concatenate(list(_pairs(x, better, 3)))
    assert len(found) == 120 and len({tuple(d) for d in found}) == 120
    assert (np.abs(found).sum(0) > 0).all() and (found[:, ~better] <= 0).all()


def test_op8_words_sent_to_the_model_have_the_tokenizers_ids():
    import random

    import public_tokenizers

    from panelflow.llm.packing import _words
    words = _words(public_tokenizers.path("word_bpe_49k.json"))
    letters = random.Random(5)
    made = ["".join(letters.choices("abcxyzéüßñœſıøčžÿàÀİẞΣσςあª²ǆʼn", k=n)) for n in range(1, 9) for _ in range(400)]
    made += ["éa", "it's", "a1b", "x" * 300, "ﬁn", "", "��", "<|endoftext|>", "a,", "Abc", "ünder", "straße"]
    given = [w.encode() for w in made] + [b"\xff\xfea"]
    want = [words.tokenizer.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids for w in given]
    assert words.model is not None and words._word_ids(given) == want


def test_f6_regions_at_one_place_are_ordered_as_the_sql_orders_them(spark, tmp_path):
    """One centre and one height for all regions of a page, so that confidence, engine and merged list decide."""
    lines = [(page, 7, 0, line, 10.0, 5.0, "ANR"[(page + line * line) % 3], "O", round(0.03 + (page // 3 + 2 * line) % 4 * 0.02, 2))
             for page in range(120) for line in range(1, 8)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                          "l_returnflag string, l_linestatus string, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    orders = [(page, 1, "O", "1-URGENT") for page in range(120)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").withColumn(
        "o_orderdate", F.lit("1998-01-01").cast("timestamp_ntz")).write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(1, "text", "en")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "text 1")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert same_as_sql(spark, tmp_path, "localized_bubbles") == ""
    assert same_as_sql(spark, tmp_path, "ordered_regions") == ""


@pytest.mark.parametrize("fold_rows", [1000, 5])
def test_f10_f11_f13_calls_are_read_from_one_list(spark, fold_rows):
    import random

    from panelflow.operators import ocr as O
    r = random.Random(3)
    rows = [(page, r.choice([None, 0, 1, 2]), r.choice(["paddleocr", "easyocr", "tesseract"]), r.choice([None, 0.5, 0.71]) if page % 5 == 0 else r.random(),
             *(r.choice([(None,) * 4, (1.0, 2.0, 3.0, 4.0), (r.random(), r.random(), 9.0, 9.0), (r.random() * 50, r.random() * 50, 5.0, 5.0)])),
             r.choice(["", " a ", "b", "ü c", None]), "unknown", r.choice([None, 0.0, 1.5])) for page in range(60) for _ in range(1 + page % 9)]
    df = spark.createDataFrame(rows, "page_id int, region_index int, engine string, confidence double, x double, y double, w double, h double, "
                               "text string, language string, rotation double").cache()
    want = O.call_text(O.best_ocr(df))
    got = O.read_calls(df, fold_rows=fold_rows)
    assert got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    if fold_rows == 1000:
        plan = got._jdf.queryExecution().sparkPlan().toString()
        assert "Window" not in plan and "Generate" not in plan


def test_f10_f11_f13_columns_of_a_row_are_carried_once(spark):
    from panelflow.operators import regions as R
    df = spark.createDataFrame([(1, "yolo", 0.9, 1.0, 2.0, 3.0, 4.0, True)], "page_id int, engine string, confidence double, x double, y double, w double, h double, has_mask boolean")
    merged = R.merge_regions(df)
    assert merged.collect() == df.collect()
    shape = merged._jdf.queryExecution().analyzed().toString()
    assert "__o2" not in shape


def test_f12_a_provider_gets_long_texts_a_few_at_a_time(spark):
    from panelflow.operators import translate as X

    def answer(batches):
        for batch in batches:
            held = batch["original_text"].str.len().sum()
            yield batch[["key"]].assign(engine="google", text=batch["original_text"].str[:5], confidence=held)

    asked = spark.range(2000).coalesce(1).select(
        F.format_string("k%d", "id").alias("key"), F.repeat(F.lit("abcde"), F.when(F.col("id") == 7, 400_000).otherwise(2000)).alias("original_text"),
        F.lit("fr").alias("source_language"), F.lit("en").alias("target_language"))
    got = X.run_provider(asked, answer).collect()
    assert len({r["key"] for r in got}) == len(got) == 2000 and {r["text"] for r in got} == {"abcde"}
    assert max(r["confidence"] for r in got) < 4 << 20
    assert X.run_provider(asked.limit(0), answer).collect() == []


def test_f15_large_tables_are_not_sorted_for_deleted_ids(spark):
    from panelflow.operators import catalog as C
    catalog = {"projects": spark.range(30), "chapters": spark.range(90).withColumn("project_id", F.col("id") % 30),
               "pages": spark.range(400).withColumn("chapter_id", F.col("id") % 90), "bubbles": spark.range(999).withColumn("page_id", F.col("id") % 400),
               "jobs": spark.range(90).withColumn("chapter_id", F.col("id"))}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large to send to all tasks
    try:
        left = C.cascade_delete(catalog, spark.range(3), spark.createDataFrame([(10,), (31,), (999,)], "id long"))
        plans = {n: df._jdf.queryExecution().sparkPlan().toString() for n, df in left.items()}
        assert all("ShuffledHashJoin" in p and "SortMergeJoin" not in p for p in plans.values())
        rows = {n: df.collect() for n, df in left.items()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    gone = {c for c in range(90) if c % 30 < 3} | {10}
    assert sorted(r["id"] for r in rows["chapters"]) == sorted(set(range(90)) - gone)
    assert sorted(r["id"] for r in rows["pages"]) == [p for p in range(400) if p % 90 not in gone]
    assert sorted(r["id"] for r in rows["bubbles"]) == [b for b in range(999) if b % 400 % 90 not in gone]
    assert sorted((r["id"], r["chapter_id"]) for r in rows["jobs"]) == [(j, None if j in gone else j) for j in range(90)]


@pytest.mark.parametrize("ttl_ms", [None, 5])
def test_f14_actions_of_a_job_are_rows_and_a_status_that_stays_is_not_written(ttl_ms):
    from pyspark.sql import Row

    from panelflow import schema
    from panelflow.streaming.state import _Statuses
    written = []

    class Value:
        def get(self):
            return (written[-1],) if written else None

        def update(self, value):
            written.append(value[0])

    machine = _Statuses(ttl_ms)
    machine.status = Value()
    machine.handleInitialState(("j",), Row(job_id="j", status="processing"), None)
    action = next(a for a, moves in schema.JOB_TRANSITIONS.items() if "processing" in moves)
    refused = Row(action="none", at=2, action_id=1, status=None)
    got = list(machine.handleInputRows(("j",), iter([refused, Row(action="none", at=1, action_id=9, status=None)]), None))
    assert [(r["at"], r["accepted"], r["status_after"]) for r in got] == [(1, False, "processing"), (2, False, "processing")]
    assert len(written) == (2 if ttl_ms else 1)
    done = list(machine.handleInputRows(("j",), iter([Row(action=action, at=3, action_id=4, status=None)]), None))
    assert done[0]["accepted"] and written[-1] == done[0]["status_after"] == schema.JOB_TRANSITIONS[action]["processing"]
