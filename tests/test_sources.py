import zipfile

from pyspark.sql import functions as F

from panelflow import schema
from panelflow.operators import exports as E
from panelflow.operators import metrics as M
from panelflow.plans.localize import run_engine
from panelflow.sources import files, logs, sinks
from panelflow.sources.tables import CatalogStore, load_catalog
from panelflow.streaming import events as S


def test_page_files_and_their_stream(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "deep").mkdir(parents=True)
    for name in ("b10.PNG", "b2.png", "notes.txt", ".jpg", "deep/c.tif"):
        (folder / name).write_bytes(b"x" * 5)
    flat = files.read_page_files(spark, str(folder))
    assert sorted(r["filename"] for r in flat.collect()) == ["b10.PNG", "b2.png"]
    assert "content" not in flat.columns
    assert files.read_page_files(spark, str(folder), recursive=True).count() == 3
    stream = files.stream_page_files(spark, str(folder))
    for expect in (2, 3):
        S.run_available(stream.select("filename", "length"), str(tmp_path / "out"), str(tmp_path / "cp"))
        assert spark.read.parquet(str(tmp_path / "out")).count() == expect
        (folder / "new.webp").write_bytes(b"y")


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.cbz", "w") as z:
        for name in ("x/p10.png", "x/p2.png", "readme.md", "big.jpg"):
            z.writestr(name, b"0" * (100 if "big" in name else 3))
    with zipfile.ZipFile(tmp_path / "empty.zip", "w") as z:
        z.writestr("a.txt", b"")
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    (tmp_path / "rar.cbr").write_bytes(b"Rar!")
    out = files.explode_archives(files.read_archives(spark, str(tmp_path)), max_entry=50)
    rows = {}
    for r in out.collect():
        rows.setdefault(r["archive_path"].split("/")[-1], []).append(r)
    assert [(r["page_number"], r["filename"], r["success"]) for r in sorted(rows["a.cbz"], key=lambda r: r["page_number"])] == \
        [(1, "big.jpg", False), (2, "p2.png", True), (3, "p10.png", True)]
    assert rows["a.cbz"][0]["error"].startswith("Page too large: 0.0 MB")
    assert rows["empty.zip"][0]["error"] == "No supported images found in empty.zip"
    assert rows["bad.zip"][0]["error"].startswith("Corrupted archive file") and not rows["rar.cbr"][0]["success"]


def test_one_archive_is_read_by_several_tasks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "big.cbz", "w") as z:
        for n in range(60):
            z.writestr(f"x/p{n}.png", bytes([n]) * (1000 + n))
        z.writestr("x/p7b.png", b"0" * 5000)
    with zipfile.ZipFile(tmp_path / "empty.zip", "w") as z:
        z.writestr("a.txt", b"")
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    (tmp_path / "rar.cbr").write_bytes(b"Rar!")
    whole = files.explode_archives(files.read_archives(spark, str(tmp_path)), max_entry=4000)
    parts = files.read_archive_pages(spark, str(tmp_path), max_entry=4000, split_bytes=4000)
    order = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert order(parts) == order(whole) and parts.count() == 64
    tasks = parts.filter("archive_path LIKE '%big.cbz'").select(F.spark_partition_id()).distinct().count()
    assert tasks > 1 and files.archive_entries(spark, str(tmp_path), split_bytes=4000).agg(F.max("split")).first()[0] >= 10


def test_logs_round_trip(spark, tmp_path):
    (tmp_path / "app.log").write_text("2024-01-01 10:00:00,123 - backend.ocr - ERROR - engine - broke\n  trace line\n")
    (tmp_path / "app.log.1").write_text("2023-12-31 10:00:00,000 - backend.api - INFO - Started\n")
    df = logs.read_logs(spark, str(tmp_path / "*.log*"))
    got = {(r["level"], r["module"], r["message"]) for r in df.collect()}
    assert got == {("ERROR", "backend.ocr", "engine - broke"), (None, None, "  trace line"), ("INFO", "backend.api", "Started")}
    logs.export_logs(M.filter_logs(df, search="OCR"), str(tmp_path / "out"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["[2024-01-01 10:00:00.123] [ERROR] [backend.ocr] engine - broke"]


def test_catalog_store_versions(spark, tmp_path):
    store = CatalogStore(spark, str(tmp_path))
    assert store.load("projects").count() == 0 and store.load("projects").schema == schema.PROJECTS
    empty = load_catalog(spark, str(tmp_path))
    assert set(empty) == set(schema.CATALOG) and all(df.count() == 0 for df in empty.values())
    one = spark.createDataFrame([("p1", "T")], "id string, title string")
    store.save(one, "kept")
    store.save(spark.read.parquet(store.current("kept")).union(one), "kept")
    assert spark.read.parquet(store.current("kept")).count() == 2
    broken = tmp_path / "kept" / "v00000009"
    broken.mkdir()
    assert store.current("kept").endswith("v00000001")


def test_page_sinks(spark, tmp_path):
    chapters = spark.createDataFrame([(1, 9, "Manga", 1.0, "Begin"), (2, 9, "Manga", 12.5, "Mid"), (3, 9, "Manga", 3.0, None)],
                                     "id int, project_id int, project_title string, chapter_number double, title string")
    pages = spark.createDataFrame([(1, n, True) for n in range(1, 11)] + [(2, n, n != 2) for n in range(1, 6)], "chapter_id int, page_number int, success boolean")
    sinks.write_manifests(chapters, pages, str(tmp_path / "m"), "1-3", "jpg")
    root = spark.read.json(str(tmp_path / "m/roots")).first()
    assert root["total_pages"] == 6 and [(c["number"], c["pages"]) for c in root["chapters"]] == [(1.0, 3), (3.0, 0), (12.5, 3)]
    _, roots = E.export_manifest(chapters, pages)
    assert roots.count() == 1
    placed = pages.join(chapters.withColumnRenamed("id", "chapter_id"), "chapter_id")
    sinks.write_page_table(placed, str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.count() == 14 and back.filter("path = '9/2/page_0005.jpg'").count() == 1
    names = E.plan_page_paths(placed, "export", "JPEG")
    assert names.filter("path = 'Chapter_12/page_0001.jpg'").count() == 1


def test_a_failing_write_shows_no_page(spark, tmp_path):
    pages = spark.range(40).select(F.concat(F.lit("1/2/page_"), "id", F.lit(".jpg")).alias("path"), F.col("id").cast("string").cast("binary").alias("content"))
    broken = pages.repartition(4).withColumn("path", F.when(F.col("path").contains("_39."), F.raise_error(F.lit("lost"))).otherwise(F.col("path")))
    root = str(tmp_path / "pages out")
    try:
        sinks.write_pages(broken, root)
        raise AssertionError("the write should fail")
    except Exception as e:
        assert "lost" in str(e)
    assert sinks.read_pages(spark, root).count() == 0
    sinks.write_pages(pages.repartition(4), root)
    sinks.write_pages(pages.limit(0), root)
    found = sinks.read_pages(spark, root).collect()
    assert len(found) == 40 and all(open(f"{root}/{r['file']}").read() == r["path"][9:-4] and r["size"] == len(r["path"][9:-4]) for r in found)


def test_user_engine_contract(spark):
    def engine(batches):
        for b in batches:
            yield b.assign(engine="mine", confidence=0.9)[["page_id", "engine", "confidence"]]

    pages = spark.createDataFrame([(1, b"a"), (2, b"b")], "page_id long, content binary")
    out = run_engine(pages, engine, "page_id long, engine string, confidence double")
    assert sorted(tuple(r) for r in out.collect()) == [(1, "mine", 0.9), (2, "mine", 0.9)]


def test_page_ranges(spark):
    pages = spark.createDataFrame([(1, n) for n in range(1, 11)], "chapter_id int, page_number int")
    cases = {"": 10, "3": 1, "1,5,10": 3, "3-7": 5, "1-3,5,8-10": 7, "1-3,invalid,5": 4, " 2 - 3 ": 2, "-1": 0, "5-3": 0, "1-3,2": 3}
    for spec, n in cases.items():
        assert E.select_page_range(pages, spec).count() == n, spec
        assert E.select_page_range(pages, F.lit(spec)).count() == n, spec
    specs = spark.createDataFrame([(s,) for s in ("", "1-5", "1,3,5", "1-5,8,10-15", "1,,2", "abc", "-1", "5-3", "0", "1-2,x-3")], "s string")
    got = {r["s"]: r["error"] for r in E.validate_page_range(specs, "s").collect()}
    assert [s for s, e in got.items() if e is None] == ["", "1-5", "1,3,5", "1-5,8,10-15", "1,,2"]
    assert got["abc"] == "Invalid page number: 'abc'" and got["-1"] == "Invalid range: '-1'" and got["1-2,x-3"] == "Invalid range: 'x-3'"
