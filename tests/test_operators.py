"""Literal cases the driver tables do not contain, and empty inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelflow import schema
from panelflow.operators import catalog as C
from panelflow.operators import jobs as J
from panelflow.operators import ocr as O
from panelflow.operators import regions as R
from panelflow.operators import reports as P
from panelflow.operators import translate as X
from panelflow.operators import typeset as TS

NOW = dt.datetime(2024, 1, 1)


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def test_matching_titles_equals_brute_force(spark):
    titles = ["Alpha Beta", "alphabet", "a_b 100%", "", "Ünïcode Title", "aXb", "Alpha"]
    projects = spark.createDataFrame([(i, t, NOW - dt.timedelta(days=i % 3)) for i, t in enumerate(titles)], "id int, title string, created_at timestamp_ntz")
    patterns = ["alpha", "BET", "a_b", "%", "", "_____%", "ünï", "zzz", "a%b", "100%", "\\", "____________"]
    imports = spark.createDataFrame([(i, p) for i, p in enumerate(patterns)], "n int, title string")
    got = {r["n"]: r["project_id"] for r in C.match_projects(imports, projects).collect()}

    def like(p, t):
        import re
        rx = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in p)
        return re.search(f"^.*{rx}.*$", t, re.I | re.S) is not None

    for n, p in enumerate(patterns):
        hits = [(NOW - dt.timedelta(days=i % 3), i) for i, t in enumerate(titles) if like(p, t)]
        assert got[n] == (min(hits)[1] if hits else None), p


def test_memory_ttl_boundary(spark):
    rows = [("a", "A", "x", 1, NOW - dt.timedelta(seconds=3600), NOW, 3600.0), ("b", "B", "x", 1, NOW - dt.timedelta(seconds=3601), NOW, 3600.0),
            ("c", "C", "x", 1, NOW - dt.timedelta(days=900), NOW, None), ("d", "D", "x", 1, NOW - dt.timedelta(days=900), NOW, 0.0),
            ("a", "older", "x", 1, NOW - dt.timedelta(seconds=3600, microseconds=1), NOW, None)]
    memory = spark.createDataFrame(rows, "key string, translated_text string, engine string, size long, created_at timestamp_ntz, accessed_at timestamp_ntz, ttl double")
    asked = spark.createDataFrame([(k,) for k in "abcde"], "key string")
    assert sorted(r["key"] for r in X.memory_misses(asked, memory, now()).collect()) == ["b", "e"]
    hits = {r["key"]: r["translated_text"] for r in X.memory_hits(asked, memory, now()).filter("hit").collect()}
    assert hits == {"a": "A", "c": "C", "d": "D"}


def test_blank_and_failing_texts(spark):
    def upper(text, source, target, context):
        if "!" in text:
            raise ValueError
        return "  " if text == "none" else text.upper()

    segments = spark.createDataFrame([(1, "hi"), (2, "　"), (3, "bad!"), (4, "none"), (5, "hi"), (6, None)], "id int, original_text string")
    segments = segments.withColumns({"source_language": F.lit("ja"), "target_language": F.lit("en")})
    memory = spark.createDataFrame([], "key string, translated_text string, engine string, size long, created_at timestamp_ntz, accessed_at timestamp_ntz, ttl double")
    done, learned = X.translate_segments(segments, memory, X.per_row("nllb", upper), now())
    got = {r["id"]: (r["translated_text"], r["confidence"], r["engine"]) for r in done.collect()}
    assert got == {1: ("HI", 0.95, "nllb"), 2: ("", 1.0, ""), 3: ("bad!", 0.0, "fallback"), 4: ("none", 0.0, "fallback"),
                   5: ("HI", 0.95, "nllb"), 6: ("", 1.0, "")}
    assert [r["translated_text"] for r in learned.collect()] == ["HI"]
    grown = X.append_memory(memory, learned)
    assert X.append_memory(grown, learned).count() == 1


def test_page_context_without_text(spark):
    rows = [(1, 1, 0, "  ", "ctx"), (1, 2, 1, None, "ctx"), (2, 3, 5, "later", ""), (2, 4, None, "x" * 150, "")]
    bubbles = spark.createDataFrame(rows, "page_id int, id int, reading_order int, original_text string, given string")
    got = {r["page_id"]: r["context"] for r in X.page_context(bubbles, "given").collect()}
    assert got == {1: "ctx", 2: f"Page contains 2 text bubbles. First: '{'x' * 100}'"}


def test_vertical_fit_cases(spark):
    rows = [("a", "speech", 100.0, 300.0, "日本語の縦書きテスト"), ("b", "sfx", 10.0, 10.0, "long text that cannot fit"), ("c", "speech", 3.0, 3.0, "x"),
            ("d", "speech", 50.0, 50.0, "  ")]
    df = TS.with_style(spark.createDataFrame(rows, "id string, bubble_type string, width double, height double, translated_text string"))

    def fit(n, w, h, low, high):
        for size in range(high, low - 1, -2):
            rows = max(1, h // int(size * 1.2))
            if -(-n // rows) * size <= w:
                return size, False
        return high, True

    got = {r["id"]: (r["font_size"], r["overflow"]) for r in TS.vertical_fit(df).collect()}
    assert got == {"a": fit(10, 84, 284, 14, 48), "b": fit(25, 6, 6, 18, 64), "c": (8, True)}


def test_cascade_leaves_no_orphans(spark):
    cat = {
        "projects": spark.createDataFrame([(1,), (2,)], "id int"),
        "chapters": spark.createDataFrame([(10, 1), (11, 1), (20, 2)], "id int, project_id int"),
        "pages": spark.createDataFrame([(100, 10), (110, 11), (200, 20)], "id int, chapter_id int"),
        "bubbles": spark.createDataFrame([(1, 100), (2, 110), (3, 200)], "id int, page_id int"),
        "segments": spark.createDataFrame([(1, 100), (3, 200)], "id int, page_id int"),
        "jobs": spark.createDataFrame([(1, 10), (2, 20), (3, None)], "id int, chapter_id int"),
    }
    left = C.cascade_delete(cat, chapter_ids=spark.createDataFrame([(10,)], "id int"))
    assert {n: sorted(r[0] for r in df.select("id").collect()) for n, df in left.items()} == {
        "projects": [1, 2], "chapters": [11, 20], "pages": [110, 200], "bubbles": [2, 3], "segments": [3], "jobs": [1, 2, 3]}
    assert {r["id"]: r["chapter_id"] for r in left["jobs"].collect()} == {1: None, 2: 20, 3: None}


def test_history_rejects_unknown_status(spark):
    with pytest.raises(ValueError):
        P.filter_history(None, status="done")


def test_attempts(spark):
    rows = [("j", "p1", 0, False, "e0"), ("j", "p1", 1, True, None), ("j", "p2", 0, False, "x" * 300), ("j", "p2", 1, False, None),
            ("j", "p2", 2, False, "e2"), ("j", "p2", 3, False, "y" * 300), ("j", "p2", 4, True, None)]
    df = spark.createDataFrame(rows, "job_id string, page_id string, attempt int, ok boolean, error string")
    got = {r["page_id"]: (r["attempts"], r["ok"], r["delay_seconds"], r["last_error"]) for r in J.attempt_summary(df).collect()}
    assert got == {"p1": (2, True, 1.0, None), "p2": (4, False, 4.75, "y" * 200)}


def test_empty_inputs(spark):
    raw = spark.createDataFrame([], schema.RAW_REGIONS)
    assert R.detect_regions(raw).count() == 0
    assert R.engines_used(raw).count() == 0
    assert R.detection_stats(raw).first()["total_regions"] == 0
    ocr = spark.createDataFrame([], schema.OCR_REGIONS)
    assert O.call_text(O.best_ocr(ocr)).count() == 0
    projects, chapters, pages = (spark.createDataFrame([], s) for s in (schema.PROJECTS, schema.CHAPTERS, schema.PAGES))
    jobs, bubbles = spark.createDataFrame([], schema.JOBS), spark.createDataFrame([], schema.BUBBLES)
    assert P.project_summary(projects, chapters, pages, jobs).count() == 0
    assert P.overview(projects, chapters, pages).first()["overall_progress"] == 0.0
    assert P.activity_summary(jobs, now()).first()["avg_time_per_page_ms"] == 0.0
    assert P.queue_counts(jobs).first()["active"] == 0
    storage = spark.createDataFrame([], "project_id string, storage_bytes long")
    assert P.project_stats(projects, chapters, pages, bubbles, jobs, storage).count() == 0


def test_fresh_project_has_zero_stats(spark):
    one = spark.createDataFrame([("p", "T")], "id string, title string")
    chapters, pages = spark.createDataFrame([], schema.CHAPTERS), spark.createDataFrame([], schema.PAGES)
    jobs, bubbles = spark.createDataFrame([], schema.JOBS), spark.createDataFrame([], schema.BUBBLES)
    storage = spark.createDataFrame([], "project_id string, storage_bytes long")
    row = P.project_stats(one, chapters, pages, bubbles, jobs, storage).first().asDict()
    assert all(v == 0 for k, v in row.items() if k not in ("project_id", "title"))


def test_mask_refinement_and_fallback(spark):
    boxes = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "page_id int, box_id int")
    masks = spark.createDataFrame([(1, 1, 7, 0.6), (1, 1, 8, 0.9), (1, 2, 9, 0.49)], "page_id int, box_id int, mask_id int, score double")
    assert [tuple(r) for r in R.refine_candidates(boxes, masks).collect()] == [(1, 1, 8, 0.9)]
    primary = spark.createDataFrame([(1, "yolo")], "page_id int, engine string")
    spare = spark.createDataFrame([(1, "fallback"), (2, "fallback")], "page_id int, engine string")
    assert sorted(tuple(r) for r in R.with_fallback(primary, spare).collect()) == [(1, "yolo"), (2, "fallback")]
