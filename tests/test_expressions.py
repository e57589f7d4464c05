import math
import random

import pytest
from pyspark.sql import functions as F

from panelflow.functions import geometry as g
from panelflow.functions import text as t
from panelflow.functions import values as v


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], f"i int, c {kind}")
    return [r[0] for r in df.select("i", expr(F.col("c")).alias("out")).orderBy("i").select("out").collect()]


def test_script_language(spark):
    cases = {"こんにちは": "ja", "カタカナ": "ja", "漢字": "zh", "漢字かな": "ja", "한국어": "ko", "مرحبا": "ar", "สวัสดี": "th",
             "Привет": "ru", "hello": "en", "12345": "en", "": "unknown", "　": "unknown", "中한": "zh", "한中": "ko",
             "ệ": "vi", "λόγος": "unknown", "Привет мир 中": "ru"}
    assert column(spark, list(cases), "string", t.script_language) == list(cases.values())


def test_script_presence(spark):
    cases = {"漢字かな": "ja", "中한": "ko", "hello": "en", "12345": "unknown", "": "unknown", "Привет": "ru", "ab12": "unknown", "abc12": "en"}
    assert column(spark, list(cases), "string", t.script_presence) == list(cases.values())


def test_natural_order(spark):
    names = ["page_10.png", "page_2.png", "Page_1.png", "cover.png", "p1a2.png", "p1a10.png", "007", "7a", "12345678901234567890123456789012345678901234567890"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.orderBy(t.natural_key(F.col("n"))).collect()]
    assert got == ["007", "7a", "12345678901234567890123456789012345678901234567890", "cover.png", "p1a2.png", "p1a10.png",
                   "Page_1.png", "page_2.png", "page_10.png"]


def test_source_names(spark):
    names = ["[Group] My Title ch 12.5 (raw).cbz", "My_Title_v03.zip", "plain.pdf", "(x).cbz", ".jpg", "a.tar.gz"]
    assert column(spark, names, "string", t.detected_chapter) == [12.5, 3.0, None, None, None, None]
    assert column(spark, names, "string", t.detected_title) == ["My Title", "My_Title", "plain", None, "jpg", "a.tar"]
    assert column(spark, names, "string", t.extension) == [".cbz", ".zip", ".pdf", ".cbz", "", ".gz"]


def test_strip_covers_unicode_space(spark):
    spaces = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       　"
    values = [f"{s}a{s}b{s}" for s in spaces] + [spaces, ""]
    assert column(spark, values, "string", t.strip) == [x.strip() for x in values]
    assert column(spark, values, "string", t.has_text) == [bool(x.strip()) for x in values]


def test_rounding_is_by_binary_value(spark):
    rng = random.Random(1)
    values = [6.25, 4.35, 2.675, 0.125, 0.375, 2.5, 3.5, 0.28875, 1e-9, 12345.65] + [rng.randint(0, 10**6) / 400 for _ in range(300)]
    for digits in (1, 2, 4):
        assert column(spark, values, "double", lambda c: v.half_even(c, digits)) == [round(x, digits) for x in values]


def test_keys_and_names(spark):
    import hashlib
    text = "héllo"
    md5 = hashlib.md5(text.encode()).hexdigest()
    df = spark.createDataFrame([(text, "", "ctx")], "t string, empty string, c string")
    row = df.select(t.request_key(F.col("t"), F.lit("ja"), F.lit("en"), F.col("empty")),
                    t.request_key(F.col("t"), F.lit("ja"), F.lit("en"), F.col("c"))).first()
    assert row[0] == f"trans:{md5}:ja:en"
    assert row[1] == f"trans:{md5}:ja:en:ctx={hashlib.md5(b'ctx').hexdigest()[:16]}"
    long = "x\n" * 600
    assert column(spark, [long, "a\nb\r"], "string", lambda c: t.stored_key(c, "p:")) == ["p:" + hashlib.md5(long.encode()).hexdigest(), "p:ab"]
    assert column(spark, ["Translation: Output: hi ", "x Result: y"], "string", t.strip_prefixes) == ["hi", "x Result: y"]
    assert column(spark, ["a" * 51, "b" * 50], "string", t.preview) == ["a" * 50 + "...", "b" * 50]


def test_polygons(spark):
    squares = [[(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)], [(1.0, 1.0), (2.0, 5.0)], []]
    kind = "array<struct<x:double,y:double>>"
    assert column(spark, squares, kind, g.polygon_area) == [12.0, 0.0, 0.0]
    assert column(spark, squares, kind, g.polygon_perimeter) == [14.0, 2 * math.sqrt(17), 0.0]
    assert [tuple(r) for r in column(spark, squares, kind, g.bbox_from_polygon)] == [(0, 0, 4, 3), (1, 1, 1, 4), (0, 0, 0, 0)]
    lines = [[(0.0, 0.0), (1.0, 1.0)], [(0.0, 0.0), (-1.0, 1.0)], [(0.0, 0.0), (-1.0, -1.0)], [(0.0, 0.0), (0.0, 5.0)], [(0.0, 0.0), (0.0, 0.0)], [(0.0, 0.0)]]
    assert column(spark, lines, kind, g.rotation) == [45.0, -45.0, 45.0, 90.0, 0.0, 0.0]


def test_label_trap(spark):
    labels = ["cloud bubble", "Thought bubble", "panel text", "caption box", "ONOMATOPOEIA", "billboard", "heading", "large display text"]
    assert column(spark, labels, "string", lambda c: g.label_type(c, ["speech", "thought"])) == \
        ["speech", "thought", "speech", "narration", "sfx", "sign", "title", "speech"]


def test_overlaps(spark):
    boxes = [((0, 0, 10, 10), (10, 0, 10, 10)), ((0, 0, 10, 10), (5, 0, 10, 10)), ((0, 0, 10, 10), (0, 0, 5, 5)), ((0, 0, 0, 10), (0, 0, 5, 5)), (None, (0, 0, 5, 5))]
    kind = "struct<x:double,y:double,w:double,h:double>"
    df = spark.createDataFrame([(i, tuple(map(float, a)) if a else None, tuple(map(float, b))) for i, (a, b) in enumerate(boxes)], f"i int, a {kind}, b {kind}")
    got = df.orderBy("i").select(g.iou(F.col("a"), F.col("b")).alias("u"), g.overlap_min(F.col("a"), F.col("b")).alias("m")).collect()
    assert [r["u"] for r in got] == pytest.approx([0, 1 / 3, 0.25, 0, 0])
    assert [r["m"] for r in got] == pytest.approx([0, 0.5, 1, 0, 0])
