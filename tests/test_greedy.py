"""Greedy merging against a plain statement of the rule, with ordinary and with hot pages."""

import random

import pytest
from pyspark.sql import functions as F

from panelflow.operators import ocr as O
from panelflow.operators import regions as R

SCHEMA = ("page_id long, engine string, confidence double, x double, y double, w double, h double, "
          "bubble_type string, has_mask boolean, tag int")


def iou(a, b):
    dx = min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"])
    dy = min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"])
    if dx <= 0 or dy <= 0:
        return 0.0
    return dx * dy / (a["w"] * a["h"] + b["w"] * b["h"] - dx * dy)


def expected_merge(rows):
    rank = {"yolo": 1, "groundingdino": 2, "sam2": 3}
    order = sorted(rows, key=lambda r: (-r["confidence"], rank[r["engine"]], r["x"], r["y"], r["w"], r["h"],
                                        r["bubble_type"], r["has_mask"], r["tag"]))
    kept = []
    for r in order:
        for i, k in enumerate(kept):
            share = iou(k, r)
            if share > 0.5:
                break
            if share > 0.35 and r["has_mask"] and not k["has_mask"]:
                kept[i] = r
                break
        else:
            kept.append(r)
    return sorted(r["tag"] for r in kept)


def random_rows(seed, pages, per_page, crowded):
    rng = random.Random(seed)
    rows, tag = [], 0
    for page in range(pages):
        for _ in range(per_page(page)):
            tag += 1
            size = rng.choice([20, 30, 40])
            span = 60 if crowded else 300
            rows.append(dict(
                page_id=page, engine=rng.choice(["yolo", "groundingdino", "sam2"]), confidence=rng.randint(3, 9) / 10,
                x=float(rng.randint(0, span)), y=float(rng.randint(0, span)), w=float(size), h=float(rng.choice([20, 30])),
                bubble_type="speech", has_mask=rng.random() < 0.4, tag=tag))
    return rows


def merged(spark, rows, fold_rows, **kw):
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).repartition(4)
    out = {}
    for row in R.merge_regions(df, fold_rows=fold_rows, **kw).collect():
        out.setdefault(row["page_id"], []).append(row["tag"])
    return {k: sorted(v) for k, v in out.items()}


def expected(rows):
    pages = {}
    for r in rows:
        pages.setdefault(r["page_id"], []).append(r)
    return {k: expected_merge(v) for k, v in pages.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_merge_random_pages(spark, seed):
    rows = random_rows(seed, 40, lambda p: p % 12 + 1, crowded=seed == 2)
    assert merged(spark, rows, 1000) == expected(rows)


@pytest.mark.parametrize("seed,fold_rows", [(3, 60), (11, 25)])
def test_merge_hot_page_in_rounds(spark, seed, fold_rows):
    """One page holds most rows, crowded so that regions replace each other."""
    rows = random_rows(seed, 4, lambda p: 150 if p == 0 else 6, crowded=True)
    assert merged(spark, rows, fold_rows, head_rows=fold_rows, chunk_rows=20) == expected(rows)


def test_merge_hot_page_of_copies(spark):
    """Copies of few boxes, masked and not, whose overlap is in the takeover range."""
    rows, tag = [], 0
    for i in range(200):
        tag += 1
        box = [(0, False), (8, True), (16, False), (4, True)][i % 4]
        rows.append(dict(page_id=7, engine="yolo", confidence=(i * 7 % 50) / 100 + 0.3, x=float(box[0]), y=0.0, w=20.0, h=20.0,
                         bubble_type="speech", has_mask=box[1], tag=tag))
    assert merged(spark, rows, 60, head_rows=30, chunk_rows=50) == expected(rows)


def test_merge_basic_cases(spark):
    def row(page, conf, x, mask, tag):
        return dict(page_id=page, engine="yolo", confidence=conf, x=x, y=0.0, w=100.0, h=10.0, bubble_type="s", has_mask=mask, tag=tag)

    rows = [
        row(1, 0.9, 0.0, False, 1), row(1, 0.8, 25.0, False, 2),        # IoU 0.6: the surer one stays
        row(2, 0.9, 0.0, False, 1), row(2, 0.8, 42.0, True, 2),         # IoU 0.408: replaced by the masked one
        row(3, 0.9, 0.0, False, 1), row(3, 0.8, 42.0, False, 2),        # neither masked: both stay
        row(4, 0.9, 0.0, False, 1),
    ]
    exact = dict(rows[0], page_id=5, w=20.0, tag=1), dict(rows[0], page_id=5, confidence=0.5, w=10.0, tag=2)  # IoU 0.5
    got = merged(spark, rows + list(exact), 1000)
    assert got == {1: [1], 2: [2], 3: [1, 2], 4: [1], 5: [1, 2]}


def test_boxes_without_area_stay(spark):
    rows = random_rows(9, 1, lambda p: 3, crowded=True)
    flat = [dict(r, w=0.0, tag=100 + i) for i, r in enumerate(rows)]
    tags = merged(spark, rows + flat, 1000)[0]
    assert {100, 101, 102} <= set(tags)


def expected_ocr(rows):
    rank = {"paddleocr": 1, "easyocr": 2, "tesseract": 3}
    kept = []
    for r in sorted(rows, key=lambda r: (-r[2], rank[r[1]], r[3], r[4], r[5], r[6], r[7])):
        for k in kept:
            dx = min(k[3] + k[5], r[3] + r[5]) - max(k[3], r[3])
            dy = min(k[4] + k[6], r[4] + r[6]) - max(k[4], r[4])
            if dx > 0 and dy > 0 and dx * dy / min(k[5] * k[6], r[5] * r[6]) > 0.5:
                break
        else:
            kept.append(r)
    return sorted(r[7] for r in kept)


@pytest.mark.parametrize("fold_rows", [1000, 45])
def test_best_ocr_hot_call(spark, fold_rows):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2]), rng.choice(["paddleocr", "easyocr", "tesseract"]), rng.randint(1, 9) / 10,
             float(rng.randint(0, 80)), float(rng.randint(0, 80)), float(rng.randint(5, 40)), float(rng.randint(5, 40)), f"t{i}")
            for i in range(120)]
    df = spark.createDataFrame(rows, "page_id long, engine string, confidence double, x double, y double, w double, h double, text string")
    df = df.withColumns({"region_index": F.lit(None).cast("int"), "language": F.lit("unknown"), "rotation": F.lit(0.0)})
    got = {}
    for r in O.best_ocr(df, fold_rows=fold_rows, head_rows=25, chunk_rows=20).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
    assert {k: sorted(v) for k, v in got.items()} == {p: expected_ocr([r for r in rows if r[0] == p]) for p in (1, 2)}


def test_ocr_without_box_is_kept(spark):
    rows = [(1, None, "easyocr", 0.9, None, None, None, None, "a", "unknown", 0.0), (1, None, "easyocr", 0.8, None, None, None, None, "b", "japan", 0.0),
            (2, 4, "easyocr", 0.7, 0.0, 0.0, 9.0, 9.0, "boxed", "en", 0.0), (2, 4, "easyocr", 0.9, None, None, None, None, "free", "en", 0.0)]
    df = spark.createDataFrame(rows, "page_id long, region_index int, engine string, confidence double, x double, y double, w double, h double, "
                                     "text string, language string, rotation double")
    best = O.best_ocr(df)
    assert sorted((r["text"], r["language"]) for r in best.collect()) == [("a", "en"), ("b", "en"), ("boxed", "en"), ("free", "en")]
    assert {r["page_id"]: r["text"] for r in O.call_text(best).collect()} == {1: "a\nb", 2: "free\nboxed"}


def test_text_of_a_call_with_many_results(spark):
    rows = [(1, -1, "easyocr", i / 1000, None, None, f"t{i:04d}", float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, region_index int, engine string, confidence double, x double, y double, text string, rotation double")
    whole = O.call_text(df, hot_rows=None).first()
    parts = O.call_text(df, part_rows=7, hot_rows=50, pieces=5).first()
    assert whole == parts
    assert whole["text"] == "\n".join(f"t{i:04d}" for i in reversed(range(200))) and whole["rotation"] == 199.0
    assert whole["region_count"] == 100 and whole["confidence"] == 0.0995


def placed(spark, rows, fold_rows):
    df = spark.createDataFrame(rows, SCHEMA)
    merged = R.merge_regions(df, fold_rows=fold_rows, position="place")
    return sorted((r["page_id"], r["place"], r["tag"]) for r in merged.collect())


def test_places_are_the_same_for_folded_and_for_hot_pages(spark):
    rows = random_rows(11, 3, lambda page: 40, True)
    for k, r in enumerate(rows):
        if k % 6 == 0:
            r["w"] = 0.0  # cannot collide, keeps its place in the list
    rows = [tuple(r.values()) for r in rows]
    assert placed(spark, rows, 1000) == placed(spark, rows, 1)


def test_a_null_mask_is_no_mask_on_both_paths(spark):
    rows = [(1, "yolo", 0.9, 0.0, 0.0, 10.0, 10.0, "speech", None, 1), (1, "sam2", 0.5, 4.0, 0.0, 10.0, 10.0, "speech", True, 2),
            (1, "sam2", 0.4, 50.0, 0.0, 10.0, 10.0, "speech", None, 3)]
    for fold_rows in (1000, 1):
        assert [x[2] for x in placed(spark, rows, fold_rows)] == [2, 3]
