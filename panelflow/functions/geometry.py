"""Geometry of text regions as column expressions over boxes and polygons."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelflow import schema
from panelflow.functions.values import half_even


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def polygon_from_bbox(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Corners clockwise from the top left."""
    return F.array(point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, wherever the optimizer moves it."""
    return F.transform(F.array(value), use)[0]


def bbox_from_polygon(poly: Column) -> Column:
    """Struct x, y, w, h; an empty polygon gives zeros."""
    return _once(poly, _bbox)


def _bbox(poly: Column) -> Column:
    xs, ys = F.transform(poly, lambda p: p["x"]), F.transform(poly, lambda p: p["y"])
    x, y = F.array_min(xs), F.array_min(ys)

    def known(c: Column, name: str) -> Column:
        return F.coalesce(c, F.lit(0.0)).alias(name)

    return F.struct(known(x, "x"), known(y, "y"), known(F.array_max(xs) - x, "w"), known(F.array_max(ys) - y, "h"))


def _edges(poly: Column, measure) -> Column:
    """Sum of a measure over the closed polygon's edges, in one pass with the point before."""
    first, last = F.try_element_at(poly, F.lit(1)), F.try_element_at(poly, F.lit(-1))
    start = F.struct(first["x"].alias("x"), first["y"].alias("y"), F.lit(0.0).alias("sum"))
    walked = F.aggregate(
        F.slice(poly, 2, F.greatest(F.size(poly) - 1, F.lit(0))), start,
        lambda a, p: F.struct(p["x"].alias("x"), p["y"].alias("y"), (a["sum"] + measure(a, p)).alias("sum")),
        lambda a: a["sum"])
    return walked + measure(last, first)


def polygon_area(poly: Column) -> Column:
    def area(p: Column) -> Column:
        cross = _edges(p, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
        return F.when(F.size(p) >= 3, F.abs(cross) / 2.0).otherwise(F.lit(0.0))

    return _once(poly, area)


def polygon_perimeter(poly: Column) -> Column:
    def length(p: Column) -> Column:
        total = _edges(p, lambda a, b: F.sqrt(
            (b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"])))
        return F.when(F.size(p) >= 2, total).otherwise(F.lit(0.0))

    return _once(poly, length)


def roundness(area: Column, perimeter: Column) -> Column:
    return F.when(perimeter > 0, F.lit(4 * math.pi) * area / (perimeter * perimeter)).otherwise(F.lit(0.0))


def rotation(poly: Column) -> Column:
    """Angle of the first edge in degrees, in (-90, 90], one digit."""
    a, b = F.try_element_at(poly, F.lit(1)), F.try_element_at(poly, F.lit(2))
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    angle = F.degrees(F.atan2(dy, dx))
    turned = F.when(angle > 90, angle - 180).when(angle < -90, angle + 180).otherwise(angle)
    return (
        F.when(F.coalesce(F.size(poly), F.lit(0)) < 2, F.lit(0.0))
        .when(dx == 0, F.when(dy != 0, F.lit(90.0)).otherwise(F.lit(0.0)))
        .otherwise(half_even(turned, 1))
    )


def _shared(a: Column, b: Column) -> tuple[Column, Column]:
    """Width and height of the common part of two boxes (may be negative, null for a missing box)."""
    def along(start: str, length: str) -> Column:
        # least and greatest skip nulls, so a missing side must be ruled out first.
        known = (a[start] + a[length] + b[start] + b[length]).isNotNull()
        return F.when(known, F.least(a[start] + a[length], b[start] + b[length]) - F.greatest(a[start], b[start]))

    return along("x", "w"), along("y", "h")


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (structs with x, y, w, h); 0 when they only touch."""
    dx, dy = _shared(a, b)
    union = a["w"] * a["h"] + b["w"] * b["h"] - dx * dy
    return F.when((dx > 0) & (dy > 0) & (union > 0), dx * dy / union).otherwise(F.lit(0.0))


def overlap_min(a: Column, b: Column) -> Column:
    """Intersection over the smaller box; 0 for missing boxes or a box without area."""
    dx, dy = _shared(a, b)
    smaller = F.least(a["w"] * a["h"], b["w"] * b["h"])
    return F.when((dx > 0) & (dy > 0) & (smaller > 0), dx * dy / smaller).otherwise(F.lit(0.0))


def class_type(class_id: Column) -> Column:
    names = F.array(*[F.lit(n) for n in schema.BUBBLE_TYPES])
    return F.coalesce(F.try_element_at(names, F.when(class_id >= 0, class_id + 1).cast("int")), F.lit("speech"))


def label_type(label: Column, targets: list[str]) -> Column:
    """Bubble type of a free-text label: a target name inside it, then keywords, else speech."""
    text = F.trim(F.lower(label))
    rules = [(t, [t]) for t in targets] + schema.LABEL_KEYWORDS
    out = None
    for name, words in rules:
        hit = text.contains(words[0])
        for word in words[1:]:
            hit = hit | text.contains(word)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("speech")


def shape_type(poly: Column, w: Column, h: Column, area_ratio: Column, round_: Column | None = None) -> Column:
    """Bubble type from size and shape; with roundness for masks, without for contours."""
    aspect = w / F.nullif(h, F.lit(0.0))
    out = (
        F.when((F.coalesce(F.size(poly), F.lit(0)) < 3) | (w <= 0) | (h <= 0), "speech")
        .when((area_ratio > 0.15) & (aspect > 2.5), "poster")
        .when(area_ratio > 0.15, "sfx")
        .when((aspect > 2.0) & (area_ratio < 0.02), "sign")
        .when(aspect > 2.0, "narration")
        .when(aspect < 0.5, "sign")
    )
    if round_ is None:
        return out.when(aspect > 1.5, "narration").otherwise("speech")
    return (
        out.when((round_ > 0.6) & (round_ < 0.75), "thought")
        .when(round_ > 0.6, "speech")
        .when((aspect > 1.5) & (round_ < 0.3), "narration")
        .otherwise("speech")
    )


def clamp_box(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column) -> Column:
    """Crop box inside the page; an empty box becomes the whole page."""
    cx = F.greatest(F.lit(0), F.least(x, page_w - 1))
    cy = F.greatest(F.lit(0), F.least(y, page_h - 1))
    cw, ch = F.least(w, page_w - cx), F.least(h, page_h - cy)
    empty = (cw <= 0) | (ch <= 0)

    def pick(whole: Column, part: Column, name: str) -> Column:
        return F.when(empty, whole).otherwise(part).cast("int").alias(name)

    return F.struct(pick(F.lit(0), cx, "x"), pick(F.lit(0), cy, "y"), pick(page_w, cw, "w"), pick(page_h, ch, "h"))
