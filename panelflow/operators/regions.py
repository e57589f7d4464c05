"""Region layer: geometry columns, plausibility filters, merging, reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow import schema
from panelflow.functions import geometry as g
from panelflow.functions.values import half_even, tally
from panelflow.operators.greedy import FOLD_ROWS, Rule, greedy
from panelflow.operators.skew import first_rows, numbered


def rank_of(column: str | Column, priority: list[str]) -> Column:
    """Position in a priority list; names not listed come last."""
    names = F.array(*[F.lit(n) for n in priority])
    place = F.array_position(names, F.col(column) if isinstance(column, str) else column)
    return F.when(place > 0, place).otherwise(len(priority) + 1)


# --- geometry columns -------------------------------------------------------

def with_bbox(df: DataFrame) -> DataFrame:
    box = g.bbox_from_polygon(F.col("polygon"))
    return df.withColumns({n: box[n] for n in ("x", "y", "w", "h")})


def with_polygon(df: DataFrame) -> DataFrame:
    corners = g.polygon_from_bbox(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    poly = F.coalesce(F.col("polygon"), corners) if "polygon" in df.columns else corners
    return df.withColumn("polygon", poly)


def normalize_boxes(df: DataFrame) -> DataFrame:
    """x1,y1,x2,y2,class_id -> x,y,w,h,bubble_type."""
    return df.withColumns({
        "x": F.col("x1"), "y": F.col("y1"),
        "w": F.col("x2") - F.col("x1"), "h": F.col("y2") - F.col("y1"),
        "bubble_type": g.class_type(F.col("class_id")),
    }).drop("x1", "y1", "x2", "y2", "class_id")


def with_area(df: DataFrame) -> DataFrame:
    return df.withColumn("area", g.polygon_area(F.col("polygon")))


def with_shape(df: DataFrame) -> DataFrame:
    df = with_area(df).withColumn("perimeter", g.polygon_perimeter(F.col("polygon")))
    return df.withColumn("roundness", g.roundness(F.col("area"), F.col("perimeter")))


def _area_ratio() -> Column:
    page = F.col("page_width") * F.col("page_height")
    return F.when(page > 0, F.col("area") / page).otherwise(F.lit(0.0))


def classify_mask_shape(df: DataFrame) -> DataFrame:
    kind = g.shape_type(F.col("polygon"), F.col("w"), F.col("h"), _area_ratio(), F.col("roundness"))
    return with_shape(df).withColumn("bubble_type", kind)


def classify_contour_shape(df: DataFrame) -> DataFrame:
    return with_area(df).withColumn(
        "bubble_type", g.shape_type(F.col("polygon"), F.col("w"), F.col("h"), _area_ratio()))


def map_label_to_type(df: DataFrame, targets: list[str] | None = None) -> DataFrame:
    return df.withColumn("bubble_type", g.label_type(F.col("label"), targets or schema.BUBBLE_TYPES))


def with_rotation(df: DataFrame) -> DataFrame:
    return df.withColumn("rotation", g.rotation(F.col("polygon")))


def clamp_boxes(df: DataFrame) -> DataFrame:
    box = g.clamp_box(*[F.col(c) for c in ("x", "y", "w", "h", "page_width", "page_height")])
    return df.withColumns({n: box[n] for n in ("x", "y", "w", "h")})


# --- filters and projections ------------------------------------------------

def passes(min_conf: float = 0.3, types: list[str] | None = None,
           engine_min: dict[str, float] | None = None) -> Column:
    """Confidence >= min_conf (and an engine's own threshold), and a wanted type."""
    keep = F.col("confidence") >= min_conf
    for engine, low in ({"yolo": 0.25} if engine_min is None else engine_min).items():
        keep = keep & ((F.col("engine") != engine) | (F.col("confidence") >= low))
    return keep & F.col("bubble_type").isin(types) if types else keep


def filter_regions(df: DataFrame, min_conf: float = 0.3, types: list[str] | None = None,
                   engine_min: dict[str, float] | None = None) -> DataFrame:
    return df.filter(passes(min_conf, types, engine_min))


def _within(value: Column, low, high) -> Column:
    """low <= value <= high with the value computed once, also after the optimizer has
    moved the filter below the projection that made it."""
    return F.exists(F.array(value), lambda v: v.between(low, high))


def filter_mask_regions(df: DataFrame) -> DataFrame:
    """Plausible mask regions: 3 or more vertices, 0.2-40 % of the page, not too thin."""
    ratio = _area_ratio()
    aspect = F.try_divide(F.col("w"), F.col("h"))
    shaped = (F.col("w") <= 0) | (F.col("h") <= 0) | aspect.between(0.15, 6.0)
    return df.filter((F.size("polygon") >= 3) & shaped & _within(ratio, 0.002, 0.40))


def filter_contour_regions(df: DataFrame) -> DataFrame:
    """Plausible contour regions, with the confidence derived from their size."""
    page = F.col("page_width") * F.col("page_height")
    aspect = F.when(F.col("h") > 0, F.col("w") / F.col("h")).otherwise(F.lit(0.0))
    kept = df.filter(aspect.between(0.2, 8.0) & _within(F.col("area"), page * 0.002, page * 0.35))
    return kept.withColumn("confidence", half_even(F.least(F.lit(1.0), F.col("area") / (page * 0.05)), 4))


def to_ocr_boxes(df: DataFrame) -> DataFrame:
    """Boxes cut to whole pixels toward zero."""
    return df.withColumns({n: F.col(n).cast("int") for n in ("x", "y", "w", "h")})


def to_erase_boxes(df: DataFrame) -> DataFrame:
    whole = F.transform("polygon", lambda p: F.struct(p["x"].cast("int").alias("x"), p["y"].cast("int").alias("y")))
    return to_ocr_boxes(with_polygon(df)).withColumn("polygon", whole)


def to_typeset_rows(df: DataFrame) -> DataFrame:
    """Rows with a translated text, as the typesetter reads them."""
    return df.filter(F.coalesce(F.col("translated_text"), F.lit("")) != "").select(
        "page_id", "x", "y", F.col("w").alias("width"), F.col("h").alias("height"), "polygon",
        "translated_text", F.col("region_index").alias("reading_order"), "bubble_type")


# --- merging ----------------------------------------------------------------

def with_fallback(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Fallback regions for pages without any primary region."""
    spare = fallback.join(primary.select("page_id").distinct(), "page_id", "left_anti")
    return primary.unionByName(spare, allowMissingColumns=True)


def refine_candidates(boxes: DataFrame, masks: DataFrame, min_score: float = 0.5) -> DataFrame:
    """Best mask per prompt box of the page, when its score is high enough."""
    best = masks.groupBy("page_id", "box_id").agg(
        F.max_by("mask_id", F.struct("score", -F.col("mask_id"))).alias("mask_id"), F.max("score").alias("score"))
    return boxes.join(best.filter(F.col("score") >= min_score), ["page_id", "box_id"])


def merge_regions(regions: DataFrame, iou: float = 0.5, partial: float = 0.7,
                  priority: list[str] | None = None, fold_rows: int = FOLD_ROWS,
                  position: str | None = None, **kw) -> DataFrame:
    """Merge overlapping detections per page.

    Most confident first; a region overlapping an accepted one by more than
    ``iou`` is dropped; one overlapping by more than ``iou * partial`` replaces
    an accepted region without mask when it has a mask itself.
    """
    priority = priority or schema.DETECTOR_PRIORITY
    geometry = [c for c in ("x", "y", "w", "h") if c in regions.columns]
    others = [c for c in regions.columns if c not in ("page_id", "confidence", "engine", *geometry)]
    order = [-F.col("confidence"), rank_of("engine", priority), *geometry, *others]

    return greedy(
        regions, ["page_id"], order, Rule(True, iou, iou * partial),
        never=(F.col("w") <= 0) | (F.col("h") <= 0), fold_rows=fold_rows, position=position, **kw)


def reading_order(regions: DataFrame, column_tolerance: float | None = None, ties: list[Column] | None = None, **kw) -> DataFrame:
    """0-based order per page: right to left by box centre, then top to bottom.

    ``column_tolerance`` groups centres into columns of that width first. Exact ties go by the columns ``ties`` if
    named, then keep the order of the merged list (column ``merge_rank``, dropped here), else the surer region comes first.
    """
    centre = F.col("x") + F.col("w") / 2
    if column_tolerance:
        centre = F.floor(centre / column_tolerance)
    ties = [*(ties or []), *([F.col("merge_rank")] if "merge_rank" in regions.columns else [])]
    ties += [-F.col("confidence"), rank_of("engine", schema.DETECTOR_PRIORITY), *[F.col(c) for c in ("x", "w", "h")]]
    out = numbered(regions, ["page_id"], [centre.desc(), F.col("y"), *ties], "__n", **kw)
    return out.withColumn("reading_order", F.col("__n") - 1).drop("__n", "merge_rank")


def cap_per_group(df: DataFrame, keys: list[str], order: list[Column],
                  n: int = schema.MAX_REGIONS_PER_PAGE) -> DataFrame:
    return first_rows(df, keys, order, n)


def detect_regions(raw: DataFrame, fallback: DataFrame | None = None, min_conf: float = 0.3,
                   types: list[str] | None = None, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Filter, fall back, merge, order and cap: the region layer of every page."""
    kept = filter_regions(raw, min_conf, types)
    if fallback is not None:
        kept = with_fallback(kept, fallback)
    # A page's merged regions fit one accepted list, so the order needs no second count.
    merged = merge_regions(kept, fold_rows=fold_rows, position="merge_rank")
    ordered = reading_order(merged, hot_rows=None)
    return ordered.filter(F.col("reading_order") < schema.MAX_REGIONS_PER_PAGE)


# --- reports ----------------------------------------------------------------

def engines_used(raw: DataFrame, min_conf: float = 0.3, priority: list[str] | None = None) -> DataFrame:
    """Engines with a region passing the filter per page, in priority order."""
    priority = priority or schema.DETECTOR_PRIORITY
    found = F.when(passes(min_conf), F.struct(rank_of("engine", priority).alias("r"), "engine"))
    names = F.transform(F.array_sort(F.collect_set(found)), lambda e: e["engine"])
    used = raw.groupBy("page_id").agg(names.alias("engines"))
    return used.withColumn("engines", F.when(F.size("engines") > 0, F.col("engines")).otherwise(F.array(F.lit("fallback"))))


def detection_stats(regions: DataFrame) -> DataFrame:
    """One row: totals, mean confidence, and counts by type and by engine."""
    groups = regions.groupBy("bubble_type", "engine").agg(
        F.count("*").alias("n"), F.sum("confidence").alias("c"), F.sum("time_ms").alias("t"))
    one = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_regions"),
        F.coalesce(F.sum("c") / F.sum("n"), F.lit(0.0)).alias("avg_confidence"),
        F.coalesce(F.sum("t"), F.lit(0.0)).alias("total_time_ms"),
        F.collect_list(F.struct("bubble_type", "engine", "n")).alias("g"))
    return one.withColumns({"by_type": tally(F.col("g"), "bubble_type"), "by_engine": tally(F.col("g"), "engine")}).drop("g")


def one_row(*frames: DataFrame) -> DataFrame:
    """Put one-row aggregates side by side."""
    out = frames[0].withColumn("__one", F.lit(1))
    for frame in frames[1:]:
        out = out.join(F.broadcast(frame.withColumn("__one", F.lit(1))), "__one")
    return out.drop("__one")


def region_json(df: DataFrame) -> DataFrame:
    """Regions as JSON objects, and the metadata kept with a bubble."""
    doc = F.to_json(F.struct(
        F.transform("polygon", lambda p: F.array(p["x"], p["y"])).alias("polygon"),
        F.array("x", "y", "w", "h").alias("bbox"),
        "confidence", "bubble_type", F.col("engine").alias("engine_name"),
        g.polygon_area(F.col("polygon")).alias("area"),
        F.coalesce(F.col("text_prompt"), F.lit("")).alias("text_prompt"),
        F.coalesce(F.col("time_ms"), F.lit(0.0)).alias("processing_time_ms"),
    ))
    meta = F.to_json(F.struct(
        F.col("engine"), "has_mask", F.size("polygon").alias("polygon_vertices"),
        g.polygon_area(F.col("polygon")).alias("area")))
    return df.withColumns({"region_json": doc, "metadata_json": meta})


# --- erase plan -------------------------------------------------------------

TILE = 1024
LARGE = 2048


def _tile_step(tile: int) -> int:
    return tile - tile // 8


def tile_pages(pages: DataFrame, tile: int = TILE) -> DataFrame:
    """Overlapping tile grid of pages wider or higher than 2048; smaller pages give none."""
    step = _tile_step(tile)
    large = pages.filter((F.col("width") > LARGE) | (F.col("height") > LARGE))
    xs, ys = (F.sequence(F.lit(0), F.col(c) - 1, F.lit(step)) for c in ("width", "height"))
    return (
        large.withColumn("tile_y", F.explode(ys)).withColumn("tile_x", F.explode(xs))
        .select("page_id", "tile_x", "tile_y",
                (F.least(F.col("tile_x") + tile, F.col("width")) - F.col("tile_x")).alias("tile_w"),
                (F.least(F.col("tile_y") + tile, F.col("height")) - F.col("tile_y")).alias("tile_h")))


def assign_regions_to_tiles(regions: DataFrame, tiles: DataFrame, tile: int = TILE) -> DataFrame:
    """Tiles touched by each region: tile positions are computed from the box, so the join is an equi-join.
    The planner takes exploded tiles for as small as their pages, so it is told not to broadcast them."""
    step = _tile_step(tile)

    def hits(start: Column, length: Column) -> Column:
        first = F.greatest(F.lit(0), F.floor((start - tile) / step).cast("int") + 1)
        last = F.ceil((start + length) / step).cast("int") - 1
        index = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        return F.transform(index, lambda i: i * step)

    placed = (
        regions.withColumn("tile_x", F.explode(hits(F.col("x"), F.col("w"))))
        .withColumn("tile_y", F.explode(hits(F.col("y"), F.col("h")))))
    return placed.hint("merge").join(tiles.hint("merge"), ["page_id", "tile_x", "tile_y"])


def erase_plan(regions: DataFrame, default_dilation: int = 4, complex_dilation: int = 8) -> DataFrame:
    """Mask source and dilation radius per region (boxes clipped to the page)."""
    vertices = F.coalesce(F.size("polygon"), F.lit(0))
    source = (F.when(F.col("has_mask"), "mask").when(vertices >= 3, "polygon").otherwise("bbox"))
    dilation = (F.when(F.col("dilation") > default_dilation, F.col("dilation"))
                .when(F.col("complex_background"), complex_dilation).otherwise(default_dilation))
    return regions.withColumns({
        "mask_source": source, "dilation_radius": dilation, "has_polygon": vertices >= 3,
        "clip_x": F.greatest(F.lit(0), F.col("x").cast("int")), "clip_y": F.greatest(F.lit(0), F.col("y").cast("int")),
        "clip_x2": F.least(F.col("page_width"), (F.col("x") + F.col("w")).cast("int")),
        "clip_y2": F.least(F.col("page_height"), (F.col("y") + F.col("h")).cast("int")),
    })


def erase_page_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("page_id").agg(
        F.count("*").alias("regions"), F.count_if("has_mask").alias("masks"), F.count_if("has_polygon").alias("polygons"))


def erase_stats(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count("*").alias("total_regions"), F.count_if("complex_background").alias("regions_complex"),
        F.count_if(~F.col("complex_background")).alias("regions_simple"),
        F.coalesce(F.avg("time_ms"), F.lit(0.0)).alias("avg_processing_time_ms"),
        F.sort_array(F.collect_set("engine")).alias("engines_used"))
