"""Queries of the region layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelflow import schema
from panelflow.checks.base import flat, query, rounded, sql
from panelflow.functions import geometry as g
from panelflow.operators import regions as R
from panelflow.operators import typeset as TS

# Greedy merge in SQL: sorted list per page, folded over an accepted list.
IOU = """(CASE WHEN least(k.x + k.w, r.x + r.w) > greatest(k.x, r.x) AND least(k.y + k.h, r.y + r.h) > greatest(k.y, r.y)
 THEN (least(k.x + k.w, r.x + r.w) - greatest(k.x, r.x)) * (least(k.y + k.h, r.y + r.h) - greatest(k.y, r.y))
 / (k.w * k.h + r.w * r.h - (least(k.x + k.w, r.x + r.w) - greatest(k.x, r.x)) * (least(k.y + k.h, r.y + r.h) - greatest(k.y, r.y)))
 ELSE 0 END)"""
HIT = f"({IOU} > 0.5 OR ({IOU} > 0.35 AND r.has_mask AND NOT k.has_mask))"
ROW = ("STRUCT(o DOUBLE, rk INTEGER, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE, bubble_type VARCHAR, has_mask BOOLEAN, "
       "time_ms DOUBLE, engine VARCHAR, confidence DOUBLE)")
MERGED = f"""
kept AS (SELECT * FROM raw_regions WHERE confidence >= 0.3),
lists AS (SELECT page_id, list_sort(list(CAST({{'o': -confidence, 'rk': CASE engine WHEN 'yolo' THEN 1 WHEN 'groundingdino' THEN 2 ELSE 3 END,
  'x': x, 'y': y, 'w': w, 'h': h, 'bubble_type': bubble_type, 'has_mask': has_mask, 'time_ms': time_ms,
  'engine': engine, 'confidence': confidence}} AS {ROW}))) AS rows FROM kept GROUP BY page_id),
folded AS (SELECT page_id, list_reduce(rows, lambda acc, r:
  CASE WHEN len(list_filter(acc, lambda k: {HIT})) = 0 THEN list_append(acc, r)
  WHEN {IOU.replace("k.", "list_filter(acc, lambda k: " + HIT + ")[1].")} > 0.5 THEN acc
  ELSE list_transform(acc, lambda k, i: CASE WHEN i = list_position(list_transform(acc, lambda k: {HIT}), true) THEN r ELSE k END) END,
  CAST([] AS {ROW}[])) AS acc FROM lists),
merged AS (SELECT page_id, pos, unnest(acc[pos:pos], recursive := true) FROM (SELECT *, unnest(range(1, len(acc) + 1)) AS pos FROM folded))"""


@query(sql("SELECT page_id, engine, confidence, x, y, w, h, bubble_type, has_mask, time_ms FROM raw_regions "
           "WHERE confidence >= 0.3 AND bubble_type IN ('speech', 'thought')", "raw_regions"))
def filter_regions(d):
    return R.filter_regions(d.raw_regions, types=["speech", "thought"])


@query(sql("SELECT page_id, engine, confidence, x, y, w, h, bubble_type, has_mask, time_ms FROM merged",
           "raw_regions", extra=MERGED))
def merge_regions(d):
    return R.merge_regions(R.filter_regions(d.raw_regions))


@query(sql("""
    SELECT page_id, engine, confidence, x, y, w, h, bubble_type, has_mask, time_ms,
      row_number() OVER (PARTITION BY page_id ORDER BY x + w / 2 DESC, y, pos) - 1 AS reading_order
    FROM merged QUALIFY reading_order < 200""", "raw_regions", extra=MERGED))
def ordered_regions(d):
    """Filter, merge, reading order and cap: the flagship."""
    return R.detect_regions(d.raw_regions)


@query(sql("""
    SELECT page_id, x, y, w, h, row_number() OVER (PARTITION BY page_id ORDER BY x + w / 2 DESC, y, confidence DESC, CASE engine WHEN 'yolo' THEN 1 WHEN 'groundingdino' THEN 2 ELSE 3 END, x, w, h) - 1
      AS reading_order FROM raw_regions""", "raw_regions"))
def reading_order(d):
    return R.reading_order(d.raw_regions).select("page_id", "x", "y", "w", "h", "reading_order")


@query(sql("""
    SELECT page_id, x, y, w, h, row_number() OVER (PARTITION BY page_id ORDER BY floor((x + w / 2) / 100) DESC, y, confidence DESC, CASE engine WHEN 'yolo' THEN 1 WHEN 'groundingdino' THEN 2 ELSE 3 END, x, w, h) - 1
      AS reading_order FROM raw_regions""", "raw_regions"))
def reading_order_by_column(d):
    return R.reading_order(d.raw_regions, column_tolerance=100).select("page_id", "x", "y", "w", "h", "reading_order")


@query(sql("""
    SELECT page_id, confidence, x, y, w, h, time_ms FROM raw_regions
    QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY confidence DESC, x, y, w, h, time_ms) <= 3""", "raw_regions"))
def cap_per_page(d):
    order = [F.col("confidence").desc(), *[F.col(c) for c in ("x", "y", "w", "h", "time_ms")]]
    return R.cap_per_group(d.raw_regions, ["page_id"], order, 3).select(
        "page_id", "confidence", "x", "y", "w", "h", "time_ms")


@query(sql("""
    SELECT page_id, engine, confidence, x, y FROM raw_regions WHERE engine <> 'sam2' AND confidence >= 0.3
    UNION ALL SELECT page_id, engine, confidence, x, y FROM raw_regions WHERE engine = 'sam2'
      AND page_id NOT IN (SELECT page_id FROM raw_regions WHERE engine <> 'sam2' AND confidence >= 0.3)""", "raw_regions"))
def fallback_regions(d):
    models = d.raw_regions.filter("engine <> 'sam2'")
    contours = d.raw_regions.filter("engine = 'sam2'")
    return R.with_fallback(R.filter_regions(models), contours).select("page_id", "engine", "confidence", "x", "y")


@query(sql("""
    SELECT page_id, box_id, max(score) AS score, CAST(split_part(max(lpad(CAST(round(score * 100) AS INTEGER)::VARCHAR, 4, '0') || ':'
      || lpad((99999999 - mask_id)::VARCHAR, 8, '0')), ':', 2) AS BIGINT) * -1 + 99999999 AS mask_id
    FROM (SELECT page_id, CAST(x AS BIGINT) % 5 AS box_id, CAST(y AS BIGINT) AS mask_id, confidence AS score FROM raw_regions
      WHERE engine = 'sam2') JOIN (SELECT DISTINCT page_id, CAST(x AS BIGINT) % 5 AS box_id FROM raw_regions WHERE engine = 'yolo')
      USING (page_id, box_id) GROUP BY page_id, box_id HAVING max(score) >= 0.5""", "raw_regions"))
def refine_candidates(d):
    box = (F.col("x").cast("long") % 5).alias("box_id")
    boxes = d.raw_regions.filter("engine = 'yolo'").select("page_id", box).distinct()
    masks = d.raw_regions.filter("engine = 'sam2'").select(
        "page_id", box, F.col("y").cast("long").alias("mask_id"), F.col("confidence").alias("score"))
    return R.refine_candidates(boxes, masks)


@query(sql("""
    SELECT page_id, coalesce(engines, 'fallback') AS engines FROM (SELECT DISTINCT page_id FROM raw_regions)
    LEFT JOIN (SELECT page_id, string_agg(engine, ',' ORDER BY CASE engine WHEN 'yolo' THEN 1 WHEN 'groundingdino' THEN 2 ELSE 3 END)
      AS engines FROM (SELECT DISTINCT page_id, engine FROM raw_regions WHERE confidence >= 0.3) GROUP BY page_id) USING (page_id)""",
           "raw_regions"))
def engines_used(d):
    return R.engines_used(d.raw_regions).withColumn("engines", F.array_join("engines", ","))


@query(sql("""
    SELECT count(*) AS total_regions, round(avg(confidence), 6) AS avg_confidence, round(sum(time_ms), 2) AS total_time_ms,
      (SELECT string_agg(bubble_type || '=' || n, ',' ORDER BY bubble_type) FROM (SELECT bubble_type, count(*) AS n FROM raw_regions GROUP BY 1)) AS by_type,
      (SELECT string_agg(engine || '=' || n, ',' ORDER BY engine) FROM (SELECT engine, count(*) AS n FROM raw_regions GROUP BY 1)) AS by_engine
    FROM raw_regions""", "raw_regions"))
def detection_stats(d):
    s = R.detection_stats(d.raw_regions)
    return s.select("total_regions", F.round("avg_confidence", 6).alias("avg_confidence"),
                    F.round("total_time_ms", 2).alias("total_time_ms"),
                    flat(F.col("by_type")).alias("by_type"), flat(F.col("by_engine")).alias("by_engine"))


def shaped(d):
    """Regions with a hexagon in their box."""
    x, y, w, h = (F.col(c) for c in ("x", "y", "w", "h"))
    poly = F.array(*[g.point(a, b) for a, b in (
        (x + w / 4, y), (x + w * 3 / 4, y), (x + w, y + h / 2), (x + w * 3 / 4, y + h), (x + w / 4, y + h), (x, y + h / 2))])
    return d.raw_regions.withColumns({"polygon": poly, "page_width": F.lit(800), "page_height": F.lit(1200)})


AREA = "w * h * 0.75"
PERIMETER = "(w + 4 * sqrt(w * w / 16 + h * h / 4))"
ROUND = f"(4 * pi() * {AREA} / ({PERIMETER} * {PERIMETER}))"
SHAPE = f"""CASE WHEN w <= 0 OR h <= 0 THEN 'speech' WHEN {AREA} / 960000 > 0.15 AND w / h > 2.5 THEN 'poster'
  WHEN {AREA} / 960000 > 0.15 THEN 'sfx' WHEN w / h > 2 AND {AREA} / 960000 < 0.02 THEN 'sign' WHEN w / h > 2 THEN 'narration'
  WHEN w / h < 0.5 THEN 'sign'"""


@query(sql("SELECT page_id, x, y, w, h FROM raw_regions", "raw_regions"))
def bbox_from_polygon(d):
    return R.with_bbox(shaped(d).drop("x", "y", "w", "h")).select(
        "page_id", "x", "y", "w", "h")


@query(sql("SELECT page_id, x AS x1, y AS y1, x + w AS x3, y + h AS y3, w * h AS area FROM raw_regions", "raw_regions"))
def polygon_from_bbox(d):
    p = R.with_area(R.with_polygon(d.raw_regions))
    return p.select("page_id", F.col("polygon")[0]["x"].alias("x1"), F.col("polygon")[0]["y"].alias("y1"),
                    F.col("polygon")[2]["x"].alias("x3"), F.col("polygon")[2]["y"].alias("y3"), "area")


@query(sql(f"SELECT page_id, round({AREA}, 4) AS area, round({PERIMETER}, 4) AS perimeter, round({ROUND}, 6) AS roundness FROM raw_regions",
           "raw_regions"))
def polygon_shape(d):
    return R.with_shape(shaped(d)).select(
        "page_id", F.round("area", 4).alias("area"), F.round("perimeter", 4).alias("perimeter"),
        F.round("roundness", 6).alias("roundness"))


@query(sql(f"SELECT page_id, x, y, w, h, {SHAPE} WHEN {ROUND} > 0.6 AND {ROUND} < 0.75 THEN 'thought' WHEN {ROUND} > 0.6 THEN 'speech' "
           f"WHEN w / h > 1.5 AND {ROUND} < 0.3 THEN 'narration' ELSE 'speech' END AS bubble_type FROM raw_regions", "raw_regions"))
def classify_mask_shape(d):
    return R.classify_mask_shape(shaped(d)).select("page_id", "x", "y", "w", "h", "bubble_type")


@query(sql(f"SELECT page_id, x, y, w, h, {SHAPE} WHEN w / h > 1.5 THEN 'narration' ELSE 'speech' END AS bubble_type FROM raw_regions",
           "raw_regions"))
def classify_contour_shape(d):
    return R.classify_contour_shape(shaped(d)).select("page_id", "x", "y", "w", "h", "bubble_type")


@query(sql(f"SELECT page_id, x, y, w, h FROM raw_regions WHERE {AREA} / 960000 BETWEEN 0.002 AND 0.40 AND w / h BETWEEN 0.15 AND 6.0",
           "raw_regions"))
def filter_mask_regions(d):
    return R.filter_mask_regions(R.with_area(shaped(d))).select("page_id", "x", "y", "w", "h")


@query(sql(f"""SELECT page_id, x, y, w, h, {rounded(f"least(1.0, {AREA} / (964403 * 0.05))", 4)} AS confidence FROM raw_regions
    WHERE {AREA} BETWEEN 964403 * 0.002 AND 964403 * 0.35 AND w / h BETWEEN 0.2 AND 8.0""", "raw_regions"))
def filter_contour_regions(d):
    pages = shaped(d).withColumns({"page_width": F.lit(803), "page_height": F.lit(1201)})
    return R.filter_contour_regions(R.with_area(pages)).select("page_id", "x", "y", "w", "h", "confidence")


@query(sql("""
    SELECT page_id, x, y, w, h, coalesce(['speech', 'thought', 'narration', 'sfx', 'sign', 'title', 'poster'][c + 1], 'speech')
      AS bubble_type FROM (SELECT *, CAST(time_ms AS BIGINT) % 10 AS c FROM raw_regions)""", "raw_regions"))
def normalize_boxes(d):
    xyxy = d.raw_regions.select("page_id", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"),
                                (F.col("y") + F.col("h")).alias("y2"), (F.rint("time_ms").cast("long") % 10).alias("class_id"))
    return R.normalize_boxes(xyxy)


def _label_sql() -> str:
    rules = [(t, [t]) for t in schema.BUBBLE_TYPES] + schema.LABEL_KEYWORDS
    whens = " ".join(f"WHEN {' OR '.join(f'''contains(l, '{w}')''' for w in words)} THEN '{name}'" for name, words in rules)
    return f"CASE {whens} ELSE 'speech' END"


LABELS = ["Cloud Bubble", "sound effect", "panel BOX", "billboard sign", "a title", "banner", "thinking", "ring"]


@query(sql(f"""SELECT p_partkey AS id, label, {_label_sql()} AS bubble_type FROM (SELECT *, trim(lower(label)) AS l FROM
    (SELECT p_partkey, p_name || ' ' || {LABELS}[CAST(p_partkey % {len(LABELS)} + 1 AS INTEGER)] AS label FROM part))"""))
def map_label_to_type(d):
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.col("p_partkey") % len(LABELS) + 1).cast("int"))
    part = d.table("part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" "), label).alias("label"))
    return R.map_label_to_type(part)


@query(sql(f"""SELECT page_id, x, y, CASE WHEN dx = 0 THEN CASE WHEN dy <> 0 THEN 90.0 ELSE 0.0 END ELSE {rounded("CASE WHEN a > 90 THEN a - 180 WHEN a < -90 THEN a + 180 ELSE a END", 1)} END AS rotation FROM (SELECT *, degrees(atan2(dy, dx)) AS a FROM
    (SELECT page_id, x, y, w - 115 AS dx, h - 80 AS dy FROM raw_regions))""", "raw_regions"))
def polygon_rotation(d):
    x, y = F.col("x"), F.col("y")
    poly = F.array(g.point(x, y), g.point(x + F.col("w") - 115, y + F.col("h") - 80))
    return R.with_rotation(d.raw_regions.withColumn("polygon", poly)).select("page_id", "x", "y", "rotation")


CLAMP = """(SELECT page_id, time_ms, greatest(0, least(x - 50, 799)) AS cx, greatest(0, least(y, 1199)) AS cy, x, y, w - 60 AS w, h FROM raw_regions)"""


@query(sql(f"""SELECT page_id, time_ms, CAST(CASE WHEN e THEN 0 ELSE cx END AS INTEGER) AS x, CAST(CASE WHEN e THEN 0 ELSE cy END AS INTEGER) AS y,
    CAST(CASE WHEN e THEN 800 ELSE cw END AS INTEGER) AS w, CAST(CASE WHEN e THEN 1200 ELSE ch END AS INTEGER) AS h FROM
    (SELECT *, cw <= 0 OR ch <= 0 AS e FROM (SELECT *, least(w, 800 - cx) AS cw, least(h, 1200 - cy) AS ch FROM {CLAMP}))""", "raw_regions"))
def clamp_boxes(d):
    moved = shaped(d).withColumns({"x": F.col("x") - 50, "w": F.col("w") - 60})
    return R.clamp_boxes(moved).select("page_id", "time_ms", "x", "y", "w", "h")


@query(sql(f"""SELECT k.page_id, round(max({IOU}), 6) AS best_iou, count(*) FILTER ({IOU} > 0.5) AS n_iou,
    count(*) FILTER (greatest(0, least(k.x + k.w, r.x + r.w) - greatest(k.x, r.x)) * greatest(0, least(k.y + k.h, r.y + r.h) - greatest(k.y, r.y))
      / least(k.w * k.h, r.w * r.h) > 0.5) AS n_overlap
    FROM first k JOIN raw_regions r USING (page_id) GROUP BY k.page_id""", "raw_regions",
    extra="""first AS (SELECT page_id, min(x) AS x, min(y) AS y, 150.0::DOUBLE AS w, 100.0::DOUBLE AS h FROM raw_regions GROUP BY page_id)"""))
def box_overlap(d):
    """IoU and overlap share of every region with one reference box of its page."""
    box = F.struct(F.min("x").alias("x"), F.min("y").alias("y"), F.lit(150.0).alias("w"), F.lit(100.0).alias("h"))
    first = d.raw_regions.groupBy("page_id").agg(box.alias("k"))
    both = d.raw_regions.withColumn("r", F.struct("x", "y", "w", "h")).join(first, "page_id")
    k, r = F.col("k"), F.col("r")
    return both.groupBy("page_id").agg(
        F.round(F.max(g.iou(k, r)), 6).alias("best_iou"), F.count_if(g.iou(k, r) > 0.5).alias("n_iou"),
        F.count_if(g.overlap_min(k, r) > 0.5).alias("n_overlap"))


def big_pages(d):
    return d.table("orders").select(
        F.col("o_orderkey").alias("page_id"), (1000 + F.col("o_orderkey") % 3000).cast("int").alias("width"),
        (1500 + F.col("o_orderkey") % 2500).cast("int").alias("height"))


TILES_SQL = """big AS (SELECT o_orderkey AS page_id, CAST(1000 + o_orderkey % 3000 AS INTEGER) AS width,
    CAST(1500 + o_orderkey % 2500 AS INTEGER) AS height FROM orders),
across AS (SELECT *, unnest(range(0, width, 896)) AS tile_x FROM big WHERE width > 2048 OR height > 2048),
grid AS (SELECT *, unnest(range(0, height, 896)) AS tile_y FROM across),
tiles AS (SELECT page_id, tile_x, tile_y, least(tile_x + 1024, width) - tile_x AS tile_w,
    least(tile_y + 1024, height) - tile_y AS tile_h FROM grid)"""


@query(sql("SELECT page_id, CAST(tile_x AS INTEGER) AS tile_x, CAST(tile_y AS INTEGER) AS tile_y, CAST(tile_w AS INTEGER) AS tile_w, "
           "CAST(tile_h AS INTEGER) AS tile_h FROM tiles", extra=TILES_SQL))
def tile_pages(d):
    return R.tile_pages(big_pages(d))


@query(sql("""SELECT page_id, time_ms, CAST(tile_x AS INTEGER) AS tile_x, CAST(tile_y AS INTEGER) AS tile_y
    FROM raw_regions r JOIN tiles t USING (page_id)
    WHERE r.x < tile_x + 1024 AND r.x + r.w > tile_x AND r.y < tile_y + 1024 AND r.y + r.h > tile_y""", "raw_regions", extra=TILES_SQL))
def regions_to_tiles(d):
    return R.assign_regions_to_tiles(d.raw_regions, R.tile_pages(big_pages(d))).select("page_id", "time_ms", "tile_x", "tile_y")


def _erase_rows(d):
    return shaped(d).withColumns({
        "polygon": F.when(F.col("engine") == "yolo", F.col("polygon")),
        "dilation": F.col("w").cast("int") % 9, "complex_background": F.col("h") > 75})


ERASE = """erase AS (SELECT *, CASE WHEN has_mask THEN 'mask' WHEN engine = 'yolo' THEN 'polygon' ELSE 'bbox' END AS mask_source,
  CASE WHEN CAST(w AS INTEGER) % 9 > 4 THEN CAST(w AS INTEGER) % 9 WHEN h > 75 THEN 8 ELSE 4 END AS dilation_radius FROM raw_regions)"""


@query(sql("SELECT page_id, time_ms, mask_source, dilation_radius FROM erase", "raw_regions", extra=ERASE))
def erase_plan(d):
    return R.erase_plan(_erase_rows(d)).select("page_id", "time_ms", "mask_source", "dilation_radius")


@query(sql("SELECT page_id, count(*) AS regions, count(*) FILTER (has_mask) AS masks, count(*) FILTER (engine = 'yolo') AS polygons "
           "FROM raw_regions GROUP BY page_id", "raw_regions"))
def erase_page_counts(d):
    return R.erase_page_counts(R.erase_plan(_erase_rows(d)))


@query(sql("""SELECT count(*) AS total_regions, count(*) FILTER (h > 75) AS regions_complex, count(*) FILTER (h <= 75) AS regions_simple,
    round(avg(time_ms), 4) AS avg_processing_time_ms, (SELECT string_agg(engine, ',' ORDER BY engine) FROM (SELECT DISTINCT engine FROM raw_regions)) AS engines_used
    FROM raw_regions""", "raw_regions"))
def erase_stats(d):
    s = R.erase_stats(_erase_rows(d))
    return s.withColumns({"engines_used": F.array_join("engines_used", ","),
                          "avg_processing_time_ms": F.round("avg_processing_time_ms", 4)})


@query(sql("SELECT page_id, CAST(trunc(x / 3) AS INTEGER) AS x, CAST(trunc(y / 7) AS INTEGER) AS y, CAST(trunc(w / 3) AS INTEGER) AS w, "
           "CAST(trunc(h / 7) AS INTEGER) AS h, time_ms FROM raw_regions", "raw_regions"))
def ocr_boxes(d):
    cut = d.raw_regions.withColumns({"x": F.col("x") / 3, "y": F.col("y") / 7, "w": F.col("w") / 3, "h": F.col("h") / 7})
    return R.to_ocr_boxes(cut).select("page_id", "x", "y", "w", "h", "time_ms")


@query(sql("SELECT page_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(trunc(x + w * 3 / 4) AS INTEGER) AS px, "
           "CAST(trunc(y + h / 2) AS INTEGER) AS py, has_mask FROM raw_regions", "raw_regions"))
def erase_boxes(d):
    return R.to_erase_boxes(shaped(d)).select(
        "page_id", "x", "y", F.col("polygon")[1]["x"].alias("px"), F.col("polygon")[2]["y"].alias("py"), "has_mask")


@query(sql("SELECT page_id, x, y, width, height, 'T: ' || original_text AS translated_text, CAST(reading_order AS INTEGER) AS reading_order, bubble_type "
           "FROM bubbles WHERE page_id % 3 <> 0", "bubbles"))
def typeset_rows(d):
    rows = R.with_polygon(d.bubbles.withColumnsRenamed({"width": "w", "height": "h"})).withColumns({
        "translated_text": F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("T: "), "original_text")).otherwise(""),
        "region_index": F.col("reading_order").cast("int")})
    return R.to_typeset_rows(rows).drop("polygon")


@query(sql("""SELECT page_id, x, y, CAST(json_extract(j, '$.confidence') AS DOUBLE) AS confidence, 6 AS vertices FROM
    (SELECT *, json_object('confidence', confidence) AS j FROM raw_regions)""", "raw_regions"))
def region_json(d):
    rows = R.region_json(shaped(d).withColumn("text_prompt", F.lit(None).cast("string")))
    doc = F.from_json("region_json", "confidence double, bbox array<double>")
    meta = F.from_json("metadata_json", "polygon_vertices int")
    return rows.select("page_id", doc["bbox"][0].alias("x"), doc["bbox"][1].alias("y"),
                       doc["confidence"].alias("confidence"), meta["polygon_vertices"].alias("vertices"))


STYLE_VALUES = ", ".join(
    f"('{n}', '{v[0]}', {v[1]}, {v[2]}, {v[4]}::DOUBLE)" for n, v in schema.STYLES.items())
STYLED = f"""styles(style_type, font_name, font_size_min, font_size_max, padding_ratio) AS (VALUES {STYLE_VALUES}),
styled AS (SELECT b.*, s.*, 'T: ' || original_text AS translated_text FROM
  (SELECT *, CASE WHEN turn_type IN (SELECT style_type FROM styles) THEN turn_type ELSE 'default' END AS st FROM
    (SELECT *, CASE WHEN reading_order = 3 THEN 'scroll' ELSE bubble_type END AS turn_type FROM bubbles)) b JOIN styles s ON st = style_type)"""


def _styled(d):
    kind = F.when(F.col("reading_order") == 3, "scroll").otherwise(F.col("bubble_type"))
    rows = d.bubbles.withColumns({"bubble_type": kind, "translated_text": F.concat(F.lit("T: "), "original_text"),
                                  "own_font": F.when(F.col("reading_order") == 5, "own.ttf")})
    return TS.with_style(rows, {"font_name": "own_font"})


@query(sql("SELECT id, turn_type AS bubble_type, style_type, CASE WHEN reading_order = 5 THEN 'own.ttf' ELSE font_name END AS font_name, "
           "font_size_min, font_size_max, padding_ratio FROM styled", "bubbles", extra=STYLED))
def bubble_style(d):
    return _styled(d).select("id", "bubble_type", "style_type", "font_name", "font_size_min", "font_size_max", "padding_ratio")


FIT = """fits AS (SELECT *, list_filter(range(hi, lo - 1, -2), lambda s:
    ceil(n / greatest(1, floor(rh / floor(s * 1.2)))) * s <= rw)[1] AS fit FROM
  (SELECT id, n, CASE WHEN big THEN font_size_min ELSE 8 END AS lo, CASE WHEN big THEN font_size_max ELSE font_size_min END AS hi,
     CASE WHEN big THEN w - 2 * pad ELSE w - 4 END AS rw, CASE WHEN big THEN h - 2 * pad ELSE h - 4 END AS rh FROM
   (SELECT *, w - 2 * pad > 0 AND h - 2 * pad > 0 AS big FROM (SELECT id, length(translated_text) AS n, width AS w, height AS h,
     greatest(2, floor(width * padding_ratio)) AS pad, font_size_min, font_size_max FROM styled
     WHERE regexp_matches(translated_text, '\\S')))))"""


@query(sql("""SELECT id, CAST(coalesce(fit, hi) AS INTEGER) AS font_size,
    CAST(ceil(n / greatest(1, floor(rh / floor(coalesce(fit, hi) * 1.2)))) AS INTEGER) AS columns, fit IS NULL AS overflow FROM fits""",
           "bubbles", extra=STYLED + ",\n" + FIT))
def vertical_fit(d):
    return TS.vertical_fit(_styled(d)).select("id", "font_size", "columns", "overflow")


@query(sql("""SELECT count(*) AS total_bubbles, count(*) AS bubbles_with_effects, count(*) FILTER (reading_order % 2 = 0) AS vertical_bubbles,
    (SELECT string_agg(f, ',' ORDER BY f) FROM (SELECT DISTINCT CASE WHEN reading_order = 5 THEN 'own.ttf' ELSE font_name END AS f FROM styled)) AS fonts_used,
    (SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT DISTINCT turn_type AS t FROM styled)) AS bubble_types_used FROM styled""",
           "bubbles", extra=STYLED))
def typeset_stats(d):
    s = TS.typeset_stats(_styled(d).withColumn("is_vertical", F.col("reading_order") % 2 == 0))
    return s.withColumns({"fonts_used": F.array_join("fonts_used", ","), "bubble_types_used": F.array_join("bubble_types_used", ",")})
