"""Typesetting checks: style per bubble and vertical fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow import schema
from panelflow.functions.text import has_text, strip


def styles(spark) -> DataFrame:
    """The fixed preset table (eight rows)."""
    rows = [(name, *values) for name, values in schema.STYLES.items()]
    kinds = "style_type string, font_name string, font_size_min int, font_size_max int, " \
            "line_height_ratio double, padding_ratio double, outline_width int, shadow_blur int, " \
            "stroke_width int, text_align string, font_weight string, italic boolean, uppercase boolean"
    return spark.createDataFrame(rows, kinds)


def with_style(bubbles: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """Preset of the bubble type, 'default' for unknown types; ``overrides`` maps a
    style field to the bubble column that wins where it is not null."""
    known = [n for n in schema.STYLES if n != "default"]
    style_type = F.when(F.col("bubble_type").isin(known), F.col("bubble_type")).otherwise("default")
    out = bubbles.withColumn("style_type", style_type).join(
        F.broadcast(styles(bubbles.sparkSession)), "style_type")
    for field, column in (overrides or {}).items():
        out = out.withColumn(field, F.coalesce(F.col(column), F.col(field)))
    return out


def _fit(length: Column, inner_w: Column, inner_h: Column, low: Column, high: Column) -> Column:
    """Struct of font size, columns, overflow for the first size that fits; the largest size when none does."""
    sizes = F.when(high >= low, F.sequence(high, low, F.lit(-2))).otherwise(F.array().cast("array<int>"))

    def columns(size: Column) -> Column:
        rows = F.greatest(F.lit(1), F.floor(inner_h / F.floor(size * 1.2)).cast("int"))
        return F.ceil(length / rows).cast("int")

    first = F.try_element_at(F.filter(sizes, lambda s: columns(s) * s <= inner_w), F.lit(1))
    size = F.coalesce(first, high)
    return F.struct(size.alias("font_size"), columns(size).alias("columns"), first.isNull().alias("overflow"))


def vertical_fit(bubbles: DataFrame, text: str = "translated_text") -> DataFrame:
    """Font size and columns of vertical text in each styled bubble (see ``with_style``)."""
    drawn = bubbles.filter(has_text(F.col(text)) & (F.col("width") > 0) & (F.col("height") > 0))
    # Computed before the size search, which would repeat them for every size.
    w, h = F.col("width").cast("int"), F.col("height").cast("int")
    drawn = drawn.withColumns({
        "__w": w, "__h": h, "__len": F.char_length(strip(F.col(text))),
        "__pad": F.greatest(F.lit(2), F.floor(w * F.col("padding_ratio")).cast("int"))})
    w, h, length, pad = (F.col(c) for c in ("__w", "__h", "__len", "__pad"))
    room_w, room_h = w - pad * 2, h - pad * 2
    wide = (room_w > 0) & (room_h > 0)
    again = (w - 4 > 0) & (h - 4 > 0)
    fit = (
        F.when(wide, _fit(length, room_w, room_h, F.col("font_size_min"), F.col("font_size_max")))
        .when(again, _fit(length, w - 4, h - 4, F.lit(8), F.col("font_size_min")))
        .otherwise(F.struct(F.lit(8).alias("font_size"), F.lit(0).alias("columns"), F.lit(True).alias("overflow"))))
    return drawn.withColumn("__fit", fit).select("*", "__fit.*").drop("__fit", "__w", "__h", "__len", "__pad")


def typeset_stats(styled: DataFrame) -> DataFrame:
    effects = (F.col("outline_width") > 0) | (F.col("shadow_blur") > 0) | (F.col("stroke_width") > 0)
    return styled.agg(
        F.count("*").alias("total_bubbles"), F.count_if(effects).alias("bubbles_with_effects"),
        F.sort_array(F.collect_set("font_name")).alias("fonts_used"),
        F.count_if("is_vertical").alias("vertical_bubbles"),
        F.sort_array(F.collect_set("bubble_type")).alias("bubble_types_used"))
