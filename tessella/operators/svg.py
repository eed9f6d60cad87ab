"""Dots to SVG, a row for each line."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.color import hex_color, one_decimal
from tessella.params import Shape


def _element(shape: Shape) -> Column:
    n, x, y, r = one_decimal, F.col("x"), F.col("y"), F.col("radius")
    fill = F.concat(F.lit('fill="'), hex_color(), F.lit('"/>'))
    if shape.kind == "circle":
        return F.concat(F.lit('  <circle cx="'), n(x), F.lit('" cy="'), n(y), F.lit('" r="'), n(r), F.lit('" '), fill)
    if shape.kind == "square":
        return F.concat(F.lit('  <rect x="'), n(x - r), F.lit('" y="'), n(y - r), F.lit('" width="'), n(r * 2), F.lit('" height="'), n(r * 2), F.lit('" '), fill)
    if shape.kind == "ellipse":
        minor = F.greatest(r / F.lit(max(shape.aspect, 0.01)), F.lit(0.5))
        turn = F.concat(F.lit(f'transform="rotate({shape.angle_deg:.1f},'), n(x), F.lit(","), n(y), F.lit(')" '))
        return F.concat(F.lit('  <ellipse cx="'), n(x), F.lit('" cy="'), n(y), F.lit('" rx="'), n(r), F.lit('" ry="'), n(minor), F.lit('" '), turn, fill)
    sides = max(shape.sides, 3)
    turns = [2 * math.pi * i / sides - math.pi / 2 for i in range(sides)]  # a corner on top
    points = F.concat_ws(" ", *(F.concat(n(x + r * math.cos(a)), F.lit(","), n(y + r * math.sin(a))) for a in turns))
    return F.concat(F.lit('  <polygon points="'), points, F.lit('" '), fill)


def svg_elements(dots: DataFrame, shape: Shape) -> DataFrame:
    """``(img_id, place, element)``: dots of half a pixel and more, large ones first."""
    from tessella.operators.raster import painter_order

    return painter_order(dots.where("radius >= 0.5")).select("img_id", "place", _element(shape).alias("element"))


def svg_lines(dots: DataFrame, sizes: DataFrame, shape: Shape, bg: tuple[int, int, int], transparent: bool) -> DataFrame:
    """``(img_id, place, element)``: whole documents, head at -1, background at 0, end last."""
    head = F.format_string('<svg xmlns="http://www.w3.org/2000/svg" width="%d" height="%d" viewBox="0 0 %d %d">', "w", "h", "w", "h")
    back = F.format_string('  <rect width="%d" height="%d" fill="#%02x%02x%02x"/>', F.col("w"), F.col("h"), *(F.lit(c) for c in bg))
    rows = [F.struct(F.lit(-1).alias("place"), head.alias("element"))]
    if not transparent:
        rows.append(F.struct(F.lit(0).alias("place"), back.alias("element")))
    rows.append(F.struct(F.lit(2**31 - 1).alias("place"), F.lit("</svg>").alias("element")))
    frame = sizes.select("img_id", F.explode(F.array(*rows)).alias("e")).select("img_id", "e.*")
    return svg_elements(dots, shape).unionByName(frame)
