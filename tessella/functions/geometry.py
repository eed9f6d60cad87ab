"""Column expressions for dots: radius and whether a place lies inside a shape."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.params import Params, Shape

Inside = Callable[[Column, Column], Column]


def dot_radius(lum: Column, detail: Column, side: Column, p: Params) -> Column:
    """Dark and even places get large dots; ``side`` is the shorter side of the image."""
    low, high = side * F.lit(p.min_radius_ratio), side * F.lit(p.max_radius_ratio)
    boost = F.lit(1.0) + (F.lit(1.0) - detail) * F.lit(p.variance_sensitivity) * F.lit(p.max_boost - 1.0)
    return F.least((high - (high - low) * lum) * boost, high * F.lit(p.max_boost))


def inside(shape: Shape, radius: Column) -> Inside:
    """Of the offset from a dot's centre, whether it is in the dot."""
    r = radius
    if shape.kind == "circle":
        return lambda x, y: x * x + y * y <= r * r
    if shape.kind == "square":
        return lambda x, y: (F.abs(x) <= r) & (F.abs(y) <= r)
    if shape.kind == "ellipse":
        minor = F.greatest(r / F.lit(max(shape.aspect, 0.01)), F.lit(1.0))
        c, s = math.cos(math.radians(shape.angle_deg)), math.sin(math.radians(shape.angle_deg))
        return lambda x, y: F.pow((x * c + y * s) / r, F.lit(2.0)) + F.pow((y * c - x * s) / minor, F.lit(2.0)) <= 1.0
    return lambda x, y: in_polygon(x, y, r, max(shape.sides, 3))


def in_polygon(x: Column, y: Column, r: Column, sides: int) -> Column:
    """Regular polygon around the origin with a corner on the positive x axis."""
    d = F.sqrt(x * x + y * y)
    sector = 2 * math.pi / sides
    turn = F.pmod(F.atan2(y, x), F.lit(sector)) - F.lit(sector / 2)
    edge = r * F.lit(math.cos(math.pi / sides)) / F.abs(F.cos(turn))
    return F.when(d > r, False).when(d == 0, True).otherwise(d <= edge)


def reach(shape: Shape, radius: Column) -> Column:
    """How far from its centre a dot may touch pixels."""
    if shape.kind == "ellipse":
        return F.ceil(F.greatest(radius, radius / F.lit(max(shape.aspect, 0.01)), F.lit(1.0))) + 1
    return F.ceil(radius) + 1


def coverage(px: Column, py: Column, cx: Column, cy: Column, test: Inside) -> Column:
    """Sixteenths of a pixel that a dot covers: 16 if all corners are inside, 0 if neither a corner nor the middle is,
    else counted on a 4 by 4 raster."""
    x, y = px - 0.5 - cx, py - 0.5 - cy
    corners = [test(x + i, y + j) for j in (0.0, 1.0) for i in (0.0, 1.0)]
    every, some = corners[0], corners[0]
    for c in corners[1:]:
        every, some = every & c, some | c
    count = sum((test(x + (i + 0.5) / 4, y + (j + 0.5) / 4).cast("int") for j in range(4) for i in range(4)), F.lit(0))
    return F.when(every, 16).when(~some & ~test(x + 0.5, y + 0.5), 0).otherwise(count)
