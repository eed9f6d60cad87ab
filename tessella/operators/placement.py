"""Dots from pixels: grid cells, k-means, weighted Lloyd relaxation, quadtree."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.color import luminance
from tessella.functions.geometry import dot_radius
from tessella.operators import assign
from tessella.operators.sampling import importance_sample
from tessella.params import Params
from tessella.sources.scratch import cut_lineage

Progress = Callable[[int, int], None]
Show = Callable[[int, int, DataFrame], None]


class Cancelled(RuntimeError):
    """The caller asked to stop."""


def _numbered(dots: DataFrame, *order: str) -> DataFrame:
    """``dots`` with ``dot_id``, from 0 within an image."""
    by = Window.partitionBy("img_id").orderBy(*order)
    return dots.withColumn("dot_id", (F.row_number().over(by) - 1).cast("long"))


DOT = ("img_id", "dot_id", "x", "y", "r", "g", "b", "radius")


def grid_dots(px: DataFrame, p: Params) -> DataFrame:
    """One dot for each square cell; pixels to the right of and below the last whole cell have none. Rotated, cells stay
    where they are and only the dots turn around the middle of the image."""
    cell = F.greatest(F.floor(F.col("w") / p.cols), F.lit(1))
    at = px.withColumn("cell", cell).withColumns({"i": F.floor(F.col("x") / F.col("cell")), "j": F.floor(F.col("y") / F.col("cell"))})
    at = at.where((F.col("i") < F.floor(F.col("w") / F.col("cell"))) & (F.col("j") < F.floor(F.col("h") / F.col("cell"))))
    sums = {c: F.sum(F.col(c).cast("long")) for c in "rgb"}
    g = at.groupBy("img_id", "w", "h", "cell", "i", "j").agg(*(v.alias(f"s{c}") for c, v in sums.items()), F.count("*").alias("n"), F.avg("density").alias("d"))
    g = g.withColumns({c: F.floor(F.col(f"s{c}") / F.col("n")).cast("int") for c in "rgb"})
    radius = F.least(dot_radius(luminance(), F.col("d"), F.least("w", "h").cast("double"), p), F.col("cell") * 0.4)
    g = g.withColumns({"cx": (F.col("i") * F.col("cell") + F.col("cell") / 2).cast("double"), "cy": (F.col("j") * F.col("cell") + F.col("cell") / 2).cast("double"), "radius": radius})
    if abs(p.grid_angle_deg) > 1e-6:
        c, s = math.cos(math.radians(p.grid_angle_deg)), math.sin(math.radians(p.grid_angle_deg))
        dx, dy = F.col("cx") - F.col("w") / 2, F.col("cy") - F.col("h") / 2
        g = g.withColumns({"x": F.col("w") / 2 + dx * c - dy * s, "y": F.col("h") / 2 + dx * s + dy * c})
    else:
        g = g.withColumns({"x": F.col("cx"), "y": F.col("cy")})
    return _numbered(g, "j", "i").select(*DOT)


def _packed(px: DataFrame) -> DataFrame:
    """Pixels as tiles; loops pack them once and hand them on."""
    return px if "bytes" in px.columns else assign.tiles(px)


def dots_from_seeds(px: DataFrame, seeds: DataFrame, p: Params) -> DataFrame:
    """A dot for each seed that has pixels: their mean colour, a radius from their mean density, limited by the nearest
    seed. ``px`` are pixels or tiles."""
    sums = assign.tiled_sums(_packed(px), seeds.withColumnRenamed("seed_id", "center_id"), _middle, lambda f: np.stack([f[c] for c in ("r", "g", "b", "density")], 1), ["sr", "sg", "sb", "sd"])
    sums = sums.withColumnRenamed("center_id", "seed_id").withColumn("d", F.col("sd") / F.col("n")).join(px.select("img_id", "w", "h").distinct(), "img_id")
    g = sums.join(assign.nn_radius(seeds), ["img_id", "seed_id"]).withColumns({c: F.floor(F.col(f"s{c}") / F.col("n")).cast("int") for c in "rgb"})
    radius = F.least(dot_radius(luminance(), F.col("d"), F.least("w", "h").cast("double"), p), F.col("nn") * 0.8)
    return _numbered(g.withColumn("radius", radius), "seed_id").select(*DOT)


def _middle(f, pixels: bool):
    """Where a pixel has its middle; seeds are where they are."""
    return np.stack([f["x"], f["y"]], 1) + (0.5 if pixels else 0.0)


def _scaled(f, pixels: bool):
    """Place and colour, each from 0 to 1."""
    return np.stack([f["x"] / f["w"], f["y"] / f["h"], f["r"] / 255.0, f["g"] / 255.0, f["b"] / 255.0], 1)


def lloyd_step(px: DataFrame, seeds: DataFrame, sensitivity: float) -> DataFrame:
    """Seeds moved to the weighted middle of their pixels, weight density ** (1 + 3 * sensitivity); a seed without
    weight stays. ``px`` are pixels or tiles."""
    power = 1.0 + 3.0 * sensitivity

    def sums(f):
        w = np.power(f["density"], power)
        return np.stack([w * (f["x"] + 0.5), w * (f["y"] + 0.5), w], 1)

    moved = assign.tiled_sums(_packed(px), seeds.withColumnRenamed("seed_id", "center_id"), _middle, sums, ["wx", "wy", "ws"])
    moved = moved.where("ws > 0").select("img_id", F.col("center_id").alias("seed_id"), (F.col("wx") / F.col("ws")).alias("nx"), (F.col("wy") / F.col("ws")).alias("ny"))
    return seeds.join(moved, ["img_id", "seed_id"], "left").select("img_id", "seed_id", F.coalesce("nx", "x").alias("x"), F.coalesce("ny", "y").alias("y"))


def kmeans_step(px: DataFrame, centers: DataFrame) -> DataFrame:
    """Centres moved to the mean place and colour of their pixels; an empty one stays. ``px`` are pixels or tiles."""
    cols = ["x", "y", "r", "g", "b"]
    moved = assign.tiled_sums(_packed(px), centers, _scaled, lambda f: np.stack([f[c] for c in cols], 1), [f"s{c}" for c in cols])
    moved = moved.select("img_id", "center_id", *((F.col(f"s{c}") / F.col("n")).alias(f"n{c}") for c in cols))
    return centers.join(moved, ["img_id", "center_id"], "left").select("img_id", "center_id", *(F.coalesce(f"n{c}", c).alias(c) for c in cols))


def _loop(state: DataFrame, step, p: Params, progress: Progress | None, cancelled: Callable[[], bool] | None, show: Show | None, dots) -> DataFrame:
    """State is a row for each point; it is written after each round, so plans do not grow and a lost executor costs
    one round at most. ``show`` is told the dots of each round, which are only computed if it uses them."""
    for i in range(p.iterations):
        if cancelled and cancelled():
            raise Cancelled("cancelled")
        state = cut_lineage(step(state))
        if progress:
            progress(i + 1, p.iterations)
        if show:
            show(i + 1, p.iterations, dots(state))
    return state


def voronoi_seeds(px: DataFrame, p: Params) -> DataFrame:
    at = importance_sample(px, p.num_points, p.rng_seed)
    return at.select("img_id", F.col("sample_id").cast("long").alias("seed_id"), (F.col("x") + 0.5).alias("x"), (F.col("y") + 0.5).alias("y"))


def voronoi_dots(px: DataFrame, p: Params, progress: Progress | None = None, cancelled=None, show: Show | None = None) -> DataFrame:
    seeds = cut_lineage(voronoi_seeds(px, p))
    packed = cut_lineage(assign.tiles(px))
    seeds = _loop(seeds, lambda s: lloyd_step(packed, s, p.variance_sensitivity), p, progress, cancelled, show, lambda s: dots_from_seeds(packed, s, p))
    return dots_from_seeds(packed, seeds, p)


def kmeans_centers(px: DataFrame, p: Params) -> DataFrame:
    at = importance_sample(px, p.num_points, p.rng_seed)
    return at.join(px, ["img_id", "x", "y"]).select("img_id", F.col("sample_id").cast("long").alias("center_id"), *(F.col(c).cast("double").alias(c) for c in ("x", "y", "r", "g", "b")))


def dots_from_centers(px: DataFrame, centers: DataFrame, p: Params) -> DataFrame:
    """Centres on the canvas, with their colour truncated and the density of the pixel they are on."""
    at = centers.select("img_id", "center_id", F.col("x").alias("cx"), F.col("y").alias("cy"), *(F.col(c).cast("int").alias(f"c{c}") for c in "rgb"), F.floor("x").cast("int").alias("x"), F.floor("y").cast("int").alias("y"))
    got = at.join(px.select("img_id", "w", "h", "x", "y", "density"), ["img_id", "x", "y"])
    radius = dot_radius(luminance("cr", "cg", "cb"), F.col("density"), F.least("w", "h").cast("double"), p)
    got = got.select("img_id", "center_id", F.col("cx").alias("x"), F.col("cy").alias("y"), *(F.col(f"c{c}").alias(c) for c in "rgb"), radius.alias("radius"))
    return _numbered(got, "center_id").select(*DOT)


def kmeans_dots(px: DataFrame, p: Params, progress: Progress | None = None, cancelled=None, show: Show | None = None) -> DataFrame:
    packed = cut_lineage(assign.tiles(px))
    centers = _loop(cut_lineage(kmeans_centers(px, p)), lambda c: kmeans_step(packed, c), p, progress, cancelled, show, lambda c: dots_from_centers(px, c, p))
    return dots_from_centers(px, centers, p)


def quadtree_leaves(px: DataFrame, p: Params) -> DataFrame:
    """``(img_id, w, h, path, x0, y0, nw, nh, r, g, b, variance)``: rectangles split in four until they are even or small.

    Where a rectangle splits follows from the image's size alone, so a pixel knows its smallest rectangle at once. Sums
    are taken over these and then added up for all rectangles around them; leaves are the rectangles that are even or
    small and lie in no other such. Paths of digits 0 to 3 sort as the tree is walked.
    """
    threshold = 800.0 * (1.0 - 0.8 * p.variance_sensitivity)
    smallest = F.greatest(F.floor(F.floor(F.sqrt(F.col("w") * F.col("h") / F.lit(float(p.num_points)))) / 2), F.lit(2)).cast("int")
    whole = F.struct(F.lit("").alias("path"), F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.col("w").alias("nw"), F.col("h").alias("nh"))

    def small(n) -> Column:
        return (n["nw"] <= F.col("smallest")) | (n["nh"] <= F.col("smallest"))

    def part(n, east: Column, south: Column) -> Column:
        half_w, half_h = F.floor(n["nw"] / 2).cast("int"), F.floor(n["nh"] / 2).cast("int")
        digit = F.when(south, 2).otherwise(0) + F.when(east, 1).otherwise(0)
        return F.struct(
            F.concat(n["path"], digit.cast("string")).alias("path"), F.when(east, n["x0"] + half_w).otherwise(n["x0"]).alias("x0"), F.when(south, n["y0"] + half_h).otherwise(n["y0"]).alias("y0"),
            F.when(east, n["nw"] - half_w).otherwise(half_w).alias("nw"), F.when(south, n["nh"] - half_h).otherwise(half_h).alias("nh"),
        )

    def towards_pixel(n, _) -> Column:
        east, south = F.col("x") >= n["x0"] + F.floor(n["nw"] / 2), F.col("y") >= n["y0"] + F.floor(n["nh"] / 2)
        return F.when(small(n), n).otherwise(part(n, east, south))

    def along_path(n, i) -> Column:
        digit = F.substring(F.col("path"), i, F.lit(1)).cast("int")
        return part(n, digit % 2 == 1, digit >= 2)

    at = px.withColumn("smallest", smallest)
    deep = at.withColumn("path", F.aggregate(F.sequence(F.lit(1), F.lit(16)), whole, towards_pixel)["path"])  # sides are below 2 ** 16
    values = {"n": F.count("*")} | {f"s{c}": F.sum(F.col(c).cast("long")) for c in "rgb"} | {f"q{c}": F.sum((F.col(c) * F.col(c)).cast("long")) for c in "rgb"}
    keys = ["img_id", "w", "h", "smallest"]
    ends = deep.groupBy(*keys, "path").agg(*(v.alias(k) for k, v in values.items()))
    around = ends.withColumn("depth", F.explode(F.sequence(F.lit(0), F.length("path")))).withColumn("path", F.substring("path", F.lit(1), F.col("depth")))
    node = around.groupBy(*keys, "path").agg(*(F.sum(k).alias(k) for k in values))
    steps = F.when(F.length("path") > 0, F.sequence(F.lit(1), F.length("path"))).otherwise(F.expr("cast(array() as array<int>)"))
    node = node.withColumn("at", F.aggregate(steps, whole, along_path)).withColumns({c: F.floor(F.col(f"s{c}") / F.col("n")).cast("int") for c in "rgb"})
    far = [F.col(f"q{c}") - F.col(c) * F.col(f"s{c}") * 2 + F.col("n") * F.col(c) * F.col(c) for c in "rgb"]
    node = node.withColumn("variance", (far[0] + far[1] + far[2]).cast("double") / F.col("n"))
    even = cut_lineage(node.where(small(F.col("at")) | (F.col("variance") < threshold)).select("img_id", "w", "h", "path", "at.x0", "at.y0", "at.nw", "at.nh", "r", "g", "b", "variance"))
    above = even.where(F.length("path") > 0).select("img_id", "path", F.explode(F.transform(F.sequence(F.lit(0), F.length("path") - 1), lambda i: F.substring(F.col("path"), F.lit(1), i))).alias("outer"))
    outer = even.select(F.col("img_id").alias("o"), F.col("path").alias("outer"))
    covered = above.join(outer, (F.col("img_id") == F.col("o")) & (above["outer"] == outer["outer"]), "left_semi").select("img_id", "path").distinct()
    return even.join(covered, ["img_id", "path"], "left_anti").select(*even.columns)


def quadtree_dots(px: DataFrame, p: Params) -> DataFrame:
    leaves = quadtree_leaves(px, p)
    side = F.least("w", "h").cast("double")
    detail = F.least(F.least("nw", "nh") / side, F.lit(1.0))
    radius = F.greatest(dot_radius(luminance(), detail, side, p), F.lit(1.0))
    dots = leaves.select("img_id", "path", (F.col("x0") + F.col("nw") / 2.0).alias("x"), (F.col("y0") + F.col("nh") / 2.0).alias("y"), "r", "g", "b", radius.alias("radius"))
    return _numbered(dots, "path").select(*DOT)
