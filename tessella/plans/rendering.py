"""From pixels to dots to output, for all images of a pixel relation at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.color import linear_to_srgb, over, srgb_to_linear
from tessella.operators import halftone, palette, placement, raster, svg
from tessella.operators.density import density_gray, density_map
from tessella.params import Params
from tessella.sources.scratch import cut_lineage


def sizes(px: DataFrame) -> DataFrame:
    return px.select("img_id", "w", "h").distinct()


def flatten(px: DataFrame, bg: tuple[int, int, int]) -> DataFrame:
    """Pixels without ``a``, laid over the background."""
    if "a" not in px.columns:
        return px
    return px.withColumns({c: over(c, "a", v) for c, v in zip("rgb", bg, strict=True)}).drop("a")


def _linear(px: DataFrame, p: Params) -> tuple[DataFrame, Params]:
    spark = px.sparkSession
    bg = spark.range(1).select(*(srgb_to_linear(F.lit(v)) for v in p.bg_color)).first()
    return px.withColumns({c: srgb_to_linear(c) for c in "rgb"}), replace(p, bg_color=tuple(bg), gamma_correct=False)


def _encoded(px: DataFrame) -> DataFrame:
    return px.withColumns({c: linear_to_srgb(c) for c in "rgb"})


def _is_halftone(p: Params) -> bool:
    return p.algorithm == "halftone"


def checked(px: DataFrame, p: Params) -> Params:
    """Parameters against the images; every entry point checks."""
    p.validate()
    if _is_halftone(p) and p.halftone.mode == "off":
        raise ValueError("the halftone algorithm needs a halftone mode")
    for r in sizes(px).agg(F.max("w").alias("w"), F.max("h").alias("h"), F.min("w").alias("lw"), F.min("h").alias("lh")).collect():
        if r.w is None:
            raise ValueError("there is no image")
        p.validate(r.w, r.h)
        p.validate(r.lw, r.lh)
    return p


def compute_dots(px: DataFrame, p: Params, progress=None, cancelled: Callable[[], bool] | None = None, show: placement.Show | None = None) -> DataFrame:
    """``(img_id, dot_id, x, y, r, g, b, radius)``. ``progress`` is told the number of each round and of all, ``show`` the
    round's rendered pixels too."""
    checked(px, p)
    if cancelled and cancelled():
        raise placement.Cancelled("cancelled")
    if p.gamma_correct:
        lin, q = _linear(px, p)
        return _encoded(compute_dots(lin, q, progress, cancelled, show and (lambda i, n, image: show(i, n, _encoded(image)))))
    if _is_halftone(p):
        dots = halftone.halftone_dots(px, p)
    else:
        px = cut_lineage(density_map(px, p.variance_sensitivity))
        if p.algorithm == "grid":
            dots = placement.grid_dots(px, p)
        elif p.algorithm == "quadtree":
            dots = placement.quadtree_dots(px, p)
        else:
            drawn = show and (lambda i, n, dots: show(i, n, raster.render(dots, sizes(px), p.dot_shape, p.bg_color)))
            return {"voronoi": placement.voronoi_dots, "kmeans": placement.kmeans_dots}[p.algorithm](px, p, progress, cancelled, drawn)
    if progress:
        progress(1, 1)
    if show:
        show(1, 1, raster.render(dots, sizes(px), p.dot_shape, p.bg_color))
    return dots


def apply(px: DataFrame, p: Params, progress=None, cancelled=None, show=None) -> DataFrame:
    """Rendered pixels. Halftone multiplies inks; else dots are laid over the background, in palette colours or diffused
    to them if that is asked for."""
    checked(px, p)
    if p.gamma_correct:
        lin, q = _linear(px, p)
        return _encoded(apply(lin, q, progress, cancelled, show and (lambda i, n, image: show(i, n, _encoded(image)))))
    dots = cut_lineage(compute_dots(px, p, progress, cancelled, show))
    at = sizes(px)
    if _is_halftone(p):
        return raster.render_multiply(dots, at, p.dot_shape, p.bg_color, p.transparent).drop("a")
    if p.palette_size is None:
        return raster.render(dots, at, p.dot_shape, p.bg_color)
    if p.dithering:
        colors = palette.palette_of_dots(dots, p.palette_size)
        return palette.diffuse(raster.render(dots, at, p.dot_shape, p.bg_color), colors)
    return raster.render(palette.quantize_dots(dots, p.palette_size), at, p.dot_shape, p.bg_color)


def apply_rgba(px: DataFrame, p: Params) -> DataFrame:
    """The same with opacity; never diffused."""
    checked(px, p)
    if p.gamma_correct:
        lin, q = _linear(px, p)
        return _encoded(apply_rgba(lin, q))
    dots = cut_lineage(compute_dots(px, p))
    if _is_halftone(p):
        return raster.render_multiply(dots, sizes(px), p.dot_shape, p.bg_color, p.transparent)
    if p.palette_size is not None:
        dots = palette.quantize_dots(dots, p.palette_size)
    return raster.render_rgba(dots, sizes(px), p.dot_shape, p.bg_color, p.transparent)


def apply_dynamic(px: DataFrame, p: Params) -> DataFrame:
    return apply(flatten(px, p.bg_color), p)


def density_image(px: DataFrame, sensitivity: float) -> DataFrame:
    return density_gray(density_map(px, sensitivity)).select("img_id", "w", "h", "x", "y", "v")


def render_svg(px: DataFrame, p: Params, dots: DataFrame | None = None) -> DataFrame:
    """``(img_id, place, element)`` lines of an SVG document for each image."""
    checked(px, p)
    dots = compute_dots(px, p) if dots is None else dots
    if p.palette_size is not None:
        dots = palette.quantize_dots(cut_lineage(dots), p.palette_size)
    return svg.svg_lines(dots, sizes(px), p.dot_shape, p.bg_color, p.transparent)


def render_svg_dynamic(px: DataFrame, p: Params) -> DataFrame:
    return render_svg(flatten(px, p.bg_color), p)
