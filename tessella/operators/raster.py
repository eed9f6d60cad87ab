"""Dots to pixels: coverage, painter's order, compositing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.geometry import coverage, inside, reach
from tessella.params import Shape

TILE = 64  # pixels along a side of what one task draws at a time


def dot_coverage(dots: DataFrame, sizes: DataFrame, shape: Shape) -> DataFrame:
    """A row for each pixel that a dot covers, with ``cov`` in sixteenths. ``sizes(img_id, w, h)``; the canvas bounds the
    listed pixels of a dot, so nothing outside is made and then dropped."""
    d = dots.where("radius > 0").join(sizes, "img_id").withColumn("reach", reach(shape, F.col("radius")))
    span = lambda c, side: F.sequence(F.greatest(F.ceil(F.col(c) - F.col("reach")), F.lit(0)).cast("int"), F.least(F.floor(F.col(c) + F.col("reach")), F.col(side) - 1).cast("int"))
    on = (F.col("x") + F.col("reach") >= 0) & (F.col("x") - F.col("reach") <= F.col("w") - 1) & (F.col("y") + F.col("reach") >= 0) & (F.col("y") - F.col("reach") <= F.col("h") - 1)
    at = d.where(on).withColumn("py", F.explode(span("y", "h"))).withColumn("px", F.explode(span("x", "w")))
    cov = coverage(F.col("px"), F.col("py"), F.col("x"), F.col("y"), inside(shape, F.col("radius")))
    return at.withColumn("cov", cov.cast("int")).where("cov > 0")


def painter_order(dots: DataFrame) -> DataFrame:
    """``dots`` with ``place``: large ones first, ties by number."""
    from pyspark.sql import Window

    return dots.withColumn("place", F.row_number().over(Window.partitionBy("img_id").orderBy(F.desc("radius"), "dot_id")))


def _numpy_inside(shape: Shape, r: float, x, y):
    """The same tests as ``geometry.inside``, for arrays of offsets."""
    import math

    import numpy as np

    if shape.kind == "circle":
        return x * x + y * y <= r * r
    if shape.kind == "square":
        return (np.abs(x) <= r) & (np.abs(y) <= r)
    if shape.kind == "ellipse":
        minor = max(r / max(shape.aspect, 0.01), 1.0)
        c, s = math.cos(math.radians(shape.angle_deg)), math.sin(math.radians(shape.angle_deg))
        return ((x * c + y * s) / r) ** 2 + ((y * c - x * s) / minor) ** 2 <= 1.0
    n = max(shape.sides, 3)
    sector = 2 * math.pi / n
    d = np.sqrt(x * x + y * y)
    turn = np.mod(np.arctan2(y, x), sector) - sector / 2
    return (d <= r) & ((d == 0) | (d <= r * math.cos(math.pi / n) / np.abs(np.cos(turn))))


def _covered(shape: Shape, r: float, x, y):
    """Sixteenths of the pixels whose left and upper edges have offsets ``x`` and ``y`` from the dot."""
    import numpy as np

    def test(steps):
        gx = (x[:, None] + steps).ravel()
        gy = (y[:, None] + steps).ravel()
        n = len(steps)
        return _numpy_inside(shape, r, gx[None, :], gy[:, None]).reshape(len(y), n, len(x), n)

    corner = test(np.array([0.0, 1.0]))
    middle = test(np.array([0.5]))[:, 0, :, 0]
    count = test((np.arange(4) + 0.5) / 4).sum((1, 3))
    return np.where(corner.all((1, 3)), 16, np.where(corner.any((1, 3)) | middle, count, 0))


def _painted(dots: DataFrame, sizes: DataFrame, shape: Shape, start: tuple[int, ...], blend, by_size: bool) -> DataFrame:
    """Pixels of all images, dots laid on one by one. Dots meet tiles of ``TILE`` by ``TILE`` pixels, so what is shuffled
    is dots, times the few tiles that each touches, and no pixels; a tile is drawn with arrays."""
    import numpy as np
    import pandas as pd

    names = list("rgba")[: len(start)]
    span = lambda lo, hi: F.sequence(F.floor(lo / TILE).cast("int"), F.floor(hi / TILE).cast("int"))
    tiles = sizes.withColumn("ty", F.explode(span(F.lit(0), F.col("h") - 1))).withColumn("tx", F.explode(span(F.lit(0), F.col("w") - 1)))
    d = dots.where("radius > 0").join(sizes, "img_id").withColumn("reach", reach(shape, F.col("radius")))
    low = lambda c: F.greatest(F.ceil(F.col(c) - F.col("reach")), F.lit(0))
    high = lambda c, side: F.least(F.floor(F.col(c) + F.col("reach")), F.col(side) - 1)
    d = d.withColumns({"x0": low("x"), "x1": high("x", "w"), "y0": low("y"), "y1": high("y", "h")}).where("x0 <= x1 and y0 <= y1")
    d = d.withColumn("ty", F.explode(span(F.col("y0"), F.col("y1")))).withColumn("tx", F.explode(span(F.col("x0"), F.col("x1"))))
    d = d.select("img_id", "tx", "ty", "dot_id", "x", "y", "r", "g", "b", "radius", "x0", "x1", "y0", "y1")

    def run(tile: pd.DataFrame, on: pd.DataFrame) -> pd.DataFrame:
        if not len(tile):
            return pd.DataFrame({c: [] for c in ("img_id", "w", "h", "x", "y", *names)})
        t = tile.iloc[0]
        left, top = int(t["tx"]) * TILE, int(t["ty"]) * TILE
        cols, rows = min(TILE, int(t["w"]) - left), min(TILE, int(t["h"]) - top)
        out = np.empty((rows, cols, len(start)), np.int64)
        out[:] = start
        on = on.assign(size=-on["radius"]).sort_values(["size", "dot_id"] if by_size else ["dot_id"])
        for cx, cy, r, g, b, radius, x0, x1, y0, y1 in on[["x", "y", "r", "g", "b", "radius", "x0", "x1", "y0", "y1"]].itertuples(index=False):
            xs, ys = np.arange(max(x0, left), min(x1, left + cols - 1) + 1), np.arange(max(y0, top), min(y1, top + rows - 1) + 1)
            if not len(xs) or not len(ys):
                continue
            cov = _covered(shape, radius, xs - 0.5 - cx, ys - 0.5 - cy)
            part = out[ys[0] - top : ys[-1] - top + 1, xs[0] - left : xs[-1] - left + 1]
            part[:] = np.where(cov[..., None] > 0, blend(part, cov, np.array([r, g, b])), part)
        y, x = np.indices((rows, cols))
        got = {"img_id": t["img_id"], "w": int(t["w"]), "h": int(t["h"]), "x": x.ravel() + left, "y": y.ravel() + top}
        return pd.DataFrame(got | {c: out[..., i].ravel() for i, c in enumerate(names)})

    schema = "img_id string, w int, h int, x int, y int, " + ", ".join(f"{c} int" for c in names)
    d = d.toDF(*d.columns)  # columns of its own: both sides may come from one table
    return tiles.groupBy("img_id", "tx", "ty").cogroup(d.groupBy("img_id", "tx", "ty")).applyInPandas(run, schema)


def render(dots: DataFrame, sizes: DataFrame, shape: Shape, bg: tuple[int, int, int]) -> DataFrame:
    """Pixels ``(img_id, w, h, x, y, r, g, b)``: dots laid over the background one by one, rounded after each."""
    import numpy as np

    def blend(a, cov, c):
        part = cov[..., None] / 16.0
        return np.where(part == 1, c, np.minimum(np.floor(a * (1.0 - part) + c * part + 0.5), 255))

    return _painted(dots, sizes, shape, bg, blend, True)


def render_rgba(dots: DataFrame, sizes: DataFrame, shape: Shape, bg: tuple[int, int, int], transparent: bool) -> DataFrame:
    """The same with ``a``: on a transparent background dots keep their colour and only add opacity."""
    import numpy as np

    def blend(a, cov, c):
        src, dst = cov / 16.0, a[..., 3] / 255.0
        alpha = src + dst * (1.0 - src)
        with np.errstate(invalid="ignore", divide="ignore"):  # places that the dot does not touch
            mixed = np.floor((c * src[..., None] + a[..., :3] * dst[..., None] * (1.0 - src[..., None])) / alpha[..., None] + 0.5)
        color = np.where(src[..., None] == 1, c, np.minimum(np.nan_to_num(mixed), 255))
        return np.concatenate([color, np.where(src == 1, 255, np.minimum(np.floor(alpha * 255.0 + 0.5), 255))[..., None]], 2)

    return _painted(dots, sizes, shape, (*bg, 0 if transparent else 255), blend, True)


def render_multiply(dots: DataFrame, sizes: DataFrame, shape: Shape, paper: tuple[int, int, int], transparent: bool) -> DataFrame:
    """Inks multiplied onto paper in the order of their numbers; a transparent paper is white without opacity."""
    import numpy as np

    def blend(a, cov, c):
        part = cov[..., None] / 16.0
        some = np.minimum(np.floor(a[..., :3] * (1.0 - part + part * (c / 255.0)) + 0.5), 255)
        color = np.where(part == 1, a[..., :3] * c // 255, some)
        return np.concatenate([color, np.full((*cov.shape, 1), 255)], 2)

    return _painted(dots, sizes, shape, (*((255, 255, 255) if transparent else paper), 0 if transparent else 255), blend, False)


def _byte(v: Column) -> Column:
    return F.least(F.floor(v), F.lit(255)).cast("int")


def downscale(px: DataFrame, max_w: int, max_h: int) -> DataFrame:
    """Images that do not fit shrunk to fit, by a triangle filter along rows and then along columns."""
    fits = (F.col("w") <= max_w) & (F.col("h") <= max_h)
    scale = F.least(F.lit(float(max_w)) / F.col("w"), F.lit(float(max_h)) / F.col("h"))
    new = lambda side: F.greatest(F.floor(F.col(side) * scale + 0.5), F.lit(1)).cast("int")
    large = px.where(~fits).withColumns({"nw": new("w"), "nh": new("h")})

    def along(df: DataFrame, axis: str, side: str, new_side: str, keep: list[str]) -> DataFrame:
        ratio = F.col(side) / F.col(new_side)
        # target t looks at sources within ratio of its middle; a source lists the targets that look at it
        mid = F.col(axis) + 0.5
        low = F.greatest(F.ceil((mid - ratio) / ratio - 0.5), F.lit(0))
        high = F.least(F.floor((mid + ratio) / ratio - 0.5), F.col(new_side) - 1)
        at = df.withColumn("ratio", ratio).withColumn("t", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
        weight = F.lit(1.0) - F.abs(mid - (F.col("t") + 0.5) * F.col("ratio")) / F.col("ratio")
        at = at.withColumn("weight", weight).where("weight > 0")
        return at.groupBy("img_id", "w", "h", "nw", "nh", *keep, F.col("t").alias(axis)).agg(*((F.sum(F.col(c) * F.col("weight")) / F.sum("weight")).alias(c) for c in "rgb"))

    small = along(along(large, "x", "w", "nw", ["y"]), "y", "h", "nh", ["x"])
    small = small.select("img_id", F.col("nw").alias("w"), F.col("nh").alias("h"), "x", "y", *(_byte(F.greatest(F.col(c) + 0.5, F.lit(0.0))).alias(c) for c in "rgb"))
    return px.where(fits).select("img_id", "w", "h", "x", "y", "r", "g", "b").unionByName(small)
