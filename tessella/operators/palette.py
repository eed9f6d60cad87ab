"""Palettes: k-means over the colours of dots or pixels, quantisation, error diffusion."""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.assign import nearest_color
from tessella.sources.scratch import cut_lineage

ROUNDS = 10  # fixed value: at most so many rounds


def initial_centers(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The rows at even distances in ``order``, as first centres ``(img_id, palette_id, r, g, b)``; null images apart."""
    place = F.row_number().over(Window.partitionBy("img_id").orderBy(*order)) - 1
    count = rows.groupBy("img_id").agg(F.count("*").alias("n_rows"))
    at = rows.withColumn("place", place).join(count, "img_id").withColumn("step", F.greatest(F.floor(F.col("n_rows") / n), F.lit(1)))
    ids = at.where((F.col("place") % F.col("step") == 0) & (F.floor(F.col("place") / F.col("step")) < n))
    return ids.select("img_id", F.floor(F.col("place") / F.col("step")).cast("int").alias("palette_id"), *(F.col(c).cast("double").alias(c) for c in "rgb"))


def step(colors: DataFrame, centers: DataFrame) -> DataFrame:
    """Centres moved to the mean of the colours nearest to them; ``colors`` has a ``n`` of equal ones. Empty ones stay."""
    near = nearest_color(colors, centers)
    mean = near.groupBy("img_id", "palette_id").agg(F.sum("n").alias("m"), *((F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(f"n{c}") for c in "rgb"))
    return centers.join(mean, ["img_id", "palette_id"], "left").select("img_id", "palette_id", *(F.coalesce(f"n{c}", c).alias(c) for c in "rgb"))


def refine(colors: DataFrame, centers: DataFrame, still: float, rounds: int = ROUNDS) -> DataFrame:
    """Rounds until no centre's squared shift is over ``still``. Equal colours are counted once and weighted, so a round
    sees the different colours of an image and not its pixels."""
    colors = cut_lineage(colors.groupBy("img_id", "r", "g", "b").agg(F.count("*").alias("n")))
    centers = cut_lineage(centers)
    for _ in range(rounds):
        moved = cut_lineage(step(colors, centers))
        old = centers.select("img_id", "palette_id", *(F.col(c).alias(f"o{c}") for c in "rgb"))
        shift = sum((F.pow(F.col(c) - F.col(f"o{c}"), F.lit(2.0)) for c in "rgb"), F.lit(0.0))
        far = moved.join(old, ["img_id", "palette_id"]).where(shift > still)
        centers = moved
        if not far.head(1):
            break
    return centers


def truncated(centers: DataFrame) -> DataFrame:
    return centers.withColumns({c: F.col(c).cast("int") for c in "rgb"})


def palette_of_dots(dots: DataFrame, n: int, rounds: int = ROUNDS) -> DataFrame:
    """``n`` colours for the dots of each image; images of ``n`` dots or fewer have no palette."""
    many = dots.groupBy("img_id").agg(F.count("*").alias("k")).where(F.col("k") > n).select("img_id")
    dots = dots.join(many, "img_id", "left_semi")
    return truncated(refine(dots, initial_centers(dots, n, ["dot_id"]), 0.5, rounds))


def dominant_colors(px: DataFrame, n: int, rounds: int = ROUNDS) -> DataFrame:
    """``n`` colours for the pixels of each image. First centres lie at even distances in rows of pixels: a pixel's number
    is computed from its place, so nothing is sorted."""
    place = F.col("y").cast("long") * F.col("w") + F.col("x")
    total = F.col("w").cast("long") * F.col("h")
    step_ = F.greatest(F.floor(total / n), F.lit(1))
    slots = F.filter(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.alias("palette_id"), F.least(i * step_, total - 1).alias("at"))), lambda s: s["at"] == place)
    first = px.withColumn("slot", F.explode(slots)).select("img_id", F.col("slot.palette_id").alias("palette_id"), *(F.col(c).cast("double").alias(c) for c in "rgb"))
    return truncated(refine(px.select("img_id", "r", "g", "b"), first, 1.0, rounds))


def quantize_dots(dots: DataFrame, n: int, rounds: int = ROUNDS) -> DataFrame:
    """Dots in their nearest palette colour; unchanged in images of ``n`` dots or fewer."""
    palette = palette_of_dots(dots, n, rounds)
    near = nearest_color(dots, palette).drop("palette_id", "d2").withColumns({c: F.col(f"p{c}") for c in "rgb"}).drop("pr", "pg", "pb")
    rest = dots.join(palette.select("img_id").distinct(), "img_id", "left_anti")
    return near.unionByName(rest)


def diffuse(px: DataFrame, palette: DataFrame) -> DataFrame:
    """Floyd-Steinberg error diffusion to the palette, row by row from the left. Each pixel depends on the ones before
    it, so an image is one task; images run side by side. Pixels of one x + 2 y do not depend on one another and are one
    step. An image with fewer than two colours stays as it is."""
    import numpy as np
    import pandas as pd

    def run(key, pix: pd.DataFrame, pal: pd.DataFrame) -> pd.DataFrame:
        if not len(pix) or len(pal) < 2:
            return pix
        pix = pix.sort_values(["y", "x"])
        w, h = int(pix["x"].max()) + 1, int(pix["y"].max()) + 1
        buf = np.zeros((h + 1, w + 2, 3), np.float32)
        buf[:h, 1 : w + 1] = pix[["r", "g", "b"]].to_numpy().reshape(h, w, 3)
        colors = pal.sort_values("palette_id")[["r", "g", "b"]].to_numpy(np.float32)
        out = np.empty((h, w, 3), np.int32)
        for step in range(w + 2 * (h - 1)):
            y = np.arange(max(0, (step - w + 2) // 2), min(h - 1, step // 2) + 1)
            x = step - 2 * y + 1
            old = buf[y, x]
            new = colors[((colors - old[:, None]) ** 2).sum(2).argmin(1)]
            err = (old - new) / np.float32(16)
            out[y, x - 1] = new
            buf[y + 1, x - 1] += err * 3  # in the order in which a walk along rows would add them
            buf[y, x + 1] += err * 7
            buf[y + 1, x] += err * 5
            buf[y + 1, x + 1] += err
        return pix.assign(r=out[..., 0].ravel(), g=out[..., 1].ravel(), b=out[..., 2].ravel())

    palette = palette.toDF(*palette.columns)  # columns of its own: both sides may come from one table
    return px.groupBy("img_id").cogroup(palette.groupBy("img_id")).applyInPandas(run, px.schema)
