"""Neighbourhood operators on pixels: local variance, detail, prefix sums, disk means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REACH = 4  # fixed value: windows have 9 by 9 pixels


def local_variance(px: DataFrame, reach: int = REACH) -> DataFrame:
    """``px`` with ``variance``: mean over the channels of the variance in the window around a pixel, which shrinks at
    the borders. Sums are taken along rows and then along columns, so a pixel is touched twice and not 81 times."""
    across = Window.partitionBy("img_id", "y").orderBy("x").rangeBetween(-reach, reach)
    down = Window.partitionBy("img_id", "x").orderBy("y").rangeBetween(-reach, reach)
    wide = {"n_": F.count(F.lit(1)).over(across)}
    for c in "rgb":
        wide[f"{c}_1"] = F.sum(F.col(c).cast("long")).over(across)
        wide[f"{c}_2"] = F.sum((F.col(c) * F.col(c)).cast("long")).over(across)
    rows = px.withColumns(wide)
    whole = rows.withColumns({k: F.sum(k).over(down) for k in wide})
    return whole.withColumn("variance", _variance()).drop(*wide)


def _variance() -> Column:
    n = F.col("n_").cast("double")
    each = [F.greatest(F.col(f"{c}_2") / n - F.pow(F.col(f"{c}_1") / n, F.lit(2.0)), F.lit(0.0)) for c in "rgb"]
    return (each[0] + each[1] + each[2]) / F.lit(3.0)


def local_variance_clamped(px: DataFrame, reach: int = REACH) -> DataFrame:
    """``(img_id, x, y, variance)`` where places outside the image repeat its border, so every window has all places."""
    sums = [f"{c}_{k}" for c in "rgb" for k in (1, 2)]
    start = px.select("img_id", "w", "h", "x", "y", *(F.col(c).cast("long").alias(f"{c}_1") for c in "rgb"), *((F.col(c) * F.col(c)).cast("long").alias(f"{c}_2") for c in "rgb"))
    across = spread_axis(start, "x", "w", ["y", *sums], reach)
    across = across.groupBy("img_id", "w", "h", "y", F.col("to").alias("x")).agg(*(F.sum(F.col(s) * F.col("times")).alias(s) for s in sums))
    down = spread_axis(across, "y", "h", ["x", *sums], reach)
    down = down.groupBy("img_id", "w", "h", "x", F.col("to").alias("y")).agg(*(F.sum(F.col(s) * F.col("times")).alias(s) for s in sums))
    return down.withColumn("n_", F.lit((2 * reach + 1) ** 2)).select("img_id", "x", "y", _variance().alias("variance"))


def spread_axis(df: DataFrame, axis: str, side: str, keep: list[str], reach: int) -> DataFrame:
    """Each value once for every window along ``axis`` that it is in, and how often: a border value also stands for the
    places of a window beyond it."""
    to = F.explode(F.sequence(F.greatest(F.col(axis) - reach, F.lit(0)), F.least(F.col(axis) + reach, F.col(side) - 1))).alias("to")
    df = df.select("img_id", "w", "h", *keep, F.col(axis).alias("at"), to)
    low = F.when(F.col("at") == 0, F.greatest(F.lit(reach) - F.col("to"), F.lit(0))).otherwise(0)
    high = F.when(F.col("at") == F.col(side) - 1, F.greatest(F.col("to") + reach - (F.col(side) - 1), F.lit(0))).otherwise(0)
    return df.withColumn("times", (low + high + 1).cast("long"))


def density_map(px: DataFrame, sensitivity: float, reach: int = REACH) -> DataFrame:
    """``px`` with ``density``: 1 where the image varies most, 1 - ``sensitivity`` where it is even. The image's largest
    variance is an aggregate of one row for each image, joined back."""
    v = local_variance(px, reach)
    top = v.groupBy("img_id").agg(F.greatest(F.max("variance"), F.lit(1e-6)).alias("top"))
    s = F.lit(float(sensitivity))
    return v.join(top, "img_id").withColumn("density", F.lit(1.0) - s * (F.lit(1.0) - F.sqrt(F.col("variance") / F.col("top")))).drop("variance", "top")


def density_gray(px: DataFrame) -> DataFrame:
    return px.withColumn("v", F.greatest(F.least(F.col("density") * 255.0, F.lit(255.0)), F.lit(0.0)).cast("int"))


def prefix_sums(px: DataFrame) -> DataFrame:
    """``(img_id, x, y, ...)`` sums and sums of squares of each channel over all pixels up to and with ``(x, y)``."""
    across = Window.partitionBy("img_id", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("img_id", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    sums = {f"s{c}": F.sum(F.col(c).cast("long")).over(across) for c in "rgb"} | {f"q{c}": F.sum((F.col(c) * F.col(c)).cast("long")).over(across) for c in "rgb"}
    rows = px.withColumns(sums)
    return rows.withColumns({k: F.sum(k).over(down) for k in sums}).select("img_id", "x", "y", *sums)


def rect_query(sat: DataFrame, rects: DataFrame) -> DataFrame:
    """Sums over ``rects(img_id, rect_id, x0, y0, x1, y1)``, ends not included, from four corners of the prefix sums."""
    names = [c for c in sat.columns if c not in ("img_id", "x", "y")]
    corner = F.explode(F.array(*(F.struct(F.col(a).alias("cx"), F.col(b).alias("cy"), F.lit(sign).alias("sign")) for a, b, sign in (("x1", "y1", 1), ("x0", "y1", -1), ("x1", "y0", -1), ("x0", "y0", 1)))))
    at = rects.select("img_id", "rect_id", corner.alias("c")).select("img_id", "rect_id", (F.col("c.cx") - 1).alias("x"), (F.col("c.cy") - 1).alias("y"), "c.sign")
    got = at.join(sat, ["img_id", "x", "y"], "left")
    return got.groupBy("img_id", "rect_id").agg(*(F.sum(F.coalesce(F.col(n), F.lit(0)) * F.col("sign")).alias(n) for n in names))


def disk_average(values: DataFrame, centers: DataFrame, value: str) -> DataFrame:
    """``centers(img_id, id, cx, cy, radius)`` with ``mean``: of ``value`` over pixels at whole offsets within the radius
    from the centre's pixel. The offsets of a disk are listed, so the lookup is an equi-join."""
    n = F.ceil("radius").cast("int")
    span = F.sequence(-n, n)
    offsets = F.when(n <= 0, F.array(F.struct(F.lit(0).alias("dx"), F.lit(0).alias("dy")))).otherwise(
        F.filter(F.flatten(F.transform(span, lambda dy: F.transform(span, lambda dx: F.struct(dx.alias("dx"), dy.alias("dy"))))), lambda o: o["dx"] * o["dx"] + o["dy"] * o["dy"] <= F.col("radius") * F.col("radius"))
    )
    keys = [c for c in ("img_id", "channel") if c in centers.columns and c in values.columns]
    at = centers.select(*keys, "id", F.col("cx").cast("int").alias("x0"), F.col("cy").cast("int").alias("y0"), F.explode(offsets).alias("o"))
    at = at.select(*keys, "id", (F.col("x0") + F.col("o.dx")).alias("x"), (F.col("y0") + F.col("o.dy")).alias("y"))
    mean = at.join(values.select(*keys, "x", "y", value), [*keys, "x", "y"]).groupBy(*keys, "id").agg(F.avg(value).alias("mean"))
    return centers.join(mean, [*keys, "id"])
