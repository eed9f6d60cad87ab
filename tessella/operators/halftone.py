"""Halftone: inks, rotated screens, amplitude and frequency screening."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.assign import nearest_color
from tessella.operators.density import disk_average
from tessella.operators.palette import ROUNDS, dominant_colors
from tessella.operators.sampling import INCREMENT, MULTIPLIER
from tessella.params import Params

#: Cyan, magenta, yellow, black.
INKS = ((0, 255, 255), (255, 0, 255), (255, 255, 0), (0, 0, 0))


def separate_cmyk(px: DataFrame, angles: tuple[float, ...]) -> DataFrame:
    """``(img_id, w, h, x, y, channel, coverage, r, g, b, angle)``: four rows for each pixel."""
    r, g, b = (F.col(c) / F.lit(255.0) for c in "rgb")
    k = F.lit(1.0) - F.greatest(r, g, b)
    scale = F.when(k < 1.0, F.lit(1.0) / (F.lit(1.0) - k)).otherwise(F.lit(0.0))
    clamp = lambda v: F.greatest(F.least(v, F.lit(1.0)), F.lit(0.0))
    cmy = [clamp((F.lit(1.0) - v - k) * scale) for v in (r, g, b)]
    under = F.when(cmy[0] + cmy[1] + cmy[2] > 0.3, F.least(*cmy) * 0.5).otherwise(F.lit(0.0))
    planes = [*(clamp(v - under) for v in cmy), clamp(k)]
    rows = [F.struct(F.lit(i).alias("channel"), v.alias("coverage"), *(F.lit(c).alias(n) for c, n in zip(ink, "rgb", strict=True)), F.lit(float(a)).alias("angle")) for i, (v, ink, a) in enumerate(zip(planes, INKS, angles, strict=True))]
    return px.select("img_id", "w", "h", "x", "y", F.explode(F.array(*rows)).alias("c")).select("img_id", "w", "h", "x", "y", "c.*")


def separate_dominant(px: DataFrame, n: int, base_angle_deg: float, rounds: int = ROUNDS) -> DataFrame:
    """The same for the ``n`` dominant colours; only a pixel's nearest colour has a row, others cover nothing."""
    palette = dominant_colors(px, n, rounds)
    near = nearest_color(px, palette)
    part = F.lit(1.0) - F.least(F.greatest(F.col("d2") / F.lit(255.0 * 255.0 * 1.5), F.lit(0.0)), F.lit(1.0))
    cover = F.least(F.greatest(part * 1.3, F.lit(0.0)), F.lit(1.0))
    return near.select("img_id", "w", "h", "x", "y", F.col("palette_id").alias("channel"), cover.alias("coverage"), F.col("pr").alias("r"), F.col("pg").alias("g"), F.col("pb").alias("b"), (F.col("palette_id") * F.lit(180.0 / n) + F.lit(base_angle_deg)).alias("angle"))


def lattice(images: DataFrame, p: Params) -> DataFrame:
    """``images(img_id, w, h, channel, r, g, b, angle)`` exploded to the points of each channel's rotated screen that lie
    on the canvas, with ``i``, ``j``, ``cx``, ``cy`` and the screen's ``step``."""
    step = F.greatest(F.least("w", "h") / F.lit(float(p.halftone_frequency)), F.lit(2.0))
    extent = (F.ceil((F.sqrt(F.col("w") * F.col("w") + F.col("h") * F.col("h")) / 2 + F.col("step")) / F.col("step")) + 1).cast("int")
    at = images.withColumn("step", step).withColumn("extent", extent)
    at = at.withColumn("j", F.explode(F.sequence(-F.col("extent"), F.col("extent")))).withColumn("i", F.explode(F.sequence(-F.col("extent"), F.col("extent"))))
    c, s = F.cos(F.radians("angle")), F.sin(F.radians("angle"))
    at = at.withColumns({"cx": F.col("w") / 2 + F.col("step") * (F.col("i") * c - F.col("j") * s), "cy": F.col("h") / 2 + F.col("step") * (F.col("i") * s + F.col("j") * c)})
    return at.where("cx >= 0 and cx < w and cy >= 0 and cy < h").drop("extent")


def mixed(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) for whole numbers: two rounds of a 31-bit generator, the same in any order of rows."""
    h = F.lit(seed % 2147483648).cast("long")
    for part in parts:
        h = F.pmod((h + part.cast("long") + 65_536) * F.lit(1103515245).cast("long") + 12345, F.lit(2147483648))
        h = F.pmod(h * F.lit(69069).cast("long") + F.floor(h / 65_536) + 1, F.lit(2147483648))
    return h / F.lit(2147483648.0)


def _replayed(points: DataFrame, seed: int) -> DataFrame:
    """Frequency screening with one generator for a channel, whose draws depend on what was drawn before: a channel of an
    image is one task. Its points are bounded by the screen's frequency."""
    import numpy as np
    import pandas as pd

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["j", "i"])
        one = frame.iloc[0]
        color = int(one["r"]) << 40 | int(one["g"]) << 24 | int(one["b"])
        state = (seed * 0x9E3779B97F4A7C15 + color) % (1 << 64)  # fixed value: the golden ratio in 64 bits

        def draw() -> float:
            nonlocal state
            state = (state * MULTIPLIER + INCREMENT) % (1 << 64)
            return (state >> 32) / 4294967295.0

        keep, x, y, radius = [], [], [], []
        for k, (cx, cy, step, mean, low, high) in enumerate(frame[["cx", "cy", "step", "mean", "low", "high"]].to_numpy()):
            if draw() > mean:
                continue
            a, b = draw(), draw()
            keep.append(k)
            x.append(cx + (a - 0.5) * step * 0.4)
            y.append(cy + (b - 0.5) * step * 0.4)
            radius.append(low + (high - low) * (0.7 + 0.3 * draw()))
        got = frame.iloc[keep][["img_id", "channel", "i", "j", "r", "g", "b"]]
        return got.assign(x=np.array(x, float), y=np.array(y, float), radius=np.array(radius, float))[["img_id", "channel", "i", "j", "x", "y", "r", "g", "b", "radius"]]

    schema = "img_id string, channel int, i int, j int, x double, y double, r int, g int, b int, radius double"
    return points.groupBy("img_id", "channel").applyInPandas(run, schema)


def screened(planes: DataFrame, p: Params) -> DataFrame:
    """Dots ``(img_id, channel, i, j, x, y, r, g, b, radius)`` of all channels."""
    images = planes.select("img_id", "w", "h", "channel", "r", "g", "b", "angle").distinct()
    points = lattice(images, p).withColumn("id", F.struct("j", "i"))
    at = disk_average(planes.select("img_id", "channel", "x", "y", "coverage"), points.withColumn("radius", F.col("step") / 2), "coverage")
    # a disk that no listed pixel covers has no row: dominant separation lists only the winners
    low = F.least("w", "h") * F.lit(p.halftone_min_radius_ratio)
    if p.screening == "am":
        high = F.col("step") * F.lit(p.halftone_max_dot_ratio)
        at = at.where("mean > 0.005").withColumn("radius", low + (high - low) * F.col("mean"))
        at = at.withColumns({"x": F.col("cx"), "y": F.col("cy")})
    elif p.screening == "fm-replay":
        at = at.where("mean > 0.005").withColumns({"low": low, "high": F.col("step") * F.lit(p.halftone_max_dot_ratio * 0.5)})
        at = _replayed(at.select("img_id", "channel", "i", "j", "cx", "cy", "r", "g", "b", "step", "mean", "low", "high"), p.rng_seed)
    else:
        high = F.col("step") * F.lit(p.halftone_max_dot_ratio * 0.5)
        u = [mixed(p.rng_seed, F.col("channel"), F.col("j"), F.col("i"), F.lit(k)) for k in range(4)]
        at = at.where((F.col("mean") > 0.005) & (u[0] <= F.col("mean")))
        at = at.withColumns({"x": F.col("cx") + (u[1] - 0.5) * 0.4 * F.col("step"), "y": F.col("cy") + (u[2] - 0.5) * 0.4 * F.col("step"), "radius": low + (high - low) * (u[3] * 0.3 + 0.7)})
    return at.where("radius >= 0.5").select("img_id", "channel", "i", "j", "x", "y", "r", "g", "b", "radius")


def full_planes(planes: DataFrame) -> DataFrame:
    """Planes with a zero row where a channel does not cover a pixel, so that disk means see all pixels."""
    places = planes.select("img_id", "w", "h", "x", "y").distinct()
    channels = planes.select("img_id", "channel", "r", "g", "b", "angle").distinct()
    return places.join(channels, "img_id").join(planes.select("img_id", "x", "y", "channel", "coverage"), ["img_id", "x", "y", "channel"], "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))


def halftone_dots(px: DataFrame, p: Params) -> DataFrame:
    """Dots of the chosen separation and screening, numbered by channel and screen row."""
    from tessella.operators.placement import DOT, _numbered

    planes = separate_cmyk(px, p.halftone.angles) if p.halftone.mode == "cmyk" else full_planes(separate_dominant(px, p.halftone.n, p.halftone.base_angle_deg))
    return _numbered(screened(planes, p), "channel", "j", "i").select(*DOT)
