"""Reproducible random numbers and weighted systematic sampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the linear congruential generator, modulo 2 ** 64.
MULTIPLIER, INCREMENT = 6364136223846793005, 1442695040888963407


def lcg_states(seed: int, steps: np.ndarray) -> np.ndarray:
    """States after so many steps, found by doubling the step: any row is computed on its own."""
    a, c = np.ones(len(steps), np.uint64), np.zeros(len(steps), np.uint64)
    m, k = np.uint64(MULTIPLIER), np.uint64(INCREMENT)
    left = steps.astype(np.uint64)
    with np.errstate(over="ignore"):
        while left.any():
            odd = (left & np.uint64(1)).astype(bool)
            a[odd], c[odd] = a[odd] * m, c[odd] * m + k
            m, k = m * m, k * (m + np.uint64(1))
            left >>= np.uint64(1)
        return a * np.uint64(seed % (1 << 64)) + c


def lcg_uniform(step: Column, seed: int) -> Column:
    """The ``step``-th draw, counted from 1, in [0, 1]: the upper half of the state over 2 ** 32 - 1."""

    @F.pandas_udf("double")
    def draw(s: pd.Series) -> pd.Series:
        return pd.Series((lcg_states(seed, s.to_numpy()) >> np.uint64(32)).astype(np.float64) / 4294967295.0)

    return draw(step.cast("long"))


def lcg_sequence(spark: SparkSession, n: int, seed: int) -> DataFrame:
    return spark.range(1, n + 1).select(F.col("id").alias("i"), lcg_uniform(F.col("id"), seed).alias("u"))


def importance_sample(px: DataFrame, k: int, seed: int, weight: str = "density") -> DataFrame:
    """``(img_id, sample_id, x, y)``: ``k`` pixels of each image, drawn at jittered even steps along the running sum of
    weights, row by row. An image without weight is sampled evenly.

    The running sum has two levels, rows and then pixels in a row, so no task holds an image. A target lies well inside
    one step, and pixels are listed under the steps that their stretch of the sum touches: the range join is an
    equi-join on the step's number.
    """
    rows = px.groupBy("img_id", "y").agg(F.sum(weight).alias("row_sum"))
    before = Window.partitionBy("img_id").orderBy("y").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("above", F.coalesce(F.sum("row_sum").over(before), F.lit(0.0)))
    total = rows.groupBy("img_id").agg(F.sum("row_sum").alias("total"))
    inner = Window.partitionBy("img_id", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    at = px.withColumn("upto", F.sum(weight).over(inner)).join(rows, ["img_id", "y"]).join(total, "img_id")
    step = F.col("total") / k
    at = at.select("img_id", "w", "h", "x", "y", "total", (F.col("above") + F.col("upto") - F.col(weight)).alias("lo"), (F.col("above") + F.col("upto")).alias("hi"))
    dims = px.select("img_id", "w", "h").distinct().join(total, "img_id")
    ids = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    targets = dims.withColumn("sample_id", ids)
    u = [lcg_uniform(F.col("sample_id") * 3 + d, seed) for d in (1, 2, 3)]
    targets = targets.withColumns({f"u{i}": v for i, v in enumerate(u)})
    aim = (F.col("sample_id") + 0.5 + (F.col("u0") - 0.5) * 0.9) * step
    weighted = targets.where("total > 0").withColumn("aim", F.greatest(F.least(aim, F.col("total") - 1e-9), F.lit(0.0)))
    weighted = weighted.withColumn("step", F.floor(F.col("aim") / step))
    spread = F.sequence(F.greatest(F.floor(F.col("lo") / step) - 1, F.lit(0)), F.floor(F.col("hi") / step) + 1)
    listed = at.where("total > 0 and hi > lo").select("img_id", "x", "y", "lo", "hi", F.explode(spread).alias("step"))
    hit = weighted.select("img_id", "sample_id", "aim", "step", "w", "h", "u1", "u2").join(listed, ["img_id", "step"]).where((F.col("lo") <= F.col("aim")) & (F.col("aim") < F.col("hi")))
    shift = lambda c, u, side: F.least(F.col(c) + F.col(u), F.col(side) - 0.01).cast("int")
    hit = hit.groupBy("img_id", "sample_id").agg(F.min(F.struct("y", "x", "w", "h", "u1", "u2")).alias("p")).select("img_id", "sample_id", "p.*")
    hit = hit.select("img_id", "sample_id", shift("x", "u1", "w").alias("x"), shift("y", "u2", "h").alias("y"))
    even = targets.where("total <= 0").withColumns({"a": lcg_uniform(F.col("sample_id") * 2 + 1, seed), "b": lcg_uniform(F.col("sample_id") * 2 + 2, seed)})
    place = lambda u, side: F.least((F.col(u) * F.col(side)).cast("int"), F.col(side) - 1)
    return hit.unionByName(even.select("img_id", "sample_id", place("a", "w").alias("x"), place("b", "h").alias("y")))
