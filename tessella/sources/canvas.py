"""Pixel relations ``(img_id, w, h, x, y, r, g, b)``: from tables, from image files, from formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions of image files. Of these the JVM has no reader for WebP, such files count as not decoded.
EXTENSIONS = ("bmp", "gif", "jpeg", "jpg", "png", "tif", "tiff", "webp")


def raster(spark: SparkSession, w: int, h: int, img_id: str = "0") -> DataFrame:
    """Places of an image, row by row."""
    at = spark.range(w * h)
    return at.select(F.lit(img_id).alias("img_id"), F.lit(w).alias("w"), F.lit(h).alias("h"), (F.col("id") % w).cast("int").alias("x"), F.floor(F.col("id") / w).cast("int").alias("y"))


def table_canvas(spark: SparkSession, sf_dir: str, w: int = 64, h: int = 48) -> DataFrame:
    """A canvas from ``lineitem``: smooth gradients, with noise from sums over the rows that fall on a pixel."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cell = rows.groupBy((F.col("l_orderkey") % w).cast("int").alias("x"), (F.col("l_partkey") % h).cast("int").alias("y")).agg(
        F.sum(F.col("l_quantity").cast("long")).alias("q"),
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("p"),
        F.sum(F.col("l_linenumber").cast("long") * 37 + F.col("l_suppkey")).alias("s"),
    )
    part = lambda c, at, half, lo, hi: F.coalesce(c, F.lit(0)) % F.when(F.col(at) < half, lo).otherwise(hi)
    return (
        raster(spark, w, h)
        .join(cell, ["x", "y"], "left")
        .select(
            "img_id", "w", "h", "x", "y",
            ((F.col("x") * 3 + part(F.col("q"), "x", w // 2, 8, 64)) % 256).cast("int").alias("r"),
            ((F.col("y") * 4 + part(F.col("p"), "y", h // 2, 8, 64)) % 256).cast("int").alias("g"),
            ((F.col("x") + F.col("y") + part(F.col("s"), "x", w // 2, 4, 128)) % 256).cast("int").alias("b"),
        )
    )


def checkerboard(spark: SparkSession, w: int, h: int) -> DataFrame:
    v = F.when((F.col("x") + F.col("y")) % 2 == 0, 255).otherwise(0)
    return raster(spark, w, h).withColumns({c: v for c in "rgb"})


def solid(spark: SparkSession, w: int, h: int, color: tuple[int, int, int]) -> DataFrame:
    return raster(spark, w, h).withColumns({c: F.lit(v) for c, v in zip("rgb", color, strict=True)})


def mosaic(spark: SparkSession, w: int = 400, h: int = 400) -> DataFrame:
    """Blocks of 40 pixels in red, green, blue and a gradient: the canvas of the benchmark."""
    k = (F.floor(F.col("x") / 40) % 4 + F.floor(F.col("y") / 40) % 4) % 4
    x, y = F.col("x"), F.col("y")
    pick = lambda own, rest: F.when(k == own, 255).when(k < 3, 0).otherwise(rest).cast("int")
    return raster(spark, w, h).withColumns({"r": pick(0, F.pmod(x + y, F.lit(256))), "g": pick(1, F.pmod(x - y, F.lit(256))), "b": pick(2, F.lit(128))})


def list_images(spark: SparkSession, pattern: str) -> DataFrame:
    """``(path, length)``, sorted by path: files that a pattern matches, image files directly in a folder, or one file.
    Listed through the file system that Spark reads from."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(conf)
    if any(c in pattern for c in "*?["):
        found = fs.globStatus(path) or []
    elif fs.exists(path) and fs.getFileStatus(path).isDirectory():
        found = [s for s in fs.listStatus(path) if s.getPath().getName().lower().rpartition(".")[2] in EXTENSIONS]
    else:
        found = [fs.getFileStatus(path)]
    rows = sorted((s.getPath().toString(), s.getLen()) for s in found if s.isFile())
    return spark.createDataFrame(rows, "path string, length long")


def read_images(spark: SparkSession, pattern: str) -> DataFrame:
    """Pixels with ``a`` of image files; files that cannot be decoded are left out."""
    paths = [r.path for r in list_images(spark, pattern).collect()]  # names of one listing
    if not paths:
        return spark.createDataFrame([], "img_id string, w int, h int, x int, y int, r int, g int, b int, a int")
    image = spark.read.format("image").option("dropInvalid", True).load(paths).select("image.*")
    return unpack(image)


def unpack(image: DataFrame) -> DataFrame:
    """Spark's image rows (blue first) to pixels."""

    def run(frames):
        import numpy as np
        import pandas as pd

        for frame in frames:
            for it in frame.itertuples():
                data = np.frombuffer(it.data, np.uint8).reshape(it.height, it.width, it.nChannels)
                for y in range(0, it.height, 256):  # bands, so that a large image is no large frame
                    band = data[y : y + 256]
                    rows, cols = np.indices(band.shape[:2])
                    c = [band[..., i].ravel().astype(np.int32) for i in range(it.nChannels)]
                    b, g, r = (c[0], c[0], c[0]) if it.nChannels == 1 else c[:3]
                    yield pd.DataFrame({"img_id": it.origin, "w": it.width, "h": it.height, "x": cols.ravel(), "y": rows.ravel() + y, "r": r, "g": g, "b": b, "a": c[3] if it.nChannels == 4 else 255})

    return image.mapInPandas(run, "img_id string, w int, h int, x int, y int, r int, g int, b int, a int")
