"""Nearest-centre assignment: exact joins on cells for places, packed tiles of pixels for clustering."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.sources.scratch import cut_lineage

TILE = 128  # pixels along a side of what one task works on at a time
BROADCAST_BYTES = 32 << 20  # centres of all images are broadcast up to here, shuffled to their tiles beyond
Values = dict[str, np.ndarray]


def _in_rings(points: DataFrame, seeds: DataFrame, x: Column, y: Column, sides: DataFrame, other: Callable[[Column], Column] | None = None) -> DataFrame:
    """``points`` with ``best(d2, seed_id)``: the seed nearest to ``(x, y)``, ties to the smaller id; null if there is none.
    ``sides(img_id, w, h)`` holds all points and seeds of an image; ``other`` says which seeds count.

    Seeds are dealt to cells with about four seeds' room, and each cell gets the seeds of the 5 by 5 cells around it, so
    the join is on cell numbers. That is exact where the best distance is below two cells. Points for which it is not
    go on with cells four times as wide, until cells are as wide as the image.
    """
    count = seeds.groupBy("img_id").agg(F.count("*").alias("k"))
    grid = cut_lineage(sides.join(count, "img_id").select("img_id", F.greatest("w", "h").cast("double").alias("side"), F.greatest(F.sqrt(F.col("w") * F.col("h") * 4.0 / F.col("k")), F.lit(1.0)).alias("cell")))
    near = F.sequence(F.lit(-2), F.lit(2))
    spread = F.explode(F.flatten(F.transform(near, lambda i: F.transform(near, lambda j: F.struct((F.col("bx") + i).alias("bx"), (F.col("by") + j).alias("by"))))))
    seed = F.struct(F.col("seed_id"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    count_ = F.filter("near", other) if other else F.col("near")
    best = F.array_min(F.transform(count_, lambda s: F.struct(((s["sx"] - x) * (s["sx"] - x) + (s["sy"] - y) * (s["sy"] - y)).alias("d2"), s["seed_id"].alias("seed_id"))))
    left, done = points, None
    while True:
        home = seeds.join(grid, "img_id").withColumns({"bx": F.floor(F.col("x") / F.col("cell")), "by": F.floor(F.col("y") / F.col("cell"))})
        cells = home.select("img_id", seed.alias("s"), spread.alias("b")).groupBy("img_id", "b.bx", "b.by").agg(F.collect_list("s").alias("near"))
        at = left.join(grid, "img_id").withColumns({"bx": F.floor(x / F.col("cell")), "by": F.floor(y / F.col("cell"))})
        got = at.join(cells, ["img_id", "bx", "by"], "left").withColumn("best", best)
        sure = F.coalesce(F.col("best")["d2"] < 4 * F.col("cell") * F.col("cell"), F.lit(False)) | (F.col("cell") >= F.col("side"))
        got = cut_lineage(got.select(*points.columns, "best", sure.alias("sure")))
        some = got.where("sure").select(*points.columns, "best")
        done = some if done is None else done.unionByName(some)
        left = got.where("not sure").select(*points.columns)
        if not left.head(1):
            return done
        grid = grid.withColumn("cell", F.col("cell") * 4)


def nearest_seed(px: DataFrame, seeds: DataFrame) -> DataFrame:
    """``px`` with ``seed_id`` and ``d2`` of the seed nearest to the pixel's middle, ties to the smaller id."""
    got = _in_rings(px, seeds, F.col("x") + 0.5, F.col("y") + 0.5, px.select("img_id", "w", "h").distinct())
    return got.select(*px.columns, F.col("best")["seed_id"].alias("seed_id"), F.col("best")["d2"].alias("d2"))


def nn_radius(seeds: DataFrame) -> DataFrame:
    """``seeds`` with ``nn``, half the distance to the nearest other seed; infinite for a lone one."""
    low = seeds.groupBy("img_id").agg(F.min("x").alias("lx"), F.min("y").alias("ly"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"))
    got = _in_rings(seeds, seeds, F.col("x"), F.col("y"), low.select("img_id", "w", "h"), lambda s: s["seed_id"] != F.col("seed_id"))
    return got.select(*seeds.columns, F.coalesce(F.sqrt(F.col("best")["d2"]) / 2, F.lit(float("inf"))).alias("nn"))


def nearest_color(rows: DataFrame, palette: DataFrame, prefix: str = "") -> DataFrame:
    """``rows(img_id, r, g, b)`` with ``palette_id`` and ``d2`` of the nearest colour of ``palette(img_id, palette_id, r,
    g, b)``, ties to the smaller id. A palette is a short list, which is joined as one row per image."""
    one = F.struct("palette_id", F.col("r").alias("pr"), F.col("g").alias("pg"), F.col("b").alias("pb"))
    every = palette.groupBy("img_id").agg(F.collect_list(one).alias("palette"))
    sq = lambda a, b: (a - F.col(b)) * (a - F.col(b))
    best = F.array_min(F.transform("palette", lambda p: F.struct((sq(p["pr"], "r") + sq(p["pg"], "g") + sq(p["pb"], "b")).cast("double").alias("d2"), p["palette_id"].alias("palette_id"), p["pr"].alias("pr"), p["pg"].alias("pg"), p["pb"].alias("pb"))))
    got = rows.join(every, "img_id").withColumn("best", best)
    return got.select(*rows.columns, *(F.col("best")[c].alias(c) for c in ("palette_id", "d2", "pr", "pg", "pb")))


def nearest_center(px: DataFrame, centers: DataFrame) -> DataFrame:
    """``px`` with ``center_id`` of the centre nearest in place and colour, each scaled to 0..1, ties to the smaller id."""
    one = F.struct("center_id", *(F.col(c).alias(f"c{c}") for c in ("x", "y", "r", "g", "b")))
    every = centers.groupBy("img_id").agg(F.collect_list(one).alias("centers"))
    scale = {"x": F.col("w"), "y": F.col("h"), "r": F.lit(255.0), "g": F.lit(255.0), "b": F.lit(255.0)}

    def d2(c):
        parts = [F.pow((F.col(k) - c[f"c{k}"]) / s, F.lit(2.0)) for k, s in scale.items()]
        return parts[0] + parts[1] + parts[2] + parts[3] + parts[4]

    best = F.array_min(F.transform("centers", lambda c: F.struct(d2(c).alias("d2"), c["center_id"].alias("center_id"))))
    return px.join(every, "img_id").withColumn("best", best).select(*px.columns, F.col("best")["center_id"].alias("center_id"))


def tiles(px: DataFrame) -> DataFrame:
    """Pixels packed by tile, a row for each, to be read once in every round of a clustering loop: places within the tile,
    colours and, if there is one, density."""
    at = px.select("img_id", "w", "h", F.floor(F.col("x") / TILE).cast("int").alias("tx"), F.floor(F.col("y") / TILE).cast("int").alias("ty"), "x", "y", "r", "g", "b", (F.col("density") if "density" in px.columns else F.lit(0.0)).cast("double").alias("density"))

    def run(frame):
        import pandas as pd

        one = frame.iloc[0]
        frame = frame.sort_values(["y", "x"])
        small = np.stack([frame["x"] - one["tx"] * TILE, frame["y"] - one["ty"] * TILE, frame["r"], frame["g"], frame["b"]]).astype(np.uint8)
        return pd.DataFrame([{**{k: one[k] for k in ("img_id", "w", "h", "tx", "ty")}, "bytes": small.tobytes(), "density": frame["density"].to_numpy(np.float64).tobytes()}])

    return at.groupBy("img_id", "tx", "ty").applyInPandas(run, "img_id string, w int, h int, tx int, ty int, bytes binary, density binary")


def tiled_sums(packed: DataFrame, centers: DataFrame, feature: Callable[[Values, bool], np.ndarray], sums: Callable[[Values], np.ndarray], names: list[str]) -> DataFrame:
    """``(img_id, center_id, names..., n)``: sums over the pixels nearest to each centre, the body of a clustering loop.

    A tile meets the centres of its image as one list, and compares its pixels with those that can be nearest to any:
    whose least distance to the tile's box, in all coordinates that count, is no more than the greatest distance of any
    other. It returns a row for each centre that has pixels, so what is shuffled is these rows and never a pixel.
    ``feature`` gives the coordinates of pixels (True) or of centres.
    """
    dims = [c for c in ("x", "y", "r", "g", "b") if c in centers.columns]
    lists = centers.groupBy("img_id").agg(F.sort_array(F.collect_list(F.struct(F.col("center_id").cast("long").alias("center_id"), *(F.col(c).cast("double").alias(c) for c in dims)))).alias("centers"))
    few = (lists.agg(F.sum(F.size("centers").cast("long") * (8 + 8 * len(dims)) + 64)).first()[0] or 0) <= BROADCAST_BYTES
    at = packed.join(F.broadcast(lists) if few else lists, "img_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, h, tx, ty = (batch.column(k).to_pylist() for k in ("w", "h", "tx", "ty"))
            for i in range(batch.num_rows):
                own = batch.column("centers")[i].values
                c = {k: own.field(k).to_numpy() for k in dims}
                small = np.frombuffer(batch.column("bytes")[i].as_buffer(), np.uint8).reshape(5, -1).astype(float)
                pix = dict(zip("xyrgb", small, strict=True)) | {"density": np.frombuffer(batch.column("density")[i].as_buffer(), np.float64)}
                pix["x"] = pix["x"] + tx[i] * TILE
                pix["y"] = pix["y"] + ty[i] * TILE
                size = {"w": float(w[i]), "h": float(h[i])}
                f, v = feature(pix | size, True), feature(c | size, False)
                low, high = f.min(0), f.max(0)
                least = (np.maximum(np.maximum(low - v, v - high), 0) ** 2).sum(1)
                most = (np.maximum(np.abs(v - low), np.abs(v - high)) ** 2).sum(1)
                some = np.flatnonzero(least <= most.min() * (1 + 1e-9) + 1e-12)
                v = v[some]
                best = np.empty(len(f), np.int64)
                own_part = (v * v).sum(1)  # the squared distance less the pixel's own part, which all centres share
                for lo in range(0, len(f), 2048):
                    best[lo : lo + 2048] = (own_part - 2 * (f[lo : lo + 2048] @ v.T)).argmin(1)
                each = sums(pix)
                n = np.bincount(best, minlength=len(some))
                hit = np.flatnonzero(n)
                got = [np.bincount(best, weights=each[:, k], minlength=len(some))[hit] for k in range(len(names))]
                ids = own.field("center_id").to_numpy()[some[hit]]
                yield pa.RecordBatch.from_arrays([batch.column("img_id").take(pa.array(np.full(len(hit), i))), pa.array(ids), *map(pa.array, got), pa.array(n[hit])], ["img_id", "center_id", *names, "n"])

    schema = f"img_id string, center_id long, {', '.join(f'{c} double' for c in names)}, n long"
    part = at.mapInArrow(run, schema)
    return part.groupBy("img_id", "center_id").agg(*(F.sum(c).alias(c) for c in [*names, "n"]))
