"""Command line: ``python -m tessella -i IMAGES -o PATTERN``."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import raster
from tessella.params import ALGORITHMS, Halftone, Params, Shape, parse_bg_color, parse_halftone, parse_screening, parse_size
from tessella.plans import rendering
from tessella.sources import canvas, sinks


def parser() -> argparse.ArgumentParser:
    d, p = Params(), argparse.ArgumentParser(prog="tessella", description="Turn images into dots.")
    p.add_argument("-i", "--input", help="an image, a folder or a pattern")
    p.add_argument("-o", "--output", default="output.png", help="{n}, {stem} and {name} stand for the input's number and name")
    p.add_argument("--algorithm", choices=ALGORITHMS, default=d.algorithm)
    p.add_argument("--num-points", type=int, default=d.num_points)
    p.add_argument("--cols", type=int, default=d.cols)
    p.add_argument("--min-radius", type=float, default=d.min_radius_ratio)
    p.add_argument("--max-radius", type=float, default=d.max_radius_ratio)
    p.add_argument("--bg", default="white", help="white, black, transparent or #rrggbb")
    p.add_argument("--iterations", type=int, default=d.iterations)
    p.add_argument("--variance-sensitivity", type=float, default=d.variance_sensitivity)
    p.add_argument("--max-boost", type=float, default=d.max_boost)
    p.add_argument("--seed", type=int, default=d.rng_seed)
    p.add_argument("--palette", type=int)
    p.add_argument("--shape", choices=("circle", "square", "ellipse", "polygon"), default="circle")
    p.add_argument("--ellipse-aspect", type=float, default=1.0)
    p.add_argument("--ellipse-angle", type=float, default=0.0)
    p.add_argument("--polygon-sides", type=int, default=6)
    p.add_argument("--gamma", action="store_true")
    p.add_argument("--dithering", action="store_true")
    p.add_argument("--grid-angle", type=float, default=0.0)
    p.add_argument("--halftone", default="off", help="off, cmyk or dominant-N")
    p.add_argument("--screening", default="am", help="am or fm")
    p.add_argument("--halftone-freq", type=float, default=d.halftone_frequency)
    p.add_argument("--halftone-min-radius", type=float, default=d.halftone_min_radius_ratio)
    p.add_argument("--halftone-max-dot", type=float, default=d.halftone_max_dot_ratio)
    p.add_argument("--preview", metavar="WxH", help="shrink images to fit first")
    p.add_argument("--svg", action="store_true")
    p.add_argument("--preset", help="TOML file that replaces all parameters")
    p.add_argument("--save-preset", help="TOML file to write the parameters to")
    return p


def to_params(a: argparse.Namespace) -> Params:
    if a.preset:
        return Params.from_toml(Path(a.preset).read_text())
    color, transparent = parse_bg_color(a.bg)
    halftone: Halftone = parse_halftone(a.halftone)
    if a.algorithm == "halftone" and halftone.mode == "off":
        raise ValueError("--algorithm halftone also needs --halftone cmyk or --halftone dominant-N")
    return Params(
        algorithm="halftone" if halftone.mode != "off" else a.algorithm, num_points=a.num_points, cols=a.cols, min_radius_ratio=a.min_radius, max_radius_ratio=a.max_radius,
        bg_color=color, iterations=a.iterations, variance_sensitivity=a.variance_sensitivity, max_boost=a.max_boost, rng_seed=a.seed, palette_size=a.palette,
        dot_shape=Shape(a.shape, a.ellipse_aspect, a.ellipse_angle, min(max(a.polygon_sides, 3), 12)), transparent=transparent, gamma_correct=a.gamma, dithering=a.dithering,
        grid_angle_deg=a.grid_angle, halftone=halftone, screening=parse_screening(a.screening), halftone_frequency=a.halftone_freq,
        halftone_min_radius_ratio=a.halftone_min_radius, halftone_max_dot_ratio=a.halftone_max_dot,
    ).validate()


def convert(spark: SparkSession, source: str, pattern: str, p: Params, svg: bool, preview: tuple[int, int] | None) -> int:
    """All images in one job; the number of files written. Files that cannot be decoded are reported and left out."""
    listed = canvas.list_images(spark, source)
    names = [r.path for r in listed.collect()]
    px = canvas.read_images(spark, source)
    px = rendering.flatten(px, p.bg_color)
    if preview:
        px = raster.downscale(px, *preview)
    default = pattern == "output.png"
    kind = pattern.lower().rpartition(".")[2] if "." in pattern.rpartition("/")[2] and not pattern.endswith("{name}") else "png"
    if not svg and kind not in sinks.WITH_ALPHA + sinks.WITHOUT_ALPHA:
        raise ValueError(f"images cannot be written as {kind}")
    order = spark.createDataFrame([(name, i) for i, name in enumerate(names)], "img_id string, number int")
    out: DataFrame
    if svg:
        out, data = sinks.svg_documents(rendering.render_svg(px, p)), "svg"
    else:
        got = rendering.apply_rgba(px, p) if p.transparent else rendering.apply(px, p)
        out, data = sinks.encode(got if kind in sinks.WITH_ALPHA else rendering.flatten(got, p.bg_color), kind), "data"
    one = lambda c: F.regexp_replace(c, "^([A-Za-z0-9+.-]+):/*", "$1:/")  # noqa: E731  readers spell the scheme of a path in several ways
    out = out.join(order.select(one(F.col("img_id")).alias("file"), "number"), one(F.col("img_id")) == F.col("file"))
    out = out.withColumn("path", sinks.output_path(F.col("img_id"), F.col("number"), len(names), pattern, svg, default))
    out = out.select("path", data).cache()
    sinks.write_files(out, "path", data)
    done = out.count()
    if done < len(names):
        print(f"{len(names) - done} of {len(names)} files could not be decoded", file=sys.stderr)
    return done


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        p = to_params(a)
        preview = parse_size(a.preview) if a.preview else None
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    if a.save_preset:
        Path(a.save_preset).write_text(p.to_toml())
        if not a.input:
            return 0
    if not a.input:
        print("--input is missing", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("tessella").getOrCreate()
    try:
        convert(spark, a.input, a.output, p, a.svg, preview)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
