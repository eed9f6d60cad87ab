from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.__main__ import main, parser, to_params
from tessella.functions import color, geometry
from tessella.operators import assign, density, halftone, palette, placement, raster, sampling
from tessella.params import Halftone, Params, Shape, parse_bg_color, parse_halftone, parse_screening, parse_size
from tessella.plans import rendering
from tessella.sources import canvas, sinks


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_luminance_of_extremes(spark):
    df = spark.createDataFrame([(0, 0, 0), (255, 255, 255), (255, 0, 0), (0, 255, 0), (0, 0, 255)], "r int, g int, b int")
    black, white, red, green, blue = (r[0] for r in rows(df.withColumn("l", color.luminance()), "l"))
    assert black == 0 and white == pytest.approx(1) and green > red > blue


def test_radius_rules(spark):
    p = Params()
    at = lambda lum, d: spark.range(1).select(geometry.dot_radius(F.lit(lum), F.lit(d), F.lit(100.0), p)).first()[0]
    assert at(1.0, 1.0) == pytest.approx(0.3)
    assert at(0.1, 1.0) > at(0.9, 1.0)
    assert at(0.5, 0.2) > at(0.5, 1.0)
    assert at(0.0, 0.0) <= 6.0 * p.max_boost


def test_gamma_tables(spark):
    got = rows(spark.range(256).select(color.srgb_to_linear("id").alias("a"), color.linear_to_srgb("id").alias("b")), "a", "b")
    lin, srgb = [a for a, _ in got], [b for _, b in got]
    assert (lin[0], lin[255], lin[128], srgb[0], srgb[255]) == (0, 255, 55, 0, 255)
    assert 150 < srgb[128] < 220
    assert all(abs(srgb[lin[v]] - v) <= 2 for v in range(32, 256))


def test_density_of_plain_and_varied(spark):
    plain = rows(density.density_map(canvas.solid(spark, 16, 12, (128, 128, 128)), 0.7), "density")
    assert all(d == pytest.approx(0.3) for (d,) in plain)
    board = rows(density.density_map(canvas.checkerboard(spark, 16, 12), 0.7), "density")
    assert sum(d for (d,) in board) > sum(d for (d,) in plain)
    assert all(d == 1 for (d,) in rows(density.density_map(canvas.checkerboard(spark, 16, 12), 0.0), "density"))


def test_nn_radius(spark):
    df = spark.createDataFrame([("a", 0, 0.0, 0.0), ("a", 1, 4.0, 0.0), ("a", 2, 100.0, 0.0), ("b", 0, 5.0, 5.0)], "img_id string, seed_id long, x double, y double")
    got = {(r.img_id, r.seed_id): r.nn for r in assign.nn_radius(df).collect()}
    assert got == {("a", 0): 2.0, ("a", 1): 2.0, ("a", 2): 48.0, ("b", 0): math.inf}


def test_nearest_seed_equals_brute_force_with_sparse_corner(spark):
    rng = np.random.default_rng(1)
    seeds = [("0", i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((40, 2)) * 12)]  # all in one corner
    got = assign.nearest_seed(canvas.solid(spark, 40, 30, (1, 2, 3)), spark.createDataFrame(seeds, "img_id string, seed_id long, x double, y double"))
    s = np.array([x[2:] for x in seeds])
    for r in got.collect():
        d = ((s - [r.x + 0.5, r.y + 0.5]) ** 2).sum(1)
        assert r.seed_id == d.argmin()


def test_lcg_draws_are_the_sequence():
    s, want = 12345, []
    for _ in range(50):
        s = (s * sampling.MULTIPLIER + sampling.INCREMENT) % (1 << 64)
        want.append(s)
    assert sampling.lcg_states(12345, np.arange(1, 51)).tolist() == want


def test_sampling_without_weight_and_reproducible(spark):
    flat = canvas.solid(spark, 10, 8, (0, 0, 0)).withColumn("density", F.lit(0.0))
    assert sampling.importance_sample(flat, 5, 3).count() == 5
    px = density.density_map(canvas.checkerboard(spark, 20, 16), 0.7)
    a, b, c = (sorted(map(tuple, sampling.importance_sample(px, 30, s).collect())) for s in (1, 1, 2))
    assert a == b != c and len(a) == 30


@pytest.mark.parametrize("algorithm", ["grid", "kmeans", "voronoi", "quadtree"])
def test_apply_keeps_size(spark, algorithm):
    px = canvas.checkerboard(spark, 24, 16)
    p = Params(algorithm=algorithm, num_points=12, cols=6, iterations=1)
    out = rendering.apply(px, p)
    assert out.agg(F.count("*"), F.max("x"), F.max("y")).first()[:] == (384, 23, 15)
    assert rendering.compute_dots(px, p).where("radius <= 0").count() == 0


def test_several_images_at_once_equal_each_alone(spark):
    a, b = canvas.checkerboard(spark, 20, 16), canvas.mosaic(spark, 30, 20).withColumn("img_id", F.lit("1"))
    p = Params(algorithm="quadtree", num_points=20)
    both = rendering.compute_dots(a.unionByName(b), p)
    for one, name in ((a, "0"), (b, "1")):
        assert sorted(map(tuple, both.where(F.col("img_id") == name).collect())) == sorted(map(tuple, rendering.compute_dots(one, p).collect()))


def test_quadtree_leaves_tile_the_canvas(spark, sf_dir):
    leaves = placement.quadtree_leaves(canvas.table_canvas(spark, sf_dir, 37, 23), Params(num_points=100)).collect()
    seen = np.zeros((23, 37), int)
    for r in leaves:
        seen[r.y0 : r.y0 + r.nh, r.x0 : r.x0 + r.nw] += 1
    assert (seen == 1).all()


def test_progress_and_cancel(spark):
    px, calls = canvas.checkerboard(spark, 16, 12), []
    rendering.compute_dots(px, Params(num_points=6, iterations=2), progress=lambda i, n: calls.append((i, n)))
    assert calls == [(1, 2), (2, 2)]
    with pytest.raises(placement.Cancelled):
        rendering.compute_dots(px, Params(num_points=6), cancelled=lambda: True)


@pytest.mark.parametrize("bad", [{"num_points": 0}, {"cols": 0}, {"min_radius_ratio": 0}, {"min_radius_ratio": 0.5}, {"max_radius_ratio": 1.5}, {"palette_size": 1}, {"variance_sensitivity": 1.1}, {"max_boost": 0.5}, {"dot_shape": Shape("polygon", sides=2)}, {"dot_shape": Shape("ellipse", aspect=0)}, {"min_radius_ratio": math.nan}, {"algorithm": "x"}])
def test_validation(bad):
    with pytest.raises(ValueError):
        Params(**bad).validate()


def test_validation_of_sizes():
    Params(iterations=0).validate(65_535, 4096)
    for w, h in ((0, 5), (65_536, 1), (65_535, 65_535)):
        with pytest.raises(ValueError):
            Params().validate(w, h)


def test_toml_round_trip():
    p = Params(algorithm="halftone", halftone=Halftone("dominant", n=6), palette_size=4, dot_shape=Shape("ellipse", 2.0, 30.0), bg_color=(1, 2, 3))
    assert Params.from_toml(p.to_toml()) == p
    assert Params.from_toml(Params().to_toml()) == Params()
    with pytest.raises(ValueError):
        Params.from_toml("cols = 3")


def test_parsers():
    assert parse_bg_color("#FF8000") == ((255, 128, 0), False) and parse_bg_color("none") == ((0, 0, 0), True)
    assert parse_halftone("CMYK").mode == "cmyk" and parse_halftone("dominant-6").n == 6 and parse_halftone("").mode == "off"
    assert parse_screening("FM") == "fm" and parse_size("300x200") == parse_size("300×200") == (300, 200)
    for f, s in ((parse_bg_color, "red"), (parse_halftone, "dominant-1"), (parse_screening, "pm"), (parse_size, "0x3")):
        with pytest.raises(ValueError):
            f(s)


def test_command_line_parameters(tmp_path):
    a = parser().parse_args(["--halftone", "cmyk", "--shape", "polygon", "--polygon-sides", "40", "--bg", "black"])
    p = to_params(a)
    assert (p.algorithm, p.dot_shape.sides, p.bg_color) == ("halftone", 12, (0, 0, 0))
    with pytest.raises(ValueError):
        to_params(parser().parse_args(["--algorithm", "halftone"]))
    at = tmp_path / "p.toml"
    assert main(["--save-preset", str(at), "--cols", "33"]) == 0
    assert to_params(parser().parse_args(["--preset", str(at)])).cols == 33


def test_palette_limits_colors(spark):
    dots = placement.grid_dots(density.density_map(canvas.mosaic(spark, 200, 200), 0.7), Params(algorithm="grid", cols=14))
    few = palette.quantize_dots(dots, 4)
    assert few.count() == dots.count()
    assert few.select("r", "g", "b").distinct().count() <= 4 < dots.select("r", "g", "b").distinct().count()
    assert sorted(map(tuple, palette.quantize_dots(dots.limit(3), 4).collect())) == sorted(map(tuple, dots.limit(3).collect()))


def test_diffusion(spark):
    px = canvas.mosaic(spark, 20, 10)
    pal = spark.createDataFrame([("0", 0, 0, 0, 0), ("0", 1, 255, 255, 255)], "img_id string, palette_id int, r int, g int, b int")
    got = palette.diffuse(px, pal)
    assert got.count() == 200 and {tuple(r) for r in got.select("r", "g", "b").distinct().collect()} <= {(0, 0, 0), (255, 255, 255)}
    assert sorted(map(tuple, palette.diffuse(px, pal.limit(0)).collect())) == sorted(map(tuple, px.collect()))


def test_halftone_inks(spark):
    px = canvas.mosaic(spark, 64, 64)
    for p in (Params(algorithm="halftone", halftone=Halftone("cmyk"), halftone_frequency=16), Params(algorithm="halftone", halftone=Halftone("cmyk"), halftone_frequency=16, screening="fm")):
        assert halftone.halftone_dots(px, p).select("r", "g", "b").distinct().count() >= 3
    out = rendering.apply_rgba(canvas.solid(spark, 64, 64, (200, 220, 240)), Params(algorithm="halftone", halftone=Halftone("cmyk"), halftone_frequency=8, transparent=True))
    assert out.where("a = 0").count() > 0 and out.where("a = 255").count() > 0
    with pytest.raises(ValueError):
        rendering.apply(px, Params(algorithm="halftone"))


def test_replayed_screening(spark, sf_dir):
    from dataclasses import replace

    p = Params(algorithm="halftone", halftone=Halftone("cmyk"), halftone_frequency=12.0, rng_seed=5)
    planes = halftone.separate_cmyk(canvas.table_canvas(spark, sf_dir), p.halftone.angles)
    am = halftone.screened(planes, replace(p, halftone_min_radius_ratio=1.0, halftone_max_dot_ratio=0.0))  # radius tells the mean
    got = halftone.screened(planes, replace(p, screening="fm-replay")).collect()
    want = []
    for channel in range(4):
        points = sorted(am.where(F.col("channel") == channel).collect(), key=lambda r: (r.j, r.i))
        ink, means = halftone.INKS[channel], [(48 - r.radius) / 48 for r in points]
        state = (5 * 0x9E3779B97F4A7C15 + (ink[0] << 40 | ink[1] << 24 | ink[2])) % (1 << 64)
        at = iter(sampling.lcg_states(state, np.arange(1, 4 * len(points) + 1)).tolist())
        draw = lambda at=at: (next(at) >> 32) / 4294967295.0
        for r, mean in zip(points, means, strict=True):
            if draw() <= mean:
                dx, dy, u = draw(), draw(), draw()
                radius = 0.096 + (1.7 - 0.096) * (0.7 + 0.3 * u)
                if radius >= 0.5:
                    want.append((channel, r.i, r.j, round(r.x + (dx - 0.5) * 1.6, 6), round(r.y + (dy - 0.5) * 1.6, 6), round(radius, 6)))
    assert sorted((r.channel, r.i, r.j, round(r.x, 6), round(r.y, 6), round(r.radius, 6)) for r in got) == sorted(want)


def test_coverage_is_bounded_and_whole_inside(spark):
    dots = spark.createDataFrame([("0", 0, 10.0, 8.0, 1, 2, 3, 4.0)], "img_id string, dot_id long, x double, y double, r int, g int, b int, radius double")
    size = spark.createDataFrame([("0", 20, 16)], "img_id string, w int, h int")
    for shape in (Shape(), Shape("square"), Shape("ellipse", 2.0, 20.0), Shape("polygon", sides=6)):
        got = {(r.px, r.py): r.cov for r in raster.dot_coverage(dots, size, shape).collect()}
        assert got[10, 8] == 16 and all(1 <= c <= 16 for c in got.values())


@pytest.mark.parametrize("shape", [Shape(), Shape("square"), Shape("ellipse", 2.0, 20.0), Shape("polygon", sides=5)])
def test_drawn_tiles_show_the_listed_coverage(spark, shape):
    dots = spark.createDataFrame([("0", 0, 63.3, 64.2, 10, 20, 30, 9.0), ("0", 1, 140.0, 3.0, 1, 2, 3, 5.0)], "img_id string, dot_id long, x double, y double, r int, g int, b int, radius double")
    size = spark.createDataFrame([("0", 150, 90)], "img_id string, w int, h int")
    want = {(r.px, r.py): int(255 * (1 - r.cov / 16) + r.r * r.cov / 16 + 0.5) if r.cov < 16 else r.r for r in raster.dot_coverage(dots, size, shape).collect()}
    got = raster.render(dots, size, shape, (255, 255, 255)).collect()
    assert len(got) == 150 * 90 and {(r.x, r.y): r.r for r in got if r.r != 255} == {k: v for k, v in want.items() if v != 255}


def test_transparent_svg_and_background(spark):
    px = canvas.checkerboard(spark, 20, 16)
    p = Params(algorithm="grid", cols=5, bg_color=(16, 32, 48))
    lines = [r.element for r in rendering.render_svg(px, p).orderBy("place").collect()]
    assert lines[0].startswith('<svg xmlns="http://www.w3.org/2000/svg" width="20" height="16"') and lines[-1] == "</svg>"
    assert 'fill="#102030"' in lines[1]
    clear = [r.element for r in rendering.render_svg(px, Params(algorithm="grid", cols=5, transparent=True)).collect()]
    assert not any("<rect" in x for x in clear)


def test_gamma_brightens_mixed_grey(spark):
    half = canvas.raster(spark, 16, 16).withColumns({c: F.when(F.col("x") < 8, 0).otherwise(255) for c in "rgb"})
    one = Params(algorithm="grid", cols=1, max_radius_ratio=1.0)
    plain, lin = rendering.compute_dots(half, one).first(), rendering.compute_dots(half, Params(algorithm="grid", cols=1, max_radius_ratio=1.0, gamma_correct=True)).first()
    assert 120 <= plain.r <= 128 and lin.r >= 160


def test_files_round_trip(spark, tmp_path):
    px = canvas.mosaic(spark, 50, 40)
    png = sinks.encode_png(px).select(F.lit(str(tmp_path / "in" / "a.png")).alias("path"), "png")
    sinks.write_files(png, "path", "png")
    (tmp_path / "in" / "bad.png").write_bytes(b"no image")
    (tmp_path / "in" / "note.txt").write_text("no")
    assert [r.path.rsplit("/", 1)[1] for r in canvas.list_images(spark, str(tmp_path / "in")).collect()] == ["a.png", "bad.png"]
    assert canvas.list_images(spark, str(tmp_path / "in" / "*.txt")).count() == 1
    back = canvas.read_images(spark, str(tmp_path / "in"))
    assert sorted(map(tuple, back.select("x", "y", "r", "g", "b").collect())) == sorted(map(tuple, px.select("x", "y", "r", "g", "b").collect()))


def test_command_line_writes(spark, tmp_path):
    sinks.write_files(sinks.encode_png(canvas.mosaic(spark, 30, 20)).select(F.lit(str(tmp_path / "b.png")).alias("path"), "png"), "path", "png")
    assert main(["-i", str(tmp_path / "b.png"), "-o", f"{tmp_path}/out-{{stem}}.svg", "--svg", "--algorithm", "grid", "--cols", "6", "--preview", "15x15"]) == 0
    assert (tmp_path / "out-b.svg").read_text().startswith('<svg xmlns="http://www.w3.org/2000/svg" width="15" height="10"')


def test_output_names(spark):
    df = spark.createDataFrame([("d/a.tar.png", 3)], "p string, n int")
    name = lambda *a, **k: df.select(sinks.output_path(F.col("p"), F.col("n"), *a, **k)).first()[0]
    assert name(1, "output.png", default=True) == "output.png" and name(1, "output.png", svg=True, default=True) == "output.svg"
    assert name(12, "o/{n}_{stem}_{name}") == "o/03_a.tar_a.tar.png"
    assert name(12, "o.png") == "o_03.png" and name(12, "o") == "o_03" and name(12, "o.png", svg=True) == "o_03.svg"


def test_one_decimal_is_exact(spark):
    values = [0.25, 0.35, 0.75, 0.05, 0.15, 22.85, 49.85, 1e-9, 123456.25, -0.25, -3.15, 0.0, 9.95, 9.96]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(color.one_decimal(F.col("v"))).collect()] == [f"{v:.1f}" for v in values]


@pytest.mark.parametrize("kind", ["png", "bmp", "tif", "tiff"])
def test_images_by_extension_in_bands(spark, tmp_path, monkeypatch, kind):
    monkeypatch.setattr(sinks, "BAND", 100)  # five rows of 19 pixels
    px = canvas.mosaic(spark, 19, 33)
    sinks.write_files(sinks.encode(px, kind).select(F.lit(str(tmp_path / f"a.{kind}")).alias("path"), "data"), "path", "data")
    got = canvas.read_images(spark, str(tmp_path))
    cols = ["x", "y", "r", "g", "b"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, px.select(*cols).collect()))
    if kind == "png":
        clear = px.withColumn("a", F.col("x") * 3)
        sinks.write_files(sinks.encode(clear, kind).select(F.lit(str(tmp_path / "b.png")).alias("path"), "data"), "path", "data")
        got = canvas.read_images(spark, str(tmp_path / "b.png"))
        assert sorted(map(tuple, got.select(*cols, "a").collect())) == sorted(map(tuple, clear.select(*cols, "a").collect()))


def test_jpeg_and_formats_that_are_refused(spark, tmp_path):
    px = canvas.solid(spark, 16, 16, (200, 100, 50))
    sinks.write_files(sinks.encode(px, "jpg").select(F.lit(str(tmp_path / "a.jpg")).alias("path"), "data"), "path", "data")
    assert (tmp_path / "a.jpg").read_bytes()[:2] == b"\xff\xd8"
    got = canvas.read_images(spark, str(tmp_path)).select("r", "g", "b").distinct().collect()
    assert all(abs(a - b) <= 4 for r in got for a, b in zip(r, (200, 100, 50), strict=True))
    for kind, image in (("webp", px), ("jpg", px.withColumn("a", F.lit(9))), ("bmp", px.withColumn("a", F.lit(9)))):
        with pytest.raises(ValueError):
            sinks.encode(image, kind)


def test_equal_file_names_in_several_folders(spark, tmp_path):
    from tessella.__main__ import convert

    for k, color in (("one", (0, 0, 0)), ("two", (200, 0, 0))):
        sinks.write_files(sinks.encode(canvas.solid(spark, 24, 24, color)).select(F.lit(str(tmp_path / k / "a.png")).alias("path"), "data"), "path", "data")
    p = Params(algorithm="grid", cols=4, bg_color=(128, 128, 128), transparent=True)
    assert convert(spark, f"{tmp_path}/*/a.png", f"{tmp_path}/out/{{n}}-{{stem}}.bmp", p, False, None) == 2
    darkest = {}
    for r in canvas.read_images(spark, f"{tmp_path}/out").groupBy("img_id").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).collect():
        darkest[r.img_id.rpartition("/")[2]] = (r.lo, r.hi)
    assert darkest == {"0-a.bmp": (0, 128), "1-a.bmp": (128, 200)}


def test_rounds_can_be_shown(spark):
    px, seen = canvas.checkerboard(spark, 16, 12), []
    for algorithm, rounds in (("voronoi", 2), ("kmeans", 2), ("grid", 1)):
        rendering.compute_dots(px, Params(algorithm=algorithm, num_points=6, cols=4, iterations=2), show=lambda i, n, image: seen.append((i, n, image.count())))
        assert seen == [(i + 1, rounds, 16 * 12) for i in range(rounds)]
        seen.clear()


def test_tiles_keep_only_centres_that_can_win(spark, monkeypatch):
    """Clusters of centres far from most tiles: sums equal those over all pairs."""
    monkeypatch.setattr(assign, "TILE", 16)
    rng = np.random.default_rng(3)
    px = canvas.mosaic(spark, 70, 50)
    at = np.r_[rng.uniform(0, 6, (40, 2)), rng.uniform(0, 50, (5, 2))]
    seeds = spark.createDataFrame([("0", i, float(x), float(y)) for i, (x, y) in enumerate(at)], "img_id string, seed_id long, x double, y double")
    got = {r.seed_id: (r.x, r.y) for r in placement.lloyd_step(px.withColumn("density", F.lit(1.0)), seeds, 0.7).collect()}
    x, y = np.meshgrid(np.arange(70) + 0.5, np.arange(50) + 0.5)
    best = ((x.ravel()[:, None] - at[:, 0]) ** 2 + (y.ravel()[:, None] - at[:, 1]) ** 2).argmin(1)
    for i in range(len(at)):
        own = best == i
        want = (x.ravel()[own].mean(), y.ravel()[own].mean()) if own.any() else tuple(at[i])
        assert got[i] == pytest.approx(want)
    near = {r.seed_id: r.nn for r in assign.nn_radius(seeds).collect()}
    d = np.sqrt(((at[:, None] - at) ** 2).sum(2)) + np.diag([np.inf] * len(at))
    assert all(near[i] == pytest.approx(d[i].min() / 2) for i in range(len(at)))
    found = {(r.x, r.y): r.seed_id for r in assign.nearest_seed(px, seeds).collect()}
    assert all(found[int(a), int(b)] == k for a, b, k in zip(x.ravel(), y.ravel(), best, strict=True))
