"""Registered queries, each with the DuckDB SQL of the same result where SQL can express it.

Pixels come from a 64 by 48 canvas over ``lineitem``; ``oracle`` has the SQL of the shared parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import color, geometry
from tessella.operators import assign, density, halftone, palette, placement, raster, sampling, svg
from tessella.params import Halftone, Params, Shape
from tessella.plans import oracle as O
from tessella.plans import rendering
from tessella.sources import canvas, sinks
from tessella.sources.scratch import cut_lineage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(*names: str, digits: int = 6) -> list:
    return [F.round(n, digits).alias(n) for n in names]


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canvas.table_canvas(spark, sf_dir)


def detailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.density_map(px(spark, sf_dir), 0.7)


def small_dots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """48 dots, one for each 8 by 8 cell."""
    return placement.grid_dots(detailed(spark, sf_dir), O.GRID8)


def seeds(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    return spark.range(100).select(F.lit("0").alias("img_id"), i.alias("seed_id"), ((i * 37) % 64 + 0.5).cast("double").alias("x"), ((i * 29) % 48 + 0.5).cast("double").alias("y"))


def centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    at = spark.range(24).select(i.alias("center_id"), ((i * 17) % 64).cast("int").alias("x"), ((i * 11) % 48).cast("int").alias("y"))
    return px(spark, sf_dir).join(F.broadcast(at), ["x", "y"]).select("img_id", "center_id", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "r", "g", "b")))


def four_colors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("0", i, *c) for i, c in enumerate(O.COLORS)], "img_id string, palette_id int, r int, g int, b int")


# Pixels


@query(f"WITH {O.CANVAS} SELECT x, y, round({O.LUM}, 6) AS luminance FROM canvas")
def luminance(spark, sf_dir):
    return px(spark, sf_dir).select("x", "y", F.round(color.luminance(), 6).alias("luminance"))


@query(f"WITH {O.CANVAS}, t AS (SELECT *, (x * 7 + y * 5) % 256 AS a FROM canvas) SELECT x, y, {O.over('r', 10)} AS r, {O.over('g', 200)} AS g, {O.over('b', 255)} AS b FROM t")
def flatten_alpha(spark, sf_dir):
    src = px(spark, sf_dir).withColumn("a", (F.col("x") * 7 + F.col("y") * 5) % 256)
    return rendering.flatten(src, (10, 200, 255)).select("x", "y", "r", "g", "b")


@query(f"SELECT CAST(range AS INT) AS v, {O.TO_LINEAR} AS linear FROM range(256)")
def srgb_to_linear(spark, sf_dir):
    return spark.range(256).select(F.col("id").cast("int").alias("v"), color.srgb_to_linear("id").alias("linear"))


@query(f"SELECT CAST(range AS INT) AS v, {O.TO_SRGB} AS srgb FROM range(256)")
def linear_to_srgb(spark, sf_dir):
    return spark.range(256).select(F.col("id").cast("int").alias("v"), color.linear_to_srgb("id").alias("srgb"))


@query(f"WITH {O.DENSITY} SELECT x, y, round({O.radius(O.LUM, 'density', '48.0', Params())}, 6) AS radius FROM detailed")
def dot_radius(spark, sf_dir):
    side = F.least("w", "h").cast("double")
    return detailed(spark, sf_dir).select("x", "y", F.round(geometry.dot_radius(color.luminance(), F.col("density"), side, Params()), 6).alias("radius"))


@query(f"WITH {O.CANVAS} SELECT x, y, (0.2126*r + 0.7152*g + 0.0722*b) > 127.5 AS is_light FROM canvas")
def bg_is_light(spark, sf_dir):
    return px(spark, sf_dir).select("x", "y", (color.luminance() * 255.0 > 127.5).alias("is_light"))


@query(f"WITH {O.DENSITY} SELECT x, y, CAST(trunc(least(density * 255, 255)) AS INT) AS v FROM detailed")
def density_gray(spark, sf_dir):
    return rendering.density_image(px(spark, sf_dir), 0.7).select("x", "y", "v")


@query(O.DOWNSCALE)
def downscale_triangle(spark, sf_dir):
    return raster.downscale(px(spark, sf_dir), 20, 20).select("w", "h", "x", "y", "r", "g", "b")


@query(f"WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '#' ELSE '' END || printf('%06x', CAST(p_partkey * 7919 % 16777216 AS BIGINT)) AS c FROM part) SELECT p_partkey, {O.HEX_PARTS} FROM t")
def parse_hex_color(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    c = F.concat(F.when(F.col("p_partkey") % 3 == 0, "#").otherwise(""), F.format_string("%06x", F.col("p_partkey") * 7919 % 16777216))
    r, g, b = color.parse_hex(c)
    return part.select("p_partkey", r.alias("r"), g.alias("g"), b.alias("b"))


@query(f"WITH {O.CANVAS}, n AS (SELECT CAST(range AS INT) AS sides FROM range(3, 9)) SELECT x, y, sides, {O.polygon('(x - 31.3)', '(y - 23.5)', '20.3', 'sides')} AS inside FROM canvas, n")
def point_in_polygon(spark, sf_dir):
    at = px(spark, sf_dir)
    x, y = F.col("x") - 31.3, F.col("y") - 23.5
    each = [F.struct(F.lit(n).alias("sides"), geometry.in_polygon(x, y, F.lit(20.3), n).alias("inside")) for n in range(3, 9)]
    return at.select("x", "y", F.explode(F.array(*each)).alias("s")).select("x", "y", "s.*")


@query(O.SHAPE_COVERAGE)
def shape_coverage(spark, sf_dir):
    dots, at = cut_lineage(small_dots(spark, sf_dir)), rendering.sizes(px(spark, sf_dir))
    out = None
    for name, shape in O.SHAPES.items():
        one = raster.dot_coverage(dots, at, shape).select(F.lit(name).alias("shape"), "dot_id", "px", "py", "cov")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {O.CANVAS}, t AS (SELECT *, (x * 7 + y * 5) % 256 AS a, CASE WHEN (x // 8 + y // 8) % 2 = 0 THEN 240 ELSE 200 END AS bg FROM canvas) SELECT x, y, {', '.join(f'CAST(trunc({c}*(a/255.0) + bg*(1 - a/255.0) + 0.5) AS INT) AS {c}' for c in 'rgb')} FROM t")
def alpha_checker(spark, sf_dir):
    src = px(spark, sf_dir).withColumn("a", (F.col("x") * 7 + F.col("y") * 5) % 256)
    a, board = F.col("a") / 255.0, color.checkerboard()
    return src.select("x", "y", *(color.byte(F.col(c) * a + board * (F.lit(1.0) - a) + 0.5).alias(c) for c in "rgb"))


@query(f"WITH {O.CANVAS} SELECT x, y, r, r AS g, r AS b, 255 AS a FROM canvas")
def gray_to_rgba(spark, sf_dir):
    return px(spark, sf_dir).select("x", "y", "r", F.col("r").alias("g"), F.col("r").alias("b"), F.lit(255).alias("a"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN printf('%.1f', ms / 1000.0) || 's' ELSE (ms // 60000) || 'm ' || (ms % 60000 // 1000) || 's' END AS text FROM (SELECT l_orderkey, l_linenumber, (l_partkey * 37 + l_suppkey * l_suppkey * 11) % 200003 AS ms FROM lineitem)")
def format_duration(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    ms = (F.col("l_partkey") * 37 + F.col("l_suppkey") * F.col("l_suppkey") * 11) % 200003
    return rows.select("l_orderkey", "l_linenumber", color.duration(ms).alias("text"))


# Neighbourhoods


@query(f"WITH {O.DENSITY} SELECT x, y, round(variance, 6) AS variance FROM lv")
def local_variance(spark, sf_dir):
    return density.local_variance(px(spark, sf_dir)).select("x", "y", *r6("variance"))


@query(f"WITH {O.DENSITY} SELECT x, y, round(density, 6) AS density FROM detailed")
def density_map(spark, sf_dir):
    return detailed(spark, sf_dir).select("x", "y", *r6("density"))


@query(O.CLAMPED)
def local_variance_clamped(spark, sf_dir):
    return density.local_variance_clamped(px(spark, sf_dir)).select("x", "y", *r6("variance"))


@query(f"WITH {O.CANVAS} SELECT a.x, a.y, {', '.join(f'CAST(sum(b.{c}) AS BIGINT) AS s{c}, CAST(sum(b.{c}*b.{c}) AS BIGINT) AS q{c}' for c in 'rgb')} FROM canvas a JOIN canvas b ON b.x <= a.x AND b.y <= a.y GROUP BY a.x, a.y")
def summed_area_table(spark, sf_dir):
    return density.prefix_sums(px(spark, sf_dir)).drop("img_id")


def _rects(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    return spark.range(200).select(F.lit("0").alias("img_id"), i.alias("rect_id"), ((i * 7) % 40).cast("int").alias("x0"), ((i * 5) % 30).cast("int").alias("y0"), ((i * 7) % 40 + 1 + i % 24).cast("int").alias("x1"), ((i * 5) % 30 + 1 + i % 18).cast("int").alias("y1"))


@query(f"WITH {O.CANVAS}, {O.RECTS} SELECT rect_id, {', '.join(f'CAST(sum({c}) AS BIGINT) AS s{c}' for c in 'rgb')} FROM rects JOIN canvas ON x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY rect_id")
def sat_rect_query(spark, sf_dir):
    return density.rect_query(density.prefix_sums(px(spark, sf_dir)), _rects(spark)).select("rect_id", "sr", "sg", "sb")


@query(f"WITH {O.CANVAS} SELECT i, j, CAST(sum(r) AS BIGINT) AS sr, CAST(sum(g) AS BIGINT) AS sg, CAST(sum(b) AS BIGINT) AS sb, count(*) AS n FROM (SELECT *, x // 16 AS i, y // 12 AS j FROM canvas) GROUP BY i, j")
def rect_sum(spark, sf_dir):
    at = px(spark, sf_dir).withColumns({"i": F.floor(F.col("x") / 16).cast("int"), "j": F.floor(F.col("y") / 12).cast("int")})
    return at.groupBy("i", "j").agg(*(F.sum(F.col(c).cast("long")).alias(f"s{c}") for c in "rgb"), F.count("*").alias("n"))


@query(f"WITH {O.CANVAS}, t AS (SELECT *, x // 16 AS i, y // 12 AS j FROM canvas), m AS (SELECT i, j, sum(r)//count(*) AS ar, sum(g)//count(*) AS ag, sum(b)//count(*) AS ab FROM t GROUP BY i, j) SELECT i, j, round(avg((r-ar)*(r-ar) + (g-ag)*(g-ag) + (b-ab)*(b-ab)), 6) AS variance FROM t JOIN m USING (i, j) GROUP BY i, j")
def cell_variance(spark, sf_dir):
    at = px(spark, sf_dir).withColumns({"i": F.floor(F.col("x") / 16).cast("int"), "j": F.floor(F.col("y") / 12).cast("int")})
    s = at.groupBy("i", "j").agg(F.count("*").alias("n"), *(F.sum(F.col(c).cast("long")).alias(f"s{c}") for c in "rgb"), *(F.sum((F.col(c) * F.col(c)).cast("long")).alias(f"q{c}") for c in "rgb"))
    mean = {c: F.floor(F.col(f"s{c}") / F.col("n")) for c in "rgb"}
    each = [F.col(f"q{c}") - mean[c] * F.col(f"s{c}") * 2 + F.col("n") * mean[c] * mean[c] for c in "rgb"]
    return s.select("i", "j", F.round((each[0] + each[1] + each[2]).cast("double") / F.col("n"), 6).alias("variance"))


@query(O.DISK)
def disk_average(spark, sf_dir):
    values = px(spark, sf_dir).withColumn("v", F.col("r") / 255.0)
    i = F.col("id")
    at = spark.range(60).select(F.lit("0").alias("img_id"), i.alias("id"), ((i * 13) % 64 + 0.25).cast("double").alias("cx"), ((i * 7) % 48 + 0.75).cast("double").alias("cy"), (i % 5 * 0.9).cast("double").alias("radius"))
    return density.disk_average(values, at, "v").select("id", *r6("mean"))


# Dots


@query(f"WITH {O.DENSITY}, {O.grid(O.GRID20)} SELECT dot_id, round(x, 6) AS x, round(y, 6) AS y, r, g, b, round(radius, 6) AS radius FROM dots")
def grid_dots(spark, sf_dir):
    return placement.grid_dots(detailed(spark, sf_dir), O.GRID20).select("dot_id", *r6("x", "y", "radius"), "r", "g", "b")


@query(f"WITH {O.DENSITY}, {O.grid(O.GRID20)} SELECT dot_id, round(32 + (x-32)*cos(radians(30)) - (y-24)*sin(radians(30)), 6) AS x, round(24 + (x-32)*sin(radians(30)) + (y-24)*cos(radians(30)), 6) AS y, r, g, b, round(radius, 6) AS radius FROM dots")
def grid_dots_rotated(spark, sf_dir):
    from dataclasses import replace

    return placement.grid_dots(detailed(spark, sf_dir), replace(O.GRID20, grid_angle_deg=30.0)).select("dot_id", *r6("x", "y", "radius"), "r", "g", "b")


@query(f"WITH {O.CANVAS}, {O.SEEDS} SELECT c.x, c.y, CAST(min_by(seed_id, {O.SEED_KEY}) AS BIGINT) AS seed_id, round(min({O.SEED_D2}), 6) AS d2 FROM canvas c, seeds s GROUP BY c.x, c.y")
def nearest_seed(spark, sf_dir):
    return assign.nearest_seed(px(spark, sf_dir), seeds(spark)).select("x", "y", "seed_id", *r6("d2"))


@query(f"WITH {O.CANVAS}, {O.CENTERS} SELECT c.x, c.y, CAST(min_by(center_id, struct_pack(d := {O.CENTER_D2}, i := center_id)) AS BIGINT) AS center_id FROM canvas c, centers s GROUP BY c.x, c.y")
def nearest_center_5d(spark, sf_dir):
    return assign.nearest_center(px(spark, sf_dir), centers(spark, sf_dir)).select("x", "y", "center_id")


@query(f"WITH {O.SEEDS} SELECT a.seed_id, round(sqrt(min((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y))) / 2, 6) AS nn FROM seeds a JOIN seeds b ON a.seed_id <> b.seed_id GROUP BY a.seed_id")
def nn_radius(spark, sf_dir):
    return assign.nn_radius(seeds(spark)).select("seed_id", *r6("nn"))


@query(f"WITH {O.CANVAS}, {O.PALETTE} SELECT x, y, CAST(min_by(palette_id, struct_pack(d := {O.COLOR_D2}, i := palette_id)) AS INT) AS palette_id FROM canvas c, pal p GROUP BY x, y")
def nearest_palette(spark, sf_dir):
    return assign.nearest_color(px(spark, sf_dir), four_colors(spark)).select("x", "y", "palette_id")


@query(O.lcg(300))
def lcg_sequence(spark, sf_dir):
    return sampling.lcg_sequence(spark, 300, 3735928559).select("i", F.round("u", 9).alias("u"))


@query(O.SAMPLE)
def importance_sample(spark, sf_dir):
    return sampling.importance_sample(detailed(spark, sf_dir), 60, 99).select("sample_id", "x", "y")


@query(O.lloyd(1))
def lloyd_step(spark, sf_dir):
    return placement.lloyd_step(detailed(spark, sf_dir), seeds(spark), 0.7).select("seed_id", *r6("x", "y", digits=5))


@query(O.lloyd(2))
def lloyd_two_steps(spark, sf_dir):
    at = detailed(spark, sf_dir)
    once = cut_lineage(placement.lloyd_step(at, seeds(spark), 0.7))
    return placement.lloyd_step(at, once, 0.7).select("seed_id", *r6("x", "y", digits=5))


@query(O.VORONOI)
def voronoi_dots(spark, sf_dir):
    at = detailed(spark, sf_dir)
    return placement.dots_from_seeds(at, cut_lineage(placement.lloyd_step(at, seeds(spark), 0.7)), Params()).select("dot_id", *r6("x", "y", "radius", digits=5), "r", "g", "b")


@query(O.kmeans(1))
def kmeans_step(spark, sf_dir):
    return placement.kmeans_step(px(spark, sf_dir), centers(spark, sf_dir)).select("center_id", *r6("x", "y", "r", "g", "b", digits=5))


@query(O.KMEANS_DOTS)
def kmeans_dots(spark, sf_dir):
    at = detailed(spark, sf_dir)
    once = cut_lineage(placement.kmeans_step(at, centers(spark, sf_dir)))
    twice = cut_lineage(placement.kmeans_step(at, once))
    return placement.dots_from_centers(at, twice, Params()).select("dot_id", *r6("x", "y", "radius", digits=5), "r", "g", "b")


@query(O.quadtree("SELECT path, x0, y0, nw, nh, r, g, b, round(variance, 6) AS variance FROM leaves"))
def quadtree_leaves(spark, sf_dir):
    return placement.quadtree_leaves(px(spark, sf_dir), Params()).select("path", "x0", "y0", "nw", "nh", "r", "g", "b", *r6("variance"))


@query(O.quadtree(O.QUAD_DOTS))
def quadtree_dots(spark, sf_dir):
    return placement.quadtree_dots(px(spark, sf_dir), Params()).select("dot_id", *r6("x", "y", "radius"), "r", "g", "b")


# Palettes and inks


@query(O.palette_of_dots())
def palette_centers(spark, sf_dir):
    return palette.palette_of_dots(small_dots(spark, sf_dir), 6).select("palette_id", "r", "g", "b")


@query(O.palette_of_dots(2))
def palette_two_rounds(spark, sf_dir):
    return palette.palette_of_dots(small_dots(spark, sf_dir), 6, rounds=2).select("palette_id", "r", "g", "b")


@query(O.dominant())
def dominant_colors(spark, sf_dir):
    return palette.dominant_colors(px(spark, sf_dir), 5).select("palette_id", "r", "g", "b")


@query(O.dominant(2))
def dominant_two_rounds(spark, sf_dir):
    return palette.dominant_colors(px(spark, sf_dir), 5, rounds=2).select("palette_id", "r", "g", "b")


@query(f"WITH {O.DENSITY}, {O.grid(O.GRID20)} SELECT count(*) AS n_dots, count(DISTINCT (r, g, b)) AS n_colors FROM dots")
def distinct_colors(spark, sf_dir):
    return placement.grid_dots(detailed(spark, sf_dir), O.GRID20).agg(F.count("*").alias("n_dots"), F.countDistinct("r", "g", "b").alias("n_colors"))


@query(O.QUANTIZED)
def quantize_dots(spark, sf_dir):
    return palette.quantize_dots(small_dots(spark, sf_dir), 6).select("dot_id", "r", "g", "b")


@query(f"WITH {O.CANVAS}, {O.CMYK} SELECT x, y, channel, round(coverage, 9) AS coverage FROM planes")
def cmyk_separation(spark, sf_dir):
    return halftone.separate_cmyk(px(spark, sf_dir), Halftone().angles).select("x", "y", "channel", *r6("coverage", digits=9))


@query(O.SEPARATED)
def dominant_separation(spark, sf_dir):
    return halftone.separate_dominant(px(spark, sf_dir), 5, 15.0).select("x", "y", "channel", *r6("coverage"), "angle")


def _screen(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("0", 64, 48, i, *c, float(a)) for i, (c, a) in enumerate(zip(halftone.INKS, Halftone().angles, strict=True))], "img_id string, w int, h int, channel int, r int, g int, b int, angle double")


@query(f"WITH {O.LATTICE} SELECT channel, i, j, round(cx, 6) AS cx, round(cy, 6) AS cy FROM lattice")
def screen_lattice(spark, sf_dir):
    return halftone.lattice(_screen(spark), O.CMYK12).select("channel", "i", "j", *r6("cx", "cy"))


@query(O.halftone("am"))
def halftone_am(spark, sf_dir):
    return halftone.screened(halftone.separate_cmyk(px(spark, sf_dir), Halftone().angles), O.CMYK12).select("channel", "i", "j", *r6("x", "y", "radius"))


@query(O.halftone("fm"))
def halftone_fm(spark, sf_dir):
    from dataclasses import replace

    return halftone.screened(halftone.separate_cmyk(px(spark, sf_dir), Halftone().angles), replace(O.CMYK12, screening="fm", rng_seed=7)).select("channel", "i", "j", *r6("x", "y", "radius"))


@query(O.fm_replayed())
def halftone_fm_replay(spark, sf_dir):
    from dataclasses import replace

    return halftone.screened(halftone.separate_cmyk(px(spark, sf_dir), Halftone().angles), replace(O.CMYK12, screening="fm-replay", rng_seed=7)).select("channel", "i", "j", *r6("x", "y", "radius"))


@query(O.halftone("am", "SELECT CAST(row_number() OVER (ORDER BY channel, j, i) - 1 AS BIGINT) AS dot_id, round(x, 6) AS x, round(y, 6) AS y, r, g, b, round(radius, 6) AS radius FROM final"))
def halftone_dots(spark, sf_dir):
    return halftone.halftone_dots(px(spark, sf_dir), O.CMYK12).select("dot_id", *r6("x", "y", "radius"), "r", "g", "b")


# Compositing and output


@query(O.coverage_of("circle", "SELECT dot_id, px, py, cov FROM covered"))
def dot_coverage(spark, sf_dir):
    return raster.dot_coverage(small_dots(spark, sf_dir), rendering.sizes(px(spark, sf_dir)), Shape()).select("dot_id", "px", "py", "cov")


@query(f"WITH {O.DENSITY}, {O.grid(O.GRID8)} SELECT dot_id, CAST(row_number() OVER (ORDER BY radius DESC, dot_id) AS INT) AS place FROM dots")
def painter_order(spark, sf_dir):
    return raster.painter_order(small_dots(spark, sf_dir)).select("dot_id", "place")


@query(O.render("over"))
def render_rgb(spark, sf_dir):
    return raster.render(small_dots(spark, sf_dir), rendering.sizes(px(spark, sf_dir)), Shape(), (255, 255, 255)).select("x", "y", "r", "g", "b")


@query(O.render("rgba"))
def render_rgba(spark, sf_dir):
    return raster.render_rgba(small_dots(spark, sf_dir), rendering.sizes(px(spark, sf_dir)), Shape(), (255, 255, 255), True).select("x", "y", "r", "g", "b", "a")


@query(O.render("multiply"))
def render_multiply(spark, sf_dir):
    return raster.render_multiply(small_dots(spark, sf_dir), rendering.sizes(px(spark, sf_dir)), Shape(), (255, 255, 255), False).select("x", "y", "r", "g", "b", "a")


@query(O.diffused())
def dither_fs(spark, sf_dir):
    return palette.diffuse(px(spark, sf_dir), four_colors(spark)).select("x", "y", "r", "g", "b")


@query(O.SVG)
def svg_elements(spark, sf_dir):
    dots = cut_lineage(placement.grid_dots(detailed(spark, sf_dir), O.GRID20))
    each = [svg.svg_elements(dots, shape).select(F.lit(name).alias("shape"), "place", "element") for name, shape in O.SHAPES.items()]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])


@query("SELECT p_partkey, 'out/' || printf('%0' || length(CAST((SELECT count(*) FROM part) AS VARCHAR)) || 'd', p_partkey) || '-' || regexp_replace(f, '\\.[^.]*$', '') || '.svg' AS path FROM (SELECT p_partkey, 'p' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.tar.png' ELSE '.jpeg' END AS f FROM part)")
def output_path(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    name = F.concat(F.lit("in/p"), F.col("p_partkey"), F.when(F.col("p_partkey") % 2 == 0, ".tar.png").otherwise(".jpeg"))
    return part.select("p_partkey", sinks.output_path(name, F.col("p_partkey"), part.count(), "out/{n}-{stem}.png", svg=True).alias("path"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a/b.PNG' WHEN 1 THEN 'a.d/b.png' WHEN 2 THEN 'a/b.png' ELSE 'a/b.svg' END AS path FROM part")
def ensure_extension(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey") % 4
    given = F.when(k == 0, "a/b.PNG").when(k == 1, "a.d/b").when(k == 2, "a/b.txt").otherwise("a/b.svg")
    return part.select("p_partkey", sinks.ensure_extension(given, "png").alias("path"))


@query("SELECT * FROM (VALUES ('a.png', 5), ('b.JPG', 3)) t(name, length)")
def img_list(spark, sf_dir):
    """A folder's image files, by name; what is no image or lies deeper is left out."""
    from tessella.sources.scratch import shared_folder

    folder = shared_folder(spark, "listing")
    rows = [("b.JPG", "abc"), ("a.png", "abcde"), ("c.txt", "x"), ("deep/d.png", "x")]
    sinks.write_files(spark.createDataFrame([(f"{folder}/{n}", t) for n, t in rows], "path string, data string"), "path", "data")
    return canvas.list_images(spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").cast("int").alias("length"))


@query()
def write_png(spark, sf_dir):
    return sinks.encode_png(px(spark, sf_dir)).select("w", "h", F.length("png").alias("n_bytes"))


@query()
def image_round_trip(spark, sf_dir):
    """PNG files written to the shared folder, listed and read back."""
    from tessella.sources.scratch import shared_folder

    folder = shared_folder(spark, "images")
    files = sinks.encode_png(px(spark, sf_dir)).select(F.lit(f"{folder}/canvas.png").alias("path"), "png")
    sinks.write_files(files, "path", "png")
    return canvas.read_images(spark, folder).select("x", "y", "r", "g", "b", "a")


@query()
def apply_voronoi(spark, sf_dir):
    return rendering.apply(px(spark, sf_dir), Params(num_points=60, iterations=2)).select("x", "y", "r", "g", "b")


@query()
def apply_kmeans_gamma(spark, sf_dir):
    return rendering.apply(px(spark, sf_dir), Params(algorithm="kmeans", num_points=40, iterations=2, gamma_correct=True)).select("x", "y", "r", "g", "b")


@query()
def apply_halftone_dominant(spark, sf_dir):
    p = Params(algorithm="halftone", halftone=Halftone(mode="dominant", n=4), halftone_frequency=12.0)
    return rendering.apply_rgba(px(spark, sf_dir), p).select("x", "y", "r", "g", "b", "a")


@query()
def apply_palette_dither(spark, sf_dir):
    return rendering.apply(px(spark, sf_dir), Params(algorithm="grid", cols=16, palette_size=4, dithering=True)).select("x", "y", "r", "g", "b")
