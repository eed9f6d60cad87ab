"""DuckDB SQL of the shared parts of the registered queries, written apart from the operators and mostly in another way:
windows as self-joins, nearest neighbours as all pairs, trees as recursion."""

from __future__ import annotations

import math

from tessella.params import Halftone, Params, Shape

GRID20, GRID8 = Params(algorithm="grid", cols=20), Params(algorithm="grid", cols=8)
CMYK12 = Params(algorithm="halftone", halftone=Halftone(mode="cmyk"), halftone_frequency=12.0)
SHAPES = {"circle": Shape(), "square": Shape("square"), "ellipse": Shape("ellipse", aspect=2.0, angle_deg=30.0), "polygon": Shape("polygon", sides=5)}
COLORS = ((0, 0, 0), (255, 255, 255), (200, 30, 30), (30, 120, 160))

CANVAS = """grid0 AS (SELECT CAST(a.range AS INT) AS x, CAST(b.range AS INT) AS y FROM range(64) a, range(48) b),
cell0 AS (SELECT CAST(l_orderkey % 64 AS INT) AS x, CAST(l_partkey % 48 AS INT) AS y,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS p,
  CAST(sum(CAST(l_linenumber AS BIGINT) * 37 + l_suppkey) AS BIGINT) AS s FROM lineitem GROUP BY 1, 2),
canvas AS (SELECT x, y,
  CAST((x * 3 + coalesce(q, 0) % CASE WHEN x < 32 THEN 8 ELSE 64 END) % 256 AS INT) AS r,
  CAST((y * 4 + coalesce(p, 0) % CASE WHEN y < 24 THEN 8 ELSE 64 END) % 256 AS INT) AS g,
  CAST((x + y + coalesce(s, 0) % CASE WHEN x < 32 THEN 4 ELSE 128 END) % 256 AS INT) AS b
  FROM grid0 LEFT JOIN cell0 USING (x, y))"""

LUM = "((r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE) / 255.0::DOUBLE)"


def var(of: str, n: str = "count(*)") -> str:
    each = [f"greatest(sum({of}.{c}*{of}.{c})::DOUBLE / {n} - pow(sum({of}.{c})::DOUBLE / {n}, 2), 0)" for c in "rgb"]
    return f"(({' + '.join(each)}) / 3.0)"


DENSITY = f"""{CANVAS},
lv AS (SELECT a.x, a.y, {var("b")} AS variance FROM canvas a JOIN canvas b ON b.x BETWEEN a.x - 4 AND a.x + 4 AND b.y BETWEEN a.y - 4 AND a.y + 4 GROUP BY a.x, a.y),
detailed AS (SELECT x, y, r, g, b, 1 - 0.7::DOUBLE * (1 - sqrt(variance / (SELECT greatest(max(variance), 1e-6) FROM lv))) AS density FROM canvas JOIN lv USING (x, y))"""

CLAMPED = f"""WITH {CANVAS}, d AS (SELECT CAST(range AS INT) AS d FROM range(-4, 5))
SELECT a.x, a.y, round({var("b", "81.0")}, 6) AS variance FROM canvas a, d i, d j, canvas b
WHERE b.x = least(greatest(a.x + i.d, 0), 63) AND b.y = least(greatest(a.y + j.d, 0), 47) GROUP BY a.x, a.y"""


def over(c: str, bg: int) -> str:
    return f"CAST(trunc({c} * (a / 255.0::DOUBLE) + {bg} * (1 - a / 255.0::DOUBLE)) AS INT)"


TO_LINEAR = "CAST(floor(CASE WHEN range / 255.0 <= 0.04045 THEN range / 255.0 / 12.92 ELSE pow((range / 255.0 + 0.055) / 1.055, 2.4) END * 255 + 0.5) AS INT)"
TO_SRGB = "CAST(floor(CASE WHEN range / 255.0 <= 0.0031308 THEN range / 255.0 * 12.92 ELSE pow(range / 255.0, 1 / 2.4) * 1.055 - 0.055 END * 255 + 0.5) AS INT)"
_DIGIT = "(strpos('0123456789abcdef', substr(replace(c, '#', ''), {}, 1)) - 1)"
HEX_PARTS = ", ".join(f"CAST({_DIGIT.format(at)} * 16 + {_DIGIT.format(at + 1)} AS INT) AS {c}" for at, c in ((1, "r"), (3, "g"), (5, "b")))


def radius(lum: str, d: str, side: str, p: Params) -> str:
    low, high = f"({side}::DOUBLE * {p.min_radius_ratio!r}::DOUBLE)", f"({side}::DOUBLE * {p.max_radius_ratio!r}::DOUBLE)"
    boost = f"(1 + (1 - {d}) * {p.variance_sensitivity!r}::DOUBLE * {p.max_boost - 1.0!r}::DOUBLE)"
    return f"least(({high} - ({high} - {low}) * {lum}) * {boost}, {high} * {p.max_boost!r}::DOUBLE)"


def polygon(x: str, y: str, r: str, n: str) -> str:
    sector = f"(2 * pi() / {n})"
    d = f"sqrt({x}*{x} + {y}*{y})"
    turn = f"fmod(fmod(atan2({y}, {x}), {sector}) + {sector}, {sector})"
    return f"CASE WHEN {d} > {r} THEN false WHEN {d} = 0 THEN true ELSE {d} <= {r} * cos(pi() / {n}) / abs(cos({turn} - pi() / {n})) END"


def _inside(shape: Shape, x: str, y: str) -> str:
    if shape.kind == "circle":
        return f"({x}*{x} + {y}*{y} <= radius*radius)"
    if shape.kind == "square":
        return f"(abs({x}) <= radius AND abs({y}) <= radius)"
    if shape.kind == "ellipse":
        c, s = (f"{v!r}::DOUBLE" for v in (math.cos(math.radians(shape.angle_deg)), math.sin(math.radians(shape.angle_deg))))
        return f"(pow(({x}*{c} + {y}*{s}) / radius, 2) + pow(({y}*{c} - {x}*{s}) / greatest(radius / {shape.aspect}, 1), 2) <= 1)"
    return f"({polygon(x, y, 'radius', str(shape.sides))})"


def grid(p: Params) -> str:
    c = max(64 // p.cols, 1)
    return f"""gd AS (SELECT x // {c} AS i, y // {c} AS j, CAST(sum(r) // count(*) AS INT) AS r, CAST(sum(g) // count(*) AS INT) AS g, CAST(sum(b) // count(*) AS INT) AS b, avg(density) AS d
  FROM detailed WHERE x // {c} < {64 // c} AND y // {c} < {48 // c} GROUP BY x // {c}, y // {c}),
dots AS (SELECT CAST(row_number() OVER (ORDER BY j, i) - 1 AS BIGINT) AS dot_id, (i * {c} + {c} / 2.0)::DOUBLE AS x, (j * {c} + {c} / 2.0)::DOUBLE AS y, r, g, b,
  least({radius(LUM, "d", "48.0", p)}, {c} * 0.4::DOUBLE) AS radius FROM gd)"""


RECTS = "rects AS (SELECT range AS rect_id, range * 7 % 40 AS x0, range * 5 % 30 AS y0, range * 7 % 40 + 1 + range % 24 AS x1, range * 5 % 30 + 1 + range % 18 AS y1 FROM range(200))"

DISK = f"""WITH {CANVAS}, c AS (SELECT range AS id, range * 13 % 64 AS x0, range * 7 % 48 AS y0, (range % 5) * 0.9::DOUBLE AS radius FROM range(60))
SELECT id, round(avg(r / 255.0), 6) AS mean FROM c JOIN canvas ON abs(x - x0) <= ceil(radius) AND abs(y - y0) <= ceil(radius)
WHERE (x - x0) * (x - x0) + (y - y0) * (y - y0) <= radius * radius GROUP BY id"""

DOWNSCALE = f"""WITH {CANVAS}, t AS (SELECT CAST(range AS INT) AS t, (range + 0.5) * 3.2::DOUBLE AS mid FROM range(20)),
wx AS (SELECT t.t AS x, c.y, {", ".join(f"sum({c} * w) / sum(w) AS {c}" for c in "rgb")} FROM (SELECT *, 1 - abs(x + 0.5 - mid) / 3.2::DOUBLE AS w FROM canvas, t) c JOIN t ON t.t = c.t WHERE w > 0 GROUP BY t.t, c.y)
SELECT 20 AS w, 15 AS h, x, t AS y, {", ".join(f"CAST(least(floor(sum({c} * w) / sum(w) + 0.5), 255) AS INT) AS {c}" for c in "rgb")}
FROM (SELECT x, t, r, g, b, 1 - abs(y + 0.5 - mid) / 3.2::DOUBLE AS w FROM wx, t WHERE t < 15) WHERE w > 0 GROUP BY x, t"""

SEEDS = "seeds AS (SELECT range AS seed_id, (range * 37 % 64) + 0.5::DOUBLE AS x, (range * 29 % 48) + 0.5::DOUBLE AS y FROM range(100))"
SEED_D2 = "((s.x-(c.x+0.5::DOUBLE))*(s.x-(c.x+0.5::DOUBLE)) + (s.y-(c.y+0.5::DOUBLE))*(s.y-(c.y+0.5::DOUBLE)))"
SEED_KEY = f"struct_pack(d := {SEED_D2}, i := seed_id)"
CENTERS = "centers AS (SELECT range AS center_id, c.x::DOUBLE AS x, c.y::DOUBLE AS y, c.r::DOUBLE AS r, c.g::DOUBLE AS g, c.b::DOUBLE AS b FROM range(24) JOIN canvas c ON c.x = range * 17 % 64 AND c.y = range * 11 % 48)"
CENTER_D2 = " + ".join(f"pow((c.{k} - s.{k}) / {n}.0::DOUBLE, 2)" for k, n in (("x", 64), ("y", 48), ("r", 255), ("g", 255), ("b", 255)))
PALETTE = f"pal AS (SELECT * FROM (VALUES {', '.join(str((i, *c)) for i, c in enumerate(COLORS))}) t(palette_id, pr, pg, pb))"
COLOR_D2 = "((c.r-p.pr)*(c.r-p.pr) + (c.g-p.pg)*(c.g-p.pg) + (c.b-p.pb)*(c.b-p.pb))"


def _lcg(n: int, seed: int) -> str:
    return f"""l AS (SELECT 0 AS i, {seed}::UHUGEINT AS s UNION ALL SELECT i + 1, (s * 6364136223846793005::UHUGEINT + 1442695040888963407::UHUGEINT) % 18446744073709551616::UHUGEINT FROM l WHERE i < {n}),
draws AS (SELECT CAST(i AS BIGINT) AS i, CAST(s // 4294967296::UHUGEINT AS DOUBLE) / 4294967295.0::DOUBLE AS u FROM l WHERE i > 0)"""


def lcg(n: int) -> str:
    return f"WITH RECURSIVE {_lcg(n, 3735928559)} SELECT i, round(u, 9) AS u FROM draws"


SAMPLE = f"""WITH RECURSIVE {DENSITY}, {_lcg(180, 99)}, cum AS (SELECT x, y, density, sum(density) OVER (ORDER BY y, x ROWS UNBOUNDED PRECEDING) AS hi FROM detailed),
tot AS (SELECT sum(density) AS total FROM detailed),
t AS (SELECT CAST(range AS INT) AS sample_id, b.u AS u1, c.u AS u2, least(greatest((range + 0.5 + (a.u - 0.5) * 0.9) * total / 60, 0), total - 1e-9) AS aim
  FROM range(60) JOIN draws a ON a.i = range * 3 + 1 JOIN draws b ON b.i = range * 3 + 2 JOIN draws c ON c.i = range * 3 + 3, tot)
SELECT sample_id, CAST(trunc(least(x + u1, 63.99)) AS INT) AS x, CAST(trunc(least(y + u2, 47.99)) AS INT) AS y FROM t JOIN cum ON aim >= hi - density AND aim < hi"""


def _lloyd(n: int) -> str:
    out, last = f"{DENSITY}, {SEEDS}", "seeds"
    for i in range(1, n + 1):
        out += f""", near{i} AS (SELECT c.x, c.y, any_value(density) AS density, min_by(seed_id, {SEED_KEY}) AS seed_id FROM detailed c, {last} s GROUP BY c.x, c.y),
moved{i} AS (SELECT seed_id, sum(w * (x + 0.5)) / sum(w) AS nx, sum(w * (y + 0.5)) / sum(w) AS ny FROM (SELECT *, pow(density, {1.0 + 3.0 * 0.7!r}::DOUBLE) AS w FROM near{i}) GROUP BY seed_id),
s{i} AS (SELECT s.seed_id, coalesce(nx, x) AS x, coalesce(ny, y) AS y FROM {last} s LEFT JOIN moved{i} m USING (seed_id))"""
        last = f"s{i}"
    return out


def lloyd(n: int) -> str:
    return f"WITH {_lloyd(n)} SELECT seed_id, round(x, 5) AS x, round(y, 5) AS y FROM s{n}"


VORONOI = f"""WITH {_lloyd(1)}, near AS (SELECT c.x, c.y, any_value(r) AS r, any_value(g) AS g, any_value(b) AS b, any_value(density) AS density, min_by(seed_id, {SEED_KEY}) AS seed_id FROM detailed c, s1 s GROUP BY c.x, c.y),
m AS (SELECT seed_id, CAST(sum(r) // count(*) AS INT) AS r, CAST(sum(g) // count(*) AS INT) AS g, CAST(sum(b) // count(*) AS INT) AS b, avg(density) AS d FROM near GROUP BY seed_id),
nn AS (SELECT a.seed_id, sqrt(min((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y))) / 2 AS nn FROM s1 a JOIN s1 b ON a.seed_id <> b.seed_id GROUP BY a.seed_id)
SELECT CAST(row_number() OVER (ORDER BY seed_id) - 1 AS BIGINT) AS dot_id, round(x, 5) AS x, round(y, 5) AS y, r, g, b, round(least({radius(LUM, "d", "48.0", Params())}, nn * 0.8::DOUBLE), 5) AS radius
FROM m JOIN s1 USING (seed_id) JOIN nn USING (seed_id)"""


def _kmeans(n: int) -> str:
    out, last = f"{DENSITY}, {CENTERS}", "centers"
    cols = ("x", "y", "r", "g", "b")
    for i in range(1, n + 1):
        out += f""", near{i} AS (SELECT c.x, c.y, any_value(c.r) AS r, any_value(c.g) AS g, any_value(c.b) AS b, min_by(center_id, struct_pack(d := {CENTER_D2}, i := center_id)) AS center_id FROM canvas c, {last} s GROUP BY c.x, c.y),
moved{i} AS (SELECT center_id, {", ".join(f"avg({c}) AS n{c}" for c in cols)} FROM near{i} GROUP BY center_id),
c{i} AS (SELECT s.center_id, {", ".join(f"coalesce(n{c}, s.{c}) AS {c}" for c in cols)} FROM {last} s LEFT JOIN moved{i} USING (center_id))"""
        last = f"c{i}"
    return out


def kmeans(n: int) -> str:
    return f"WITH {_kmeans(n)} SELECT center_id, {', '.join(f'round({c}, 5) AS {c}' for c in ('x', 'y', 'r', 'g', 'b'))} FROM c{n}"


KMEANS_DOTS = f"""WITH {_kmeans(2)}, t AS (SELECT k.center_id, k.x, k.y, {", ".join(f"CAST(trunc(k.{c}) AS INT) AS {c}" for c in "rgb")}, d.density FROM c2 k JOIN detailed d ON d.x = CAST(floor(k.x) AS INT) AND d.y = CAST(floor(k.y) AS INT))
SELECT CAST(row_number() OVER (ORDER BY center_id) - 1 AS BIGINT) AS dot_id, round(x, 5) AS x, round(y, 5) AS y, r, g, b, round({radius(LUM, "density", "48.0", Params())}, 5) AS radius FROM t"""


def quadtree(select: str) -> str:
    return f"""WITH RECURSIVE {CANVAS}, node AS (SELECT '' AS path, 0 AS x0, 0 AS y0, 64 AS nw, 48 AS nh UNION ALL
SELECT path || d, x0 + CASE WHEN d % 2 = 1 THEN nw // 2 ELSE 0 END, y0 + CASE WHEN d >= 2 THEN nh // 2 ELSE 0 END, CASE WHEN d % 2 = 1 THEN nw - nw // 2 ELSE nw // 2 END, CASE WHEN d >= 2 THEN nh - nh // 2 ELSE nh // 2 END
FROM node, (VALUES (0), (1), (2), (3)) v(d) WHERE nw > 2 AND nh > 2),
inner0 AS (SELECT node.*, canvas.r, canvas.g, canvas.b FROM node JOIN canvas ON x >= x0 AND x < x0 + nw AND y >= y0 AND y < y0 + nh),
means AS (SELECT path, CAST(sum(r) // count(*) AS INT) AS ar, CAST(sum(g) // count(*) AS INT) AS ag, CAST(sum(b) // count(*) AS INT) AS ab FROM inner0 GROUP BY path),
st AS (SELECT path, any_value(x0) AS x0, any_value(y0) AS y0, any_value(nw) AS nw, any_value(nh) AS nh, any_value(ar) AS r, any_value(ag) AS g, any_value(ab) AS b, avg((r-ar)*(r-ar) + (g-ag)*(g-ag) + (b-ab)*(b-ab)) AS variance FROM inner0 JOIN means USING (path) GROUP BY path),
ends AS (SELECT * FROM st WHERE nw <= 2 OR nh <= 2 OR variance < {800.0 * (1.0 - 0.8 * 0.7)!r}),
leaves AS (SELECT * FROM ends e WHERE NOT EXISTS (SELECT 1 FROM ends a WHERE length(a.path) < length(e.path) AND starts_with(e.path, a.path)))
{select}"""


QUAD_DOTS = f"SELECT CAST(row_number() OVER (ORDER BY path) - 1 AS BIGINT) AS dot_id, (x0 + nw / 2.0)::DOUBLE AS x, (y0 + nh / 2.0)::DOUBLE AS y, r, g, b, round(greatest({radius(LUM, 'least(least(nw, nh) / 48.0, 1)', '48.0', Params())}, 1), 6) AS radius FROM leaves"


def _refined(first: str, rows: str, still: float, rounds: int) -> str:
    """Rounds of k-means, until no centre moves by more than the root of ``still``."""
    out, last, go = f", k0 AS MATERIALIZED ({first}), go0 AS MATERIALIZED (SELECT true AS go)", "k0", "go0"
    for i in range(1, rounds + 1):
        near = "min_by(palette_id, struct_pack(d := (c.r-p.r)*(c.r-p.r) + (c.g-p.g)*(c.g-p.g) + (c.b-p.b)*(c.b-p.b), i := palette_id))"
        moved = ", ".join(f"CASE WHEN go THEN coalesce(n.{c}, o.{c}) ELSE o.{c} END AS {c}" for c in "rgb")
        out += f""", q{i} AS MATERIALIZED (SELECT c.id, any_value(c.r) AS r, any_value(c.g) AS g, any_value(c.b) AS b, {near} AS palette_id FROM {rows} c, {last} p GROUP BY c.id),
k{i} AS MATERIALIZED (SELECT o.palette_id, {moved} FROM {go}, {last} o LEFT JOIN (SELECT palette_id, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM q{i} GROUP BY palette_id) n USING (palette_id)),
go{i} AS MATERIALIZED (SELECT bool_or((a.r-b.r)*(a.r-b.r) + (a.g-b.g)*(a.g-b.g) + (a.b-b.b)*(a.b-b.b) > {still!r}) AS go FROM {last} a JOIN k{i} b USING (palette_id))"""
        last, go = f"k{i}", f"go{i}"
    return out + f" SELECT palette_id, {', '.join(f'CAST(trunc({c}) AS INT) AS {c}' for c in 'rgb')} FROM {last}"


def palette_of_dots(rounds: int = 10) -> str:
    first = "SELECT CAST(dot_id // 8 AS INT) AS palette_id, r::DOUBLE AS r, g::DOUBLE AS g, b::DOUBLE AS b FROM dots WHERE dot_id % 8 = 0 AND dot_id // 8 < 6"
    return f"WITH {DENSITY}, {grid(GRID8)}, rows0 AS (SELECT dot_id AS id, r, g, b FROM dots)" + _refined(first, "rows0", 0.5, rounds)


def dominant(rounds: int = 10) -> str:
    first = "SELECT CAST(id // 614 AS INT) AS palette_id, r::DOUBLE AS r, g::DOUBLE AS g, b::DOUBLE AS b FROM rows0 WHERE id % 614 = 0 AND id // 614 < 5"
    return f"WITH {CANVAS}, rows0 AS (SELECT y * 64 + x AS id, r, g, b FROM canvas)" + _refined(first, "rows0", 1.0, rounds)


CMYK = """inks AS (SELECT *, 1 - greatest(r, g, b) / 255.0::DOUBLE AS k FROM canvas),
cmy AS (SELECT x, y, k, CASE WHEN k < 1 THEN greatest(least((1 - r / 255.0::DOUBLE - k) / (1 - k), 1), 0) ELSE 0 END AS c, CASE WHEN k < 1 THEN greatest(least((1 - g / 255.0::DOUBLE - k) / (1 - k), 1), 0) ELSE 0 END AS m,
  CASE WHEN k < 1 THEN greatest(least((1 - b / 255.0::DOUBLE - k) / (1 - k), 1), 0) ELSE 0 END AS yy FROM inks),
planes AS (SELECT x, y, 0 AS channel, c AS coverage FROM cmy UNION ALL SELECT x, y, 1, m FROM cmy UNION ALL SELECT x, y, 2, yy FROM cmy UNION ALL SELECT x, y, 3, k FROM cmy)"""

LATTICE = """ink AS (SELECT * FROM (VALUES (0, 0, 255, 255, 15.0::DOUBLE), (1, 255, 0, 255, 75.0::DOUBLE), (2, 255, 255, 0, 0.0::DOUBLE), (3, 0, 0, 0, 45.0::DOUBLE)) t(channel, r, g, b, angle)),
lattice AS (SELECT * FROM (SELECT ink.*, CAST(a.range AS INT) AS i, CAST(b.range AS INT) AS j, 32 + 4.0::DOUBLE * (a.range * cos(radians(angle)) - b.range * sin(radians(angle))) AS cx, 24 + 4.0::DOUBLE * (a.range * sin(radians(angle)) + b.range * cos(radians(angle))) AS cy
  FROM ink, range(-12, 13) a, range(-12, 13) b) WHERE cx >= 0 AND cx < 64 AND cy >= 0 AND cy < 48)"""


def halftone(mode: str, select: str = "SELECT channel, i, j, round(x, 6) AS x, round(y, 6) AS y, round(radius, 6) AS radius FROM final") -> str:
    low, high = "(48 * 0.002::DOUBLE)", "(4 * 0.85::DOUBLE)" if mode == "am" else "(4 * 0.425::DOUBLE)"
    mean = "mean AS (SELECT l.channel, l.i, l.j, any_value(l.cx) AS cx, any_value(l.cy) AS cy, any_value(l.r) AS r, any_value(l.g) AS g, any_value(l.b) AS b, avg(coverage) AS mean FROM lattice l JOIN planes p ON p.channel = l.channel AND abs(p.x - trunc(cx)) <= 2 AND abs(p.y - trunc(cy)) <= 2 WHERE (p.x - trunc(cx)) * (p.x - trunc(cx)) + (p.y - trunc(cy)) * (p.y - trunc(cy)) <= 4 GROUP BY l.channel, l.i, l.j)"
    if mode == "am":
        final = f"SELECT channel, i, j, r, g, b, cx AS x, cy AS y, {low} + ({high} - {low}) * mean AS radius FROM mean WHERE mean > 0.005"
    else:
        steps = ", ".join(f"{_mixed_step(k)} AS u{k}" for k in range(4))
        final = f"SELECT channel, i, j, r, g, b, cx + (u1 - 0.5) * 0.4::DOUBLE * 4 AS x, cy + (u2 - 0.5) * 0.4::DOUBLE * 4 AS y, {low} + ({high} - {low}) * (u3 * 0.3::DOUBLE + 0.7::DOUBLE) AS radius FROM (SELECT *, {steps} FROM (SELECT *, {_round('h2', 'i')} AS h3 FROM (SELECT *, {_round('h1', 'j')} AS h2 FROM (SELECT *, {_round('7::BIGINT', 'channel')} AS h1 FROM mean)))) WHERE mean > 0.005 AND u0 <= mean"
    return f"WITH {CANVAS}, {CMYK}, {LATTICE}, {mean}, final AS (SELECT * FROM ({final}) WHERE radius >= 0.5) {select}"


def _round(h: str, part: str) -> str:
    a = f"((({h}) + {part} + 65536) * 1103515245 + 12345) % 2147483648"
    return f"((({a}) * 69069 + (({a}) // 65536) + 1) % 2147483648)"


def _mixed_step(k: int) -> str:
    return f"({_round('h3', str(k))} / 2147483648.0::DOUBLE)"


def _covered(shape: Shape, dots: str = "dots") -> str:
    x, y = "(q.x - 0.5 - d.x + {})", "(q.y - 0.5 - d.y + {})"
    at = lambda i, j: _inside(shape, x.format(i), y.format(j))
    corners = [at(i, j) for j in (0, 1) for i in (0, 1)]
    count = " + ".join(f"CAST({at((i + 0.5) / 4, (j + 0.5) / 4)} AS INT)" for j in range(4) for i in range(4))
    reach = f"(ceil(greatest(radius, radius / {shape.aspect}, 1)) + 1)" if shape.kind == "ellipse" else "(ceil(radius) + 1)"
    return f"""SELECT * FROM (SELECT d.dot_id, d.radius, d.r, d.g, d.b, q.x AS px, q.y AS py, CASE WHEN {" AND ".join(corners)} THEN 16 WHEN NOT ({" OR ".join(corners)} OR {at(0.5, 0.5)}) THEN 0 ELSE {count} END AS cov
  FROM {dots} d JOIN canvas q ON q.x >= ceil(d.x - {reach}) AND q.x <= floor(d.x + {reach}) AND q.y >= ceil(d.y - {reach}) AND q.y <= floor(d.y + {reach})) WHERE cov > 0"""


def coverage_of(shape: str, select: str) -> str:
    return f"WITH {DENSITY}, {grid(GRID8)}, covered AS ({_covered(SHAPES[shape])}) {select}"


SHAPE_COVERAGE = f"WITH {DENSITY}, {grid(GRID8)} " + " UNION ALL ".join(f"SELECT '{name}' AS shape, dot_id, px, py, cov FROM ({_covered(shape)})" for name, shape in SHAPES.items())


def render(kind: str) -> str:
    part = "(l.cov / 16.0::DOUBLE)"
    if kind == "rgba":
        dst = "(acc.a / 255.0::DOUBLE)"
        alpha = f"({part} + {dst} * (1 - {part}))"
        mix = {c: f"CASE WHEN l.cov = 16 THEN l.{c} ELSE CAST(least(floor((l.{c} * {part} + acc.{c} * {dst} * (1 - {part})) / {alpha} + 0.5), 255) AS INT) END" for c in "rgb"}
        mix["a"] = f"CASE WHEN l.cov = 16 THEN 255 ELSE CAST(least(floor({alpha} * 255 + 0.5), 255) AS INT) END"
    elif kind == "over":
        mix = {c: f"CASE WHEN l.cov = 16 THEN l.{c} ELSE CAST(least(floor(acc.{c} * (1 - {part}) + l.{c} * {part} + 0.5), 255) AS INT) END" for c in "rgb"} | {"a": "255"}
    else:
        mix = {c: f"CASE WHEN l.cov = 16 THEN CAST(acc.{c} * l.{c} // 255 AS INT) ELSE CAST(least(floor(acc.{c} * (1 - {part} + {part} * (l.{c} / 255.0::DOUBLE)) + 0.5), 255) AS INT) END" for c in "rgb"} | {"a": "255"}
    step = f"struct_pack(cov := 16, {', '.join(f'{c} := {v}' for c, v in mix.items())})"
    start = f"struct_pack(cov := 16, r := 255, g := 255, b := 255, a := {0 if kind == 'rgba' else 255})"
    order = "dot_id" if kind == "multiply" else "radius DESC, dot_id"
    cols = "r, g, b, a" if kind != "over" else "r, g, b"
    return f"""WITH {DENSITY}, {grid(GRID8)}, covered AS ({_covered(SHAPES["circle"])}),
stack AS (SELECT px, py, list_reduce(list(struct_pack(cov := cov, r := r, g := g, b := b, a := 255) ORDER BY {order}), lambda acc, l: {step}, {start}) AS v FROM covered GROUP BY px, py),
done AS (SELECT c.x, c.y, coalesce(v, {start}) AS v FROM canvas c LEFT JOIN stack ON px = x AND py = y)
SELECT x, y, {", ".join(f"v.{c} AS {c}" for c in cols.split(", "))} FROM done"""


def svg(shape: str) -> str:
    n = lambda v: f"printf('%.1f', {v})"
    pairs = {
        "circle": [("cx", n("x")), ("cy", n("y")), ("r", n("radius"))],
        "square": [("x", n("x - radius")), ("y", n("y - radius")), ("width", n("radius * 2")), ("height", n("radius * 2"))],
        "ellipse": [("cx", n("x")), ("cy", n("y")), ("rx", n("radius")), ("ry", n(f"greatest(radius / {SHAPES['ellipse'].aspect}, 0.5)")), ("transform", f"'rotate({SHAPES['ellipse'].angle_deg:.1f},' || {n('x')} || ',' || {n('y')} || ')'")],
        "polygon": [("points", " || ' ' || ".join(f"{n(f'x + radius * ({math.cos(a)!r})::DOUBLE')} || ',' || {n(f'y + radius * ({math.sin(a)!r})::DOUBLE')}" for a in (2 * math.pi * i / SHAPES["polygon"].sides - math.pi / 2 for i in range(SHAPES["polygon"].sides))))],
    }[shape]
    name = {"square": "rect"}.get(shape, shape)
    text = " || ".join(f"' {k}=\"' || {v} || '\"'" for k, v in pairs)
    return f"""WITH {DENSITY}, {grid(GRID20)} SELECT '{shape}' AS shape, CAST(row_number() OVER (ORDER BY radius DESC, dot_id) AS INT) AS place,
'  <{name}' || {text} || ' fill="#' || printf('%02x%02x%02x', r, g, b) || '"/>' AS element FROM dots WHERE radius >= 0.5"""


SVG = " UNION ALL ".join(f"({svg(shape)})" for shape in SHAPES)

_STEP = "(({}) * 6364136223846793005::HUGEINT + 1442695040888963407) % 18446744073709551616::HUGEINT"


def fm_replayed() -> str:
    """One generator for each channel, walked from point to point: a draw for each, and three more where a dot is kept."""
    points = halftone("am", "SELECT channel, row_number() OVER (PARTITION BY channel ORDER BY j, i) AS n, i, j, cx, cy, r, g, b, mean FROM mean WHERE mean > 0.005")
    low, high = "(48 * 0.002::DOUBLE)", "(4 * 0.425::DOUBLE)"
    u = lambda s: f"(CAST({s} // 4294967296::HUGEINT AS DOUBLE) / 4294967295.0::DOUBLE)"
    draws = f"SELECT *, {_STEP.format('s3')} AS s4 FROM (SELECT *, {_STEP.format('s2')} AS s3 FROM (SELECT *, {_STEP.format('s1')} AS s2 FROM (SELECT *, {_STEP.format('state')} AS s1 FROM ({{}}))))"
    first = "SELECT p.*, (7 * 11400714819323198485::HUGEINT + r * 1099511627776::HUGEINT + g * 16777216::HUGEINT + b) % 18446744073709551616::HUGEINT AS state FROM points p WHERE n = 1"
    then = f"SELECT p.*, CASE WHEN {u('w.s1')} <= w.mean THEN w.s4 ELSE w.s1 END AS state FROM walk w JOIN points p ON p.channel = w.channel AND p.n = w.n + 1"
    return f"""WITH RECURSIVE points AS MATERIALIZED ({points}), walk AS ({draws.format(first)} UNION ALL {draws.format(then)}),
final AS (SELECT channel, i, j, cx + ({u('s2')} - 0.5) * 4 * 0.4::DOUBLE AS x, cy + ({u('s3')} - 0.5) * 4 * 0.4::DOUBLE AS y, {low} + ({high} - {low}) * (0.7::DOUBLE + 0.3::DOUBLE * {u('s4')}) AS radius FROM walk WHERE {u('s1')} <= mean)
SELECT channel, i, j, round(x, 6) AS x, round(y, 6) AS y, round(radius, 6) AS radius FROM final WHERE radius >= 0.5"""


def diffused() -> str:
    """A walk along the rows, pixel by pixel, with what earlier errors have made of the present and the next row."""
    colors = ", ".join(f"struct_pack(r := {r}::FLOAT, g := {g}::FLOAT, b := {b}::FLOAT)" for r, g, b in COLORS)
    near = f"list_sort(list_transform([{colors}], lambda k, i: struct_pack(d := (k.r - o.r) * (k.r - o.r) + (k.g - o.g) * (k.g - o.g) + (k.b - o.b) * (k.b - o.b), i := i, k := k)))[1].k"
    add = lambda row, parts: f"list_transform({row}, lambda v, i: CASE {' '.join(f'WHEN i = x + {at} THEN struct_pack(r := v.r + e.r * {n}::FLOAT, g := v.g + e.g * {n}::FLOAT, b := v.b + e.b * {n}::FLOAT)' for at, n in parts)} ELSE v END)"
    zero = "struct_pack(r := 0::FLOAT, g := 0::FLOAT, b := 0::FLOAT)"
    err = ", ".join(f"{c} := (o.{c} - k.{c}) / 16::FLOAT" for c in "rgb")
    # place i of a row's list, from 1, is the pixel i - 2: one place more at either end
    return f"""WITH RECURSIVE {CANVAS}, line AS MATERIALIZED (SELECT y, list_concat(list_concat([{zero}], list(struct_pack(r := r::FLOAT, g := g::FLOAT, b := b::FLOAT) ORDER BY x)), [{zero}]) AS v FROM canvas GROUP BY y
  UNION ALL SELECT 48, list_transform(range(66), lambda i: {zero})),
walk AS (SELECT -1 AS x, -1 AS y, (SELECT v FROM line WHERE y = 0) AS here, (SELECT v FROM line WHERE y = 1) AS below, {zero} AS k
  UNION ALL SELECT x, y, {add("here", [(3, 7)])}, {add("below", [(1, 3), (2, 5), (3, 1)])}, k
  FROM (SELECT *, struct_pack({err}) AS e FROM (SELECT *, {near} AS k FROM (SELECT *, here[x + 2] AS o FROM (
    SELECT CASE WHEN last THEN 0 ELSE w.x + 1 END AS x, w.y + CAST(last AS INT) AS y, CASE WHEN last AND w.y >= 0 THEN below ELSE here END AS here, CASE WHEN last AND w.y >= 0 THEN line.v ELSE below END AS below
    FROM (SELECT *, y < 0 OR x = 63 AS last FROM walk) w LEFT JOIN line ON line.y = w.y + 2 WHERE NOT (w.x = 63 AND w.y = 47))))))
SELECT x, y, CAST(k.r AS INT) AS r, CAST(k.g AS INT) AS g, CAST(k.b AS INT) AS b FROM walk WHERE y >= 0"""


_NEAREST = "min_by({cols}, struct_pack(d := (c.r-p.r)*(c.r-p.r) + (c.g-p.g)*(c.g-p.g) + (c.b-p.b)*(c.b-p.b), i := palette_id))"
_D2 = "min((c.r-p.r)*(c.r-p.r) + (c.g-p.g)*(c.g-p.g) + (c.b-p.b)*(c.b-p.b))"

QUANTIZED = f"""SELECT dot_id, v.r AS r, v.g AS g, v.b AS b FROM (SELECT c.dot_id, {_NEAREST.format(cols="struct_pack(r := p.r, g := p.g, b := p.b)")} AS v
FROM (WITH {DENSITY}, {grid(GRID8)} SELECT * FROM dots) c, ({palette_of_dots()}) p GROUP BY c.dot_id)"""

SEPARATED = f"""SELECT x, y, channel, round(least(greatest((1 - least(greatest(d2 / (255.0::DOUBLE * 255.0 * 1.5), 0), 1)) * 1.3::DOUBLE, 0), 1), 6) AS coverage, channel * 36.0::DOUBLE + 15 AS angle
FROM (SELECT c.x, c.y, CAST({_NEAREST.format(cols="palette_id")} AS INT) AS channel, {_D2} AS d2 FROM (WITH {CANVAS} SELECT * FROM canvas) c, ({dominant()}) p GROUP BY c.x, c.y)"""
