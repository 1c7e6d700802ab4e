"""Lookups, stencils and pyramids on generated fields, and neighbourhood searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookup, pyramid, spatial, stencil
from ..operators.grid import continuous, grid, lattice, line, toroidal, world
from ..session import table
from . import sqltext as sql
from .registry import query

RES = 64


def hills(spark, res: int = RES):
    """The test field: whole-numbered hills."""
    x, y = F.col("x"), F.col("y")
    return grid(spark, res).withColumn("h", ((x * x * 7 + y * y * 13 + x * y * 5) % 251).cast("double"))


_H = sql.heights(RES)
_CROSS = f"SELECT *, {sql.moved('h', -1, 'x')} AS w, {sql.moved('h', 1, 'x')} AS e, {sql.moved('h', -1, 'y')} AS s, {sql.moved('h', 1, 'y')} AS n FROM ({_H})"


@query(
    "q_grid_source",
    f"SELECT x, y, ((x + 0.5) / {RES} - 0.5) * 4096 AS wx, round(((((x + 0.5) / {RES} - 0.5) * 4096) / 4096 + 0.5) * {RES} - 0.5, 6) AS gx, (round_even((37 - x) / 64.0, 0) * 64 + x)::INTEGER AS near FROM ({sql.cells(RES)})",
)
def grid_source(spark, sf_dir):
    """SRC-3, SRC-4, P-1..P-3."""
    wx = world(F.col("x"), RES)
    return grid(spark, RES).select("x", "y", wx.alias("wx"), F.round(continuous(wx, RES), 6).alias("gx"), toroidal(F.col("x"), 37, 64).alias("near"))


_POINTS = f"SELECT p_partkey, (p_partkey % 97) * 0.71 - 2 AS gx, (p_size * 1.37) - 1 AS gy FROM part"


def points(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_partkey") % 97) * 0.71 - 2).alias("gx"), (F.col("p_size") * 1.37 - 1).alias("gy"))


@query(
    "q_lookup_nearest",
    f"SELECT p_partkey, h FROM ({_POINTS}) p JOIN ({_H}) r ON r.x = least(greatest(floor(gx), 0), {RES - 1}) AND r.y = least(greatest(floor(gy), 0), {RES - 1})",
)
def lookup_nearest(spark, sf_dir):
    """J-1."""
    return lookup.nearest(points(spark, sf_dir), F.col("gx"), F.col("gy"), hills(spark), RES, ["h"]).select("p_partkey", "h")


def _bilinear(source: str, keys: str, raster: str, res: int, out: str) -> str:
    return f"""SELECT {keys}, sum(w * h) AS {out} FROM (
  SELECT {keys}, unnest([x0, x1, x0, x1]) AS cx, unnest([y0, y0, y1, y1]) AS cy, unnest([(1 - fx) * (1 - fy), fx * (1 - fy), (1 - fx) * fy, fx * fy]) AS w FROM (
    SELECT *, floor(bx)::INTEGER AS x0, floor(by_)::INTEGER AS y0, least(floor(bx)::INTEGER + 1, {res - 1}) AS x1, least(floor(by_)::INTEGER + 1, {res - 1}) AS y1, bx - floor(bx) AS fx, by_ - floor(by_) AS fy FROM (
      SELECT *, least(greatest(gx::DOUBLE, 0), {res - 1}) AS bx, least(greatest(gy::DOUBLE, 0), {res - 1}) AS by_ FROM ({source})))) JOIN ({raster}) r ON r.x = cx AND r.y = cy GROUP BY {keys}"""


@query("q_lookup_bilinear", f"SELECT p_partkey, round(v, 6) AS v FROM ({_bilinear(_POINTS, 'p_partkey', _H, RES, 'v')})")
def lookup_bilinear(spark, sf_dir):
    """J-2."""
    found = lookup.bilinear(points(spark, sf_dir), ["p_partkey"], F.col("gx"), F.col("gy"), hills(spark), RES, "h", "v")
    return found.select("p_partkey", F.round("v", 6).alias("v"))


_COARSE = sql.heights(16)
_UP = f"SELECT x AS fx_, y AS fy_, (x + 0.5) * 0.25 - 0.5 AS gx, (y + 0.5) * 0.25 - 0.5 AS gy FROM ({sql.cells(RES)})"


@query(
    "q_compose_cross_res",
    f"""WITH a AS ({_bilinear(_UP, 'fx_, fy_', f'SELECT x, y, h * 0.9 - 1 AS h FROM ({_COARSE})', 16, 'v')}), b AS ({_bilinear(_UP, 'fx_, fy_', _COARSE, 16, 'v')})
SELECT f.x, f.y, round(a.v + f.h - b.v, 8) AS composed FROM ({_H}) f JOIN a ON a.fx_ = f.x AND a.fy_ = f.y JOIN b ON b.fx_ = f.x AND b.fy_ = f.y""",
)
def compose_cross_res(spark, sf_dir):
    """J-3: fine detail on a changed coarse field."""
    before = hills(spark, 16)
    after = hills(spark, 16).withColumn("h", F.col("h") * 0.9 - 1)
    return lookup.compose(hills(spark), RES, before, after, 16).select("x", "y", F.round("composed", 8).alias("composed"))


@query(
    "q_line_profile",
    f"""WITH l AS (SELECT s_suppkey, k, least(greatest(floor((s_suppkey % 60) + ((s_nationkey * 2) - (s_suppkey % 60)) * k / 8.0), 0), 63)::INTEGER AS cx, least(greatest(floor((s_suppkey % 50) + (60 - (s_suppkey % 50)) * k / 8.0), 0), 63)::INTEGER AS cy FROM supplier, range(9) t(k))
SELECT s_suppkey, k, h FROM l JOIN ({_H}) r ON r.x = cx AND r.y = cy""",
)
def line_profile(spark, sf_dir):
    """SRC-11: a field along segments."""
    s = F.col("s_suppkey")
    along = line(s % 60, s % 50, F.col("s_nationkey") * 2, F.lit(60), 8)
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(along).alias("p")).select("s_suppkey", "p.k", "p.px", "p.pz")
    return lookup.nearest(rows, F.col("px"), F.col("pz"), hills(spark), RES, ["h"]).select("s_suppkey", F.col("k").cast("long").alias("k"), "h")


@query(
    "q_min_pyramid",
    "WITH a AS (SELECT 1 AS level, x // 2 AS x, y // 2 AS y, min(h) AS h FROM (" + _H + ") GROUP BY ALL), b AS (SELECT 2 AS level, x // 2 AS x, y // 2 AS y, min(h) AS h FROM a GROUP BY ALL), c AS (SELECT 3 AS level, x // 2 AS x, y // 2 AS y, min(h) AS h FROM b GROUP BY ALL) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c",
)
def min_pyramid(spark, sf_dir):
    """A-6, A-7."""
    return pyramid.min_pyramid(hills(spark), "h", 3)


@query(
    "q_range_pyramid",
    f"WITH a AS (SELECT 0 AS level, x // 8 AS x, y // 8 AS y, max(h) - min(h) AS r FROM ({_H}) WHERE x % 4 = 0 AND y % 4 = 0 GROUP BY ALL), b AS (SELECT 1 AS level, x // 2 AS x, y // 2 AS y, max(r) AS r FROM a GROUP BY ALL), c AS (SELECT 2 AS level, x // 2 AS x, y // 2 AS y, max(r) AS r FROM b GROUP BY ALL) SELECT level, x, y, r AS \"range\" FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)",
)
def range_pyramid(spark, sf_dir):
    """A-8."""
    return pyramid.range_pyramid(hills(spark), "h", 8, 4, 2)


_BOX = f"SELECT *, {sql.moved('w', -1, 'y')} AS sw, {sql.moved('w', 1, 'y')} AS nw, {sql.moved('e', -1, 'y')} AS se, {sql.moved('e', 1, 'y')} AS ne FROM ({_CROSS})"


@query("q_neighbor_min", f"SELECT x, y, least(h, w, e, s, n, sw, se, nw, ne) AS low, (h + w + e + s + n + sw + se + nw + ne) AS total FROM ({_BOX})")
def neighbor_min(spark, sf_dir):
    """J-4, A-9, W-4: 3 x 3 minimum and sum."""
    near = stencil.box(hills(spark), "h")
    all9 = [F.col(c) for c in ("h", "w", "e", "s", "n", "sw", "se", "nw", "ne")]
    return near.select("x", "y", F.least(*all9).alias("low"), sum(all9[1:], all9[0]).alias("total"))


_WET = f"SELECT x, y, h, (h > 120)::INTEGER AS wet FROM ({_H})"
_AROUND = ((-1, "x"), (1, "x"), (-1, "y"), (1, "y"))


@query(
    "q_masked_mean",
    f"SELECT x, y, round(CASE WHEN wet = 1 THEN (h + {' + '.join(sql.moved('hw', b, a) for b, a in _AROUND)}) / (1 + {' + '.join(sql.moved('wet', b, a) for b, a in _AROUND)}) ELSE h END, 6) AS smooth FROM (SELECT *, h * wet AS hw FROM ({_WET}))",
)
def masked_mean(spark, sf_dir):
    """A-10."""
    field = hills(spark).withColumn("wet", (F.col("h") > 120).cast("int"))
    return stencil.masked_mean(field, "h", "wet", "smooth").select("x", "y", F.round("smooth", 6).alias("smooth"))


@query(
    "q_cliff_cut",
    f"SELECT x, y, CASE WHEN wet = 1 AND steep / 64 > 0.35 THEN h - 2 ELSE h END AS cut FROM (SELECT *, greatest({', '.join(f'abs(h - {sql.moved(chr(104), b, a)}) * {sql.moved(chr(119) + chr(101) + chr(116), b, a)}' for b, a in _AROUND)}) AS steep FROM ({_WET}))",
)
def cliff_cut(spark, sf_dir):
    """A-11: cells under the mask with a steep neighbour sink."""
    field = hills(spark).withColumn("wet", (F.col("h") > 120).cast("int"))
    found = stencil.steepest_masked(field, "h", "wet", "steep")
    return found.select("x", "y", F.when((F.col("wet") == 1) & (F.col("steep") / 64 > 0.35), F.col("h") - 2).otherwise(F.col("h")).alias("cut"))


@query("q_central_diff", f"SELECT x, y, round(sqrt(((e - w) / 128) * ((e - w) / 128) + ((n - s) / 128) * ((n - s) / 128)), 6) AS slope, round(1 / sqrt(((e - w) / 128) * ((e - w) / 128) + ((n - s) / 128) * ((n - s) / 128) + 1), 6) AS ny FROM ({_CROSS})")
def central_diff(spark, sf_dir):
    """W-1."""
    found = stencil.central_difference(hills(spark), "h", 64.0)
    return found.select("x", "y", F.round("slope", 6).alias("slope"), F.round("ny", 6).alias("ny"))


@query(
    "q_laplacian",
    f"SELECT x, y, ({' + '.join(sql.moved('h', b * 3, a) for b, a in _AROUND)}) / 4 - h AS fine, ({' + '.join(sql.moved('h', b * 14, a) for b, a in _AROUND)}) / 4 - h AS wide FROM ({_H})",
)
def laplacian(spark, sf_dir):
    """W-2: strides 3 and 14."""
    found = stencil.laplacian(stencil.laplacian(hills(spark), "h", 3, "fine"), "h", 14, "wide")
    return found.select("x", "y", "fine", "wide")


def _blur(source: str, value: str, radius: int, axis: str, out: str) -> str:
    w = {o: 1 - abs(o) / (radius + 1) for o in range(-radius, radius + 1)}
    return f"SELECT *, ({' + '.join(f'{sql.moved(value, o, axis)} * {k!r}::DOUBLE' for o, k in w.items())}) / {sum(w.values())!r}::DOUBLE AS {out} FROM ({source})"


@query("q_triangle_blur", f"SELECT x, y, round(b, 5) AS blurred FROM ({_blur(_blur(_H, 'h', 2, 'x', 'a'), 'a', 2, 'y', 'b')})")
def triangle_blur(spark, sf_dir):
    """W-3: separable blur with replicated edges."""
    found = stencil.blur(stencil.blur(hills(spark), "h", 2, "x", "a"), "a", 2, "y", "b")
    return found.select("x", "y", F.round("b", 5).alias("blurred"))


def _dilated(source: str) -> str:
    total = " + ".join(sql.moved("z", b, a) for b, a in _AROUND)
    weight = " + ".join(sql.moved("f", b, a) for b, a in _AROUND)
    return f"SELECT x, y, coalesce(h, CASE WHEN wt > 0 THEN t / wt END) AS h FROM (SELECT *, {total} AS t, {weight} AS wt FROM (SELECT *, coalesce(h, 0) AS z, (h IS NOT NULL)::INTEGER AS f FROM ({source})))"


_HOLES = f"SELECT x, y, CASE WHEN h > 70 THEN NULL ELSE h END AS h FROM ({_H})"


@query("q_dilate", f"SELECT x, y, round(h, 5) AS h FROM ({_dilated(_dilated(_HOLES))})")
def dilate(spark, sf_dir):
    """G-11: two passes."""
    holes = hills(spark).withColumn("h", F.when(F.col("h") <= 70, F.col("h")))
    return stencil.dilate(holes, "h", 2).select("x", "y", F.round("h", 5).alias("h"))


@query(
    "q_wet_fraction",
    f"""WITH w AS ({_WET}), c AS (SELECT x, y, avg(wet) OVER (PARTITION BY y ORDER BY x ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS f, wet FROM w WHERE x % 2 = 0 AND y % 2 = 0)
SELECT count(*) AS cells, count(*) FILTER (wet = 1 AND f < 0.3) AS isolated, round(avg(abs(wet - f)), 6) AS contrast, round(max(abs(wet - f)), 6) AS top FROM c""",
)
def wet_fraction(spark, sf_dir):
    """SRC-12, A-23: a lattice sweep with local wet shares."""
    from pyspark.sql import Window

    points_ = lattice(spark, (0, 0), (62, 62), 2).withColumnRenamed("z", "y")
    field = points_.join(hills(spark), ["x", "y"]).withColumn("wet", (F.col("h") > 120).cast("int"))
    near = Window.partitionBy("y").orderBy("x").rowsBetween(-3, 3)
    found = field.withColumn("f", F.avg("wet").over(near)).withColumn("c", F.abs(F.col("wet") - F.col("f")))
    return found.agg(F.count("*").alias("cells"), F.count_if((F.col("wet") == 1) & (F.col("f") < 0.3)).alias("isolated"), F.round(F.avg("c"), 6).alias("contrast"), F.round(F.max("c"), 6).alias("top"))


LINE = ((0.0, 0.0, 100.0), (40.0, 15.0, 80.0), (70.0, 12.0, 60.0), (100.0, 90.0, 20.0))


@query(
    "q_nearest_segment",
    "WITH s(k, ax, az, f0, bx, bz, f1) AS (VALUES "
    + ", ".join(f"({k}, {a[0]!r}::DOUBLE, {a[1]!r}::DOUBLE, {a[2]!r}::DOUBLE, {b[0]!r}::DOUBLE, {b[1]!r}::DOUBLE, {b[2]!r}::DOUBLE)" for k, (a, b) in enumerate(zip(LINE, LINE[1:])))
    + """), p AS (SELECT c_custkey, (c_custkey % 101)::DOUBLE AS px, (c_nationkey * 4)::DOUBLE AS pz FROM customer),
t AS (SELECT *, least(greatest(((px - ax) * (bx - ax) + (pz - az) * (bz - az)) / ((bx - ax) * (bx - ax) + (bz - az) * (bz - az)), 0), 1) AS t FROM p, s),
d AS (SELECT *, sqrt((px - ax - (bx - ax) * t) * (px - ax - (bx - ax) * t) + (pz - az - (bz - az) * t) * (pz - az - (bz - az) * t)) AS d FROM t)
SELECT c_custkey, round(min(d), 5) AS d, round(arg_min(f0 + (f1 - f0) * t, d + k * 1e-12), 5) AS floor FROM d GROUP BY c_custkey""",
)
def nearest_segment(spark, sf_dir):
    """J-8, G-6: distance to a polyline and its floor there."""
    near = spatial.nearest_segment((F.col("c_custkey") % 101).cast("double"), (F.col("c_nationkey") * 4).cast("double"), LINE)
    rows = table(spark, sf_dir, "customer").select("c_custkey", near.alias("s"))
    return rows.select("c_custkey", F.round("s.d", 5).alias("d"), F.round("s.floor", 5).alias("floor"))


@query(
    "q_nearest_feature_f1_f2",
    f"""WITH p AS (SELECT i, (i % 40) * 0.37 AS px, (i // 40) * 0.41 AS py FROM range(1200) t(i)), c AS (SELECT *, floor(px)::BIGINT AS cx, floor(py)::BIGINT AS cy FROM p),
n AS (SELECT *, cx + dx AS nx, cy + dy AS ny, ((cx + dx) % 8 + 8) % 8 AS hx, ((cy + dy) % 8 + 8) % 8 AS hy FROM c, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy)),
d AS (SELECT i, (nx + u / 16777216.0::DOUBLE - px) * (nx + u / 16777216.0::DOUBLE - px) + (ny + v / 16777216.0::DOUBLE - py) * (ny + v / 16777216.0::DOUBLE - py) AS d FROM ({sql.pcg('SELECT * FROM n', 'hx', 'hy', 77)})),
s AS (SELECT i, list_sort(list(d)) AS l FROM d GROUP BY i) SELECT i, round(sqrt(l[1]), 5) AS f1, round(sqrt(l[2]) - sqrt(l[1]), 5) AS edge FROM s""",
)
def nearest_feature(spark, sf_dir):
    """J-9: first and second nearest feature points, periodic."""
    i = F.col("id")
    p = spark.range(1200).select(i.alias("i"), ((i % 40) * 0.37).alias("px"), (F.floor(i / 40) * 0.41).alias("py"))
    cells = p.withColumns({"cx": F.floor("px"), "cy": F.floor("py")})
    l = cells.withColumn("l", spatial.nearest_features(F.col("cx"), F.col("cy"), F.col("px"), F.col("py"), 77, 8))
    first, second = F.sqrt(F.get("l", F.lit(0))), F.sqrt(F.get("l", F.lit(1)))
    return l.select("i", F.round(first, 5).alias("f1"), F.round(second - first, 5).alias("edge"))


_CLUMP = f"SELECT i, px, py, floor(px / 26) + dx + 8192 AS cx, floor(py / 26) + dy + 8192 AS cy FROM (SELECT i, (i % 30) * 7.3 - 60 AS px, (i // 30) * 6.1 - 50 AS py FROM range(900) t(i)), (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy)"


@query(
    "q_clump_kernel",
    f"""WITH h AS ({sql.pcg(sql.pcg(_CLUMP, 'cx', 'cy', 0x51F3), 'cx', 'cy', 0x51F3 ^ 0x9E3779, 'eu', 'ev')}),
k AS (SELECT *, u / 16777216.0::DOUBLE AS uu, v / 16777216.0::DOUBLE AS vv FROM h),
d AS (SELECT *, 26 * (uu * 0.55 + 0.5) AS r, sqrt(power(px - (cx - 8192 + 0.15 + uu * 0.7) * 26, 2) + power(py - (cy - 8192 + 0.15 + vv * 0.7) * 26, 2)) AS d FROM k),
t AS (SELECT *, least(greatest((d - r * 0.22) / (r - r * 0.22), 0), 1) AS t FROM d)
SELECT i, round(greatest(max(CASE WHEN eu / 16777216.0 < 0.62 THEN 1 - t * t * (3 - 2 * t) ELSE 0 END), 0), 5) AS clump FROM t GROUP BY i""",
)
def clump_kernel(spark, sf_dir):
    """J-10."""
    i = F.col("id")
    p = spark.range(900).select(i.alias("i"), ((i % 30) * 7.3 - 60).alias("px"), (F.floor(i / 30) * 6.1 - 50).alias("py"))
    return p.select("i", F.round(spatial.clump(F.col("px"), F.col("py"), 0x51F3), 5).alias("clump"))


SPIRAL = spatial.spiral(6, 3.0)


@query(
    "q_spiral_first",
    "WITH o(r, k, dx, dz) AS (VALUES "
    + ", ".join(f"({r}, {k}, {dx!r}::DOUBLE, {dz!r}::DOUBLE)" for r, k, dx, dz in SPIRAL)
    + f"), c AS (SELECT s_suppkey, r, k, least(greatest(floor(s_suppkey % 64 + dx), 0), 63)::INTEGER AS cx, least(greatest(floor(s_nationkey * 2 + dz), 0), 63)::INTEGER AS cy FROM supplier, o), f AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY r, k) AS n FROM c JOIN ({_H}) g ON g.x = cx AND g.y = cy WHERE h < 8) SELECT s_suppkey, r, k, h FROM f WHERE n = 1",
)
def spiral_first(spark, sf_dir):
    """O-6, O-9, J-17: the first match on an outward spiral, as a minimum over matches."""
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(k).alias("k"), F.lit(dx).alias("dx"), F.lit(dz).alias("dz")) for r, k, dx, dz in SPIRAL])
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(steps).alias("o"), "s_nationkey")
    placed = rows.select("s_suppkey", "o.r", "o.k", (F.col("s_suppkey") % 64 + F.col("o.dx")).alias("px"), (F.col("s_nationkey") * 2 + F.col("o.dz")).alias("pz"))
    found = lookup.nearest(placed, F.col("px"), F.col("pz"), hills(spark), RES, ["h"]).where("h < 8")
    return found.groupBy("s_suppkey").agg(F.min(F.struct("r", "k", "h")).alias("m")).select("s_suppkey", "m.r", "m.k", "m.h")


@query(
    "q_occlusion",
    f"""WITH p AS (SELECT s_suppkey, s_suppkey % 60 AS ax, (s_suppkey * 3) % 60 AS az FROM supplier), m AS (SELECT s_suppkey, k, least(greatest(floor(ax + (32 - ax) * k / 8.0), 0), 63)::INTEGER AS cx, least(greatest(floor(az + (32 - az) * k / 8.0), 0), 63)::INTEGER AS cy FROM p, range(1, 8) t(k)),
v AS (SELECT s_suppkey, max(h - 180) AS excess, product(1 - least(greatest((h - 100) / 400, 0), 1)) AS seen, min(k) FILTER (h > 200) AS first_hit FROM m JOIN ({_H}) g ON g.x = cx AND g.y = cy GROUP BY s_suppkey) SELECT s_suppkey, excess, excess <= 4 AS visible, round(seen, 6) AS seen, first_hit FROM v""",
)
def occlusion(spark, sf_dir):
    """P-10, J-17, J-18: a seven-step march with the greatest excess, the product of visibilities and the first hit."""
    s = F.col("s_suppkey")
    march = F.filter(line(s % 60, (s * 3) % 60, F.lit(32), F.lit(32), 8), lambda p: p["k"].between(1, 7))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(march).alias("p")).select("s_suppkey", "p.k", "p.px", "p.pz")
    found = lookup.nearest(rows, F.col("px"), F.col("pz"), hills(spark), RES, ["h"])
    clear = 1 - F.least(F.greatest((F.col("h") - 100) / 400, F.lit(0.0)), F.lit(1.0))
    out = found.groupBy("s_suppkey").agg(F.max(F.col("h") - 180).alias("excess"), F.product(clear).alias("seen"), F.min(F.when(F.col("h") > 200, F.col("k"))).cast("long").alias("first_hit"))
    return out.select("s_suppkey", "excess", (F.col("excess") <= 4).alias("visible"), F.round("seen", 6).alias("seen"), "first_hit")
