"""Recursive subdivision, growth, greedy picks and iterative solvers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, noise
from ..operators import curves, recursive, solvers, spatial
from ..operators.grid import grid
from ..session import table
from . import sqltext as sql
from .grids import RES, hills
from .registry import query

_TILES = """WITH RECURSIVE cam AS (SELECT s_suppkey AS camera, (s_suppkey * 37 % 4096 - 2048)::DOUBLE AS cx, (s_nationkey * 160 - 2048)::DOUBLE AS cz FROM supplier),
t AS (SELECT camera, cx, cz, 0::DOUBLE AS ox, 0::DOUBLE AS oz, 4096::DOUBLE AS size, 0 AS lod FROM cam
UNION ALL SELECT camera, cx, cz, ox + sx * size / 4, oz + sz * size / 4, size / 2, lod + 1 FROM t, (VALUES (-1, -1), (1, -1), (-1, 1), (1, 1)) v(sx, sz)
WHERE size > 128 AND sqrt(power(greatest(abs(cx - ox) - size / 2, 0), 2) + power(greatest(abs(cz - oz) - size / 2, 0), 2)) < size * 2.1)
SELECT camera, ox, oz, size, lod FROM t WHERE NOT (size > 128 AND sqrt(power(greatest(abs(cx - ox) - size / 2, 0), 2) + power(greatest(abs(cz - oz) - size / 2, 0), 2)) < size * 2.1)"""


@query("q_quadtree", _TILES)
def quadtree(spark, sf_dir):
    """G-13, O-7: the tiles around every supplier's camera, under a cap of tiles."""
    s = F.col("s_suppkey")
    cameras = table(spark, sf_dir, "supplier").select(s.alias("camera"), (s * 37 % 4096 - 2048).cast("double").alias("cx"), (F.col("s_nationkey") * 160 - 2048).cast("double").alias("cz"))
    return recursive.quadtree(cameras)


@query("q_icosphere_counts", "SELECT d AS level, (10 * power(4, d) + 2)::BIGINT AS vertices, (30 * power(4, d))::BIGINT AS edges, (20 * power(4, d))::BIGINT AS faces FROM range(4) t(d)")
def icosphere_counts(spark, sf_dir):
    """G-14: subdivision with merged midpoints."""
    return recursive.icosphere_counts(spark, 3).withColumn("level", F.col("level").cast("long"))


@query("q_growth")
def growth(spark, sf_dir):
    """G-12: a seeded grammar for every nation; each plant has 1 + 3 + 9 + 27 branches."""
    seeds = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("plant"), (F.col("n_nationkey") * 7919 + 1).alias("seed"))
    found = recursive.growth(seeds)
    return found.groupBy("plant", "level").agg(F.count("*").alias("branches"), F.round(F.max("y"), 6).alias("top"), F.round(F.sum("length"), 6).alias("length"))


def _thin_sql(picks: int, apart: int) -> str:
    """One step for each pick: the best row that is far from those before."""
    ctes = ["r AS (SELECT c_custkey, c_acctbal, (c_custkey % 101 * 10)::DOUBLE AS x, (c_nationkey * 40)::DOUBLE AS z FROM customer)"]
    for k in range(picks):
        far = " AND ".join(f"NOT EXISTS (SELECT 1 FROM p{j} WHERE power(r.x - p{j}.x, 2) + power(r.z - p{j}.z, 2) < {apart * apart})" for j in range(k)) or "true"
        ctes.append(f"p{k} AS MATERIALIZED (SELECT * FROM r WHERE {far} ORDER BY c_acctbal DESC, c_custkey LIMIT 1)")
    return f"WITH {', '.join(ctes)} " + " UNION ALL ".join(f"SELECT * FROM p{k}" for k in range(picks))


@query("q_greedy_thin", _thin_sql(6, 400))
def greedy_thin(spark, sf_dir):
    """O-4: six customers far apart, taken greedily by balance among all."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", (F.col("c_custkey") % 101 * 10).cast("double").alias("x"), (F.col("c_nationkey") * 40).cast("double").alias("z"))
    return spatial.greedy_thin(rows, "x", "z", [F.desc("c_acctbal"), "c_custkey"], 400.0, 6)


def _field(spark):
    return hills(spark).withColumn("hardness", (F.col("x") * 3 + F.col("y")) % 10 / 12.0)


_EIGHT = [("x", -1), ("x", 1), ("y", -1), ("y", 1)]


def _fill_sql(passes: int) -> str:
    """As many relaxations of the whole surface as it takes, each a step of its own."""
    border = f"x IN (0, {RES - 1}) OR y IN (0, {RES - 1})"
    ctes = [f"t0 AS MATERIALIZED (SELECT x, y, h, CASE WHEN {border} THEN h ELSE 9999.0::DOUBLE END AS w FROM ({sql.heights(RES)}))"]
    for k in range(passes):
        side = f"SELECT *, {sql.moved('w', -1, 'x')} AS a, {sql.moved('w', 1, 'x')} AS b FROM t{k}"
        near = ", ".join(f"{sql.moved(c, by, 'y')} + {e!r}" for c, e in (("w", 0.0045), ("a", 0.0045 * 2**0.5), ("b", 0.0045 * 2**0.5)) for by in (-1, 1))
        ctes.append(f"t{k + 1} AS MATERIALIZED (SELECT x, y, h, CASE WHEN {border} THEN h ELSE greatest(h, least(w, a + 0.0045, b + 0.0045, {near})) END AS w FROM ({side}))")
    return f"WITH {', '.join(ctes)} SELECT x, y, h, round(w, 6) AS filled FROM t{passes}"


@query("q_fill", _fill_sql(60))
def fill(spark, sf_dir):
    """G-2: depressions filled level by level until nothing moves."""
    return solvers.fill(_field(spark), 64, steps=32, tile=32).select("x", "y", "h", F.round("filled", 6).alias("filled"))


def _talus_sql(half_steps: int) -> str:
    ctes = [f"t0 AS MATERIALIZED (SELECT x, y, h, (x * 3 + y) % 10 / 12.0::DOUBLE AS g FROM ({sql.heights(RES)}))"]
    rest = "(2.0 * ({0} * {0} * 2.8::DOUBLE + 0.62::DOUBLE))"
    for k in range(half_steps):
        near = ", ".join(f"{sql.moved(c, by, axis)} AS {c}{j}" for j, (axis, by) in enumerate(_EIGHT) for c in "hg")
        delta = " + ".join(f"greatest(h{j} - h - {rest.format(f'g{j}')}, 0) - greatest(h - h{j} - {rest.format('g')}, 0)" for j in range(4))
        ctes.append(f"t{k + 1} AS MATERIALIZED (SELECT x, y, h + 0.12::DOUBLE * ({delta}) AS h, g FROM (SELECT *, {near} FROM t{k}))")
    return f"WITH {', '.join(ctes)} SELECT x, y, round(h, 5) AS h FROM t{half_steps}"


@query("q_talus", _talus_sql(26))
def talus(spark, sf_dir):
    """G-7."""
    return solvers.talus(_field(spark), 64, 2.0, half_steps=26, tile=32).select("x", "y", F.round("h", 5).alias("h"))


@query("q_erosion")
def erosion(spark, sf_dir):
    """G-1: six iterations on halo tiles."""
    found = solvers.erosion(_field(spark), 64, 2.0, iterations=6, tile=32)
    return found.select("x", "y", *[F.round(c, 6).alias(c) for c in ("h", "water", "sediment", "deposit")])


@query("q_flow_trace")
def flow_trace(spark, sf_dir):
    """G-3, G-4, A-4: paths on the filled surface, tile by tile, visits and flow strength."""
    field = solvers.fill(_field(spark), 64, steps=32, tile=32)
    particles = spark.range(4096).select("id", (F.col("id") % 64 + 0.5).cast("double").alias("px"), (F.floor(F.col("id") / 64) + 0.25).cast("double").alias("py"))
    visits = solvers.trace(particles, field, 64, tile=32)
    strength = solvers.flow_strength(F.col("visits"), 4096, 64 * 64, 14, 0.18)
    return visits.select("x", "y", "visits", F.round(strength, 6).alias("strength"))


@query("q_magic_square", "SELECT ((4 + k // 9 - k % 9) % 9 + 9)::INTEGER % 9 AS i, ((8 - 2 * (k // 9) + k % 9) % 9 + 9)::INTEGER % 9 AS j, k + 1 AS value FROM range(81) t(k)")
def magic_square(spark, sf_dir):
    """G-17."""
    return curves.magic_square(spark, 8)


PLANES = ((1.0, 0.0, 0.0, 0.7), (0.0, 0.8, 0.6, 0.8), (-0.6, 0.0, 0.8, 0.55))
_DIRECTIONS = "SELECT k, sqrt(1 - y * y) * cos(k * pi() * (3 - sqrt(5::DOUBLE))) AS x, y, sqrt(1 - y * y) * sin(k * pi() * (3 - sqrt(5::DOUBLE))) AS z, 1.0::DOUBLE AS r FROM (SELECT k, 1 - (2 * k + 1) / 500.0::DOUBLE AS y FROM range(500) t(k))"


def _cut_sql() -> str:
    out = _DIRECTIONS
    for a, b, c, o in PLANES:
        toward = f"(x * {a} + y * {b} + z * {c})"
        out = f"SELECT * REPLACE (CASE WHEN {toward} > 0.001 AND {o} / {toward} < r THEN {o} / {toward} + (r - {o} / {toward}) * 0.035 ELSE r END AS r) FROM ({out})"
    return f"SELECT k, round(r, 6) AS r FROM ({out})"


@query("q_plane_cuts", _cut_sql())
def plane_cuts(spark, sf_dir):
    """G-15: a ball cut by planes in order."""
    d = spark.range(500).select(F.col("id").alias("k"), hashing.sphere_direction(F.col("id"), 500).alias("d"))
    return d.select("k", F.round(curves.plane_cuts(F.lit(1.0), [F.col("d.x"), F.col("d.y"), F.col("d.z")], PLANES), 6).alias("r"))


def lines(spark, sf_dir):
    """A short line of twelve points for every nation."""
    k, n = F.col("seq"), F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("seq"))
    return rows.select(n.alias("line"), "seq", (F.cos(k * 0.5 + n) * (2 + n * 0.1)).alias("x"), (k * 0.7).alias("y"), (F.sin(k * 0.5 + n) * (2 + n * 0.1)).alias("z"))


@query("q_path_points")
def path_points(spark, sf_dir):
    """G-18: points at equal arc lengths along a centripetal curve."""
    found = curves.path_points(lines(spark, sf_dir), 24)
    return found.select("line", "k", *[F.round(c, 6).alias(c) for c in "xyz"])


@query("q_line_frames")
def line_frames(spark, sf_dir):
    """G-16: normals carried along lines without twisting."""
    found = curves.frames(lines(spark, sf_dir))
    return found.select("line", "seq", *[F.round(c, 6).alias(c) for c in ("along", "nx", "ny", "nz")])


@query("q_ring_flood")
def ring_flood(spark, sf_dir):
    """G-10: empty cells of each tile filled from their covered neighbours, ring by ring."""
    cells = grid(spark, 64).withColumn("h", ((F.col("x") * F.col("x") * 7 + F.col("y") * 13) % 101).cast("double"))
    tiles = cells.select((F.floor(F.col("x") / 32) * 2 + F.floor(F.col("y") / 32)).cast("int").alias("tile"), (F.col("x") % 32).alias("x"), (F.col("y") % 32).alias("y"), F.when(F.col("h") < 12, F.col("h")).alias("v"))
    return curves.ring_flood(tiles).withColumn("v", F.round("v", 6))


_TILED = "SELECT x, y, k, x / 8.0 + k * 4 AS px, y / 8.0 - k * 8 AS py FROM (" + sql.cells(32) + "), range(2) t(k)"
_LATTICE = f"SELECT x, y, k, px - floor(px) AS fx, py - floor(py) AS fy, ((floor(px) + r) % 4 + 4)::BIGINT % 4 AS cx, ((floor(py) + u) % 4 + 4)::BIGINT % 4 AS cy, 0::BIGINT AS cz, r, u, 11::BIGINT AS h FROM ({_TILED}), (VALUES (0), (1)) a(r), (VALUES (0), (1)) b(u)"
_WEIGHT = " * ".join(f"CASE {side} WHEN 1 THEN {f} * {f} * (3 - 2 * {f}) ELSE 1 - {f} * {f} * (3 - 2 * {f}) END" for side, f in (("r", "fx"), ("u", "fy")))


@query(
    "q_periodic_noise",
    f"WITH n AS (SELECT x, y, k, sum(h / 4294967296.0 * {_WEIGHT}) AS v FROM ({sql.hashed(_LATTICE)}) GROUP BY x, y, k) SELECT x, y, round(max(v) FILTER (k = 0), 6) AS noise, round(max(v) FILTER (k = 1), 6) AS wrapped FROM n GROUP BY x, y",
)
def periodic_noise(spark, sf_dir):
    """N-7: a tile of periodic noise, and the same a period further."""
    x, y = F.col("x") / 8.0, F.col("y") / 8.0
    here, there = noise.periodic_noise2(x, y, 4, 11), noise.periodic_noise2(x + 4, y - 8, 4, 11)
    return grid(spark, 32).select("x", "y", F.round(here, 6).alias("noise"), F.round(there, 6).alias("wrapped"))


_OFFSETS = ((0.0, 0.0), (0.125, 0.0), (-0.125, 0.0), (0.0, 0.125), (0.0, -0.125))
_BAKE = f"SELECT x, y, k, x / 8.0 + ox AS px, y / 8.0 + oy AS py FROM ({sql.cells(32)}), (VALUES " + ", ".join(f"({k}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for k, (a, b) in enumerate(_OFFSETS)) + ") v(k, ox, oy)"


@query(
    "q_noise_baked",
    f"WITH n AS (SELECT x, y, k, sum(h / 4294967296.0 * {_WEIGHT}) AS v FROM ({sql.hashed(_LATTICE.replace(_TILED, _BAKE))}) GROUP BY x, y, k) SELECT x, y, round(max(v) FILTER (k = 0), 6) AS noise, round((max(v) FILTER (k = 1) - max(v) FILTER (k = 2)) * 4, 5) AS gx, round((max(v) FILTER (k = 3) - max(v) FILTER (k = 4)) * 4, 5) AS gy FROM n GROUP BY x, y",
)
def noise_baked(spark, sf_dir):
    """N-6: a table of periodic noise with its gradient."""
    x, y = F.col("x") / 8.0, F.col("y") / 8.0
    v = [noise.periodic_noise2(x + a, y + b, 4, 11) for a, b in _OFFSETS]
    return grid(spark, 32).select("x", "y", F.round(v[0], 6).alias("noise"), F.round((v[1] - v[2]) * 4, 5).alias("gx"), F.round((v[3] - v[4]) * 4, 5).alias("gy"))
