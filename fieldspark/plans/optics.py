"""Atmosphere, gathers, float hashes, masks, guards and vector helpers."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.scalar import clamp, number_or
from ..operators import optics
from ..session import table
from . import sqltext as sql
from .grids import RES, hills
from .registry import query
from .terrain import _step


def _depth_sql(rays: str, keys: str, steps: int) -> str:
    """Extinction along `rays` (keys, r, mu)."""
    ground, top = (f"(r * r * (mu * mu - 1) + {e * e!r}::DOUBLE)" for e in (optics.GROUND, optics.TOP))
    path = f"CASE WHEN mu < 0 AND {ground} >= 0 THEN greatest(-r * mu - sqrt({ground}), 0) ELSE greatest(-r * mu + sqrt(greatest({top}, 0)), 0) END"
    parts = ", ".join(f"sum(({a!r}::DOUBLE * exp(-h / 8) + {optics.MIE!r}::DOUBLE * exp(-h / 1.2::DOUBLE) + {o!r}::DOUBLE * greatest(1 - abs(h - 25) / 15, 0)) * dt) AS tau_{c}" for a, o, c in zip(optics.RAYLEIGH, optics.OZONE, "rgb"))
    return f"SELECT {keys}, {parts} FROM (SELECT *, sqrt(t * t + r * r + t * r * mu * 2) - {optics.GROUND!r}::DOUBLE AS h FROM (SELECT *, (k + 0.5) * dt AS t FROM (SELECT *, {path} / {steps} AS dt FROM ({rays})), range({steps}) s(k))) GROUP BY {keys}"


_RAYS = "SELECT s_suppkey, 6360.0::DOUBLE + (s_suppkey * 37 % 1000) / 10.0 AS r, (s_nationkey - 12) / 12.5::DOUBLE AS mu FROM supplier"
_AROUND = "SELECT n_nationkey, k AS ray, 6360.0::DOUBLE + n_nationkey * 4 AS r, 1 - (2 * k + 1) / 64.0::DOUBLE AS mu FROM nation, range(64) d(k)"


@query("q_optical_depth", f"SELECT s_suppkey, round(tau_r, 5) AS tau_r, round(tau_g, 5) AS tau_g, round(tau_b, 5) AS tau_b FROM ({_depth_sql(_RAYS, 's_suppkey', 44)})")
def optical_depth(spark, sf_dir):
    """A-29: extinction over 44 steps of a ray, for every supplier."""
    rays = table(spark, sf_dir, "supplier").select("s_suppkey", (6360.0 + (F.col("s_suppkey") * 37 % 1000) / 10.0).alias("r"), ((F.col("s_nationkey") - 12) / 12.5).alias("mu"))
    return optics.optical_depth(rays, ["s_suppkey"], "r", "mu").select("s_suppkey", *[F.round(f"tau_{c}", 5).alias(f"tau_{c}") for c in "rgb"])


@query("q_sky_mean", f"SELECT n_nationkey, round(avg((exp(-tau_r) + exp(-tau_g) + exp(-tau_b)) / 3), 6) AS clear FROM ({_depth_sql(_AROUND, 'n_nationkey, ray', 44)}) GROUP BY n_nationkey")
def sky_mean(spark, sf_dir):
    """A-29: the mean over 64 directions around sites at different heights."""
    sites = table(spark, sf_dir, "nation").select("n_nationkey", (6360.0 + F.col("n_nationkey") * 4).alias("r"))
    return optics.mean_transmittance(sites, "n_nationkey", "r").select("n_nationkey", F.round("clear", 6).alias("clear"))


_TAPS = ", ".join(f"({math.cos(k * 2.399963 + 0.7) * math.sqrt((k + 0.5) / 8) * 2.5!r}::DOUBLE, {math.sin(k * 2.399963 + 0.7) * math.sqrt((k + 0.5) / 8) * 2.5!r}::DOUBLE)" for k in range(8))


@query(
    "q_spiral_gather",
    f"""WITH f AS (SELECT x, y, h / 40 AS depth, (x * 5 + y * 3) % 17 + 0.0::DOUBLE AS light FROM ({sql.heights(RES)})),
t AS (SELECT a.x, a.y, {_step(1.8, 0.25, 'abs(b.depth - a.depth)')} AS w, b.light FROM (SELECT f.*, least(greatest(floor(x + dx + 0.5), 0), {RES - 1})::INTEGER AS cx, least(greatest(floor(y + dy + 0.5), 0), {RES - 1})::INTEGER AS cy FROM f, (VALUES {_TAPS}) v(dx, dy)) a JOIN f b ON b.x = cx AND b.y = cy)
SELECT x, y, round(sum(w * light) / greatest(sum(w), 1e-3), 5) AS gathered, round(sum(w) / 8, 5) AS support FROM t GROUP BY x, y""",
)
def spiral_gather(spark, sf_dir):
    """A-30: eight spiral taps, gated by depth."""
    field = hills(spark).select("x", "y", (F.col("h") / 40).alias("depth"), ((F.col("x") * 5 + F.col("y") * 3) % 17).cast("double").alias("light"))
    found = optics.spiral_gather(field, RES, "depth", "light", 2.5)
    return found.select("x", "y", F.round("gathered", 5).alias("gathered"), F.round("support", 5).alias("support"))


def _swirl(a: tuple[str, str, str], turned: tuple[int, int, int], bias: float, ends: dict[str, str], source: str) -> str:
    dot = " + ".join(f"p{k} * (p{t} + {bias}::DOUBLE)" for k, t in enumerate(turned))
    fract = lambda e: f"({e}) - floor({e})"
    first = ", ".join(f"{fract(e)} AS p{k}" for k, e in enumerate(a))
    out = ", ".join(f"{fract(e)} AS {n}" for n, e in ends.items())
    return f"SELECT *, {out} FROM (SELECT * REPLACE (p0 + q AS p0, p1 + q AS p1, p2 + q AS p2) FROM (SELECT *, {dot} AS q FROM (SELECT *, {first} FROM ({source}))))"


_TENTH = ("x * 0.1031::DOUBLE", "y * 0.1031::DOUBLE", "x * 0.1031::DOUBLE")
_H12 = _swirl(_TENTH, (1, 2, 0), 33.33, {"a": "(p0 + p1) * p2"}, "SELECT i, i % 50 + 0.25::DOUBLE AS x, i // 50 + 0.5::DOUBLE AS y FROM range(2000) t(i)")
_H13 = _swirl((*_TENTH[:2], "i % 7 * 0.1031::DOUBLE"), (2, 1, 0), 31.32, {"b": "(p0 + p1) * p2"}, f"SELECT * EXCLUDE (p0, p1, p2, q) FROM ({_H12})")
_H22 = _swirl(("x * 0.1031::DOUBLE", "y * 0.103::DOUBLE", "x * 0.0973::DOUBLE"), (1, 2, 0), 33.33, {"u": "(p0 + p1) * p2", "v": "(p0 + p2) * p1"}, f"SELECT * EXCLUDE (p0, p1, p2, q) FROM ({_H13})")


@query("q_float_hashes", f"SELECT i, round(a, 5) AS h12, round(b, 5) AS h13, round(u, 5) AS h22_u, round(v, 5) AS h22_v FROM ({_H22})")
def float_hashes(spark, sf_dir):
    """H-7: hashes of places in floating point."""
    i = F.col("id")
    p = spark.range(2000).select(i.alias("i"), (i % 50 + 0.25).alias("x"), (F.floor(i / 50) + 0.5).alias("y"), (i % 7).cast("double").alias("z"))
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    found = p.select("i", optics.hash12(x, y).alias("h12"), optics.hash13(x, y, z).alias("h13"), optics.hash22(x, y).alias("h"))
    return found.select("i", F.round("h12", 5).alias("h12"), F.round("h13", 5).alias("h13"), F.round("h.u", 5).alias("h22_u"), F.round("h.v", 5).alias("h22_v"))


@query(
    "q_masks",
    """WITH p AS (SELECT c_custkey, c_acctbal, c_custkey * 37 % 4300 - 2150 AS x, c_nationkey * 170 - 2040 AS z FROM customer)
SELECT c_custkey, x <= 0 AS left_half, list_contains(string_split(CASE c_custkey % 3 WHEN 0 THEN 'ao,fog' WHEN 1 THEN 'fog' ELSE '' END, ','), 'fog') AS fog_off, CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE least(greatest(c_acctbal / 5000, 0), 1) END AS guarded FROM p WHERE NOT (x > -600 AND z > -500 AND x < 700 AND z < 800) AND abs(x) < 2044 AND abs(z) < 2044""",
)
def masks(spark, sf_dir):
    """P-12, P-14, P-15, P-16: flag sets, a cut-out in the world's bounds, halves, and a guard against what isn't a number."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", (key * 37 % 4300 - 2150).alias("x"), (F.col("c_nationkey") * 170 - 2040).alias("z"))
    x, z = F.col("x"), F.col("z")
    inner = (x > -600) & (z > -500) & (x < 700) & (z < 800)
    flags = F.when(key % 3 == 0, "ao,fog").when(key % 3 == 1, "fog").otherwise("")
    shade = F.when(key % 11 == 0, float("nan")).otherwise(F.col("c_acctbal") / 5000)
    kept = rows.where(~inner & (F.abs(x) < 2044) & (F.abs(z) < 2044))
    return kept.select("c_custkey", (x <= 0).alias("left_half"), F.array_contains(F.split(flags, ","), "fog").alias("fog_off"), clamp(number_or(shade, 1.0), 0.0, 1.0).alias("guarded"))


_UNIT = "SELECT *, sqrt(1 - ny * ny) AS nx, 0.0::DOUBLE AS nz, d0 / l AS ix, d1 / l AS iy, d2 / l AS iz FROM (SELECT p_partkey, (p_size + 20) / 80.0::DOUBLE AS ny, p_partkey % 7 - 3.5::DOUBLE AS d0, -(p_size + 1.0::DOUBLE) AS d1, p_partkey % 5 - 2.0::DOUBLE AS d2, sqrt(power(p_partkey % 7 - 3.5, 2) + power(p_size + 1.0::DOUBLE, 2) + power(p_partkey % 5 - 2.0, 2)) AS l FROM part)"
_BENT = f"SELECT *, 1 - 1.33::DOUBLE * 1.33::DOUBLE * (1 - d * d) AS k FROM (SELECT *, nx * ix + ny * iy + nz * iz AS d FROM ({_UNIT}))"


@query(
    "q_vector_scalars",
    f"""SELECT p_partkey, round(iy - ny * d * 2, 6) AS mirrored, round(CASE WHEN k < 0 THEN 0 ELSE iy * 1.33::DOUBLE - ny * (d * 1.33::DOUBLE + sqrt(greatest(k, 0))) END, 6) AS bent, round((1 - 0.76::DOUBLE * 0.76) / (4 * pi() * power(1 + 0.76::DOUBLE * 0.76 - 2 * 0.76::DOUBLE * d, 1.5)), 6) AS phase,
round(least(greatest((ix + iz) / (abs(ix) + abs(iz) - iy) * 0.5 + 0.5, 0), 1), 6) AS u, round(least(greatest((iz - ix) / (abs(ix) + abs(iz) - iy) * 0.5 + 0.5, 0), 1), 6) AS v FROM ({_BENT})""",
)
def vector_scalars(spark, sf_dir):
    """Math scalars: mirrored and bent rays, the phase function and the half octahedron."""
    size, key = F.col("p_size"), F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", ((size + 20) / 80.0).alias("ny"), (key % 7 - 3.5).alias("d0"), (-(size + 1.0)).alias("d1"), (key % 5 - 2.0).alias("d2"))
    length = F.sqrt(sum((F.col(c) * F.col(c) for c in ("d1", "d2")), F.col("d0") * F.col("d0")))
    rows = rows.withColumn("l", length).select("p_partkey", F.sqrt(1 - F.col("ny") * F.col("ny")).alias("nx"), "ny", F.lit(0.0).alias("nz"), *[(F.col(f"d{k}") / F.col("l")).alias(c) for k, c in enumerate(("ix", "iy", "iz"))])
    i, n = [F.col(c) for c in ("ix", "iy", "iz")], [F.col(c) for c in ("nx", "ny", "nz")]
    u, v = optics.hemi_octahedral(i[0], -i[1], i[2])
    values = {"mirrored": optics.reflect(i, n)[1], "bent": optics.refract(i, n, 1.33)[1], "phase": optics.phase(optics.dot(n, i), 0.76), "u": u, "v": v}
    return rows.select("p_partkey", *[F.round(c, 6).alias(name) for name, c in values.items()])


@query(
    "q_map_scalars",
    "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type || ':' || n, ',' ORDER BY event_type) FILTER (n > 2 AND event_type < 'r') AS kept, sum(n)::BIGINT AS total, count(*) AS kinds FROM c GROUP BY user_id",
)
def map_scalars(spark, sf_dir):
    """Map scalars, P-19: counts by kind as a map, filtered by key and threshold, listed in the order of keys."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    some = F.map_filter("m", lambda k, v: (v > 2) & (k < "r"))
    listed = F.transform(F.array_sort(F.map_entries(some)), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    total = F.aggregate(F.map_values("m"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return maps.select("user_id", F.when(F.size(some) > 0, F.array_join(listed, ",")).alias("kept"), total.alias("total"), F.size("m").cast("long").alias("kinds"))
