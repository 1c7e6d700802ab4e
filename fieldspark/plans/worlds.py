"""Layered lookups, reprojection, sight lines, classification and four-layer scatter."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing
from ..functions.scalar import hour_of, pick
from ..operators import lookup, scatter, stencil
from ..operators.grid import grid
from ..session import table
from ..sources.files import half, unorm8
from . import sqltext as sql
from .grids import RES, hills
from .registry import query

LAYERS, BASE, RATIO = 6, 2.0, 2.2


@query(
    "q_slot_hash",
    f"""WITH a AS (SELECT i, ({sql.mul('((i + 77) & 4294967295)', 747796405)} + 2891336453) & {sql.MASK} AS a FROM range(2000) t(i)), b AS (SELECT i, {sql.mul('xor(a >> ((a >> 28) + 4)::INTEGER, a)', 277803737)} AS b FROM a)
SELECT i, xor(b >> 22, b) & 16777215 AS h FROM b""",
)
def slot_hash(spark, sf_dir):
    """H-6."""
    return spark.range(2000).select(F.col("id").alias("i"), hashing.slot_hash(F.col("id"), 77).alias("h"))


_STACK = f"SELECT x, y, l AS layer, ((x * 7 + y * 13 + l * 29) % 50)::DOUBLE AS v FROM ({sql.cells(16)}), range({LAYERS}) t(l)"


@query(
    "q_trilinear_layers",
    f"""WITH p AS (SELECT p_partkey, least(greatest((p_partkey % 37) * 0.45::DOUBLE, 0), 15) AS gx, least(greatest(p_size * 0.3::DOUBLE, 0), 15) AS gy, least(greatest(log2(greatest(p_retailprice / 20 / {BASE}, 1)) / log2({RATIO}::DOUBLE), 0), {LAYERS - 1}) AS li FROM part),
c AS (SELECT p_partkey, least(floor(gx) + dx, 15)::INTEGER AS cx, least(floor(gy) + dy, 15)::INTEGER AS cy, least(floor(li) + dl, {LAYERS - 1})::INTEGER AS cl, CASE dx WHEN 1 THEN gx - floor(gx) ELSE 1 - (gx - floor(gx)) END * CASE dy WHEN 1 THEN gy - floor(gy) ELSE 1 - (gy - floor(gy)) END * CASE dl WHEN 1 THEN li - floor(li) ELSE 1 - (li - floor(li)) END AS w FROM p, (VALUES (0), (1)) a(dx), (VALUES (0), (1)) b(dy), (VALUES (0), (1)) d(dl))
SELECT p_partkey, round(sum(w * v), 5) AS v FROM c JOIN ({_STACK}) s ON s.x = cx AND s.y = cy AND s.layer = cl GROUP BY p_partkey""",
)
def trilinear_layers(spark, sf_dir):
    """J-13: log-spaced layers, inverted by a logarithm."""
    stack = grid(spark, 16).withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(LAYERS - 1)))).withColumn("v", ((F.col("x") * 7 + F.col("y") * 13 + F.col("layer") * 29) % 50).cast("double"))
    layer = F.log2(F.greatest(F.col("p_retailprice") / 20 / BASE, F.lit(1.0))) / F.log2(F.lit(RATIO))
    found = lookup.trilinear(table(spark, sf_dir, "part"), ["p_partkey"], (F.col("p_partkey") % 37) * 0.45, F.col("p_size") * 0.3, layer, stack, 16, LAYERS, "v", "v")
    return found.select("p_partkey", F.round("v", 5).alias("v"))


@query(
    "q_reprojection",
    f"SELECT count(*) AS cells, count(*) FILTER (abs(a.h - b.h) > 40) AS changed, round(avg(abs(a.h - b.h)), 6) AS mean_delta FROM (SELECT *, least(greatest(floor(x * 0.98::DOUBLE - y * 0.02::DOUBLE + 1.37::DOUBLE), 0), 63)::INTEGER AS px, least(greatest(floor(x * 0.02::DOUBLE + y * 0.98::DOUBLE - 0.61::DOUBLE), 0), 63)::INTEGER AS py FROM ({sql.heights(RES)})) a JOIN ({sql.heights(RES)}) b ON b.x = px AND b.y = py",
)
def reprojection(spark, sf_dir):
    """J-15: each cell against the cell of the frame before that a transform leads to."""
    now = hills(spark).withColumnRenamed("h", "now")
    px, py = F.col("x") * 0.98 - F.col("y") * 0.02 + 1.37, F.col("x") * 0.02 + F.col("y") * 0.98 - 0.61
    found = lookup.nearest(now, px, py, hills(spark), RES, ["h"]).withColumn("d", F.abs(F.col("now") - F.col("h")))
    return found.agg(F.count("*").alias("cells"), F.count_if(F.col("d") > 40).alias("changed"), F.round(F.avg("d"), 6).alias("mean_delta"))


#: Eight sight lines as whole steps.
YAWS = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))


@query(
    "q_sightline_best",
    "WITH yaw(k, dx, dz) AS (VALUES " + ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(YAWS)) + f"""), s AS (SELECT x, y, h + 60 AS eye FROM ({sql.heights(RES)}) WHERE x % 8 = 0 AND y % 8 = 0),
r AS (SELECT s.x, s.y, k, d, h > eye + d * 2 AS blocked FROM s, yaw, range(1, 13) t(d) JOIN ({sql.heights(RES)}) g ON g.x = s.x + dx * d AND g.y = s.y + dz * d),
l AS (SELECT x, y, k, max(d) FILTER (d < first) AS land FROM (SELECT *, coalesce(min(d) FILTER (blocked) OVER (PARTITION BY x, y, k), 99) AS first FROM r) GROUP BY x, y, k),
b AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY land DESC, k) AS n FROM l WHERE land IS NOT NULL) SELECT x, y, k AS yaw, land FROM b WHERE n = 1""",
)
def sightline_best(spark, sf_dir):
    """A-32: the longest open line of each site, the first of equals."""
    yaws = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("dx"), F.lit(b).alias("dz")) for k, (a, b) in enumerate(YAWS)])
    sites = hills(spark).where("x % 8 = 0 and y % 8 = 0").select(F.col("x").alias("sx"), F.col("y").alias("sy"), (F.col("h") + 60).alias("eye"), F.explode(yaws).alias("w"))
    steps = sites.select("sx", "sy", "eye", F.col("w.k").alias("yaw"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("d"), "w")
    met = steps.select("*", (F.col("sx") + F.col("w.dx") * F.col("d")).alias("x"), (F.col("sy") + F.col("w.dz") * F.col("d")).alias("y")).join(hills(spark), ["x", "y"])
    # The first blocked step of a line is a minimum; land before it needs no second pass over the steps.
    lines = met.groupBy("sx", "sy", "yaw").agg(F.min(F.when(F.col("h") > F.col("eye") + F.col("d") * 2, F.col("d"))).alias("first"), F.max("d").alias("last"))
    land = lines.withColumn("land", F.coalesce(F.col("first") - 1, F.col("last"))).where("land > 0")
    best = land.groupBy("sx", "sy").agg(F.max(F.struct("land", (-F.col("yaw")).alias("k"))).alias("b"))
    return best.select(F.col("sx").alias("x"), F.col("sy").alias("y"), (-F.col("b.k")).alias("yaw"), F.col("b.land").cast("long").alias("land"))


@query(
    "q_sun_direction",
    """WITH h AS (SELECT event_id, (extract(hour FROM ts) + extract(minute FROM ts) / 60.0::DOUBLE + floor(extract(second FROM ts)) / 3600.0::DOUBLE - 5.4) / 15.2 AS d FROM events),
e AS (SELECT event_id, greatest(sin(pi() * least(greatest(d, 0.001), 0.999)) * 1.02 - 0.085, -0.12) AS e, -0.6 + d * 2.4 AS az FROM h)
SELECT event_id, round(cos(e) * cos(az), 5) AS x, round(sin(e), 5) AS y, round(cos(e) * sin(az), 5) AS z FROM e""",
)
def sun_direction(spark, sf_dir):
    """Composite scalar math: the sun's direction at an hour."""
    day = (hour_of(F.col("ts")) - 5.4) / 15.2
    e = F.greatest(F.sin(F.pi() * F.least(F.greatest(day, F.lit(0.001)), F.lit(0.999))) * 1.02 - 0.085, F.lit(-0.12))
    az = day * 2.4 - 0.6
    return table(spark, sf_dir, "events").select("event_id", F.round(F.cos(e) * F.cos(az), 5).alias("x"), F.round(F.sin(e), 5).alias("y"), F.round(F.cos(e) * F.sin(az), 5).alias("z"))


@query(
    "q_biome_fields",
    f"""WITH c AS (SELECT *, sqrt(((e - w) / 128) * ((e - w) / 128) + ((n - s) / 128) * ((n - s) / 128)) AS slope, (x * 3 + y * 5) % 100 / 100.0::DOUBLE AS moist FROM (SELECT *, {sql.moved('h', -1, 'x')} AS w, {sql.moved('h', 1, 'x')} AS e, {sql.moved('h', -1, 'y')} AS s, {sql.moved('h', 1, 'y')} AS n FROM ({sql.heights(RES)}))),
b AS (SELECT *, CASE WHEN h > 230 THEN 0 WHEN h > 205 THEN 1 WHEN moist > 0.72 AND slope < 0.9 AND h < 120 THEN 5 WHEN (x + y) % 9 > 5 THEN 3 WHEN slope < 0.6 AND moist < 0.5 THEN 4 ELSE 2 END AS biome FROM c)
SELECT biome, count(*) AS cells, round(avg(slope), 5) AS slope, count(DISTINCT floor(least(greatest(moist, 0), 1) * 255 + 0.5)) AS steps FROM b GROUP BY biome""",
)
def biome_fields(spark, sf_dir):
    """P-7, W-1, SNK-1: classification of a field, with a channel stored in 255ths."""
    field = stencil.central_difference(hills(spark), "h", 64.0).withColumn("moist", (F.col("x") * 3 + F.col("y") * 5) % 100 / 100.0)
    h, slope, moist = F.col("h"), F.col("slope"), F.col("moist")
    tree = F.when(h > 230, 0).when(h > 205, 1).when((moist > 0.72) & (slope < 0.9) & (h < 120), 5).when((F.col("x") + F.col("y")) % 9 > 5, 3).when((slope < 0.6) & (moist < 0.5), 4).otherwise(2)
    return field.groupBy(tree.alias("biome")).agg(F.count("*").alias("cells"), F.round(F.avg("slope"), 5).alias("slope"), F.count_distinct(unorm8(moist)).alias("steps"))


@query(
    "q_half_precision",
    "SELECT p_partkey, CASE WHEN p_retailprice = 0 THEN 0 ELSE round_even(p_retailprice / power(2.0::DOUBLE, floor(log2(p_retailprice)) - 10), 0) * power(2.0::DOUBLE, floor(log2(p_retailprice)) - 10) END AS stored FROM part",
)
def half_precision(spark, sf_dir):
    """T3: values as 16-bit floats hold them."""
    return table(spark, sf_dir, "part").select("p_partkey", half(F.col("p_retailprice")).alias("stored"))


#: Layers with their cell size, salt and density by biome.
SCATTER = (("trees", 1, 101, (0.0, 0.25, 0.8, 0.85, 0.1, 0.25)), ("understory", 1, 202, (0.05, 0.3, 0.6, 0.7, 0.4, 0.5)), ("extras", 2, 303, (0.1, 0.1, 0.2, 0.2, 0.1, 0.1)), ("stones", 1, 404, (0.7, 0.4, 0.15, 0.3, 0.1, 0.05)))
LAYER_CAP = 250


def _layer_sql(name: str, step: int, salt: int, density: tuple) -> str:
    biome = "CASE WHEN h > 230 THEN 0 WHEN h > 205 THEN 1 WHEN (x + y) % 9 > 5 THEN 3 WHEN h < 40 THEN 5 WHEN h < 90 THEN 4 ELSE 2 END"
    gate = "CASE biome " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(density)) + " END"
    source = f"SELECT x, y, h, {biome} AS biome FROM ({sql.heights(RES)}) WHERE x % {step} = 0 AND y % {step} = 0 AND h > 12"
    kept = f"SELECT * EXCLUDE (u, v) FROM ({sql.pcg(source, 'x', 'y', salt)}) WHERE u < {gate} * 16777216"
    picked = sql.pcg(kept, "x", "y", salt + 7)
    return f"SELECT '{name}' AS layer, biome, CASE WHEN u <= 9 * 1048576 THEN 0 WHEN u <= 14 * 1048576 THEN 1 ELSE 2 END AS cls, x, y, row_number() OVER (PARTITION BY biome ORDER BY y, x) AS place FROM ({picked})"


@query(
    "q_four_layer_scatter",
    f"SELECT layer, biome, cls, count(*) AS n, sum(x * 64 + y)::BIGINT AS places FROM ({' UNION ALL '.join(_layer_sql(*layer) for layer in SCATTER)}) WHERE place <= {LAYER_CAP} GROUP BY layer, biome, cls",
)
def four_layer_scatter(spark, sf_dir):
    """G-21, P-4, P-5, W-6, A-3: exclusions first, the hash gate last, then classes and a cap."""
    h, x, y = F.col("h"), F.col("x"), F.col("y")
    biome = F.when(h > 230, 0).when(h > 205, 1).when((x + y) % 9 > 5, 3).when(h < 40, 5).when(h < 90, 4).otherwise(2)
    out = None
    for name, step, salt, density in SCATTER:
        cells = hills(spark).where((x % step == 0) & (y % step == 0) & (h > 12)).withColumn("biome", biome)
        kept = scatter.gate(cells, x, y, salt, pick(F.col("biome"), list(density[:-1]), density[-1]))
        classed = kept.withColumn("cls", scatter.weighted_pick(hashing.pcg2d(x, y, salt + 7)["u"], [F.lit(k * 1048576) for k in (9, 5, 2)]))
        own = scatter.capped(classed, ["biome"], ["y", "x"], LAYER_CAP).select(F.lit(name).alias("layer"), "biome", "cls", "x", "y")
        out = own if out is None else out.unionByName(own)
    return out.groupBy("layer", "biome", "cls").agg(F.count("*").alias("n"), F.sum(x * 64 + y).alias("places"))
