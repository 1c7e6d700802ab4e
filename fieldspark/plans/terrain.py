"""The composed world and its classification, with the same projection written out in SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import hashing
from ..functions.scalar import pick, saturate, smoothstep
from ..operators import lookup, scatter, spatial, stencil, terrain
from ..operators.grid import grid, world
from ..session import stored
from . import sqltext as sql
from .grids import RES, _bilinear, hills
from .registry import query

SIDE = 40
TEXEL = 4096.0 / SIDE


def _step(low: float, high: float, x: str) -> str:
    """The Hermite step of a column or a short expression."""
    t = f"least(greatest(({x} - ({low!r}::DOUBLE)) / ({high - low!r}::DOUBLE), 0), 1)"
    return f"({t} * {t} * (3 - 2 * {t}))"


def _worley(scale: float, at: float, out: str) -> str:
    """(x, y, out): distance to the nearest hashed feature point around (kx, ky)."""
    p = terrain.WORLEY_PERIOD
    cells = f"SELECT x, y, px, py, floor(px)::BIGINT + dx AS nx, floor(py)::BIGINT + dy AS ny, ((floor(px)::BIGINT + dx) % {p} + {p}) % {p} AS hx, ((floor(py)::BIGINT + dy) % {p} + {p}) % {p} AS hy FROM (SELECT x, y, kx / {scale!r}::DOUBLE + {at!r}::DOUBLE AS px, ky / {scale!r}::DOUBLE + {at!r}::DOUBLE AS py FROM w), (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy)"
    return f"SELECT x, y, sqrt(min(power(nx + u / 16777216.0::DOUBLE - px, 2) + power(ny + v / 16777216.0::DOUBLE - py, 2))) AS {out} FROM ({sql.pcg(cells, 'hx', 'hy', terrain.WORLEY_SALT)}) GROUP BY x, y"


def _segments(line, out: str) -> str:
    rows = ", ".join(f"({k}, {', '.join(f'{v!r}::DOUBLE' for v in (*a, *b))})" for k, (a, b) in enumerate(zip(line, line[1:])))
    t = "least(greatest(((sx - ax) * (bx - ax) + (sy - az) * (bz - az)) / ((bx - ax) * (bx - ax) + (bz - az) * (bz - az)), 0), 1)"
    return f"SELECT x, y, min(d) AS {out}_dist, arg_min(f0 + (f1 - f0) * t, d + k * 1e-12) AS {out}_floor FROM (SELECT *, sqrt(power(sx - ax - (bx - ax) * t, 2) + power(sy - az - (bz - az) * t, 2)) AS d FROM (SELECT w.*, s.*, {t} AS t FROM w, (VALUES {rows}) s(k, ax, az, f0, bx, bz, f1))) GROUP BY x, y"


def macro_sql(side: int) -> str:
    """(x, y, height, hardness, zones, noise) of a grid of `side` cells, as CTE m."""
    known = terrain.channels()
    table = ", ".join(f"({k}, {', '.join(f'{v!r}::DOUBLE' for v in c)})" for k, c in enumerate(known.values()))
    place = f"SELECT x, y, k, wx * a + wy * b + c AS x_, wx * d + wy * e + f AS y_ FROM p, (VALUES {table}) t(k, a, b, c, d, e, f)"
    # The grid's x and y are kept aside while a place takes their names.
    noise = sql.value_noise(f"SELECT x AS gx, y AS gy, k, x_ AS x, y_ AS y, 0.5::DOUBLE AS z, (100 + k)::BIGINT AS s FROM ({place})", "gx, gy, k")
    wide = ", ".join(f"max(v) FILTER (k = {k}) AS n_{name}" for k, name in enumerate(known))
    single = lambda x, y, seed, out, source: f"SELECT gx AS x, gy AS y, v AS {out} FROM ({sql.value_noise(f'SELECT x AS gx, y AS gy, {x} AS x, {y} AS y, 0.5::DOUBLE AS z, {seed}::BIGINT AS s FROM {source}', 'gx, gy')})"
    ca, sa = math.cos(terrain.KARST_TURN), math.sin(terrain.KARST_TURN)
    kx, ky = (f"(k{a} - {c!r}::DOUBLE)" for a, c in zip("xy", terrain.KARST))
    length = lambda a, b: f"sqrt(power({a}, 2) + power({b}, 2))"
    total = lambda name, shape, spec: "(" + " + ".join(f"{shape.format(f'n_{name}{k}')} * {0.5 * spec[2] ** k!r}::DOUBLE" for k in range(spec[0])) + f") / {sum(0.5 * spec[2] ** k for k in range(spec[0]))!r}::DOUBLE"
    fall = lambda d, r: _step(r, r * 0.25, d)
    return f"""p AS (SELECT x, y, ((x + 0.5::DOUBLE) / {side} - 0.5) * 4096 AS wx, ((y + 0.5::DOUBLE) / {side} - 0.5) * 4096 AS wy FROM ({sql.cells(side)})),
nn AS MATERIALIZED (SELECT gx AS x, gy AS y, {wide} FROM ({noise}) GROUP BY gx, gy),
w AS MATERIALIZED (SELECT p.*, n.* EXCLUDE (x, y), wx + n_kx * 190 AS kx, wy + n_ky * 190 AS ky, wx + n_vx * 85 + n_fx * 16 AS sx, wy + n_vy * 85 + n_fy * 16 AS sy FROM p JOIN nn n USING (x, y)),
z AS (SELECT *, {length(f"wx - {terrain.ALPINE[0]!r}::DOUBLE", f"wy - ({terrain.ALPINE[1]!r}::DOUBLE)")} AS da, {length(f"wx - ({terrain.LAKE[0]!r}::DOUBLE)", f"wy - {terrain.LAKE[1]!r}::DOUBLE")} AS dl, {length(f"({kx} * {ca!r}::DOUBLE - {ky} * {sa!r}::DOUBLE / 1.3)", f"({kx} * {sa!r}::DOUBLE + {ky} * {ca!r}::DOUBLE * 1.15)")} AS dk FROM w),
t AS (SELECT *, power({fall("da", terrain.ALPINE_RADIUS)}, 1.2) AS t_alp, {fall("dl", terrain.LAKE_RADIUS)} AS t_lake, {fall("dk", terrain.KARST_RADIUS)} AS t_karst FROM z),
j AS (SELECT t.*, least(fa, fb + 0.12) + wall * 0.05 AS f1, power(least(greatest(1 - abs(g) * 2.2, 0), 1), 3) AS gully, va_dist, va_floor, tr_dist, tr_floor FROM t JOIN ({_worley(80.0, 0.0, "fa")}) USING (x, y) JOIN ({_worley(133.0, 31.7, "fb")}) USING (x, y)
  JOIN ({single("kx / 9.5", "ky / 9.5", 90, "wall", "w")}) USING (x, y) JOIN ({single("kx / 210.0", "ky / 210.0", 91, "g", "w")}) USING (x, y) JOIN ({_segments(terrain.VALLEY, "va")}) USING (x, y) JOIN ({_segments(terrain.TRIBUTARY, "tr")}) USING (x, y)),
b AS (SELECT *, 192 + (1 - power(1 - least(greatest({total("hill", "{}", terrain.HILLS)} * 0.5 + 0.5, 0), 1), 1.7)) * 135 * (1 - t_alp) * (1 - t_karst * 0.72) + {terrain.KARST_PLATEAU - 192} * t_karst - power(t_lake, 1.5) * 110 AS base,
  t_alp * (power({total("ridge", "power(1 - abs({}), 2)", terrain.RIDGES)}, 1.5) * 1380 + t_alp * 470) AS mountains, {_step(0.46, 0.31, "f1")} AS mask, {total("detail", "{}", terrain.DETAIL)} * 7 AS detail FROM j),
h0 AS (SELECT *, base + mountains + mask * ((n_tower * 0.5 + 0.5) * 80 + 78) * power(t_karst, 0.8) * {_step(55.0, 150.0, "tr_dist")} - gully * 26 * t_karst * (1 - mask) + detail + least(va_dist * 0.06, 95) * (1 - t_alp) * (1 - t_karst) AS h0 FROM b),
h1 AS (SELECT *, va_floor + (h0 - va_floor) * power({_step(0.0, terrain.VALLEY_WIDTH, "va_dist")}, 2.2) - {_step(120.0, 18.0, "va_dist")} * 16 * {_step(0.5, 0.12, "t_lake")} AS h1 FROM h0),
h2 AS (SELECT *, (tr_floor + (h1 - tr_floor) * power({_step(0.0, terrain.TRIBUTARY_WIDTH, "tr_dist")}, 1.6)) * power(t_karst, 0.5) + h1 * (1 - power(t_karst, 0.5)) AS h2 FROM h1),
h3 AS MATERIALIZED (SELECT *, h2 - greatest(h2 - {terrain.LAKE_LEVEL - 13}, 0) * power(t_lake, 3.4) * 0.95 AS height FROM h2),
m AS MATERIALIZED (SELECT h3.*, least(greatest(0.34 + (st * 0.5 + 0.5) * 0.36 + t_karst * 0.28 + t_alp * 0.18 - t_lake * 0.2, 0.08), 0.97) AS hardness FROM h3 JOIN ({single("height * 0.016", "n_strata * 2", 92, "st", "h3")}) USING (x, y))"""


def world_cells(spark, side: int = SIDE):
    return terrain.macro(grid(spark, side).withColumns({"wx": world(F.col("x"), side), "wy": world(F.col("y"), side)}))


def classified_cells(spark):
    h = F.col("height")
    cells = stored(world_cells(spark), "world").withColumns({"moisture": saturate(1 - h / 900), "water": F.when(h < terrain.LAKE_LEVEL, 0.5).otherwise(0.0)})
    return terrain.classified(cells, TEXEL)


@query("q_macro_terrain", f"WITH {macro_sql(SIDE)} SELECT x, y, round(height, 3) AS height, round(hardness, 4) AS hardness, round(t_alp, 5) AS t_alp, round(t_karst, 5) AS t_karst, round(t_lake, 5) AS t_lake, round(va_dist, 3) AS valley_dist FROM m")
def macro_terrain(spark, sf_dir):
    """G-19: base, hills, ridges, towers, carved valleys and the lake, composed; portable noise stands in for the library's (N-8)."""
    found = world_cells(spark)
    return found.select("x", "y", F.round("height", 3).alias("height"), F.round("hardness", 4).alias("hardness"), *[F.round(c, 5).alias(c) for c in ("t_alp", "t_karst", "t_lake")], F.round("valley_dist", 3).alias("valley_dist"))


def _classified_sql() -> str:
    moved = [f"{sql.moved('height', by * s, axis)} AS {c}{s}" for s in (1, 3, 14) for c, by, axis in (("l", -1, "x"), ("r", 1, "x"), ("d", -1, "y"), ("u", 1, "y"))]
    around = lambda s: f"(l{s} + r{s} + d{s} + u{s} - height * 4)"
    clamp = lambda x: f"least(greatest({x}, 0), 1)"
    return f"""WITH {macro_sql(SIDE)},
c AS (SELECT *, least(greatest(1 - height / 900, 0), 1) AS moisture, CASE WHEN height < {terrain.LAKE_LEVEL} THEN 0.5::DOUBLE ELSE 0 END AS water, {", ".join(moved)} FROM m),
s AS (SELECT *, (r1 - l1) / {2 * TEXEL!r}::DOUBLE AS gx, (u1 - d1) / {2 * TEXEL!r}::DOUBLE AS gz FROM c),
v AS (SELECT *, sqrt(gx * gx + gz * gz) AS slope, -gz / sqrt(gx * gx + gz * gz + 1) AS nz FROM s),
q AS (SELECT *, 11.8 - height * 0.0125 - {clamp(f"-nz * {clamp('slope')}")} * 2 + n_cold * 1.2 AS temp, {around(3)} / 9 AS c3, sqrt(power(r14 - l14, 2) + power(u14 - d14, 2)) / {28 * TEXEL!r}::DOUBLE AS coarse, {around(14)} / {196 * TEXEL!r}::DOUBLE AS c14 FROM v),
k AS (SELECT *, {_step(2.6, -2.2, "temp")} AS chill, {_step(0.08, 0.5, "c3")} * {_step(0.9, 0.35, "slope")} AS ledge, {_step(0.015, 0.16, "c14")} AS couloir FROM q),
f AS (SELECT *, power({clamp(f"chill * {_step(2.6, 0.8, 'coarse')} + ledge * chill * 0.45 + couloir * chill * 0.9")}, 0.78) * {_step(0.02, 0.0, "water")} AS snow, {clamp(f"{_step(0.75, 1.45, 'slope')} + t_karst * {_step(0.55, 1.0, 'slope')} * 0.7 + t_alp * 0.18")} AS rock,
  CASE WHEN height > {terrain.TREELINE} + n_cold * 60 THEN 0 WHEN height > {terrain.TREELINE - 170} + n_cold * 70 THEN 1 WHEN moisture > 0.72 AND slope < 0.35 AND height < {terrain.LAKE_LEVEL + 70} THEN 5 WHEN t_karst > 0.42 THEN 3 WHEN n_meadow > 0.22 AND slope < 0.42 AND moisture < 0.72 AND height < 520 AND t_karst < 0.4 THEN 4 ELSE 2 END AS biome FROM k)
SELECT x, y, biome, round(temp, 4) AS temp, round(snow, 4) AS snow, round(rock, 4) AS rock, round({clamp(f"(0.85 - 0.6 * rock) * {_step(-2.5, 1.5, 'temp')} * {_step(0.05, 0.25, '(moisture + 0.15)')} * {_step(1.9, 1.1, 'slope')} - snow * 0.7")}, 4) AS dens FROM f"""


#: Of each layer its salt, the salt of its clumps, its density by biome and the weights of its classes.
LAYERS = {
    "trees": (0x1A2B, 0x51F3, (0.0, 0.3, 0.85, 0.8, 0.08, 0.3), (9, 5, 2)),
    "understory": (0x2B3C, 0x51F3, (0.05, 0.35, 0.6, 0.7, 0.4, 0.5), (6, 6, 4)),
    "extras": (0x3C4D, 0x2E0F, (0.1, 0.12, 0.2, 0.25, 0.1, 0.15), (8, 8)),
    "stones": (0x4D5E, 0x77AA, (0.55, 0.4, 0.26, 0.32, 0.14, 0.18), (10, 4, 2)),
}
LAYER_CAP = 120


def _clump_sql(source: str, salt: int) -> str:
    """(x, y, clump): the greatest kernel of the hashed parents around (wx, wy)."""
    cell, bias = spatial.PARENT_CELL, spatial.PARENT_BIAS
    near = f"SELECT x, y, wx, wy, floor(wx / {cell})::BIGINT + dx + {bias} AS cx, floor(wy / {cell})::BIGINT + dy + {bias} AS cy FROM {source}, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy)"
    hashed = sql.pcg(sql.pcg(near, "cx", "cy", salt), "cx", "cy", salt ^ 0x9E3779, "eu", "ev")
    far = f"SELECT *, {cell} * (u / 16777216.0::DOUBLE * 0.55 + 0.5) AS r, sqrt(power(wx - (cx - {bias} + 0.15 + u / 16777216.0::DOUBLE * 0.7) * {cell}, 2) + power(wy - (cy - {bias} + 0.15 + v / 16777216.0::DOUBLE * 0.7) * {cell}, 2)) AS d FROM ({hashed})"
    t = "least(greatest((d - r * 0.22) / (r - r * 0.22), 0), 1)"
    return f"SELECT x, y, greatest(max(CASE WHEN eu / 16777216.0 < {spatial.PARENT_PROB} THEN 1 - {t} * {t} * (3 - 2 * {t}) ELSE 0 END), 0) AS clump FROM ({far}) GROUP BY x, y"


def _layers_sql() -> str:
    base = _classified_sql()
    head, tail = base.rsplit("SELECT x, y, biome,", 1)
    dens = tail.split("AS rock, round(", 1)[1].rsplit(", 4) AS dens", 1)[0]
    parts = []
    for name, (salt, clumps, density, weights) in LAYERS.items():
        gate = "CASE biome " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(density)) + " END"
        grow = "(0.25 + 0.75 * clump)"
        accept = {
            "trees": f"{gate} * {grow} * dens",
            "understory": f"{gate} * (0.4 + 0.6 * clump) * greatest(dens, 0.15)",
            "extras": f"{gate} * {grow} * (1 - snow)",
            "stones": f"{gate} * (clump * 0.78 + 0.22) * (rock * 0.85 + 0.3) * (1 - {_step(0.72, 0.98, 'slope')} * 0.9)",
        }[name]
        dry = "height > 142.25" if name != "stones" else "height > 142.25 AND slope < 2.4"
        source = f"SELECT n.*, clump FROM n JOIN ({_clump_sql('n', clumps)}) USING (x, y) WHERE {dry}"
        kept = f"SELECT * EXCLUDE (u, v) FROM ({sql.pcg(source, 'x', 'y', salt)}) WHERE u < {accept} * 16777216"
        edges = [sum(weights[: k + 1]) for k in range(len(weights) - 1)]
        cls = "CASE " + " ".join(f"WHEN u <= {e} * 1048576 THEN {k}" for k, e in enumerate(edges)) + f" ELSE {len(weights) - 1} END"
        parts.append(f"SELECT '{name}' AS layer, biome, {cls} AS cls, x, y, row_number() OVER (PARTITION BY biome ORDER BY y, x) AS place FROM ({sql.pcg(kept, 'x', 'y', salt + 7)})")
    return f"{head}, n AS MATERIALIZED (SELECT *, {dens} AS dens FROM f) SELECT layer, biome, cls, count(*) AS n, sum(x * 64 + y)::BIGINT AS places FROM ({' UNION ALL '.join(parts)}) WHERE place <= {LAYER_CAP} GROUP BY layer, biome, cls"


@query("q_scatter_layers", _layers_sql())
def scatter_layers(spark, sf_dir):
    """G-21: four layers over the classified world: exclusions, clumps, each layer's own rules, the hash gate, classes, a cap by biome."""
    x, y = F.col("x"), F.col("y")
    world_ = classified_cells(spark)
    out = None
    for name, (salt, clumps, density, weights) in LAYERS.items():
        dry = world_.where(F.col("height") > terrain.LAKE_LEVEL + 0.25)
        dry = dry.where(F.col("slope") < 2.4) if name == "stones" else dry
        near = dry.withColumns({"clump": spatial.clump(F.col("wx"), F.col("wy"), clumps), "gate": pick(F.col("biome"), list(density[:-1]), density[-1])})
        gate, clump, dens = F.col("gate"), F.col("clump"), F.col("dens")
        accept = {
            "trees": gate * (0.25 + 0.75 * clump) * dens,
            "understory": gate * (0.4 + 0.6 * clump) * F.greatest(dens, F.lit(0.15)),
            "extras": gate * (0.25 + 0.75 * clump) * (1 - F.col("snow")),
            "stones": gate * (clump * 0.78 + 0.22) * (F.col("rock") * 0.85 + 0.3) * (1 - smoothstep(0.72, 0.98, F.col("slope")) * 0.9),
        }[name]
        kept = scatter.gate(near, x, y, salt, accept)
        classed = kept.withColumn("cls", scatter.weighted_pick(hashing.pcg2d(x, y, salt + 7)["u"], [F.lit(k * 1048576) for k in weights]))
        own = scatter.capped(classed, ["biome"], ["y", "x"], LAYER_CAP).select(F.lit(name).alias("layer"), "biome", "cls", "x", "y")
        out = own if out is None else out.unionByName(own)
    return out.groupBy("layer", "biome", "cls").agg(F.count("*").alias("n"), F.sum(x * 64 + y).alias("places"))


@query("q_biome_classify", _classified_sql())
def biome_classify(spark, sf_dir):
    """G-20, W-2, P-7: temperature, snow, rock, the biome tree and plant density over the composed world."""
    return classified_cells(spark).select("x", "y", "biome", *[F.round(c, 4).alias(c) for c in ("temp", "snow", "rock", "dens")])


_SLOPED = f"SELECT x, y, h, (e - w) / 128 AS gx_, (n - s) / 128 AS gz_ FROM (SELECT *, {sql.moved('h', -1, 'x')} AS w, {sql.moved('h', 1, 'x')} AS e, {sql.moved('h', -1, 'y')} AS s, {sql.moved('h', 1, 'y')} AS n FROM ({sql.heights(RES)}))"
_UPHILL = f"SELECT x * {RES} + y AS site, x + gx_ / greatest(sqrt(gx_ * gx_ + gz_ * gz_), 0.02) * {{far}} / 64 AS gx, y + gz_ / greatest(sqrt(gx_ * gx_ + gz_ * gz_), 0.02) * {{far}} / 64 AS gy FROM ({_SLOPED})"


@query(
    "q_uphill_probe",
    f"WITH a AS ({_bilinear(_UPHILL.format(far=8), 'site', sql.heights(RES), RES, 'h8')}), b AS ({_bilinear(_UPHILL.format(far=18), 'site', sql.heights(RES), RES, 'h18')}), r AS (SELECT x, y, greatest((h8 - h) / 8, (h18 - h8) / 10) AS rise FROM ({_SLOPED}) JOIN a ON a.site = x * {RES} + y JOIN b ON b.site = x * {RES} + y) SELECT x, y, round(rise, 5) AS rise, round({_step(0.7, 1.3, 'rise')}, 4) AS cliff_above FROM r",
)
def uphill_probe(spark, sf_dir):
    """P-20: the rise 8 m and 18 m uphill of every site, by lookups between cells."""
    sloped = stencil.central_difference(hills(spark), "h", 64.0)
    gx, gz = (F.col("e") - F.col("w")) / 128, (F.col("n") - F.col("s")) / 128
    steep = F.greatest(F.sqrt(gx * gx + gz * gz), F.lit(0.02))
    sites = sloped.select("x", "y", "h", (gx / steep).alias("ux"), (gz / steep).alias("uz"))
    probe = lambda far, out: lookup.bilinear(sites, ["x", "y"], F.col("x") + F.col("ux") * far / 64, F.col("y") + F.col("uz") * far / 64, hills(spark), RES, "h", out)
    met = sites.join(probe(8, "h8"), ["x", "y"]).join(probe(18, "h18"), ["x", "y"])
    rise = F.greatest((F.col("h8") - F.col("h")) / 8, (F.col("h18") - F.col("h8")) / 10)
    return met.select("x", "y", F.round(rise, 5).alias("rise"), F.round(smoothstep(0.7, 1.3, rise), 4).alias("cliff_above"))
