"""Rivers, moisture and the water surface over the test field, and the same steps in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hydrology
from . import sqltext as sql
from .grids import RES, _blur, hills
from .registry import query
from .terrain import _step

TEXEL = 64.0


def channels(spark):
    """The test field with a standing level, strengths of flow and leftover rain."""
    x, y, h = F.col("x"), F.col("y"), F.col("h")
    filled = F.greatest(h, F.lit(30.0) + F.floor(x / 16) * 8)
    flow = (x * 11 + y * 17) % 100 / 163.0
    return hills(spark).withColumns({"filled": filled, "flow": flow, "wet_flow": flow * 0.9, "lake": (filled - h) * 0.3, "rain": (x + y * 3) % 7 / 40.0})


_INPUT = f"SELECT *, filled - h AS _d, (filled - h) * 0.3::DOUBLE AS lake, flow * 0.9::DOUBLE AS wet_flow FROM (SELECT *, greatest(h, 30.0::DOUBLE + x // 16 * 8) AS filled, (x * 11 + y * 17) % 100 / 163.0::DOUBLE AS flow, (x + y * 3) % 7 / 40.0::DOUBLE AS rain FROM ({sql.heights(RES)}))"
_CARVED = f"""i AS MATERIALIZED ({_INPUT}), g AS (SELECT *, {sql.moved('filled', -1, 'x')} - {sql.moved('filled', 1, 'x')} AS gx, {sql.moved('filled', -1, 'y')} - {sql.moved('filled', 1, 'y')} AS gy FROM i),
s AS (SELECT *, sqrt(gx * gx + gy * gy) AS g, least(flow * 2.1, 1) AS strong, least(wet_flow * 1.5, 1) AS wide, {_step(2.2 * 0.7, 0.12, 'lake')} AS fade FROM g),
d AS (SELECT *, power(strong, 1.35) * 7.5 * fade AS depth, {_step(0.5, 0.24, '(g / 128)')} AS gentle FROM s),
c AS MATERIALIZED (SELECT *, h - depth AS bed, greatest((power(wide, 2.2) * 3.3 * fade * 0.45 + 0.12) * gentle - 0.12, 0) AS rise FROM d),
r AS MATERIALIZED (SELECT x, y, bed, depth, CASE WHEN lake > 2.2 THEN lake WHEN strong > 0.02 THEN (depth * 0.45 + 0.12) * gentle ELSE 0 END AS river_depth,
  CASE WHEN lake > 2.2 THEN filled WHEN wide > 0.05 AND rise > 0.05 THEN bed + rise ELSE -10000.0::DOUBLE END AS surface,
  gx / greatest(g, 1e-5) * CASE WHEN lake > 2.2 THEN 0 ELSE strong END AS flow_x, gy / greatest(g, 1e-5) * CASE WHEN lake > 2.2 THEN 0 ELSE strong END AS flow_y,
  least(CASE WHEN lake > 2.2 THEN 1 ELSE greatest(strong * 0.85, CASE WHEN lake > 0.9 THEN 0.8 ELSE 0 END) END + least(rain * 2, 0.35), 1)::DOUBLE AS source FROM c)"""


@query("q_river_carve", f"WITH {_CARVED} SELECT x, y, " + ", ".join(f"round({c}, 5) + 0.0::DOUBLE AS {c}" for c in ("bed", "river_depth", "surface", "flow_x", "flow_y", "source")) + " FROM r")
def river_carve(spark, sf_dir):
    """G-5: beds, river depths, the water's level, flow directions and the source of moisture."""
    return hydrology.carved(channels(spark), TEXEL).select("x", "y", *[(F.round(c, 5) + 0.0).alias(c) for c in ("bed", "river_depth", "surface", "flow_x", "flow_y", "source")])


_BLURRED = _blur(_blur(_blur(_blur("SELECT x, y, source AS b0 FROM r", "b0", 10, "x", "b1"), "b1", 10, "y", "b2"), "b2", 10, "x", "b3"), "b3", 10, "y", "b4")


@query("q_moisture", f"WITH {_CARVED} SELECT x, y, round(b4, 4) AS moisture FROM ({_BLURRED})")
def moisture(spark, sf_dir):
    """G-8: two separable blurs of radius ten."""
    found = hydrology.moisture(hydrology.carved(channels(spark), TEXEL).select("x", "y", "source"), "source", "moisture")
    return found.select("x", "y", F.round("moisture", 4).alias("moisture"))


def _surface_sql() -> str:
    around = ((-1, "x"), (1, "x"), (-1, "y"), (1, "y"))
    side = f"SELECT *, {sql.moved('bed', -1, 'x')} AS w, {sql.moved('bed', 1, 'x')} AS e FROM r"
    lows = ", ".join(sql.moved(c, by, "y") for c in ("bed", "w", "e") for by in (-1, 1))
    ctes = [_CARVED, f"b0 AS MATERIALIZED (SELECT x, y, bed, (surface > -1000)::INTEGER AS wet, CASE WHEN surface > -1000 THEN surface ELSE least(bed, w, e, {lows}) - 2 END AS water FROM ({side}))"]
    for k in range(4):
        total, weight = (" + ".join(sql.moved(c, by, a) for by, a in around) for c in ("v", "wet"))
        ctes.append(f"b{k + 1} AS MATERIALIZED (SELECT x, y, bed, wet, CASE WHEN wet = 1 THEN (water + {total}) / (1 + {weight}) ELSE water END AS water FROM (SELECT *, water * wet AS v FROM b{k}))")
    drop = ", ".join(f"abs(water - {sql.moved('water', by, a)}) * {sql.moved('wet', by, a)}" for by, a in around)
    return f"WITH {', '.join(ctes)} SELECT x, y, wet, round(CASE WHEN wet = 1 AND drop / 64 > 0.35 THEN bed - 2 ELSE water END, 4) AS water FROM (SELECT *, greatest({drop}) AS drop FROM b4)"


@query("q_water_surface", _surface_sql())
def water_surface(spark, sf_dir):
    """G-9: dry cells sunk, wet ones smoothed in four passes, steep water cut."""
    found = hydrology.water_surface(hydrology.carved(channels(spark), TEXEL), TEXEL)
    return found.select("x", "y", "wet", F.round("water", 4).alias("water"))
