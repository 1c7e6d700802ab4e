"""The composed world: zones, valleys, ridges, towers and hills as one projection, and its classification.

Noise is the portable lattice noise of `functions.noise`, one seed for each
channel; a channel reads a place that is a linear map of the world's.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import noise
from ..functions.scalar import clamp, saturate, smoothstep
from . import spatial, stencil

#: Fixed values of the world: anchors and radii of its zones, polylines with their floors, levels.
ALPINE, ALPINE_RADIUS = (1460.0, -1470.0), 1820.0
LAKE, LAKE_RADIUS, LAKE_LEVEL = (-1380.0, 1290.0), 600.0, 142.0
KARST, KARST_RADIUS, KARST_TURN, KARST_PLATEAU = (640.0, 660.0), 900.0, 0.35, 380.0
TREELINE = 950.0
VALLEY = ((1520.0, -1530.0, 690.0), (830.0, -770.0, 468.0), (70.0, -70.0, 300.0), (-630.0, 520.0, 212.0), (-1120.0, 1000.0, 172.0), (-1380.0, 1290.0, 141.0), (-1840.0, 1700.0, 133.0), (-2200.0, 2040.0, 120.0))
TRIBUTARY = ((1000.0, 950.0, 318.0), (600.0, 600.0, 286.0), (220.0, 330.0, 246.0), (-630.0, 520.0, 213.0))
VALLEY_WIDTH, TRIBUTARY_WIDTH = 360.0, 150.0
HILLS, RIDGES, DETAIL = (3, 2.1, 0.52), (3, 2.13, 0.52), (2, 2.05, 0.5)
WORLEY_SALT, WORLEY_PERIOD = 313, 4096


def channels() -> dict[str, tuple[float, ...]]:
    """(a, b, c, d, e, f) of each first-level channel: it reads (a x + b y + c, d x + e y + f)."""
    scaled = lambda s, at=0.0: (1 / s, 0.0, at, 0.0, 1 / s, at)
    out = {"kx": scaled(430.0), "ky": scaled(430.0, 50.0), "vx": scaled(290.0), "vy": scaled(290.0, 53.0), "fx": scaled(61.0), "fy": scaled(61.0, 97.0)}
    out |= {f"hill{k}": scaled(1350.0 / HILLS[1] ** k) for k in range(HILLS[0])}
    turn = 0.7071 / 2100
    for k in range(RIDGES[0]):
        f = RIDGES[1] ** k
        out[f"ridge{k}"] = (turn * f, turn * f, 7.31 * k, -1.65 * turn * f, 1.65 * turn * f, 7.31 * k)
    out |= {f"detail{k}": scaled(62.0 / DETAIL[1] ** k) for k in range(DETAIL[0])}
    return out | {"tower": scaled(310.0), "strata": scaled(900.0), "cold": scaled(420.0), "meadow": scaled(560.0)}


def _noise(x: Column, y: Column, seed: int) -> Column:
    return noise.value_noise3(x, y, F.lit(0.5), F.lit(seed))


def _falloff(d: Column, radius: float) -> Column:
    return smoothstep(radius, radius * 0.25, d)


def _length(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def macro(points: DataFrame) -> DataFrame:
    """Adds the zones, distances, `height` and `hardness` of the world at (wx, wy), and the noise that classification reads."""
    wx, wy = F.col("wx"), F.col("wy")
    known = channels()
    rows = points.withColumns({f"n_{name}": _noise(wx * a + wy * b + c, wx * d + wy * e + f, 100 + k) for k, (name, (a, b, c, d, e, f)) in enumerate(known.items())})
    n = lambda name: F.col(f"n_{name}")
    rows = rows.withColumns({"kx": wx + n("kx") * 190, "ky": wy + n("ky") * 190, "sx": wx + n("vx") * 85 + n("fx") * 16, "sy": wy + n("vy") * 85 + n("fy") * 16})
    kx, ky, sx, sy = (F.col(c) for c in ("kx", "ky", "sx", "sy"))
    ca, sa = math.cos(KARST_TURN), math.sin(KARST_TURN)
    rx, ry = (kx - KARST[0]) * ca - (ky - KARST[1]) * sa / 1.3, (kx - KARST[0]) * sa + (ky - KARST[1]) * ca * 1.15
    features = [spatial.nearest_features(F.floor(kx / s + o), F.floor(ky / s + o), kx / s + o, ky / s + o, WORLEY_SALT, WORLEY_PERIOD) for s, o in ((80.0, 0.0), (133.0, 31.7))]
    rows = rows.withColumns(
        {
            "t_alp": F.pow(_falloff(_length(wx - ALPINE[0], wy - ALPINE[1]), ALPINE_RADIUS), 1.2),
            "t_lake": _falloff(_length(wx - LAKE[0], wy - LAKE[1]), LAKE_RADIUS),
            "t_karst": _falloff(_length(rx, ry), KARST_RADIUS),
            "valley": spatial.nearest_segment(sx, sy, VALLEY),
            "trib": spatial.nearest_segment(sx, sy, TRIBUTARY),
            "f1": F.least(F.sqrt(F.get(features[0], F.lit(0))), F.sqrt(F.get(features[1], F.lit(0))) + 0.12) + _noise(kx / 9.5, ky / 9.5, 90) * 0.05,
            "gully": F.pow(saturate(1 - F.abs(_noise(kx / 210.0, ky / 210.0, 91)) * 2.2), 3.0),
        }
    )
    alp, karst, lake = F.col("t_alp"), F.col("t_karst"), F.col("t_lake")
    octaves = lambda name, shape, spec: sum((shape(n(f"{name}{k}")) * 0.5 * spec[2] ** k for k in range(spec[0])), F.lit(0.0)) / sum(0.5 * spec[2] ** k for k in range(spec[0]))
    hills = 1 - F.pow(1 - saturate(octaves("hill", lambda v: v, HILLS) * 0.5 + 0.5), 1.7)
    ridge = octaves("ridge", lambda v: (1 - F.abs(v)) * (1 - F.abs(v)), RIDGES)
    rows = rows.withColumns(
        {
            "base": 192 + hills * 135 * (1 - alp) * (1 - karst * 0.72) + (KARST_PLATEAU - 192) * karst - F.pow(lake, 1.5) * 110,
            "mountains": alp * (F.pow(ridge, 1.5) * 1380 + alp * 470),
            "mask": smoothstep(0.46, 0.31, F.col("f1")),
            "detail": octaves("detail", lambda v: v, DETAIL) * 7,
            "valley_dist": F.col("valley.d"),
            "valley_floor": F.col("valley.floor"),
            "trib_dist": F.col("trib.d"),
        }
    )
    mask, vd, td = F.col("mask"), F.col("valley_dist"), F.col("trib_dist")
    towers = mask * ((n("tower") * 0.5 + 0.5) * 80 + 78) * F.pow(karst, 0.8) * smoothstep(55.0, 150.0, td) - F.col("gully") * 26 * karst * (1 - mask)
    rows = rows.withColumn("h0", F.col("base") + F.col("mountains") + towers + F.col("detail") + F.least(vd * 0.06, F.lit(95.0)) * (1 - alp) * (1 - karst))
    carve = lambda h, floor, share: floor + (h - floor) * share
    trench = smoothstep(120.0, 18.0, vd) * 16 * smoothstep(0.5, 0.12, lake)
    rows = rows.withColumn("h1", carve(F.col("h0"), F.col("valley_floor"), F.pow(smoothstep(0.0, VALLEY_WIDTH, vd), 2.2)) - trench)
    pull = F.pow(karst, 0.5)
    rows = rows.withColumn("h2", carve(F.col("h1"), F.col("trib.floor"), F.pow(smoothstep(0.0, TRIBUTARY_WIDTH, td), 1.6)) * pull + F.col("h1") * (1 - pull))
    rows = rows.withColumn("height", F.col("h2") - F.greatest(F.col("h2") - (LAKE_LEVEL - 13), F.lit(0.0)) * F.pow(lake, 3.4) * 0.95)
    strata = _noise(F.col("height") * 0.016, n("strata") * 2, 92) * 0.5 + 0.5
    return rows.withColumn("hardness", clamp(0.34 + strata * 0.36 + karst * 0.28 + alp * 0.18 - lake * 0.2, 0.08, 0.97))


def classified(cells: DataFrame, texel: float) -> DataFrame:
    """Adds temp, snow, rock, biome and dens to cells (x, y) of the composed world that have `moisture` and `water`.

    Slopes and curvature come from strides of 1, 3 and 14 cells.
    """
    near = stencil.central_difference(cells, "height", texel)
    strided = near.withColumns({f"{c}{s}": stencil.shift("height", by * s, axis) for s in (3, 14) for c, by, axis in (("l", -1, "x"), ("r", 1, "x"), ("d", -1, "y"), ("u", 1, "y"))})
    h, slope, cold = F.col("height"), F.col("slope"), F.col("n_cold")
    around = lambda s: F.col(f"l{s}") + F.col(f"r{s}") + F.col(f"d{s}") + F.col(f"u{s}") - h * 4
    rows = strided.withColumns(
        {
            "temp": 11.8 - h * 0.0125 - clamp(-F.col("nz") * clamp(slope, 0.0, 1.0), 0.0, 1.0) * 2.0 + cold * 1.2,
            "ledge": smoothstep(0.08, 0.5, around(3) / 9) * smoothstep(0.9, 0.35, slope),
            "coarse": _length(F.col("r14") - F.col("l14"), F.col("u14") - F.col("d14")) / (28 * texel),
            "couloir": smoothstep(0.015, 0.16, around(14) / (196 * texel)),
        }
    )
    chill = smoothstep(2.6, -2.2, F.col("temp"))
    snow = F.pow(clamp(chill * smoothstep(2.6, 0.8, F.col("coarse")) + F.col("ledge") * chill * 0.45 + F.col("couloir") * chill * 0.9, 0.0, 1.0), 0.78)
    rock = clamp(smoothstep(0.75, 1.45, slope) + F.col("t_karst") * smoothstep(0.55, 1.0, slope) * 0.7 + F.col("t_alp") * 0.18, 0.0, 1.0)
    moist = F.col("moisture")
    wetland = (moist > 0.72) & (slope < 0.35) & (h < LAKE_LEVEL + 70)
    meadow = (F.col("n_meadow") > 0.22) & (slope < 0.42) & (moist < 0.72) & (h < 520) & (F.col("t_karst") < 0.4)
    tree = F.when(h > TREELINE + cold * 60, 0).when(h > TREELINE - 170 + cold * 70, 1).when(wetland, 5).when(F.col("t_karst") > 0.42, 3).when(meadow, 4).otherwise(2)
    rows = rows.withColumns({"snow": snow * smoothstep(0.02, 0.0, F.col("water")), "rock": rock, "biome": tree})
    lush = (0.85 + (0.25 - 0.85) * F.col("rock")) * smoothstep(-2.5, 1.5, F.col("temp")) * smoothstep(0.05, 0.25, moist + 0.15) * smoothstep(1.9, 1.1, slope)
    return rows.withColumn("dens", clamp(lush - F.col("snow") * 0.7, 0.0, 1.0))
