"""Atmosphere integrals, spiral gathers and vector helpers, as Column expressions and small explosions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import sphere_direction
from ..functions.scalar import clamp, fract, smoothstep
from . import lookup

#: Fixed values of the atmosphere: radii and scale heights in km, extinction of the three parts per channel.
GROUND, TOP, RAYLEIGH_HEIGHT, MIE_HEIGHT = 6360.0, 6460.0, 8.0, 1.2
RAYLEIGH, MIE, OZONE = (5.802e-3, 13.558e-3, 33.1e-3), 1.07e-2, (0.65e-3, 1.881e-3, 0.085e-3)
STEPS, DIRECTIONS = 44, 64
#: Fixed values of the gather: golden angle, phase and number of taps, and the depth gate.
GOLDEN, PHASE, TAPS = 2.399963, 0.7, 8


def path_length(r: Column, mu: Column) -> Column:
    """From a radius along a ray with cosine mu to the ground, if it is hit, or to the top."""
    ground = r * r * (mu * mu - 1) + GROUND * GROUND
    hit = (mu < 0) & (ground >= 0)
    top = r * r * (mu * mu - 1) + TOP * TOP
    return F.when(hit, F.greatest(-r * mu - F.sqrt(F.greatest(ground, F.lit(0.0))), F.lit(0.0))).otherwise(F.greatest(-r * mu + F.sqrt(F.greatest(top, F.lit(0.0))), F.lit(0.0)))


def optical_depth(rays: DataFrame, keys: list[str], r: str, mu: str, steps: int = STEPS) -> DataFrame:
    """(keys, tau_r, tau_g, tau_b): extinction summed over the middle points of `steps` equal steps of each ray."""
    timed = rays.select(*keys, F.col(r).alias("_r"), F.col(mu).alias("_m")).withColumn("_dt", path_length(F.col("_r"), F.col("_m")) / steps)
    walked = timed.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("_t", (F.col("_t") + 0.5) * F.col("_dt"))
    high = F.sqrt(F.col("_t") * F.col("_t") + F.col("_r") * F.col("_r") + F.col("_t") * F.col("_r") * F.col("_m") * 2) - GROUND
    dense = walked.withColumn("_h", high).withColumns({"_a": F.exp(-F.col("_h") / RAYLEIGH_HEIGHT), "_b": F.exp(-F.col("_h") / MIE_HEIGHT), "_c": F.greatest(1 - F.abs(F.col("_h") - 25) / 15, F.lit(0.0))})
    part = lambda k: F.sum((RAYLEIGH[k] * F.col("_a") + MIE * F.col("_b") + OZONE[k] * F.col("_c")) * F.col("_dt"))
    return dense.groupBy(*keys).agg(*[part(k).alias(f"tau_{c}") for k, c in enumerate("rgb")])


def mean_transmittance(sites: DataFrame, key: str, r: str, directions: int = DIRECTIONS, steps: int = STEPS) -> DataFrame:
    """(key, clear): what gets through on average over golden-angle directions all around each site."""
    rays = sites.select(key, F.col(r).alias("r"), F.explode(F.sequence(F.lit(0), F.lit(directions - 1))).alias("ray"))
    rays = rays.withColumn("mu", sphere_direction(F.col("ray"), directions)["y"])
    return optical_depth(rays, [key, "ray"], "r", "mu", steps).groupBy(key).agg(F.avg((F.exp(-F.col("tau_r")) + F.exp(-F.col("tau_g")) + F.exp(-F.col("tau_b"))) / 3).alias("clear"))


def spiral_gather(cells: DataFrame, res: int, depth: str, value: str, radius: float) -> DataFrame:
    """(x, y, gathered, support): the mean of a value over spiral taps around each cell, those far off in depth left out."""
    taps = [(math.cos(k * GOLDEN + PHASE) * math.sqrt((k + 0.5) / TAPS) * radius, math.sin(k * GOLDEN + PHASE) * math.sqrt((k + 0.5) / TAPS) * radius) for k in range(TAPS)]
    spread = cells.select(F.col("x").alias("sx"), F.col("y").alias("sy"), F.col(depth).alias("own"), F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in taps])).alias("t"))
    met = lookup.nearest(spread, F.col("sx") + F.col("t.dx") + 0.5, F.col("sy") + F.col("t.dy") + 0.5, cells, res, [depth, value])
    w = smoothstep(1.8, 0.25, F.abs(F.col(depth) - F.col("own")))
    found = met.withColumn("_w", w).groupBy("sx", "sy").agg(F.sum(F.col("_w") * F.col(value)).alias("_v"), F.sum("_w").alias("_s"))
    return found.select(F.col("sx").alias("x"), F.col("sy").alias("y"), (F.col("_v") / F.greatest(F.col("_s"), F.lit(1e-3))).alias("gathered"), (F.col("_s") / TAPS).alias("support"))


def _swirled(p: list[Column], turned: tuple[int, ...], bias: float) -> list[Column]:
    """The point plus its product with itself turned, as one struct that later steps read."""
    dot = sum((a * (p[k] + bias) for a, k in zip(p, turned)), F.lit(0.0))
    return [a + dot for a in p]


def hash12(x: Column, y: Column) -> Column:
    """A hash in [0, 1) of a place, without sines; in double precision, so portable only as far as that is."""
    start = F.struct(*[fract(c * 0.1031).alias(n) for n, c in zip("abc", (x, y, x))])

    def end(s: Column) -> Column:
        b = _swirled([s[n] for n in "abc"], (1, 2, 0), 33.33)
        return fract((b[0] + b[1]) * b[2])

    return F.element_at(F.transform(F.array(start), end), 1)


def hash13(x: Column, y: Column, z: Column) -> Column:
    start = F.struct(*[fract(c * 0.1031).alias(n) for n, c in zip("abc", (x, y, z))])

    def end(s: Column) -> Column:
        b = _swirled([s[n] for n in "abc"], (2, 1, 0), 31.32)
        return fract((b[0] + b[1]) * b[2])

    return F.element_at(F.transform(F.array(start), end), 1)


def hash22(x: Column, y: Column) -> Column:
    """struct(u, v) of a place."""
    start = F.struct(*[fract(c * k).alias(n) for n, c, k in zip("abc", (x, y, x), (0.1031, 0.103, 0.0973))])

    def end(s: Column) -> Column:
        b = _swirled([s[n] for n in "abc"], (1, 2, 0), 33.33)
        return F.struct(fract((b[0] + b[1]) * b[2]).alias("u"), fract((b[0] + b[2]) * b[1]).alias("v"))

    return F.element_at(F.transform(F.array(start), end), 1)


def dot(a: list[Column], b: list[Column]) -> Column:
    return sum((x * y for x, y in zip(a[1:], b[1:])), a[0] * b[0])


def reflect(i: list[Column], n: list[Column]) -> list[Column]:
    """i mirrored at the plane of the unit normal n."""
    d = dot(n, i)
    return [a - b * d * 2.0 for a, b in zip(i, n)]


def refract(i: list[Column], n: list[Column], eta: float) -> list[Column]:
    """i bent at the plane of n by a ratio of indices; zero where all of it is reflected."""
    d = dot(n, i)
    k = 1.0 - eta * eta * (1.0 - d * d)
    return [F.when(k < 0, 0.0).otherwise(a * eta - b * (d * eta + F.sqrt(F.greatest(k, F.lit(0.0))))) for a, b in zip(i, n)]


def phase(mu: Column, g: float) -> Column:
    """The share of light scattered by an angle with cosine mu (Henyey and Greenstein)."""
    return (1.0 - g * g) / (4.0 * math.pi * F.pow(1.0 + g * g - 2.0 * g * mu, 1.5))


def hemi_octahedral(x: Column, y: Column, z: Column) -> list[Column]:
    """A direction of the upper half (y up) on the unit square, the horizon at its border."""
    total = F.abs(x) + F.abs(z) + y
    px, pz = x / total, z / total
    return [clamp((px + pz) * 0.5 + 0.5, 0.0, 1.0), clamp((pz - px) * 0.5 + 0.5, 0.0, 1.0)]
