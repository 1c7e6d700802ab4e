"""Lattice noise on the portable integer hash, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import fmix32, hash3

OCTAVE_SALT, RIDGE_SALT = 0x9E37, 0x51ED


def value_noise3(x: Column, y: Column, z: Column, seed: Column) -> Column:
    """Trilinear value noise in [-1, 1]: the weighted sum over the eight corners, as one lambda."""
    start = F.struct(*[F.floor(c).cast("bigint").alias(f"i{n}") for n, c in zip("xyz", (x, y, z))], *[(c - F.floor(c)).alias(f"f{n}") for n, c in zip("xyz", (x, y, z))], seed.cast("bigint").alias("s"))

    def at_point(p: Column) -> Column:
        def corner(k: Column) -> Column:
            weight, place = F.lit(1.0), []
            for bit, n in enumerate("xyz"):
                on = F.shiftright(k, bit).bitwiseAND(F.lit(1))
                f = p[f"f{n}"]
                t = f * f * (3.0 - 2.0 * f)
                weight = weight * F.when(on == 1, t).otherwise(1.0 - t)
                place.append(p[f"i{n}"] + on)
            return weight * hash3(*place, p["s"])

        return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(7)), corner), F.lit(0.0), lambda a, b: a + b) * 2.0 - 1.0

    return F.element_at(F.transform(F.array(start), at_point), 1)


def periodic_noise2(x: Column, y: Column, period: int, seed: int) -> Column:
    """Bilinear value noise in [0, 1] that repeats after `period` cells on both axes."""
    start = F.struct(F.floor(x).alias("ix"), F.floor(y).alias("iy"), (x - F.floor(x)).alias("fx"), (y - F.floor(y)).alias("fy"))

    def corner(p: Column, k: Column) -> Column:
        right, up = k % 2, F.shiftright(k, 1)
        tx, ty = (p[n] * p[n] * (3.0 - 2.0 * p[n]) for n in ("fx", "fy"))
        weight = F.when(right == 1, tx).otherwise(1.0 - tx) * F.when(up == 1, ty).otherwise(1.0 - ty)
        return weight * hash3(F.pmod(p["ix"] + right, F.lit(period)), F.pmod(p["iy"] + up, F.lit(period)), F.lit(0), F.lit(seed))

    each = F.transform(F.array(start), lambda p: F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: corner(p, k)), F.lit(0.0), lambda a, b: a + b))
    return F.element_at(each, 1)


def _octaves(shape, x, y, z, seed: int, octaves: int, lacunarity: float, gain: float, salt: int) -> Column:
    """Sum over octaves, whose seeds, frequencies and amplitudes are literals, as one lambda."""
    steps = [(0.5 * gain**i, lacunarity**i, seed + i * salt) for i in range(octaves)]
    table = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(f).alias("f"), F.lit(s).cast("bigint").alias("s")) for a, f, s in steps])
    places = F.array(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z")))
    each = F.transform(places, lambda p: F.aggregate(F.transform(table, lambda o: o["a"] * shape(value_noise3(p["x"] * o["f"], p["y"] * o["f"], p["z"] * o["f"], fmix32(o["s"])))), F.lit(0.0), lambda a, b: a + b))
    return F.element_at(each, 1) / sum(a for a, _, _ in steps)


def fbm3(x: Column, y: Column, z: Column, seed: int, octaves: int = 5, lacunarity: float = 2.02, gain: float = 0.5) -> Column:
    """Fractal sum of value noise, normalized."""
    return _octaves(lambda n: n, x, y, z, seed, octaves, lacunarity, gain, OCTAVE_SALT)


def ridged3(x: Column, y: Column, z: Column, seed: int, octaves: int = 5, lacunarity: float = 2.1, gain: float = 0.52) -> Column:
    """Fractal sum with sharp creases, in [0, 1]."""
    return _octaves(lambda n: (1.0 - F.abs(n)) * (1.0 - F.abs(n)), x, y, z, seed, octaves, lacunarity, gain, RIDGE_SALT)


def warped(frame: DataFrame, noise, x: str, y: str, z: str, amount: float, out: str) -> DataFrame:
    """Noise at a place that noise itself has moved; the move is a column of its own, not part of the expression."""
    px, py, pz = F.col(x), F.col(y), F.col(z)
    moved = frame.withColumns({"_wx": px + amount * noise(px, py, pz + 17.0), "_wy": py + amount * noise(px + 31.0, py, pz)})
    return moved.withColumn(out, noise(F.col("_wx"), F.col("_wy"), pz)).drop("_wx", "_wy")
