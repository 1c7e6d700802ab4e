"""Nearest, bracketing and region operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import cell_hash, pcg2d
from ..functions.scalar import saturate, smoothstep

#: Fixed values of the clump field.
PARENT_CELL, PARENT_PROB, PARENT_BIAS = 26.0, 0.62, 8192


def nearest_segment(px: Column, pz: Column, line: Sequence[tuple[float, float, float]]) -> Column:
    """struct(d, floor): distance to a polyline of (x, z, floor) and the floor there; the first of equals.

    The polyline is a parameter of the query, so its segments are folded in
    expressions and points are never joined with it.
    """
    best = None
    for (ax, az, f0), (bx, bz, f1) in zip(line, line[1:]):
        dx, dz = bx - ax, bz - az
        t = saturate(((px - ax) * dx + (pz - az) * dz) / (dx * dx + dz * dz))
        ex, ez = px - (ax + dx * t), pz - (az + dz * t)
        own = F.struct(F.sqrt(ex * ex + ez * ez).alias("d"), (f0 + (f1 - f0) * t).alias("floor"))
        best = F.array(own) if best is None else F.concat(best, F.array(own))
    least = F.array_min(F.transform(best, lambda s: s["d"]))
    return F.element_at(F.filter(best, lambda s: s["d"] == least), 1)


def nearest_features(cx: Column, cy: Column, px: Column, py: Column, salt: int, period: int) -> Column:
    """Ascending squared distances (in cells) to the hashed feature points of the 3 x 3 cells around, periodic."""
    start = F.struct(cx.alias("cx"), cy.alias("cy"), px.alias("px"), py.alias("py"))

    def squared(s: Column, k: Column) -> Column:
        nx, ny = s["cx"] + k % 3 - 1, s["cy"] + F.floor(k / 3) - 1
        hashed = pcg2d(F.pmod(nx, F.lit(period)), F.pmod(ny, F.lit(period)), salt)
        return F.element_at(F.transform(F.array(hashed), lambda h: F.pow(nx + h["u"] / 16777216.0 - s["px"], 2) + F.pow(ny + h["v"] / 16777216.0 - s["py"], 2)), 1)

    return F.element_at(F.transform(F.array(start), lambda s: F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: squared(s, k)))), 1)


def clump(px: Column, py: Column, salt: int) -> Column:
    """Greatest kernel of the hashed parents in the 3 x 3 parent cells around."""
    start = F.struct(px.alias("px"), py.alias("py"), F.floor(px / PARENT_CELL).alias("bx"), F.floor(py / PARENT_CELL).alias("by"))

    def kernel(s: Column, k: Column) -> Column:
        cx, cy = s["bx"] + k % 3 - 1 + PARENT_BIAS, s["by"] + F.floor(k / 3) - 1 + PARENT_BIAS

        def near(h: Column) -> Column:
            u, v = h["u"] / 16777216.0, h["v"] / 16777216.0
            ex, ey = s["px"] - (cx - PARENT_BIAS + 0.15 + u * 0.7) * PARENT_CELL, s["py"] - (cy - PARENT_BIAS + 0.15 + v * 0.7) * PARENT_CELL
            r = PARENT_CELL * (u * 0.55 + 0.5)
            return 1.0 - smoothstep(r * 0.22, r, F.sqrt(ex * ex + ey * ey))

        there = cell_hash(cx, cy, salt ^ 0x9E3779) < PARENT_PROB
        return F.when(there, F.element_at(F.transform(F.array(pcg2d(cx, cy, salt)), near), 1)).otherwise(0.0)

    return F.element_at(F.transform(F.array(start), lambda s: F.array_max(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: kernel(s, k)))), 1)


def halfspaces(coordinates: Sequence[Column], planes: Sequence[Sequence[float]], radius: Column) -> Column:
    """Whether a ball reaches into the region on the inner side of all planes."""
    out = F.lit(True)
    for *normal, d in planes:
        out = out & (sum((c * n for c, n in zip(coordinates, normal)), F.lit(d)) > -radius)
    return out


def asof_interpolated(rows: DataFrame, at: Column, frames: Sequence[tuple[float, ...]], names: Sequence[str]) -> DataFrame:
    """Values between the keyframes (t, values...) around each row's time; outer rows take the ends.

    Keyframes are a small sorted literal: the bracket is found by array
    functions on each row, without a join or a shuffle.
    """
    times = F.array(*[F.lit(float(f[0])) for f in frames])
    t = at
    last = len(frames) - 2
    place = F.least(F.greatest(F.size(F.filter(times, lambda x: x < t)) - 1, F.lit(0)), F.lit(last))
    rows = rows.withColumn("_t", t).withColumn("_i", place)
    left, right = F.get(times, F.col("_i")), F.get(times, F.col("_i") + 1)
    k = F.when(right == left, 0.0).otherwise(saturate((F.col("_t") - left) / (right - left)))
    rows = rows.withColumn("_k", k)
    for j, name in enumerate(names, 1):
        own = F.array(*[F.lit(float(f[j])) for f in frames])
        a, b = F.get(own, F.col("_i")), F.get(own, F.col("_i") + 1)
        rows = rows.withColumn(name, a + (b - a) * F.col("_k"))
    return rows.drop("_t", "_i", "_k")


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], time: str, values: Sequence[str], strict: bool = False) -> DataFrame:
    """The newest row of `right` at or before (strict: before) each row of `left`, by key: one shuffle on the key, no range join."""
    a = left.withColumns({"_side": F.lit(1), **{v: F.lit(None).cast(right.schema[v].dataType) for v in values}})
    b = right.select(*by, time, *values).withColumn("_side", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    before = Window.partitionBy(*by).orderBy(time, F.desc("_side") if strict else F.col("_side")).rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(F.col("_side") == 0, F.struct(*values)), ignorenulls=True).over(before)
    return both.withColumn("_held", held).where("_side = 1").select(*[c for c in left.columns], *[F.col(f"_held.{v}").alias(v) for v in values])


def lattice_dedup(rows: DataFrame, x: Column, z: Column, size: float, order: Sequence) -> DataFrame:
    """The first row of each lattice cell in the given order; cells round halves up."""
    cell = [F.floor(c / size + 0.5).cast("long") for c in (x, z)]
    keyed = rows.withColumns({"_cx": cell[0], "_cz": cell[1]})
    place = F.row_number().over(Window.partitionBy("_cx", "_cz").orderBy(*order))
    return keyed.withColumn("_n", place).where("_n = 1").drop("_n", "_cx", "_cz")


def greedy_thin(rows: DataFrame, x: str, z: str, order: Sequence, apart: float, picks: int) -> DataFrame:
    """The best rows at least `apart` from each other, taken greedily among all; one pass over the rows for each pick."""
    found = []
    while len(found) < picks:
        far = rows
        for p in found:
            far = far.where((F.col(x) - p[x]) * (F.col(x) - p[x]) + (F.col(z) - p[z]) * (F.col(z) - p[z]) >= apart * apart)
        best = far.orderBy(*order).limit(1).collect()
        if not best:
            break
        found += best
    return rows.sparkSession.createDataFrame(found, rows.schema)


def spiral(rings: int, step: float, first: int = 8) -> list[tuple[int, int, float, float]]:
    """(ring, k, dx, dz) of an outward spiral of sample points."""
    import math

    return [(r, k, r * step * math.cos(2 * math.pi * k / (first * r)), r * step * math.sin(2 * math.pi * k / (first * r))) for r in range(1, rings + 1) for k in range(first * r)]
