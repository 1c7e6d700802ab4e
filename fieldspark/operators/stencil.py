"""Neighbourhood operators with replicated edges, on (x, y) frames.

A row of the grid is one window partition, a column another, so a step costs two
shuffles whatever the grid's size; no cell is joined with its neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def along(axis: str):
    """The window of a cell's row (x) or column (y)."""
    return Window.partitionBy("y").orderBy("x") if axis == "x" else Window.partitionBy("x").orderBy("y")


def shift(value: str | Column, by: int, axis: str) -> Column:
    """The value `by` cells on; beyond an edge the edge's own value."""
    value = F.col(value) if isinstance(value, str) else value
    window = along(axis)
    if not by:
        return value
    moved = F.lead(value, by).over(window) if by > 0 else F.lag(value, -by).over(window)
    edge = (F.last if by > 0 else F.first)(value).over(window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.coalesce(moved, edge)


def cross(frame: DataFrame, value: str) -> DataFrame:
    """Adds the four neighbours: west, east, south, north."""
    return frame.withColumns({"w": shift(value, -1, "x"), "e": shift(value, 1, "x")}).withColumns({"s": shift(value, -1, "y"), "n": shift(value, 1, "y")})


def box(frame: DataFrame, value: str) -> DataFrame:
    """Adds all eight neighbours as w, e, s, n, sw, se, nw, ne."""
    found = frame.withColumns({"w": shift(value, -1, "x"), "e": shift(value, 1, "x")})
    return found.withColumns({a + b: shift(src, by, "y") for a, by in (("s", -1), ("n", 1)) for b, src in (("", value), ("w", "w"), ("e", "e"))})


def blur(frame: DataFrame, value: str, radius: int, axis: str, out: str) -> DataFrame:
    """Triangle blur along one axis, weight 1 - |o| / (radius + 1)."""
    weights = {o: 1 - abs(o) / (radius + 1) for o in range(-radius, radius + 1)}
    total = sum((shift(value, o, axis) * F.lit(w) for o, w in weights.items()), F.lit(0.0))
    return frame.withColumn(out, total / F.lit(sum(weights.values())))


def central_difference(frame: DataFrame, value: str, texel: float) -> DataFrame:
    """Adds the normal and the slope (rise over run)."""
    near = cross(frame, value)
    gx, gz = (F.col("e") - F.col("w")) / (2 * texel), (F.col("n") - F.col("s")) / (2 * texel)
    length = F.sqrt(gx * gx + gz * gz + 1.0)
    return near.withColumns({"nx": -gx / length, "ny": 1.0 / length, "nz": -gz / length, "slope": F.sqrt(gx * gx + gz * gz)})


def laplacian(frame: DataFrame, value: str, stride: int, out: str) -> DataFrame:
    """Mean of the neighbours `stride` cells off, less the value."""
    total = shift(value, -stride, "x") + shift(value, stride, "x") + shift(value, -stride, "y") + shift(value, stride, "y")
    return frame.withColumn(out, total / 4.0 - F.col(value))


def masked_mean(frame: DataFrame, value: str, mask: str, out: str) -> DataFrame:
    """Cells under the mask take the mean of themselves and their neighbours under it."""
    parts = frame.withColumns({"_v": F.col(value) * F.col(mask), "_m": F.col(mask).cast("double")})
    total, weight = F.col(value), F.lit(1.0)
    for by, axis in ((-1, "x"), (1, "x"), (-1, "y"), (1, "y")):
        total, weight = total + shift("_v", by, axis), weight + shift("_m", by, axis)
    return parts.withColumn(out, F.when(F.col(mask) == 1, total / weight).otherwise(F.col(value))).drop("_v", "_m")


def steepest_masked(frame: DataFrame, value: str, mask: str, out: str) -> DataFrame:
    """Greatest difference to a neighbour under the mask."""
    steps = [F.abs(F.col(value) - shift(value, by, axis)) * shift(mask, by, axis) for by, axis in ((-1, "x"), (1, "x"), (-1, "y"), (1, "y"))]
    return frame.withColumn(out, F.greatest(*steps))


def dilate(frame: DataFrame, value: str, passes: int) -> DataFrame:
    """Each pass fills empty cells with the mean of their filled neighbours."""
    for _ in range(passes):
        filled = F.when(F.col(value).isNotNull(), 1.0).otherwise(0.0)
        parts = frame.withColumns({"_f": filled, "_z": F.coalesce(F.col(value), F.lit(0.0))})
        total = weight = F.lit(0.0)
        for by, axis in ((-1, "x"), (1, "x"), (-1, "y"), (1, "y")):
            total, weight = total + shift("_z", by, axis), weight + shift("_f", by, axis)
        frame = parts.withColumn(value, F.coalesce(F.col(value), F.when(weight > 0, total / weight))).drop("_f", "_z")
    return frame
