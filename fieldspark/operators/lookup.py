"""Raster lookups as equi joins on computed cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clamp


def nearest(points: DataFrame, px: Column, py: Column, raster: DataFrame, res: int, values: list[str]) -> DataFrame:
    """Adds the raster's values at each point's cell, edges clamped."""
    keyed = points.withColumns({"_cx": clamp(F.floor(px), 0, res - 1).cast("int"), "_cy": clamp(F.floor(py), 0, res - 1).cast("int")})
    cells = raster.select(F.col("x").alias("_cx"), F.col("y").alias("_cy"), *values)
    return keyed.join(cells, ["_cx", "_cy"], "left").drop("_cx", "_cy")


def corners(gx: Column, gy: Column, res: int) -> Column:
    """The four cells around a continuous coordinate with their weights, to be exploded."""
    cx, cy = clamp(gx, 0.0, float(res - 1)), clamp(gy, 0.0, float(res - 1))
    x0, y0 = F.floor(cx).cast("int"), F.floor(cy).cast("int")
    fx, fy = cx - x0, cy - y0
    x1, y1 = F.least(x0 + 1, F.lit(res - 1)), F.least(y0 + 1, F.lit(res - 1))
    corner = lambda x, y, w: F.struct(x.alias("cx"), y.alias("cy"), w.alias("w"))
    return F.array(corner(x0, y0, (1 - fx) * (1 - fy)), corner(x1, y0, fx * (1 - fy)), corner(x0, y1, (1 - fx) * fy), corner(x1, y1, fx * fy))


def bilinear(points: DataFrame, key: list[str], gx: Column, gy: Column, raster: DataFrame, res: int, value: str, out: str) -> DataFrame:
    """(key, out): the raster's value between its cells; points are unique by `key`."""
    spread = points.select(*key, F.explode(corners(gx, gy, res)).alias("c")).select(*key, "c.cx", "c.cy", "c.w")
    cells = raster.select(F.col("x").alias("cx"), F.col("y").alias("cy"), F.col(value).alias("_v"))
    return spread.join(cells, ["cx", "cy"]).groupBy(*key).agg(F.sum(F.col("w") * F.col("_v")).alias(out))


def upsampled(fine: DataFrame, fine_res: int, coarse: DataFrame, coarse_res: int, value: str, out: str) -> DataFrame:
    """A coarse raster's value at every cell of a fine one."""
    ratio = coarse_res / fine_res
    return bilinear(fine.select("x", "y"), ["x", "y"], (F.col("x") + 0.5) * ratio - 0.5, (F.col("y") + 0.5) * ratio - 0.5, coarse, coarse_res, value, out)


def compose(fine: DataFrame, fine_res: int, before: DataFrame, after: DataFrame, coarse_res: int) -> DataFrame:
    """Fine detail on a changed coarse field: up(after) + (h - up(before))."""
    a = upsampled(fine, fine_res, after, coarse_res, "h", "up_after")
    b = upsampled(fine, fine_res, before, coarse_res, "h", "up_before")
    return fine.join(a, ["x", "y"]).join(b, ["x", "y"]).withColumn("composed", F.col("up_after") + F.col("h") - F.col("up_before"))


def trilinear(points: DataFrame, key: list[str], gx: Column, gy: Column, layer: Column, raster: DataFrame, res: int, layers: int, value: str, out: str) -> DataFrame:
    """(key, out) in a stack of rasters (x, y, layer); points are unique by `key`."""
    depth = clamp(layer, 0.0, float(layers - 1))
    low = F.floor(depth).cast("int")
    between = F.array(F.struct(low.alias("cl"), (1 - (depth - low)).alias("wl")), F.struct(F.least(low + 1, F.lit(layers - 1)).alias("cl"), (depth - low).alias("wl")))
    spread = points.select(*key, F.explode(corners(gx, gy, res)).alias("c"), between.alias("l")).select(*key, "c", F.explode("l").alias("l")).select(*key, "c.cx", "c.cy", "l.cl", (F.col("c.w") * F.col("l.wl")).alias("w"))
    cells = raster.select(F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("layer").alias("cl"), F.col(value).alias("_v"))
    return spread.join(cells, ["cx", "cy", "cl"]).groupBy(*key).agg(F.sum(F.col("w") * F.col("_v")).alias(out))
