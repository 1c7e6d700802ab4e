"""Block reductions; every level aggregates partially before its shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def block(axis: str, size: int) -> Column:
    return F.floor(F.col(axis) / size).cast("int").alias(axis)


def reduced(frame: DataFrame, size: int, **values: Column) -> DataFrame:
    """Blocks of size x size cells with the given aggregates."""
    return frame.groupBy(block("x", size), block("y", size)).agg(*[v.alias(k) for k, v in values.items()])


def min_pyramid(frame: DataFrame, value: str, levels: int) -> DataFrame:
    """(level, x, y, value): each level the minimum of 2 x 2 of the one below."""
    out, now = None, frame.select("x", "y", value)
    for level in range(1, levels + 1):
        now = reduced(now, 2, **{value: F.min(value)})
        own = now.select(F.lit(level).alias("level"), "x", "y", value)
        out = own if out is None else out.unionByName(own)
    return out


def range_pyramid(frame: DataFrame, value: str, size: int, stride: int, levels: int) -> DataFrame:
    """(level, x, y, range): strided max - min of blocks, then the maximum of 2 x 2."""
    strided = frame.where((F.col("x") % stride == 0) & (F.col("y") % stride == 0))
    now = reduced(strided, size, range=F.max(value) - F.min(value))
    out = now.select(F.lit(0).alias("level"), "x", "y", "range")
    for level in range(1, levels + 1):
        now = reduced(now, 2, range=F.max("range"))
        out = out.unionByName(now.select(F.lit(level).alias("level"), "x", "y", "range"))
    return out
