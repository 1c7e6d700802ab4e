"""Gated sampling, weighted choice, capped groups and splats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import pcg2d


def gate(frame: DataFrame, x: Column, y: Column, salt: int, accept: Column) -> DataFrame:
    """Rows whose cell hash (24 bits) falls under accept * 2**24; the same rows for any partitioning."""
    return frame.where(pcg2d(x, y, salt)["u"] < accept * 16777216)


def weighted_pick(draw: Column, weights: Sequence[Column]) -> Column:
    """Index of the first partial sum that the draw (0 .. total) does not pass."""
    total, out = None, None
    for k, w in enumerate(weights[:-1]):
        total = w if total is None else total + w
        hit = draw <= total
        out = F.when(hit, k) if out is None else out.when(hit, k)
    return out.otherwise(len(weights) - 1)


def capped(frame: DataFrame, group: Sequence[str], order: Sequence, cap: int | Column) -> DataFrame:
    """The first `cap` rows of each group in a fixed order; the rest overflows.

    A constant cap lets Spark drop rows before the shuffle, so that a hot group
    doesn't pile up in one task.
    """
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return frame.withColumn("_place", place).where(F.col("_place") <= cap).drop("_place")


def exclusive_offsets(frame: DataFrame, order: str, size: str, out: str) -> DataFrame:
    """Exclusive prefix sums of a dimension's sizes; dimensions are small."""
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return frame.withColumn(out, F.coalesce(F.sum(size).over(before), F.lit(0)))


def splat(points: DataFrame, px: Column, py: Column, strength: Column, radius: int, res: int) -> DataFrame:
    """(x, y, amount): sums of a square kernel's fixed-point shares, truncated to 255ths; shares of 1 or less are dropped."""
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)])
    spread = points.select(px.alias("px"), py.alias("py"), strength.alias("s"), F.explode(offsets).alias("o"))
    cells = spread.select(F.col("px") + F.col("o.dx"), F.col("py") + F.col("o.dy"), F.col("s"), (F.col("o.dx") * F.col("o.dx") + F.col("o.dy") * F.col("o.dy")).alias("d2")).toDF("x", "y", "s", "d2")
    limit = (radius + 1) * (radius + 1)
    share = F.floor(F.col("s") * 255 * F.greatest(F.lit(0.0), 1.0 - F.col("d2") / float(limit)))
    return cells.withColumn("share", share).where((F.col("share") > 1) & F.col("x").between(0, res - 1) & F.col("y").between(0, res - 1)).groupBy("x", "y").agg(F.sum("share").alias("amount"))


def bands(distance: Column, edges: Sequence[tuple[float, float]]) -> Column:
    """Every band that a distance lies in, to be exploded; bands may overlap."""
    return F.filter(F.array(*[F.when((distance >= a) & (distance < b), F.lit(k)) for k, (a, b) in enumerate(edges)]), lambda k: k.isNotNull())
