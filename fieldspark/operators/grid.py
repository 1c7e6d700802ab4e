"""Index-space sources: grids, lattices, toroidal windows and world coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed extent of the reference world, in metres.
WORLD_SIZE = 4096.0


def grid(spark: SparkSession, res: int) -> DataFrame:
    """Cells (x, y) of a square grid, generated in parallel; no guard is needed as range is exact."""
    i = F.col("id")
    return spark.range(res * res).select((i % res).cast("int").alias("x"), F.floor(i / res).cast("int").alias("y"))


def world(cell: Column, res: int) -> Column:
    """The world coordinate of a cell's centre."""
    return ((cell + 0.5) / res - 0.5) * WORLD_SIZE


def continuous(coordinate: Column, res: int) -> Column:
    """The grid coordinate of a world coordinate; cell centres are whole numbers."""
    return (coordinate / WORLD_SIZE + 0.5) * res - 0.5


def toroidal(slot: Column, camera: float, size: int) -> Column:
    """The cell congruent to `slot` modulo `size` that is nearest the camera's cell."""
    return (F.rint((F.lit(float(camera)) - slot) / size) * size + slot).cast("int")


def lattice(spark: SparkSession, first: tuple[int, int], last: tuple[int, int], step: int) -> DataFrame:
    """Points (x, z) of a rectangle, `step` apart."""
    nx, nz = ((b - a) // step + 1 for a, b in zip(first, last))
    i = F.col("id")
    return spark.range(nx * nz).select((first[0] + (i % nx) * step).cast("int").alias("x"), (first[1] + F.floor(i / nx) * step).cast("int").alias("z"))


def line(ax: Column, az: Column, bx: Column, bz: Column, steps: int) -> Column:
    """steps + 1 points along a segment, to be exploded."""
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: F.struct(k.alias("k"), (ax + (bx - ax) * k / steps).alias("px"), (az + (bz - az) * k / steps).alias("pz")))
