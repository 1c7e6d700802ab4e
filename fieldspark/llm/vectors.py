"""What the embedding operators share: usable vectors and plain k-means."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is there, finite in all components and not zero."""
    wide = vector.cast("array<double>")
    finite = ~F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(wide, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array, dtype=np.float64) -> np.ndarray:
    """Rows of equal-length lists as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 1), dtype)
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)


def main_size(vectors: DataFrame, column: str) -> int | None:
    """The most common vector length, the smaller one of equals; there are few lengths."""
    row = vectors.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return row.d if row else None


def kmeans(points: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's centres; an empty centre moves to a far point."""
    centres = points[rng.choice(len(points), k, replace=len(points) < k)].copy()
    for _ in range(rounds):
        far = (centres**2).sum(1) - 2 * points @ centres.T
        near = far.argmin(1)
        count = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        full = count > 0
        centres[full] = sums[full] / count[full, None]
        if not full.all():
            worst = np.argsort(far[np.arange(len(points)), near] + (points**2).sum(1))[::-1]
            centres[~full] = points[worst[: (~full).sum()]] if (~full).sum() <= len(points) else points[0]
    return centres
