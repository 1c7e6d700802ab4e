"""Curves, frames along lines, ring floods, plane cuts and the magic square."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def magic_square(spark: SparkSession, size: int) -> DataFrame:
    """(i, j, value) of an odd magic square; an even size is raised by one.

    Each run of `size` numbers climbs one diagonal, and the runs start one row
    down and two columns back from each other, so every cell has a closed form.
    """
    n = size + 1 - size % 2
    run, step = F.floor(F.col("id") / n), F.col("id") % n
    i = F.pmod(n // 2 + run - step, F.lit(n))
    j = F.pmod(n - 1 - 2 * run + step, F.lit(n))
    return spark.range(n * n).select(i.cast("int").alias("i"), j.cast("int").alias("j"), (F.col("id") + 1).alias("value"))


def plane_cuts(radius: Column, direction: Sequence[Column], planes: Sequence[tuple[float, float, float, float]], rounding: float = 0.035) -> Column:
    """A radius cut by planes (nx, ny, nz, offset) one after another, each leaving a slight rounding."""
    table = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip("xyzo", p)]) for p in planes])
    start = F.struct(radius.cast("double").alias("r"), *[c.cast("double").alias(n) for n, c in zip("xyz", direction)])

    def cut(s: Column, p: Column) -> Column:
        toward = s["x"] * p["x"] + s["y"] * p["y"] + s["z"] * p["z"]
        at = p["o"] / F.when(toward > 0.001, toward)
        r = F.when(at < s["r"], at + (s["r"] - at) * rounding).otherwise(s["r"])
        return F.struct(r.alias("r"), s["x"].alias("x"), s["y"].alias("y"), s["z"].alias("z"))

    return F.aggregate(table, start, cut, lambda s: s["r"])


def _centripetal(points: np.ndarray, fine: int) -> np.ndarray:
    """Points of a centripetal Catmull-Rom curve through all given ones."""
    ends = np.vstack([2 * points[0] - points[1], points, 2 * points[-1] - points[-2]])
    out = []
    for k in range(len(points) - 1):
        p = ends[k : k + 4]
        knots = np.concatenate([[0], np.cumsum(np.maximum(np.linalg.norm(np.diff(p, axis=0), axis=1), 1e-9) ** 0.5)])
        t = np.linspace(knots[1], knots[2], fine, endpoint=False)[:, None]
        mid = lambda a, b, ka, kb: (kb - t) / (kb - ka) * a + (t - ka) / (kb - ka) * b
        a1, a2, a3 = mid(p[0], p[1], knots[0], knots[1]), mid(p[1], p[2], knots[1], knots[2]), mid(p[2], p[3], knots[2], knots[3])
        b1, b2 = mid(a1, a2, knots[0], knots[2]), mid(a2, a3, knots[1], knots[3])
        out.append(mid(b1, b2, knots[1], knots[2]))
    return np.vstack([*out, points[-1:]])


def path_points(lines: DataFrame, samples: int, fine: int = 64) -> DataFrame:
    """(line, k, x, y, z): points at equal arc lengths along the curve through each line's points (line, seq, x, y, z)."""

    def run(table: pd.DataFrame) -> pd.DataFrame:
        points = table.sort_values("seq")[["x", "y", "z"]].to_numpy(float)
        curve = _centripetal(points, fine) if len(points) > 1 else points.repeat(2, 0)
        along = np.concatenate([[0], np.cumsum(np.linalg.norm(np.diff(curve, axis=0), axis=1))])
        at = np.linspace(0, along[-1], samples)
        return pd.DataFrame({"line": table.line.iloc[0], "k": np.arange(samples), **{n: np.interp(at, along, curve[:, c]) for c, n in enumerate("xyz")}})

    kind = lines.schema["line"].dataType.simpleString()
    return lines.groupBy("line").applyInPandas(run, f"line {kind}, k long, x double, y double, z double")


def frames(lines: DataFrame) -> DataFrame:
    """(line, seq, along, nx, ny, nz): a normal carried along each line without twisting, and the arc length."""

    def run(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("seq")
        p = table[["x", "y", "z"]].to_numpy(float)
        t = np.gradient(p, axis=0) if len(p) > 1 else np.array([[0.0, 1.0, 0.0]])
        t /= np.maximum(np.linalg.norm(t, axis=1, keepdims=True), 1e-12)
        n = np.cross([0.0, 1.0, 0.0] if abs(t[0, 1]) < 0.94 else [1.0, 0.0, 0.0], t[0])
        n /= np.linalg.norm(n)
        normals = [n]
        for before, now in zip(t, t[1:]):
            axis = np.cross(before, now)
            sine = np.linalg.norm(axis)
            if sine > 1e-6:
                axis, angle = axis / sine, np.arcsin(min(1.0, sine))
                n = n * np.cos(angle) + np.cross(axis, n) * np.sin(angle) + axis * (axis @ n) * (1 - np.cos(angle))
                n /= np.linalg.norm(n)
            normals.append(n)
        along = np.concatenate([[0], np.cumsum(np.linalg.norm(np.diff(p, axis=0), axis=1))])
        return pd.DataFrame({"line": table.line, "seq": table.seq, "along": along, **{f"n{a}": [v[c] for v in normals] for c, a in enumerate("xyz")}})

    kind, seq = (lines.schema[c].dataType.simpleString() for c in ("line", "seq"))
    return lines.groupBy("line").applyInPandas(run, f"line {kind}, seq {seq}, along double, nx double, ny double, nz double")


def ring_flood(tiles: DataFrame) -> DataFrame:
    """(tile, x, y, v) with empty cells filled ring by ring from the covered ones.

    A cell takes the mean of its filled neighbours at its turn; turns follow the
    rings, and rows within a ring, so the result doesn't depend on the input's order.
    """

    def run(table: pd.DataFrame) -> pd.DataFrame:
        value = {(r.x, r.y): r.v for r in table.itertuples() if pd.notna(r.v)}
        cells = {(r.x, r.y) for r in table.itertuples()}
        near = lambda c: [(c[0] + dx, c[1] + dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy]
        queue = deque(sorted((c for c in cells - value.keys() if any(n in value for n in near(c))), key=lambda c: (c[1], c[0])))
        queued = set(queue)
        while queue:
            cell = queue.popleft()
            value[cell] = float(np.mean([value[n] for n in near(cell) if n in value]))
            for n in near(cell):
                if n in cells and n not in value and n not in queued:
                    queued.add(n)
                    queue.append(n)
        out = table.copy()
        out["v"] = [value.get((x, y), np.nan) for x, y in zip(table.x, table.y)]
        return out

    return tiles.groupBy("tile").applyInPandas(run, tiles.schema)
