"""Curves, frames, floods and the magic square against their properties."""

import numpy as np
from pyspark.sql import functions as F

from fieldspark.operators import curves
from fieldspark.plans import registry, solving

SF = "/root/testdata/sf0.001"


def test_magic_square(spark):
    for size in (3, 4, 7):
        n = size + 1 - size % 2
        square = np.zeros((n, n), int)
        for r in curves.magic_square(spark, size).collect():
            assert square[r.i, r.j] == 0
            square[r.i, r.j] = r.value
        sums = {*square.sum(0), *square.sum(1), np.trace(square), np.trace(square[:, ::-1])}
        assert sums == {n * (n * n + 1) // 2}


def test_path_has_equal_steps_and_keeps_its_ends(spark):
    given = solving.lines(spark, SF).where("line = 3")
    found = curves.path_points(given, 50).toPandas().sort_values("k")[["x", "y", "z"]].to_numpy()
    ends = given.toPandas().sort_values("seq")[["x", "y", "z"]].to_numpy()
    steps = np.linalg.norm(np.diff(found, axis=0), axis=1)
    assert np.allclose(found[[0, -1]], ends[[0, -1]]) and steps.std() < 0.02 * steps.mean()


def test_frames_are_normal_to_the_line(spark):
    given = solving.lines(spark, SF).where("line = 3")
    rows = curves.frames(given).toPandas().sort_values("seq")
    points = given.toPandas().sort_values("seq")[["x", "y", "z"]].to_numpy()
    tangent = np.gradient(points, axis=0)
    tangent /= np.linalg.norm(tangent, axis=1, keepdims=True)
    normal = rows[["nx", "ny", "nz"]].to_numpy()
    assert np.allclose(np.linalg.norm(normal, axis=1), 1) and np.abs((normal * tangent).sum(1)).max() < 1e-6


def test_flood_fills_all_and_keeps_what_was_there(spark):
    cells = spark.range(64).select(F.lit(1).alias("tile"), (F.col("id") % 8).cast("int").alias("x"), F.floor(F.col("id") / 8).cast("int").alias("y"), F.when(F.col("id") == 0, 4.0).when(F.col("id") == 63, 8.0).alias("v"))
    rows = {(r.x, r.y): r.v for r in curves.ring_flood(cells).collect()}
    assert rows[0, 0] == 4 and rows[7, 7] == 8 and rows[1, 0] == 4 and all(4 <= v <= 8 for v in rows.values())


def test_periodic_noise_repeats(spark):
    assert registry.QUERIES["q_periodic_noise"](spark, SF).where("abs(noise - wrapped) > 1e-5").isEmpty()
