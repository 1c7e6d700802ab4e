"""Solvers against whole-grid numpy runs and invariants."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.operators import solvers, stencil
from fieldspark.operators.grid import grid
from fieldspark.plans.grids import hills


def array(df, value, res):
    rows = df.select("x", "y", value).toPandas().sort_values(["y", "x"])
    return rows[value].to_numpy().reshape(res, res)


def flood(h, eps=solvers.FILL_EPSILON):
    """Filled surface by a priority flood."""
    n = len(h)
    out, heap = np.full_like(h, np.inf), []
    for y in range(n):
        for x in range(n):
            if x in (0, n - 1) or y in (0, n - 1):
                out[y, x] = h[y, x]
                heapq.heappush(heap, (h[y, x], y, x))
    while heap:
        level, y, x = heapq.heappop(heap)
        if level > out[y, x]:
            continue
        for dx, dy in solvers.EIGHT:
            a, b = y + dy, x + dx
            if 0 < a < n - 1 and 0 < b < n - 1:
                new = max(h[a, b], level + eps * np.hypot(dx, dy))
                if new < out[a, b]:
                    out[a, b] = new
                    heapq.heappush(heap, (new, a, b))
    return out


@pytest.fixture(scope="module")
def field(spark):
    return hills(spark, 32).withColumn("hardness", (F.col("x") * 3 + F.col("y")) % 10 / 12.0)


def test_fill_is_the_priority_flood(field):
    found = solvers.fill(field, 32, steps=16, tile=16)
    assert np.allclose(array(found, "filled", 32), flood(array(field, "h", 32)))


def test_fill_of_a_winding_channel(spark):
    """A channel through walls, longer than any one round reaches, on a grid that no level divides evenly."""
    wall = (F.col("x") % 4 == 0) & ~((F.col("y") == 2) & (F.col("x") % 8 == 0)) & ~((F.col("y") == 42) & (F.col("x") % 8 == 4))
    winding = grid(spark, 45).withColumn("h", F.when(wall, 50.0).otherwise(F.abs(F.col("y") - 20) * 0.01))
    assert np.allclose(array(solvers.fill(winding, 45, steps=8, tile=8), "filled", 45), flood(array(winding, "h", 45)))


def plain_trace(surface, bed, starts, steps=260, lake=2.2, flat=0.012):
    """Visits by one particle after the other over the whole field."""
    res, visits = len(surface), np.zeros(surface.shape, int)
    look = lambda x, y: float(solvers._between(surface, np.array([x]), np.array([y]))[0])
    for px, py in starts:
        dx = dy = 0.0
        for _ in range(steps):
            xi, yi = int(min(max(px, 1), res - 2)), int(min(max(py, 1), res - 2))
            visits[yi, xi] += 1
            gx, gy = look(px + 0.65, py) - look(px - 0.65, py), look(px, py + 0.65) - look(px, py - 0.65)
            length = np.hypot(gx, gy)
            if surface[yi, xi] - bed[yi, xi] > lake or length < flat:
                break
            dx, dy = 0.45 * dx - 0.55 * gx / length, 0.45 * dy - 0.55 * gy / length
            size = max(np.hypot(dx, dy), 1e-6)
            px, py = px + dx / size, py + dy / size
            if not (1 <= px <= res - 2 and 1 <= py <= res - 2):
                break
    return visits


@pytest.mark.parametrize("tile", [8, 64])
def test_traces_over_tiles_equal_the_whole(spark, tile):
    slope = grid(spark, 40).withColumn("h", F.col("x") * 0.5 + F.sin(F.col("y") / 3.0) * 4 + F.cos(F.col("x") / 5.0) * 3)
    filled = slope.withColumn("filled", F.col("h"))
    starts = [(float(a) + 0.3, float(b) + 0.6) for a in range(0, 40, 3) for b in range(0, 40, 3)]
    particles = spark.createDataFrame([(k, *p) for k, p in enumerate(starts)], "id long, px double, py double")
    surface = array(filled, "filled", 40)
    want = plain_trace(surface, surface, starts)
    got = np.zeros_like(want)
    for r in solvers.trace(particles, filled, 40, tile=tile).collect():
        got[r.y, r.x] = r.visits
    assert (got == want).all() and want.sum() > 2000


def test_talus_tiles_equal_the_whole(field):
    h, hard = array(field, "h", 32), array(field, "hardness", 32)
    for _ in range(8):
        h = solvers.talus_step(h, hard, 2.0)
    assert np.allclose(array(solvers.talus(field, 32, 2.0, half_steps=8, tile=16), "h", 32), h)


def test_erosion_tiles_equal_the_whole(field):
    h, hard = array(field, "h", 32), array(field, "hardness", 32)
    edge = np.zeros(h.shape, bool)
    edge[[0, -1]] = edge[:, [0, -1]] = True
    s = {"h": h, "hardness": hard, "water": 0 * h, "sediment": 0 * h, "deposit": 0 * h, "flux": [0 * h] * 4}
    for _ in range(3):
        s = solvers.erosion_step(s, edge, 2.0)
    found = solvers.erosion(field, 32, 2.0, iterations=3, tile=16)
    for name in ("h", "water", "sediment", "deposit"):
        assert np.allclose(array(found, name, 32), s[name])
    assert (array(found, "water", 32)[edge] == 0).all()


def test_constant_field_stays(spark):
    flat = grid(spark, 16).withColumn("h", F.lit(5.0))
    blurred = stencil.blur(stencil.blur(flat, "h", 3, "x", "a"), "a", 3, "y", "b")
    assert blurred.where(F.abs(F.col("b") - 5) > 1e-9).isEmpty()
    assert stencil.central_difference(flat, "h", 2.0).where("slope != 0").isEmpty()


def test_ramp_has_half_slope_at_replicated_edges(spark):
    ramp = grid(spark, 8).withColumn("h", F.col("x") * 4.0)
    rows = stencil.central_difference(ramp, "h", 2.0).select("x", "slope").distinct().collect()
    assert {(r.x, r.slope) for r in rows} == {(x, 1.0 if x in (0, 7) else 2.0) for x in range(8)}
