"""Iterative grid solvers on halo tiles.

Few steps are done with window functions (see stencil); many steps are done on
tiles: a tile is read with a halo as wide as the steps' reach, runs them in
numpy and returns its inner cells. A round of rounds re-cuts the tiles, so that
no step ever needs the whole grid in one place. Tiles are bounded by TILE. A cell
is sent to the tiles whose halo it lies in, which for most cells is one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

TILE = 64
#: Fixed values of the fill, the talus and the erosion.
FILL_EPSILON = 0.0045
LEVELS = (8, 4, 2, 1)
TALUS_BASE, TALUS_HARD, TALUS_RATE = 0.62, 2.8, 0.12
ERODE = {"dt": 0.03, "rain": 0.01, "evap": 0.02, "kc": 0.55, "ks": 0.28, "kd": 0.5, "g": 9.81, "thermal": 0.14, "max_vel": 6.0, "max_erode": 0.06, "max_deposit": 0.1}
EIGHT = ((-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (1, 1), (-1, 1), (1, -1))


def at(a: np.ndarray, dx: int, dy: int) -> np.ndarray:
    """The array shifted so that each cell holds its neighbour at (dx, dy), edges replicated; rows are y."""
    padded = np.pad(a, 1, mode="edge")
    return padded[1 + dy : 1 + dy + a.shape[0], 1 + dx : 1 + dx + a.shape[1]]


def on_tiles(frame: DataFrame, res: int, values: list[str], out: list[str], halo: int, step: Callable[[dict, np.ndarray, np.ndarray], dict], tile: int = TILE) -> DataFrame:
    """Runs `step` on every tile with its halo; it gets the arrays and the cells' coordinates."""
    last = -(-res // tile) - 1

    def touched(axis: str):
        """The tiles whose halo a cell lies in: one for most cells."""
        place = F.col(axis)
        return F.explode(F.sequence(F.greatest(F.floor((place - halo) / tile), F.lit(0)), F.least(F.floor((place + halo) / tile), F.lit(last))))

    keyed = frame.select("x", "y", *values, touched("x").alias("tx")).withColumn("ty", touched("y"))

    def run(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        tx, ty = map(int, key)
        table = table.sort_values(["y", "x"])
        xs, ys = np.unique(table.x), np.unique(table.y)
        arrays = {v: table[v].to_numpy(float).reshape(len(ys), len(xs)) for v in values}
        found = step(arrays, xs, ys)
        gx, gy = np.meshgrid(xs, ys)
        inner = (gx // tile == tx) & (gy // tile == ty)
        return pd.DataFrame({"x": gx[inner].astype("int32"), "y": gy[inner].astype("int32"), **{v: found[v][inner] for v in out}})

    schema = "x int, y int, " + ", ".join(f"{v} double" for v in out)
    return keyed.groupBy("tx", "ty").applyInPandas(run, schema)


def fill_step(h: np.ndarray, w: np.ndarray, border: np.ndarray, spacing: float = 1.0) -> np.ndarray:
    """One relaxation of the filled surface: down to the lowest neighbour plus a tilt, never under the bed."""
    lowest = np.min([at(w, dx, dy) + FILL_EPSILON * spacing * np.hypot(dx, dy) for dx, dy in EIGHT], axis=0)
    return np.where(border, h, np.maximum(h, np.minimum(w, lowest)))


def _settled(now: DataFrame, res: int, spacing: float, steps: int, tile: int) -> DataFrame:
    """Relaxes `filled` over `h` round by round until no cell moves."""

    def step(a: dict, xs: np.ndarray, ys: np.ndarray) -> dict:
        edge = np.zeros(a["h"].shape, bool)
        edge[:, (xs == 0) | (xs == res - 1)] = True
        edge[(ys == 0) | (ys == res - 1)] = True
        w, left = a["filled"], steps
        while left or alone:
            after = fill_step(a["h"], w, edge, spacing)
            if (after == w).all():
                break
            w, left = after, left - 1
        return {"h": a["h"], "filled": w, "moved": a["filled"] - w}

    # A grid that one tile holds is settled there.
    alone = res <= tile
    if alone:
        return stored(on_tiles(now, res, ["h", "filled"], ["h", "filled"], 0, step, tile), "fill")
    while True:
        found = stored(on_tiles(now, res, ["h", "filled"], ["h", "filled", "moved"], min(steps, 2 * tile), step, tile), "fill")
        now = found.drop("moved")
        if found.where("moved > 0").isEmpty():
            return now


def fill(frame: DataFrame, res: int, steps: int = 48, tile: int = TILE, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(x, y, h, filled): depressions raised until they drain; the world's border stays at the bed.

    Coarse levels first: a block's bed is its highest cell, so its filled surface
    is nowhere under the true one, and a level's surface, with the tilt that the
    way inside blocks can add, is where the next finer one starts. Each level
    runs until nothing moves, so the result is exact for any field and any start.
    """
    bed = frame.select("x", "y", F.col("h").cast("double").alias("h"))
    peak = bed.agg(F.max("h")).first()[0]
    coarse, before = None, 0
    # The finest level that one tile holds needs no coarser one.
    fitting = min((k for k in levels if -(-res // k) <= tile), default=max(levels))
    for f in sorted({k for k in levels if k <= fitting} | {1}, reverse=True):
        own = -(-res // f)
        cells = bed if f == 1 else bed.groupBy(F.floor(F.col("x") / f).cast("int").alias("x"), F.floor(F.col("y") / f).cast("int").alias("y")).agg(F.max("h").alias("h"))
        if coarse is None:
            start = cells.withColumn("up", F.lit((peak or 0.0) + 4000.0))
        else:
            ratio = before // f
            keyed = cells.withColumns({"cx": F.floor(F.col("x") / ratio).cast("int"), "cy": F.floor(F.col("y") / ratio).cast("int")})
            above = coarse.select(F.col("x").alias("cx"), F.col("y").alias("cy"), (F.col("filled") + FILL_EPSILON * 3 * before).alias("up"))
            start = keyed.join(above, ["cx", "cy"])
        border = (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == own - 1) | (F.col("y") == own - 1)
        now = start.select("x", "y", "h", F.when(border, F.col("h")).otherwise(F.greatest("h", "up")).alias("filled"))
        coarse, before = _settled(now, own, float(f), steps, tile), f
    return coarse


def talus_step(h: np.ndarray, hard: np.ndarray, texel: float) -> np.ndarray:
    """One half-step of collapse to the angle of repose, which hardness raises."""
    own = texel * (hard * hard * TALUS_HARD + TALUS_BASE)
    delta = np.zeros_like(h)
    for dx, dy in EIGHT[:4]:
        near, near_hard = at(h, dx, dy), at(hard, dx, dy)
        theirs = texel * (near_hard * near_hard * TALUS_HARD + TALUS_BASE)
        delta += np.maximum(near - h - theirs, 0) - np.maximum(h - near - own, 0)
    return h + TALUS_RATE * delta


def talus(frame: DataFrame, res: int, texel: float, half_steps: int = 26, tile: int = TILE) -> DataFrame:
    """(x, y, h) after the given half-steps; needs h and hardness."""

    def step(a: dict, xs: np.ndarray, ys: np.ndarray) -> dict:
        h = a["h"]
        for _ in range(half_steps):
            h = talus_step(h, a["hardness"], texel)
        return {"h": h}

    return on_tiles(frame, res, ["h", "hardness"], ["h"], half_steps, step, tile)


def erosion_step(s: dict, edge: np.ndarray, texel: float) -> dict:
    """One pass of flux, water, erosion or deposit, transport and thermal collapse."""
    k = ERODE
    h, w, sed, hard = s["h"], s["water"], s["sediment"], s["hardness"]
    head = h + w
    flux = [np.maximum(0, f + (head - at(head, dx, dy)) * (k["dt"] * k["g"] / texel)) for f, (dx, dy) in zip(s["flux"], EIGHT[:4])]
    share = np.minimum(1, w / (np.maximum(sum(flux), 1e-6) * k["dt"]))
    west, east, south, north = flux = [f * share for f in flux]
    from_w, from_e, from_s, from_n = at(east, -1, 0), at(west, 1, 0), at(north, 0, -1), at(south, 0, 1)
    after = np.maximum(0, w + (from_w + from_e + from_s + from_n - sum(flux)) * k["dt"])
    water = np.where(edge, 0, after * (1 - k["evap"] * k["dt"]) + k["rain"] * k["dt"])
    mean = np.maximum((w + after) / 2, 1e-4) * texel
    vx, vy = (from_w - west + east - from_e) / 2 / mean, (from_s - south + north - from_n) / 2 / mean
    speed = np.hypot(vx, vy)
    slow = np.minimum(1, k["max_vel"] / np.maximum(speed, 1e-5))
    vx, vy, speed = vx * slow, vy * slow, speed * slow
    slope = np.hypot(at(h, 1, 0) - at(h, -1, 0), at(h, 0, 1) - at(h, 0, -1)) / (2 * texel)
    capacity = k["kc"] * np.maximum(slope / np.sqrt(slope * slope + 1), 0.012) * speed * np.clip(water * 4, 0, 1)
    taken = np.minimum(k["max_erode"], np.maximum(0, capacity - sed) * k["ks"] * k["dt"] * (1 - 0.92 * hard))
    left = np.minimum(k["max_deposit"], np.maximum(0, sed - capacity) * k["kd"] * k["dt"])
    h, sed = h + left - taken, sed + taken - left
    rows, cols = np.indices(h.shape)
    bx, by = np.clip(cols - vx * k["dt"] / texel, 0, h.shape[1] - 1), np.clip(rows - vy * k["dt"] / texel, 0, h.shape[0] - 1)
    x0, y0 = np.floor(bx).astype(int), np.floor(by).astype(int)
    x1, y1, fx, fy = np.minimum(x0 + 1, h.shape[1] - 1), np.minimum(y0 + 1, h.shape[0] - 1), bx - x0, by - y0
    sed = (sed[y0, x0] * (1 - fx) + sed[y0, x1] * fx) * (1 - fy) + (sed[y1, x0] * (1 - fx) + sed[y1, x1] * fx) * fy
    rest, rate = 0.55 + 2.6 * hard * hard, (1 - hard) ** 1.5 * k["thermal"] * k["dt"] * texel
    net = np.zeros_like(h)
    for dx, dy in EIGHT:
        far, near = texel * np.hypot(dx, dy), at(h, dx, dy)
        net += np.maximum(0, (near - h) / far - at(rest, dx, dy)) * at(rate, dx, dy) - np.maximum(0, (h - near) / far - rest) * rate
    return {"h": h + np.clip(net, -0.22, 0.22), "water": water, "sediment": sed, "hardness": hard, "flux": flux, "deposit": s["deposit"] + left}


def erosion(frame: DataFrame, res: int, texel: float, iterations: int = 8, tile: int = TILE) -> DataFrame:
    """(x, y, h, water, sediment, deposit) after the given iterations; each reaches five cells."""

    def step(a: dict, xs: np.ndarray, ys: np.ndarray) -> dict:
        edge = np.zeros(a["h"].shape, bool)
        edge[:, (xs == 0) | (xs == res - 1)] = True
        edge[(ys == 0) | (ys == res - 1)] = True
        zero = np.zeros_like(a["h"])
        s = {"h": a["h"], "hardness": a["hardness"], "water": zero, "sediment": zero, "deposit": zero, "flux": [zero] * 4}
        for _ in range(iterations):
            s = erosion_step(s, edge, texel)
        return s

    return on_tiles(frame, res, ["h", "hardness"], ["h", "water", "sediment", "deposit"], 5 * iterations, step, tile)


def _between(field: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = np.clip(x, 0, field.shape[1] - 1), np.clip(y, 0, field.shape[0] - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1, fx, fy = np.minimum(x0 + 1, field.shape[1] - 1), np.minimum(y0 + 1, field.shape[0] - 1), x - x0, y - y0
    return (field[y0, x0] * (1 - fx) + field[y0, x1] * fx) * (1 - fy) + (field[y1, x0] * (1 - fx) + field[y1, x1] * fx) * fy


#: Cells that a tile of the tracing sees beyond its own, so that a particle in it can look around.
LOOK = 2


def trace(particles: DataFrame, field: DataFrame, res: int, steps: int = 260, lake: float = 2.2, flat: float = 0.012, tile: int = 4 * TILE) -> DataFrame:
    """(x, y, visits): paths of particles (id, px, py) down a filled surface, with inertia.

    A tile moves the particles in it until they leave it, end or have made all
    their steps, and hands those that left over to the tiles that they are in
    now, round by round; neither field nor particles are ever in one place.
    """
    place = lambda c: F.floor(F.least(F.greatest(F.floor(F.col(c)), F.lit(1)), F.lit(res - 2)) / tile).cast("int")
    last = -(-res // tile) - 1
    near = lambda c: F.explode(F.sequence(F.greatest(F.floor((F.col(c) - LOOK) / tile), F.lit(0)), F.least(F.floor((F.col(c) + LOOK) / tile), F.lit(last))))
    cells = field.select("x", "y", "h", "filled", near("x").alias("tx")).withColumn("ty", near("y")).select(F.col("tx").cast("int").alias("tx"), F.col("ty").cast("int").alias("ty"), "x", "y", "h", "filled")
    cells = stored(cells, "trace-cells")
    zero = F.lit(0.0)
    now = stored(particles.select(F.col("px").cast("double").alias("px"), F.col("py").cast("double").alias("py"), zero.alias("dx"), zero.alias("dy"), F.lit(steps).alias("left")), "particles")

    def run(key: tuple, moving: pd.DataFrame, ground: pd.DataFrame) -> pd.DataFrame:
        names = ["x", "y", "n", "px", "py", "dx", "dy", "left"]
        if not len(moving) or not len(ground):
            return pd.DataFrame({n: [] for n in names})
        ground = ground.sort_values(["y", "x"])
        ox, oy = int(ground.x.min()), int(ground.y.min())
        shape = int(ground.y.max()) - oy + 1, int(ground.x.max()) - ox + 1
        surface, bed = ground.filled.to_numpy().reshape(shape), ground.h.to_numpy().reshape(shape)
        px, py, dx, dy, left = (moving[n].to_numpy() for n in ("px", "py", "dx", "dy", "left"))
        visits = np.zeros(shape, np.int64)
        gone = []
        while len(px):
            xi, yi = np.clip(px, 1, res - 2).astype(int), np.clip(py, 1, res - 2).astype(int)
            away = (xi // tile != key[0]) | (yi // tile != key[1])
            if away.any():
                gone.append(np.stack([v[away] for v in (px, py, dx, dy, left)]))
                px, py, dx, dy, left, xi, yi = (v[~away] for v in (px, py, dx, dy, left, xi, yi))
            np.add.at(visits, (yi - oy, xi - ox), 1)
            at_x, at_y = px - ox, py - oy
            gx, gy = _between(surface, at_x + 0.65, at_y) - _between(surface, at_x - 0.65, at_y), _between(surface, at_x, at_y + 0.65) - _between(surface, at_x, at_y - 0.65)
            length = np.hypot(gx, gy)
            go = (surface[yi - oy, xi - ox] - bed[yi - oy, xi - ox] <= lake) & (length >= flat)
            px, py, dx, dy, left, gx, gy, length = (v[go] for v in (px, py, dx, dy, left, gx, gy, length))
            dx, dy = 0.45 * dx - 0.55 * gx / length, 0.45 * dy - 0.55 * gy / length
            size = np.maximum(np.hypot(dx, dy), 1e-6)
            px, py, left = px + dx / size, py + dy / size, left - 1
            inside = (px >= 1) & (px <= res - 2) & (py >= 1) & (py <= res - 2) & (left > 0)
            px, py, dx, dy, left = (v[inside] for v in (px, py, dx, dy, left))
        seen_y, seen_x = np.nonzero(visits)
        out = np.concatenate(gone, 1) if gone else np.zeros((5, 0))
        none = np.full(len(seen_x), np.nan)
        here = pd.DataFrame({"x": seen_x + ox, "y": seen_y + oy, "n": visits[seen_y, seen_x], "px": none, "py": none, "dx": none, "dy": none, "left": 0})
        there = pd.DataFrame({"x": -1, "y": -1, "n": 0, **dict(zip(names[3:], out))})
        return pd.concat([here, there]).astype({"x": "int32", "y": "int32", "n": "int64", "left": "int32"})

    schema = "x int, y int, n long, px double, py double, dx double, dy double, left int"
    visits = None
    while not now.isEmpty():
        dealt = now.withColumns({"tx": place("px"), "ty": place("py")})
        found = stored(dealt.groupBy("tx", "ty").cogroup(cells.groupBy("tx", "ty")).applyInPandas(run, schema), "traced")
        own = found.where("n > 0").select("x", "y", "n")
        visits = own if visits is None else stored(visits.unionByName(own).groupBy("x", "y").agg(F.sum("n").alias("n")), "visits")
        now = found.where("n = 0").select("px", "py", "dx", "dy", "left")
    if visits is None:
        return particles.sparkSession.createDataFrame([], "x int, y int, visits long")
    return visits.groupBy("x", "y").agg(F.sum("n").alias("visits"))


def flow_strength(visits, particles: int, cells: int, extra: float, gain: float):
    """clamp(log2(visits / threshold) * gain), zero up to the threshold."""
    t = F.least(F.greatest(visits / (particles / cells + extra), F.lit(1e-5)), F.lit(60.0))
    return F.when(t > 1, F.least(F.greatest(F.log2(t) * gain, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
