"""Pieces of DuckDB SQL that several oracles share."""

from __future__ import annotations

MASK = 4294967295


def pcg(source: str, x: str, y: str, salt: int, u: str = "u", v: str = "v") -> str:
    """The rows of `source` with a cell's two 24-bit hashes."""
    m = f"* 1664525) & {MASK}"
    out = f"SELECT *, ((({x}) + {40000 + (salt & 0x3FFF)})::BIGINT * 1664525 + 1013904223) & {MASK} AS _a, ((({y}) + {40000 + ((salt >> 14) & 0x3FFF)})::BIGINT * 1664525 + 1013904223) & {MASK} AS _b FROM ({source})"
    mix = (f"(_a + ((_b {m})) & {MASK} AS _a", f"(_b + ((_a {m})) & {MASK} AS _b")
    fold = "xor(_a, _a >> 16) AS _a, xor(_b, _b >> 16) AS _b"
    for step in (*mix, fold, *mix):
        out = f"SELECT * REPLACE ({step}) FROM ({out})"
    return f"SELECT * EXCLUDE (_a, _b), xor(_a, _a >> 16) & 16777215 AS {u}, xor(_b, _b >> 16) & 16777215 AS {v} FROM ({out})"


def mul(a: str, k: int) -> str:
    return f"(((({a}) & 65535) * {k} + ((((({a}) >> 16) * {k}) & 65535) << 16)) & {MASK})"


def fmix(source: str, column: str) -> str:
    """The rows of `source` with the column finalized in place."""
    out = source
    for step in (f"xor({column}, {column} >> 16)", mul(column, 0x85EBCA6B), f"xor({column}, {column} >> 13)", mul(column, 0xC2B2AE35), f"xor({column}, {column} >> 16)"):
        out = f"SELECT * REPLACE ({step} AS {column}) FROM ({out})"
    return out


def cells(res: int) -> str:
    return f"SELECT (i % {res})::INTEGER AS x, (i // {res})::INTEGER AS y FROM range({res * res}) t(i)"


def moved(value: str, by: int, axis: str) -> str:
    """The value `by` cells on, the edge's beyond it."""
    window = "(PARTITION BY y ORDER BY x)" if axis == "x" else "(PARTITION BY x ORDER BY y)"
    full = window[:-1] + " ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    if not by:
        return value
    return f"coalesce({'lead' if by > 0 else 'lag'}({value}, {abs(by)}) OVER {window}, {'last' if by > 0 else 'first'}({value}) OVER {full})"


def heights(res: int) -> str:
    """The test field: whole-numbered hills."""
    return f"SELECT x, y, ((x * x * 7 + y * y * 13 + x * y * 5) % 251)::DOUBLE AS h FROM ({cells(res)})"


def hashed(source: str, h: str = "h", axes: tuple[str, ...] = ("cx", "cy", "cz")) -> str:
    """The rows of `source` with the seed in `h` made a lattice point's hash."""
    out = source
    for axis, k in zip(axes, (0x27D4EB2F, 0x165667B1, 0x9E3779B1)):
        out = fmix(f"SELECT * REPLACE (xor({h}, {mul(f'({axis} & {MASK})', k)}) AS {h}) FROM ({out})", h)
    return out


def value_noise(source: str, keys: str) -> str:
    """(keys, v): value noise in [-1, 1] at the places (x, y, z) under the seeds s of `source`; keys are unique."""
    corners = f"SELECT {keys}, s AS h, floor(x)::BIGINT + dx AS cx, floor(y)::BIGINT + dy AS cy, floor(z)::BIGINT + dz AS cz, x - floor(x) AS fx, y - floor(y) AS fy, z - floor(z) AS fz, dx, dy, dz FROM ({source}), (VALUES (0), (1)) a(dx), (VALUES (0), (1)) b(dy), (VALUES (0), (1)) d(dz)"
    w = " * ".join(f"CASE WHEN d{a} = 1 THEN f{a} * f{a} * (3 - 2 * f{a}) ELSE 1 - f{a} * f{a} * (3 - 2 * f{a}) END" for a in "xyz")
    return f"SELECT {keys}, sum(h / 4294967296.0 * {w}) * 2 - 1 AS v FROM ({hashed(corners)}) GROUP BY {keys}"
