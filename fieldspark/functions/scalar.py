"""Shader-style scalar helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, lit(low)), lit(high))


def saturate(x: Column) -> Column:
    return clamp(x, 0.0, 1.0)


def mix(a, b, t: Column) -> Column:
    return lit(a) + (lit(b) - lit(a)) * t


def smoothstep(low, high, x: Column) -> Column:
    """Hermite step; edges in falling order give a falling step."""
    t = saturate((x - lit(low)) / (lit(high) - lit(low)))
    return t * t * (3.0 - 2.0 * t)


def fract(x: Column) -> Column:
    return x - F.floor(x)


def round_half_up(x: Column) -> Column:
    """floor(x + 0.5), which also rounds negative halves up."""
    return F.floor(x + 0.5)


def pick(index: Column, values: list, default) -> Column:
    """The value at a small index; anything else gives the default."""
    out = None
    for k, v in enumerate(values):
        out = F.when(index == k, F.lit(v)) if out is None else out.when(index == k, F.lit(v))
    return out.otherwise(F.lit(default))


def number_or(x: Column, other) -> Column:
    """x, or `other` where it is NaN or null."""
    return F.coalesce(F.when(~F.isnan(x), x), lit(other))


def parse_pose(text: Column) -> Column:
    """array of five or six numbers; null with fewer than five or with one that isn't finite."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p).try_cast("double"))
    bad = F.exists(F.slice(parts, 1, 6), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when((F.size(parts) >= 5) & ~bad, F.slice(parts, 1, 6))


def hour_of(ts: Column) -> Column:
    """Hour of the day with its fraction."""
    return F.hour(ts) + F.minute(ts) / 60.0 + F.second(ts) / 3600.0
