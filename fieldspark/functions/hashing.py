"""32-bit integer hashes and seeded streams as Column expressions.

Spark's ANSI mode raises an error when a BIGINT overflows, so every product is
split into 16-bit halves and masked; no value ever leaves 53 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
#: Fixed values of FNV-1a, of the murmur3 finalizer and of the golden-ratio combiner.
FNV_BASIS, FNV_PRIME = 0x811C9DC5, 0x01000193
FMIX_1, FMIX_2 = 0x85EBCA6B, 0xC2B2AE35
COMBINE_1, COMBINE_2 = 0x9E3779B1, 0x85EBCA77
#: Fixed values of the lattice hashes.
PCG_MUL, PCG_ADD, PCG_BIAS = 1664525, 1013904223, 40000
LATTICE = (0x27D4EB2F, 0x165667B1, 0x9E3779B1)


def u32(c: Column) -> Column:
    return c.bitwiseAND(F.lit(MASK))


def mul32(a: Column, k: int) -> Column:
    """a * k modulo 2**32, for 0 <= a < 2**32."""
    low = a.bitwiseAND(F.lit(0xFFFF)) * F.lit(k)
    high = F.shiftleft((F.shiftright(a, 16) * F.lit(k)).bitwiseAND(F.lit(0xFFFF)), 16)
    return u32(low + high)


def fnv1a(text: Column) -> Column:
    """FNV-1a over the characters of an ASCII string."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("bigint"))
    return F.when(F.length(text) == 0, F.lit(FNV_BASIS)).otherwise(F.aggregate(codes, F.lit(FNV_BASIS).cast("bigint"), lambda h, c: mul32(h.bitwiseXOR(c), FNV_PRIME)))


def _steps(start: Column, *steps) -> Column:
    """Runs unary steps one after another, each on the value of the one before, not on its expression."""
    for step in steps:
        start = F.element_at(F.transform(F.array(start), step), 1)
    return start


def fmix32(h: Column) -> Column:
    return _steps(
        u32(h.cast("bigint")),
        lambda x: mul32(x.bitwiseXOR(F.shiftright(x, 16)), FMIX_1),
        lambda x: mul32(x.bitwiseXOR(F.shiftright(x, 13)), FMIX_2),
        lambda x: x.bitwiseXOR(F.shiftright(x, 16)),
    )


def hash_combine(a: Column, b: Column) -> Column:
    return fmix32(mul32(u32(a.cast("bigint")), COMBINE_1).bitwiseXOR(mul32(u32(b.cast("bigint")), COMBINE_2)))


def sub_seed(seed: Column, stream: Column) -> Column:
    """The seed of a named stream; another stream never shifts it."""
    return hash_combine(seed, fnv1a(stream))


def pcg2d(x: Column, y: Column, salt: int) -> Column:
    """struct(u, v): two 24-bit hashes of a cell; the bias keeps negative cells positive."""
    a = (x + F.lit(PCG_BIAS + (salt & 0x3FFF))).cast("bigint")
    b = (y + F.lit(PCG_BIAS + ((salt >> 14) & 0x3FFF))).cast("bigint")

    def scaled(c: Column) -> Column:
        return u32(c * F.lit(PCG_MUL))

    def fold(c: Column) -> Column:
        return c.bitwiseXOR(F.shiftright(c, 16))

    pair = lambda u, v: F.struct(u.alias("u"), v.alias("v"))
    return _steps(
        pair(u32(scaled(a) + PCG_ADD), u32(scaled(b) + PCG_ADD)),
        lambda s: pair(u32(s["u"] + scaled(s["v"])), s["v"]),
        lambda s: pair(s["u"], u32(s["v"] + scaled(s["u"]))),
        lambda s: pair(fold(s["u"]), fold(s["v"])),
        lambda s: pair(u32(s["u"] + scaled(s["v"])), s["v"]),
        lambda s: pair(s["u"], u32(s["v"] + scaled(s["u"]))),
        lambda s: pair(fold(s["u"]).bitwiseAND(F.lit(0xFFFFFF)), fold(s["v"]).bitwiseAND(F.lit(0xFFFFFF))),
    )


def cell_hash(x: Column, y: Column, salt: int) -> Column:
    """Uniform [0, 1) of a cell."""
    return pcg2d(x, y, salt)["u"] / F.lit(16777216.0)


def hash3(x: Column, y: Column, z: Column, seed: Column) -> Column:
    """Uniform [0, 1) of a lattice point."""
    h = u32(seed.cast("bigint"))
    for c, k in zip((x, y, z), LATTICE):
        h = fmix32(h.bitwiseXOR(mul32(u32(c.cast("bigint")), k)))
    return h / F.lit(4294967296.0)


def slot_hash(slot: Column, salt: int) -> Column:
    """24 bits of an instance slot; one shift depends on the value itself."""
    return _steps(
        u32(mul32(u32(slot.cast("bigint") + salt), 747796405) + 2891336453),
        lambda a: mul32(F.call_function("shiftright", a, (F.shiftright(a, 28) + 4).cast("int")).bitwiseXOR(a), 277803737),
        lambda b: F.shiftright(b, 22).bitwiseXOR(b).bitwiseAND(F.lit(0xFFFFFF)),
    )


def lcg(seed: Column, count: int, mul: int = PCG_MUL, add: int = PCG_ADD) -> Column:
    """The first `count` states of a linear congruential generator."""
    start = F.struct(u32(seed.cast("bigint")).alias("s"), F.array().cast("array<bigint>").alias("out"))

    def step(state: Column, _: Column) -> Column:
        nxt = u32(mul32(state["s"], mul) + add)
        return F.struct(nxt.alias("s"), F.concat(state["out"], F.array(nxt)).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(count)), start, step, lambda s: s["out"])


def sfc32(seed: Column, count: int) -> Column:
    """The first `count` draws of the seeded small-fast-counting generator."""
    gold = 0x9E3779B9
    a, b, c, d = (fmix32(u32(u32(seed.cast("bigint")) + F.lit((k * gold) & MASK))) for k in range(1, 5))
    start = F.struct(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"), F.array().cast("array<bigint>").alias("out"))

    def step(s: Column, k: Column) -> Column:
        t = u32(s["a"] + s["b"] + s["d"])
        turned = u32(F.shiftleft(s["c"].bitwiseAND(F.lit(0x7FF)), 21)).bitwiseOR(F.shiftright(s["c"], 11))
        return F.struct(
            s["b"].bitwiseXOR(F.shiftright(s["b"], 9)).alias("a"),
            u32(s["c"] + F.shiftleft(s["c"], 3)).alias("b"),
            u32(turned + t).alias("c"),
            u32(s["d"] + 1).alias("d"),
            F.when(k > 8, F.concat(s["out"], F.array(t))).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(count + 8)), start, step, lambda s: s["out"])


def draws(seed: int) -> Iterator[int]:
    """The same generator in Python, draw by draw, for sequential work on one key."""

    def mixed(h: int) -> int:
        h = (h ^ (h >> 16)) * FMIX_1 & MASK
        h = (h ^ (h >> 13)) * FMIX_2 & MASK
        return h ^ (h >> 16)

    a, b, c, d = (mixed((seed + k * 0x9E3779B9) & MASK) for k in range(1, 5))
    skipped = 0
    while True:
        t = (a + b + d) & MASK
        a, b, c, d = b ^ (b >> 9), (c + (c << 3)) & MASK, (((c << 21) | (c >> 11)) + t) & MASK, (d + 1) & MASK
        if skipped < 8:
            skipped += 1
        else:
            yield t


def gauss(u: Column, v: Column) -> Column:
    """A normal draw from two uniform ones (Box-Muller)."""
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * math.pi * v)


def sphere_direction(k: Column, count: int) -> Column:
    """Direction k of `count` golden-angle directions, as struct(x, y, z)."""
    y = 1.0 - (2.0 * k + 1.0) / F.lit(float(count))
    r = F.sqrt(1.0 - y * y)
    turn = k * F.lit(math.pi * (3.0 - math.sqrt(5.0)))
    return F.struct((r * F.cos(turn)).alias("x"), y.alias("y"), (r * F.sin(turn)).alias("z"))
