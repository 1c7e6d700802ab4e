"""Hashes against independent plain-Python versions and public vectors."""

from itertools import islice

from pyspark.sql import functions as F

from fieldspark.functions import hashing

MASK = 0xFFFFFFFF


def fmix(h):
    h ^= h >> 16
    h = h * 0x85EBCA6B & MASK
    h ^= h >> 13
    h = h * 0xC2B2AE35 & MASK
    return h ^ h >> 16


def test_fixed_vectors(spark):
    row = spark.range(1).select(
        hashing.fnv1a(F.lit("a")).alias("a"), hashing.fnv1a(F.lit("")).alias("e"), hashing.fnv1a(F.lit("hydrology")).alias("h"),
        hashing.fmix32(F.lit(1)).alias("one"), hashing.fmix32(F.lit(123456789)).alias("n"), hashing.hash_combine(F.lit(1), F.lit(2)).alias("c"),
        hashing.sub_seed(F.lit(1), F.lit("scatter/trees")).alias("s"), hashing.sfc32(F.lit(1), 4).alias("draws"),
        hashing.pcg2d(F.lit(5), F.lit(-7), 0x1234F).alias("p"), hashing.pcg2d(F.lit(-128), F.lit(127), 0x51F3).alias("q"),
    ).first()
    assert (row.a, row.e, row.h) == (3826002220, 0x811C9DC5, 1003278008)
    assert (row.one, row.n, row.c, row.s) == (1364076727, 3126909082, 360995440, 1306174504)
    assert row.draws == [3596636168, 285703380, 1792312969, 2963537640]
    assert tuple(row.p) == (14004350, 4239386) and tuple(row.q) == (8608668, 520309)


def test_fmix_of_many(spark):
    rows = spark.range(0, 4294967296, 85899345).select("id", hashing.fmix32(F.col("id")).alias("h")).collect()
    assert all(r.h == fmix(r.id) for r in rows)


def test_draws_in_python_equal_the_column(spark):
    rows = spark.createDataFrame([(k * 7919 - 5,) for k in range(6)], "s long").select("s", hashing.sfc32(F.col("s"), 12).alias("d")).collect()
    assert all(list(islice(hashing.draws(r.s), 12)) == r.d for r in rows)
