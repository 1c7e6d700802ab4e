"""Recursive subdivision level by level, and growth as a table function."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.hashing import draws
from .grid import WORLD_SIZE
from .scatter import capped

#: Fixed split rule of the reference's tiles.
SPLIT, MAX_TILES = 2.1, 2048


def quadtree(cameras: DataFrame, min_size: float = 128.0, world: float = WORLD_SIZE) -> DataFrame:
    """(camera, ox, oz, size, lod) for cameras (camera, cx, cz): a tile splits while it is large for its distance.

    Tiles are split level by level; their number of levels is known beforehand.
    Where a camera could have more than MAX_TILES, the first ones depth first stay.
    """
    corners = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(sx).alias("sx"), F.lit(sz).alias("sz")) for k, (sx, sz) in enumerate(((-1, -1), (1, -1), (-1, 1), (1, 1)))])
    now = cameras.select("camera", "cx", "cz", F.lit(0.0).alias("ox"), F.lit(0.0).alias("oz"), F.lit(float(world)).alias("size"), F.lit("").alias("path"))
    levels = max(0, math.ceil(math.log2(world / min_size)))
    done = None
    for lod in range(levels + 1):
        dx, dz = (F.greatest(F.abs(F.col(c) - F.col(o)) - F.col("size") / 2, F.lit(0.0)) for c, o in (("cx", "ox"), ("cz", "oz")))
        split = (F.col("size") > min_size) & (F.sqrt(dx * dx + dz * dz) < F.col("size") * SPLIT)
        marked = now.withColumn("split", split)
        own = marked.where(~F.col("split")).select("camera", "ox", "oz", "size", F.lit(lod).alias("lod"), "path")
        done = own if done is None else done.unionByName(own)
        cut = marked.where("split").withColumn("c", F.explode(corners))
        quarter = F.col("size") / 4
        now = cut.select("camera", "cx", "cz", (F.col("ox") + F.col("c.sx") * quarter).alias("ox"), (F.col("oz") + F.col("c.sz") * quarter).alias("oz"), (F.col("size") / 2).alias("size"), F.concat("path", F.col("c.k").cast("string")).alias("path"))
    if 4**levels > MAX_TILES:
        done = capped(done, ["camera"], ["path"], MAX_TILES)
    return done.drop("path")


@udtf(returnType="branch int, parent int, level int, x double, y double, z double, length double")
class Growth:
    """Branches of a seeded recursive grammar, depth first under a budget; the order of its draws matters, so a plant is one row's work."""

    def eval(self, seed: int, levels: int, children: int, budget: int):
        drawn = draws(seed)

        def draw() -> float:
            return next(drawn) / 4294967296.0

        count, stack = 0, [(-1, 0, 0.0, 0.0, 0.0, 8.0)]
        while stack and count < budget:
            parent, level, x, y, z, length = stack.pop()
            own, count = count, count + 1
            yield own, parent, level, x, y, z, length
            if level < levels:
                for _ in range(children):
                    turn, lift, scale = 2 * math.pi * draw(), 0.3 + 0.5 * draw(), 0.55 + 0.2 * draw()
                    flat = math.sqrt(1 - lift * lift)
                    stack.append((own, level + 1, x + length * flat * math.cos(turn), y + length * lift, z + length * flat * math.sin(turn), length * scale))


def growth(seeds: DataFrame, levels: int = 3, children: int = 3, budget: int = 9000) -> DataFrame:
    """(plant, branch, parent, level, x, y, z, length) for plants (plant, seed)."""
    spark = seeds.sparkSession
    spark.udtf.register("fieldspark_growth", Growth)
    seeds.createOrReplaceTempView("fieldspark_seeds")
    return spark.sql(f"SELECT plant, t.* FROM fieldspark_seeds, LATERAL fieldspark_growth(seed, {levels}, {children}, {budget}) t")


def icosphere_counts(spark: SparkSession, depth: int) -> DataFrame:
    """(level, vertices, edges, faces) by subdividing faces and merging the midpoints of shared edges."""
    top = [(0, 11, 5), (0, 5, 1), (0, 1, 7), (0, 7, 10), (0, 10, 11), (1, 5, 9), (5, 11, 4), (11, 10, 2), (10, 7, 6), (7, 1, 8), (3, 9, 4), (3, 4, 2), (3, 2, 6), (3, 6, 8), (3, 8, 9), (4, 9, 5), (2, 4, 11), (6, 2, 10), (8, 6, 7), (9, 8, 1)]
    faces = spark.createDataFrame([tuple(map(str, f)) for f in top], "a string, b string, c string")
    out = None
    for level in range(depth + 1):
        pairs = faces.select(F.explode(F.array(*[F.array_sort(F.array(F.col(p), F.col(q))) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))])).alias("e"))
        v = faces.select(F.lit(level).alias("level"), F.explode(F.array("a", "b", "c")).alias("v")).groupBy("level").agg(F.count_distinct("v").alias("vertices"))
        e = pairs.select(F.lit(level).alias("level"), "e").groupBy("level").agg(F.count_distinct("e").alias("edges"))
        f = faces.select(F.lit(level).alias("level")).groupBy("level").agg(F.count("*").alias("faces"))
        own = v.join(e, "level").join(f, "level")
        out = own if out is None else out.unionByName(own)
        # A midpoint is named by its edge, so that both faces of the edge name it alike.
        mid = lambda p, q: F.sha2(F.array_join(F.array_sort(F.array(F.col(p), F.col(q))), "-"), 256)
        m = faces.select("a", "b", "c", mid("a", "b").alias("ab"), mid("b", "c").alias("bc"), mid("c", "a").alias("ca"))
        cut = F.array(*[F.struct(F.col(p).alias("a"), F.col(q).alias("b"), F.col(r).alias("c")) for p, q, r in (("a", "ab", "ca"), ("b", "bc", "ab"), ("c", "ca", "bc"), ("ab", "bc", "ca"))])
        faces = m.select(F.explode(cut).alias("f")).select("f.a", "f.b", "f.c")
    return out
