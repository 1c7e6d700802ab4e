"""Rivers carved from flow strength, moisture and the water surface, as projections over neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clamp, smoothstep
from . import stencil

#: Depths that make a lake and a marsh, the level that marks dry cells, and the steepest water.
LAKE_DELTA, MARSH_DELTA = 2.2, 0.9
DRY, STEEP = -1e4, 0.35


def carved(cells: DataFrame, texel: float) -> DataFrame:
    """Adds bed, depth, river_depth, surface, flow_x, flow_y and source to cells (x, y, h, filled, flow, wet_flow, lake, rain).

    `flow` and `wet_flow` are the widened strengths, `lake` the blurred depth of
    standing water and `rain` what erosion left.
    """
    near = stencil.cross(cells, "filled")
    gx, gy = F.col("w") - F.col("e"), F.col("s") - F.col("n")
    rows = near.withColumns({"gx": gx, "gy": gy, "g": F.sqrt(gx * gx + gy * gy), "is_lake": F.col("lake") > LAKE_DELTA, "strong": clamp(F.col("flow") * 2.1, 0.0, 1.0), "wide": clamp(F.col("wet_flow") * 1.5, 0.0, 1.0)})
    rows = rows.withColumns({"fade": smoothstep(LAKE_DELTA * 0.7, 0.12, F.col("lake")), "gentle": smoothstep(0.5, 0.24, F.col("g") / (2 * texel))})
    lake, strong, gentle = F.col("is_lake"), F.col("strong"), F.col("gentle")
    rows = rows.withColumn("depth", F.pow(strong, 1.35) * 7.5 * F.col("fade")).withColumn("bed", F.col("h") - F.col("depth"))
    rise = F.greatest((F.pow(F.col("wide"), 2.2) * 3.3 * F.col("fade") * 0.45 + 0.12) * gentle - 0.12, F.lit(0.0))
    rows = rows.withColumn("rise", rise)
    speed = F.when(lake, 0.0).otherwise(strong)
    marsh = F.when(F.col("lake") > MARSH_DELTA, 0.8).otherwise(0.0)
    return rows.withColumns(
        {
            "river_depth": F.when(lake, F.col("lake")).when(strong > 0.02, (F.col("depth") * 0.45 + 0.12) * gentle).otherwise(0.0),
            "surface": F.when(lake, F.col("filled")).when((F.col("wide") > 0.05) & (F.col("rise") > 0.05), F.col("bed") + F.col("rise")).otherwise(DRY),
            "flow_x": F.col("gx") / F.greatest(F.col("g"), F.lit(1e-5)) * speed,
            "flow_y": F.col("gy") / F.greatest(F.col("g"), F.lit(1e-5)) * speed,
            "source": clamp(F.when(lake, 1.0).otherwise(F.greatest(strong * 0.85, marsh)) + clamp(F.col("rain") * 2, 0.0, 0.35), 0.0, 1.0),
        }
    )


def moisture(cells: DataFrame, source: str, out: str, radius: int = 10) -> DataFrame:
    """Two separable triangle blurs of the moisture source."""
    now = cells.withColumn(out, F.col(source))
    for _ in range(2):
        for axis in "xy":
            now = stencil.blur(now, out, radius, axis, out)
    return now


def water_surface(cells: DataFrame, texel: float, passes: int = 4) -> DataFrame:
    """(x, y, wet, water): dry cells sink under their lowest neighbour, wet ones are smoothed, and steep water between wet ones is cut.

    cells has the bed in `bed` and the level of open water, or DRY, in `surface`.
    """
    near = stencil.box(cells.select("x", "y", "bed", "surface"), "bed")
    low = F.least(*[F.col(c) for c in ("bed", "w", "e", "s", "n", "sw", "se", "nw", "ne")])
    wet = (F.col("surface") > -1e3).cast("int")
    now = near.select("x", "y", "bed", wet.alias("wet"), F.when(wet == 1, F.col("surface")).otherwise(low - 2).alias("water"))
    for _ in range(passes):
        now = stencil.masked_mean(now, "water", "wet", "smooth").select("x", "y", "bed", "wet", F.col("smooth").alias("water"))
    steep = stencil.steepest_masked(now, "water", "wet", "drop")
    cut = (F.col("wet") == 1) & (F.col("drop") / texel > STEEP)
    return steep.select("x", "y", "wet", F.when(cut, F.col("bed") - 2).otherwise(F.col("water")).alias("water"))
