"""Order statistics, rolling metrics, scans and image differences with the reference's index rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def floor_percentile(values: Column, share: float) -> Column:
    """sorted[min(n - 1, floor(share * n))] of an array."""
    n = F.size(values)
    return F.get(F.sort_array(values), F.least(n - 1, F.floor(n * F.lit(share)).cast("int")))


def upper_median(values: Column) -> Column:
    """sorted[floor(n / 2)] of an array."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def grouped_floor_percentile(rows: DataFrame, group: Sequence[str], value: str, share: float, out: str) -> DataFrame:
    """The same rule by ranks, without gathering a group's values in an array."""
    by = Window.partitionBy(*group)
    ranked = rows.withColumns({"_k": F.row_number().over(by.orderBy(value)), "_n": F.count("*").over(by)})
    return ranked.where(F.col("_k") == F.least(F.col("_n") - 1, F.floor(F.col("_n") * F.lit(share))) + 1).select(*group, F.col(value).alias(out))


def rolling_floor_percentile(rows: DataFrame, by: Sequence[str], order: Sequence, value: str, share: float, last: int, out: str) -> DataFrame:
    """The rule over the last `last` rows of each key: arrays are of bounded size."""
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - last, 0)
    return rows.withColumn(out, floor_percentile(F.collect_list(value).over(window), share))


def ema(values: Column, alpha: float) -> Column:
    """Feedback mean of an array, seeded by its first value; exact zero means unset."""
    return F.aggregate(values, F.lit(0.0), lambda acc, x: F.when(acc == 0.0, x).otherwise(acc * (1 - alpha) + x * alpha))


def newest_partition_sum(rows: DataFrame, kind: str, version: str, label: str, value: Column, out: str) -> DataFrame:
    """Sums by label over each kind's newest version only, and the kind's total under the label `total`."""
    newest = rows.groupBy(kind).agg(F.max(version).alias(version))
    own = rows.join(newest, [kind, version], "left_semi")
    return own.rollup(kind, label).agg(F.sum(value).alias(out)).where(F.col(kind).isNotNull()).withColumn(label, F.coalesce(F.col(label), F.lit("total")))


def first_argmax(rows: DataFrame, group: Sequence[str], value: str, position: Sequence[str]) -> DataFrame:
    """The row of the greatest value, the first of equals; both parts of the rule go into one partial aggregate."""
    others = [c for c in rows.columns if c not in group]
    key = F.struct(F.col(value), *[(-F.col(p)).alias(f"_{p}") for p in position])
    best = rows.groupBy(*group).agg(F.max_by(F.struct(*others), key).alias("b"))
    return best.select(*group, *[F.col(f"b.{c}").alias(c) for c in others])


def ordered_transmittance(rows: DataFrame, by: Sequence[str], order: Sequence, density: Column, out: str) -> DataFrame:
    """exp(-sum of densities in front), front to back."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.exp(-F.coalesce(F.sum(density).over(before), F.lit(0.0))))


def pixel_difference(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, threshold: float) -> DataFrame:
    """(cells, changed, mean_delta) of two images joined by position; positions in one only are an error."""
    joined = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), list(keys), "full")
    both = joined.withColumn("_d", F.when(F.assert_true(F.col("_a").isNotNull() & F.col("_b").isNotNull(), "the images differ in size").isNull(), F.abs(F.col("_a") - F.col("_b"))))
    return both.agg(F.count("*").alias("cells"), F.count_if(F.col("_d") > threshold).alias("changed"), F.avg("_d").alias("mean_delta"))


def band_scan(rows: DataFrame, group: Sequence[str], position: str, value: str, limits: Sequence[float]) -> DataFrame:
    """For each limit the count, first and last position of values under it, and the mean of all."""
    out = [F.avg(value).alias("mean_value")]
    for k, limit in enumerate(limits):
        under = F.when(F.col(value) < limit, F.col(position))
        out += [F.count(under).alias(f"rows_{k}"), F.min(under).alias(f"first_{k}"), F.max(under).alias(f"last_{k}")]
    return rows.groupBy(*group).agg(*out)
