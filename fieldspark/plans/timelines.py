"""As-of lookups, rolling metrics, order statistics and scans over events and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalar import hour_of
from ..operators import metrics, spatial
from ..session import table
from .registry import query

#: Time, saturation, contrast and shadow amount of the grade keyframes.
KEYFRAMES = (
    (0.0, 0.8, 1.06, 0.45),
    (6.2, 1.1, 1.05, 0.4),
    (11.0, 1.13, 1.07, 0.28),
    (15.5, 1.13, 1.07, 0.28),
    (19.0, 1.15, 1.1, 0.58),
    (20.6, 0.95, 1.05, 0.5),
    (24.0, 0.8, 1.06, 0.45),
)
_KEYS = ", ".join(f"({k}, {t!r}::DOUBLE, {s!r}::DOUBLE, {c!r}::DOUBLE, {a!r}::DOUBLE)" for k, (t, s, c, a) in enumerate(KEYFRAMES))


@query(
    "q_keyframe_asof",
    f"""WITH f(k, t, s, c, a) AS (VALUES {_KEYS}), h AS (SELECT event_id, extract(hour FROM ts) + extract(minute FROM ts) / 60.0::DOUBLE + floor(extract(second FROM ts)) / 3600.0::DOUBLE AS h FROM events),
b AS (SELECT h.*, f.*, lead(t) OVER w AS t1, lead(s) OVER w AS s1, lead(c) OVER w AS c1, lead(a) OVER w AS a1 FROM h, f WINDOW w AS (PARTITION BY event_id ORDER BY k)),
n AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY k DESC) AS r FROM b WHERE t1 IS NOT NULL AND (t < h OR k = 0))
SELECT event_id, round(s + (s1 - s) * (h - t) / (t1 - t), 6) AS saturation, round(c + (c1 - c) * (h - t) / (t1 - t), 6) AS contrast, round(a + (a1 - a) * (h - t) / (t1 - t), 6) AS shadow FROM n WHERE r = 1""",
)
def keyframe_asof(spark, sf_dir):
    """J-11, J-12: interpolation between the keyframes around an hour, without a join."""
    rows = table(spark, sf_dir, "events").select("event_id", hour_of(F.col("ts")).alias("h"))
    names = ["saturation", "contrast", "shadow"]
    found = spatial.asof_interpolated(rows, F.pmod("h", F.lit(24.0)), KEYFRAMES, names)
    return found.select("event_id", *[F.round(n, 6).alias(n) for n in names])


@query(
    "q_asof_join",
    "WITH p AS (SELECT user_id, ts, max(value) AS value FROM events GROUP BY ALL) SELECT e.event_id, p.ts AS seen_at, p.value AS seen_value FROM events e ASOF LEFT JOIN p ON p.user_id = e.user_id AND e.ts > p.ts",
)
def asof_join(spark, sf_dir):
    """J-11 as a join: what each event's user did last before it, in one shuffle."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    right = events.groupBy("user_id", "ts").agg(F.max("value").alias("seen_value")).withColumn("seen_at", F.col("ts"))
    left = events.select("event_id", "user_id", "ts")
    return spatial.asof_join(left, right, ["user_id"], "ts", ["seen_at", "seen_value"], strict=True).select("event_id", "seen_at", "seen_value")


@query(
    "q_floor_p95",
    "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(value) FILTER (k = least(n - 1, floor(n * 0.95::DOUBLE)) + 1) AS p95, max(value) FILTER (k = floor(n / 2.0) + 1) AS median FROM r GROUP BY event_type",
)
def floor_p95(spark, sf_dir):
    """A-18, A-19: the floor-index percentile and the upper median, by ranks."""
    rows = table(spark, sf_dir, "events").select("event_type", "value")
    by = Window.partitionBy("event_type")
    ranked = rows.withColumns({"k": F.row_number().over(by.orderBy("value")), "n": F.count("*").over(by)})
    at = lambda place, name: F.max(F.when(F.col("k") == place + 1, F.col("value"))).alias(name)
    return ranked.groupBy("event_type").agg(at(F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95)), "p95"), at(F.floor(F.col("n") / 2), "median"))


@query(
    "q_rolling_p95",
    "WITH r AS (SELECT event_id, list_sort(list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)) AS l FROM events) SELECT event_id, l[least(len(l) - 1, floor(len(l) * 0.95::DOUBLE))::INTEGER + 1] AS p95 FROM r",
)
def rolling_p95(spark, sf_dir):
    """A-18, W-7: over the last 120 rows of each user."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return metrics.rolling_floor_percentile(rows, ["user_id"], ["ts", "event_id"], "value", 0.95, 120, "p95").select("event_id", "p95")


@query(
    "q_upper_median",
    "SELECT user_id, list_sort(list(value))[(count(*) // 2 + 1)::INTEGER] AS median, list_sort(list(value))[least(count(*) - 1, floor(count(*) * 0.95::DOUBLE))::INTEGER + 1] AS p95 FROM events GROUP BY user_id",
)
def upper_median(spark, sf_dir):
    """A-19 by ranks: no user's values are gathered."""
    rows = table(spark, sf_dir, "events").select("user_id", "value")
    half = metrics.grouped_floor_percentile(rows, ["user_id"], "value", 0.5, "median")
    return half.join(metrics.grouped_floor_percentile(rows, ["user_id"], "value", 0.95, "p95"), "user_id")


@query(
    "q_ema",
    "SELECT user_id, round(list_reduce(list(value ORDER BY ts, event_id), lambda a, x: CASE WHEN a = 0 THEN x ELSE a * 0.95 + x * 0.05 END, 0.0::DOUBLE), 5) AS ema FROM events GROUP BY user_id",
)
def ema(spark, sf_dir):
    """A-20: feedback mean; zero means unset."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda s: s["value"])
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(metrics.ema(ordered, 0.05), 5).alias("ema"))


@query(
    "q_argmax_first",
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY floor(value) DESC, event_id) AS k FROM events) SELECT event_type, event_id, user_id, floor(value) AS top FROM r WHERE k = 1",
)
def argmax_first(spark, sf_dir):
    """A-21: the first of equal maxima."""
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", "user_id", F.floor("value").cast("double").alias("top"))
    return metrics.first_argmax(rows, ["event_type"], "top", ["event_id"]).select("event_type", "event_id", "user_id", "top")


@query(
    "q_band_scan",
    "SELECT user_id, round(avg(value), 5) AS mean_value, count(*) FILTER (value < 10) AS rows_0, min(event_id) FILTER (value < 10) AS first_0, max(event_id) FILTER (value < 10) AS last_0, count(*) FILTER (value < 50) AS rows_1, min(event_id) FILTER (value < 50) AS first_1, max(event_id) FILTER (value < 50) AS last_1 FROM events GROUP BY user_id",
)
def band_scan(spark, sf_dir):
    """A-22."""
    return metrics.band_scan(table(spark, sf_dir, "events"), ["user_id"], "event_id", "value", [10, 50]).withColumn("mean_value", F.round("mean_value", 5))


@query(
    "q_jump_flag",
    "WITH d AS (SELECT user_id, event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events) SELECT user_id, count(*) FILTER (abs(step) > 40) AS jumps, round(max(abs(step)), 6) AS widest FROM d GROUP BY user_id",
)
def jump_flag(spark, sf_dir):
    """W-8, ST-11: the difference to the row before, flagged."""
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").select("user_id", (F.col("value") - before).alias("step"))
    return rows.groupBy("user_id").agg(F.count_if(F.abs("step") > 40).alias("jumps"), F.round(F.max(F.abs("step")), 6).alias("widest"))


@query(
    "q_arc_length",
    "WITH s AS (SELECT o_custkey, o_orderkey, o_orderdate, abs(o_totalprice - lag(o_totalprice) OVER w) AS seg FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) SELECT o_orderkey, round(coalesce(sum(seg) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 0), 2) AS arc FROM s",
)
def arc_length(spark, sf_dir):
    """W-9: cumulative length along each customer's line."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.abs(F.col("o_totalprice") - F.lag("o_totalprice").over(w)).alias("seg"))
    total = F.sum("seg").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("o_orderkey", F.round(F.coalesce(total, F.lit(0.0)), 2).alias("arc"))


@query(
    "q_lattice_dedup",
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY floor((user_id % 500) / 60.0 + 0.5), floor(value / 25.0 + 0.5) ORDER BY value DESC, event_id) AS k FROM events) SELECT event_id, user_id, value FROM r WHERE k = 1 ORDER BY value DESC, event_id LIMIT 40",
)
def lattice_dedup(spark, sf_dir):
    """O-2, O-3: the best row of each lattice cell, then the top 40."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    x, z = (F.col("user_id") % 500) / 60.0, F.col("value") / 25.0
    return spatial.lattice_dedup(rows, x, z, 1.0, [F.desc("value"), "event_id"]).orderBy(F.desc("value"), "event_id").limit(40)


@query(
    "q_timeslice",
    "SELECT tick, count(*) AS n, sum(event_id)::BIGINT AS id_sum FROM events, range(8) t(tick) WHERE ((event_id - tick * 1250) % 10000 + 10000) % 10000 < 1250 GROUP BY tick",
)
def timeslice(spark, sf_dir):
    """ST-4: each tick's share of the rows, with wrap-around, in one pass."""
    rows = table(spark, sf_dir, "events").select("event_id")
    tick = F.floor(F.pmod("event_id", F.lit(10000)) / 1250)
    return rows.groupBy(tick.alias("tick")).agg(F.count("*").alias("n"), F.sum("event_id").alias("id_sum"))


@query(
    "q_cached_refresh",
    """WITH s AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events), p AS (SELECT *, [1, 2, 3, 6][user_id % 4 + 1] AS period, [0, 1, 2, 5][user_id % 4 + 1] AS phase FROM s)
SELECT user_id, count(*) AS frames, count(*) FILTER ((frame + phase) % period = 0 OR frame = 0) AS scheduled FROM p GROUP BY user_id""",
)
def cached_refresh(spark, sf_dir):
    """ST-6, ST-17: staggered schedules by period and phase."""
    frame = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    slot = (F.col("user_id") % 4).cast("int")
    period, phase = F.get(F.array(*map(F.lit, (1, 2, 3, 6))), slot), F.get(F.array(*map(F.lit, (0, 1, 2, 5))), slot)
    rows = table(spark, sf_dir, "events").withColumns({"frame": frame, "period": period, "phase": phase})
    return rows.groupBy("user_id").agg(F.count("*").alias("frames"), F.count_if(((F.col("frame") + F.col("phase")) % F.col("period") == 0) | (F.col("frame") == 0)).alias("scheduled"))


@query(
    "q_two_phase_windows",
    "WITH e AS (SELECT user_id, value, epoch(ts) AS t FROM events), w AS (SELECT user_id, value, 0 AS phase, floor(t / 3600) AS slot, 1 - abs(2 * (t / 3600 - floor(t / 3600)) - 1) AS weight FROM e UNION ALL SELECT user_id, value, 1, floor(t / 3600 + 0.5), 1 - abs(2 * (t / 3600 + 0.5 - floor(t / 3600 + 0.5)) - 1) FROM e) SELECT phase, slot::BIGINT AS slot, count(*) AS n, round(sum(value * weight), 4) AS blended, round(sum(weight), 4) AS weight FROM w GROUP BY phase, slot",
)
def two_phase_windows(spark, sf_dir):
    """ST-16: two half-offset windows with triangular weights that add up to one."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 3600.0
    both = F.explode(F.array(*[F.struct(F.lit(p).alias("phase"), (t + 0.5 * p).alias("t")) for p in (0, 1)]))
    rows = table(spark, sf_dir, "events").select("value", both.alias("w")).select("value", "w.phase", "w.t")
    weight = 1 - F.abs(2 * (F.col("t") - F.floor("t")) - 1)
    return rows.groupBy("phase", F.floor("t").alias("slot")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("value") * weight), 4).alias("blended"), F.round(F.sum(weight), 4).alias("weight"))
