"""Streams over the events table, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..streaming import stateful
from ..session import shared_dir, table
from ..streaming.run import observed, settled, source
from .registry import query


def events(spark, sf_dir):
    """The columns that the state functions need."""
    return source(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", "event_type")


@query("q_stream_ema", "SELECT user_id, ema, n FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) JOIN (SELECT user_id, round(list_reduce(list(value ORDER BY ts, event_id), lambda a, x: CASE WHEN a = 0 THEN x ELSE a * 0.95 + x * 0.05 END, 0.0::DOUBLE), 5) AS ema FROM events GROUP BY user_id) USING (user_id)")
def stream_ema(spark, sf_dir):
    """ST-3."""
    return settled(stateful.ema(events(spark, sf_dir)), ["user_id"]).withColumn("ema", F.round("ema", 5))


@query(
    "q_stream_ttl",
    "WITH d AS (SELECT user_id, epoch(ts) AS t, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events), b AS (SELECT user_id, max(t) FILTER (gap IS NULL OR gap > 36000) AS born, max(t) AS seen, count(*) AS rows, count(*) FILTER (gap IS NULL OR gap > 36000) AS lives FROM d GROUP BY user_id) SELECT user_id, lives, round(seen - born, 3) AS age, rows FROM b",
)
def stream_ttl(spark, sf_dir):
    """ST-5, ST-15: entities with a time to live of ten hours."""
    return settled(stateful.ttl(events(spark, sf_dir), 36000.0), ["user_id"]).withColumn("age", F.round("age", 3))


def _folded(start: str, first: str, step: str) -> str:
    """Each user's rows in order, folded into one state; rows and state are structs alike."""
    return f"(SELECT user_id, list_reduce(list({{{first}}} ORDER BY ts, event_id), lambda a, e: {{{step}}}, {{{start}}}) AS s FROM events GROUP BY user_id)"


_DUE = "((a.frames + [0, 1, 2, 5][user_id % 4 + 1]) % [1, 2, 3, 6][user_id % 4 + 1] = 0 OR a.held IS NULL OR abs(e.held - a.held) >= 4)"
_CACHED = _folded(
    "'frames': 0::BIGINT, 'refreshes': 0::BIGINT, 'held': NULL::DOUBLE",
    "'frames': 0::BIGINT, 'refreshes': 0::BIGINT, 'held': value",
    f"'frames': a.frames + 1, 'refreshes': a.refreshes + {_DUE}::BIGINT, 'held': CASE WHEN {_DUE} THEN e.held ELSE a.held END",
)


@query("q_stream_cached", f"SELECT user_id, s.frames AS frames, s.refreshes AS refreshes, s.held AS held FROM {_CACHED}")
def stream_cached(spark, sf_dir):
    """ST-6."""
    return settled(stateful.cached(events(spark, sf_dir)), ["user_id"])


_FAR = "(a.place IS NULL OR abs(e.place - a.place) >= 20)"
_MOVED = _folded("'rebuilds': 0::BIGINT, 'place': NULL::DOUBLE", "'rebuilds': 0::BIGINT, 'place': value", f"'rebuilds': a.rebuilds + {_FAR}::BIGINT, 'place': CASE WHEN {_FAR} THEN e.place ELSE a.place END")


@query("q_stream_moved", f"SELECT user_id, s.rebuilds AS rebuilds, s.place AS place FROM {_MOVED}")
def stream_moved(spark, sf_dir):
    """ST-7."""
    return settled(stateful.moved(events(spark, sf_dir)), ["user_id"])


_DT = "coalesce(least(greatest(e.last - a.last, 0), 0.1), 0)"
_V = f"((a.v + (e.x - a.x) * 40 * {_DT}) * power(0.85::DOUBLE, {_DT} / 0.1))"
_DAMPED = _folded("'x': 0.0::DOUBLE, 'v': 0.0::DOUBLE, 'last': NULL::DOUBLE", "'x': value, 'v': 0.0::DOUBLE, 'last': epoch(ts)", f"'x': a.x + {_V} * {_DT}, 'v': {_V}, 'last': e.last")


@query("q_stream_damped", f"SELECT user_id, round(s.x, 4) AS x, round(s.v, 4) AS v FROM {_DAMPED}")
def stream_damped(spark, sf_dir):
    """ST-2, ST-12: a damped spring."""
    return settled(stateful.damped(events(spark, sf_dir)), ["user_id"]).select("user_id", F.round("x", 4).alias("x"), F.round("v", 4).alias("v"))


@query("q_stream_tumbling", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    """Hourly windows under a watermark."""
    timed = events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "2 hours")
    counts = timed.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    flat = counts.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "total")
    return settled(flat, ["event_type", "start"]).withColumn("total", F.round("total", 4))


@query(
    "q_stream_session",
    "WITH d AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM d) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k",
)
def stream_session(spark, sf_dir):
    """ST-13: sessions that end after six quiet hours."""
    timed = events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    counts = timed.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return settled(counts.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n"), ["user_id", "start"], "complete")


_OLD = "(a.since IS NULL OR e.since - a.since > 10800)"
_BAKED = _folded(
    "'bakes': 0::BIGINT, 'baked': 0.0::DOUBLE, 'since': NULL::DOUBLE, 'residual': 0.0::DOUBLE",
    "'bakes': 0::BIGINT, 'baked': value, 'since': epoch(ts), 'residual': 0.0::DOUBLE",
    f"'bakes': a.bakes + {_OLD}::BIGINT, 'baked': CASE WHEN {_OLD} THEN e.baked ELSE a.baked END, 'since': CASE WHEN {_OLD} THEN e.since ELSE a.since END, 'residual': CASE WHEN {_OLD} THEN 0.0 ELSE e.baked - a.baked END",
)


@query("q_stream_rebaked", f"SELECT user_id, s.bakes AS bakes, s.baked AS baked, round(s.residual, 6) AS residual FROM {_BAKED}")
def stream_rebaked(spark, sf_dir):
    """ST-8: baked anew after three hours, the residual applied in between."""
    return settled(stateful.rebaked(events(spark, sf_dir), 10800.0), ["user_id"]).withColumn("residual", F.round("residual", 6))


_PUSH = f"(a.speed + e.speed * 0.05 - 9.81 * {_DT})"
_HIGH = f"(a.height + {_PUSH} * {_DT})"
_LANDS = f"({_HIGH} <= 0 AND {_PUSH} < 0)"
_FALL = _folded(
    "'height': 0.0::DOUBLE, 'speed': 0.0::DOUBLE, 'landings': 0::BIGINT, 'last': NULL::DOUBLE",
    "'height': 0.0::DOUBLE, 'speed': value, 'landings': 0::BIGINT, 'last': epoch(ts)",
    f"'height': CASE WHEN {_LANDS} THEN 0.0 ELSE {_HIGH} END, 'speed': CASE WHEN {_LANDS} THEN 0.0 ELSE {_PUSH} END, 'landings': a.landings + {_LANDS}::BIGINT, 'last': e.last",
)


@query("q_stream_falling", f"SELECT user_id, round(s.height, 7) AS height, round(s.speed, 7) AS speed, s.landings AS landings FROM {_FALL}")
def stream_falling(spark, sf_dir):
    """ST-12: gravity, pushes and the ground."""
    return settled(stateful.falling(events(spark, sf_dir)), ["user_id"]).select("user_id", F.round("height", 7).alias("height"), F.round("speed", 7).alias("speed"), "landings")


@query("q_stream_observed", "SELECT 0 AS batch, count(*) AS n, max(value) AS peak, min(value) AS low, count(DISTINCT user_id) AS users FROM events")
def stream_observed(spark, sf_dir):
    """ST-1, ST-9, ST-10, SNK-7, SNK-8, X-4, X-5: ordered updates on each batch, metrics on the side, throttled; then what the updates wrote."""
    path = f"{shared_dir(spark)}/updates-{uuid.uuid4().hex}"
    metrics = [F.count(F.lit(1)).alias("n"), F.max("value").alias("peak"), F.min("value").alias("low")]
    write = lambda batch, number: batch.select("user_id").distinct().write.mode("overwrite").parquet(f"{path}/{number}")
    check = lambda batch, number: spark.read.parquet(f"{path}/{number}").limit(1).collect()
    rows = observed(events(spark, sf_dir), "stats", metrics, [write, check])
    users = spark.read.option("recursiveFileLookup", "true").parquet(path).agg(F.count_distinct("user_id").alias("users"))
    shown = spark.createDataFrame([(r["batch"], r["n"], r["peak"], r["low"]) for r in rows], "batch int, n long, peak double, low double")
    # Both sides have a row or a few.
    return shown.join(users, F.lit(True))


@query(
    "q_toroidal_follow",
    """WITH s AS (SELECT user_id, ts, event_id, k, (round_even((value / 4 - k) / 16, 0) * 16 + k)::INTEGER AS cell FROM events, range(16) t(k)), d AS (SELECT *, lag(cell) OVER (PARTITION BY user_id, k ORDER BY ts, event_id) AS was FROM s)
SELECT user_id, count(*) FILTER (was <> cell) AS moved, min(cell) AS first_cell, max(cell) AS last_cell FROM d GROUP BY user_id""",
)
def toroidal_follow(spark, sf_dir):
    """ST-14: a window of sixteen slots that follows a moving key; the slots that take a new cell with each move."""
    slots = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k"))
    cell = (F.rint((F.col("value") / 4 - F.col("k")) / 16) * 16 + F.col("k")).cast("int")
    was = F.lag("cell").over(Window.partitionBy("user_id", "k").orderBy("ts", "event_id"))
    rows = slots.withColumn("cell", cell).withColumn("was", was)
    return rows.groupBy("user_id").agg(F.count_if(F.col("was") != F.col("cell")).alias("moved"), F.min("cell").alias("first_cell"), F.max("cell").alias("last_cell"))
