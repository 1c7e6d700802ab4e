"""Streams against plain replays of the same rows, in one batch and in many."""

import duckdb
import numpy as np
import pandas as pd

from fieldspark.plans import registry
from fieldspark.streaming import stateful
from fieldspark.streaming.run import settled, source


def replay(table, periods=(1, 2, 3, 6), phases=(0, 1, 2, 5)):
    out = {}
    for user, own in table.sort_values(["ts", "event_id"]).groupby("user_id"):
        refreshes, held = 0, None
        for frame, value in enumerate(own.value):
            slot = user % 4
            if held is None or (frame + phases[slot]) % periods[slot] == 0 or abs(value - held) >= 4.0:
                held, refreshes = value, refreshes + 1
        out[user] = (len(own), refreshes, held)
    return out


def test_cached_in_many_batches(spark, tmp_path):
    table = pd.read_parquet("/root/testdata/sf0.001/events.parquet").sort_values(["ts", "event_id"])
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    step = -(-len(table) // 5)
    for k in range(5):
        table.iloc[k * step : (k + 1) * step].to_parquet(folder / f"part-{k}.parquet")
    stream = spark.readStream.schema(spark.read.parquet(str(folder)).schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    found = settled(stateful.cached(stream), ["user_id"]).collect()
    assert {r.user_id: (r.frames, r.refreshes, r.held) for r in found} == replay(table)


def test_cached_in_one_batch(spark):
    table = pd.read_parquet("/root/testdata/sf0.001/events.parquet")
    found = settled(stateful.cached(source(spark, "/root/testdata/sf0.001", "events")), ["user_id"]).collect()
    assert {r.user_id: (r.frames, r.refreshes, r.held) for r in found} == replay(table)


def test_falling_keeps_the_last_digits_over_many_rows(spark, tmp_path):
    rng, n = np.random.default_rng(5), 60_000
    at = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.cumsum(rng.integers(1, 10**5, n)), unit="us")
    table = pd.DataFrame({"event_id": np.arange(n), "ts": at.astype("datetime64[us]"), "user_id": np.arange(n) % 4, "event_type": "click", "value": rng.gamma(2.0, 25.0, n).round(2)})
    table.to_parquet(tmp_path / "events.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = sorted(db.sql(registry.ORACLES["q_stream_falling"]).fetchall())
    assert sorted(map(tuple, registry.QUERIES["q_stream_falling"](spark, str(tmp_path)).collect())) == want
