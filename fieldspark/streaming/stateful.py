"""Keyed state functions; each works on batches in any split and ends in the same state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _ordered(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(parts)).sort_values(["ts", "event_id"])


def ema(events: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(user_id, ema, n): a feedback mean that the first value seeds; zero means unset."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState):
        mean, n = state.get if state.exists else (0.0, 0)
        for value in _ordered(parts).value:
            mean, n = (float(value) if mean == 0 else mean * (1 - alpha) + value * alpha), n + 1
        state.update((mean, n))
        yield pd.DataFrame({"user_id": [key[0]], "ema": [mean], "n": [n]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, ema double, n long", "ema double, n long", "update", GroupStateTimeout.NoTimeout)


def ttl(events: DataFrame, seconds: float) -> DataFrame:
    """(user_id, lives, age, rows): an entity is born again when it was not seen for longer than its time to live."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState):
        born, seen, lives, rows = state.get if state.exists else (0.0, -1e18, 0, 0)
        for ts in _ordered(parts).ts:
            at = pd.Timestamp(ts).timestamp()
            if at - seen > seconds:
                born, lives = at, lives + 1
            seen, rows = at, rows + 1
        state.update((born, seen, lives, rows))
        yield pd.DataFrame({"user_id": [key[0]], "lives": [lives], "age": [seen - born], "rows": [rows]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, lives long, age double, rows long", "born double, seen double, lives long, rows long", "update", GroupStateTimeout.NoTimeout)


def cached(events: DataFrame, periods: tuple[int, ...] = (1, 2, 3, 6), phases: tuple[int, ...] = (0, 1, 2, 5), drift: float = 0.04, span: float = 100.0) -> DataFrame:
    """(user_id, frames, refreshes, held): a cached value, renewed on schedule or when the input has drifted too far."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState):
        frames, refreshes, held = state.get if state.exists else (0, 0, float("nan"))
        slot = int(key[0]) % len(periods)
        for value in _ordered(parts).value:
            due = (frames + phases[slot]) % periods[slot] == 0
            if held != held or due or abs(value - held) >= span * drift:
                held, refreshes = float(value), refreshes + 1
            frames += 1
        state.update((frames, refreshes, held))
        yield pd.DataFrame({"user_id": [key[0]], "frames": [frames], "refreshes": [refreshes], "held": [held]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, frames long, refreshes long, held double", "frames long, refreshes long, held double", "update", GroupStateTimeout.NoTimeout)


def moved(events: DataFrame, distance: float = 20.0) -> DataFrame:
    """(user_id, rebuilds, place): rebuilt only after a move of `distance` since the last rebuild."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState):
        rebuilds, place = state.get if state.exists else (0, float("inf"))
        for value in _ordered(parts).value:
            if abs(value - place) >= distance:
                rebuilds, place = rebuilds + 1, float(value)
        state.update((rebuilds, place))
        yield pd.DataFrame({"user_id": [key[0]], "rebuilds": [rebuilds], "place": [place]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, rebuilds long, place double", "rebuilds long, place double", "update", GroupStateTimeout.NoTimeout)


def damped(events: DataFrame, stiffness: float = 40.0, damping: float = 0.85, most_dt: float = 0.1) -> DataFrame:
    """(user_id, x, v): a damped spring that follows the values; the time step is clamped to 0 .. most_dt."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState):
        x, v, last = state.get if state.exists else (0.0, 0.0, float("nan"))
        for row in _ordered(parts).itertuples():
            at = pd.Timestamp(row.ts).timestamp()
            dt = 0.0 if last != last else min(max(at - last, 0.0), most_dt)
            v = (v + (row.value - x) * stiffness * dt) * damping**(dt / most_dt)
            x, last = x + v * dt, at
        state.update((x, v, last))
        yield pd.DataFrame({"user_id": [key[0]], "x": [x], "v": [v]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, x double, v double", "x double, v double, last double", "update", GroupStateTimeout.NoTimeout)


def rebaked(events: DataFrame, seconds: float) -> DataFrame:
    """(user_id, bakes, baked, residual): a value baked anew only after `seconds`; between bakes what it is off by is applied."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState):
        bakes, baked, since, residual = state.get if state.exists else (0, 0.0, -1e18, 0.0)
        for row in _ordered(parts).itertuples():
            at = pd.Timestamp(row.ts).timestamp()
            if at - since > seconds:
                bakes, baked, since = bakes + 1, float(row.value), at
            residual = float(row.value) - baked
        state.update((bakes, baked, since, residual))
        yield pd.DataFrame({"user_id": [key[0]], "bakes": [bakes], "baked": [baked], "residual": [residual]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, bakes long, baked double, residual double", "bakes long, baked double, since double, residual double", "update", GroupStateTimeout.NoTimeout)


def falling(events: DataFrame, gravity: float = 9.81, lift: float = 0.05, most_dt: float = 0.1) -> DataFrame:
    """(user_id, height, speed, landings): a body that each row pushes up, that falls, and that the ground stops."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState):
        height, speed, landings, last = state.get if state.exists else (0.0, 0.0, 0, float("nan"))
        for row in _ordered(parts).itertuples():
            at = pd.Timestamp(row.ts).timestamp()
            dt = 0.0 if last != last else min(max(at - last, 0.0), most_dt)
            # Pushed first, then pulled: the order of the sums decides the last bits, which add up.
            speed = speed + row.value * lift - gravity * dt
            height += speed * dt
            if height <= 0 and speed < 0:
                height, speed, landings = 0.0, 0.0, landings + 1
            last = at
        state.update((height, speed, landings, last))
        yield pd.DataFrame({"user_id": [key[0]], "height": [height], "speed": [speed], "landings": [landings]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, height double, speed double, landings long", "height double, speed double, landings long, last double", "update", GroupStateTimeout.NoTimeout)
