"""Recurrences that never forget, as streams: each key's state is carried, its rows are folded in order.

A step takes the state and a value and gives the new state; states are plain tuples of doubles.
Only the rows of one micro-batch of a key are sorted at a time, so a key with very many rows is no burden.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Step = Callable[[tuple, float], tuple]


def pid(setpoint: float = 0.7, kp: float = 0.3, ki: float = 0.05, kd: float = 0.1, most: float = 10.0) -> tuple[tuple, Step]:
    """``integral, error, output``: a controller whose integral and output are clamped; no derivative at first."""

    def step(state: tuple, value: float) -> tuple:
        integral, last, _ = state
        error = setpoint - value
        integral = max(-most, min(most, integral + error))
        slope = 0.0 if math.isnan(last) else error - last
        return integral, error, max(-1.0, min(1.0, kp * error + ki * integral + kd * slope))

    return (0.0, math.nan, 0.0), step


def temperature(scale: float = 0.1, decay: float = 0.995) -> tuple[tuple, Step]:
    """``scale, value``: a magnitude over a running maximum that fades slowly, squashed to [0, 1)."""

    def step(state: tuple, value: float) -> tuple:
        top = max(0.001, state[0] * decay, value)
        return top, 2 / (1 + math.exp(-2 * value / top)) - 1

    return (max(0.001, scale), 0.0), step


def change_rate(alpha: float = 0.2) -> tuple[tuple, Step]:
    """``last, rate, n``: the exponential average of first differences; the first difference seeds it."""

    def step(state: tuple, value: float) -> tuple:
        last, rate, n = state
        if n > 0:
            rate = value - last if n == 1 else alpha * (value - last) + (1 - alpha) * rate
        return value, rate, n + 1

    return (0.0, 0.0, 0.0), step


def feedback_rate(up: float = 0.05, down: float = 0.20) -> tuple[tuple, Step]:
    """``rate, knew, novel``: knowing it already (value above 0) nudges up, news pulls down; bounded to [0.05, 0.95]."""

    def step(state: tuple, value: float) -> tuple:
        rate, knew, novel = state
        rate += up * (0.95 - rate) if value > 0 else down * (0.05 - rate)
        return max(0.05, min(0.95, rate)), knew + (value > 0), novel + (value <= 0)

    return (0.5, 0.0, 0.0), step


def stability(low: float = 0.8, high: float = 1.2, margin: float = 0.05, alpha: float = 0.3) -> tuple[tuple, Step]:
    """``smoothed, status``: -1 rigid, 0 healthy, 1 unstable, by a smoothed value that must pass a border by a margin to change it."""

    def step(state: tuple, value: float) -> tuple:
        smoothed = value if math.isnan(state[0]) else alpha * value + (1 - alpha) * state[0]
        plain = 1.0 if smoothed > high else -1.0 if smoothed < low else 0.0
        was = state[1]
        if math.isnan(was):
            return smoothed, plain
        stays = {0.0: low - margin <= smoothed <= high + margin, 1.0: smoothed >= high - margin, -1.0: smoothed <= low + margin}[was]
        return smoothed, was if stays else plain

    return (math.nan, math.nan), step


def fold_stream(events: DataFrame, key: str, order: list[str], value: str, names: list[str], start: tuple, step: Step) -> DataFrame:
    """``key, n, <names>``: the state of every key after each micro-batch; null keys and values are skipped."""

    def fold(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *now, n = state.get if state.exists else (*start, 0)
        now = tuple(now)
        for v in pd.concat(list(frames)).sort_values([*order, value], kind="stable")[value]:
            now, n = step(now, float(v)), n + 1
        state.update((*now, n))
        yield pd.DataFrame({key: [keys[0]], "n": [n], **{c: [float(x)] for c, x in zip(names, now)}})

    kind = dict(events.dtypes)[key]
    fields = ", ".join(f"{c} double" for c in names)
    rows = events.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key, *order, F.col(value).cast("double").alias(value))
    return rows.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, n long, {fields}", f"{fields}, n long", "update", GroupStateTimeout.NoTimeout)
