"""Structured Streaming: windowed counts with a watermark, and a CUSUM whose state lives with its key."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.operators.series import cusum_step

ALARM = "key string, at timestamp, side string, sum double"
STATE = "up double, down double"


def windowed(events: DataFrame, width: str, late: str, when: str = "ts", key: str = "event_type", value: str = "value", slide: str | None = None) -> DataFrame:
    """Counts, sums and extremes by window and key; works on a stream and on a batch alike."""
    window = F.window(when, width, slide) if slide else F.window(when, width)
    return events.withWatermark(when, late).groupBy(window.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("high")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total", "high")


def sessions(events: DataFrame, gap: str, late: str, when: str = "ts", key: str = "user_id") -> DataFrame:
    return events.withWatermark(when, late).groupBy(F.session_window(when, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def cusum_alarms(events: DataFrame, target: float, scale: float = 1.0, k: float = 0.5, h: float = 5.0, when: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """Alarms of a two-sided CUSUM by key; the side that alarms starts anew, the other goes on. State: two numbers a key. Null values
    are passed over."""

    def step(name: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sums = state.get if state.exists else (0.0, 0.0)
        rows = pd.concat(list(frames))
        out = []
        for at, x in rows.sort_values("at")[["at", "value"]].itertuples(index=False):
            if x == x:
                sums, alarms = cusum_step(sums, (x - target) / scale, k, h)
                out += [(name[0], at, side, top) for side, top in alarms]
        state.update(sums)
        yield pd.DataFrame(out, columns=["key", "at", "side", "sum"])

    rows = events.select(F.col(key).cast("string").alias("key"), F.col(when).cast("timestamp").alias("at"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("key").applyInPandasWithState(step, ALARM, STATE, "append", GroupStateTimeout.NoTimeout)
