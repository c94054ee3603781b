"""Structured Streaming forms of the usage report and of the token bucket (watermarks and time-outs are extensions)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usage_daily_stream(events: DataFrame, late: str = "1 day", surface: str = "event_type") -> DataFrame:
    """Calls for each UTC day and surface, as a windowed aggregate with a watermark."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), F.col(surface).alias("surface"))
    return g.agg(F.count("*").alias("calls"), F.sum("value").alias("total_value")).select(F.col("w.start").alias("day"), "surface", "calls", "total_value")


def token_bucket_stream(events: DataFrame, per_minute: float, burst: float, late: str = "1 hour") -> DataFrame:
    """allowed for each call (event_id, user_id, ts), with tokens and last time as keyed state; idle keys are let go."""
    full, rate = float(per_minute + burst), per_minute / 60.0

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        left, last = state.get if state.exists else (full, None)
        calls = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for event_id, ts in zip(calls["event_id"], calls["ts"], strict=True):
            t = ts.timestamp()
            left = min(full, left + (max(0.0, t - last) * rate if last is not None else 0.0))
            last = t
            ok = left >= 1
            left -= ok
            out.append((event_id, key[0], ok))
        state.update((left, last))
        idle = max(300.0, (full - left) / rate if rate else 300.0)  # by then the bucket is full again, as a new one is
        state.setTimeoutTimestamp(max(int((last + idle) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["event_id", "user_id", "allowed"])

    calls = events.select("event_id", "user_id", "ts").withWatermark("ts", late)
    return calls.groupBy("user_id").applyInPandasWithState(step, "event_id long, user_id long, allowed boolean", "left double, last double", "append", "EventTimeTimeout")
