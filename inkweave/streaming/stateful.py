"""Structured Streaming operators; each has a batch twin in the registered queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per tumbling event-time window and type, late rows dropped at the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def newest_generation(writes: DataFrame) -> DataFrame:
    """Writes (key, generation, value) of a generation older than one seen before are dropped."""

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else -(2**62)
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                if r.generation >= seen:
                    seen = r.generation
                    rows.append(r)
            yield pd.DataFrame(rows, columns=frame.columns)
        state.update((int(seen),))

    return writes.select("key", "generation", "value").groupBy("key").applyInPandasWithState(keep, "key long, generation long, value double", "seen long", "append", "NoTimeout")


def admitted(requests: DataFrame, per_minute: float = 60.0, burst: float = 10.0) -> DataFrame:
    """T10, token bucket per key: requests (key, ts, tokens) with admitted; tokens refill linearly up to `burst`."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        level, last, out = burst, None, []
        group = group.sort_values(["ts", "tokens"])
        for ts, tokens in zip(group["ts"], group["tokens"], strict=True):
            level = min(burst, level + (0 if last is None else (ts - last).total_seconds() * per_minute / 60))
            last = ts
            out.append(tokens <= level)
            level -= tokens if out[-1] else 0
        return group.assign(admitted=out)

    return requests.select("key", "ts", "tokens").groupBy("key").applyInPandas(fold, "key long, ts timestamp, tokens double, admitted boolean")


def breaker(calls: DataFrame, cool: float = 30.0) -> DataFrame:
    """T11, circuit breaker per key: calls (key, ts, ok) with the state each call meets: closed, open or half_open."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        failed, out = None, []
        group = group.sort_values("ts")
        for ts, ok in zip(group["ts"], group["ok"], strict=True):
            state = "closed" if failed is None else "half_open" if (ts - failed).total_seconds() >= cool else "open"
            out.append(state)
            if state != "open":
                failed = None if ok else ts
        return group.assign(state=out)

    return calls.select("key", "ts", "ok").groupBy("key").applyInPandas(fold, "key long, ts timestamp, ok boolean, state string")
