"""The indexing watchdog as a stream: keyed state, event time, timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STUCK_MS, STALE_MS = 300_000, 90_000


class Watchdog(StatefulProcessor):
    """A paper that began to be indexed over STUCK_MS ago and whose last sign of life is over STALE_MS old is promoted.

    Rows wait until the watermark has passed them, so that they are taken in the order of their times, late ones too;
    a timer stands at the earliest waiting row and at the time when the paper would be stuck.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, event_id long, status string")
        self.indexing = handle.getValueState("indexing", "started long, heartbeat long")

    def _advance(self, paper: int, upto: int) -> Iterator[pd.DataFrame]:
        """Take what lies at or before `upto`; then set the timer anew."""
        rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        now = tuple(self.indexing.get()) if self.indexing.exists() else None
        out, kept = [], []

        def promote(before: int) -> None:
            nonlocal now
            if now is not None and (due := max(now[0] + STUCK_MS, now[1] + STALE_MS)) < before:
                out.append((paper, now[0], now[1], due))
                now = None

        for ms, event, status in rows:
            if ms > upto:
                kept.append((ms, event, status))
                continue
            promote(ms)
            if status == "indexing":
                now = (now[0] if now else ms, ms)
            else:
                now = None
        promote(upto)
        self.waiting.put(kept) if kept else self.waiting.clear()
        self.indexing.update(now) if now else self.indexing.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = [kept[0][0]] if kept else []
        due += [max(now[0] + STUCK_MS, now[1] + STALE_MS) + 1] if now else []
        if due:
            self.handle.registerTimer(max(min(due), upto + 1))
        frame = pd.DataFrame(out, columns=["paper_id", "started", "heartbeat", "due"])
        for c in ("started", "heartbeat", "due"):
            frame[c] = pd.to_datetime(frame[c].astype("int64"), unit="ms", utc=True)
        yield frame

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            self.waiting.appendList([(int(r.ms), int(r.event_id), r.status) for r in frame.itertuples(index=False)])
        yield from self._advance(key[0], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key[0], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def stuck_indexing(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """paper_id, started, heartbeat, due of each promotion, for streaming events (event_id, paper_id, status, ts). An indexing event
    of a paper that is being indexed is a heartbeat; any other status ends indexing; rows later than `late` are dropped."""
    rows = events.select("event_id", "paper_id", "status", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    return rows.groupBy("paper_id").transformWithStateInPandas(Watchdog(), "paper_id long, started timestamp, heartbeat timestamp, due timestamp", "Append", "EventTime")
