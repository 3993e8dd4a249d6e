"""Frames put in order as they come: a missing one is waited for, then held over, and dropped if it comes after.

State and event-time timers are the stream's own (``transformWithState``): of each stream the next frame to give, the last
value given and the frames that came early. Nothing is kept of what was given.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "user_id long, frame long, q long, status string"


class Jitter(StatefulProcessor):
    """Gives frames from 0 on in order, each once: ``ok`` as they came, ``held`` (the last value) where one did not come
    before the watermark passed the earliest one after it, ``late`` (and not given again) where one came after that."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "next long, last long")
        self.early = handle.getMapState("early", "frame long", "q long, ms long")

    def _state(self) -> tuple[int, int, dict[int, tuple[int, int]]]:
        now, last = self.at.get() if self.at.exists() else (0, 0)
        return now, last, {k[0]: (v[0], v[1]) for k, v in self.early.iterator()} if self.early.exists() else {}

    def _give(self, user: int, now: int, last: int, early: dict[int, tuple[int, int]], due: int | None) -> tuple[list[tuple], int, int]:
        """What can be given; ``due``: the event time up to which missing frames are no longer waited for."""
        out = []
        while early:
            if now in early:
                last = early.pop(now)[0]
                out.append((user, now, last, "ok"))
            elif due is not None and min(ms for _, ms in early.values()) <= due:
                out.append((user, now, last, "held"))
            else:
                break
            now += 1
        return out, now, last

    def _keep(self, before: dict[int, Any], now: int, last: int, early: dict[int, tuple[int, int]]) -> None:
        self.at.update((now, last))
        for frame in before.keys() - early.keys():
            self.early.removeKey((frame,))
        for frame in early.keys() - before.keys():
            self.early.updateValue((frame,), early[frame])
        if early:
            self.handle.registerTimer(min(ms for _, ms in early.values()))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now, last, early = self._state()
        before, out = dict(early), []
        for batch in rows:
            for frame, q, ms in zip(batch["frame"].tolist(), batch["q"].tolist(), batch["ms"].tolist(), strict=True):
                if frame < now:
                    out.append((key[0], frame, q, "late"))
                else:
                    early.setdefault(frame, (q, ms))
        given, now, last = self._give(key[0], now, last, early, None)
        self._keep(before, now, last, early)
        yield pd.DataFrame(out + given, columns=[c.split()[0] for c in OUT.split(", ")])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now, last, early = self._state()
        before = dict(early)
        given, now, last = self._give(key[0], now, last, early, expiredTimerInfo.getExpiryTimeInMs())
        self._keep(before, now, last, early)
        yield pd.DataFrame(given, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, wait: str = "2 seconds") -> DataFrame:
    """``user_id, frame, q, status`` of the streaming ``stream`` (user_id, frame, ts, q), as ``Jitter`` says.

    A frame is waited for until an event is ``wait`` after the earliest frame that came instead: the watermark is that far
    behind, and what is older than it Spark leaves out. Of a frame that comes twice in time the first counts. Rows with
    nulls are left out.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    whole = stream.where("user_id is not null and frame is not null and ts is not null and q is not null")
    timed = whole.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", wait)
    rows = timed.select("user_id", "frame", "q", "ts", F.expr("unix_millis(ts)").alias("ms"))
    return rows.groupBy("user_id").transformWithStateInPandas(Jitter(), OUT, "Append", "EventTime")
