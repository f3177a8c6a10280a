"""Streaming forms of batch operators (T1-T5). Each takes and returns a streaming DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from padlens.operators.detectors import scored as batch_scored
from padlens.operators.gestures import CANCEL, DOWN, UP

CONTACT = "user_id long, act_id long, start_ms long, end_ms long, n_frames long, state string"
#: How long after its last frame an open contact is given up.
IDLE_MS = 600_000
_BIT = {DOWN: 1, UP: 2, CANCEL: 4}
#: The state store that processors with several states need.
STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ContactProcessor(StatefulProcessor):
    """Contacts of one (user, activity): frames wait in a map until the watermark has passed them, the open contact is a value of
    its own, and one event-time timer stands for the next frame or for the end of the contact's patience.

    So a batch reads and writes the frames that it adds or handles, not all that wait.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start_ms long, end_ms long, n_frames long")
        self.waiting = handle.getMapState("waiting", "t long", "bits int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, int] = {}
        for batch in rows:
            for t, code in zip(batch["evt_t"].tolist(), batch["code"].tolist()):
                new[t] = new.get(t, 0) | _BIT.get(code, 0)
        for t, bits in new.items():
            known = self.waiting.getValue((t,))
            self.waiting.updateValue((t,), (bits | (known[0] if known else 0),))
        yield self.advance(key, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.advance(key, timerValues)

    def advance(self, key: tuple, timers: TimerValues) -> pd.DataFrame:
        """Handles the frames below the watermark in order of time, as no earlier row can come any more."""
        mark, out = timers.getCurrentWatermarkInMs(), []
        waiting = {int(t[0]): int(bits[0]) for t, bits in self.waiting.iterator()}
        start, end, n = map(int, self.open.get()) if self.open.exists() else (-1, -1, 0)
        for t in sorted(t for t in waiting if t < mark):
            bits = waiting.pop(t)
            self.waiting.removeKey((t,))
            if start >= 0 and t - end >= IDLE_MS:
                out.append((*key, start, end, n, "eof"))
                start = -1
            if bits & _BIT[DOWN]:
                if start >= 0:
                    out.append((*key, start, end, n, "restarted"))
                start, n = t, 0
            if start < 0:
                continue
            end, n = t, n + 1
            if bits & (_BIT[UP] | _BIT[CANCEL]):
                out.append((*key, start, end, n, "cancelled" if bits & _BIT[CANCEL] else "complete"))
                start = -1
        if start >= 0 and mark > end + IDLE_MS:
            out.append((*key, start, end, n, "eof"))
            start = -1
        if start >= 0:
            self.open.update((start, end, n))
        elif self.open.exists():
            self.open.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = [*waiting, *([end + IDLE_MS] if start >= 0 else [])]
        if due:
            self.handle.registerTimer(max(mark, min(due)) + 1)
        return pd.DataFrame(out, columns=["user_id", "act_id", "start_ms", "end_ms", "n_frames", "state"])

    def close(self) -> None:
        pass


def contacts(touch: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Contacts as they close. touch(user_id, act_id, evt_t ms, code, ts).

    Rows may come late by up to the delay, in any order and in any batch: frames wait in the state until the watermark has
    passed them and are then handled in order of their time, so the contacts are those of the batch form. An open contact
    without a frame for IDLE_MS ends as eof. State is three numbers a key and the frames of the last `delay`. Sets the
    session's state store to the one that such processors need.
    """
    touch.sparkSession.conf.set(*STORE)
    rows = touch.withWatermark("ts", delay).select("user_id", "act_id", "evt_t", "code", "ts")
    return rows.groupBy("user_id", "act_id").transformWithStateInPandas(ContactProcessor(), CONTACT, "append", "eventTime")


def occupancy(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events of each user in tumbling windows."""
    return events.withWatermark("ts", delay).groupBy("user_id", F.window("ts", width)).agg(F.count("*").alias("n")).select("user_id", F.col("window.start").alias("start"), "n")


def gap_sessions(events: DataFrame, gap: str = "120 seconds", delay: str = "10 minutes") -> DataFrame:
    """Sessions that end after a gap."""
    return events.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def caught_alarm(events: DataFrame, thresholds: DataFrame, least: int, width: str = "6 hours", slide: str = "3 hours", delay: str = "10 minutes") -> DataFrame:
    """T4: sliding count of scores at or over their action's static threshold; windows with `least` or more."""
    caught = events.join(F.broadcast(thresholds), "action").filter("score >= cut").withWatermark("ts", delay)
    counted = caught.groupBy("user_id", F.window("ts", width, slide)).agg(F.count("*").alias("caught"))
    return counted.filter(F.col("caught") >= least).select("user_id", F.col("window.start").alias("start"), "caught")


def scored(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """T5: a fitted detector's scores on a stream."""
    return batch_scored(model, rows)
