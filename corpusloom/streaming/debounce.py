"""Latest event in a window, on a stream.

Events wait in state until the watermark has passed them, and are then taken in the order of
(ts, event_id). So the result does not depend on the order of arrival, as long as rows are not
later than the watermark allows. A null key is a key of its own. A row that comes after the watermark has passed its time can change
nothing any more; it is handed out at once, marked as late and without a time to act.

Users share state by groups, so that calls to the state grow with groups and batches, not with users or events. Events
wait in chunks of packed numbers under their first time: a timer reads those that are due, and leaves later ones alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "user_id bigint, event_id bigint, ts timestamp, fire timestamp, late boolean"
#: Groups of users. The newest event of every user of a group is rewritten when an event of the group is due.
GROUPS = 1024
#: Events of a chunk at most.
CHUNK_EVENTS = 16_384
#: Rows of the tables in state: a waiting event, and the newest event taken of a user. ``none`` is 1 for a null user;
#: ``open`` is 1 until the event has been emitted or given up.
_WAITING = ("none", "user", "ts", "event_id")
_NEWEST = (*_WAITING, "fire", "open")


class _LatestInWindow(StatefulProcessor):
    def __init__(self, window_us: int):
        self.window_us = window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "first bigint, chunk bigint", "events binary")
        # the newest event taken so far of every user
        self.newest = handle.getValueState("newest", "users binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        wakes = []
        for frame in rows:
            events = _events(frame)
            late = events[2] <= passed if passed > 0 else np.zeros(events.shape[1], bool)
            if late.any():
                yield _frame(events[:, late])
            wakes += self._wait(events[:, ~late])
        if wakes:
            self._wake_at(min(wakes))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        acting = self._advance(timerValues.getCurrentWatermarkInMs() * 1000)
        if acting.shape[1]:
            yield _frame(acting[:4], acting[4])

    def close(self) -> None:
        pass

    def _wake_at(self, ts_us: int) -> None:
        self.handle.registerTimer(ts_us // 1000 + 1)

    def _wait(self, events: np.ndarray) -> list[int]:
        """Put events into state, in chunks by time; gives the first time of every chunk."""
        events = events[:, np.argsort(events[2], kind="stable")]
        chunks = [events[:, at : at + CHUNK_EVENTS] for at in range(0, events.shape[1], CHUNK_EVENTS)]
        firsts = [int(chunk[2, 0]) for chunk in chunks]
        for first, chunk in zip(firsts, chunks, strict=True):
            self.waiting.updateValue((first, uuid.uuid4().int >> 65), (chunk.tobytes(),))
        return firsts

    def _advance(self, watermark: int) -> np.ndarray:
        chunks = [tuple(key) for key in self.waiting.keys()]
        due = [key for key in chunks if key[0] <= watermark]
        parts = [np.empty((len(_WAITING), 0), np.int64)]
        for key in due:
            parts.append(_unpacked(self.waiting.getValue(key)[0], len(_WAITING)))
            self.waiting.removeKey(key)
        events = np.concatenate(parts, axis=1)
        passed = events[2] <= watermark
        wakes = [first for first, _ in chunks if first > watermark] + self._wait(events[:, ~passed])
        stored = _unpacked(self.newest.get()[0] if self.newest.exists() else b"", len(_NEWEST))
        acting, newest = _decided(stored, events[:, passed], self.window_us, watermark)
        if passed.any() or acting.shape[1]:
            self.newest.update((newest.tobytes(),))
        wakes += newest[4, newest[5] == 1].tolist()
        if wakes:
            self._wake_at(min(wakes))
        return acting


def _events(frame: pd.DataFrame) -> np.ndarray:
    columns = frame[["none", "user", "us", "event_id"]]
    if columns.isna().any(axis=None):
        raise ValueError("an event has no time or no id")
    return columns.to_numpy(np.int64).T


def _unpacked(packed: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(packed, np.int64).reshape(rows, -1)


def _decided(newest: np.ndarray, due: np.ndarray, window: int, watermark: int) -> tuple[np.ndarray, np.ndarray]:
    """(events that act, the newest event of every user) once ``due``, all up to the watermark, are taken after ``newest``."""
    rows = np.hstack([newest, np.vstack([due, np.zeros((2, due.shape[1]), np.int64)])])
    fresh = np.arange(rows.shape[1]) >= newest.shape[1]
    order = np.lexsort((rows[3], rows[2], fresh, rows[1], rows[0]))
    rows, fresh = rows[:, order], fresh[order]
    none, user, ts, event_id, fire, open_ = rows
    follows = np.zeros(len(ts) + 1, bool)
    follows[1:-1] = (none[1:] == none[:-1]) & (user[1:] == user[:-1])
    first, last = ~follows[:-1], ~follows[1:]
    # An event waits for the window of the one before it, the first of a user for its own.
    fire = np.where(fresh, np.where(first, ts + window, np.maximum(ts, np.roll(ts, 1) + window)), fire)
    at_once = fresh & (fire == ts)
    open_ = np.where(fresh, ~at_once, open_ == 1)
    passed = fire <= watermark
    # One that waits acts when nothing has come up to its time.
    acts = at_once | (open_ & np.where(last, passed, np.roll(ts, -1) > fire))
    rows = np.stack([none, user, ts, event_id, fire, open_ & ~passed])
    return rows[:5, acts], rows[:, last]


def _frame(events: np.ndarray, fire: np.ndarray | None = None) -> pd.DataFrame:
    none, user, ts, event_id = events
    return pd.DataFrame(
        {
            "user_id": pd.Series(user, dtype="Int64").mask(none == 1),
            "event_id": event_id,
            "ts": pd.to_datetime(pd.Series(ts), unit="us"),
            "fire": pd.to_datetime(pd.Series([None] * len(ts) if fire is None else fire, dtype="Int64"), unit="us"),
            "late": fire is None,
        }
    )


def latest_in_window_stream(
    events: DataFrame, window_ms: int = 500, lateness: str = "10 seconds", key: str = "user_id", groups: int = GROUPS
) -> DataFrame:
    """(user_id, event_id, ts, fire, late) from a stream of (user_id, event_id, ts).

    The stream form of :func:`corpusloom.operators.timeline.latest_in_window`. ``groups`` may not change while a
    checkpoint is in use.
    """
    stamped = events.select(
        F.col(key).cast("bigint").alias("user_id"), "event_id", F.col("ts").cast("timestamp").alias("ts")
    )
    watched = stamped.withColumn("us", F.unix_micros("ts")).withWatermark("ts", lateness)
    # Without nulls, whole numbers stay whole in pandas.
    grouped = watched.select(
        F.pmod(F.xxhash64("user_id"), F.lit(groups)).cast("int").alias("users"),
        F.isnull("user_id").cast("bigint").alias("none"), F.coalesce("user_id", F.lit(0)).alias("user"),
        "ts", "us", "event_id",
    )
    return grouped.groupBy("users").transformWithStateInPandas(
        _LatestInWindow(window_ms * 1000), OUTPUT, "append", "EventTime"
    )
