"""A stateful operator whose timers end its state; it needs Spark's RocksDB state store, see ``rocksdb``."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corvane.runtime import ship
from corvane.streaming.events import event_time

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams started within use the state store that timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def split_sessions(times: list[int], gap: int) -> list[list[int]]:
    """Sorted times, cut where one is ``gap`` or more after the one before."""
    out: list[list[int]] = []
    for t in sorted(times):
        if out and t - out[-1][-1] < gap:
            out[-1].append(t)
        else:
            out.append([t])
    return out


def merge_sessions(sessions: np.ndarray, gap: int) -> np.ndarray:
    """Rows (key, first, last, n) in any order: those of a key nearer than ``gap`` joined, by key and time; an event is (key, time, time, 1).

    Joined from events this is ``split_sessions`` of each key, however often and in whatever order parts of it were joined before.
    """
    sessions = sessions[np.lexsort((sessions[:, 1], sessions[:, 0]))]
    key, first, last, n = sessions.T
    # The latest end so far of each key, by the ends' ranks, as times of any size times keys could overflow.
    ends, rank = np.unique(last, return_inverse=True)
    reach = ends[np.maximum.accumulate(key * len(ends) + rank) - key * len(ends)]
    start = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (first[1:] - reach[:-1] >= gap)))
    return np.column_stack((key[start], first[start], np.maximum.reduceat(last, start), np.add.reduceat(n, start)))


class _Sessions(StatefulProcessor):
    """Keeps the open sessions of a group's keys in one value: the keys, and rows (place of the key, first, last, n) as bytes of longs.

    Every call on state is a message to the JVM and every element of a list is
    packed on its own, so a group has one value and, at the end of its first open session, one timer.
    """

    def __init__(self, by: str, gap_ms: int):
        self.by, self.gap = by, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getValueState("times", "keys array<string>, sessions binary")

    def _open(self) -> tuple[list, np.ndarray]:
        keys, sessions = self.times.get() or ([], b"")
        return list(keys), np.frombuffer(sessions, dtype=np.int64).reshape(-1, 4)

    def _due(self, sessions: np.ndarray) -> int:
        return int(sessions[:, 2].min()) + self.gap

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        keys, before = self._open()
        sessions, place = before, {k: i for i, k in enumerate(keys)}
        for frame in rows:
            at = np.array([place.setdefault(k if isinstance(k, str) else None, len(place)) for k in frame["key_text"].tolist()], dtype=np.int64)
            ms = frame["event_ms"].to_numpy(dtype=np.int64)
            sessions = merge_sessions(np.concatenate((sessions, np.column_stack((at, ms, ms, np.ones_like(ms))))), self.gap)
        self.times.update((list(place), sessions.tobytes()))
        if not len(before):
            self.handle.registerTimer(self._due(sessions))
        elif self._due(before) != self._due(sessions):
            self.handle.deleteTimer(self._due(before))
            self.handle.registerTimer(self._due(sessions))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        keys, sessions = self._open()
        past = sessions[:, 2] + self.gap <= timerValues.getCurrentWatermarkInMs()
        closed, rest = sessions[past], sessions[~past]
        if len(rest):
            held, at = np.unique(rest[:, 0], return_inverse=True)
            self.times.update(([keys[i] for i in held.tolist()], np.column_stack((at, rest[:, 1:])).tobytes()))
            self.handle.registerTimer(self._due(rest))
        else:
            self.times.clear()
        if len(closed):
            yield pd.DataFrame({self.by: [keys[i] for i in closed[:, 0].tolist()], "first_ms": closed[:, 1], "last_ms": closed[:, 2], "n": closed[:, 3]})

    def close(self) -> None:
        pass


def closed_sessions(events: DataFrame, by: str, gap_seconds: int, late: str, time: str = "ts", buckets: int | None = None) -> DataFrame:
    """(by, first_ms, last_ms, n): a key's sessions, each once, when the watermark has passed its last event by the gap.

    Events may come in any order within ``late``. A timer goes off at each
    session's end: it emits the session and drops it, so a key without
    open sessions has no state, and an open one is three numbers. Sessions that the stream's end leaves open aren't emitted.
    Rows with a null time are left out.

    buckets: keys share this many states by their hash, for keys so many that
    the calls on their states would take most of the time; the rows are the same.
    Keys are held as text, of which their type must be castable and back.
    """
    ship(events.sparkSession)
    kind = events.schema[by].dataType.simpleString()
    timed = event_time(events, time).where(F.col(time).isNotNull()).withWatermark(time, late)
    group = F.col(by) if buckets is None else F.pmod(F.xxhash64(by), F.lit(buckets)).alias("bucket")
    timed = timed.select(group, time, F.unix_millis(time).alias("event_ms"), F.col(by).cast("string").alias("key_text"))
    closed = timed.groupBy(timed.columns[0]).transformWithStateInPandas(_Sessions(by, gap_seconds * 1000), f"`{by}` string, first_ms long, last_ms long, n long", "append", "EventTime")
    return closed.withColumn(by, F.col(by).cast(kind))
