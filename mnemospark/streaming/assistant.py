"""Streams of assistant turns and captures, with timers in state: they tell and forget without a further event.

State lives in RocksDB: set spark.sql.streaming.stateStore.providerClass (``ROCKSDB``) on the session.
Rows of a session must come in order but for what one batch holds; rows later than the watermark take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mnemospark.operators import assistant as A

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(spark: SparkSession) -> SparkSession:
    """The session, with the state store that timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


def _rearm(handle: StatefulProcessorHandle, at: int) -> None:
    """One timer a key."""
    for t in list(handle.listTimers()):
        handle.deleteTimer(t)
    handle.registerTimer(at)


class Repeats(StatefulProcessor):
    """State of a session: at most MOST hashes in order of use, gone when the watermark is TTL_MS past the last turn."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cache = handle.getValueState("cache", "hashes array<string>, used array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turns = pd.concat(list(rows)).sort_values(["ts_ms", "message_id"])
        names, used = self.cache.get() if self.cache.exists() else ([], [])
        cache = dict(zip(names, used, strict=True))
        found = [A.remembered(cache, a, b, t) for a, b, t in zip(turns["full"], turns["prefix"], turns["ts_ms"].tolist(), strict=True)]
        self.cache.update((list(cache), list(cache.values())))
        _rearm(self.handle, int(turns["ts_ms"].iloc[-1]) + A.TTL_MS + 1)
        yield pd.DataFrame({"message_id": turns["message_id"], "session_key": key[0], "ts": turns["ts_ms"], "repeated": found})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.cache.clear()
        return iter([])

    def close(self) -> None:
        pass


def repeated_turns(turns: DataFrame, late: str = "5 minutes") -> DataFrame:
    """``operators.assistant.repeated_turns`` of a stream (message_id, session_key, content, ts as timestamp); turns without session pass as not repeated."""
    full, prefix = A.hashes(F.col("content"))
    rows = turns.select("message_id", F.col("session_key").cast("long"), "ts", F.unix_millis("ts").alias("ts_ms"), full.alias("full"), prefix.alias("prefix")).withWatermark("ts", late)
    out = "message_id long, session_key long, ts long, repeated boolean"
    return rows.where("session_key IS NOT NULL").groupBy("session_key").transformWithStateInPandas(Repeats(), out, "append", "EventTime")


class Stalls(StatefulProcessor):
    """State of a session: the capture it counts from, its messages since, when it was told last and its last event."""

    def __init__(self, received: str, done: str):
        self.received, self.done = received, done

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "since long, pending long, filled long, told long, last long")

    def _due(self, s: list, until: int) -> list[tuple[int, int]]:
        """What is to be told before ``until``."""
        if s[1] <= A.PENDING:
            return []
        at = A.told(max(s[2], s[0] + A.WAIT_MS + 1), until, s[3])
        s[3] = at[-1] if at else s[3]
        return [(t, s[1]) for t in at]

    def _next(self, s: list) -> int:
        """When to look again: when something is due, or when the session is forgotten."""
        forget = s[4] + A.IDLE_MS
        if s[1] <= A.PENDING:
            return forget
        first = max(s[2], s[0] + A.WAIT_MS + 1)
        return min(forget, first if s[3] is None else max(first, s[3] + A.QUIET_MS + 1))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows))
        found = found.assign(order=(found["event_type"] != self.done).astype(int)).sort_values(["ts_ms", "order"])
        s = list(self.state.get()) if self.state.exists() else [None, 0, None, None, None]
        out = []
        for t, kind in zip(found["ts_ms"].tolist(), found["event_type"].tolist(), strict=True):
            if s[0] is not None:
                out += self._due(s, min(t, s[4] + A.IDLE_MS))
            if kind == self.done:
                s[0], s[1], s[2] = t, 0, None
            else:
                s[0] = t if s[0] is None else s[0]
                s[1] += 1
                s[2] = t if s[1] == A.PENDING + 1 else s[2]
            s[4] = t
        self.state.update(tuple(s))
        _rearm(self.handle, self._next(s))
        yield pd.DataFrame([(key[0], t, n) for t, n in out], columns=["session_key", "ts", "pending"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # All that is due before the watermark, as a timer set for an instant before it would wait for a next batch.
        now, s = timerValues.getCurrentWatermarkInMs(), list(self.state.get())
        forget = s[4] + A.IDLE_MS
        out = self._due(s, min(forget, now))
        if now >= forget:
            self.state.clear()
        else:
            self.state.update(tuple(s))
            self.handle.registerTimer(self._next(s))
        yield pd.DataFrame([(key[0], t, n) for t, n in out], columns=["session_key", "ts", "pending"])

    def close(self) -> None:
        pass


def stalls(events: DataFrame, received: str, done: str, late: str = "5 minutes") -> DataFrame:
    """``operators.assistant.stalls`` of a stream (session_key, event_type, ts as timestamp): told when the watermark passes the instant, also if no event of the session comes any more."""
    rows = events.where(F.col("event_type").isin(received, done) & F.col("session_key").isNotNull()).select(F.col("session_key").cast("long"), "event_type", "ts", F.unix_millis("ts").alias("ts_ms")).withWatermark("ts", late)
    return rows.groupBy("session_key").transformWithStateInPandas(Stalls(received, done), "session_key long, ts long, pending long", "append", "EventTime")
