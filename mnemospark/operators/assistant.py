"""What a session's assistant turns and captures say: repeats of what has just been written, and captures that have stalled.

Both are given as batch operators here and as streams in ``streaming.assistant``, which share the rules below.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.sources.tables import HOUR_MS, MINUTE_MS

#: How long and how many hashes of written texts are remembered a session, and how long a prefix is.
TTL_MS, MOST, PREFIX = 2 * HOUR_MS, 500, 200
#: More pending messages than this, for longer than this, told again after this; a session is forgotten so long after its last event.
PENDING, WAIT_MS, QUIET_MS, IDLE_MS = 3, 10 * MINUTE_MS, 60 * MINUTE_MS, 24 * HOUR_MS


def hashes(content: Column) -> tuple[Column, Column]:
    """Of the trimmed text, and of its first PREFIX characters."""
    t = T.trim(content)
    return F.sha1(t), F.sha1(F.substring(t, 1, PREFIX))


def remembered(cache: dict[str, int], full: str, prefix: str, now: int, ttl_ms: int = TTL_MS, most: int = MOST) -> bool:
    """Whether a text's full or prefix hash is in the cache, which keeps the order of use.  A hit renews the entry that was found; a miss adds both and drops the least recently used beyond ``most``."""
    for k in [k for k, t in cache.items() if now - t > ttl_ms]:
        del cache[k]
    for k in (full, "p" + prefix):
        if k in cache:
            del cache[k]
            cache[k] = now
            return True
    for k in (full, "p" + prefix):
        cache[k] = now
    while len(cache) > most:
        del cache[next(iter(cache))]
    return False


def repeated_turns(turns: DataFrame, ttl_ms: int = TTL_MS, most: int = MOST) -> DataFrame:
    """(message_id, session_key, ts, repeated): of turns (message_id, session_key, content, ts), whether the session has just written the same text or one with the same beginning.

    Turns without session are never repeated.  A session is cut where more than ``ttl_ms``
    passes without a turn, as nothing is remembered for longer; within a part, rows go by in order and
    at most ``most`` hashes are held.
    """
    full, prefix = hashes(F.col("content"))
    rows = turns.select("message_id", "session_key", "ts", full.alias("full"), prefix.alias("prefix"))
    kind = dict(turns.dtypes)["session_key"]
    named = rows.where(F.col("session_key").isNotNull())
    w = Window.partitionBy("session_key").orderBy("ts", "message_id")
    parted = named.withColumn("cut", F.coalesce(F.col("ts") - F.lag("ts").over(w) > ttl_ms, F.lit(True)).cast("long")).withColumn("part", F.sum("cut").over(w)).drop("cut")
    ordered = parted.repartition("session_key", "part").sortWithinPartitions("session_key", "part", "ts", "message_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, cache = None, {}
        for pdf in batches:
            found = []
            for session, part, t, a, b in zip(pdf["session_key"], pdf["part"], pdf["ts"], pdf["full"], pdf["prefix"], strict=True):
                if (session, part) != key:
                    key, cache = (session, part), {}
                found.append(remembered(cache, a, b, t, ttl_ms, most))
            yield pd.DataFrame({"message_id": pdf["message_id"], "session_key": pdf["session_key"], "ts": pdf["ts"], "repeated": found})

    found = ordered.mapInPandas(run, f"message_id long, session_key {kind}, ts long, repeated boolean")
    return found.unionByName(rows.where(F.col("session_key").isNull()).select("message_id", "session_key", "ts", F.lit(False).alias("repeated")))


def told(first: int, end: int, last: int | None, quiet_ms: int = QUIET_MS) -> list[int]:
    """The instants in [first, end) at which a stall is told: the first one that is more than ``quiet_ms`` after the last one told, and so on."""
    begin = first if last is None else max(first, last + quiet_ms + 1)
    return list(range(begin, end, quiet_ms + 1))


def stalls(events: DataFrame, received: str, done: str, pending: int = PENDING, wait_ms: int = WAIT_MS, quiet_ms: int = QUIET_MS, idle_ms: int = IDLE_MS) -> DataFrame:
    """(session_key, ts, pending): instants at which more than ``pending`` messages have been received since the last capture, which is longer ago than ``wait_ms``.

    events (session_key, event_type, ts).  A session without a capture counts from its first
    message.  What is told isn't told again within ``quiet_ms``, also across captures, and a session is
    forgotten ``idle_ms`` after its last event.  Stretches between captures come from windows; only those that stall pass
    through Python, in order, with the last instant told as state.
    """
    kind = dict(events.dtypes)["session_key"]
    rows = events.where(F.col("event_type").isin(received, done) & F.col("session_key").isNotNull()).select("session_key", "ts", (F.col("event_type") == done).alias("done"))
    # Captures come before messages of the same instant.
    order = Window.partitionBy("session_key").orderBy("ts", F.desc("done"))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("stretch", F.sum(F.col("done").cast("long")).over(so_far))
    nth = F.row_number().over(Window.partitionBy("session_key", "stretch", "done").orderBy("ts"))
    rows = rows.withColumn("nth", F.when(~F.col("done"), nth))
    runs = rows.groupBy("session_key", "stretch").agg(F.min("ts").alias("since"), F.max("ts").alias("until"), F.min(F.when(F.col("nth") == pending + 1, F.col("ts"))).alias("full"))
    # Captures of one instant: all but the last are stretches of their own, without messages.
    by = Window.partitionBy("session_key").orderBy("stretch")
    last = F.max("until").over(Window.partitionBy("session_key"))
    runs = runs.withColumn("end", F.coalesce(F.lead("since").over(by), last + idle_ms)).withColumn("first", F.greatest("full", F.col("since") + wait_ms + 1))
    runs = runs.where("full IS NOT NULL AND first < end").select("session_key", "stretch", "first", "end").repartition("session_key").sortWithinPartitions("session_key", "stretch")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, latest = None, None
        for pdf in batches:
            out = []
            for session, stretch, first, end in zip(pdf["session_key"], pdf["stretch"], pdf["first"], pdf["end"], strict=True):
                if session != key:
                    key, latest = session, None
                for t in told(first, end, latest, quiet_ms):
                    out.append((session, stretch, t))
                    latest = t
            yield pd.DataFrame(out, columns=["session_key", "stretch", "ts"])

    at = runs.mapInPandas(run, f"session_key {kind}, stretch long, ts long").alias("t")
    seen = rows.where("NOT done").select("session_key", "stretch", F.col("ts").alias("seen")).alias("s")
    on = (F.col("t.session_key") == F.col("s.session_key")) & (F.col("t.stretch") == F.col("s.stretch")) & (F.col("s.seen") <= F.col("t.ts"))
    return at.join(seen, on).groupBy("t.session_key", "t.ts").agg(F.count(F.lit(1)).alias("pending"))
