"""Streams of events and messages: dedupe, sessions, rate limits (see ``assistant`` for repeated turns and stalled captures).

Each takes a streaming DataFrame and returns one; state has a bound: a watermark,
a time to live, or a constant per key.  ``now`` is the events' own time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mnemospark.sources.tables import MINUTE_MS


def read_events(spark: SparkSession, folder: str, schema: str = "event_id long, user_id long, event_type string, ts timestamp", files: int = 1) -> DataFrame:
    """The Parquet files of a folder as a stream, some at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def deduplicated(events: DataFrame, keys: list[str], ts: str = "ts", band: str = "5 seconds") -> DataFrame:
    """The first of rows with equal keys within the band; later ones are dropped, and so is state beyond it."""
    return events.withWatermark(ts, band).dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, by: str = "user_id", ts: str = "ts", gap: str = "15 minutes", late: str = "5 minutes") -> DataFrame:
    """(by, start, end, n): a session ends after a gap without events; out when the watermark has passed it."""
    found = events.withWatermark(ts, late).groupBy(by, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return found.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def daily_counts(events: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """(user_id, day, n) for quotas, updated as events come."""
    return events.withWatermark(ts, late).groupBy("user_id", F.window(ts, "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("day"), "n")


def rate_limited(events: DataFrame, limit: int = 60, window_ms: int = MINUTE_MS, idle_ms: int = 60 * MINUTE_MS, late: str = "5 minutes") -> DataFrame:
    """(event_id, user_id, ts_ms, nth, allowed): windows open at a user's first event after the last one closed.  Events later than the watermark take no part.  State: two numbers a user, gone when the watermark is idle_ms past the user's last event."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["ts_ms", "event_id"])
        nth = []
        for t in rows["ts_ms"].tolist():
            if start is None or t - start > window_ms:
                start, n = t, 0
            n += 1
            nth.append(n)
        state.update((int(start), int(n)))
        state.setTimeoutTimestamp(max(int(rows["ts_ms"].iloc[-1]), state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame({"event_id": rows["event_id"], "user_id": key[0], "ts_ms": rows["ts_ms"], "nth": nth, "allowed": [x <= limit for x in nth]})

    ts = F.col("ts").cast("timestamp")
    rows = events.select("event_id", "user_id", ts.alias("ts"), F.unix_millis(ts).alias("ts_ms")).withWatermark("ts", late)
    return rows.groupBy("user_id").applyInPandasWithState(run, "event_id long, user_id long, ts_ms long, nth long, allowed boolean", "start long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def written(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", seconds: int | None = None) -> bool:
    """Run over all that is there, then end; what is written is exactly once.  Stops after ``seconds`` and says whether it had ended."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if seconds is None:
        query.awaitTermination()
        return True
    ended = bool(query.awaitTermination(seconds))
    query.stop()
    return ended
