"""Retention, decay, quotas and changes of rows.  Tables are not updated in place: each operator returns the new rows or an action for each."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import scoring as S
from mnemospark.functions.timeexpr import age_days, day_key
from mnemospark.operators.common import with_runs
from mnemospark.operators.gates import stale_workflow
from mnemospark.sources.tables import DAY_MS, MINUTE_MS


def expired(rows: DataFrame, now_ms: int, col: str = "expires_at") -> DataFrame:
    return rows.where(F.col(col) <= now_ms)


def cleanup_action(now_ms: int) -> Column:
    """delete: sensory rows of over a day; archive: weak rows and stale workflows; rows of a knowledge base stay."""
    old = (F.col("store") == "sensory") & (F.col("created_ms") <= now_ms - DAY_MS)
    weak = (F.col("strength") < 0.1) | stale_workflow(F.col("store"), F.col("category"), F.col("metadata"), now_ms)
    return F.when(F.col("kb_id").isNotNull(), "keep").when(old, "delete").when(weak & ~F.col("archived"), "archive").otherwise("keep")


def cleaned(memories: DataFrame, edges: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """Rows after the cleanup, and the edges whose ends both remain."""
    acted = memories.withColumn("action", cleanup_action(now_ms))
    kept = acted.where("action != 'delete'").withColumn("archived", F.col("archived") | (F.col("action") == "archive"))
    gone = acted.where("action = 'delete'").select("memory_id")
    edges = edges.join(gone.withColumnRenamed("memory_id", "from_id"), "from_id", "left_anti").join(gone.withColumnRenamed("memory_id", "to_id"), "to_id", "left_anti")
    return kept.drop("action"), edges


def under_pressure(memories: DataFrame, limit: int, now_ms: int, start: float = 0.9, target: float = 0.85, buckets: int = 64) -> DataFrame:
    """(memory_id, strength, user_id): rows to archive, with half their strength, of users at ``start`` of the limit or more: the lowest down to ``target``.

    The rank within a user is split over ``buckets`` ranges of the score, so that a
    user with a third of all rows is not one task: counts of the lower ranges
    are added to a rank within each.
    """
    active = memories.where(~F.col("archived"))
    quota = active.groupBy("user_id").agg(F.count(F.lit(1)).alias("active")).where(F.col("active") >= limit * start).select("user_id", (F.col("active") - F.floor(F.lit(limit * target))).cast("long").alias("excess"))
    score = F.round(S.retention_score(F.col("strength"), age_days(now_ms, F.coalesce("last_accessed_ms", "created_ms"))), 6)
    rows = active.where("kb_id IS NULL").select("memory_id", "user_id", "strength", score.alias("score")).join(quota, "user_id")
    rows = rows.withColumn("range", F.least(F.lit(buckets - 1), F.floor(F.col("score") * buckets)).cast("int"))
    below = Window.partitionBy("user_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("user_id", "range").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(below), F.lit(0))).select("user_id", "range", "base")
    w = Window.partitionBy("user_id", "range").orderBy("score", "memory_id")
    ranked = rows.withColumn("n", F.row_number().over(w)).join(base, ["user_id", "range"])
    return ranked.where(F.col("n") + F.col("base") <= F.col("excess")).select("memory_id", "user_id", (F.col("strength") * 0.5).alias("strength"))


def daily_quota(rows: DataFrame, cap: int, ts: str = "ts", id_col: str = "event_id") -> DataFrame:
    """rows with ``day``, their number in it and whether it is within the cap, by user."""
    w = Window.partitionBy("user_id", "day").orderBy(ts, id_col)
    return rows.withColumn("day", day_key(F.col(ts))).withColumn("nth", F.row_number().over(w)).withColumn("allowed", F.col("nth") <= cap)


def fixed_window_limit(rows: DataFrame, limit: int = 60, window_ms: int = MINUTE_MS, inclusive: bool = False, ts: str = "ts", id_col: str = "event_id") -> DataFrame:
    """rows with ``window_ms``, ``nth`` and ``allowed``: windows open at a user's first request after the last one closed.

    A window's start depends on all before it, so a user's rows run in order with
    constant state; they are cut where more than a window passes without any, as the next one then opens a
    window anyhow.  ``inclusive``: a request exactly at the end is in the next window.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    rows = with_runs(rows, ["user_id"], window_ms, ts).repartition("user_id", "__run").sortWithinPartitions("user_id", "__run", ts, id_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, start, n = None, 0, 0
        for pdf in batches:
            starts, nth = [], []
            for u, r, t in zip(pdf["user_id"], pdf["__run"], pdf[ts], strict=True):
                late = t - start >= window_ms if inclusive else t - start > window_ms
                if (u, r) != part or late:
                    part, start, n = (u, r), t, 0
                n += 1
                starts.append(start)
                nth.append(n)
            yield pdf.drop(columns="__run").assign(window_start=starts, nth=nth, allowed=[x <= limit for x in nth])

    return rows.mapInPandas(run, f"{fields}, window_start long, nth long, allowed boolean")


def ttl_histogram(traces: DataFrame, now_ms: int) -> DataFrame:
    """Active traces by time left: within 1 h, 6 h, 24 h, later."""
    left = F.col("expires_ms") - now_ms
    hour = 60 * MINUTE_MS
    band = F.when(left <= hour, "1h").when(left <= 6 * hour, "6h").when(left <= 24 * hour, "24h").otherwise("later")
    return traces.where((F.col("expires_ms") > now_ms) & F.col("validated").isNull()).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


def superseded(memories: DataFrame, changes: DataFrame) -> DataFrame:
    """memories plus a successor for each change (memory_id, new_id, content), with fields inherited; the old rows are archived."""
    hit = changes.select("memory_id", "new_id", F.col("content").alias("__content"))
    old = memories.join(hit.select("memory_id").withColumn("__hit", F.lit(True)), "memory_id", "left").withColumn("archived", F.col("archived") | F.col("__hit").isNotNull()).drop("__hit")
    new = memories.join(hit, "memory_id").withColumn("memory_id", F.col("new_id")).withColumn("content", F.col("__content")).withColumn("archived", F.lit(False)).drop("new_id", "__content")
    return old.select(*memories.columns).unionByName(new.select(*memories.columns))


def accessed(memories: DataFrame, seen: DataFrame, now_ms: int) -> DataFrame:
    """memories with one more access, now, for those seen."""
    hit = seen.select("memory_id").distinct().withColumn("__hit", F.lit(True))
    m = memories.join(hit, "memory_id", "left")
    return m.select(*[F.when(F.col("__hit"), F.col("access_count") + 1).otherwise(F.col("access_count")).alias(c) if c == "access_count" else F.when(F.col("__hit"), F.lit(now_ms)).otherwise(F.col(c)).alias(c) if c == "last_accessed_ms" else F.col(c) for c in memories.columns])


def boosted_traces(traces: DataFrame, new: DataFrame, now_ms: int, step: float = 0.05, most: float = 0.95) -> DataFrame:
    """(key, confidence, is_new): predictions merged into active traces of equal text, whose confidence rises by ``step``; the others are added."""
    from mnemospark.functions.text import collapsed

    key = F.sha2(collapsed(F.col("predicted_query")), 256)
    old = traces.where((F.col("expires_ms") > now_ms) & F.col("validated").isNull()).groupBy(key.alias("key")).agg(F.max("confidence").alias("old"))
    added = new.groupBy(key.alias("key")).agg(F.max("confidence").alias("new"))
    m = old.join(added, "key", "full")
    value = F.when(F.col("old").isNull(), F.col("new")).when(F.col("new").isNull(), F.col("old")).otherwise(F.least(F.lit(most), F.col("old") + step))
    return m.select("key", F.round(value, 6).alias("confidence"), F.col("old").isNull().alias("is_new"))


def idea_status(ideas: DataFrame, now_ms: int, to: str = "to") -> DataFrame:
    """ideas (.., status, notified_ms, emailed_ms, read_ms, dismissed_ms, starred_ms, updated_ms) after each moves to the status in ``to``; null keeps it as it is.

    ``starred`` only sets when it was starred.  A step forward fills in the steps before it where they
    are missing, a step back clears those after it, and pending_notification clears all but the star.
    """
    now, none = F.lit(now_ms).cast("long"), F.lit(None).cast("long")
    step = F.col(to)
    moves = step.isNotNull() & (step != "starred")
    seen = moves & (step != "pending_notification")
    first = lambda c: F.coalesce(c, now)
    return ideas.withColumns(
        {
            "status": F.when(moves, step).otherwise(F.col("status")),
            "notified_ms": F.when(seen, first(F.col("notified_ms"))).when(moves, none).otherwise(F.col("notified_ms")),
            "emailed_ms": F.when(step == "pending_notification", none).otherwise(F.col("emailed_ms")),
            "read_ms": F.when(step == "read", now).when(step == "dismissed", first(F.col("read_ms"))).when(moves, none).otherwise(F.col("read_ms")),
            "dismissed_ms": F.when(step == "dismissed", now).when(moves, none).otherwise(F.col("dismissed_ms")),
            "starred_ms": F.when(step == "starred", now).otherwise(F.col("starred_ms")),
            "updated_ms": F.when(step.isNotNull(), now).otherwise(F.col("updated_ms")),
        }
    )
