"""Exact and near-time duplicates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.operators.common import best_per, with_runs


def merged_memories(rows: DataFrame, least_strength: float = 0.8, least_confidence: float = 0.9) -> DataFrame:
    """One row for equal texts of a user in a channel (archived rows apart): the first id, raised strength and confidence if repeated, all tags.

    Grouping is on a hash of the text, pre-aggregated before the shuffle; tags of a
    group are distinct values, so no group gathers its texts.
    """
    keyed = rows.withColumn("content_hash", T.memory_hash(F.col("store"), F.col("category"), F.col("content")))
    n = F.count(F.lit(1))
    repeated = n > 1
    out = keyed.where(~F.col("archived")).groupBy("user_id", "content_hash", "channel").agg(
        F.min("memory_id").alias("memory_id"),
        n.alias("copies"),
        F.when(repeated, F.greatest(F.lit(least_strength), F.max("strength"))).otherwise(F.max("strength")).alias("strength"),
        F.when(repeated, F.greatest(F.lit(least_confidence), F.max("confidence"))).otherwise(F.max("confidence")).alias("confidence"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"),
    )
    return out


def same_title_and_content(rows: DataFrame) -> DataFrame:
    """(memory_id, keep_id): each active row and the first of those with equal user, store, category, title and text; a row without channel equals any."""
    key = ["user_id", "store", "category", F.sha2(F.concat_ws("\u001f", T.folded(F.col("title")), T.hash_text(F.col("content"))), 256).alias("h")]
    r = rows.where(~F.col("archived")).select("memory_id", "channel", *key)
    by = Window.partitionBy("user_id", "store", "category", "h")
    open_first = F.min(F.when(F.col("channel").isNull(), F.col("memory_id"))).over(by)
    same_first = F.min("memory_id").over(Window.partitionBy("user_id", "store", "category", "h", "channel"))
    first = F.min("memory_id").over(by)
    return r.select("memory_id", F.when(F.col("channel").isNull(), first).otherwise(F.least(same_first, open_first)).alias("keep_id"))


def keep_best(rows: DataFrame, score: str = "score", id_col: str = "memory_id") -> DataFrame:
    """Of rows with equal title and content the one of highest score, the smallest id among equals."""
    keyed = rows.withColumn("__key", F.sha2(T.dedupe_key(F.col("title"), F.col("content")), 256))
    return best_per(keyed, ["__key"], F.desc(score), F.asc(id_col)).drop("__key")


def _scoped(messages: DataFrame) -> DataFrame:
    h = T.message_hash(F.col("role"), F.col("content"))
    return messages.withColumn("content_hash", h).withColumn("scope_hash", T.dedupe_scope(F.col("user_id"), F.col("role"), h, F.col("channel"), F.col("session_key"), F.col("turn_id"), F.col("turn_index")))


def repeats_of_previous(messages: DataFrame, band_ms: int = 5000) -> DataFrame:
    """Messages flagged ``repeat``: same scope as an earlier one, at most band_ms after the previous one unless the scope names the turn."""
    w = Window.partitionBy("scope_hash").orderBy("ts", "message_id")
    durable = F.col("turn_id").isNotNull() | (F.col("session_key").isNotNull() & F.col("turn_index").isNotNull())
    last = F.lag("ts").over(w)
    return _scoped(messages).withColumn("repeat", last.isNotNull() & (durable | (F.col("ts") - last <= band_ms)))


def near_time_kept(messages: DataFrame, keys: list[str], band_ms: int = 5000, ts: str = "ts", id_col: str = "message_id") -> DataFrame:
    """Rows without those at most band_ms after the last *kept* row of their key: of repeats 4 s apart the first and third stay.

    Sequential by nature: rows are sorted by key and time inside partitions and
    one running state is held, so a hot key needs no memory.  A key of a third of
    the rows is cut where a gap is longer than the band, since nothing carries over it.
    """
    rows = with_runs(messages, keys, band_ms, ts)
    rows = rows.repartition(*keys, "__run").sortWithinPartitions(*keys, "__run", ts, id_col)
    schema = messages.schema

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, 0
        for pdf in batches:
            marks = []
            for row in zip(*(pdf[c] for c in (*keys, "__run", ts)), strict=True):
                k, t = tuple(None if pd.isna(x) else x for x in row[:-1]), row[-1]
                new = k != key or t - last > band_ms
                if new:
                    key, last = k, t
                marks.append(new)
            yield pdf[marks][schema.names]

    return rows.mapInPandas(keep, schema)


def first_of_copies(messages: DataFrame) -> DataFrame:
    """(message_id, keep_id) of every message: the first with its scope."""
    w = Window.partitionBy("scope_hash")
    first = F.min_by("message_id", F.struct("ts", "message_id")).over(w)
    return _scoped(messages).select("message_id", first.alias("keep_id"))


def with_hashes(messages: DataFrame) -> DataFrame:
    return _scoped(messages)


def duplicate_key(rows: DataFrame, keys: list[Column]) -> DataFrame:
    """Keys that several rows have, with their number."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
