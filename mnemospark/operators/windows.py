"""Turns, sessions, budgets and other windows over ordered rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.sources.tables import DAY_MS, MINUTE_MS


def turns(messages: DataFrame) -> DataFrame:
    """One row for each turn (a message without turn is its own): its span, first channel and session, and its messages in order."""
    key = F.coalesce("turn_id", F.col("message_id").cast("string"))
    order = F.struct(F.col("turn_index").isNull().alias("last"), "turn_index", "ts", "message_id", "role", "content")
    m = messages.withColumn("turn", key)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("ts", "message_id")))
    return m.groupBy("user_id", "turn").agg(
        F.min("ts").alias("start_ms"), F.max("ts").alias("end_ms"), F.count(F.lit(1)).alias("messages"), first("channel").alias("channel"), first("session_key").alias("session_key"), F.array_sort(F.collect_list(order)).alias("items")
    )  # a turn is a few messages


def gap_sessions(rows: DataFrame, by: list[str], gap_ms: int = 15 * MINUTE_MS, ts: str = "ts", id_col: str = "message_id") -> DataFrame:
    """rows with ``session_no``: a new one after more than gap_ms without a row of the key."""
    w = Window.partitionBy(*by).orderBy(ts, id_col)
    new = F.coalesce((F.col(ts) - F.lag(ts).over(w) > gap_ms).cast("int"), F.lit(1))
    return rows.withColumn("__new", new).withColumn("session_no", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def extraction_windows(messages: DataFrame, gap_ms: int = 15 * MINUTE_MS, most: int = 12, chars: int = 8000) -> DataFrame:
    """messages with ``window_no`` within (user, channel, session): cut at gaps, at ``most`` messages and before ``chars`` letters are passed.

    Cuts at gaps are found first, by a window; the counts restart there, so each
    island runs on its own, in order, with constant state.
    """
    keys = ["user_id", "channel", "session_key"]
    rows = gap_sessions(messages, keys, gap_ms).repartition(*keys, "session_no").sortWithinPartitions(*keys, "session_no", "ts", "message_id")
    schema = messages.schema.simpleString()[7:-1]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, n, size, no = None, 0, 0, 0
        for pdf in batches:
            numbers = []
            for *k, text in zip(*(pdf[c] for c in (*keys, "session_no", "content")), strict=True):
                k = tuple(None if pd.isna(x) else x for x in k)
                length = len(text or "")
                if k != key:
                    key, n, size, no = k, 0, 0, 0
                elif n >= most or size + length > chars:
                    n, size, no = 0, 0, no + 1
                n, size = n + 1, size + length
                numbers.append(no)
            yield pdf.assign(part_no=numbers)

    names = messages.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in messages.schema.fields)
    del schema
    return rows.mapInPandas(cut, f"{fields}, session_no long, part_no long").select(*names, "session_no", "part_no")


def within_budget(rows: DataFrame, by: list[str], budget: int, size: str = "tokens", order: str = "ordinal") -> DataFrame:
    """The newest rows of each key while their sizes fit the budget; the first that doesn't fit ends it."""
    w = Window.partitionBy(*by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)


def greedy_budget(rows: DataFrame, by: list[str], budget: int, most: int = 1000, size: str = "tokens", order: str = "ordinal", id_col: str = "summary_id") -> DataFrame:
    """Rows of each key, newest first, skipping those that don't fit what is left of the budget.

    A row of more than the budget never fits; of the others only those with a size
    are gathered (id and size), as the choice depends on all before it.
    """
    item = F.struct(F.col(order).alias("o"), F.col(id_col).alias("id"), F.col(size).alias("n"))
    lists = rows.where(F.col(size) <= budget).groupBy(*by).agg(F.reverse(F.array_sort(F.collect_list(item))).alias("items"))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<bigint>").alias("kept"))
    kept = F.aggregate("items", start, lambda s, x: F.when(x["n"] <= s["left"], F.struct((s["left"] - x["n"]).cast("long").alias("left"), F.concat(s["kept"], F.array(x["id"].cast("long"))).alias("kept"))).otherwise(s), lambda s: s["kept"])
    return lists.select(*by, F.explode(kept).alias(id_col))


def fresh_tail(rows: DataFrame, by: list[str], n: int = 8, order: str = "ordinal") -> DataFrame:
    """rows with ``fresh``: whether they are among the last n of their key."""
    return rows.withColumn("fresh", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order))) <= n)


def oldest_chunk(rows: DataFrame, by: list[str], limit: int, tail: int = 8, kind: str = "message", size: str = "tokens", order: str = "ordinal") -> DataFrame:
    """The first run of neighbouring rows of one kind before the fresh tail, up to and with the row at which its sizes reach the limit."""
    w = Window.partitionBy(*by).orderBy(order)
    r = fresh_tail(rows, by, tail, order).where("NOT fresh").withColumn("__is", (F.col("item_type") == kind).cast("int"))
    r = r.withColumn("__first", F.min(F.when(F.col("__is") == 1, F.col(order))).over(Window.partitionBy(*by))).where(F.col(order) >= F.col("__first"))
    r = r.withColumn("__broken", F.sum(1 - F.col("__is")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("__broken = 0")
    r = r.withColumn("__before", F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return r.where(F.col("__before") < limit).drop("__is", "__first", "__broken", "__before", "fresh")


def dropped_sections(sections: DataFrame, by: list[str], most: int | str, drop_order: list[str]) -> DataFrame:
    """Sections of each key after dropping whole labels, lowest priority first and last section first, until all fit ``most`` (a number, or the column that has it)."""
    rank = F.coalesce(*[F.when(F.col("label") == x, i) for i, x in enumerate(drop_order)])
    s = sections.withColumn("__rank", rank)
    total = F.sum("size").over(Window.partitionBy(*by))
    w = Window.partitionBy(*by).orderBy(F.col("__rank").asc_nulls_last(), F.desc("ordinal"))
    gone = F.coalesce(F.sum(F.when(F.col("__rank").isNotNull(), F.col("size")).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = s.withColumn("__excess", total - gone)
    return s.where(F.col("__rank").isNull() | (F.col("__excess") <= (F.col(most) if isinstance(most, str) else most))).drop("__rank", "__excess")


def trimmed_oldest(rows: DataFrame, by: list[str], most: int, size: str = "chars", order: str = "ordinal") -> DataFrame:
    """The newest rows of each key whose sizes sum to at most ``most``: the oldest are dropped first."""
    w = Window.partitionBy(*by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("kept_chars", F.sum(size).over(w)).where(F.col("kept_chars") <= most)


def numbered_chunks(rows: DataFrame, by: str, order: str) -> DataFrame:
    """rows with ``chunk_no`` from 1 and ``chunks`` of their file."""
    return rows.withColumn("chunk_no", F.row_number().over(Window.partitionBy(by).orderBy(order))).withColumn("chunks", F.count(F.lit(1)).over(Window.partitionBy(by)))


def head_and_tail(rows: DataFrame, by: list[str], n: int, order: str) -> DataFrame:
    """The first and last n rows of each key, each once."""
    up = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    down = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))
    return rows.withColumn("__up", up).withColumn("__down", down).where((F.col("__up") <= n) | (F.col("__down") <= n)).drop("__up", "__down")


def rolling_sum(rows: DataFrame, by: str, value: str, ts: str, span_ms: int = DAY_MS) -> DataFrame:
    """rows with the sum of a value over the span up to and with their instant."""
    return rows.withColumn("rolling", F.sum(value).over(Window.partitionBy(by).orderBy(ts).rangeBetween(-span_ms, 0)))


def lag_delta(rows: DataFrame, by: str, value: str, *order: str) -> DataFrame:
    return rows.withColumn("delta", F.col(value) - F.lag(value).over(Window.partitionBy(by).orderBy(*order)))


def session_snapshot(messages: DataFrame) -> DataFrame:
    """Span, number and a summary of the lines of each session."""
    line = F.concat(F.lit("["), F.date_format(F.timestamp_millis("ts"), "HH:mm"), F.lit("] "), F.col("role"), F.lit(": "), F.when(F.length("content") > 120, F.concat(F.substring("content", 1, 120), F.lit("..."))).otherwise(F.col("content")))
    m = messages.select("session_key", "ts", F.struct("ts", "message_id", line.alias("line")).alias("x"))
    out = m.groupBy("session_key").agg(F.min("ts").alias("started_ms"), F.max("ts").alias("last_active_ms"), F.count(F.lit(1)).alias("messages"), F.array_sort(F.collect_list("x")).alias("x"))
    return out.withColumn("summary", F.concat(F.lit("Recent conversation:\n"), F.array_join(F.transform("x", lambda x: x["line"]), "\n"))).drop("x")
