"""The logical tables of an agent-memory store, as views over the Parquet tables of a folder.

Memories, messages, activity, recall logs, runs, traces, a typed entity graph and
vectors are derived columns only: no view shuffles, so filters and column pruning
reach the Parquet scan.  Instants are epoch milliseconds (long, UTC).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2024-01-01T00:00:00Z, the first instant of the derived columns.
EPOCH_MS = 1704067200000
MINUTE_MS, HOUR_MS, DAY_MS = 60_000, 3_600_000, 86_400_000
#: The instant that registered queries take as now: 2024-03-01T00:00:00Z.
NOW_MS = 1709251200000

STORES = ("sensory", "episodic", "semantic", "procedural", "prospective")
CATEGORIES = ("decision", "lesson", "person", "rule", "event", "fact", "goal", "workflow", "conversation", "skill")
RELATIONS = ("supports", "contradicts", "derives_from", "co_occurred", "generalizes", "precedes")
TRACE_TYPES = ("query", "context", "followup", "resonance", "warning")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def share(key: Column, factor: int) -> Column:
    """A number from 0 to 1 in hundredths, fixed by the key."""
    return (key * factor % 101) / 100.0


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    created = i * 10 * MINUTE_MS + EPOCH_MS
    return table(spark, sf_dir, "documents").select(
        i.alias("memory_id"),
        (F.floor(i / 3) % 20).alias("user_id"),
        F.substring("text", 1, 80).alias("title"),
        F.col("text").alias("content"),
        F.col("lang").alias("channel"),
        F.when(i % 7 == 0, F.col("source")).alias("kb_id"),
        F.when(i % 3 == 0, (i % 5).cast("string")).alias("scope"),
        pick(STORES, i).alias("store"),
        pick(CATEGORIES, F.floor(i / 5)).alias("category"),
        share(i, 37).alias("strength"),
        share(i, 53).alias("confidence"),
        share(i, 29).alias("salience"),
        (i * 17 % 201 / 100.0 - 1).alias("valence"),
        share(i, 71).alias("arousal"),
        (i % 25).alias("access_count"),
        created.alias("created_ms"),
        (created + i % 30 * DAY_MS).alias("last_accessed_ms"),
        F.array("lang", "source").alias("tags"),
        (i % 11 == 0).alias("archived"),
        F.concat(F.lit('{"skillFormat":true,"observationCount":'), (i % 5).cast("string"), F.lit(',"lastObserved":'), (created + i % 40 * DAY_MS).cast("string"), F.lit("}")).alias("metadata"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    ts = c * HOUR_MS + t * MINUTE_MS + EPOCH_MS
    return table(spark, sf_dir, "conversations").select(
        (c * 1000 + t).alias("message_id"),
        (c % 10).alias("user_id"),
        c.alias("session_key"),
        F.when(c % 3 == 0, F.concat_ws("-", c.cast("string"), F.floor(t / 2).cast("string"))).alias("turn_id"),
        t.alias("turn_index"),
        "role",
        F.col("text").alias("content"),
        F.concat(F.lit("ch"), (c % 4).cast("string")).alias("channel"),
        ts.alias("ts"),
        (ts + (c % 60 + 1) * DAY_MS).alias("expires_at"),
        (c % 2 == 0).alias("embedded"),
        F.when(c % 4 == 0, ts + HOUR_MS).alias("extracted_at"),
    )


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.get_json_object("props", "$.k").cast("long").alias("k"))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "memory_recalled").otherwise("memory_stored")
    return _events(spark, sf_dir).where(F.col("event_type").isin("view", "click")).select("event_id", "user_id", kind.alias("event_type"), F.col("k").alias("memory_id"), "ts")


def recall_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    top = F.array(k, (k + 1) % 100, (k + 2) % 100)
    return _events(spark, sf_dir).where("event_type = 'purchase'").select(
        F.col("event_id").alias("log_id"), "user_id", F.concat(F.lit("topic "), k.cast("string")).alias("query"), top.alias("top_ids"), (k % 4).alias("result_count"), (k % 3).alias("trace_hits"), (F.round(F.col("value")) % 100 / 100.0).alias("top_score"), F.col("ts").alias("created_ms")
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).where("event_type = 'error'").select(
        F.col("event_id").alias("run_id"), "user_id", F.when(F.col("k") % 5 == 0, "failed").otherwise("completed").alias("status"), F.when(F.col("k") % 3 == 0, "scheduled").otherwise("manual").alias("trigger"), F.col("value").alias("cost"), F.col("k").alias("traces"), F.col("ts").alias("started_ms")
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", "user_id", "event_type", "ts")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    i = c * 1000 + t
    return table(spark, sf_dir, "conversations").where("role = 'user'").select(
        i.alias("trace_id"),
        (c % 10).alias("user_id"),
        F.col("text").alias("predicted_query"),
        pick(TRACE_TYPES, i).alias("trace_type"),
        share(i, 31).alias("confidence"),
        (c * HOUR_MS + EPOCH_MS).alias("created_ms"),
        (c * HOUR_MS + EPOCH_MS + i % 72 * HOUR_MS).alias("expires_ms"),
        F.when(i % 3 == 0, F.lit(True)).when(i % 3 == 1, F.lit(False)).alias("validated"),
        (i % 9).alias("access_count"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("memory_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").alias("ensemble_id"))


def knowledge_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimension rows, one for each source, with stored counters that are off by a known drift."""
    n = F.count(F.lit(1))
    b = F.regexp_extract("kb_id", "([0-9]+)$", 1).cast("long")
    return memories(spark, sf_dir).where("kb_id IS NOT NULL").groupBy("kb_id").agg(n.alias("n"), F.sum(F.length("content")).alias("chars")).select(
        "kb_id", (F.col("n") + b % 3).alias("stored_count"), (F.col("chars") - b % 2 * 10).alias("stored_chars"), (b % 6 != 5).alias("is_active"), F.when(b % 2 == 0, F.array(F.lit("coach"), F.lit("coder"))).otherwise(F.array().cast("array<string>")).alias("agent_ids"), F.when(b % 3 == 0, (b % 5).cast("string")).alias("scope"), F.when(b % 4 == 0, "permissive").when(b % 4 == 1, "strict").alias("policy")
    )


def associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").where("doc_id > 0").select(i.alias("edge_id"), i.alias("from_id"), F.floor(i / 2).alias("to_id"), pick(RELATIONS, i).alias("relation"), share(i, 41).alias("weight"), (i * 10 * MINUTE_MS + EPOCH_MS).alias("updated_ms"))


def node_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(i.alias("memory_id"), F.concat(F.lit("nation:"), (i % 25).cast("string")).alias("node_id"), share(i, 67).alias("confidence"))


def triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).where(F.col("memory_id") % 3 == 0).select("memory_id", F.concat(F.lit("tool"), (F.col("memory_id") % 8).cast("string")).alias("tool"), "last_accessed_ms")


def _node_id(kind: str, key: str) -> Column:
    return F.concat(F.lit(kind + ":"), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("supplier", "s_suppkey", "s_name"), ("customer", "c_custkey", "c_name"), ("part", "p_partkey", "p_name")]
    out = None
    for kind, key, label in parts:
        one = table(spark, sf_dir, kind).select(_node_id(kind, key).alias("node_id"), F.lit(kind).alias("node_type"), F.col(label).alias("label"))
        out = one if out is None else out.unionByName(one)
    return out


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges: nation to region, supplier and customer to nation, customer to part, part to part."""
    t = {n: table(spark, sf_dir, n) for n in ("nation", "supplier", "customer", "part")}

    def edges(df, src, relation, dst, key):
        return df.select(src.alias("from_id"), dst.alias("to_id"), F.lit(relation).alias("relation"), share(F.col(key).cast("long"), 43).alias("confidence"))

    half = F.concat(F.lit("part:"), F.floor(F.col("p_partkey") / 2).cast("string"))
    owned = t["customer"].join(t["part"].select("p_partkey"), F.col("c_custkey") == F.col("p_partkey"))
    return (
        edges(t["nation"], _node_id("nation", "n_nationkey"), "depends_on", _node_id("region", "n_regionkey"), "n_nationkey")
        .unionByName(edges(t["supplier"], _node_id("supplier", "s_suppkey"), "assigned_to", _node_id("nation", "s_nationkey"), "s_suppkey"))
        .unionByName(edges(t["customer"], _node_id("customer", "c_custkey"), "assigned_to", _node_id("nation", "c_nationkey"), "c_custkey"))
        .unionByName(edges(owned, _node_id("customer", "c_custkey"), "owns", _node_id("part", "p_partkey"), "p_partkey"))
        .unionByName(edges(t["part"].where("p_partkey > 0"), _node_id("part", "p_partkey"), "depends_on", half, "p_partkey"))
    )


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of a session, from its assistant turns, at depth 0 and 1."""
    return messages(spark, sf_dir).where("role = 'assistant'").select(F.col("message_id").alias("summary_id"), "session_key", (F.col("turn_index") % 2).alias("depth"), "content", F.ceil(F.length("content") / 4).alias("tokens"), "ts")


def context_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered context of each session: summaries for its first half, raw messages after them."""
    kind = F.when((F.col("role") == "assistant") & (F.col("turn_index") < 4), "summary").otherwise("message")
    return messages(spark, sf_dir).select("session_key", F.col("turn_index").alias("ordinal"), kind.alias("item_type"), F.col("message_id").alias("ref_id"))
