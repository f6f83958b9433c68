"""Writes of memories and rules about what a session is shown or logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.operators.common import checkpoint
from mnemospark.operators.content import stripped
from mnemospark.operators.gates import scanned
from mnemospark.operators.lifecycle import fixed_window_limit

#: What a new memory starts with.
NEW = {"strength": 0.8, "confidence": 0.9, "valence": 0.0, "arousal": 0.3}


def captured(memories: DataFrame, new: DataFrame, now_ms: int) -> DataFrame:
    """(memory_id, user_id, channel, strength, confidence, last_accessed_ms, tags, action): what capturing ``new`` writes.

    ``new`` has the columns of memories.  Rows with a threat in title or text are
    ``blocked``; of the others those whose text an active memory of the same user,
    store, category and channel has are merged into the one of least id
    (``merged``, under its id, with raised strength and confidence and all tags), and
    of equal new texts the first is ``inserted`` and the rest are merged into it.  Tags
    are stored as given, and trimmed, lower-cased and made distinct where rows merge.
    """
    shown = new.withColumn("threat", F.coalesce(scanned(F.col("title")), scanned(F.col("content"))))
    key = T.memory_hash(F.col("store"), F.col("category"), F.col("content"))
    place = ["user_id", F.coalesce("channel", F.lit("")).alias("at"), F.col("channel").isNull().alias("nowhere")]
    # Texts are scanned and hashed once; without them the rows are small.
    shown = checkpoint(shown.select("memory_id", "user_id", "channel", "tags", "threat", F.when(F.col("threat").isNull(), key).alias("hash")))
    kept = shown.where("threat IS NULL").select("memory_id", "channel", "tags", *place, "hash")
    by = ["user_id", "at", "nowhere", "hash"]
    incoming = kept.groupBy(*by).agg(F.min("memory_id").alias("first"), F.count(F.lit(1)).alias("n"), F.first("channel").alias("channel"), F.min_by("tags", "memory_id").alias("given"))
    # Distinct tags of equal texts, in order of their first use: no group gathers its rows.
    words = kept.select("memory_id", *by, F.posexplode("tags").alias("i", "tag")).withColumn("tag", T.folded(F.col("tag"))).where("tag != ''")
    words = words.groupBy(*by, "tag").agg(F.min(F.struct("memory_id", "i")).alias("at_first"))
    words = words.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at_first", "tag"))), lambda x: x["tag"]).alias("new_tags"))
    incoming = incoming.join(words, by, "left")
    active = memories.where("NOT archived").select("memory_id", "strength", "confidence", F.col("tags").alias("old_tags"), *place, key.alias("hash"))
    old = active.join(incoming.select(*by), by, "left_semi").groupBy(*by).agg(F.min(F.struct("memory_id", "strength", "confidence", "old_tags")).alias("old"))
    m = incoming.join(old, by, "left")
    merged = F.col("old").isNotNull()
    none = F.array().cast("array<string>")
    lowered = F.filter(F.transform(F.coalesce("old.old_tags", none), lambda x: T.folded(x)), lambda x: x != "")
    written = m.select(
        F.when(merged, F.col("old.memory_id")).otherwise(F.col("first")).alias("memory_id"),
        "user_id",
        "channel",
        F.greatest(F.coalesce("old.strength", F.lit(0.0)), F.lit(NEW["strength"])).alias("strength"),
        F.greatest(F.coalesce("old.confidence", F.lit(0.0)), F.lit(NEW["confidence"])).alias("confidence"),
        F.lit(now_ms).cast("long").alias("last_accessed_ms"),
        F.when(merged | (F.col("n") > 1), F.array_distinct(F.concat(lowered, F.coalesce("new_tags", none)))).otherwise(F.col("given")).alias("tags"),
        F.when(merged, "merged").otherwise("inserted").alias("action"),
    )
    nothing = F.lit(None)
    blocked = shown.where("threat IS NOT NULL").select("memory_id", "user_id", "channel", nothing.cast("double").alias("strength"), nothing.cast("double").alias("confidence"), nothing.cast("long").alias("last_accessed_ms"), "tags", F.lit("blocked").alias("action"))
    return written.unionByName(blocked)


def forgotten(memories: DataFrame, asked: DataFrame, now_ms: int) -> DataFrame:
    """memories with ``archived_ms``, after asked rows (memory_id, user_id, permanent): their owner's are archived or, if permanent, gone."""
    hit = asked.groupBy("memory_id", "user_id").agg(F.max("permanent").alias("asked_permanent"))
    m = memories.join(hit, ["memory_id", "user_id"], "left").where(~F.coalesce("asked_permanent", F.lit(False)))
    was = F.col("asked_permanent").isNotNull()
    return m.withColumn("archived_ms", F.when(was, F.lit(now_ms).cast("long"))).select(*[(F.col(c) | was).alias(c) if c == "archived" else F.col(c) for c in memories.columns], "archived_ms")


def consolidated(memories: DataFrame, made: DataFrame) -> DataFrame:
    """memories plus ``made`` rows (the columns of memories, and ``sources``), unless their text holds a threat; the sources of those added are archived."""
    good = made.where(scanned(F.col("content")).isNull())
    gone = good.select(F.explode("sources").alias("memory_id")).distinct().withColumn("was_source", F.lit(True))
    old = memories.join(gone, "memory_id", "left").select(*[(F.col(c) | F.col("was_source").isNotNull()).alias(c) if c == "archived" else F.col(c) for c in memories.columns])
    return old.unionByName(good.select(*memories.columns))


def not_shown(results: DataFrame, shown: DataFrame) -> DataFrame:
    """Results whose memory the session hasn't seen; the limit has been applied before, so fewer may be left."""
    return results.join(shown.select("memory_id"), "memory_id", "left_anti")


def in_channel(rows: DataFrame, channel: str | None) -> DataFrame:
    """Rows of a channel; without one, all."""
    return rows if channel is None else rows.where(F.col("channel") == channel)


def in_cleanup_scope(messages: DataFrame, channel: str | None = None, session_key: str | None = None, since_ms: int | None = None, before_ms: int | None = None) -> DataFrame:
    """Messages of a channel or of a session, not both, within both bounds; blank names count as none."""
    channel, session_key = ((x or "").strip() or None for x in (channel, session_key))
    if channel and session_key:
        raise ValueError("channel or session_key, not both")
    if channel or session_key:
        messages = messages.where(F.col("channel") == channel if channel else F.col("session_key").cast("string") == session_key)
    if since_ms is not None:
        messages = messages.where(F.col("ts") >= since_ms)
    return messages if before_ms is None else messages.where(F.col("ts") <= before_ms)


def loggable(messages: DataFrame) -> DataFrame:
    """Messages as they are logged: users' lose recalled context, and those with nothing else or a broken block are skipped."""
    user = F.col("role") == "user"
    said = messages.withColumn("said", stripped(F.when(user, F.col("content"))))
    kept = said.where(~user | (~F.col("said.malformed") & (T.trim(F.col("said.content")) != "")))
    return kept.withColumn("content", F.when(user, F.col("said.content")).otherwise(F.col("content"))).drop("said")


def cron_or_isolated(session_key: Column, target: Column) -> Column:
    """Whether a named session is a scheduled one or has a target of its own."""
    key = F.coalesce(session_key, F.lit(""))
    return (key != "") & (F.contains(key, F.lit(":cron:")) | F.coalesce(target == "isolated", F.lit(False)))


def continuous(results: DataFrame, by: list[str], *order: Column, most: int = 5) -> DataFrame:
    """Of each ``by`` the first rows that are of a knowledge base or continue the session (``continuity`` isn't 0)."""
    w = Window.partitionBy(*by).orderBy(*order)
    kept = results.where(F.col("kb_id").isNotNull() | F.coalesce(F.col("continuity") != 0, F.lit(True)))
    return kept.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def paced(rows: DataFrame, wait_ms: int, ts: str = "ts", id_col: str = "event_id") -> DataFrame:
    """rows with ``passes``: of each user the first, and each that comes ``wait_ms`` or more after the last that passed; ``suppressed``: those held back before it."""
    limited = fixed_window_limit(rows, 1, wait_ms, inclusive=True, ts=ts, id_col=id_col)
    w = Window.partitionBy("user_id").orderBy(ts, id_col)
    since = F.when(F.col("nth") == 1, F.coalesce(F.lag("nth").over(w), F.lit(1)) - 1)
    return limited.withColumn("suppressed", since).withColumn("passes", F.col("nth") == 1).drop("window_start", "nth", "allowed")


def attributed(rows: DataFrame, consumes: Column, counts: Column, amount: Column, ts: str = "ts", id_col: str = "event_id") -> DataFrame:
    """For each row that ``consumes``: how many rows of its user counted since the one before it, and their whole amounts."""
    before = Window.partitionBy("user_id").orderBy(ts, id_col).rowsBetween(Window.unboundedPreceding, -1)
    r = rows.select("user_id", id_col, consumes.alias("consumes"), counts.alias("counts"), F.greatest(F.lit(0), F.floor(amount)).cast("long").alias("amount"), ts).where("consumes OR counts")
    r = r.withColumn("turn", F.coalesce(F.sum(F.col("consumes").cast("long")).over(before), F.lit(0)))
    by_turn = r.groupBy("user_id", "turn").agg(F.max(F.when(F.col("consumes"), F.col(id_col))).alias(id_col), F.count_if("counts").alias("invoked"), F.coalesce(F.sum(F.when(F.col("counts"), F.col("amount"))), F.lit(0)).alias("reclaimed"))
    return by_turn.where(F.col(id_col).isNotNull()).select("user_id", id_col, "invoked", "reclaimed")


def idle_sessions(messages: DataFrame, now_ms: int, most_ms: int) -> DataFrame:
    """(session_key, last_ms) of sessions whose last message is longer ago."""
    return messages.groupBy("session_key").agg(F.max("ts").alias("last_ms")).where(F.lit(now_ms) - F.col("last_ms") > most_ms)


def without_recent_resonance(clusters: DataFrame, traces: DataFrame, since_ms: int, key: str = "cluster") -> DataFrame:
    """Clusters (user_id, key) that have no resonance trace which expires after ``since_ms``."""
    recent = traces.where((F.col("trace_type") == "resonance") & (F.col("expires_ms") > since_ms)).select("user_id", key)
    return clusters.join(recent, ["user_id", key], "left_anti")


def worth_checking(similarity: Column, differ: Column, low: float = 0.7, high: float = 0.9, bypass: float = 0.55) -> Column:
    """Whether a pair is looked at for contradiction: alike but not equal, or less alike with other facts."""
    return similarity.between(low, high) | (differ & (similarity >= bypass))
