"""Reflection: what a model distils from a user's recent memories is written back as memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.functions.timeexpr import day_key
from mnemospark.operators.enrich import plain_json
from mnemospark.sources.tables import HOUR_MS

#: Hours looked back (0.5 to 72) and the fewest memories that are reflected on.
WINDOW_HOURS, LEAST = 4.0, 3
#: Fixed values of what an answer lists: field, store, category, title, strength, confidence, arousal and a tag of its own.
WRITTEN = (
    ("decisions", "episodic", "decision", "Decision: ", 0.85, 0.8, 0.2, None),
    ("lessons", "semantic", "lesson", "Lesson: ", 0.85, 0.8, 0.2, None),
    ("openLoops", "prospective", "goal", "Open loop: ", 0.75, 0.7, 0.3, "open-loop"),
)
_SCHEMA = "decisions array<string>, lessons array<string>, openLoops array<string>, summary string, tags array<string>"


def reflected(memories: DataFrame, answers: DataFrame, now_ms: int, window_hours: float = WINDOW_HOURS, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(rows, runs) of one reflection over all users.

    memories (memory_id, user_id, store, category, title, content, archived, created_ms); answers
    (user_id, answer: JSON text, perhaps in a code fence).

    rows (user_id, place, store, category, title, content, strength, confidence, arousal, tags): decisions,
    lessons and open loops that aren't blank, numbered as in the answer, and the summary; those that an active memory of
    the user has already (store, category, title and text) are left out.  runs (user_id, read, written,
    skipped): skipped says why nothing was done: too few memories in the window, an empty answer or one that is no JSON object.
    """
    hours = min(max(window_hours, 0.5), 72)
    active = memories.where("NOT archived")
    read = active.where(F.col("created_ms") >= now_ms - int(hours * HOUR_MS)).groupBy("user_id").agg(F.count(F.lit(1)).alias("read"))
    plain = plain_json(F.col("answer"))
    users = memories.select("user_id").distinct().join(read, "user_id", "left").join(answers, "user_id", "left").withColumn("read", F.coalesce("read", F.lit(0)))
    is_object = F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(plain)), F.lit("OBJECT")), F.lit(False))
    skipped = F.when(F.col("read") < least, "too few memories").when(T.trim(F.col("answer")) == "", "empty answer").when(~is_object, "no JSON")
    users = users.withColumn("skipped", skipped).withColumn("x", F.when(skipped.isNull(), F.from_json(plain, _SCHEMA)))
    good = users.where("skipped IS NULL")
    none = F.array().cast("array<string>")
    tags = F.concat(F.array(F.lit("reflection"), F.lit("distilled")), F.coalesce("x.tags", none))

    def numbers(strength: float, confidence: float, arousal: float) -> list[Column]:
        return [F.lit(strength).alias("strength"), F.lit(confidence).alias("confidence"), F.lit(arousal).alias("arousal")]

    parts = []
    for field, store, category, head, strength, confidence, arousal, tag in WRITTEN:
        own = good.select("user_id", tags.alias("tags"), F.posexplode(f"x.{field}").alias("place", "said")).where(T.trim(F.col("said")) != "")
        mine = F.concat("tags", F.array(F.lit(tag))) if tag else F.col("tags")
        parts.append(own.select("user_id", "place", F.lit(store).alias("store"), F.lit(category).alias("category"), F.concat(F.lit(head), F.substring("said", 1, 80)).alias("title"), F.col("said").alias("content"), *numbers(strength, confidence, arousal), mine.alias("tags")))
    summary = good.withColumn("said", T.trim(F.col("x.summary"))).where("said != ''")
    parts.append(summary.select("user_id", F.lit(0).alias("place"), F.lit("episodic").alias("store"), F.lit("conversation").alias("category"), F.concat(F.lit("Reflection summary: "), day_key(F.lit(now_ms))).alias("title"), F.col("said").alias("content"), *numbers(0.8, 0.75, 0.2), tags.alias("tags")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    known = active.select("user_id", "store", "category", "title", T.memory_hash(F.col("store"), F.col("category"), F.col("content")).alias("hash"))
    rows = rows.withColumn("hash", T.memory_hash(F.col("store"), F.col("category"), F.col("content"))).join(known, ["user_id", "store", "category", "title", "hash"], "left_anti").drop("hash")
    written = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("written"))
    runs = users.join(written, "user_id", "left").select("user_id", "read", F.coalesce("written", F.lit(0)).alias("written"), "skipped")
    return rows, runs
