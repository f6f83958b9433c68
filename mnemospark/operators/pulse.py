"""Pulses of conversations: what is being talked about is matched with memories, and a model's predictions become traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import jsonx as J
from mnemospark.functions import text as T
from mnemospark.operators.capture import paced
from mnemospark.operators.common import checkpoint, latest, sifted
from mnemospark.operators.enrich import plain_json
from mnemospark.sources.tables import DAY_MS, HOUR_MS, MINUTE_MS

#: Between two pulses of a user; messages and letters shown; user messages and letters that topics are taken from; days and number of memories looked at; related ones that count, name topics and are kept warm.
COOLDOWN_MS, SHOWN, SHOWN_CHARS, ASKED, ASKED_CHARS, RECENT_MS, LOOKED, RELATED, NAMED, WARM, WARM_MS = MINUTE_MS, 20, 300, 3, 200, 7 * DAY_MS, 100, 15, 5, 10, 30 * MINUTE_MS
#: Newest memories of a pulse that are searched first; newest pulses of a user that are matched first.
FIRST, NEWEST = 32, 8
KINDS = ("query", "context", "followup", "resonance", "warning")
_SCHEMA = "struct<predictedQuery:string,predictedContext:string,documentDescription:string,traceType:string,confidence:double,ttlHours:double,sourcePattern:string>"


def admitted(pulses: DataFrame, enabled: DataFrame) -> DataFrame:
    """pulses (pulse_id, user_id, ts, ..) with ``status``: ok, disabled (no row in ``enabled``), or limited: within COOLDOWN_MS of the user's last one that passed."""
    known = pulses.join(enabled.select("user_id").distinct().withColumn("on", F.lit(True)), "user_id", "left")
    on = known.where("on").drop("on")
    passed = paced(on, COOLDOWN_MS, ts="ts", id_col="pulse_id").select(*on.columns, F.when(F.col("passes"), "ok").otherwise("limited").alias("status"))
    return passed.unionByName(known.where("on IS NULL").drop("on").withColumn("status", F.lit("disabled")))


def related(pulses: DataFrame, messages: DataFrame, memories: DataFrame) -> DataFrame:
    """(pulse_id, summary, memory_ids, topics) of each pulse (pulse_id, user_id, session_key, ts): see ``told`` and ``matched``."""
    none = F.array().cast("array<bigint>")
    both = pulses.select("pulse_id").join(told(pulses, messages), "pulse_id", "left").join(matched(pulses, messages, memories), "pulse_id", "left")
    return both.select("pulse_id", F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("memory_ids", none).alias("memory_ids"), F.coalesce("topics", F.array().cast("array<string>")).alias("topics"))


def _said(pulses: DataFrame, messages: DataFrame, most: int, text: Column) -> DataFrame:
    """(pulse_id, said): the texts of the session's last messages up to each pulse, oldest first."""
    lines = latest(pulses, messages.select("session_key", "message_id", F.col("ts").alias("sent"), text.alias("t")), "session_key", most, "pulse_id", "ts", "sent", "message_id", ("t",))
    return lines.groupBy("pulse_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("place")).alias("o"), "t"))).alias("x")).select("pulse_id", F.transform("x", lambda x: x["t"]).alias("said"))


def told(pulses: DataFrame, messages: DataFrame) -> DataFrame:
    """(pulse_id, summary): the session's last SHOWN messages up to each pulse, each cut."""
    return _said(pulses, messages, SHOWN, F.concat("role", F.lit(": "), T.cut(F.col("content"), SHOWN_CHARS))).select("pulse_id", F.array_join("said", "\n").alias("summary"))


def matched(pulses: DataFrame, messages: DataFrame, memories: DataFrame) -> DataFrame:
    """(pulse_id, memory_ids, topics) of each pulse (pulse_id, user_id, session_key, ts) that has related memories.

    Topics words are those of over three letters in the last ASKED users' messages; related are, newest first, at most RELATED of the
    user's LOOKED newest active memories of RECENT_MS before the pulse whose title or text contains one; topics are the first two
    tags, or the title, of the first NAMED of them, each once, ten at most.

    The newest memories of a pulse are found on ids.  Their texts are searched in two rounds: the FIRST
    newest of each pulse, then the rest of those pulses that haven't RELATED yet.
    """
    asked = _said(pulses, messages.where("role = 'user'"), ASKED, F.substring("content", 1, ASKED_CHARS)).select("pulse_id", F.array_join("said", " ").alias("asked"))
    words = F.array_distinct(F.filter(F.split(F.lower("asked"), T.SPACE + "+"), lambda w: F.length(w) > 3))
    # Short ones are found sooner.
    words = F.transform(F.array_sort(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), lambda x: x["w"])
    topics = checkpoint(asked.select("pulse_id", words.alias("words")).where("size(words) > 0"))

    active = memories.where("NOT archived")
    near = latest(pulses.select("pulse_id", "user_id", "ts").join(topics.select("pulse_id"), "pulse_id", "left_semi"), active.select("user_id", "memory_id", "created_ms"), "user_id", LOOKED, "pulse_id", "ts", "created_ms", "memory_id")
    near = checkpoint(near.where(F.col("created_ms") >= F.col("ts") - RECENT_MS).select("pulse_id", "memory_id", "place"))
    names = F.when(F.size("tags") > 0, F.slice("tags", 1, 2)).otherwise(F.array(F.substring("title", 1, 50)))

    def hits(pairs: DataFrame) -> DataFrame:
        texts = sifted(active, "memory_id", pairs.select("memory_id")).select("memory_id", names.alias("names"), F.lower(F.concat_ws(" ", "title", "content")).alias("low"))
        found = pairs.join(topics, "pulse_id").join(texts, "memory_id").where(F.exists("words", lambda w: F.contains(F.col("low"), w)))
        return checkpoint(found.select("pulse_id", "place", "memory_id", "names"))

    first = hits(near.where(F.col("place") <= FIRST))
    full = first.groupBy("pulse_id").count().where(F.col("count") >= RELATED).select("pulse_id")
    every = first.unionByName(hits(near.where(F.col("place") > FIRST).join(full, "pulse_id", "left_anti")))
    found = every.groupBy("pulse_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("place", "memory_id", "names"))), 1, RELATED).alias("x"))
    return found.select("pulse_id", F.transform("x", lambda x: x["memory_id"]).alias("memory_ids"), F.slice(F.array_distinct(F.flatten(F.transform(F.slice("x", 1, NAMED), lambda x: x["names"]))), 1, 10).alias("topics"))


def predicted(pulses: DataFrame, answers: DataFrame, found: DataFrame) -> DataFrame:
    """(pulse_id, user_id, place, predicted_query, predicted_context, trace_type, confidence, expires_ms, pattern, memory_ids): the traces of admitted pulses.

    pulses (pulse_id, user_id, ts, intent, channel); answers (pulse_id, answer: JSON text, an array or
    one under traces or predictions); found as ``matched`` gives it.
    """
    rows = pulses.join(answers, "pulse_id").select("pulse_id", "user_id", "ts", "intent", "channel", F.posexplode(J.payload_rows(plain_json(F.col("answer")), _SCHEMA, ("traces", "predictions"))).alias("place", "x"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    kind = F.when(F.col("x.traceType").isin(*KINDS), F.col("x.traceType")).otherwise("query")
    hours = F.greatest(F.lit(1.0), F.least(F.lit(72.0), F.coalesce("x.ttlHours", F.lit(24.0))))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("x.confidence", F.lit(0.5))))
    pattern = F.concat(F.lit("conversation_pulse"), blank(F.concat(F.lit(":"), "channel")), blank(F.concat(F.lit(" ["), "intent", F.lit("]"))), F.lit(": "), F.coalesce(F.nullif(F.col("x.sourcePattern"), F.lit("")), F.lit("unknown")))
    rows = rows.select("pulse_id", "user_id", "place", blank(F.col("x.predictedQuery")).alias("predicted_query"), blank(F.col("x.predictedContext")).alias("predicted_context"), kind.alias("trace_type"), sure.alias("confidence"), (F.col("ts") + (hours * HOUR_MS).cast("long")).alias("expires_ms"), pattern.alias("pattern"))
    ids = F.coalesce("memory_ids", F.array().cast("array<bigint>"))
    return rows.join(found.select("pulse_id", "memory_ids"), "pulse_id", "left").withColumn("memory_ids", ids)


def warmed(pulses: DataFrame, found: DataFrame) -> DataFrame:
    """(user_id, memory_ids, expires_ms): what each user's last pulse with related memories keeps warm, WARM ids for WARM_MS."""
    rows = pulses.select("pulse_id", "user_id", "ts").join(found.where("size(memory_ids) > 0").select("pulse_id", "memory_ids"), "pulse_id")
    return rows.groupBy("user_id").agg(F.max(F.struct("ts", "pulse_id", F.slice("memory_ids", 1, WARM).alias("ids"))).alias("x")).select("user_id", F.col("x.ids").alias("memory_ids"), (F.col("x.ts") + WARM_MS).alias("expires_ms"))


def kept_warm(pulses: DataFrame, messages: DataFrame, memories: DataFrame) -> DataFrame:
    """What ``warmed`` gives for all pulses and their related memories.

    Only a user's last pulse with related memories counts: each user's newest pulses are matched first,
    and only of users without any such among these the others, in rounds of more and more.
    """
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("pulse_id"))
    left = checkpoint(pulses.select("pulse_id", "user_id", "session_key", "ts").withColumn("nth", F.row_number().over(newest)))
    out, most = None, NEWEST
    while True:
        now = left.where(F.col("nth") <= most)
        warm = checkpoint(warmed(now, matched(now, messages, memories)))
        out = warm if out is None else out.unionByName(warm)
        left = checkpoint(left.where(F.col("nth") > most).join(warm.select("user_id"), left["user_id"].eqNullSafe(warm["user_id"]), "left_anti"))
        if not left.take(1):
            return out
        most *= 64
