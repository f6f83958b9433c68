"""Evaluation of recall by what was used afterwards."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.scoring import WEIGHTS
from mnemospark.sources.tables import MINUTE_MS

SPAN_MS = 30 * MINUTE_MS


def within(logs: DataFrame, events: DataFrame, span_ms: int = SPAN_MS) -> DataFrame:
    """Pairs of a log row and an event of its user from its instant to span_ms later.

    A range join on a key: events stand in bins of one span, and a log row looks
    in its own and the next one; no nested loop.
    """
    e = events.select("user_id", "event_id", "event_type", "memory_id", "ts", F.floor(F.col("ts") / span_ms).alias("__bin"))
    first = F.floor(F.col("created_ms") / span_ms)
    l = logs.withColumn("__bin", F.explode(F.array(first, first + 1)))  # noqa: E741
    return l.join(e, ["user_id", "__bin"]).where(F.col("ts").between(F.col("created_ms"), F.col("created_ms") + span_ms)).drop("__bin")


def scored(samples: DataFrame) -> DataFrame:
    """samples (ranked, relevant: arrays) with hits, grounding, coverage and their mean; 0 without relevant ones."""
    hits = F.size(F.array_intersect("ranked", "relevant"))
    some = (F.size("ranked") > 0) & (F.size("relevant") > 0)
    s = samples.withColumn("hits", F.when(some, hits).otherwise(0).cast("long"))
    s = s.withColumn("grounding", F.when(some, F.round(F.col("hits") / F.size("ranked"), 6)).otherwise(0.0)).withColumn("coverage", F.when(some, F.round(F.col("hits") / F.size("relevant"), 6)).otherwise(0.0))
    return s.withColumn("composite", F.round((F.col("grounding") + F.col("coverage")) / 2, 6))


def samples(logs: DataFrame, events: DataFrame, span_ms: int = SPAN_MS) -> DataFrame:
    """Each log row that was followed by use: what was shown and, distinct, what was used."""
    used = within(logs.select("log_id", "user_id", "created_ms"), events, span_ms).groupBy("log_id").agg(F.collect_set("memory_id").alias("relevant"))
    return scored(logs.join(used, "log_id").select("log_id", "user_id", "created_ms", F.array_distinct("top_ids").alias("ranked"), "relevant"))


def report(found: DataFrame) -> DataFrame:
    """Means over the samples of each user."""
    return found.groupBy("user_id").agg(F.count(F.lit(1)).alias("samples"), *[F.round(F.avg(c), 6).alias(c) for c in ("grounding", "coverage", "composite")])


def followed_up(logs: DataFrame, events: DataFrame, span_ms: int = SPAN_MS) -> DataFrame:
    """Log rows after which one of the shown memories was recalled in time."""
    shown = logs.select("log_id", "user_id", "created_ms", F.explode(F.array_distinct("top_ids")).alias("shown"))
    hit = within(shown, events.where("event_type = 'memory_recalled'"), span_ms).where("shown = memory_id")
    return logs.join(hit.select("log_id").distinct(), "log_id", "left_semi")


def policy_scores(candidates: DataFrame, relevant: DataFrame, policies: Mapping[str, Mapping[str, float]], k: int = 3) -> DataFrame:
    """(policy, composite): logged candidates (log_id, memory_id and a column for each signal) ranked anew under each policy.

    The few policies are an array of structs that each row explodes; the rank is a
    window over (policy, log row).
    """
    one = lambda name, w: F.struct(F.lit(name).alias("policy"), F.round(sum((F.col(s) * F.lit(float({**WEIGHTS, **w}[s])) for s in WEIGHTS if s in candidates.columns), F.lit(0.0)), 6).alias("s"))
    c = candidates.select("log_id", "memory_id", F.explode(F.array(*[one(n, w) for n, w in policies.items()])).alias("x")).select("log_id", "memory_id", "x.*")
    w = Window.partitionBy("policy", "log_id").orderBy(F.desc("s"), "memory_id")
    ranked = c.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).groupBy("policy", "log_id").agg(F.collect_set("memory_id").alias("ranked"))
    return scored(ranked.join(relevant.select("log_id", "relevant"), "log_id")).groupBy("policy").agg(F.count(F.lit(1)).alias("samples"), F.round(F.avg("composite"), 6).alias("composite"))
