"""Ideas that a model finds in a user's changed ensembles and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import jsonx as J
from mnemospark.functions import text as T
from mnemospark.operators.common import top_per
from mnemospark.operators.enrich import plain_json
from mnemospark.sources.tables import DAY_MS

#: How many ideas a run may have and how sure they must be, by how often a user wants them; kinds of ideas.
FREQUENCIES = {"aggressive": (7, 0.2), "balanced": (5, 0.3), "conservative": (3, 0.45)}
KINDS = ("connection", "pattern", "contradiction_resolved", "insight", "action_suggested")
#: Least letters of title and summary; ideas of so long ago aren't told again.
TITLE, SUMMARY, RECENT_MS = 10, 30, DAY_MS
_SCHEMA = "struct<title:string,summary:string,ideaType:string,confidence:double,sourceMemoryIds:array<string>,sourceEnsembleIds:array<string>>"


def discovered(answers: DataFrame, changed: DataFrame, findings: DataFrame, ideas: DataFrame, now_ms: int) -> DataFrame:
    """(user_id, place, title, summary, idea_type, confidence, memory_ids, ensemble_ids): the ideas that are written, status pending_notification.

    answers (user_id, frequency, answer: JSON text); changed (user_id, ensemble_id, members: array of
    ids), the ensembles changed since the last run; findings (user_id, memory_id) of contradictions and resonances;
    ideas (user_id, title, created_ms).

    Users without changed ensembles or findings get none.  An idea needs a title, a summary, enough
    confidence for the user's frequency (balanced if it is none of FREQUENCIES) and a source; of those with one title (letters and digits without
    articles) the first counts, if none of the last day has it.  Of the first few that are left, those with a source among the
    user's changed ensembles and findings are written, with these sources only.
    """
    active = changed.select("user_id").union(findings.select("user_id")).distinct()
    limits = F.create_map(*[F.lit(x) for k, v in FREQUENCIES.items() for x in (k, float(v[0]))])
    least = F.create_map(*[F.lit(x) for k, v in FREQUENCIES.items() for x in (k, float(v[1]))])
    often = F.when(F.col("frequency").isin(*FREQUENCIES), F.col("frequency")).otherwise("balanced")
    a = answers.join(active, "user_id", "left_semi").withColumns({"most": limits[often], "least": least[often]})
    rows = a.select("user_id", "most", "least", F.posexplode(J.payload_rows(plain_json(F.col("answer")), _SCHEMA, ("ideas", "results", "items", "discoveries"))).alias("place", "x"))
    kind = F.when(F.col("x.ideaType").isin(*KINDS), F.col("x.ideaType")).otherwise("insight")
    rows = rows.select("user_id", "most", "least", "place", T.trim(F.col("x.title")).alias("title"), T.trim(F.col("x.summary")).alias("summary"), kind.alias("idea_type"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("x.confidence", F.lit(0.0)))).alias("confidence"), F.array_distinct(F.coalesce("x.sourceMemoryIds", F.array().cast("array<string>"))).alias("sources"), F.array_distinct(F.coalesce("x.sourceEnsembleIds", F.array().cast("array<string>"))).alias("ensembles"))
    rows = rows.where((F.length("title") >= TITLE) & (F.length("summary") >= SUMMARY) & (F.col("confidence") >= F.col("least")) & (F.size("sources") > 0)).withColumn("key", T.idea_title(F.col("title")))
    told = ideas.where(F.col("created_ms") >= now_ms - RECENT_MS).select("user_id", T.idea_title(F.col("title")).alias("key")).where("key != ''").distinct()
    fresh = rows.join(told, ["user_id", "key"], "left_anti")
    # Titles of signs alone are like no other.
    once = top_per(fresh.withColumn("like", F.when(F.col("key") != "", F.col("key")).otherwise(F.concat(F.lit("#"), F.col("place").cast("string")))), ["user_id", "like"], 1, F.asc("place"))
    taken = once.withColumn("nth", F.row_number().over(Window.partitionBy("user_id").orderBy("place"))).where(F.col("nth") <= F.col("most"))

    own = changed.select("user_id", F.explode("members").alias("id")).union(findings.select("user_id", "memory_id")).select("user_id", F.col("id").cast("string").alias("id")).distinct()
    known = changed.select("user_id", F.col("ensemble_id").cast("string").alias("id")).distinct()

    def valid(col: str, of: DataFrame, name: str) -> DataFrame:
        cells = taken.select("user_id", "place", F.posexplode(col).alias("i", "id")).join(of, ["user_id", "id"], "left_semi")
        return cells.groupBy("user_id", "place").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "id"))), lambda x: x["id"]).alias(name))  # what one idea lists

    out = taken.join(valid("sources", own, "memory_ids"), ["user_id", "place"]).join(valid("ensembles", known, "ensemble_ids"), ["user_id", "place"], "left")
    return out.select("user_id", "place", "title", "summary", "idea_type", "confidence", "memory_ids", "ensemble_ids")
