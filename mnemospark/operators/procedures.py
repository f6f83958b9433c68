"""Procedures found in memories: a model's patterns are merged into the procedure they resemble, or become new ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import jsonx as J
from mnemospark.functions import text as T
from mnemospark.operators.common import best_per, top_per

#: Memories shown to the model, patterns taken a user, observations and sources that one needs.
SHOWN, TAKEN, LEAST_SEEN, LEAST_SOURCES = 60, 1, 2, 2
#: Shares of words in common over which a title or a content is the same.
SAME_TITLE, SAME_CONTENT = 0.8, 0.6
#: Kinds of patterns, tags of their own, heads of the sections of their text.
KINDS = ("workflow", "problem_solving", "decision_chain")
TAGS = ("organic", "auto-extracted")
HEADS = ("Trigger conditions", "Steps", "Pitfalls", "Verification")
_STEP = "struct<order:double,action:string,command:string>"
_SCHEMA = f"struct<title:string,content:string,sourceMemoryIndices:array<double>,patternType:string,observationCount:double,triggerConditions:array<string>,steps:array<{_STEP}>,pitfalls:array<string>,verification:string>"


def _texts(c: Column, most: int | None = 8) -> Column:
    kept = F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), T.trim), lambda x: x != "")
    return F.slice(kept, 1, most) if most else F.array_distinct(kept)


def _steps(c: Column, most: int = 12) -> Column:
    """(order, action, command) in order; steps without action go, a missing order is the place."""
    own = F.transform(F.coalesce(c, F.array().cast(f"array<{_STEP}>")), lambda s, i: F.struct(F.coalesce(s["order"], (i + 1).cast("double")).alias("order"), i.alias("i"), T.trim(s["action"]).alias("action"), F.nullif(T.trim(s["command"]), F.lit("")).alias("command")))
    return F.slice(F.transform(F.array_sort(F.filter(own, lambda s: s["action"] != "")), lambda s: F.struct(s["action"].alias("action"), s["command"].alias("command"))), 1, most)


def shown(memories: DataFrame, since_ms: int, most: int = SHOWN) -> DataFrame:
    """(user_id, i, memory_id): the newest memories of each user that a model is shown, numbered from 0; neither prospective nor procedural ones."""
    rows = memories.where((F.col("created_ms") >= since_ms) & ~F.col("archived") & ~F.col("store").isin("prospective", "procedural"))
    w = Window.partitionBy("user_id").orderBy(F.desc("created_ms"), F.asc("memory_id"))
    return rows.select("user_id", "memory_id", (F.row_number().over(w) - 1).alias("i")).where(F.col("i") < most)


def patterns(answers: DataFrame, of: DataFrame, taken: int = TAKEN) -> DataFrame:
    """One row for each pattern that is taken from answers (user_id, answer: JSON text): an array, or an object with it under patterns, procedures, workflows or results.

    Patterns need a title and a content, LEAST_SEEN observations and LEAST_SOURCES
    sources among those shown (``of``, see ``shown``); of each user the first ``taken`` that have the observations are looked at.
    """
    rows = answers.select("user_id", F.posexplode(J.payload_rows(F.col("answer"), _SCHEMA, ("patterns", "procedures", "workflows", "results"))).alias("place", "x"))
    rows = rows.where("x.title IS NOT NULL AND x.content IS NOT NULL").withColumn("seen", F.coalesce("x.observationCount", F.lit(1.0)))
    rows = top_per(rows.where(F.col("seen") >= LEAST_SEEN), ["user_id"], taken, F.asc("place"))
    kind = F.when(F.col("x.patternType").isin(*KINDS), F.col("x.patternType")).otherwise("workflow")
    cells = rows.select("user_id", "place", F.posexplode("x.sourceMemoryIndices").alias("at", "i"))
    found = cells.join(of, (cells["user_id"] == of["user_id"]) & (cells["i"] == of["i"])).select(cells["user_id"], "place", F.struct("at", "memory_id").alias("s"))
    sources = found.groupBy("user_id", "place").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["memory_id"]).alias("sources"))  # of the few that are shown
    rows = rows.join(sources, ["user_id", "place"]).where(F.size("sources") >= LEAST_SOURCES)
    tags = F.concat(F.array(*[F.lit(x) for x in TAGS], F.concat(F.lit("pattern:"), kind)), F.transform("sources", lambda s: F.concat(F.lit("source:"), s.cast("string"))))
    confidence = F.when(F.col("seen") >= 5, 0.9).when(F.col("seen") >= 2, 0.7).otherwise(0.5)
    own = F.greatest(F.lit(1.0), F.col("seen"), F.size("sources").cast("double"))
    return rows.select(
        "user_id", "place", F.col("x.title").alias("title"), F.col("x.content").alias("content"), kind.alias("kind"), "seen", own.alias("observations"), confidence.alias("confidence"), "sources", tags.alias("tags"),
        _texts(F.col("x.triggerConditions")).alias("triggers"), _steps(F.col("x.steps")).alias("steps"), _texts(F.col("x.pitfalls")).alias("pitfalls"), T.trim(F.col("x.verification")).alias("verification"),
    )


def resembling(found: DataFrame, known: DataFrame, title: float = SAME_TITLE, content: float = SAME_CONTENT) -> DataFrame:
    """(user_id, place, memory_id): for each pattern the first procedure of its user, by id, that it resembles.

    Alike are over ``title`` of the distinct words of both titles, or over ``content`` of the
    words of the longer content (a word of the pattern counts as often as it comes); words have
    more than three letters, and titles without any resemble none.  Words meet by (user, word), so no pattern is held against procedures
    that share nothing with it.
    """

    def long_words(c: str) -> Column:
        return F.filter(F.split(F.lower(T.trim(F.col(c))), T.SPACE + "+"), lambda w: F.length(w) > 3)

    a = found.select("user_id", "place", F.array_distinct(long_words("title")).alias("titled"), long_words("content").alias("said")).where("size(titled) > 0")
    b = known.select("user_id", "memory_id", F.array_distinct(long_words("title")).alias("titled"), long_words("content").alias("said")).where("size(titled) > 0")
    sizes_a = a.select("user_id", "place", F.size("titled").alias("ta"), F.size("said").alias("sa"))
    sizes_b = b.select("user_id", "memory_id", F.size("titled").alias("tb"), F.size("said").alias("sb"))

    def shared(col: str, name: str) -> DataFrame:
        x = a.select("user_id", "place", F.explode(col).alias("w")).groupBy("user_id", "place", "w").agg(F.count(F.lit(1)).alias("n"))
        y = b.select("user_id", "memory_id", F.explode(F.array_distinct(col)).alias("w"))
        return x.join(y, ["user_id", "w"]).groupBy("user_id", "place", "memory_id").agg(F.sum("n").alias(name))

    pairs = shared("titled", "t").join(shared("said", "s"), ["user_id", "place", "memory_id"], "full").join(sizes_a, ["user_id", "place"]).join(sizes_b, ["user_id", "memory_id"])
    same = F.coalesce(F.col("t") / (F.col("ta") + F.col("tb") - F.col("t")) > title, F.lit(False)) | F.coalesce(F.col("s") / F.greatest("sa", "sb") > content, F.lit(False))
    return best_per(pairs.where(same), ["user_id", "place"], F.asc("memory_id")).select("user_id", "place", "memory_id")


def _skill(title: Column, content: Column, kind: Column, observations: Column, triggers: Column, steps: Column, pitfalls: Column, verification: Column, now_ms: int) -> Column:
    return F.struct(title.alias("title"), content.alias("content"), F.to_json(F.struct(F.lit(True).alias("skillFormat"), triggers.alias("triggerConditions"), steps.alias("steps"), pitfalls.alias("pitfalls"), verification.alias("verification"), kind.alias("patternType"), observations.cast("long").alias("observationCount"), F.lit(now_ms).alias("lastObserved"))).alias("metadata"))


def procedure_text(content: Column, triggers: Column, steps: Column, pitfalls: Column, verification: Column) -> Column:
    """What a person reads: the summary, then sections for triggers, numbered steps, pitfalls and verification, those that have something."""

    def listed(head: str, items: Column) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(f"{head}:\n"), F.array_join(items, "\n")))

    dashed = lambda c: F.transform(c, lambda x: F.concat(F.lit("- "), x))
    numbered = F.transform(steps, lambda s: F.concat(s["order"].cast("string"), F.lit(". "), s["action"], F.coalesce(F.concat(F.lit(" ("), s["command"], F.lit(")")), F.lit(""))))
    return F.concat_ws("\n\n", F.nullif(T.trim(content), F.lit("")), listed(HEADS[0], dashed(triggers)), listed(HEADS[1], numbered), listed(HEADS[2], dashed(pitfalls)), F.when(verification != "", F.concat(F.lit(f"{HEADS[3]}:\n"), verification)))


def upserted(found: DataFrame, known: DataFrame, now_ms: int) -> DataFrame:
    """(user_id, place, memory_id, action, title, content, metadata, confidence, strength, access_count, tags): what patterns write.

    known (memory_id, user_id, title, content, metadata, confidence, strength, access_count, tags) are the
    active procedures before the run: patterns of one run don't resemble each other.  A
    procedure that several patterns resemble is reinforced by each in turn: text and metadata are the last one's
    merged with what was stored, confidence is the largest, strength grows by a tenth each, tags add up.
    place is the (last) pattern's; memory_id is null for new ones.
    """
    hits = found.join(resembling(found, known), ["user_id", "place"], "left")
    none_text, none_steps = F.array().cast("array<string>"), F.array().cast("array<struct<action:string,command:string>>")
    fresh = hits.where("memory_id IS NULL")
    steps = J.merged_steps(none_steps, F.col("steps"))
    made = fresh.withColumn("w", _skill(F.substring("title", 1, 200), F.col("content"), F.col("kind"), F.col("observations"), _texts(F.col("triggers"), None), steps, _texts(F.col("pitfalls"), None), F.col("verification"), now_ms))
    out = ["user_id", "place", "memory_id", "action", "title", "content", "metadata", "confidence", "strength", "access_count", "tags"]
    made = made.select("user_id", "place", "memory_id", F.lit("create").alias("action"), "w.*", "confidence", F.lit(0.8).alias("strength"), F.lit(0).cast("long").alias("access_count"), "tags").select(*out)

    own = F.struct("place", *[c for c in found.columns if c not in ("user_id", "place")])
    turns = hits.where("memory_id IS NOT NULL").groupBy("user_id", "memory_id").agg(F.array_sort(F.collect_list(own)).alias("turns"))  # a few a user
    k = known.select("memory_id", "user_id", F.col("title").alias("old_title"), F.col("confidence").alias("old_confidence"), "strength", "access_count", F.coalesce("tags", none_text).alias("old_tags"), F.from_json("metadata", "triggerConditions array<string>, steps array<struct<action:string,command:string>>, pitfalls array<string>, verification string, observationCount double, skillFormat boolean").alias("m"))
    r = turns.join(k, ["user_id", "memory_id"]).withColumn("last", F.element_at("turns", -1))
    stored = F.coalesce(F.col("m.skillFormat"), F.lit(False))
    before = F.when(stored, F.coalesce(F.col("m.observationCount"), F.lit(0.0)))
    total = lambda turn: F.when(stored, F.greatest(before + F.greatest(F.lit(1.0), turn["seen"]), turn["observations"])).otherwise(turn["observations"])
    merged = lambda old, new: _texts(F.concat(F.when(stored, F.coalesce(old, none_text)).otherwise(none_text), new), None)
    last = F.col("last")
    triggers, pitfalls = merged(F.col("m.triggerConditions"), last["triggers"]), merged(F.col("m.pitfalls"), last["pitfalls"])
    steps = J.merged_steps(F.when(stored, F.coalesce(F.col("m.steps"), none_steps)).otherwise(none_steps), last["steps"])
    check = F.when((last["verification"] != "") | ~stored, last["verification"]).otherwise(F.coalesce("m.verification", F.lit("")))
    r = r.withColumn("w", _skill(F.when(last["kind"] == "workflow", F.substring(last["title"], 1, 200)).otherwise(F.col("old_title")), procedure_text(last["content"], triggers, steps, pitfalls, check), last["kind"], total(last), triggers, steps, pitfalls, check, now_ms))
    uses = F.aggregate("turns", F.col("access_count").cast("long"), lambda n, turn: F.greatest(n + 1, total(turn).cast("long")))
    r = r.select("user_id", last["place"].alias("place"), "memory_id", F.lit("reinforce").alias("action"), "w.*", F.greatest("old_confidence", F.array_max(F.transform("turns", lambda x: x["confidence"]))).alias("confidence"), F.round(F.least(F.lit(1.0), F.col("strength") + 0.1 * F.size("turns")), 6).alias("strength"), uses.alias("access_count"), F.array_distinct(F.concat("old_tags", F.flatten(F.transform("turns", lambda x: x["tags"])))).alias("tags")).select(*out)
    return made.unionByName(r)
