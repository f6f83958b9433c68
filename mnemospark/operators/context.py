"""What a session's prompts are given before a model sees them: sections of memory under one budget of characters, for all prompts at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions import scoring as S
from mnemospark.functions import text as T
from mnemospark.operators.common import top_per
from mnemospark.operators.gates import wants_evidence
from mnemospark.operators.windows import dropped_sections

#: Labels of sections, those that are dropped first in front.
DROPPED = ("Relevant Skills", "Memory Discovery", "Preamble", "Relevant Recall")
#: Shown memories, messages, ideas and skills; least confidence of an idea; letters of a briefing, a title, a memory, an idea, a message, a prompt.
HITS, MATCHES, IDEAS, SKILLS, SURE = 2, 2, 3, 3, 0.5
BRIEFING, TITLE, CONTENT, SUMMARY, LINE, ASKED = 240, 120, 600, 2000, 220, 180
#: What blocks and sections are made of.
BLOCK_HEAD, BLOCK_END = "--- Memory [", "--- End Memory ---"
IDEAS_HEAD = "--- Memory Discovery ---\nWhile you were away, your memory discovered:\n\n"
IDEAS_END = "\n\n(Respond naturally -- reference this if relevant to the conversation)\n--- End Discovery ---"
EVIDENCE_HEAD, EVIDENCE_LINES, EVIDENCE_LAST = "## Relevant Memory Evidence\nQuestion: ", "Recent message evidence:\n", "Recent context: "
SKILLS_HEAD, SKILLS_END = "## Relevant Skills\n", "\n\nApply these skills if they fit the current task."
EVIDENCE_END = "Search messages for exact wording and memories for broader lookup."


def _clean(c: Column, most: int) -> Column:
    return T.snippet(T.sanitised(c), most)


def _block(name: Column, *lines: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit(BLOCK_HEAD), name, F.lit("] ---")), *lines, F.lit(BLOCK_END))


def memory_block(id_: Column, store: Column, category: Column, title: Column, content: Column, score: Column) -> Column:
    """A memory as a prompt shows it: kind and confidence, title, and the beginning of its text without what poses as another role."""
    said = F.substring(T.sanitised(content), 1, CONTENT)
    kind = F.concat(F.lit("Type: "), F.coalesce(store, F.lit("?")), F.lit("/"), F.coalesce(category, F.lit("?")), T.confidence_label(score))
    return _block(id_.cast("string"), kind, F.concat(F.lit("Title: "), _clean(F.coalesce(title, F.lit("Untitled")), TITLE)), F.when(said != "", F.concat(F.lit("Content: "), said)))


def _joined(rows: DataFrame, by: str, order: str, text: Column, name: str, most: int) -> DataFrame:
    """(by, name: texts of the first ``most`` rows in order)."""
    first = top_per(rows, [by], most, F.asc(order)).select(by, F.struct(F.col(order).alias("o"), text.alias("t")).alias("x"))
    return first.groupBy(by).agg(F.array_sort(F.collect_list("x")).alias("x")).select(by, F.transform("x", lambda x: x["t"]).alias(name))


def built(prompts: DataFrame, preamble: str, tools: str, briefings: DataFrame, ideas: DataFrame, hits: DataFrame, matches: DataFrame, recent: DataFrame, skills: DataFrame) -> DataFrame:
    """(prompt_id, budget, chars, labels, text): the context of each prompt, labels those of the sections that are left.

    prompts (prompt_id, session_key, user_id, prompt, first, cron, effective_tokens, share); briefings
    (session_key, briefing); ideas (user_id, rank, idea_id, title, summary, confidence, sources); hits and skills
    (prompt_id, rank, memory_id, store, block, kb_id, continuity), block as memory_block() makes it, matches and recent (prompt_id, rank, role, content, ts).

    Sections come in this order: preamble, for first prompts tools and briefing, ideas, evidence, skills;
    scheduled sessions (cron) get the last two only, and no messages.  Evidence holds
    the best memories, for prompts that ask for the past also messages, and the last message where
    either is missing; of hits, those that are neither of a knowledge base nor continue the session (continuity 0) don't count.
    Skills are for prompts that are commands or ask for a way to do something.  Where all is longer than the budget, whole sections go, lowest
    label first and its last section first: sums over (label, place) say which, in one window a prompt.
    """
    p = prompts.withColumn("asked", T.trim(F.col("prompt"))).withColumn("intent", T.intent(F.col("prompt")))
    long = F.length("asked") >= 5
    head = F.concat(F.lit("Prompt: "), T.snippet(F.col("asked"), ASKED))

    def section(rows: DataFrame, ordinal: int, label: str, text: Column) -> DataFrame:
        return rows.select("prompt_id", F.lit(ordinal).alias("ordinal"), F.lit(label).alias("label"), text.alias("text")).where("text != ''")

    shown = p.where("NOT cron")
    parts = [section(shown, 0, "Preamble", F.lit(preamble)), section(shown.where("first"), 1, "Preamble", F.lit(tools))]
    woken = shown.where("first").join(briefings, "session_key")
    parts.append(section(woken, 2, "Preamble", _clean(F.col("briefing"), BRIEFING)))

    idea = _block(F.concat(F.lit("idea:"), F.col("idea_id").cast("string")), F.concat(F.lit("Title: "), _clean(F.coalesce("title", F.lit("Untitled discovery")), TITLE)), F.concat(F.lit("Content: "), _clean(F.coalesce("summary", F.lit("")), SUMMARY)), F.concat(F.lit("Source: Based on "), F.when(F.col("sources") > 0, F.col("sources").cast("string")).otherwise("multiple"), F.lit(" connected memories")))
    told = _joined(ideas.where(F.col("confidence") > SURE), "user_id", "rank", idea, "ideas", IDEAS)
    discovery = F.concat(F.lit(IDEAS_HEAD), F.array_join("ideas", "\n"), F.lit(IDEAS_END))
    parts.append(section(shown.join(told, "user_id"), 3, "Memory Discovery", discovery))

    def blocks(rows: DataFrame, name: str, most: int) -> DataFrame:
        return _joined(rows, "prompt_id", "rank", F.col("block"), name, most)

    counted = hits.where(F.col("kb_id").isNotNull() | F.coalesce(F.col("continuity") != 0, F.lit(True)))
    stamp = F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd HH:mm")
    line = F.concat(F.lit("- ["), F.coalesce("role", F.lit("?")), F.lit("] "), _clean(F.coalesce("content", F.lit("")), LINE), F.lit(" ("), F.coalesce(stamp, F.lit("unknown")), F.lit(")"))
    past = ~F.col("cron") & ((F.col("intent") == "recall") | wants_evidence(F.col("asked")))
    e = p.where(long).withColumn("past", past)
    e = e.join(blocks(counted, "memories", HITS), "prompt_id", "left").join(_joined(matches, "prompt_id", "rank", line, "lines", MATCHES), "prompt_id", "left")
    e = e.join(_joined(recent, "prompt_id", "rank", _clean(F.coalesce("content", F.lit("")), ASKED), "lasts", 1), "prompt_id", "left")
    lines = F.when(F.col("past"), F.col("lines"))
    last = F.when(F.col("past") & (F.col("memories").isNull() | F.col("lines").isNull()), F.col("lasts")[0])
    e = e.where(F.col("memories").isNotNull() | lines.isNotNull() | last.isNotNull())
    evidence = F.concat_ws(
        "\n",
        F.concat(F.lit(EVIDENCE_HEAD), T.snippet(F.col("asked"), ASKED), F.lit("\n")),
        F.concat(F.array_join("memories", "\n"), F.lit("\n")),
        F.concat(F.lit(EVIDENCE_LINES), F.array_join(lines, "\n"), F.lit("\n")),
        F.when(last != "", F.concat(F.lit(EVIDENCE_LAST), last, F.lit("\n"))),
        F.lit(EVIDENCE_END),
    )
    parts.append(section(e, 4, "Relevant Recall", evidence))

    able = p.where(long & F.col("intent").isin("command", "workflow")).join(blocks(skills.where("store = 'procedural'"), "skills", SKILLS), "prompt_id")
    parts.append(section(able, 5, "Relevant Skills", F.concat(F.lit(SKILLS_HEAD), head, F.lit("\n"), F.array_join("skills", "\n"), F.lit(SKILLS_END))))

    budget = S.injection_budget(F.col("effective_tokens"), F.col("share"))
    every = reduce(DataFrame.unionByName, parts).withColumn("size", F.length("text")).join(p.select("prompt_id", budget.cast("long").alias("budget")), "prompt_id")
    left = dropped_sections(every, ["prompt_id"], "budget", list(DROPPED))
    whole = left.groupBy("prompt_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "label", "text"))).alias("x"))
    whole = p.select("prompt_id", budget.cast("long").alias("budget")).join(whole, "prompt_id", "left")
    text = T.trim(F.array_join(F.transform("x", lambda x: x["text"]), "\n\n"))
    return whole.select("prompt_id", "budget", F.length(text).alias("chars"), F.coalesce(F.array_join(F.transform("x", lambda x: x["label"]), "|"), F.lit("")).alias("labels"), text.alias("text"))
