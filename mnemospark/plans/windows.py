"""Turns, sessions, budgets, top-k lists and set operations (rows E, F and G of the survey)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.operators import windows as W
from mnemospark.operators.common import top, top_per
from mnemospark.operators.search import merged_hits
from mnemospark.plans.oracle import sql
from mnemospark.registry import query
from mnemospark.sources import tables as t
from mnemospark.sources.tables import DAY_MS, EPOCH_MS, NOW_MS


@query("e1_turns", sql("SELECT user_id, coalesce(turn_id, CAST(message_id AS VARCHAR)) AS turn, min(ts) AS start_ms, max(ts) AS end_ms, count(*) AS messages, arg_min(channel, ts) AS channel, string_agg(role, ',' ORDER BY turn_index NULLS LAST, ts, message_id) AS roles FROM messages GROUP BY 1, 2"))
def e1(spark, d):
    return W.turns(t.messages(spark, d)).select("user_id", "turn", "start_ms", "end_ms", "messages", "channel", F.array_join(F.transform("items", lambda x: x["role"]), ",").alias("roles"))


@query("e2_gap_sessions", sql("SELECT message_id, CAST(sum(new) OVER (PARTITION BY user_id, channel ORDER BY ts, message_id) AS BIGINT) AS session_no FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id, channel ORDER BY ts, message_id) <= 900000 THEN 0 ELSE 1 END AS new FROM messages)"))
def e2(spark, d):
    return W.gap_sessions(t.messages(spark, d), ["user_id", "channel"]).select("message_id", "session_no")


@query("e2_extraction_windows", sql("""WITH RECURSIVE m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= 900000 THEN 0 ELSE 1 END AS new FROM messages WHERE extracted_at IS NULL WINDOW w AS (PARTITION BY user_id, channel, session_key ORDER BY ts, message_id)),
    s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id, channel, session_key ORDER BY ts, message_id) AS BIGINT) AS session_no FROM m), r AS MATERIALIZED (SELECT user_id, channel, session_key, session_no, length(content) AS chars, row_number() OVER (PARTITION BY user_id, channel, session_key, session_no ORDER BY ts, message_id) AS step FROM s),
    go AS (SELECT *, 1 AS n, chars AS size, 0::BIGINT AS part_no FROM r WHERE step = 1 UNION ALL SELECT user_id, channel, session_key, session_no, chars, step, CASE WHEN cut THEN 1 ELSE n + 1 END, CASE WHEN cut THEN chars ELSE size + chars END, CASE WHEN cut THEN part_no + 1 ELSE part_no END
        FROM (SELECT r.*, g.n, g.size, g.part_no, g.n >= 4 OR g.size + r.chars > 4000 AS cut FROM go g JOIN r ON r.user_id = g.user_id AND r.channel = g.channel AND r.session_key = g.session_key AND r.session_no = g.session_no AND r.step = g.step + 1))
    SELECT user_id, channel, session_key, session_no, part_no, count(*) AS messages, CAST(sum(chars) AS BIGINT) AS chars FROM go GROUP BY ALL""", recursive=True))
def e2_windows(spark, d):
    rows = W.extraction_windows(t.messages(spark, d).where("extracted_at IS NULL"), most=4, chars=4000)
    return rows.groupBy("user_id", "channel", "session_key", "session_no", "part_no").agg(F.count(F.lit(1)).alias("messages"), F.sum(F.length("content")).alias("chars"))


_BUDGET = "SELECT summary_id, session_key, CAST(sum(tokens) OVER (PARTITION BY session_key ORDER BY ts DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM summaries"


@query("e5_token_budget", sql(f"SELECT summary_id, used FROM ({_BUDGET}) WHERE used <= 400"))
def e5(spark, d):
    return W.within_budget(t.summaries(spark, d), ["session_key"], 400, order="ts").select("summary_id", "used")


@query("e6_greedy_budget", sql("""WITH RECURSIVE items AS (SELECT session_key, summary_id, tokens, row_number() OVER (PARTITION BY session_key ORDER BY ts DESC, summary_id DESC) AS n FROM summaries WHERE tokens <= 400),
    run AS (SELECT DISTINCT session_key, 0::BIGINT AS n, 400::BIGINT AS spare, NULL::BIGINT AS kept FROM items UNION ALL
    SELECT i.session_key, i.n, CASE WHEN i.tokens <= r.spare THEN r.spare - i.tokens ELSE r.spare END, CASE WHEN i.tokens <= r.spare THEN i.summary_id END FROM run r JOIN items i ON i.session_key = r.session_key AND i.n = r.n + 1)
    SELECT session_key, kept AS summary_id FROM run WHERE kept IS NOT NULL"""))
def e6(spark, d):
    return W.greedy_budget(t.summaries(spark, d), ["session_key"], 400, order="ts")


_ITEMS = "SELECT c.*, CAST(ceil(length(m.content) / 4.0) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY c.session_key ORDER BY c.ordinal DESC) <= 2 AS fresh FROM context_items c JOIN messages m ON m.message_id = c.ref_id"


def _items(spark, d):
    m = t.messages(spark, d).select(F.col("message_id").alias("ref_id"), F.ceil(F.length("content") / 4).alias("tokens"))
    return t.context_items(spark, d).join(m, "ref_id")


@query("e7_oldest_chunk", sql(f"""WITH i AS ({_ITEMS}), s AS (SELECT *, min(CASE WHEN item_type = 'message' THEN ordinal END) OVER (PARTITION BY session_key) AS first FROM i WHERE NOT fresh), r AS (SELECT *, sum(CASE WHEN item_type = 'message' THEN 0 ELSE 1 END) OVER (PARTITION BY session_key ORDER BY ordinal) AS broken FROM s WHERE ordinal >= first)
    SELECT session_key, ordinal, tokens FROM (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY session_key ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r WHERE broken = 0) WHERE before < 100"""))
def e7(spark, d):
    return W.oldest_chunk(_items(spark, d), ["session_key"], 100, tail=2).select("session_key", "ordinal", "tokens")


@query("e8_fresh_tail", sql(f"SELECT session_key, ordinal, fresh FROM ({_ITEMS})"))
def e8(spark, d):
    return W.fresh_tail(t.context_items(spark, d), ["session_key"], 2).select("session_key", "ordinal", "fresh")


@query("e9_section_drop", sql("""WITH s AS (SELECT session_key, turn_index AS ordinal, role AS label, length(content) AS size, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 END AS rk FROM messages),
    x AS (SELECT *, sum(size) OVER (PARTITION BY session_key) - coalesce(sum(CASE WHEN rk IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY session_key ORDER BY rk NULLS LAST, ordinal DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS excess FROM s)
    SELECT session_key, ordinal, label FROM x WHERE rk IS NULL OR excess <= 2000"""))
def e9(spark, d):
    sections = t.messages(spark, d).select("session_key", F.col("turn_index").alias("ordinal"), F.col("role").alias("label"), F.length("content").alias("size"))
    return W.dropped_sections(sections, ["session_key"], 2000, ["system", "user"]).select("session_key", "ordinal", "label")


@query("e10_trim_oldest", sql("SELECT session_key, turn_index AS ordinal, kept AS kept_chars FROM (SELECT *, CAST(sum(length(content)) OVER (PARTITION BY session_key ORDER BY turn_index DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS kept FROM messages) WHERE kept <= 1500"))
def e10(spark, d):
    rows = t.messages(spark, d).select("session_key", F.col("turn_index").alias("ordinal"), F.length("content").alias("chars"))
    return W.trimmed_oldest(rows, ["session_key"], 1500).select("session_key", "ordinal", "kept_chars")


@query("e12_head_and_tail", sql("SELECT session_key, turn_index FROM (SELECT session_key, turn_index, row_number() OVER (PARTITION BY session_key ORDER BY turn_index) AS a, row_number() OVER (PARTITION BY session_key ORDER BY turn_index DESC) AS b FROM messages) WHERE a <= 2 OR b <= 2"))
def e12(spark, d):
    return W.head_and_tail(t.messages(spark, d), ["session_key"], 2, "turn_index").select("session_key", "turn_index")


@query("e13_rolling_spend", sql("SELECT run_id, round(sum(cost) OVER (PARTITION BY user_id ORDER BY started_ms RANGE BETWEEN 86400000 PRECEDING AND CURRENT ROW), 4) AS rolling FROM runs"))
def e13(spark, d):
    return W.rolling_sum(t.runs(spark, d), "user_id", "cost", "started_ms").select("run_id", F.round("rolling", 4).alias("rolling"))


@query("e14_session_snapshot", sql("SELECT session_key, min(ts) AS started_ms, max(ts) AS last_active_ms, count(*) AS messages, 'Recent conversation:' || chr(10) || string_agg('[' || strftime(make_timestamp(ts * 1000), '%H:%M') || '] ' || role || ': ' || CASE WHEN length(content) > 120 THEN substring(content, 1, 120) || '...' ELSE content END, chr(10) ORDER BY ts, message_id) AS summary FROM messages GROUP BY session_key"))
def e14(spark, d):
    return W.session_snapshot(t.messages(spark, d))


@query("e15_prior_summaries", sql("SELECT summary_id, session_key FROM (SELECT *, row_number() OVER (PARTITION BY session_key, depth ORDER BY ts DESC) AS n FROM summaries) WHERE n <= 2"))
def e15(spark, d):
    return top_per(t.summaries(spark, d), ["session_key", "depth"], 2, F.desc("ts")).select("summary_id", "session_key")


@query("f1_rank_order", sql("SELECT memory_id, strength, confidence FROM memories WHERE NOT archived ORDER BY strength DESC, confidence DESC, memory_id LIMIT 20"))
def f1(spark, d):
    return top(t.memories(spark, d).where("NOT archived"), 20, F.desc("strength"), F.desc("confidence"), F.asc("memory_id")).select("memory_id", "strength", "confidence")


@query("f2_diversity")
def f2(spark, d):
    from mnemospark.operators.recall import distinct_results

    best = top(t.memories(spark, d).where("NOT archived"), 40, F.desc("salience"), F.asc("memory_id"))
    rows = best.select("memory_id", "title", "content", "store", "category", F.col("salience").alias("score"), F.lit(0.0).alias("text_score"))
    return distinct_results(rows, 12, 0.5).select("memory_id", "score")


@query("f5_guardrails", sql("SELECT memory_id, category, strength FROM memories WHERE category IN ('lesson', 'rule') AND NOT archived ORDER BY strength DESC, memory_id LIMIT 5"))
def f5(spark, d):
    return top(t.memories(spark, d).where(F.col("category").isin("lesson", "rule") & ~F.col("archived")), 5, F.desc("strength"), F.asc("memory_id")).select("memory_id", "category", "strength")


@query("f6_wake_lists", sql("SELECT list, memory_id FROM (SELECT 'goals' AS list, memory_id, row_number() OVER (ORDER BY strength DESC, memory_id) AS n, 5 AS k FROM memories WHERE category = 'goal' AND NOT archived UNION ALL SELECT 'decisions', memory_id, row_number() OVER (ORDER BY last_accessed_ms DESC, memory_id), 3 FROM memories WHERE category = 'decision' AND NOT archived) WHERE n <= k"))
def f6(spark, d):
    m = t.memories(spark, d).where("NOT archived")
    goals = top(m.where("category = 'goal'"), 5, F.desc("strength"), F.asc("memory_id")).select(F.lit("goals").alias("list"), "memory_id")
    return goals.unionByName(top(m.where("category = 'decision'"), 3, F.desc("last_accessed_ms"), F.asc("memory_id")).select(F.lit("decisions").alias("list"), "memory_id"))


@query("f7_checkpoint", sql("SELECT memory_id, title, strength FROM memories WHERE NOT archived ORDER BY last_accessed_ms DESC, memory_id LIMIT 12"))
def f7(spark, d):
    return top(t.memories(spark, d).where("NOT archived"), 12, F.desc("last_accessed_ms"), F.asc("memory_id")).select("memory_id", "title", "strength")


@query("f8_last_session", sql("SELECT channel, arg_max(session_key, (ts, session_key)) AS session_key, max(ts) AS last_ms FROM messages GROUP BY channel"))
def f8(spark, d):
    return t.messages(spark, d).groupBy("channel").agg(F.max_by("session_key", F.struct("ts", "session_key")).alias("session_key"), F.max("ts").alias("last_ms"))


@query("f9_skills", sql("SELECT memory_id, CAST(json_extract(metadata, '$.observationCount') AS DOUBLE) AS seen FROM memories WHERE store = 'procedural' AND NOT archived ORDER BY seen DESC, last_accessed_ms DESC, memory_id LIMIT 25"))
def f9(spark, d):
    from mnemospark.functions.jsonx import number

    rows = t.memories(spark, d).where("store = 'procedural' AND NOT archived").withColumn("seen", number(F.col("metadata"), "observationCount"))
    return top(rows, 25, F.desc("seen"), F.desc("last_accessed_ms"), F.asc("memory_id")).select("memory_id", "seen")


@query("f10_recent_memories", sql("SELECT memory_id FROM memories WHERE NOT archived AND (channel = 'en' OR kb_id IS NOT NULL) ORDER BY last_accessed_ms DESC, memory_id LIMIT 50"))
def f10(spark, d):
    return top(t.memories(spark, d).where("NOT archived AND (channel = 'en' OR kb_id IS NOT NULL)"), 50, F.desc("last_accessed_ms"), F.asc("memory_id")).select("memory_id")


@query("f12_low_salience", sql(f"SELECT memory_id, salience FROM memories WHERE salience <= 0.45 AND created_ms >= {EPOCH_MS + DAY_MS} AND NOT archived ORDER BY salience, memory_id LIMIT 50"))
def f12(spark, d):
    return top(t.memories(spark, d).where((F.col("salience") <= 0.45) & (F.col("created_ms") >= EPOCH_MS + DAY_MS) & ~F.col("archived")), 50, F.asc("salience"), F.asc("memory_id")).select("memory_id", "salience")


@query("f13_reflection_window", sql(f"SELECT memory_id, created_ms FROM memories WHERE store IN ('sensory', 'episodic') AND created_ms >= {EPOCH_MS + DAY_MS} AND created_ms <= $NOW AND NOT archived ORDER BY created_ms DESC, memory_id LIMIT 40"))
def f13(spark, d):
    rows = t.memories(spark, d).where(F.col("store").isin("sensory", "episodic") & F.col("created_ms").between(EPOCH_MS + DAY_MS, NOW_MS) & ~F.col("archived"))
    return top(rows, 40, F.desc("created_ms"), F.asc("memory_id")).select("memory_id", "created_ms")


@query("f14_newest_runs", sql("SELECT run_id, started_ms, status FROM runs ORDER BY started_ms DESC, run_id DESC LIMIT 50"))
def f14(spark, d):
    return top(t.runs(spark, d), 50, F.desc("started_ms"), F.desc("run_id")).select("run_id", "started_ms", "status")


@query("g1_candidate_union", sql("SELECT memory_id FROM (SELECT memory_id FROM vectors WHERE ensemble_id < 3 UNION SELECT memory_id FROM memories WHERE contains(lower(content), 'the') UNION SELECT memory_id FROM activity)"))
def g1(spark, d):
    v = t.vectors(spark, d).where("ensemble_id < 3").select("memory_id")
    m = t.memories(spark, d).where(F.contains(F.lower("content"), F.lit("the"))).select("memory_id")
    return v.union(m).union(t.activity(spark, d).select("memory_id")).distinct()


@query("g2_trace_merge", sql("SELECT kind, id, score FROM (SELECT 'trace' AS kind, trace_id AS id, confidence AS score FROM traces WHERE confidence >= 0.25 UNION ALL SELECT 'memory', memory_id, strength FROM memories WHERE NOT archived) ORDER BY score DESC, kind, id LIMIT 25"))
def g2(spark, d):
    a = t.traces(spark, d).where("confidence >= 0.25").select(F.lit("trace").alias("kind"), F.col("trace_id").alias("id"), F.col("confidence").alias("score"))
    return top(a.unionByName(t.memories(spark, d).where("NOT archived").select(F.lit("memory").alias("kind"), F.col("memory_id").alias("id"), F.col("strength").alias("score"))), 25, F.desc("score"), F.asc("kind"), F.asc("id"))


@query("g3_best_tier", sql("SELECT memory_id, max(tier) AS tier FROM (SELECT memory_id, 1.0::DOUBLE AS tier FROM memories WHERE contains(lower(title), 'en') UNION ALL SELECT memory_id, 0.75 FROM memories WHERE contains(lower(content), 'en')) GROUP BY memory_id"))
def g3(spark, d):
    m = t.memories(spark, d)
    rows = m.where(F.contains(F.lower("title"), F.lit("en"))).select("memory_id", F.lit(1.0).alias("tier")).unionByName(m.where(F.contains(F.lower("content"), F.lit("en"))).select("memory_id", F.lit(0.75).alias("tier")))
    return rows.groupBy("memory_id").agg(F.max("tier").alias("tier"))


@query("g4_message_union", sql("""SELECT message_id, max(score) AS score FROM (SELECT message_id, 6.0::DOUBLE AS score FROM messages WHERE starts_with(lower(content), 'en') UNION ALL SELECT message_id, 0.9::DOUBLE FROM messages WHERE embedded AND turn_index = 0) GROUP BY message_id ORDER BY score DESC, message_id LIMIT 40"""))
def g4(spark, d):
    m = t.messages(spark, d)
    a = m.where(F.startswith(F.lower("content"), F.lit("en"))).select("message_id", F.lit(6.0).alias("score"))
    return merged_hits([a, m.where("embedded AND turn_index = 0").select("message_id", F.lit(0.9).alias("score"))], "message_id", 40, F.desc("score"), F.asc("message_id"))


@query("g5_base_append", sql("""WITH r AS (SELECT memory_id FROM memories WHERE NOT archived ORDER BY strength DESC, memory_id LIMIT 8), k AS (SELECT memory_id, kb_id, row_number() OVER (PARTITION BY kb_id ORDER BY strength DESC, memory_id) AS n FROM memories WHERE kb_id IN (SELECT kb_id FROM knowledge_bases ORDER BY stored_count DESC, kb_id LIMIT 5))
    SELECT memory_id, 'result' AS part FROM r UNION ALL SELECT memory_id, kb_id FROM k WHERE n <= 3 AND memory_id NOT IN (SELECT memory_id FROM r)"""))
def g5(spark, d):
    m = t.memories(spark, d)
    r = top(m.where("NOT archived"), 8, F.desc("strength"), F.asc("memory_id")).select("memory_id")
    bases = top(t.knowledge_bases(spark, d), 5, F.desc("stored_count"), F.asc("kb_id")).select("kb_id")
    k = top_per(m.join(bases, "kb_id", "left_semi"), ["kb_id"], 3, F.desc("strength"), F.asc("memory_id")).select("memory_id", F.col("kb_id").alias("part"))
    return r.withColumn("part", F.lit("result")).unionByName(k.join(r, "memory_id", "left_anti"))


_TOK = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: x <> '')"


@query("g6_bigram_jaccard", sql(f"""SELECT memory_id, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(list_distinct(a || b)) END, 6)::DOUBLE AS similarity FROM (SELECT memory_id, CASE WHEN len(ta) < 2 THEN list_distinct(ta) ELSE list_distinct([ta[i] || ' ' || ta[i + 1] for i in range(1, len(ta))]) END AS a, CASE WHEN len(tb) < 2 THEN list_distinct(tb) ELSE list_distinct([tb[i] || ' ' || tb[i + 1] for i in range(1, len(tb))]) END AS b
    FROM (SELECT memory_id, {_TOK.format('content')} AS ta, {_TOK.format('substring(content, 30, 400)')} AS tb FROM memories))"""))
def g6(spark, d):
    a, b = T.bigrams(F.col("content")), T.bigrams(F.substring("content", 30, 400))
    return t.memories(spark, d).select("memory_id", F.round(T.jaccard(a, b, 1.0), 6).alias("similarity"))


_BIG = "list_filter(regexp_split_to_array(lower({0}), '[ \\t\\n\\r\\f]+'), lambda x: length(x) > 3)"


@query("g7_word_overlap", sql(f"SELECT memory_id, round(CASE WHEN len(list_distinct(a || b)) = 0 THEN 0 ELSE len(list_intersect(list_distinct(a), list_distinct(b))) / len(list_distinct(a || b)) END, 6)::DOUBLE AS jaccard, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_filter(a, lambda w: list_contains(b, w))) / greatest(len(a), len(b)) END, 6)::DOUBLE AS overlap FROM (SELECT memory_id, {_BIG.format('title')} AS a, {_BIG.format('substring(content, 20, 300)')} AS b FROM memories)"))
def g7(spark, d):
    a, b = T.significant_words(F.col("title")), T.significant_words(F.substring("content", 20, 300))
    return t.memories(spark, d).select("memory_id", F.round(T.jaccard(F.array_distinct(a), F.array_distinct(b)), 6).alias("jaccard"), F.round(T.overlap_share(a, b), 6).alias("overlap"))


@query("g8_tag_union", sql("SELECT user_id, array_to_string(list_sort(list_distinct(flatten(list(tags)))), ',') AS tags FROM memories GROUP BY user_id"))
def g8(spark, d):
    rows = t.memories(spark, d).select("user_id", F.explode("tags").alias("tag")).distinct()
    return rows.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list("tag")), ",").alias("tags"))


@query("g9_first_by_id", sql("SELECT memory_id, min(ts) AS first_ms, arg_min(event_id, (ts, event_id)) AS event_id FROM activity GROUP BY memory_id"))
def g9(spark, d):
    return t.activity(spark, d).groupBy("memory_id").agg(F.min("ts").alias("first_ms"), F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


