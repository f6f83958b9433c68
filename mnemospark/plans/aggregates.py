"""Statistics, funnels, reconciliation and replay scores (rows D of the survey)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemospark.functions import scoring as S
from mnemospark.functions.timeexpr import day_key
from mnemospark.operators import clustering, dedupe, graph, lifecycle, replay
from mnemospark.operators.common import top, top_per
from mnemospark.operators.visibility import agent_of, base_visible
from mnemospark.plans.filters import CHANNELS, PEERS
from mnemospark.plans.oracle import sql
from mnemospark.registry import query
from mnemospark.sources import tables as t
from mnemospark.sources.tables import DAY_MS, EPOCH_MS, HOUR_MS, NOW_MS

_SHORT_COLLAPSED = r"regexp_replace(lower(regexp_replace({0}, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')), '[ \t\n\r\f]+', ' ', 'g')"


@query("d1_memory_stats", sql("SELECT store, count(*) AS n, count(*) FILTER (archived) AS archived, round(avg(strength), 6) AS strength, count(*) FILTER (created_ms >= $NOW - 86400000) AS last_day FROM memories GROUP BY store"))
def d1(spark, d):
    return t.memories(spark, d).groupBy("store").agg(F.count(F.lit(1)).alias("n"), F.count_if("archived").alias("archived"), F.round(F.avg("strength"), 6).alias("strength"), F.count_if(F.col("created_ms") >= NOW_MS - DAY_MS).alias("last_day"))


@query("d1_strongest", sql("SELECT memory_id, strength FROM memories WHERE NOT archived ORDER BY strength DESC, memory_id LIMIT 5"))
def d1_top(spark, d):
    return top(t.memories(spark, d).where("NOT archived"), 5, F.desc("strength"), F.asc("memory_id")).select("memory_id", "strength")


@query("d2_usage", sql("SELECT user_id, category, count(*) AS n, CAST(floor(($NOW - min(created_ms)) / 86400000.0) AS BIGINT) AS oldest_days, least(100, CAST(round(count(*) * 100.0 / 500) AS BIGINT)) AS percent FROM memories GROUP BY user_id, category"))
def d2(spark, d):
    n = F.count(F.lit(1))
    return t.memories(spark, d).groupBy("user_id", "category").agg(n.alias("n"), F.floor((NOW_MS - F.min("created_ms")) / DAY_MS).alias("oldest_days"), F.least(F.lit(100), F.round(n * 100 / 500)).cast("long").alias("percent"))


@query("d3_graph_status", sql("SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM relations) AS relations, (SELECT round(count(*) FILTER (confidence > 0.7) * 100.0 / count(*), 2)::DOUBLE FROM node_links) AS enriched"))
def d3(spark, d):
    n, r, k = F.count(F.lit(1)), F.count(F.lit(1)), F.count(F.lit(1))
    links = t.node_links(spark, d).agg(F.round(F.count_if(F.col("confidence") > 0.7) * 100 / k, 2).alias("enriched"))
    return t.nodes(spark, d).agg(n.alias("nodes")).crossJoin(t.relations(spark, d).agg(r.alias("relations"))).crossJoin(links)  # one row each


@query("d4_live_count", sql("SELECT user_id, least(count(*), 40) AS live FROM memories WHERE NOT archived GROUP BY user_id"))
def d4(spark, d):
    return t.memories(spark, d).where("NOT archived").groupBy("user_id").agg(F.least(F.count(F.lit(1)), F.lit(40)).alias("live"))


@query("d5_totals", sql("SELECT user_id, count(*) AS created, count(*) FILTER (archived) AS archived, CAST(sum(length(content)) AS BIGINT) AS chars FROM memories GROUP BY user_id"))
def d5(spark, d):
    return t.memories(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("created"), F.count_if("archived").alias("archived"), F.sum(F.length("content")).alias("chars"))


@query("d6_staleness", sql("SELECT user_id, count(*) FILTER ($NOW - last_accessed_ms > 30 * 86400000::BIGINT) AS stale30, count(*) FILTER ($NOW - last_accessed_ms > 60 * 86400000::BIGINT) AS stale60, count(*) FILTER (access_count = 0) AS never, round(sum(access_count) / count(*), 6)::DOUBLE AS recalls FROM memories GROUP BY user_id"))
def d6(spark, d):
    age = NOW_MS - F.col("last_accessed_ms")
    return t.memories(spark, d).groupBy("user_id").agg(F.count_if(age > 30 * DAY_MS).alias("stale30"), F.count_if(age > 60 * DAY_MS).alias("stale60"), F.count_if(F.col("access_count") == 0).alias("never"), F.round(F.sum("access_count") / F.count(F.lit(1)), 6).alias("recalls"))


_SPAN = 10 * DAY_MS
_SAMPLES = f"""SELECT l.log_id, l.user_id, l.created_ms, len(list_distinct(l.top_ids)) AS shown, count(DISTINCT a.memory_id) AS used, count(DISTINCT a.memory_id) FILTER (list_contains(l.top_ids, a.memory_id)) AS hits FROM recall_log l JOIN activity a ON l.user_id = a.user_id AND a.ts BETWEEN l.created_ms AND l.created_ms + {_SPAN} GROUP BY l.log_id, l.user_id, l.created_ms, l.top_ids"""
_SCORES = f"SELECT log_id, user_id, created_ms, hits, round(hits / shown, 6) AS grounding, round(hits / used, 6) AS coverage, round((round(hits / shown, 6) + round(hits / used, 6)) / 2, 6) AS composite FROM ({_SAMPLES})"


def _samples(spark, d):
    return replay.samples(t.recall_log(spark, d), t.activity(spark, d), _SPAN)


@query("d7_replay_scores", sql(f"SELECT log_id, hits, grounding, coverage, composite FROM ({_SCORES})"))
def d7(spark, d):
    return _samples(spark, d).select("log_id", "hits", "grounding", "coverage", "composite")


@query("d8_replay_report", sql(f"SELECT user_id, count(*) AS samples, round(avg(grounding), 6) AS grounding, round(avg(coverage), 6) AS coverage, round(avg(composite), 6) AS composite FROM ({_SCORES}) GROUP BY user_id"))
def d8(spark, d):
    return replay.report(_samples(spark, d))


@query("f11_worst_samples", sql(f"SELECT log_id, composite FROM ({_SCORES}) ORDER BY composite, log_id LIMIT 5"))
def f11(spark, d):
    return top(_samples(spark, d), 5, F.asc("composite"), F.asc("log_id")).select("log_id", "composite")


@query("e4_report_delta", sql(f"SELECT user_id, log_id, round(composite - lag(composite) OVER (PARTITION BY user_id ORDER BY created_ms, log_id), 6) AS delta FROM ({_SCORES})"))
def e4(spark, d):
    from mnemospark.operators.windows import lag_delta

    return lag_delta(_samples(spark, d), "user_id", "composite", "created_ms", "log_id").select("user_id", "log_id", F.round("delta", 6).alias("delta"))


@query("d9_recall_stats", sql("SELECT user_id, count(*) AS recalls, CAST(sum(trace_hits) AS BIGINT) AS trace_hits, round(avg(result_count), 6) AS results, round(sum(trace_hits) / count(*), 6)::DOUBLE AS hit_rate FROM recall_log GROUP BY user_id"))
def d9(spark, d):
    n = F.count(F.lit(1))
    return t.recall_log(spark, d).groupBy("user_id").agg(n.alias("recalls"), F.sum("trace_hits").alias("trace_hits"), F.round(F.avg("result_count"), 6).alias("results"), F.round(F.try_divide(F.sum("trace_hits"), n), 6).alias("hit_rate"))


@query("d10_trace_funnel", sql("SELECT user_id, count(*) AS n, count(*) FILTER (trace_hits > 0) AS hits, max(top_score) AS best, list_sort(list(top_score))[CAST(floor(count(*) * 0.5) AS BIGINT) + 1] AS p50, list_sort(list(top_score))[CAST(floor(count(*) * 0.9) AS BIGINT) + 1] AS p90 FROM recall_log GROUP BY user_id"))
def d10(spark, d):
    """p50 and p90 are the values at places floor(n q) of the sorted scores: ranks in a window, so no list is gathered."""
    by = Window.partitionBy("user_id")
    r = t.recall_log(spark, d).withColumn("i", F.row_number().over(by.orderBy("top_score")) - 1).withColumn("n", F.count(F.lit(1)).over(by))
    at = lambda q: F.max(F.when(F.col("i") == F.floor(F.col("n") * q), F.col("top_score")))
    return r.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("trace_hits") > 0).alias("hits"), F.max("top_score").alias("best"), at(0.5).alias("p50"), at(0.9).alias("p90"))


@query("d11_day_spend", sql(f"SELECT user_id, round(sum(cost), 6) AS cost, count(*) AS runs FROM runs WHERE started_ms >= {EPOCH_MS + 20 * DAY_MS} GROUP BY user_id"))
def d11(spark, d):
    return t.runs(spark, d).where(F.col("started_ms") >= EPOCH_MS + 20 * DAY_MS).groupBy("user_id").agg(F.round(F.sum("cost"), 6).alias("cost"), F.count(F.lit(1)).alias("runs"))


@query("d12_ttl_histogram", sql(f"SELECT CASE WHEN left_ms <= {HOUR_MS} THEN '1h' WHEN left_ms <= {6 * HOUR_MS} THEN '6h' WHEN left_ms <= {24 * HOUR_MS} THEN '24h' ELSE 'later' END AS band, count(*) AS n FROM (SELECT expires_ms - {EPOCH_MS + 2 * DAY_MS} AS left_ms FROM traces WHERE validated IS NULL) WHERE left_ms > 0 GROUP BY band"))
def d12(spark, d):
    return lifecycle.ttl_histogram(t.traces(spark, d), EPOCH_MS + 2 * DAY_MS)


@query("d13_trace_stats", sql(f"SELECT trace_type, count(*) AS n, count(*) FILTER (validated) AS validated, round(count(*) FILTER (validated) * 1.0 / count(*), 6)::DOUBLE AS hit_rate, count(*) FILTER (validated IS NULL AND expires_ms > {EPOCH_MS + DAY_MS}) AS active FROM traces GROUP BY trace_type"))
def d13(spark, d):
    n = F.count(F.lit(1))
    return t.traces(spark, d).groupBy("trace_type").agg(n.alias("n"), F.count_if("validated").alias("validated"), F.round(F.count_if("validated") / n, 6).alias("hit_rate"), F.count_if(F.col("validated").isNull() & (F.col("expires_ms") > EPOCH_MS + DAY_MS)).alias("active"))


@query("d14_cost_projection", sql("SELECT user_id, round(coalesce(avg(cost) FILTER (trigger = 'scheduled' AND status = 'completed'), avg(cost) FILTER (status = 'completed')) * 24, 6) AS daily, count(*) AS runs FROM runs GROUP BY user_id"))
def d14(spark, d):
    done = F.col("status") == "completed"
    cost = F.coalesce(F.avg(F.when(done & (F.col("trigger") == "scheduled"), F.col("cost"))), F.avg(F.when(done, F.col("cost"))))
    return t.runs(spark, d).groupBy("user_id").agg(F.round(cost * 24, 6).alias("daily"), F.count(F.lit(1)).alias("runs"))


_FEED = f"SELECT ts // {HOUR_MS} AS slot, event_type FROM activity UNION ALL SELECT created_ms // {HOUR_MS}, 'recall' FROM recall_log UNION ALL SELECT started_ms // {HOUR_MS}, 'run' FROM runs"


@query("d15_activity_feed", sql(f"SELECT slot, event_type, count(*) AS n FROM ({_FEED}) GROUP BY ALL ORDER BY slot DESC, event_type LIMIT 20"))
def d15(spark, d):
    slot = lambda c: F.floor(F.col(c) / HOUR_MS).alias("slot")
    feed = t.activity(spark, d).select(slot("ts"), "event_type").unionByName(t.recall_log(spark, d).select(slot("created_ms"), F.lit("recall").alias("event_type"))).unionByName(t.runs(spark, d).select(slot("started_ms"), F.lit("run").alias("event_type")))
    return top(feed.groupBy("slot", "event_type").agg(F.count(F.lit(1)).alias("n")), 20, F.desc("slot"), F.asc("event_type"))


@query("d16_counter_reconcile", sql("SELECT k.kb_id, m.n AS true_count, m.chars AS true_chars, k.stored_count - m.n AS count_delta, k.stored_chars - m.chars AS chars_delta FROM knowledge_bases k LEFT JOIN (SELECT kb_id, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars FROM memories GROUP BY kb_id) m USING (kb_id) WHERE k.stored_count <> m.n OR k.stored_chars <> m.chars"))
def d16(spark, d):
    true = t.memories(spark, d).where("kb_id IS NOT NULL").groupBy("kb_id").agg(F.count(F.lit(1)).alias("true_count"), F.sum(F.length("content")).alias("true_chars"))
    k = t.knowledge_bases(spark, d).join(true, "kb_id", "left")
    return k.select("kb_id", "true_count", "true_chars", (F.col("stored_count") - F.col("true_count")).alias("count_delta"), (F.col("stored_chars") - F.col("true_chars")).alias("chars_delta")).where("count_delta != 0 OR chars_delta != 0")


@query("d17_session_summary", sql("SELECT session_key, count(*) AS messages, count(*) FILTER (role = 'user') AS users, count(*) FILTER (role = 'assistant') AS assistants, min(ts) AS first_ms, max(ts) AS last_ms, array_to_string(list(substring(content, 1, 40) ORDER BY ts DESC, message_id DESC)[1:3], ' / ') AS excerpts FROM messages GROUP BY session_key"))
def d17(spark, d):
    m = t.messages(spark, d)
    last = top_per(m.select("session_key", "ts", "message_id", F.substring("content", 1, 40).alias("x")), ["session_key"], 3, F.desc("ts"), F.desc("message_id"))
    last = last.groupBy("session_key").agg(F.reverse(F.array_sort(F.collect_list(F.struct("ts", "message_id", "x")))).alias("l")).select("session_key", F.array_join(F.transform("l", lambda x: x["x"]), " / ").alias("excerpts"))
    out = m.groupBy("session_key").agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.col("role") == "user").alias("users"), F.count_if(F.col("role") == "assistant").alias("assistants"), F.min("ts").alias("first_ms"), F.max("ts").alias("last_ms"))
    return out.join(last, "session_key")


@query("d18_mean_vectors", sql("SELECT ensemble_id, i::BIGINT AS place, round(avg(embedding[i]), 6) AS mean FROM vectors, range(1, 65) r(i) GROUP BY ensemble_id, i"))
def d18(spark, d):
    c = clustering.mean_vectors(t.vectors(spark, d), "ensemble_id")
    return c.select("ensemble_id", F.posexplode("centroid").alias("i", "m")).select("ensemble_id", (F.col("i") + 1).cast("long").alias("place"), F.round("m", 6).alias("mean"))


@query("d19_ensemble_strength", sql("""WITH c AS (SELECT ensemble_id, list(m ORDER BY i) AS embedding FROM (SELECT ensemble_id, i, avg(embedding[i]) AS m FROM vectors, range(1, 65) r(i) GROUP BY ALL) GROUP BY ensemble_id)
    SELECT v.ensemble_id, round(avg(m.strength), 6) AS strength, round(avg(round(list_dot_product(v.embedding, c.embedding) / (sqrt(list_dot_product(v.embedding, v.embedding)) * sqrt(list_dot_product(c.embedding, c.embedding))), 6)), 6) AS confidence FROM vectors v JOIN c USING (ensemble_id) JOIN memories m USING (memory_id) GROUP BY v.ensemble_id"""))
def d19(spark, d):
    rows = clustering.cohesion(t.vectors(spark, d)).join(t.memories(spark, d).select("memory_id", "strength"), "memory_id")
    return rows.groupBy("ensemble_id").agg(F.round(F.avg("strength"), 6).alias("strength"), F.round(F.avg("similarity"), 6).alias("confidence"))


@query("d20_relation_merge", sql("SELECT 'channel:' || m.channel AS from_id, m.store AS to_id, a.relation, least(1.0, greatest(0.1, max(a.weight)))::DOUBLE AS weight, count(DISTINCT m.tags[2]) AS evidence FROM associations a JOIN memories m ON m.memory_id = a.from_id GROUP BY 1, 2, 3"))
def d20(spark, d):
    m = t.memories(spark, d).select(F.col("memory_id").alias("mid"), "channel", "store", F.element_at("tags", 2).alias("evidence"))
    rows = t.associations(spark, d).join(m, F.col("from_id") == F.col("mid")).select(F.concat(F.lit("channel:"), "channel").alias("from_id"), F.col("store").alias("to_id"), "relation", "weight", "evidence")
    return graph.merged_relations(rows).withColumn("evidence", F.size("evidence").cast("long"))


@query("d21_node_merge", sql("SELECT user_id, 'person:' || coalesce(nullif(regexp_replace(regexp_replace(lower(tags[2]), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), ''), 'untitled') AS canonical_key, count(*) AS mentions, min(memory_id) AS first_source FROM memories GROUP BY 1, 2"))
def d21(spark, d):
    rows = t.memories(spark, d).select("user_id", F.lit("person").alias("kind"), F.element_at("tags", 2).alias("label"), F.col("memory_id").alias("source_id"))
    return graph.merged_nodes(rows)


@query("d22_keep_best", sql(f"SELECT memory_id, strength FROM (SELECT memory_id, strength, row_number() OVER (PARTITION BY {_SHORT_COLLAPSED.format('title')}, {_SHORT_COLLAPSED.format('content')} ORDER BY strength DESC, memory_id) AS n FROM memories) WHERE n = 1"))
def d22(spark, d):
    return dedupe.keep_best(t.memories(spark, d), "strength").select("memory_id", "strength")


@query("d24_duplicate_keys", sql("SELECT sha256(text) AS key, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1"))
def d24(spark, d):
    return dedupe.duplicate_key(t.table(spark, d, "documents"), [F.sha2("text", 256).alias("key")])


@query("d25_context_tokens", sql("SELECT c.session_key, CAST(sum(CASE c.item_type WHEN 'summary' THEN 10 ELSE ceil(length(m.content) / 4.0) END) AS BIGINT) AS tokens FROM context_items c JOIN messages m ON m.message_id = c.ref_id GROUP BY c.session_key"))
def d25(spark, d):
    m = t.messages(spark, d).select(F.col("message_id").alias("ref_id"), F.ceil(F.length("content") / 4).alias("n"))
    return t.context_items(spark, d).join(m, "ref_id").groupBy("session_key").agg(F.sum(F.when(F.col("item_type") == "summary", 10).otherwise(F.col("n"))).alias("tokens"))


@query("d26_lesson_counter", sql("SELECT user_id, k AS topic, count(*) AS n FROM event_rows GROUP BY user_id, k HAVING count(*) >= 3"))
def d26(spark, d):
    rows = t.table(spark, d, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("topic"))
    return rows.groupBy("user_id", "topic").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


@query("d27_spend_fold", sql("SELECT status, count(*) AS runs, round(sum(cost), 4) AS cost, CAST(sum(traces) AS BIGINT) AS traces FROM runs GROUP BY status"))
def d27(spark, d):
    return t.runs(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("runs"), F.round(F.sum("cost"), 4).alias("cost"), F.sum("traces").alias("traces"))


@query("d28_summary_depths", sql("SELECT DISTINCT session_key, depth FROM summaries"))
def d28(spark, d):
    return t.summaries(spark, d).select("session_key", "depth").distinct()


@query("d29_alert_budget", sql("SELECT user_id, strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS day, count(*) + 1 AS used FROM requests WHERE event_type = 'error' GROUP BY 1, 2"))
def d29(spark, d):
    return t.requests(spark, d).where("event_type = 'error'").groupBy("user_id", day_key(F.col("ts")).alias("day")).agg((F.count(F.lit(1)) + 1).alias("used"))


@query("d30_coverage_split", sql("SELECT user_id, count(*) FILTER (result_count >= 3) AS covered, count(*) FILTER (result_count < 2) AS gaps FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_ms DESC, log_id DESC) AS n FROM recall_log) WHERE n <= 10 GROUP BY user_id"))
def d30(spark, d):
    last = top_per(t.recall_log(spark, d), ["user_id"], 10, F.desc("created_ms"), F.desc("log_id"))
    return last.groupBy("user_id").agg(F.count_if(F.col("result_count") >= 3).alias("covered"), F.count_if(F.col("result_count") < 2).alias("gaps"))


@query("d31_dispatch_gap", sql("SELECT user_id, count(*) FILTER (event_type = 'view') AS received, count(*) FILTER (event_type = 'view') >= 3 AND count(*) FILTER (event_type = 'signup') = 0 AS stalled FROM requests GROUP BY user_id"))
def d31(spark, d):
    got = F.count_if(F.col("event_type") == "view")
    return t.requests(spark, d).groupBy("user_id").agg(got.alias("received"), ((got >= 3) & (F.count_if(F.col("event_type") == "signup") == 0)).alias("stalled"))


@query("d32_signal_log", sql("SELECT user_id, string_agg(memory_id || ':' || round(strength, 2), ',' ORDER BY strength DESC, memory_id) AS signals FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY strength DESC, memory_id) AS n FROM memories) WHERE n <= 30 GROUP BY user_id"))
def d32(spark, d):
    best = top_per(t.memories(spark, d).select("user_id", "memory_id", "strength"), ["user_id"], 30, F.desc("strength"), F.asc("memory_id"))
    x = F.array_sort(F.collect_list(F.struct((-F.col("strength")).alias("o"), "memory_id", F.concat_ws(":", F.col("memory_id").cast("string"), F.round("strength", 2).cast("string")).alias("s"))))  # thirty
    return best.groupBy("user_id").agg(x.alias("x")).select("user_id", F.array_join(F.transform("x", lambda s: s["s"]), ",").alias("signals"))


@query("d33_validated_since", sql(f"SELECT user_id, count(*) FILTER (validated AND expires_ms >= {EPOCH_MS + DAY_MS}) AS n FROM traces GROUP BY user_id"))
def d33(spark, d):
    return t.traces(spark, d).groupBy("user_id").agg(F.count_if(F.coalesce("validated", F.lit(False)) & (F.col("expires_ms") >= EPOCH_MS + DAY_MS)).alias("n"))


_PAIR = "SELECT kb_id, is_active, agent_ids, scope, coalesce(policy, 'strict') AS policy, c, CASE WHEN contains(c, ':') THEN split_part(c, ':', 1) ELSE c END AS prefix, CASE WHEN contains(c, ':') THEN split_part(c, ':', 2) ELSE '' END AS suffix FROM knowledge_bases, (SELECT unnest(['coach:3', 'coach:team', 'coach', 'coder:en', 'en', 'general']) AS c)"


@query("d34_guard_replay", sql(f"""SELECT c, count(*) FILTER (old) AS was, count(*) FILTER (new) AS now, count(*) FILTER (old AND NOT new) AS lost FROM (SELECT c, is_active AND (scope IS NULL OR scope = c) AND (len(agent_ids) = 0 OR list_contains(agent_ids, prefix)) AS old,
    is_active AND (CASE WHEN scope IS NOT NULL AND scope <> c AND NOT contains(c, ':') THEN false WHEN prefix = 'coach' THEN CASE WHEN regexp_matches(suffix, '^[0-9]+$') THEN policy <> 'strict' OR coalesce(scope = c OR scope = suffix, false) ELSE policy = 'permissive' END ELSE scope IS NULL OR scope = c END) AND (len(agent_ids) = 0 OR list_contains(agent_ids, prefix)) AS new FROM ({_PAIR})) GROUP BY c"""))
def d34(spark, d):
    k = t.knowledge_bases(spark, d).withColumn("c", F.explode(F.array(*[F.lit(c) for c in CHANNELS])))
    args = [F.col(x) for x in ("is_active", "agent_ids", "scope", "policy")] + [agent_of(F.col("c")), F.col("c"), PEERS]
    k = k.withColumn("old", base_visible(*args, strict=False)).withColumn("new", base_visible(*args))
    return k.groupBy("c").agg(F.count_if("old").alias("was"), F.count_if("new").alias("now"), F.count_if(F.col("old") & ~F.col("new")).alias("lost"))


_POLICIES = {"baseline": {}, "strong": {"strength": 0.5}, "fresh": {"freshness": 0.4, "strength": 0.05}}


@query("h3_policy_evaluation", sql(f"""WITH rel AS (SELECT l.log_id, list(DISTINCT a.memory_id) AS relevant FROM recall_log l JOIN activity a ON l.user_id = a.user_id AND a.ts BETWEEN l.created_ms AND l.created_ms + {_SPAN} GROUP BY l.log_id),
    cand AS (SELECT log_id, memory_id, round(freshness * f + strength * s, 6) AS sc, policy FROM (SELECT log_id, unnest(list_distinct(top_ids || [(k + 7) % 100, (k + 11) % 100])) AS memory_id FROM (SELECT log_id, top_ids, top_ids[1] AS k FROM recall_log)) JOIN (SELECT memory_id, strength, salience AS freshness FROM memories) USING (memory_id), (VALUES ('baseline', 0.15::DOUBLE, 0.22::DOUBLE), ('strong', 0.15, 0.5), ('fresh', 0.4, 0.05)) p(policy, f, s)),
    ranked AS (SELECT policy, log_id, list(memory_id) AS ranked FROM (SELECT *, row_number() OVER (PARTITION BY policy, log_id ORDER BY sc DESC, memory_id) AS n FROM cand) WHERE n <= 3 GROUP BY policy, log_id)
    SELECT policy, count(*) AS samples, round(avg(round((round(h / len(ranked), 6) + round(h / len(relevant), 6)) / 2, 6)), 6) AS composite FROM (SELECT *, len(list_intersect(ranked, relevant)) AS h FROM ranked JOIN rel USING (log_id)) GROUP BY policy"""))
def h3_11(spark, d):
    logs = t.recall_log(spark, d)
    k = F.element_at("top_ids", 1)
    cand = logs.select("log_id", F.explode(F.array_distinct(F.concat("top_ids", F.array((k + 7) % 100, (k + 11) % 100)))).alias("memory_id"))
    cand = cand.join(t.memories(spark, d).select("memory_id", "strength", F.col("salience").alias("freshness")), "memory_id")
    return replay.policy_scores(cand, _samples(spark, d), _POLICIES)
