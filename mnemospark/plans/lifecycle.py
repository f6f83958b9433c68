"""Retention, quotas, changes of rows, graph and clustering jobs (rows I, J and K of the survey)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.operators import clustering, compaction, dedupe, graph, lifecycle
from mnemospark.operators.common import upsert
from mnemospark.operators.gates import noise
from mnemospark.plans.filters import _NOISE_SQL, _noisy
from mnemospark.plans.oracle import sql
from mnemospark.registry import query
from mnemospark.sources import tables as t
from mnemospark.sources.tables import DAY_MS, EPOCH_MS, HOUR_MS, NOW_MS

_STALE = f"(store = 'procedural' AND category = 'workflow' AND CAST(json_extract(metadata, '$.observationCount') AS DOUBLE) < 3 AND $NOW - CAST(json_extract(metadata, '$.lastObserved') AS BIGINT) >= {30 * DAY_MS})"
_ACTION = f"CASE WHEN kb_id IS NOT NULL THEN 'keep' WHEN store = 'sensory' AND created_ms <= $NOW - {DAY_MS} THEN 'delete' WHEN (strength < 0.1 OR {_STALE}) AND NOT archived THEN 'archive' ELSE 'keep' END"


@query("i1_dependency_chain", sql("""WITH RECURSIVE chain(node_id, depth) AS (SELECT 'part:900', 0 UNION SELECT r.to_id, depth + 1 FROM chain JOIN relations r ON r.from_id = chain.node_id WHERE r.relation IN ('depends_on', 'leads_to', 'decided_in') AND depth < 4)
    SELECT node_id, min(depth) AS depth FROM chain GROUP BY node_id"""))
def i1(spark, d):
    return graph.dependency_chain(t.relations(spark, d), spark.range(1).select(F.lit("part:900").alias("node_id")), 4)


@query("i2_leader_clusters", sql("""WITH RECURSIVE r AS MATERIALIZED (SELECT ensemble_id AS k, memory_id AS id, embedding AS v, sqrt(list_dot_product(embedding, embedding)) AS norm, row_number() OVER (PARTITION BY ensemble_id ORDER BY memory_id) AS step FROM vectors),
    go AS (SELECT k, step, id, 0::BIGINT AS cluster, [v] AS sums FROM r WHERE step = 1
        UNION ALL SELECT k, step, id, CASE WHEN hit THEN best - 1 ELSE len(sums) END, CASE WHEN hit THEN list_transform(range(1, len(sums) + 1), lambda i: CASE WHEN i = best THEN list_transform(range(1, len(v) + 1), lambda j: sums[i][j] + v[j]) ELSE sums[i] END) ELSE list_append(sums, v) END
            FROM (SELECT *, list_max(near) > 0.2 AS hit, list_position(near, list_max(near)) AS best FROM (SELECT r.*, g.sums, list_transform(g.sums, lambda s: round(list_dot_product(s, r.v) / (sqrt(list_dot_product(s, s)) * r.norm), 9)) AS near FROM go g JOIN r ON r.k = g.k AND r.step = g.step + 1)))
    SELECT k AS ensemble_id, id AS memory_id, cluster, n FROM (SELECT *, count(*) OVER (PARTITION BY k, cluster) AS n FROM go) WHERE n >= 3""", recursive=True))
def i2(spark, d):
    rows = t.vectors(spark, d)
    return clustering.leaders(rows, "ensemble_id", 0.2)


@query("i3_recall_outcome", sql("SELECT log_id, CASE WHEN result_count = 0 THEN 'failed' ELSE 'successful' END AS outcome FROM recall_log"))
def i3(spark, d):
    return t.recall_log(spark, d).select("log_id", F.when(F.col("result_count") == 0, "failed").otherwise("successful").alias("outcome"))


@query("i4_skill_gaps", sql("SELECT query, count(*) AS failures, count(DISTINCT user_id) AS users FROM recall_log WHERE result_count = 0 GROUP BY query HAVING count(*) >= 3"))
def i4(spark, d):
    """Failed queries by text; clustering of their vectors is i2."""
    return t.recall_log(spark, d).where("result_count = 0").groupBy("query").agg(F.count(F.lit(1)).alias("failures"), F.countDistinct("user_id").alias("users")).where("failures >= 3")


_SLUG = "coalesce(nullif(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), ''), 'untitled')"


@query("i7_graph_seed", sql(f"SELECT node_id, count(*) AS links FROM (SELECT memory_id, 'channel:' || {_SLUG.format('channel')} AS node_id FROM memories UNION SELECT memory_id, 'tag:' || {_SLUG.format('tag')} FROM (SELECT memory_id, unnest(tags) AS tag FROM memories)) GROUP BY node_id UNION ALL SELECT 'memory:' || memory_id, 0 FROM memories"))
def i7(spark, d):
    return graph.seed(t.memories(spark, d))[0]


@query("i11_compaction")
def i11(spark, d):
    items = t.messages(spark, d).select("session_key", F.col("turn_index").alias("ordinal"), F.ceil(F.length("content") / 4).alias("tokens"))
    return compaction.compacted(items, budget=300, chunk=400, tail=2)


@query("i15_dimension_audit", sql("SELECT len(embedding)::BIGINT AS dimensions, count(*) AS n FROM vectors GROUP BY 1"))
def i15(spark, d):
    return t.vectors(spark, d).groupBy(F.size("embedding").cast("long").alias("dimensions")).agg(F.count(F.lit(1)).alias("n"))


@query("i16_missing_vectors", sql("SELECT memory_id, kb_id FROM memories WHERE kb_id IS NOT NULL AND memory_id NOT IN (SELECT memory_id FROM vectors)"))
def i16(spark, d):
    return t.memories(spark, d).where("kb_id IS NOT NULL").select("memory_id", "kb_id").join(t.vectors(spark, d).select("memory_id"), "memory_id", "left_anti")


@query("i17_duplicate_deletion", sql("SELECT message_id, min(message_id) OVER (PARTITION BY user_id, role, lower(regexp_replace(content, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g')), channel, session_key, coalesce(turn_id, ''), turn_index) AS keep_id FROM messages"))
def i17(spark, d):
    return dedupe.first_of_copies(t.messages(spark, d))


@query("i19_skill_activation", sql("SELECT memory_id, greatest(confidence, 0.7)::DOUBLE AS confidence, greatest(strength, 0.95)::DOUBLE AS strength FROM memories WHERE store = 'procedural' AND confidence >= 0.5"))
def i19(spark, d):
    return t.memories(spark, d).where("store = 'procedural' AND confidence >= 0.5").select("memory_id", F.greatest("confidence", F.lit(0.7)).alias("confidence"), F.greatest("strength", F.lit(0.95)).alias("strength"))


@query("j2_expired_messages", sql("SELECT message_id, expires_at FROM messages WHERE expires_at <= $NOW"))
def j2(spark, d):
    return lifecycle.expired(t.messages(spark, d), NOW_MS).select("message_id", "expires_at")


@query("j3_cleanup_actions", sql(f"SELECT action, store, count(*) AS n FROM (SELECT {_ACTION} AS action, store FROM memories) GROUP BY ALL"))
def j3(spark, d):
    return t.memories(spark, d).groupBy(lifecycle.cleanup_action(NOW_MS).alias("action"), "store").agg(F.count(F.lit(1)).alias("n"))


@query("j3_cleaned_edges", sql(f"WITH gone AS (SELECT memory_id FROM memories WHERE {_ACTION} = 'delete') SELECT edge_id FROM associations WHERE from_id NOT IN (SELECT memory_id FROM gone) AND to_id NOT IN (SELECT memory_id FROM gone)"))
def j3_edges(spark, d):
    return lifecycle.cleaned(t.memories(spark, d), t.associations(spark, d), NOW_MS)[1].select("edge_id")


@query("j4_noise_purge", sql(f"SELECT noise, count(*) AS n FROM ({_NOISE_SQL.format(extra='')}) WHERE noise IS NOT NULL GROUP BY noise"))
def j4(spark, d):
    return _noisy(spark, d).groupBy(noise(F.col("content"), F.col("title")).alias("noise")).agg(F.count(F.lit(1)).alias("n")).where("noise IS NOT NULL")


@query("j6_prunes", sql(f"SELECT 'activity' AS log, count(*) AS kept FROM activity WHERE ts >= {EPOCH_MS + 23 * DAY_MS} UNION ALL SELECT 'recall', count(*) FROM recall_log WHERE created_ms >= {EPOCH_MS + DAY_MS} UNION ALL SELECT 'traces', count(*) FROM traces WHERE expires_ms >= {EPOCH_MS + DAY_MS}"))
def j6(spark, d):
    kept = lambda name, df, col, since: df.where(F.col(col) >= since).agg(F.lit(name).alias("log"), F.count(F.lit(1)).alias("kept"))
    return kept("activity", t.activity(spark, d), "ts", EPOCH_MS + 23 * DAY_MS).unionByName(kept("recall", t.recall_log(spark, d), "created_ms", EPOCH_MS + DAY_MS)).unionByName(kept("traces", t.traces(spark, d), "expires_ms", EPOCH_MS + DAY_MS))


@query("j8_settled", sql(f"SELECT message_id FROM messages WHERE ts <= {EPOCH_MS + 2 * DAY_MS} - 120000 AND extracted_at IS NULL"))
def j8(spark, d):
    return t.messages(spark, d).where((F.col("ts") <= EPOCH_MS + 2 * DAY_MS - 120_000) & F.col("extracted_at").isNull()).select("message_id")


@query("j9_session_windows", sql("SELECT user_id, min(ts) AS start_ms, max(ts) AS last_ms, count(*) AS messages FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, message_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, message_id) < 900000 THEN 0 ELSE 1 END AS new FROM messages)) GROUP BY user_id, s"))
def j9(spark, d):
    rows = t.messages(spark, d).withColumn("at", F.timestamp_millis("ts"))
    return rows.groupBy("user_id", F.session_window("at", "15 minutes").alias("w")).agg(F.min("ts").alias("start_ms"), F.max("ts").alias("last_ms"), F.count(F.lit(1)).alias("messages")).drop("w")


@query("j11_daily_quota", sql("SELECT event_id, strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY user_id, ts // 86400000 ORDER BY ts, event_id) <= 2 AS allowed FROM requests"))
def j11(spark, d):
    return lifecycle.daily_quota(t.requests(spark, d), 2).select("event_id", "day", "allowed")


@query("j12_alert_budget", sql("SELECT run_id FROM (SELECT run_id, row_number() OVER (PARTITION BY user_id, started_ms // 86400000 ORDER BY started_ms, run_id) AS n FROM runs WHERE status = 'failed') WHERE n <= 3"))
def j12(spark, d):
    return lifecycle.daily_quota(t.runs(spark, d).where("status = 'failed'"), 3, "started_ms", "run_id").where("allowed").select("run_id")


@query("j14_warm_cache", sql(f"SELECT user_id, memory_id FROM (SELECT user_id, memory_id, max(ts) AS ts, row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, memory_id) AS n FROM activity WHERE ts > {EPOCH_MS + 25 * DAY_MS} GROUP BY user_id, memory_id) WHERE n <= 10"))
def j14(spark, d):
    from mnemospark.operators.common import top_per

    rows = t.activity(spark, d).where(F.col("ts") > EPOCH_MS + 25 * DAY_MS).groupBy("user_id", "memory_id").agg(F.max("ts").alias("ts"))
    return top_per(rows, ["user_id"], 10, F.desc("ts"), F.asc("memory_id")).select("user_id", "memory_id")


@query("j20_embed_queue", sql("SELECT channel, count(*) AS waiting, min(ts) AS oldest_ms FROM messages WHERE NOT embedded GROUP BY channel"))
def j20(spark, d):
    return t.messages(spark, d).where("NOT embedded").groupBy("channel").agg(F.count(F.lit(1)).alias("waiting"), F.min("ts").alias("oldest_ms"))


_KEY = r"sha256(regexp_replace(lower(regexp_replace(predicted_query, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')), '[ \t\n\r\f]+', ' ', 'g'))"
_T0 = EPOCH_MS + DAY_MS


@query("j22_prediction_merge", sql(f"""SELECT key, round(CASE WHEN o IS NULL THEN n WHEN n IS NULL THEN o ELSE least(0.95, o + 0.05) END, 6)::DOUBLE AS confidence, o IS NULL AS is_new FROM (SELECT {_KEY} AS key, max(confidence) AS o FROM traces WHERE expires_ms > {_T0} AND validated IS NULL GROUP BY 1)
    FULL JOIN (SELECT {_KEY} AS key, max(confidence) AS n FROM traces WHERE trace_type = 'query' GROUP BY 1) USING (key)"""))
def j22(spark, d):
    rows = t.traces(spark, d)
    return lifecycle.boosted_traces(rows, rows.where("trace_type = 'query'"), _T0)


@query("j23_run_accumulators", sql("SELECT user_id, count(*) AS runs, CAST(sum(traces) AS BIGINT) AS traces, round(count(*) FILTER (status = 'completed') * 1.0 / count(*), 6)::DOUBLE AS rate, max(started_ms) AS last_ms FROM runs GROUP BY user_id"))
def j23(spark, d):
    n = F.count(F.lit(1))
    return t.runs(spark, d).groupBy("user_id").agg(n.alias("runs"), F.sum("traces").alias("traces"), F.round(F.count_if(F.col("status") == "completed") / n, 6).alias("rate"), F.max("started_ms").alias("last_ms"))


@query("j27_scope_from_title", sql("SELECT memory_id, CASE WHEN starts_with(x, 'src1 ') THEN substring(x, 1, 4) WHEN contains(x, ' — ') THEN split_part(x, ' — ', 1) END AS scope FROM (SELECT memory_id, tags[2] || ' — ' || title AS x FROM memories)"))
def j27(spark, d):
    x = F.concat(F.element_at("tags", 2), F.lit(" — "), F.col("title"))
    return t.memories(spark, d).select("memory_id", F.when(F.startswith(x, F.lit("src1 ")), F.substring(x, 1, 4)).when(F.contains(x, F.lit(" — ")), F.split_part(x, F.lit(" — "), F.lit(1))).alias("scope"))


@query("h3_pressure_decay", sql("""WITH a AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS active FROM memories WHERE NOT archived), s AS (SELECT memory_id, user_id, strength, active, round(strength * 0.4 + exp(-0.05 * greatest(0, ($NOW - last_accessed_ms) / 86400000.0)) * 0.6, 6) AS score FROM a WHERE kb_id IS NULL)
    SELECT memory_id, user_id, strength * 0.5 AS strength FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score, memory_id) AS n FROM s WHERE active >= 4 * 0.9) WHERE n <= active - floor(4 * 0.85)"""))
def h3_8(spark, d):
    return lifecycle.under_pressure(t.memories(spark, d), 4, NOW_MS)


@query("k2_update", sql("SELECT memory_id, CASE WHEN memory_id % 9 = 0 THEN 'changed ' || memory_id ELSE content END AS content, CASE WHEN memory_id % 9 = 0 THEN 1.0 ELSE strength END::DOUBLE AS strength FROM memories"))
def k2(spark, d):
    m = t.memories(spark, d).select("memory_id", "content", "strength")
    changes = m.where("memory_id % 9 = 0").select("memory_id", F.concat(F.lit("changed "), F.col("memory_id").cast("string")).alias("content"), F.lit(1.0).alias("strength"))
    return upsert(m, changes, "memory_id", ["content", "strength"])


@query("k3_supersede", sql("SELECT memory_id, archived OR memory_id % 10 = 0 AS archived, store FROM memories UNION ALL SELECT memory_id + 1000000, false, store FROM memories WHERE memory_id % 10 = 0"))
def k3(spark, d):
    m = t.memories(spark, d)
    changes = m.where("memory_id % 10 = 0").select("memory_id", (F.col("memory_id") + 1_000_000).alias("new_id"), F.lit("new").alias("content"))
    return lifecycle.superseded(m, changes).select("memory_id", "archived", "store")


@query("k5_access_bump", sql("SELECT memory_id, access_count + CASE WHEN memory_id IN (SELECT memory_id FROM activity) THEN 1 ELSE 0 END AS access_count FROM memories"))
def k5(spark, d):
    return lifecycle.accessed(t.memories(spark, d), t.activity(spark, d), NOW_MS).select("memory_id", "access_count")


@query("k6_promotion", sql("SELECT memory_id, CASE WHEN store = 'sensory' AND salience > 0.45 THEN 'episodic' ELSE store END AS store, archived OR (salience <= 0.1 AND store = 'sensory') AS archived FROM memories"))
def k6(spark, d):
    s = F.col("store") == "sensory"
    return t.memories(spark, d).select("memory_id", F.when(s & (F.col("salience") > 0.45), "episodic").otherwise(F.col("store")).alias("store"), (F.col("archived") | (s & (F.col("salience") <= 0.1))).alias("archived"))


@query("k7_association_upsert", sql("SELECT from_id, to_id, relation, least(1.0, greatest(0.1, max(weight)))::DOUBLE AS weight FROM (SELECT from_id, to_id, relation, weight FROM associations UNION ALL SELECT from_id, to_id, relation, 0.9 FROM associations WHERE edge_id % 4 = 0) GROUP BY ALL"))
def k7(spark, d):
    a = t.associations(spark, d).withColumn("evidence", F.col("edge_id"))
    return graph.merged_relations(a.unionByName(a.where("edge_id % 4 = 0").withColumn("weight", F.lit(0.9)))).drop("evidence")


@query("k8_triggers", sql("SELECT DISTINCT memory_id, trim(x) AS tool FROM (SELECT memory_id, unnest([tool, ' ' || tool || ' ', '']) AS x FROM triggers) WHERE trim(x) <> ''"))
def k8(spark, d):
    tools = F.array("tool", F.concat(F.lit(" "), "tool", F.lit(" ")), F.lit(""))
    return t.triggers(spark, d).select("memory_id", F.explode(F.array_distinct(F.transform(tools, lambda x: F.trim(x)))).alias("tool")).where("tool != ''")


@query("k10_status_change", sql("SELECT trace_id, CASE WHEN expires_ms <= $NOW THEN 'expired' WHEN validated THEN 'accepted' WHEN NOT validated THEN 'dismissed' ELSE 'pending' END AS status FROM traces"))
def k10(spark, d):
    return t.traces(spark, d).select("trace_id", F.when(F.col("expires_ms") <= NOW_MS, "expired").when(F.col("validated"), "accepted").when(~F.col("validated"), "dismissed").otherwise("pending").alias("status"))


@query("k11_base_archive", sql("SELECT m.memory_id, m.archived OR (m.kb_id IS NOT NULL AND NOT k.is_active) AS archived FROM memories m LEFT JOIN knowledge_bases k USING (kb_id)"))
def k11(spark, d):
    gone = t.knowledge_bases(spark, d).where("NOT is_active").select("kb_id", F.lit(True).alias("gone"))
    return t.memories(spark, d).join(gone, "kb_id", "left").select("memory_id", (F.col("archived") | F.coalesce("gone", F.lit(False))).alias("archived"))


@query("k14_membership_change", sql("SELECT memory_id, ensemble_id, 'add' AS change FROM vectors WHERE memory_id % 2 = 0 AND NOT (memory_id % 3 = 0) UNION ALL SELECT memory_id, ensemble_id, 'remove' FROM vectors WHERE memory_id % 3 = 0 AND NOT (memory_id % 2 = 0)"))
def k14(spark, d):
    v = t.vectors(spark, d).select("memory_id", "ensemble_id")
    new, old = v.where("memory_id % 2 = 0"), v.where("memory_id % 3 = 0")
    return new.join(old, ["memory_id", "ensemble_id"], "left_anti").withColumn("change", F.lit("add")).unionByName(old.join(new, ["memory_id", "ensemble_id"], "left_anti").withColumn("change", F.lit("remove")))


@query("k16_message_logging", sql(f"SELECT message_id, substring(content, 1, 8000) AS content, ts + CASE user_id % 3 WHEN 0 THEN 7 WHEN 1 THEN 30 ELSE 90 END::BIGINT * {DAY_MS} AS expires_ms FROM messages WHERE regexp_replace(content, '[ \\t\\n\\r\\f]+', '', 'g') <> ''"))
def k16(spark, d):
    from mnemospark.functions.timeexpr import expires_at

    rows = t.messages(spark, d).where(T.trim(F.col("content")) != "")
    return rows.select("message_id", F.substring("content", 1, 8000).alias("content"), expires_at(F.col("ts"), t.pick(("free", "pro", "ultra"), F.col("user_id"))).alias("expires_ms"))


@query("k17_trace_validate", sql("SELECT trace_id, true AS validated, access_count + 1 AS access_count FROM traces WHERE validated IS NULL AND contains(lower(predicted_query), 'en')"))
def k17(spark, d):
    return t.traces(spark, d).where(F.col("validated").isNull() & F.contains(F.lower("predicted_query"), F.lit("en"))).select("trace_id", F.lit(True).alias("validated"), (F.col("access_count") + 1).alias("access_count"))


