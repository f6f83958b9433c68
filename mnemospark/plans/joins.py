"""Joins that hand-written lookups compute: hydration, intervals, bands, paths, exclusions (rows C of the survey)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemospark.operators import clustering, dedupe, graph, replay, search
from mnemospark.operators.common import best_per, top, top_per
from mnemospark.plans.oracle import sql
from mnemospark.plans.scalars import _HASH_TEXT
from mnemospark.registry import query
from mnemospark.sources import tables as t
from mnemospark.sources.tables import DAY_MS, EPOCH_MS, NOW_MS

_COS = "round(list_dot_product(a.embedding, b.embedding) / (sqrt(list_dot_product(a.embedding, a.embedding)) * sqrt(list_dot_product(b.embedding, b.embedding))), 6)"


@query("c1_hydration", sql("SELECT m.memory_id, m.user_id, m.title FROM (SELECT DISTINCT memory_id FROM activity) a JOIN memories m USING (memory_id) WHERE m.user_id < 5"))
def c1(spark, d):
    return t.memories(spark, d).where("user_id < 5").join(t.activity(spark, d).select("memory_id").distinct(), "memory_id").select("memory_id", "user_id", "title")


@query("c2_base_dimension", sql("SELECT m.memory_id, m.kb_id, coalesce(k.is_active, true) AS base_active, k.policy FROM memories m LEFT JOIN knowledge_bases k USING (kb_id)"))
def c2(spark, d):
    k = t.knowledge_bases(spark, d).select("kb_id", "is_active", "policy")
    return t.memories(spark, d).join(k, "kb_id", "left").select("memory_id", "kb_id", F.coalesce("is_active", F.lit(True)).alias("base_active"), "policy")


@query("c3_graph_boost", sql("SELECT memory_id, round(strength + CASE WHEN EXISTS (SELECT 1 FROM node_links l JOIN nodes n USING (node_id) WHERE l.memory_id = m.memory_id AND l.confidence > 0.7) THEN 0.05 ELSE 0 END, 6)::DOUBLE AS score FROM memories m"))
def c3(spark, d):
    strong = t.node_links(spark, d).where("confidence > 0.7").join(t.nodes(spark, d), "node_id", "left_semi").select("memory_id", F.lit(0.05).alias("boost")).distinct()
    return t.memories(spark, d).select("memory_id", "strength").join(strong, "memory_id", "left").select("memory_id", F.round(F.col("strength") + F.coalesce("boost", F.lit(0.0)), 6).alias("score"))


@query("c4_association_expansion", sql("""WITH seeds AS (SELECT memory_id, row_number() OVER (ORDER BY strength DESC, memory_id) AS rank FROM (SELECT memory_id, strength FROM memories WHERE NOT archived ORDER BY strength DESC, memory_id LIMIT 12)),
    both_ends AS (SELECT from_id AS memory_id, to_id AS other, weight, edge_id FROM associations UNION ALL SELECT to_id, from_id, weight, edge_id FROM associations),
    near AS (SELECT other, weight, rank, n FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY weight DESC, edge_id) AS n FROM both_ends JOIN seeds USING (memory_id) WHERE other <> memory_id) WHERE n <= 3),
    firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY other ORDER BY rank, n) AS m FROM near) WHERE m = 1)
    SELECT m.memory_id, rank AS seed_rank, round(strength * weight * 0.25 + exp(-0.1 * greatest(0, ($NOW - last_accessed_ms) / 86400000.0)) * 0.15 + least(access_count / 20.0, 1.0) * 0.1, 6)::DOUBLE AS score FROM firsts JOIN memories m ON m.memory_id = other WHERE NOT archived AND other NOT IN (SELECT memory_id FROM seeds)"""))
def c4(spark, d):
    m = t.memories(spark, d)
    seeds = top(m.where("NOT archived").select("memory_id", "strength"), 12, F.desc("strength"), F.asc("memory_id"))
    seeds = seeds.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("strength"), "memory_id")).cast("long")).drop("strength")  # twelve rows
    return graph.expansion(seeds, t.associations(spark, d), m, NOW_MS)


@query("c5_edge_listing", sql("SELECT a.edge_id, a.from_id, a.to_id, a.weight FROM associations a JOIN memories f ON f.memory_id = a.from_id JOIN memories g ON g.memory_id = a.to_id WHERE f.user_id = g.user_id"))
def c5(spark, d):
    m = t.memories(spark, d).select("memory_id", "user_id")
    a = t.associations(spark, d).join(m.select(F.col("memory_id").alias("from_id"), F.col("user_id").alias("u1")), "from_id").join(m.select(F.col("memory_id").alias("to_id"), F.col("user_id").alias("u2")), "to_id")
    return a.where("u1 = u2").select("edge_id", "from_id", "to_id", "weight")


_MATCH = "SELECT * FROM nodes WHERE contains(lower(label), 'nation_1') OR contains(lower(node_id), 'nation_1') ORDER BY node_id LIMIT 25"


def _matched(spark, d):
    return graph.matching(t.nodes(spark, d), " NATION_1 ")


@query("c9_label_search", sql(f"SELECT node_id, label FROM ({_MATCH})"))
def c9(spark, d):
    return _matched(spark, d).select("node_id", "label")


@query("c6_relations_of", sql(f"""WITH w AS ({_MATCH}) SELECT DISTINCT r.from_id, r.to_id, r.relation, r.confidence, CASE WHEN a.node_id IS NOT NULL AND b.node_id IS NOT NULL THEN 'both' WHEN a.node_id IS NOT NULL THEN 'from' ELSE 'to' END AS direction, n1.label AS from_label, n2.label AS to_label
    FROM relations r LEFT JOIN w a ON a.node_id = r.from_id LEFT JOIN w b ON b.node_id = r.to_id JOIN nodes n1 ON n1.node_id = r.from_id JOIN nodes n2 ON n2.node_id = r.to_id WHERE a.node_id IS NOT NULL OR b.node_id IS NOT NULL"""))
def c6(spark, d):
    return graph.relations_of(t.nodes(spark, d), t.relations(spark, d), _matched(spark, d))


@query("c7_ownership", sql(f"""WITH w AS ({_MATCH}) SELECT x.node_id, side, other_id, relation, confidence, n.label FROM (SELECT to_id AS node_id, 'owner' AS side, from_id AS other_id, relation, confidence FROM relations WHERE relation IN ('owns', 'assigned_to', 'leads_to')
    UNION ALL SELECT from_id, 'owned', to_id, relation, confidence FROM relations WHERE relation IN ('owns', 'assigned_to')) x JOIN w ON w.node_id = x.node_id JOIN nodes n ON n.node_id = other_id"""))
def c7(spark, d):
    return graph.ownership(t.nodes(spark, d), t.relations(spark, d), _matched(spark, d))


_TWO = "SELECT e1.{s} AS a, e1.{t} AS via, e2.{t} AS b, round(e1.confidence * e2.confidence, 6) AS score FROM relations e1 JOIN relations e2 ON e1.{t} = e2.{s} WHERE starts_with(e1.{s}, 'supplier:') AND starts_with(e2.{t}, 'region:') AND e1.{s} <> e2.{t}"


@query("c8_two_hops", sql(f"SELECT a, via, b, max(score) AS score FROM ({_TWO.format(s='from_id', t='to_id')} UNION ALL {_TWO.format(s='to_id', t='from_id')}) p WHERE NOT EXISTS (SELECT 1 FROM relations r WHERE (r.from_id = a AND r.to_id = b) OR (r.from_id = b AND r.to_id = a)) GROUP BY ALL"))
def c8(spark, d):
    n = t.nodes(spark, d)
    return graph.two_hops(t.relations(spark, d), n.where("node_type = 'supplier'"), n.where("node_type = 'region'"))


@query("c10_unclustered", sql("SELECT memory_id, created_ms FROM memories WHERE NOT archived AND memory_id NOT IN (SELECT memory_id FROM vectors) ORDER BY created_ms DESC, memory_id LIMIT 100"))
def c10(spark, d):
    rows = t.memories(spark, d).where("NOT archived").select("memory_id", "created_ms").join(t.vectors(spark, d).select("memory_id"), "memory_id", "left_anti")
    return top(rows, 100, F.desc("created_ms"), F.asc("memory_id"))


@query("c11_membership", sql("SELECT memory_id, ensemble_id FROM vectors WHERE memory_id IN (SELECT memory_id FROM memories WHERE store = 'semantic')"))
def c11(spark, d):
    return t.vectors(spark, d).select("memory_id", "ensemble_id").join(t.memories(spark, d).where("store = 'semantic'").select("memory_id"), "memory_id", "left_semi")


_WITHIN = "l.user_id = a.user_id AND a.ts BETWEEN l.created_ms AND l.created_ms + 1800000"


@query("c12_recall_then_activity", sql(f"SELECT l.log_id, a.event_id, a.memory_id, a.ts FROM recall_log l JOIN activity a ON {_WITHIN}"))
def c12(spark, d):
    return replay.within(t.recall_log(spark, d), t.activity(spark, d)).select("log_id", "event_id", "memory_id", "ts")


@query("c13_followed_up", sql("SELECT log_id, query FROM recall_log l WHERE EXISTS (SELECT 1 FROM activity a WHERE l.user_id = a.user_id AND a.ts BETWEEN l.created_ms AND l.created_ms + 864000000 AND a.event_type = 'memory_recalled' AND list_contains(l.top_ids, a.memory_id))"))
def c13(spark, d):
    return replay.followed_up(t.recall_log(spark, d), t.activity(spark, d), 10 * DAY_MS).select("log_id", "query")


def _repeated(spark, d):
    """Messages and, for some of them, a copy three seconds later."""
    m = t.messages(spark, d)
    again = m.where("message_id % 5 = 0").withColumn("message_id", F.col("message_id") + 500).withColumn("ts", F.col("ts") + 3000)
    return m.unionByName(again)


_REPEATED = "SELECT message_id, user_id, session_key, turn_id, turn_index, role, content, channel, ts FROM messages UNION ALL SELECT message_id + 500, user_id, session_key, turn_id, turn_index, role, content, channel, ts + 3000 FROM messages WHERE message_id % 5 = 0"
_SCOPED = f"SELECT *, sha256(role || chr(10) || lower({_HASH_TEXT})) AS h, coalesce('turn:' || turn_id || ':' || turn_index, 'session-turn:' || turn_index) AS sc FROM ({_REPEATED})"


@query("c14_near_time_repeats", sql(f"SELECT message_id, lag(ts) OVER w IS NOT NULL AS repeat FROM ({_SCOPED}) WINDOW w AS (PARTITION BY user_id, role, h, channel, session_key, sc ORDER BY ts, message_id)"))
def c14(spark, d):
    return dedupe.repeats_of_previous(_repeated(spark, d)).select("message_id", "repeat")


@query("c14_kept_after_band", sql(f"""WITH RECURSIVE r AS MATERIALIZED (SELECT user_id, role, content, message_id, ts, row_number() OVER (PARTITION BY user_id, role, content ORDER BY ts, message_id) AS step FROM ({_REPEATED})),
    go AS (SELECT *, ts AS last, true AS kept FROM r WHERE step = 1 UNION ALL SELECT r.*, CASE WHEN r.ts - g.last > 5000 THEN r.ts ELSE g.last END, r.ts - g.last > 5000 FROM go g JOIN r ON r.user_id = g.user_id AND r.role = g.role AND r.content = g.content AND r.step = g.step + 1)
    SELECT message_id, ts FROM go WHERE kept""", recursive=True))
def c14_kept(spark, d):
    return dedupe.near_time_kept(_repeated(spark, d).drop("expires_at", "embedded", "extracted_at"), ["user_id", "role", "content"]).select("message_id", "ts")


@query("c15_merged_memories", sql(f"""SELECT user_id, channel, h AS content_hash, min(memory_id) AS memory_id, count(*) AS copies, CASE WHEN count(*) > 1 THEN greatest(0.8, max(strength)) ELSE max(strength) END AS strength,
    CASE WHEN count(*) > 1 THEN greatest(0.9, max(confidence)) ELSE max(confidence) END AS confidence, array_to_string(list_sort(list_distinct(flatten(list(tags)))), ',') AS tags
    FROM (SELECT *, sha256(store || chr(10) || category || chr(10) || lower({_HASH_TEXT})) AS h FROM memories WHERE NOT archived) GROUP BY user_id, channel, h"""))
def c15(spark, d):
    return dedupe.merged_memories(t.memories(spark, d)).withColumn("tags", F.array_join("tags", ","))


@query("c16_same_title", sql(f"SELECT memory_id, min(memory_id) OVER (PARTITION BY user_id, store, category, channel, lower(trim(title)), {_HASH_TEXT}) AS keep_id FROM (SELECT * EXCLUDE (user_id), 0 AS user_id FROM memories) WHERE NOT archived"))
def c16(spark, d):
    return dedupe.same_title_and_content(t.memories(spark, d).withColumn("user_id", F.lit(0)))


@query("c17_similarity_edges", sql(f"""WITH p AS (SELECT a.memory_id AS x, b.memory_id AS y, {_COS} AS score FROM vectors a JOIN vectors b ON a.memory_id <> b.memory_id),
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY score DESC, y) AS n FROM p) WHERE n <= 3 AND score >= 0.25)
    SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b, score, CASE WHEN score > 0.35 THEN 'supports' ELSE 'co_occurred' END AS relation FROM k"""))
def c17(spark, d):
    v = t.vectors(spark, d)
    near = search.neighbours(v, v, 3, 0.25)
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score").distinct().withColumn("relation", F.when(F.col("score") > 0.35, "supports").otherwise("co_occurred"))


@query("c18_without_recent_edge", sql(f"SELECT memory_id FROM memories WHERE memory_id NOT IN (SELECT from_id FROM associations WHERE updated_ms >= {EPOCH_MS + 3 * DAY_MS})"))
def c18(spark, d):
    recent = t.associations(spark, d).where(F.col("updated_ms") >= EPOCH_MS + 3 * DAY_MS).select(F.col("from_id").alias("memory_id"))
    return t.memories(spark, d).select("memory_id").join(recent, "memory_id", "left_anti")


@query("c19_contradiction_pairs", sql(f"SELECT least(a.memory_id, b.memory_id) AS a, greatest(a.memory_id, b.memory_id) AS b, max({_COS}) AS score FROM vectors a JOIN vectors b ON a.ensemble_id = b.ensemble_id AND a.memory_id < b.memory_id WHERE {_COS} BETWEEN 0.2 AND 0.3 GROUP BY 1, 2"))
def c19(spark, d):
    v = t.vectors(spark, d)
    return search.similar_pairs(v, v, 0.2, 0.3, same="ensemble_id")


@query("c20_active_conflicts", sql("SELECT least(from_id, to_id)::VARCHAR AS lo, edge_id FROM associations WHERE relation = 'contradicts' AND edge_id NOT IN (SELECT edge_id FROM associations WHERE weight >= 0.5)"))
def c20(spark, d):
    a = t.associations(spark, d)
    meta = a.where("weight >= 0.5").select(F.to_json(F.struct(F.col("edge_id").alias("pairKey"), F.lit("unresolved").alias("status"))).alias("metadata"))
    active = meta.select(F.from_json("metadata", "pairKey long, status string").alias("m")).where("m.status = 'unresolved'").select(F.col("m.pairKey").alias("edge_id"))
    return a.where("relation = 'contradicts'").join(active, "edge_id", "left_anti").select(F.least("from_id", "to_id").cast("string").alias("lo"), "edge_id")


_CENTROIDS = "SELECT ensemble_id, list(m ORDER BY i) AS embedding FROM (SELECT ensemble_id, i, avg(embedding[i]) AS m FROM vectors, range(1, 65) r(i) GROUP BY ALL) GROUP BY ensemble_id"


@query("c22_centroid_drift", sql(f"WITH c AS ({_CENTROIDS}) SELECT a.memory_id, a.ensemble_id, {_COS} AS similarity FROM vectors a JOIN c b USING (ensemble_id) WHERE {_COS} >= 0.2"))
def c22(spark, d):
    return clustering.cohesion(t.vectors(spark, d)).where("similarity >= 0.2").select("memory_id", "ensemble_id", "similarity")


@query("c23_resonance", sql(f"""WITH c AS ({_CENTROIDS}), p AS (SELECT a.ensemble_id AS x, b.ensemble_id AS y, {_COS} AS score FROM c a JOIN c b ON a.ensemble_id <> b.ensemble_id WHERE {_COS} BETWEEN -0.1 AND 0.9),
    k AS (SELECT x, list_sort(list(y)) AS peers FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY score DESC, y) AS n FROM p) WHERE n <= 2 GROUP BY x HAVING count(*) >= 2)
    SELECT array_to_string(list_sort(list_append(peers, x)), '|') AS key, min(x)::BIGINT AS ensemble_id FROM k GROUP BY 1"""))
def c23(spark, d):
    return clustering.in_band(clustering.mean_vectors(t.vectors(spark, d), "ensemble_id"), -0.1, 0.9)


@query("c24_context_rows", sql("SELECT c.session_key, c.ordinal, c.item_type, coalesce(m.content, s.content) AS content FROM context_items c LEFT JOIN messages m ON c.item_type = 'message' AND m.message_id = c.ref_id LEFT JOIN summaries s ON c.item_type = 'summary' AND s.summary_id = c.ref_id"))
def c24(spark, d):
    c = t.context_items(spark, d)
    m = t.messages(spark, d).select(F.lit("message").alias("item_type"), F.col("message_id").alias("ref_id"), F.col("content").alias("m"))
    s = t.summaries(spark, d).select(F.lit("summary").alias("item_type"), F.col("summary_id").alias("ref_id"), F.col("content").alias("s"))
    return c.join(m, ["item_type", "ref_id"], "left").join(s, ["item_type", "ref_id"], "left").select("session_key", "ordinal", "item_type", F.coalesce("m", "s").alias("content"))


@query("c26_memory_trace", sql("SELECT m.memory_id, s.n AS messages FROM memories m LEFT JOIN (SELECT session_key, count(*) AS n FROM messages GROUP BY session_key) s ON s.session_key = m.memory_id WHERE m.user_id = 2"))
def c26(spark, d):
    s = t.messages(spark, d).groupBy(F.col("session_key").alias("memory_id")).agg(F.count(F.lit(1)).alias("messages"))
    return t.memories(spark, d).where("user_id = 2").select("memory_id").join(s, "memory_id", "left")


@query("c27_tool_triggers", sql("SELECT memory_id, max(last_accessed_ms) AS seen_ms FROM (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY last_accessed_ms DESC, memory_id) AS n FROM triggers WHERE tool IN ('tool1', 'tool3', 'tool6')) WHERE n <= 20 GROUP BY memory_id ORDER BY seen_ms DESC, memory_id LIMIT 50"))
def c27(spark, d):
    rows = top_per(t.triggers(spark, d).where(F.col("tool").isin("tool1", "tool3", "tool6")), ["tool"], 20, F.desc("last_accessed_ms"), F.asc("memory_id"))
    return top(rows.groupBy("memory_id").agg(F.max("last_accessed_ms").alias("seen_ms")), 50, F.desc("seen_ms"), F.asc("memory_id"))


@query("c28_hint_match", sql("SELECT hint, memory_id FROM (SELECT hint, memory_id, row_number() OVER (PARTITION BY hint ORDER BY created_ms DESC, memory_id) AS n FROM memories, (SELECT unnest(['le', 'die', 'the', 'que']) AS hint) WHERE NOT archived AND contains(lower(title || ' ' || content), hint)) WHERE n = 1"))
def c28(spark, d):
    text = F.lower(F.concat_ws(" ", "title", "content"))
    hints = F.array_compact(F.array(*[F.when(F.contains(text, F.lit(h)), h) for h in ("le", "die", "the", "que")]))
    rows = t.memories(spark, d).where("NOT archived").select("memory_id", "created_ms", F.explode(hints).alias("hint"))
    return best_per(rows, ["hint"], F.desc("created_ms"), F.asc("memory_id")).select("hint", "memory_id")


@query("c29_conflict_details", sql("SELECT a.edge_id, string_agg(m.title, ' | ' ORDER BY m.memory_id) AS members FROM associations a JOIN memories m ON m.memory_id IN (a.from_id, a.to_id) WHERE a.relation = 'contradicts' AND NOT m.archived GROUP BY a.edge_id"))
def c29(spark, d):
    ends = t.associations(spark, d).where("relation = 'contradicts'").select("edge_id", F.explode(F.array_distinct(F.array("from_id", "to_id"))).alias("memory_id"))
    rows = ends.join(t.memories(spark, d).where("NOT archived").select("memory_id", "title"), "memory_id")
    members = F.array_sort(F.collect_list(F.struct("memory_id", "title")))  # two rows
    return rows.groupBy("edge_id").agg(members.alias("x")).select("edge_id", F.array_join(F.transform("x", lambda x: x["title"]), " | ").alias("members"))


@query("c30_search_merge", sql("""SELECT message_id, max(score) AS score FROM (SELECT * FROM (SELECT message_id, 0.5::DOUBLE + (message_id % 7) / 20.0::DOUBLE AS score FROM messages WHERE embedded ORDER BY score DESC, message_id LIMIT 20) UNION ALL
    SELECT * FROM (SELECT message_id, (contains(lower(content), 'le'))::INT::DOUBLE + CASE WHEN contains(lower(content), 'le') THEN 5 ELSE 0 END + CASE WHEN starts_with(lower(content), 'le') THEN 1 ELSE 0 END AS score FROM messages WHERE contains(lower(content), 'le') ORDER BY score DESC, ts DESC, message_id LIMIT 20)) GROUP BY message_id ORDER BY score DESC, message_id LIMIT 30"""))
def c30(spark, d):
    m = t.messages(spark, d)
    near = top(m.where("embedded").select("message_id", (0.5 + (F.col("message_id") % 7) / 20.0).alias("score")), 20, F.desc("score"), F.asc("message_id"))
    text = search.message_search(m, "le", 20).select("message_id", "score")
    return search.merged_hits([near, text], "message_id", 30, F.desc("score"), F.asc("message_id"))


@query("c31_topic_memories", sql("""WITH last3 AS (SELECT content FROM messages WHERE role = 'user' ORDER BY ts DESC, message_id DESC LIMIT 3), w AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda x: length(x) > 3)) AS w FROM last3)
    SELECT DISTINCT memory_id FROM (SELECT memory_id, unnest(list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda x: length(x) > 3)) AS w FROM memories WHERE NOT archived) JOIN w USING (w) ORDER BY memory_id LIMIT 15"""))
def c31(spark, d):
    from mnemospark.functions.text import tokens

    last = top(t.messages(spark, d).where("role = 'user'"), 3, F.desc("ts"), F.desc("message_id"))
    words = last.select(F.explode(tokens(F.col("content"), 4)).alias("w")).distinct()
    rows = t.memories(spark, d).where("NOT archived").select("memory_id", F.explode(F.array_distinct(tokens(F.col("content"), 4))).alias("w"))
    return top(rows.join(words, "w", "left_semi").select("memory_id").distinct(), 15, F.asc("memory_id"))


@query("c32_evidence", sql("SELECT title, store, min(memory_id) AS memory_id FROM memories WHERE memory_id IN (SELECT unnest(top_ids) FROM recall_log) GROUP BY title, store"))
def c32(spark, d):
    ids = t.recall_log(spark, d).select(F.explode("top_ids").alias("memory_id")).distinct()
    return t.memories(spark, d).join(ids, "memory_id", "left_semi").groupBy("title", "store").agg(F.min("memory_id").alias("memory_id"))


@query("c34_base_by_name", sql("SELECT n, arg_max(kb_id, (stored_count, kb_id)) AS kb_id, count(*) AS copies FROM (SELECT kb_id, stored_count, right(kb_id, 1) AS n FROM knowledge_bases) GROUP BY n"))
def c34(spark, d):
    k = t.knowledge_bases(spark, d).withColumn("n", F.right("kb_id", F.lit(1)))
    return k.groupBy("n").agg(F.max_by("kb_id", F.struct("stored_count", "kb_id")).alias("kb_id"), F.count(F.lit(1)).alias("copies"))


