"""Reads: lookups, ranges, newest rows, text and vector searches, exports (rows A of the survey)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.operators import search
from mnemospark.operators import windows as W
from mnemospark.operators.common import keyset_page, top, top_per
from mnemospark.plans.oracle import sql
from mnemospark.registry import query
from mnemospark.sources import tables as t
from mnemospark.sources.tables import DAY_MS, EPOCH_MS, NOW_MS

_COSINE = "round(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))), 6)"
_Q = _COSINE.format(a="v.embedding", b="q.embedding")


def query_vector(spark, d, key: int = 0) -> list[float]:
    return t.vectors(spark, d).where(F.col("memory_id") == key).first()["embedding"]


@query("a1_batch_lookup", sql("SELECT memory_id, user_id, store, strength FROM memories WHERE memory_id IN (SELECT DISTINCT memory_id FROM activity) AND user_id = 3"))
def a1(spark, d):
    ids = t.activity(spark, d).select("memory_id").distinct()
    return t.memories(spark, d).where("user_id = 3").join(ids, "memory_id", "left_semi").select("memory_id", "user_id", "store", "strength")


@query("a2_filtered_list", sql("SELECT memory_id, store, category, last_accessed_ms FROM memories WHERE store = 'semantic' AND NOT archived AND strength BETWEEN 0.2 AND 0.9 AND list_contains(tags, 'en') ORDER BY last_accessed_ms DESC, memory_id LIMIT 50"))
def a2(spark, d):
    rows = t.memories(spark, d).where("store = 'semantic' AND NOT archived AND strength BETWEEN 0.2 AND 0.9 AND array_contains(tags, 'en')")
    return top(rows, 50, F.desc("last_accessed_ms"), F.asc("memory_id")).select("memory_id", "store", "category", "last_accessed_ms")


_A3 = (EPOCH_MS + DAY_MS, EPOCH_MS + 3 * DAY_MS)


@query("a3_date_range", sql(f"SELECT memory_id, created_ms FROM memories WHERE created_ms BETWEEN {_A3[0]} AND {_A3[1]} AND NOT archived ORDER BY created_ms, memory_id LIMIT 50"))
def a3(spark, d):
    return top(t.memories(spark, d).where(F.col("created_ms").between(*_A3) & ~F.col("archived")), 50, F.asc("created_ms"), F.asc("memory_id")).select("memory_id", "created_ms")


@query("a4_recent_messages", sql("SELECT message_id, ts, role FROM messages WHERE channel = 'ch1' ORDER BY ts DESC, message_id DESC LIMIT 20"))
def a4(spark, d):
    return top(t.messages(spark, d).where("channel = 'ch1'"), 20, F.desc("ts"), F.desc("message_id")).orderBy("ts", "message_id").select("message_id", "ts", "role")


@query("a5_session_scan", sql(f"SELECT message_id, turn_index, content FROM messages WHERE session_key = 3 AND ts >= {EPOCH_MS}"))
def a5(spark, d):
    return t.messages(spark, d).where((F.col("session_key") == 3) & (F.col("ts") >= EPOCH_MS)).orderBy("ts").select("message_id", "turn_index", "content")


@query("a8_integrity_audit", sql("SELECT count(*) AS n, count(*) FILTER (content IS NULL) AS missing_text, count(*) FILTER (title = '') AS untitled, count(*) FILTER (contains(channel, '|')) AS bad_channel FROM memories"))
def a8(spark, d):
    return t.memories(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("content").isNull()).alias("missing_text"), F.count_if(F.col("title") == "").alias("untitled"), F.count_if(F.contains("channel", F.lit("|"))).alias("bad_channel"))


@query("a9_missing_field", sql("SELECT message_id, ts FROM messages WHERE extracted_at IS NULL AND ts <= $NOW AND role <> 'system'"))
def a9(spark, d):
    return t.messages(spark, d).where(F.col("extracted_at").isNull() & (F.col("ts") <= NOW_MS) & (F.col("role") != "system")).orderBy("ts", "message_id").select("message_id", "ts")


@query("a10_tiered_text", sql("""SELECT memory_id, hint FROM (SELECT memory_id, last_accessed_ms, CASE WHEN list_contains(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda x: length(x) >= 2), 'the') THEN 1.0 WHEN list_contains(regexp_split_to_array(lower(content), '[^a-z0-9]+'), 'the') THEN 0.75 END::DOUBLE AS hint FROM memories WHERE NOT archived) WHERE hint IS NOT NULL ORDER BY hint DESC, last_accessed_ms DESC, memory_id LIMIT 50"""))
def a10(spark, d):
    return search.tiered_text(t.memories(spark, d).where("NOT archived"), "the", 50)


_LEX = "CASE WHEN contains(lower(content), 'the re') THEN 5.0 ELSE 0.0 END"
_LEXICAL = f"""SELECT message_id, ts, round(e + s + h / 2.0, 6)::DOUBLE AS score FROM (SELECT message_id, ts, {_LEX} AS e, CASE WHEN starts_with(lower(content), 'the re') THEN 1.0 ELSE 0.0 END AS s,
    (contains(lower(content), 'the'))::INT + (contains(lower(content), 're'))::INT AS h FROM messages WHERE role <> 'system') WHERE e > 0 OR h > 0"""


@query("a11_message_text_search", sql(f"SELECT message_id, score FROM ({_LEXICAL}) ORDER BY score DESC, ts DESC, message_id LIMIT 50"))
def a11(spark, d):
    return search.message_search(t.messages(spark, d).where("role != 'system'"), '"the re"', 50).select("message_id", "score")


@query("a12_trace_text_match", sql("SELECT trace_id FROM traces WHERE validated IS NULL AND expires_ms > 1704240000000 AND contains(lower(predicted_query), 'en') ORDER BY confidence DESC, trace_id LIMIT 20"))
def a12(spark, d):
    rows = t.traces(spark, d).where(F.col("validated").isNull() & (F.col("expires_ms") > EPOCH_MS + 2 * DAY_MS) & F.contains(F.lower("predicted_query"), F.lit("en")))
    return top(rows, 20, F.desc("confidence"), F.asc("trace_id")).select("trace_id")


@query("a13_nearest", sql(f"SELECT v.memory_id, {_Q} AS score FROM vectors v, vectors q WHERE q.memory_id = 0 ORDER BY score DESC, v.memory_id LIMIT 20"))
def a13(spark, d):
    return search.nearest(t.vectors(spark, d).select("memory_id", "embedding"), query_vector(spark, d), 20)


@query("a14_nearest_filtered", sql(f"SELECT v.memory_id, {_Q} AS score FROM vectors v JOIN memories m USING (memory_id), vectors q WHERE q.memory_id = 1 AND m.channel = 'en' AND NOT m.archived ORDER BY score DESC, v.memory_id LIMIT 20"))
def a14(spark, d):
    ids = t.memories(spark, d).where("channel = 'en' AND NOT archived").select("memory_id")
    return search.nearest(t.vectors(spark, d).select("memory_id", "embedding").join(ids, "memory_id", "left_semi"), query_vector(spark, d, 1), 20)


@query("a15_nearest_in_base", sql(f"SELECT v.memory_id, {_Q} AS score FROM vectors v JOIN memories m USING (memory_id), vectors q WHERE q.memory_id = 2 AND m.kb_id IS NOT NULL ORDER BY score DESC, v.memory_id LIMIT 12"))
def a15(spark, d):
    ids = t.memories(spark, d).where("kb_id IS NOT NULL").select("memory_id")
    return search.nearest(t.vectors(spark, d).select("memory_id", "embedding").join(ids, "memory_id", "left_semi"), query_vector(spark, d, 2), 12)


@query("a16_nearest_centroid", sql("""WITH c AS (SELECT ensemble_id, list(m ORDER BY i) AS embedding FROM (SELECT ensemble_id, i, avg(embedding[i]) AS m FROM vectors, range(1, 65) r(i) GROUP BY ALL) GROUP BY ensemble_id)
    SELECT v.ensemble_id, """ + _Q + " AS score FROM c v, vectors q WHERE q.memory_id = 3 ORDER BY score DESC, v.ensemble_id LIMIT 5"))
def a16(spark, d):
    from mnemospark.operators.clustering import mean_vectors

    c = mean_vectors(t.vectors(spark, d), "ensemble_id").withColumnRenamed("centroid", "embedding").drop("n")
    return search.nearest(c, query_vector(spark, d, 3), 5, "ensemble_id").select("ensemble_id", "score")


@query("a17_trace_vectors", sql(f"SELECT memory_id, score FROM (SELECT v.memory_id, {_Q} AS score FROM vectors v, vectors q WHERE q.memory_id = 4 ORDER BY score DESC, v.memory_id LIMIT 20) WHERE score >= 0.2 AND memory_id % 3 <> 0"))
def a17(spark, d):
    found = search.nearest(t.vectors(spark, d).select("memory_id", "embedding"), query_vector(spark, d, 4), 20)  # the cut comes before the filter
    return found.where("score >= 0.2 AND memory_id % 3 != 0")


@query("a18_local_store_like", sql("SELECT session_key, turn_index, role FROM messages WHERE content LIKE '%en%' AND role = 'user'"))
def a18(spark, d):
    return t.messages(spark, d).where("content LIKE '%en%' AND role = 'user'").select("session_key", "turn_index", "role")



@query("a20_chunk_export", sql(f"""SELECT lang, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS chunk_no, count(*) OVER (PARTITION BY source) AS chunks, source || ' — Chunk ' || row_number() OVER (PARTITION BY source ORDER BY doc_id) || '/' || count(*) OVER (PARTITION BY source) AS title FROM documents"""))
def a20(spark, d):
    rows = W.numbered_chunks(t.table(spark, d, "documents").select("doc_id", "source", "lang"), "source", "doc_id")
    title = F.concat(F.col("source"), F.lit(" — Chunk "), F.col("chunk_no").cast("string"), F.lit("/"), F.col("chunks").cast("string"))
    return rows.select("lang", "doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "chunks", title.alias("title"))


@query("a21_bulk_chunk_insert", sql("SELECT kb_id, count(*) AS inserted, CAST(sum(length(content)) AS BIGINT) AS chars FROM memories WHERE kb_id IS NOT NULL AND NOT regexp_matches(content, '[A-Za-z0-9+/=]{500}') GROUP BY kb_id"))
def a21(spark, d):
    from mnemospark.operators.gates import THREATS

    rows = t.memories(spark, d).where(F.col("kb_id").isNotNull() & ~F.col("content").rlike(dict(THREATS)["encoded_payload"]))
    return rows.groupBy("kb_id").agg(F.count(F.lit(1)).alias("inserted"), F.sum(F.length("content")).alias("chars"))


@query("a22_base_list", sql("SELECT kb_id, stored_count, coalesce(policy, 'strict') AS policy, coalesce(scope, '') AS scope FROM knowledge_bases WHERE is_active"))
def a22(spark, d):
    return t.knowledge_bases(spark, d).where("is_active").select("kb_id", "stored_count", F.coalesce("policy", F.lit("strict")).alias("policy"), F.coalesce("scope", F.lit("")).alias("scope"))


@query("a23_snapshot", sql("SELECT session_key, count(*) AS messages, CAST(ceil(sum(length(content)) / 4.0) AS BIGINT) AS tokens, string_agg(role, ',' ORDER BY turn_index) AS roles FROM messages GROUP BY session_key"))
def a23(spark, d):
    m = t.messages(spark, d).groupBy("session_key").agg(F.count(F.lit(1)).alias("messages"), F.ceil(F.sum(F.length("content")) / 4).alias("tokens"), F.array_sort(F.collect_list(F.struct("turn_index", "role"))).alias("x"))
    return m.select("session_key", "messages", "tokens", F.array_join(F.transform("x", lambda x: x["role"]), ",").alias("roles"))


@query("a24_embed_queue", sql("SELECT message_id, ts FROM messages WHERE NOT embedded ORDER BY ts, message_id LIMIT 50"))
def a24(spark, d):
    return top(t.messages(spark, d).where("NOT embedded"), 50, F.asc("ts"), F.asc("message_id")).select("message_id", "ts")


@query("a25_without_vectors", sql("SELECT memory_id, ensemble_id FROM vectors"))
def a25(spark, d):
    return t.vectors(spark, d).drop("embedding")


@query("a28_vault_export", sql(r"""SELECT store, 'memory-' || memory_id || '.md' AS file, '---' || chr(10) || 'store: ' || store || chr(10) || 'category: ' || category || chr(10) || 'tags: [' || array_to_string(tags, ', ') || ']' || chr(10) || '---' || chr(10) || content AS body FROM memories WHERE NOT archived"""))
def a28(spark, d):
    from mnemospark.sources.files import vault_rows

    return vault_rows(t.memories(spark, d).where("NOT archived"))


@query("a29_embedding_text", sql("SELECT memory_id, coalesce(nullif(title, ''), nullif(content, ''), store) AS text FROM memories"))
def a29(spark, d):
    empty = F.lit("")
    return t.memories(spark, d).select("memory_id", F.coalesce(F.nullif("title", empty), F.nullif("content", empty), "store").alias("text"))


@query("a31_stale_traces", sql("SELECT trace_id, expires_ms FROM traces WHERE expires_ms <= $NOW AND validated IS NULL ORDER BY expires_ms, trace_id LIMIT 200"))
def a31(spark, d):
    return top(t.traces(spark, d).where((F.col("expires_ms") <= NOW_MS) & F.col("validated").isNull()), 200, F.asc("expires_ms"), F.asc("trace_id")).select("trace_id", "expires_ms")


@query("a32_recent_samples", sql("SELECT log_id, user_id FROM (SELECT * FROM recall_log ORDER BY created_ms DESC, log_id DESC LIMIT 200) WHERE result_count > 0"))
def a32(spark, d):
    newest = top(t.recall_log(spark, d), 200, F.desc("created_ms"), F.desc("log_id"))  # the cut comes before the filter
    return newest.where("result_count > 0").select("log_id", "user_id")


@query("b23_keyset_page", sql("SELECT memory_id, created_ms, n > 25 AS has_more FROM (SELECT memory_id, created_ms, count(*) OVER () AS n, row_number() OVER (ORDER BY created_ms DESC, memory_id DESC) AS i FROM (SELECT memory_id, created_ms FROM memories WHERE created_ms < 1704133800000 OR (created_ms = 1704133800000 AND memory_id < 111) ORDER BY created_ms DESC, memory_id DESC LIMIT 26)) WHERE i <= 25"))
def b23(spark, d):
    return keyset_page(t.memories(spark, d).select("memory_id", "created_ms"), 25, (1704133800000, 111), "created_ms", "memory_id")


@query("bm25_search", sql("""WITH tok AS (SELECT memory_id, list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda x: length(x) >= 2) AS w FROM memories),
    tf AS (SELECT memory_id, len(w) AS n, len(list_filter(w, lambda x: x = 'er')) AS a, len(list_filter(w, lambda x: x = 'the')) AS b FROM tok),
    st AS (SELECT count(*) AS n, avg(n) AS avgn, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM tf)
    SELECT memory_id, round(ln(1 + (st.n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * tf.n / avgn)) + ln(1 + (st.n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * tf.n / avgn)), 6) AS score FROM tf, st WHERE a > 0 OR b > 0 ORDER BY score DESC, memory_id LIMIT 25"""))
def bm25(spark, d):
    return search.bm25(t.memories(spark, d), "the er", 25)


@query("f3_top_per_source", sql("SELECT source, doc_id, n_chars FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 3"))
def f3(spark, d):
    return top_per(t.table(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], 3, F.desc("n_chars"), F.asc("doc_id"))


