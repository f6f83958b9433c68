"""DuckDB SQL of the logical tables, for the checks of the registered queries."""

from __future__ import annotations

import re

from mnemospark.sources.tables import CATEGORIES, DAY_MS, EPOCH_MS, HOUR_MS, MINUTE_MS, NOW_MS, RELATIONS, STORES, TRACE_TYPES


def _pick(values: tuple[str, ...], index: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[CAST({index} AS BIGINT) % {len(values)} + 1]"


_CREATED = f"({EPOCH_MS} + doc_id * {10 * MINUTE_MS})"
_TS = f"({EPOCH_MS} + conv_id * {HOUR_MS} + turn * {MINUTE_MS})"
VIEWS = {
    "memories": f"""SELECT doc_id AS memory_id, doc_id // 3 % 20 AS user_id, substring(text, 1, 80) AS title, text AS content, lang AS channel,
        CASE WHEN doc_id % 7 = 0 THEN source END AS kb_id, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 5 AS VARCHAR) END AS scope,
        {_pick(STORES, "doc_id")} AS store, {_pick(CATEGORIES, "doc_id // 5")} AS category,
        (doc_id * 37 % 101) / 100.0::DOUBLE AS strength, (doc_id * 53 % 101) / 100.0::DOUBLE AS confidence, (doc_id * 29 % 101) / 100.0::DOUBLE AS salience,
        (doc_id * 17 % 201) / 100.0::DOUBLE - 1 AS valence, (doc_id * 71 % 101) / 100.0::DOUBLE AS arousal, doc_id % 25 AS access_count,
        {_CREATED} AS created_ms, {_CREATED} + doc_id % 30 * {DAY_MS} AS last_accessed_ms, [lang, source] AS tags, doc_id % 11 = 0 AS archived,
        '{{"skillFormat":true,"observationCount":' || (doc_id % 5) || ',"lastObserved":' || ({_CREATED} + doc_id % 40 * {DAY_MS}) || '}}' AS metadata FROM documents""",
    "messages": f"""SELECT conv_id * 1000 + turn AS message_id, conv_id % 10 AS user_id, conv_id AS session_key,
        CASE WHEN conv_id % 3 = 0 THEN conv_id || '-' || (turn // 2) END AS turn_id, turn AS turn_index, role, text AS content, 'ch' || (conv_id % 4) AS channel,
        {_TS} AS ts, {_TS} + (conv_id % 60 + 1) * {DAY_MS} AS expires_at, conv_id % 2 = 0 AS embedded, CASE WHEN conv_id % 4 = 0 THEN {_TS} + {HOUR_MS} END AS extracted_at FROM conversations""",
    "event_rows": "SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "activity": "SELECT event_id, user_id, CASE WHEN event_type = 'view' THEN 'memory_recalled' ELSE 'memory_stored' END AS event_type, k AS memory_id, ts FROM event_rows WHERE event_type IN ('view', 'click')",
    "recall_log": "SELECT event_id AS log_id, user_id, 'topic ' || k AS query, [k, (k + 1) % 100, (k + 2) % 100] AS top_ids, k % 4 AS result_count, k % 3 AS trace_hits, round(value) % 100 / 100.0::DOUBLE AS top_score, ts AS created_ms FROM event_rows WHERE event_type = 'purchase'",
    "runs": "SELECT event_id AS run_id, user_id, CASE WHEN k % 5 = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN k % 3 = 0 THEN 'scheduled' ELSE 'manual' END AS trigger, value AS cost, k AS traces, ts AS started_ms FROM event_rows WHERE event_type = 'error'",
    "requests": "SELECT event_id, user_id, event_type, ts FROM event_rows",
    "traces": f"""SELECT conv_id * 1000 + turn AS trace_id, conv_id % 10 AS user_id, text AS predicted_query, {_pick(TRACE_TYPES, "(conv_id * 1000 + turn)")} AS trace_type,
        ((conv_id * 1000 + turn) * 31 % 101) / 100.0::DOUBLE AS confidence, {EPOCH_MS} + conv_id * {HOUR_MS} AS created_ms, {EPOCH_MS} + conv_id * {HOUR_MS} + (conv_id * 1000 + turn) % 72 * {HOUR_MS} AS expires_ms,
        CASE (conv_id * 1000 + turn) % 3 WHEN 0 THEN true WHEN 1 THEN false END AS validated, (conv_id * 1000 + turn) % 9 AS access_count FROM conversations WHERE role = 'user'""",
    "vectors": "SELECT vec_id AS memory_id, CAST(embedding AS DOUBLE[]) AS embedding, label AS ensemble_id FROM embeddings",
    "knowledge_bases": """SELECT kb_id, n + b % 3 AS stored_count, chars - b % 2 * 10 AS stored_chars, b % 6 <> 5 AS is_active, CASE WHEN b % 2 = 0 THEN ['coach', 'coder'] ELSE [] END AS agent_ids,
        CASE WHEN b % 3 = 0 THEN CAST(b % 5 AS VARCHAR) END AS scope, CASE b % 4 WHEN 0 THEN 'permissive' WHEN 1 THEN 'strict' END AS policy
        FROM (SELECT kb_id, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars, CAST(regexp_extract(kb_id, '([0-9]+)$', 1) AS BIGINT) AS b FROM memories WHERE kb_id IS NOT NULL GROUP BY kb_id)""",
    "associations": f"SELECT doc_id AS edge_id, doc_id AS from_id, doc_id // 2 AS to_id, {_pick(RELATIONS, 'doc_id')} AS relation, (doc_id * 41 % 101) / 100.0::DOUBLE AS weight, {_CREATED} AS updated_ms FROM documents WHERE doc_id > 0",
    "node_links": "SELECT doc_id AS memory_id, 'nation:' || (doc_id % 25) AS node_id, (doc_id * 67 % 101) / 100.0::DOUBLE AS confidence FROM documents",
    "triggers": "SELECT memory_id, 'tool' || (memory_id % 8) AS tool, last_accessed_ms FROM memories WHERE memory_id % 3 = 0",
    "nodes": """SELECT 'region:' || r_regionkey AS node_id, 'region' AS node_type, r_name AS label FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name FROM nation
        UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name FROM supplier UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name FROM customer UNION ALL SELECT 'part:' || p_partkey, 'part', p_name FROM part""",
    "relations": """SELECT 'nation:' || n_nationkey AS from_id, 'region:' || n_regionkey AS to_id, 'depends_on' AS relation, (n_nationkey::BIGINT * 43 % 101) / 100.0::DOUBLE AS confidence FROM nation
        UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'assigned_to', (s_suppkey * 43 % 101) / 100.0::DOUBLE FROM supplier
        UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'assigned_to', (c_custkey * 43 % 101) / 100.0::DOUBLE FROM customer
        UNION ALL SELECT 'customer:' || c_custkey, 'part:' || p_partkey, 'owns', (p_partkey * 43 % 101) / 100.0::DOUBLE FROM customer JOIN part ON c_custkey = p_partkey
        UNION ALL SELECT 'part:' || p_partkey, 'part:' || (p_partkey // 2), 'depends_on', (p_partkey * 43 % 101) / 100.0::DOUBLE FROM part WHERE p_partkey > 0""",
    "summaries": "SELECT message_id AS summary_id, session_key, turn_index % 2 AS depth, content, CAST(ceil(length(content) / 4.0) AS BIGINT) AS tokens, ts FROM messages WHERE role = 'assistant'",
    "context_items": "SELECT session_key, turn_index AS ordinal, CASE WHEN role = 'assistant' AND turn_index < 4 THEN 'summary' ELSE 'message' END AS item_type, message_id AS ref_id FROM messages",
}


def sql(body: str, recursive: bool = False) -> str:
    """body with the views it names, and those they name, as common table expressions; $NOW is the queries' instant."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name, view in VIEWS.items():
            if re.search(rf"\b{name}\b", text) and name not in needed:
                need(view)
                if name not in needed:
                    needed.append(name)

    need(body)
    body = body.replace("$NOW", str(NOW_MS)).strip()
    ctes = [f"{n} AS ({VIEWS[n]})" for n in needed]
    if body[:5].upper() == "WITH ":
        rest = body[5:].strip()
        if rest[:9].upper() == "RECURSIVE":
            rest, recursive = rest[9:], True
        return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join([*ctes, rest])
    return (f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(ctes) + "\n" if ctes else "") + body
