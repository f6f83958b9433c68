"""Query surface: hybrid recall and the calls built on it (rows H3-3, L and 3 of the survey)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import scoring as S
from mnemospark.operators import recall as R
from mnemospark.operators.common import top
from mnemospark.plans.oracle import sql
from mnemospark.plans.scans import query_vector
from mnemospark.registry import query
from mnemospark.sources import tables as t
from mnemospark.sources.tables import NOW_MS

_COS = "round(list_dot_product(v.embedding, q.embedding) / (sqrt(list_dot_product(v.embedding, v.embedding)) * sqrt(list_dot_product(q.embedding, q.embedding))), 6)"
_COLLAPSED = r"regexp_replace(lower(regexp_replace({0}, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')), '[ \t\n\r\f]+', ' ', 'g')"
_TOKENS = "regexp_split_to_array(lower({0}), '[^a-z0-9]+')"


def _score(vector: str, text: str, weights: dict, channel: str | None = None) -> str:
    w = {**S.WEIGHTS, **weights}
    clamp = lambda x: f"least(1.0, greatest(0.0, {x}))::DOUBLE"
    near = f"CASE WHEN lower(trim(channel)) = '{channel}' THEN 1.0 ELSE 0.0 END::DOUBLE" if channel else "0.0::DOUBLE"
    parts = {
        "vector": clamp(vector), "strength": "strength", "freshness": "exp(-0.12 * greatest(0.0, ($NOW - created_ms) / 86400000.0::DOUBLE))",
        "access": "least(1.0, least(access_count / 20.0::DOUBLE, 1.0) * 0.55::DOUBLE + exp(-0.08 * greatest(0.0, ($NOW - last_accessed_ms) / 86400000.0::DOUBLE)) * 0.45::DOUBLE)",
        "salience": "salience", "continuity": near, "text": clamp(text), "kb": "CASE WHEN kb_id IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE",
    }
    return "round(" + " + ".join(f"({parts[k]}) * {w[k]}::DOUBLE" for k in S.WEIGHTS) + ", 6)"


_FACTOR = "CASE WHEN category = 'workflow' AND CAST(json_extract(metadata, '$.observationCount') AS DOUBLE) < 3 THEN 0.5 ELSE 1.0 END::DOUBLE"


def _ranked(source: str, weights: dict, channel: str | None = None, least: float = S.LEAST_SCORE, boost: str = "0.0::DOUBLE") -> str:
    """Common table expressions up to ``final`` (memory_id, score, text_score) over rows of ``source``."""
    return f"""scored AS (SELECT *, {_score('vector_score', 'text_score', weights, channel)} AS s0 FROM {source}),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_COLLAPSED.format('title')}, {_COLLAPSED.format('content')} ORDER BY s0 DESC, memory_id) AS nn FROM scored) WHERE nn = 1),
    final AS (SELECT *, round(s1 + {boost}, 6) AS score FROM (SELECT *, round(s0 * {_FACTOR}, 6) AS s1 FROM best) WHERE s1 >= {least})"""


def _recall_sql(mode: str, key: int, word: str, channel: str | None = None, boosted: bool = False) -> str:
    m = S.MODES[mode]
    n = min(20, max(1, m.limit))
    take = min(100, max(20, 4 * n))
    where = ["NOT archived"]
    if m.stores:
        where.append(f"store IN {m.stores}")
    if m.categories:
        where.append(f"category IN {m.categories}")
    if channel:
        where.append(f"(kb_id IS NOT NULL OR channel IS NULL OR channel = '{channel}')")
    boost = "CASE WHEN memory_id IN (SELECT memory_id FROM node_links WHERE confidence > 0.7) THEN 0.05 ELSE 0.0 END::DOUBLE" if boosted else "0.0::DOUBLE"
    return sql(f"""WITH pool AS (SELECT * FROM memories WHERE {' AND '.join(where)}),
    near AS (SELECT v.memory_id, {_COS} AS vector_score, 0.0::DOUBLE AS hint FROM vectors v JOIN pool USING (memory_id), vectors q WHERE q.memory_id = {key} ORDER BY vector_score DESC, v.memory_id LIMIT {take}),
    txt AS (SELECT memory_id, 0.0::DOUBLE AS vector_score, CASE WHEN list_contains({_TOKENS.format('title')}, '{word}') THEN 1.0 WHEN list_contains({_TOKENS.format('content')}, '{word}') THEN 0.75 END::DOUBLE AS hint, last_accessed_ms FROM pool WHERE list_contains({_TOKENS.format('title')}, '{word}') OR list_contains({_TOKENS.format('content')}, '{word}') ORDER BY hint DESC, last_accessed_ms DESC, memory_id LIMIT {take}),
    cand AS (SELECT memory_id, max(vector_score) AS vector_score, max(hint) AS text_score FROM (SELECT * FROM near UNION ALL SELECT memory_id, vector_score, hint FROM txt) GROUP BY memory_id),
    rows0 AS (SELECT * FROM cand JOIN pool USING (memory_id)), {_ranked('rows0', dict(m.weights), channel, boost=boost)}
    SELECT memory_id, title, content, store, category, score, text_score FROM final ORDER BY score DESC, text_score DESC, memory_id LIMIT {2 * n}""")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid recall for one query: nearest vectors and text hits, eight signals, equal texts reduced, weak ones dropped, linked ones boosted."""
    return R.recall(t.memories(spark, sf_dir), t.vectors(spark, sf_dir), query_vector(spark, sf_dir, 0), "the", NOW_MS, links=t.node_links(spark, sf_dir))


query("l1_recall", _recall_sql("general", 0, "the", boosted=True))(flagship)


@query("l1_recall_decision", _recall_sql("decision", 5, "en", "en"))
def l1_decision(spark, d):
    return R.recall(t.memories(spark, d), t.vectors(spark, d), query_vector(spark, d, 5), "en", NOW_MS, "decision", "en")


@query("l1_recall_conversation", _recall_sql("conversation", 7, "die"))
def l1_conversation(spark, d):
    return R.recall(t.memories(spark, d), t.vectors(spark, d), query_vector(spark, d, 7), "die", NOW_MS, "conversation")


@query("l1_distinct_results")
def l1_distinct(spark, d):
    return R.distinct_results(flagship(spark, d), 8).select("memory_id", "score")


@query("h3_recall_score", sql(f"SELECT memory_id, {_score('0.5', 'confidence', {}, 'en')} AS score FROM memories"))
def h3_3(spark, d):
    return t.memories(spark, d).select("memory_id", F.round(S.recall_score(S.signals(NOW_MS, F.lit(0.5), F.col("confidence"), "EN ")), 6).alias("score"))


_HAY = _COLLAPSED.format("title || ' ' || content || ' ' || array_to_string(tags, ' ')")
_MATCH = "greatest(contains({h}, '{p}')::INT::DOUBLE, " + "(contains({h}, '{a}')::INT + contains({h}, '{b}')::INT) / 2.0)"


@query("l2_lexical_fallback", sql(f"WITH rows0 AS (SELECT *, 0.0::DOUBLE AS vector_score, round({_MATCH.format(h=_HAY, p='the er', a='the', b='er')}, 6)::DOUBLE AS text_score FROM memories WHERE NOT archived), hit AS (SELECT * FROM rows0 WHERE text_score > 0), {_ranked('hit', {}, least=0.0)} SELECT memory_id, score, text_score FROM final ORDER BY score DESC, text_score DESC, memory_id LIMIT 20"))
def l2(spark, d):
    return R.lexical_fallback(t.memories(spark, d).where("NOT archived"), "the er", 20, NOW_MS)


@query("l5_preflight", sql("SELECT bucket, count(*) AS n, max(strength) AS best FROM (SELECT CASE category WHEN 'rule' THEN 'rules' WHEN 'lesson' THEN 'lessons' WHEN 'decision' THEN 'decisions' ELSE 'other' END AS bucket, strength FROM (SELECT * FROM memories WHERE NOT archived ORDER BY strength DESC, memory_id LIMIT 40)) GROUP BY bucket"))
def l5(spark, d):
    best = top(t.memories(spark, d).where("NOT archived"), 40, F.desc("strength"), F.asc("memory_id"))
    bucket = F.when(F.col("category") == "rule", "rules").when(F.col("category") == "lesson", "lessons").when(F.col("category") == "decision", "decisions").otherwise("other")
    return best.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.max("strength").alias("best"))


@query("l7_query_base", sql(f"""WITH rows0 AS (SELECT m.*, coalesce(x.s, 0.0::DOUBLE) AS vector_score, round({_MATCH.format(h=_HAY, p='le', a='le', b='le')}, 6)::DOUBLE AS text_score FROM memories m LEFT JOIN (SELECT v.memory_id, {_COS} AS s FROM vectors v, vectors q WHERE q.memory_id = 9) x USING (memory_id) WHERE kb_id = 'src7' AND NOT archived),
    {_ranked('rows0', {'kb': 0.08}, least=0.0)} SELECT memory_id, score FROM final ORDER BY score DESC, text_score DESC, memory_id LIMIT 12"""))
def l7(spark, d):
    return R.query_base(t.memories(spark, d), t.vectors(spark, d), query_vector(spark, d, 9), "src7", "le", 12, NOW_MS)


@query("l8_local_grep", sql("SELECT c.session_key, c.ordinal FROM context_items c JOIN messages m ON m.message_id = c.ref_id WHERE regexp_matches(m.content, '(?i)en.*le') ORDER BY c.session_key, c.ordinal LIMIT 30"))
def l8(spark, d):
    m = t.messages(spark, d).where(F.col("content").rlike("(?i)en.*le")).select(F.col("message_id").alias("ref_id"))
    return top(t.context_items(spark, d).join(m, "ref_id"), 30, F.asc("session_key"), F.asc("ordinal")).select("session_key", "ordinal")


@query("l12_vector_mean", sql("SELECT ensemble_id, count(*) AS n FROM vectors GROUP BY ensemble_id"))
def l12(spark, d):
    from mnemospark.operators.clustering import mean_vectors

    return mean_vectors(t.vectors(spark, d), "ensemble_id").select("ensemble_id", "n")
