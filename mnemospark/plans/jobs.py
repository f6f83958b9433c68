"""Background jobs over whole tables: ensembles, consolidation, contradictions, clean-up, tuning (rows I, J, C and L of the survey)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemospark.functions import tables
from mnemospark.functions import text as T
from mnemospark.operators import assistant, cleanup, context, contradictions, discovery, enrich, ensembles, lifecycle, procedures, pulse, reflection, replay, tuning
from mnemospark.operators import gates as G
from mnemospark.operators.clustering import mean_vectors
from mnemospark.operators.common import checkpoint, latest, sifted, top_per
from mnemospark.plans.filters import _IDEA, _lit
from mnemospark.plans.joins import _HASH_TEXT
from mnemospark.plans.oracle import sql
from mnemospark.plans.scalars import _INTENT, TRIM
from mnemospark.plans.scans import _COSINE
from mnemospark.registry import query
from mnemospark.sources import files
from mnemospark.sources import tables as t
from mnemospark.sources.tables import DAY_MS, EPOCH_MS, HOUR_MS, MINUTE_MS, NOW_MS

_MEAN = "list_transform(range(1, 65), lambda i: list_avg(list_transform({0}, lambda e: e[i])))"
_V = """v AS MATERIALIZED (SELECT m.memory_id, m.user_id, m.archived, m.created_ms, m.last_accessed_ms, m.strength, m.kb_id, m.store, e.embedding, e.ensemble_id AS label FROM memories m JOIN vectors e USING (memory_id))"""


def with_vectors(spark, d):
    """Memories that have a vector; the texts of the others aren't shuffled."""
    v = t.vectors(spark, d)
    return sifted(t.memories(spark, d), "memory_id", v.select("memory_id")).join(v.withColumnRenamed("ensemble_id", "label"), "memory_id")


def stored_ensembles(spark, d):
    """Every fourth memory is in an ensemble of its user and label; every fifth ensemble is a conflict group."""
    rows = with_vectors(spark, d).where("memory_id % 4 = 0").select("memory_id", "user_id", (F.col("user_id") * 1000 + F.col("label")).alias("ensemble_id"), "embedding")
    members = rows.groupBy("ensemble_id", "user_id").agg(F.array_sort(F.collect_list("memory_id")).alias("members"))
    kind = F.when(F.col("ensemble_id") % 5 == 0, "conflict_group").otherwise("cluster")
    return members.join(mean_vectors(rows, "ensemble_id").select("ensemble_id", "centroid"), "ensemble_id").withColumn("kind", kind)


_STORED = f"""st AS MATERIALIZED (SELECT user_id * 1000 + label AS ensemble_id, user_id, list(memory_id ORDER BY memory_id) AS members, {_MEAN.format("list(embedding)")} AS centroid, CASE WHEN (user_id * 1000 + label) % 5 = 0 THEN 'conflict_group' ELSE 'cluster' END AS kind FROM v WHERE memory_id % 4 = 0 GROUP BY ALL)"""
#: Of the data's vectors, which have no clusters, so many are alike and near.
_ALIKE, _DRIFT, _NEW, _KEEP = 0.12, 0.5, 4, 3
_COS, _COS_M = _COSINE.format(a="a.embedding", b="b.embedding"), _COSINE.format(a="a.embedding", b="c.centroid")
_TICK = f"""WITH RECURSIVE {_V}, {_STORED},
    held AS (SELECT DISTINCT user_id, unnest(members) AS memory_id FROM st),
    close AS (SELECT * FROM (SELECT a.memory_id AS seed, b.memory_id AS member, {_COS} AS score, row_number() OVER (PARTITION BY a.memory_id ORDER BY {_COS} DESC, b.memory_id) AS n FROM v a JOIN v b ON a.user_id = b.user_id AND a.memory_id <> b.memory_id
        WHERE NOT a.archived AND a.memory_id NOT IN (SELECT memory_id FROM held)) WHERE n <= 19 AND score > {_ALIKE}),
    free0 AS (SELECT memory_id AS member FROM v WHERE NOT archived AND memory_id NOT IN (SELECT memory_id FROM held)),
    wants AS MATERIALIZED (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY created_ms DESC, seed) AS step, seed, members FROM (
        SELECT seed, list_prepend(seed, list(f.member ORDER BY f.member) FILTER (f.member IS NOT NULL)) AS members, count(*) AS n FROM close LEFT JOIN free0 f USING (member) GROUP BY seed) w JOIN v ON v.memory_id = w.seed WHERE n >= {_NEW} - 1),
    go AS (SELECT DISTINCT user_id, 0::BIGINT AS step, []::BIGINT[] AS taken, NULL::BIGINT AS seed, []::BIGINT[] AS made FROM wants
        UNION ALL SELECT user_id, step, CASE WHEN ok THEN list_concat(taken, free) ELSE taken END, seed, CASE WHEN ok THEN free ELSE [] END FROM (SELECT *, NOT list_contains(taken, seed) AND len(free) >= {_NEW} AS ok FROM (
            SELECT w.user_id, w.step, w.seed, g.taken, list_filter(w.members, lambda x: NOT list_contains(g.taken, x)) AS free FROM go g JOIN wants w ON w.user_id = g.user_id AND w.step = g.step + 1))),
    born AS (SELECT 'new:' || seed AS ensemble, user_id, 'cluster' AS kind, unnest(made) AS memory_id, 1 AS no, step AS turn FROM go WHERE len(made) > 0),
    every AS (SELECT ensemble_id::VARCHAR AS ensemble, user_id, kind, unnest(members) AS memory_id, 0 AS no, ensemble_id AS turn FROM st UNION ALL SELECT * FROM born),
    c AS (SELECT ensemble_id::VARCHAR AS ensemble, centroid FROM st UNION ALL SELECT ensemble, {_MEAN.format("list(embedding)")} FROM born JOIN v USING (memory_id) GROUP BY ensemble),
    steady AS (SELECT e.ensemble, e.memory_id FROM every e JOIN v a ON a.memory_id = e.memory_id JOIN c USING (ensemble) WHERE NOT a.archived AND {_COS_M} >= {_DRIFT}),
    ens AS (SELECT e.ensemble, e.user_id, e.kind, e.no, e.turn, count(*) AS had, count(s.memory_id) AS kept, count(s.memory_id) < CASE e.kind WHEN 'conflict_group' THEN 1 ELSE {_KEEP} END AS ends FROM every e LEFT JOIN steady s USING (ensemble, memory_id) GROUP BY e.ensemble, e.user_id, e.kind, e.no, e.turn),
    kept AS (SELECT s.* FROM steady s JOIN ens USING (ensemble) WHERE NOT ends),
    now AS (SELECT ensemble, user_id, no, turn, CASE WHEN had <> kept THEN {_MEAN.format("list(embedding)")} ELSE any_value(centroid) END AS centroid FROM ens JOIN kept USING (ensemble) JOIN (SELECT memory_id, embedding FROM v) USING (memory_id) JOIN c USING (ensemble) GROUP BY ensemble, user_id, no, turn, had, ens.kept),
    reach AS (SELECT * FROM (SELECT c.ensemble, c.no, c.turn, a.memory_id, a.archived, {_COS_M} AS score, row_number() OVER (PARTITION BY c.ensemble ORDER BY {_COS_M} DESC, a.memory_id) AS n FROM now c JOIN v a ON a.user_id = c.user_id) WHERE n <= 10 AND score > {_ALIKE}),
    free AS (SELECT r.* FROM reach r WHERE NOT EXISTS (SELECT 1 FROM kept k JOIN ens e USING (ensemble) WHERE k.memory_id = r.memory_id AND (e.no, e.turn) <= (r.no, r.turn)) AND NOT EXISTS (SELECT 1 FROM every e WHERE e.memory_id = r.memory_id AND (e.no, e.turn) > (r.no, r.turn))),
    gains AS (SELECT ensemble, memory_id FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY no, turn) AS k FROM free WHERE NOT archived) WHERE k = 1),
    members AS (SELECT * FROM kept UNION ALL SELECT * FROM gains)"""
_TICK_END = f"""{_TICK}, means AS (SELECT ensemble, {_MEAN.format("list(embedding)")} AS centroid, count(*) AS n, round(avg(strength), 6) AS strength FROM members JOIN v USING (memory_id) GROUP BY ensemble),
    sums AS (SELECT c.ensemble, c.n, c.strength, round(avg({_COS_M[len("round") : -len(", 6)")]})), 6) AS confidence FROM members JOIN means c USING (ensemble) JOIN v a USING (memory_id) GROUP BY c.ensemble, c.n, c.strength)
    SELECT e.ensemble, e.user_id, CASE WHEN ends THEN 'archived' WHEN no = 1 THEN 'created' WHEN had <> kept OR ensemble IN (SELECT ensemble FROM gains UNION ALL SELECT ensemble FROM free WHERE archived) THEN 'updated' ELSE 'kept' END AS action, coalesce(n, 0) AS n, strength, confidence FROM ens e LEFT JOIN sums USING (ensemble)"""


def _tick(spark, d):
    return ensembles.ensemble_tick(with_vectors(spark, d), stored_ensembles(spark, d), _ALIKE, _DRIFT, _NEW, _KEEP)


@query("i5_ensemble_tick", sql(_TICK_END))
def i5(spark, d):
    return _tick(spark, d)[0].drop("centroid")


@query("i5_ensemble_members", sql(f"{_TICK} SELECT ensemble, memory_id FROM members"))
def i5_members(spark, d):
    return _tick(spark, d)[1]


_BLANKS = "' ' || chr(9) || chr(10) || chr(12) || chr(13)"


def _short_sql(text: str, most: int) -> str:
    return f"CASE WHEN length({text}) > {most} THEN trim(substring({text}, 1, {most}), {_BLANKS}) || '…' ELSE {text} END"


_SENSORY = f"""WITH RECURSIVE v AS MATERIALIZED (SELECT m.* EXCLUDE (store), CASE WHEN memory_id % 2 = 0 THEN 'sensory' ELSE store END AS store, e.embedding FROM memories m JOIN vectors e USING (memory_id) WHERE NOT archived),
    near AS (SELECT a.user_id, a.memory_id AS seed, a.last_accessed_ms, b.memory_id AS member, b.kb_id, CASE WHEN a.memory_id = b.memory_id THEN 2 ELSE {_COS} END AS score FROM v a JOIN v b ON a.user_id = b.user_id AND a.store = 'sensory' AND b.store = 'sensory' AND a.kb_id IS NULL AND a.created_ms <= $NOW - {DAY_MS}),
    wants AS MATERIALIZED (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY last_accessed_ms DESC, seed) AS step, seed, list(member ORDER BY score DESC, member) AS members, list(member ORDER BY score DESC, member) FILTER (kb_id IS NULL) AS own FROM near WHERE score >= 0.1 GROUP BY user_id, last_accessed_ms, seed),
    go AS (SELECT DISTINCT user_id, 0::BIGINT AS step, []::BIGINT[] AS used, []::BIGINT[] AS gone, NULL::BIGINT AS seed, []::BIGINT[] AS docs FROM wants
        UNION ALL SELECT user_id, step, CASE WHEN list_contains(used, seed) THEN used ELSE list_concat(used, free) END, CASE WHEN ok THEN list_concat(gone, docs) ELSE gone END, seed, CASE WHEN ok THEN docs ELSE [] END FROM (
            SELECT *, NOT list_contains(used, seed) AND len(free) >= 2 AND len(docs) >= 2 AS ok FROM (SELECT *, list_filter(free, lambda x: list_contains(own, x)) AS docs FROM (
                SELECT w.user_id, w.step, w.seed, w.own, g.used, g.gone, list_filter(w.members, lambda x: NOT list_contains(g.gone, x))[1:9] AS free FROM go g JOIN wants w ON w.user_id = g.user_id AND w.step = g.step + 1)))),
    d AS (SELECT user_id, step, seed, unnest(docs) AS memory_id, generate_subscripts(docs, 1) AS i FROM go WHERE len(docs) > 0),
    e AS MATERIALIZED (SELECT d.user_id, d.step, d.seed, count(*) AS n, arg_min(v.memory_id, i) AS source_id, string_agg(v.title, ' | ' ORDER BY i) AS titles, string_agg(i || '. [sensory] ' || {_short_sql("v.title", 80)} || chr(10) || {_short_sql("v.content", 180)}, chr(10) || chr(10) ORDER BY i) AS lines,
        {_MEAN.format("list(v.embedding)")} AS embedding, least(1, avg(v.valence)) AS valence, least(1, avg(v.arousal)) AS arousal, array_to_string(list_sort(list_distinct(flatten(list(v.tags)))), ',') AS tags, string_agg(v.memory_id::VARCHAR, ',' ORDER BY i) AS sources FROM d JOIN v USING (memory_id) GROUP BY d.user_id, d.step, d.seed),
    ep AS (SELECT *, least(1, 0.45::DOUBLE + least(n, 12) * 0.05::DOUBLE) AS strength, least(1, 0.55::DOUBLE + least(n, 20) * 0.02::DOUBLE) AS confidence, 'Episodic cluster: ' || titles AS full_title, 'Source cluster summary (' || n || ' memories):' || chr(10) || chr(10) || chr(10) || chr(10) || lines AS content FROM e),
    strong AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY step) AS k FROM ep WHERE n >= 3 AND seed NOT IN (SELECT a.seed FROM ep a JOIN v b ON a.user_id = b.user_id AND b.store = 'semantic' WHERE {_COS} >= 0.3)),
    rivals AS MATERIALIZED (SELECT s.user_id, s.k, s.seed, coalesce(list(r.seed) FILTER (r.seed IS NOT NULL), []) AS rivals FROM strong s LEFT JOIN (SELECT a.seed AS x, b.seed FROM strong a JOIN strong b ON a.user_id = b.user_id AND a.seed <> b.seed WHERE {_COS} >= 0.3) r ON r.x = s.seed GROUP BY s.user_id, s.k, s.seed),
    up AS (SELECT DISTINCT user_id, 0::BIGINT AS k, []::BIGINT[] AS written FROM rivals UNION ALL SELECT r.user_id, r.k, CASE WHEN len(list_intersect(r.rivals, u.written)) = 0 THEN list_append(u.written, r.seed) ELSE u.written END FROM up u JOIN rivals r ON r.user_id = u.user_id AND r.k = u.k + 1),
    won AS (SELECT DISTINCT unnest(written) AS seed FROM up),
    rows AS (SELECT 'episodic' AS level, *, {_short_sql("full_title", 110)} AS title FROM ep UNION ALL SELECT 'semantic', * REPLACE (least(1, strength * 0.95::DOUBLE + 0.05::DOUBLE) AS strength, least(1, confidence + 0.05::DOUBLE) AS confidence), 'Semantic: ' || {_short_sql("full_title", 110)} FROM ep WHERE seed IN (SELECT seed FROM won))
    SELECT level, source_id, user_id, title, content, round(strength, 6)::DOUBLE AS strength, round(confidence, 6)::DOUBLE AS confidence, round(valence, 6)::DOUBLE AS valence, round(arousal, 6)::DOUBLE AS arousal, n, tags, sources FROM rows"""


@query("i6_consolidation", sql(_SENSORY))
def i6(spark, d):
    """Every second memory is sensory, and vectors count as alike as the data's are."""
    rows = with_vectors(spark, d).withColumn("store", F.when(F.col("memory_id") % 2 == 0, "sensory").otherwise(F.col("store")))
    made = ensembles.consolidate(rows, NOW_MS, alike=0.1, repeated=0.3, least=(3, 0.5, 0.5))
    numbers = [F.round(c, 6).alias(c) for c in ("strength", "confidence", "valence", "arousal")]
    return made.select("level", "source_id", "user_id", "title", "content", *numbers, "n", F.array_join("tags", ",").alias("tags"), F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"))


#: Of the data's vectors: what counts as alike, as too alike, and as alike enough for differing facts.
_LOW, _HIGH, _BYPASS = 0.1, 0.25, 0.02
_SINCE = EPOCH_MS + DAY_MS


def _answers(pairs):
    """A model's stored answers: some missing, some no JSON, some in a list."""
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    n = F.lpad(((lo * 31 + hi * 17) % 100).cast("string"), 2, "0")
    kind = t.pick(("factual", "temporal", "opinion", "scope", "other"), lo + hi)
    one = F.concat(F.lit('{"score":0.'), n, F.lit(',"explanation":"pair '), F.col("pair_key"), F.lit('","conflictType":"'), kind, F.lit('","suggestedResolution":"'), F.when(hi % 2 == 0, "merge").otherwise(""), F.lit('"}'))
    text = F.when((lo * 7 + hi * 13) % 17 == 0, F.lit(None)).when((lo * 7 + hi * 13) % 19 == 0, "no json").when((lo + hi) % 5 == 0, F.concat(F.lit("["), one, F.lit("]"))).otherwise(one)
    return pairs.withColumn("answer", text)


_ANSWERED = """(lo * 7 + hi * 13) % 17 = 0 OR (lo * 7 + hi * 13) % 19 = 0 AS failed, CASE WHEN (lo * 7 + hi * 13) % 17 = 0 OR (lo * 7 + hi * 13) % 19 = 0 THEN 0 ELSE ((lo * 31 + hi * 17) % 100) / 100.0::DOUBLE END AS score,
    CASE WHEN (lo * 7 + hi * 13) % 17 = 0 OR (lo * 7 + hi * 13) % 19 = 0 THEN '' ELSE 'pair ' || pair_key END AS explanation, CASE WHEN (lo * 7 + hi * 13) % 17 = 0 OR (lo * 7 + hi * 13) % 19 = 0 THEN 'none' ELSE (['factual', 'temporal', 'opinion', 'scope', 'none'])[(lo + hi) % 5 + 1] END AS conflict_type"""


def _conflicts(spark, d):
    """Stored conflict groups: of every memory and the one before it, some settled, long ago or not."""
    m = t.memories(spark, d).where("memory_id > 0 AND memory_id % 3 = 0")
    i = F.col("memory_id")
    key = F.array_join(F.array_sort(F.array(i.cast("string"), (i - 60).cast("string"))), "::")
    meta = F.concat(F.lit('{"pairKey":"'), key, F.lit('","status":"'), F.when(i % 2 == 0, "unresolved").otherwise("resolved"), F.lit('"'), F.when(i % 5 == 0, F.concat(F.lit(',"resolvedAt":'), (NOW_MS - i * DAY_MS).cast("string"))).otherwise(""), F.lit("}"))
    return m.where("memory_id >= 60").select("user_id", meta.alias("metadata"), F.col("created_ms").alias("updated_ms"))


_ACTIVE = f"""active AS (SELECT user_id, array_to_string(list_sort([memory_id::VARCHAR, (memory_id - 60)::VARCHAR]), '::') AS pair_key FROM memories WHERE memory_id >= 60 AND memory_id % 3 = 0
    AND (memory_id % 2 = 0 OR $NOW - CASE WHEN memory_id % 5 = 0 THEN $NOW - memory_id * {DAY_MS} ELSE created_ms END < {30 * DAY_MS}))"""


def _fired(spark, d):
    return t.memories(spark, d).select("user_id", (F.col("user_id") % 5).alias("fired")).distinct()


def _facts_sql(a: str, b: str) -> str:
    parts = []
    for p in (G.AMOUNTS, G.DATES):
        x, y = (f"regexp_extract_all(lower({s}), {_lit(p)})" for s in (a, b))
        parts.append(f"(len({x}) > 0 AND len({y}) > 0 AND (len(list_filter({x}, lambda z: NOT list_contains({y}, z))) > 0 OR len(list_filter({y}, lambda z: NOT list_contains({x}, z))) > 0))")
    return f"({' OR '.join(parts)} OR regexp_matches(lower({a}), {_lit(G.NEGATED)}) <> regexp_matches(lower({b}), {_lit(G.NEGATED)}))"


_GATE = f"(score BETWEEN {_LOW} AND {_HIGH} OR score >= {_BYPASS} AND {_facts_sql('x_text', 'y_text')})"


@query("i9_contradiction_scan", sql(f"""WITH v AS MATERIALIZED (SELECT m.*, m.title || chr(10) || m.content AS text, e.embedding, user_id * 1000 + e.ensemble_id % 3 AS ens, {EPOCH_MS} + (user_id * 1000 + e.ensemble_id % 3) % 4 * {DAY_MS} AS updated_ms, created_ms > {_SINCE} AS fresh FROM memories m JOIN vectors e USING (memory_id) WHERE NOT archived), {_ACTIVE},
    p AS (SELECT a.user_id, a.ens, a.updated_ms, CASE WHEN a.fresh THEN a.memory_id ELSE b.memory_id END AS a, CASE WHEN a.fresh THEN b.memory_id ELSE a.memory_id END AS b, a.fresh AND b.fresh AS two, {_COS} AS score, a.text AS x_text, b.text AS y_text, a.memory_id AS lo, b.memory_id AS hi, array_to_string(list_sort([a.memory_id::VARCHAR, b.memory_id::VARCHAR]), '::') AS pair_key
        FROM v a JOIN v b ON a.ens = b.ens AND a.memory_id < b.memory_id AND (a.fresh OR b.fresh) WHERE a.updated_ms >= {_SINCE}),
    g AS (SELECT *, greatest(0, 3 - user_id % 5) AS left_over FROM p WHERE {_GATE} AND (user_id, pair_key) NOT IN (SELECT (user_id, pair_key) FROM active)),
    n AS (SELECT * EXCLUDE (score), score AS similarity FROM g WHERE left_over > 0), j AS (SELECT *, {_ANSWERED} FROM n),
    k AS (SELECT *, row_number() OVER w AS nth, coalesce(sum(failed::INT) OVER before, 0) AS errors, coalesce(sum((score >= 0.6)::INT) OVER before, 0) AS told FROM j WINDOW w AS (PARTITION BY user_id ORDER BY updated_ms, ens, two, a, b), before AS (PARTITION BY user_id ORDER BY updated_ms, ens, two, a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT k.user_id, ens AS ensemble_id, nth, a, b, pair_key, similarity, CASE WHEN failed THEN 'failed' WHEN score >= 0.8 THEN 'conflict' WHEN score >= 0.6 THEN 'trace' ELSE 'none' END AS outcome, score, explanation,
        CASE WHEN score >= 0.6 THEN '**Contradiction detected** (' || conflict_type || ', score: ' || printf('%.2f', score) || ')' || chr(10) || 'Memory A: "' || x.title || '" — ' || substring(x.content, 1, 150) || chr(10) || 'Memory B: "' || y.title || '" — ' || substring(y.content, 1, 150) || chr(10) || 'Explanation: ' || explanation || CASE WHEN hi % 2 = 0 THEN chr(10) || 'Suggested resolution: merge' ELSE '' END END AS context
    FROM k JOIN memories x ON x.memory_id = a JOIN memories y ON y.memory_id = b WHERE nth <= 10 AND errors < 3 AND told < left_over"""))
def i9(spark, d):
    """Ensembles of a user and a third of the labels."""
    rows = with_vectors(spark, d).withColumn("ens", F.col("user_id") * 1000 + F.col("label") % 3)
    members = rows.select(F.col("ens").alias("ensemble_id"), "memory_id", F.col("created_ms").alias("joined_ms"))
    changed = rows.select(F.col("ens").alias("ensemble_id"), "user_id", (F.col("ens") % 4 * DAY_MS + EPOCH_MS).alias("updated_ms")).distinct()
    return contradictions.scan(rows, members, changed, _conflicts(spark, d), _fired(spark, d), _answers, _SINCE, NOW_MS, low=_LOW, high=_HIGH, bypass=_BYPASS)


@query("c21_contradiction_probe", sql(f"""WITH v AS MATERIALIZED (SELECT m.*, m.title || chr(10) || m.content AS text, e.embedding FROM memories m JOIN vectors e USING (memory_id)), {_ACTIVE},
    tg AS (SELECT *, CASE WHEN memory_id % 2 = 0 THEN 'en' ELSE channel END AS place, CASE WHEN archived THEN 'skipped' WHEN user_id % 5 >= 3 THEN 'budget' ELSE 'ok' END AS status FROM v WHERE memory_id % 4 = 1 OR memory_id % 4 = 2),
    near AS (SELECT * FROM (SELECT a.user_id, a.memory_id AS a, b.memory_id AS b, a.place, a.text AS x_text, {_COS} AS score, row_number() OVER (PARTITION BY a.memory_id ORDER BY {_COS} DESC, b.memory_id) AS n FROM tg a JOIN v b ON a.user_id = b.user_id AND a.memory_id <> b.memory_id WHERE status = 'ok') WHERE n <= 5),
    g AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS k FROM (SELECT near.*, o.text AS y_text FROM near JOIN v o ON o.memory_id = b WHERE NOT o.archived AND o.kb_id IS NULL AND o.channel = place) WHERE {_GATE}),
    j AS (SELECT *, {_ANSWERED} FROM (SELECT a, b, user_id, score AS similarity, least(a, b) AS lo, greatest(a, b) AS hi, array_to_string(list_sort([a::VARCHAR, b::VARCHAR]), '::') AS pair_key FROM g WHERE k <= 3) WHERE (user_id, pair_key) NOT IN (SELECT (user_id, pair_key) FROM active)),
    w AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, similarity DESC, b) AS r FROM j WHERE NOT failed AND score >= 0.6)
    SELECT memory_id, tg.user_id, status, w.b AS other_id, similarity, score, conflict_type, explanation FROM tg LEFT JOIN w ON w.a = memory_id AND r = 1"""))
def c21(spark, d):
    rows = with_vectors(spark, d)
    i = F.col("memory_id")
    targets = rows.where((i % 4 == 1) | (i % 4 == 2)).select("memory_id", F.when(i % 2 == 0, "en").alias("channel"))
    return contradictions.probe(rows, targets, _conflicts(spark, d), _fired(spark, d), _answers, NOW_MS, low=_LOW, high=_HIGH, bypass=_BYPASS)


@query("j16_repeated_turns", sql(f"""WITH RECURSIVE turns AS MATERIALIZED (SELECT message_id, user_id AS k, ts, sha1(trim(content, {_BLANKS})) AS full_hash, 'p' || sha1(substring(trim(content, {_BLANKS}), 1, 200)) AS prefix_hash, row_number() OVER (PARTITION BY user_id ORDER BY ts, message_id) AS step FROM (SELECT * REPLACE (substring(content, 1, 1) AS content) FROM messages) WHERE role = 'assistant'),
    go AS (SELECT DISTINCT k, 0::BIGINT AS step, []::STRUCT(h VARCHAR, t BIGINT)[] AS cache, NULL::BIGINT AS message_id, NULL::BIGINT AS ts, false AS repeated FROM turns
        UNION ALL SELECT k, step, list_concat(list_filter(known, lambda x: NOT list_contains(added, x.h)), list_transform(added, lambda h: {{'h': h, 't': ts}}))[-500:], message_id, ts, len(added) = 1 FROM (
            SELECT *, CASE WHEN list_contains(list_transform(known, lambda x: x.h), full_hash) THEN [full_hash] WHEN list_contains(list_transform(known, lambda x: x.h), prefix_hash) THEN [prefix_hash] ELSE [full_hash, prefix_hash] END AS added FROM (
                SELECT t.*, list_filter(g.cache, lambda x: t.ts - x.t <= {2 * HOUR_MS}) AS known FROM go g JOIN turns t ON t.k = g.k AND t.step = g.step + 1)))
    SELECT message_id, k AS session_key, ts, repeated FROM go WHERE message_id IS NOT NULL"""))
def j16(spark, d):
    """A user's turns as one session, with short texts, which repeat."""
    turns = t.messages(spark, d).where("role = 'assistant'").select("message_id", F.col("user_id").alias("session_key"), F.substring("content", 1, 1).alias("content"), "ts")
    return assistant.repeated_turns(turns)


@query("j17_stalled_captures", sql(f"""WITH RECURSIVE r AS (SELECT user_id AS k, ts, event_type = 'purchase' AS done FROM requests WHERE event_type IN ('view', 'purchase')),
    s AS (SELECT *, sum(done::INT) OVER (PARTITION BY k ORDER BY ts, done DESC ROWS UNBOUNDED PRECEDING) AS stretch FROM r), n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k, stretch, done ORDER BY ts) AS nth FROM s),
    spans AS (SELECT k, stretch, min(ts) AS since, max(ts) AS until, min(ts) FILTER (NOT done AND nth = 4) AS filled FROM n GROUP BY k, stretch),
    e AS (SELECT k, stretch, greatest(filled, since + {10 * MINUTE_MS + 1}) AS first, filled, coalesce(lead(since) OVER (PARTITION BY k ORDER BY stretch), max(until) OVER (PARTITION BY k) + {DAY_MS}) AS last FROM spans),
    f AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k ORDER BY stretch) AS step FROM e WHERE filled IS NOT NULL AND first < last),
    go AS (SELECT DISTINCT k, 0::BIGINT AS step, NULL::BIGINT AS told, NULL::BIGINT AS stretch, NULL::BIGINT AS start, 0::BIGINT AS times FROM f
        UNION ALL SELECT k, step, CASE WHEN times > 0 THEN start + (times - 1) * {HOUR_MS + 1} ELSE told END, stretch, start, times FROM (SELECT *, CASE WHEN start < last THEN (last - 1 - start) // {HOUR_MS + 1} + 1 ELSE 0 END AS times FROM (
            SELECT f.k, f.step, g.told, f.stretch, f.last, greatest(f.first, coalesce(g.told + {HOUR_MS + 1}, f.first)) AS start FROM go g JOIN f ON f.k = g.k AND f.step = g.step + 1))),
    hits AS (SELECT k, stretch, start + unnest(range(times)) * {HOUR_MS + 1} AS ts FROM go WHERE times > 0)
    SELECT hits.k AS session_key, hits.ts, count(*) AS pending FROM hits JOIN n ON n.k = hits.k AND n.stretch = hits.stretch AND NOT n.done AND n.ts <= hits.ts GROUP BY hits.k, hits.ts"""))
def j17(spark, d):
    return assistant.stalls(t.requests(spark, d).select(F.col("user_id").alias("session_key"), "event_type", "ts"), "view", "purchase")


def _polluted(spark, d):
    """Messages of which some begin with recalled context: with a prompt behind it, without an end, with nothing behind it, or with a prompt that others repeat."""
    m = t.messages(spark, d)
    kind, c = F.col("message_id") % 6, F.col("content")
    text = F.when(kind == 0, F.concat(F.lit("<recalled_context><user><recalled_context>old</recalled_context></user></recalled_context> "), c)).when(kind == 1, F.concat(F.lit("<recalled_context>"), c)).when(kind == 2, F.concat(F.lit(" <recalled_context>"), c, F.lit("</recalled_context>")))
    text = text.when(kind == 3, F.lit("<recalled_context>x</recalled_context>Go on")).when(F.col("session_key") % 3 == 0, F.lit("go on")).otherwise(c)
    none = F.lit(None)
    return m.select("message_id", "user_id", "role", F.col("channel"), (F.col("session_key") % 5).alias("session_key"), none.cast("string").alias("turn_id"), none.cast("long").alias("turn_index"), text.alias("content"), "ts", F.lit("m").alias("metadata"), "embedded")


_CLEANED = f"""WITH raw AS (SELECT message_id, user_id, role, channel, session_key % 5 AS s, ts, message_id % 6 AS kind, embedded,
        CASE message_id % 6 WHEN 0 THEN '<recalled_context><user><recalled_context>old</recalled_context></user></recalled_context> ' || content WHEN 1 THEN '<recalled_context>' || content WHEN 2 THEN ' <recalled_context>' || content || '</recalled_context>' WHEN 3 THEN '<recalled_context>x</recalled_context>Go on' ELSE CASE WHEN session_key % 3 = 0 THEN 'go on' ELSE content END END AS text,
        CASE message_id % 6 WHEN 0 THEN ltrim(content, {_BLANKS}) WHEN 1 THEN '' WHEN 2 THEN '' WHEN 3 THEN 'Go on' ELSE CASE WHEN session_key % 3 = 0 THEN 'go on' ELSE content END END AS content FROM messages),
    h AS (SELECT *, sha256(role || chr(10) || lower({_HASH_TEXT})) AS hash FROM (SELECT * REPLACE (substring(content, 1, 8000) AS content) FROM raw)),
    c AS (SELECT *, row_number() OVER (PARTITION BY user_id, channel, s, hash ORDER BY ts DESC, message_id DESC) AS n FROM h WHERE role = 'user' AND kind < 4),
    plan AS (SELECT message_id, user_id, CASE WHEN kind IN (1, 2) OR length(trim(content, {_BLANKS})) = 0 THEN 'delete' WHEN n > 1 OR EXISTS (SELECT 1 FROM h WHERE h.role = 'user' AND h.kind >= 4 AND h.user_id = c.user_id AND h.channel = c.channel AND h.s = c.s AND h.hash = c.hash) THEN 'merge-delete' ELSE 'patch' END AS action,
        kind = 1 AS malformed, length(text)::INT AS original_chars, length(trim(content, {_BLANKS}))::INT AS cleaned_chars, content, hash FROM c)"""


@query("j5_recalled_cleanup", sql(f"{_CLEANED} SELECT message_id, user_id, action, malformed, original_chars, cleaned_chars, CASE WHEN action = 'patch' THEN content END AS content, CASE WHEN action = 'patch' THEN hash END AS content_hash FROM plan"))
def j5(spark, d):
    return cleanup.cleanup_plan(_polluted(spark, d))


@query("j5_cleanup_counters", sql(f"""{_CLEANED} SELECT user_id, count(*) AS candidates, count(*) FILTER (action = 'patch') AS would_patch, count(*) FILTER (action = 'patch') AS patched, count(*) FILTER (action = 'delete') AS would_delete, count(*) FILTER (action = 'delete') AS deleted,
    count(*) FILTER (action = 'merge-delete') AS would_merge_delete, count(*) FILTER (action = 'merge-delete') AS merged_deleted, count(*) FILTER (malformed) AS malformed FROM plan GROUP BY user_id"""))
def j5_counters(spark, d):
    return cleanup.counters(cleanup.cleanup_plan(_polluted(spark, d)))


@query("j5_cleaned_table", sql(f"""{_CLEANED} SELECT h.message_id, h.channel, CASE WHEN p.action = 'patch' THEN p.content ELSE h.text END AS content, CASE WHEN p.action = 'patch' THEN 'm; recalled_context_cleanup:$NOW' ELSE 'm' END AS metadata, p.action IS DISTINCT FROM 'patch' AND h.embedded AS embedded
    FROM h LEFT JOIN plan p USING (message_id) WHERE p.action IS NULL OR p.action = 'patch'"""))
def j5_table(spark, d):
    """The stored table after the clean-up, rewritten partition by partition."""
    path = cleanup.scratch_folder(spark, "messages")
    _polluted(spark, d).repartition("channel").write.partitionBy("channel").parquet(path)
    cleanup.apply_plan(spark, path, cleanup.cleanup_plan(spark.read.parquet(path)), "channel", NOW_MS)
    return spark.read.parquet(path).select("message_id", "channel", "content", "metadata", "embedded")


def _pattern_answers(spark, d):
    """A model's stored answers: of each user the memories of two places in 45 as patterns, the first of which are procedures that exist."""
    m = t.memories(spark, d).where("memory_id % 45 IN (13, 14, 31)")
    i = F.col("memory_id")
    step = lambda n, action, command: F.struct(n.cast("double").alias("order"), action.alias("action"), command.cast("string").alias("command"))
    steps = F.array(step(F.lit(2), F.concat(F.lit("do "), (i % 4).cast("string")), F.lit("run it")), step(F.lit(1), F.lit(" look "), F.lit(None)), step(F.lit(3), F.lit("LOOK"), F.lit("")), step(F.lit(4), F.lit(" "), F.lit("no")))
    one = F.struct(
        i.alias("id"), F.when(i % 2 == 0, F.concat("title", F.lit(" more"))).otherwise(F.col("title")).alias("title"), F.col("content").alias("content"), F.array((i % 2).cast("double"), F.lit(0.0), F.lit(900.0)).alias("sourceMemoryIndices"),
        t.pick(("workflow", "problem_solving", "else"), i).alias("patternType"), (i % 7).cast("double").alias("observationCount"), F.array(F.lit(" when "), F.concat(F.lit("t"), (i % 3).cast("string"))).alias("triggerConditions"), steps.alias("steps"), F.array(F.lit(""), F.lit("slow")).alias("pitfalls"), F.when(i % 4 == 1, " see ").alias("verification"),
    )
    every = F.to_json(F.array_sort(F.collect_list(one)))  # a few of each user
    return m.groupBy("user_id").agg(F.when(F.col("user_id") % 2 == 0, F.concat(F.lit('{"patterns":'), every, F.lit("}"))).otherwise(every).alias("answer"))


_LONG = "list_filter(regexp_split_to_array(lower(trim({0}, " + _BLANKS + ")), '[ \\t\\n\\r\\f]+'), lambda w: length(w) > 3)"
_PATTERNS = f"""shown AS (SELECT * FROM (SELECT user_id, memory_id, row_number() OVER (PARTITION BY user_id ORDER BY created_ms DESC, memory_id) - 1 AS i FROM memories WHERE created_ms >= {EPOCH_MS} AND NOT archived AND store NOT IN ('prospective', 'procedural')) WHERE i < 60),
    f0 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY memory_id) - 1 AS place FROM (SELECT user_id, memory_id, CASE WHEN memory_id % 2 = 0 THEN title || ' more' ELSE title END AS title, content, memory_id % 7 AS seen FROM memories WHERE memory_id % 45 IN (13, 14, 31))),
    f AS MATERIALIZED (SELECT f0.*, [a.memory_id, b.memory_id] AS sources FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY place) AS n FROM f0 WHERE seen >= 2) f0 JOIN shown a ON a.user_id = f0.user_id AND a.i = f0.memory_id % 2 JOIN shown b ON b.user_id = f0.user_id AND b.i = 0 WHERE n <= 5),
    known AS MATERIALIZED (SELECT *, list_distinct({_LONG.format("title")}) AS kt, {_LONG.format("content")} AS ks FROM memories WHERE store = 'procedural' AND NOT archived),
    x AS (SELECT *, list_distinct({_LONG.format("title")}) AS ft, {_LONG.format("content")} AS fs FROM f),
    p AS (SELECT x.user_id, x.place, min(k.memory_id) AS hit FROM x JOIN known k ON k.user_id = x.user_id WHERE len(ft) > 0 AND len(kt) > 0 AND (len(list_intersect(ft, kt)) / (len(ft) + len(kt) - len(list_intersect(ft, kt)))::DOUBLE > 0.8
        OR len(fs) > 0 AND len(ks) > 0 AND len(list_filter(fs, lambda w: list_contains(ks, w))) / greatest(len(fs), len(ks))::DOUBLE > 0.6) GROUP BY x.user_id, x.place),
    c AS (SELECT f.*, p.hit, CASE WHEN memory_id % 3 = 1 THEN 'problem_solving' ELSE 'workflow' END AS kind, greatest(seen, 2)::BIGINT AS observations, CASE WHEN seen >= 5 THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence, CASE WHEN memory_id % 4 = 1 THEN 'see' ELSE '' END AS checked FROM f LEFT JOIN p USING (user_id, place)),
    g AS (SELECT *, ['organic', 'auto-extracted', 'pattern:' || kind, 'source:' || sources[1], 'source:' || sources[2]] AS tags FROM c)"""
_META = """'{"skillFormat":true,"triggerConditions":["when","t' || (memory_id % 3) || '"],"steps":[{"order":1,"action":"look"},{"order":2,"action":"do ' || (memory_id % 4) || '","command":"run it"}],"pitfalls":["slow"],"verification":"' || checked || '","patternType":"' || kind || '","observationCount":' || """


@query("i13_procedures", sql(f"""WITH {_PATTERNS},
    r AS (SELECT g.*, row_number() OVER (PARTITION BY hit ORDER BY place) AS nth, row_number() OVER (PARTITION BY hit ORDER BY place DESC) AS last, k.title AS old_title, k.confidence AS old_confidence, k.strength, k.access_count, k.tags AS old_tags, CAST(json_extract(k.metadata, '$.observationCount') AS BIGINT) + seen AS total FROM g JOIN known k ON k.memory_id = hit),
    s AS (SELECT hit, count(*) AS turns, max(confidence) AS confidence, list(tags ORDER BY nth) AS tags, max(greatest(access_count + 0, total) + 0) AS any_total, list(total ORDER BY nth) AS totals FROM r GROUP BY hit)
    SELECT user_id, place, CASE WHEN hit IS NULL THEN NULL ELSE hit END AS memory_id, 'create' AS action, substring(title, 1, 200) AS title, content, {_META} observations || ',"lastObserved":$NOW}}' AS metadata, confidence, 0.8::DOUBLE AS strength, 0::BIGINT AS access_count, array_to_string(list_sort(list_distinct(tags)), ',') AS tags FROM g WHERE hit IS NULL
    UNION ALL SELECT r.user_id, place, r.hit, 'reinforce', CASE kind WHEN 'workflow' THEN substring(title, 1, 200) ELSE old_title END,
        concat_ws(chr(10) || chr(10), trim(content, {_BLANKS}), 'Trigger conditions:' || chr(10) || '- when' || chr(10) || '- t' || (memory_id % 3), 'Steps:' || chr(10) || '1. look' || chr(10) || '2. do ' || (memory_id % 4) || ' (run it)', 'Pitfalls:' || chr(10) || '- slow', CASE WHEN checked <> '' THEN 'Verification:' || chr(10) || checked END),
        {_META} greatest(total, observations) || ',"lastObserved":$NOW}}', greatest(old_confidence, s.confidence), round(least(1, strength + 0.1::DOUBLE * turns), 6), list_reduce(list_prepend(access_count::BIGINT, totals), lambda a, b: greatest(a + 1, b)), array_to_string(list_sort(list_distinct(flatten(list_prepend(old_tags, s.tags)))), ',') FROM r JOIN s ON s.hit = r.hit WHERE last = 1"""))
def i13(spark, d):
    m = t.memories(spark, d)
    found = procedures.patterns(_pattern_answers(spark, d), procedures.shown(m, EPOCH_MS), taken=5)
    out = procedures.upserted(found, m.where("store = 'procedural' AND NOT archived"), NOW_MS)
    return out.withColumn("tags", F.array_join(F.array_sort(F.array_distinct("tags")), ","))


def _clean_sql(text: str, most: int | None = None) -> str:
    """SQL of a sanitised text, as one line of ``most`` letters if given."""
    lines = f"[regexp_replace(regexp_replace(regexp_replace(y, {_lit(T.INJECTED_BLOCK)}, '', 'g'), {_lit(T.INJECTED_MARK)}, '', 'g'), '[ \\t\\r\\f]+$', '') for y in string_split({text}, chr(10))]"
    clean = TRIM.format(f"substring(array_to_string(list_filter({lines}, lambda y: NOT regexp_matches(regexp_replace(y, '^[ \\t\\r\\f]+', ''), {_lit(T.INJECTED_LINE)}) AND trim(y, {_BLANKS}) <> ''), chr(10)), 1, 2000)")
    return clean if most is None else _line_sql(clean, most)


def _line_sql(text: str, most: int) -> str:
    one = TRIM.format(f"regexp_replace({text}, '[ \\t\\n\\r\\f]+', ' ', 'g')")
    return f"(SELECT CASE WHEN length(o) <= {most} THEN o ELSE regexp_replace(substring(o, 1, {most - 1}), ' +$', '') || '…' END FROM (SELECT {one} AS o))"


def _prompts(spark, d):
    """Users' messages as prompts; some say what an intent needs, some sessions are scheduled, and models differ."""
    m = t.messages(spark, d).where("role = 'user'")
    i, s = F.col("message_id"), F.col("session_key")
    say = t.pick(("how to run", "recall the plan", "build it now", "what did you say?", "do"), i)
    return m.select(i.alias("prompt_id"), "session_key", "user_id", F.when(i % 4 < 3, say).otherwise(F.col("content")).alias("prompt"), (F.col("turn_index") == 0).alias("first"), (s % 13 == 0).alias("cron"), ((s % 5 + 1) * 3000).alias("effective_tokens"), F.lit(0.1).alias("share"))


_SHOWN = ("memory_id", "user_id", "store", "category", "title", "content", "strength", "kb_id")
_MEMORY_SQL = f"""'--- Memory [' || memory_id || '] ---' || chr(10) || 'Type: ' || store || '/' || category || CASE WHEN strength >= 0.85 THEN ' [HIGH CONFIDENCE]' WHEN strength >= 0.5 THEN '' ELSE ' [low confidence]' END || chr(10) || 'Title: ' || {_clean_sql("title", 120)}
    || CASE WHEN {_clean_sql("content")} <> '' THEN chr(10) || 'Content: ' || substring({_clean_sql("content")}, 1, 600) ELSE '' END || chr(10) || '--- End Memory ---'"""
_PAST = f"(intent = 'recall' OR {' OR '.join(f'regexp_matches(asked, {_lit(x)})' for x in (G.ASKS_EVIDENCE, G.NAMES_PERSON, G.NAMES_DAY, G.ISO_DAY))})"


@query("l18_context", sql(f"""WITH p AS MATERIALIZED (SELECT *, {_INTENT.replace("q ", "asked ").replace("(q,", "(asked,")} AS intent FROM (SELECT *, trim(prompt, {_BLANKS}) AS asked FROM (SELECT message_id AS prompt_id, session_key, user_id, turn_index, ts, CASE WHEN message_id % 4 < 3 THEN (['how to run', 'recall the plan', 'build it now', 'what did you say?', 'do'])[message_id % 5 + 1] ELSE content END AS prompt,
        turn_index = 0 AS first, session_key % 13 = 0 AS cron, CAST(floor((session_key % 5 + 1) * 3000 * 0.1) AS BIGINT) * 4 AS budget FROM messages WHERE role = 'user'))),
    blocks AS MATERIALIZED (SELECT user_id, memory_id, store, strength, category, {_MEMORY_SQL} AS block FROM memories WHERE NOT archived AND (strength >= 0.9 OR store = 'procedural')),
    hit AS (SELECT user_id, string_agg(block, chr(10) ORDER BY n) AS memories FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY strength DESC, memory_id) AS n FROM blocks WHERE strength >= 0.9 AND user_id % 3 <> 0) WHERE n <= 2 GROUP BY user_id),
    able AS (SELECT user_id, string_agg(block, chr(10) ORDER BY n) AS skills FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY strength DESC, memory_id) AS n FROM blocks WHERE store = 'procedural') WHERE n <= 3 GROUP BY user_id),
    idea AS (SELECT user_id, string_agg('--- Memory [idea:' || memory_id || '] ---' || chr(10) || 'Title: ' || {_clean_sql("title", 120)} || chr(10) || 'Content: ' || {_clean_sql("content", 2000)} || chr(10) || 'Source: Based on ' || CASE WHEN access_count > 0 THEN access_count::VARCHAR ELSE 'multiple' END || ' connected memories' || chr(10) || '--- End Memory ---', chr(10) ORDER BY n) AS ideas
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY memory_id) AS n FROM memories WHERE category = 'goal' AND confidence > 0.5) WHERE n <= 3 GROUP BY user_id),
    old AS MATERIALIZED (SELECT p.prompt_id, m.role, m.content, m.ts, row_number() OVER (PARTITION BY p.prompt_id ORDER BY m.ts DESC, m.message_id) AS n, m.role = 'assistant' AS theirs, row_number() OVER (PARTITION BY p.prompt_id, m.role ORDER BY m.ts DESC, m.message_id) AS k FROM p JOIN messages m ON m.session_key = p.session_key AND m.ts < p.ts),
    lines AS (SELECT prompt_id, string_agg('- [' || role || '] ' || {_clean_sql("content", 220)} || ' (' || strftime(make_timestamp(ts * 1000), '%Y-%m-%d %H:%M') || ')', chr(10) ORDER BY n) AS lines FROM old WHERE n <= 2 GROUP BY prompt_id),
    lasts AS (SELECT prompt_id, {_clean_sql("content", 180)} AS last FROM old WHERE theirs AND k = 1),
    woken AS (SELECT session_key, {_clean_sql("content", 240)} AS briefing FROM messages WHERE turn_index = 1),
    e AS (SELECT p.*, memories, CASE WHEN NOT cron AND {_PAST} THEN lines END AS lines, CASE WHEN NOT cron AND {_PAST} AND (memories IS NULL OR lines IS NULL) THEN last END AS last FROM p LEFT JOIN hit USING (user_id) LEFT JOIN lines USING (prompt_id) LEFT JOIN lasts USING (prompt_id) WHERE length(asked) >= 5),
    parts AS (SELECT prompt_id, 0 AS ordinal, 'Preamble' AS label, 'Memory is on.' AS text FROM p WHERE NOT cron UNION ALL SELECT prompt_id, 1, 'Preamble', 'Tools: recall, search.' FROM p WHERE NOT cron AND first UNION ALL SELECT prompt_id, 2, 'Preamble', briefing FROM p JOIN woken USING (session_key) WHERE NOT cron AND first
        UNION ALL SELECT prompt_id, 3, 'Memory Discovery', '--- Memory Discovery ---' || chr(10) || 'While you were away, your memory discovered:' || chr(10) || chr(10) || ideas || chr(10) || chr(10) || '(Respond naturally -- reference this if relevant to the conversation)' || chr(10) || '--- End Discovery ---' FROM p JOIN idea USING (user_id) WHERE NOT cron
        UNION ALL SELECT prompt_id, 4, 'Relevant Recall', concat_ws(chr(10), '## Relevant Memory Evidence' || chr(10) || 'Question: ' || {_line_sql("asked", 180)} || chr(10), memories || chr(10), 'Recent message evidence:' || chr(10) || lines || chr(10), CASE WHEN last <> '' THEN 'Recent context: ' || last || chr(10) END, 'Search messages for exact wording and memories for broader lookup.') FROM e WHERE memories IS NOT NULL OR lines IS NOT NULL OR last IS NOT NULL
        UNION ALL SELECT prompt_id, 5, 'Relevant Skills', '## Relevant Skills' || chr(10) || 'Prompt: ' || {_line_sql("asked", 180)} || chr(10) || skills || chr(10) || chr(10) || 'Apply these skills if they fit the current task.' FROM p JOIN able USING (user_id) WHERE length(asked) >= 5 AND intent IN ('command', 'workflow')),
    r AS (SELECT parts.*, budget, CASE label WHEN 'Relevant Skills' THEN 0 WHEN 'Memory Discovery' THEN 1 WHEN 'Preamble' THEN 2 ELSE 3 END AS rank FROM parts JOIN p USING (prompt_id) WHERE text <> ''),
    x AS (SELECT *, sum(length(text)) OVER (PARTITION BY prompt_id) - coalesce(sum(length(text)) OVER (PARTITION BY prompt_id ORDER BY rank, ordinal DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS excess FROM r),
    g AS (SELECT prompt_id, string_agg(label, '|' ORDER BY ordinal) AS labels, trim(string_agg(text, chr(10) || chr(10) ORDER BY ordinal), {_BLANKS}) AS text FROM x WHERE excess <= budget GROUP BY prompt_id)
    SELECT prompt_id, budget, length(coalesce(text, ''))::INT AS chars, coalesce(labels, '') AS labels, coalesce(text, '') AS text FROM p LEFT JOIN g USING (prompt_id)"""))
def l18(spark, d):
    m, msgs, p = t.memories(spark, d), t.messages(spark, d), _prompts(spark, d)
    best = [F.desc("strength"), F.asc("memory_id")]

    def ranked(rows, n):
        first = top_per(rows.select(*_SHOWN), ["user_id"], n, *best).withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(*best)))
        # Blocks are made once a memory (a few of each of 20 users), so that no whole text is shuffled with a prompt.
        block = context.memory_block(*[F.col(c) for c in ("memory_id", "store", "category", "title", "content", "strength")])
        shown = first.select("user_id", "rank", "memory_id", "store", "kb_id", block.alias("block"))
        return p.select("prompt_id", "user_id").join(F.broadcast(shown), "user_id").withColumn("continuity", F.col("user_id") % 3)

    active = m.where("NOT archived")
    hits = ranked(active.where("strength >= 0.9"), 5).withColumn("kb_id", F.lit(None).cast("string"))
    ideas = m.where("category = 'goal'").select("user_id", F.col("memory_id").alias("rank"), F.col("memory_id").alias("idea_id"), "title", F.col("content").alias("summary"), "confidence", F.col("access_count").alias("sources"))
    # Of messages of one instant the one of least id is the later; a prompt's own instant doesn't count.
    old = msgs.select((-F.col("message_id")).alias("other_id"), "session_key", "role", "content", "ts")
    now = msgs.where("role = 'user'").select(F.col("message_id").alias("prompt_id"), "session_key", (F.col("ts") - 1).alias("now"))

    def before(rows, n):
        return latest(now, rows, "session_key", n, "prompt_id", "now", "ts", "other_id", ("role", "content")).withColumnRenamed("place", "rank")

    briefings = msgs.where("turn_index = 1").select("session_key", F.col("content").alias("briefing"))
    return context.built(p, "Memory is on.", "Tools: recall, search.", briefings, ideas, hits, before(old, context.MATCHES), before(old.where("role = 'assistant'"), 1), ranked(active.where("store = 'procedural'"), 3))


_BASE_WEIGHTS = [0.22, 0.2, 0.12, 0.03, 0.13, 0.08, 0.12, 0.1]


def _policies(spark, d):
    """A policy for each user: some stored, locked or tuned of late."""
    u = t.recall_log(spark, d).select("user_id").distinct()
    i = F.col("user_id")
    return u.select("user_id", F.array(*[F.lit(w) for w in _BASE_WEIGHTS]).alias("weights"), (1 + i % 4).alias("generation"), (i % 2 == 0).alias("stored"), (i % 11 == 3).alias("locked"), F.when(i % 7 == 2, F.lit(NOW_MS - 3_600_000)).when(i % 7 == 4, F.lit(NOW_MS - 2 * DAY_MS)).alias("tuned_ms"))


def _signals(spark, d):
    logs = t.recall_log(spark, d)
    k = F.element_at("top_ids", 1)
    cand = logs.select("log_id", "user_id", F.explode(F.array_distinct(F.concat("top_ids", F.array((k + 7) % 100, (k + 11) % 100)))).alias("memory_id"))
    i = F.col("memory_id")
    signals = F.array(F.col("confidence"), F.col("strength"), F.col("arousal"), F.col("access_count") / 25.0, F.col("salience"), (i % 3) / 2.0, (i % 5) / 4.0, F.when(F.col("kb_id").isNotNull(), 1.0).otherwise(0.0))
    return cand.join(t.memories(spark, d).select("memory_id", signals.alias("signals")), "memory_id")


_HASHED = "CAST('0x' || substr(sha256({0}), {1}, 8) AS BIGINT)"


@query("i10_policy_tuning", sql(f"""WITH RECURSIVE u AS (SELECT DISTINCT user_id FROM recall_log), pol AS (SELECT user_id, {_BASE_WEIGHTS}::DOUBLE[] AS weights, 1 + user_id % 4 AS generation, user_id % 2 = 0 AS stored, user_id % 11 = 3 AS locked, CASE WHEN user_id % 7 = 2 THEN $NOW - 3600000 WHEN user_id % 7 = 4 THEN $NOW - {2 * DAY_MS} END AS tuned_ms FROM u),
    c AS (SELECT *, user_id || ':' || generation || ':' || candidate || ':' AS seed FROM (SELECT *, unnest(range(0, 5)) AS candidate FROM pol WHERE NOT locked)),
    dr AS (SELECT *, list_transform({list(tuning.KEYS)}, lambda k: {_HASHED.format("seed || k", 1)}) AS drawn, list_transform({list(tuning.KEYS)}, lambda k: {_HASHED.format("seed || k", 9)} % 2 = 1) AS ups, 2 + {_HASHED.format("seed || 'moved'", 1)} % 2 AS moved FROM c),
    mv AS (SELECT *, CASE WHEN candidate = 0 THEN weights ELSE list_transform(range(1, 9), lambda i: CASE WHEN drawn[i] <= list_sort(drawn)[moved] THEN greatest(0.02, least(0.5, weights[i] * CASE WHEN ups[i] THEN 1.15 ELSE 0.85 END)) ELSE weights[i] END) END::DOUBLE[] AS v FROM dr),
    wf AS (SELECT user_id, candidate, 0 AS step, v, list_transform(range(1, 9), lambda i: false) AS held, 1.0::DOUBLE AS rest FROM mv WHERE candidate > 0
        UNION ALL SELECT user_id, candidate, step + 1, CASE WHEN k > 0 THEN list_transform(range(1, 9), lambda i: CASE WHEN i = k THEN bound ELSE v[i] END) ELSE list_transform(range(1, 9), lambda i: CASE WHEN held[i] THEN v[i] ELSE share[i] END) END, list_transform(range(1, 9), lambda i: held[i] OR i = k), CASE WHEN k > 0 THEN rest - bound ELSE rest END FROM (
            SELECT *, CASE WHEN share[k] < 0.02 THEN 0.02 ELSE 0.5 END::DOUBLE AS bound FROM (SELECT *, coalesce(list_position(list_transform(range(1, 9), lambda i: NOT held[i] AND (share[i] < 0.02 OR share[i] > 0.5)), true), 0) AS k FROM (
                SELECT *, list_transform(own, lambda x: x / list_sum(own) * rest) AS share FROM (SELECT *, list_transform(range(1, 9), lambda i: CASE WHEN held[i] THEN 0 ELSE greatest(v[i], 0) END) AS own FROM wf WHERE step <= 8)))) ),
    fin AS (SELECT user_id, candidate, list_transform(v, lambda x: greatest(0.02, least(0.5, x))) AS v FROM wf WHERE step = 9),
    var AS MATERIALIZED (SELECT user_id, candidate, weights AS w FROM mv WHERE candidate = 0 UNION ALL SELECT user_id, candidate, list_transform(range(1, 9), lambda i: CASE WHEN i = 1 THEN greatest(0.02, least(0.5, v[1] + 1 - list_sum(v))) ELSE v[i] END) FROM fin),
    lg AS (SELECT log_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_ms DESC, log_id DESC) AS n FROM recall_log) WHERE n <= 50),
    rel AS (SELECT l.log_id, list(DISTINCT a.memory_id) AS relevant FROM recall_log l JOIN activity a ON l.user_id = a.user_id AND a.ts BETWEEN l.created_ms AND l.created_ms + {10 * DAY_MS} GROUP BY l.log_id),
    hit AS (SELECT log_id, memory_id, [confidence, strength, arousal, access_count / 25.0::DOUBLE, salience, memory_id % 3 / 2.0::DOUBLE, memory_id % 5 / 4.0::DOUBLE, CASE WHEN kb_id IS NOT NULL THEN 1 ELSE 0 END]::DOUBLE[] AS s
        FROM (SELECT log_id, unnest(list_distinct(top_ids || [(top_ids[1] + 7) % 100, (top_ids[1] + 11) % 100])) AS memory_id FROM recall_log) JOIN memories USING (memory_id)),
    sc AS (SELECT log_id, lg.user_id, v.candidate, memory_id, round(list_dot_product(s, w), 6) AS score FROM hit JOIN lg USING (log_id) JOIN var v ON v.user_id = lg.user_id),
    rk AS (SELECT log_id, user_id, candidate, list(memory_id) AS shown FROM (SELECT *, row_number() OVER (PARTITION BY log_id, candidate ORDER BY score DESC, memory_id) AS n FROM sc) WHERE n <= 3 GROUP BY ALL),
    ev AS (SELECT user_id, candidate, count(*) AS evaluated, round(avg(round((round(x / len(shown)::DOUBLE, 6) + round(x / len(relevant)::DOUBLE, 6)) / 2, 6)), 6) AS score FROM (SELECT *, len(list_intersect(shown, relevant)) AS x FROM rk JOIN rel USING (log_id)) GROUP BY user_id, candidate),
    st AS (SELECT pol.*, b.score AS base, b.evaluated, (SELECT max(score) FROM ev WHERE ev.user_id = pol.user_id AND candidate > 0) AS best, (SELECT arg_min(candidate, (-score, candidate)) FROM ev WHERE ev.user_id = pol.user_id AND candidate > 0) AS first FROM pol LEFT JOIN ev b ON b.user_id = pol.user_id AND b.candidate = 0),
    dec AS (SELECT *, CASE WHEN locked THEN 'locked' WHEN evaluated IS NULL THEN 'no samples' WHEN coalesce($NOW - tuned_ms < {DAY_MS}, false) THEN 'interval' END AS skipped, CASE WHEN best > base AND best > CASE WHEN base <= 0 THEN 0.05 ELSE base * 1.05 END THEN first END AS won FROM st)
    SELECT d.user_id, v.candidate::INT AS candidate, CASE WHEN v.candidate = 0 THEN generation WHEN stored THEN generation + 1 ELSE 1 END AS generation, CASE WHEN v.candidate = 0 AND won IS NULL OR v.candidate = won THEN 'active' ELSE 'rejected' END AS status, ev.score, d.evaluated, list_transform(w, lambda x: round(x, 6)) AS weights FROM dec d JOIN var v USING (user_id) JOIN ev ON ev.user_id = d.user_id AND ev.candidate = v.candidate WHERE skipped IS NULL
    UNION ALL SELECT user_id, NULL, generation, skipped, NULL, 0, list_transform(weights, lambda x: round(x, 6)) FROM dec WHERE skipped IS NOT NULL"""))
def i10(spark, d):
    logs = t.recall_log(spark, d)
    out = tuning.tuned(_policies(spark, d), logs, _signals(spark, d), replay.samples(logs, t.activity(spark, d), 10 * DAY_MS), NOW_MS)
    return out.withColumn("weights", F.transform("weights", lambda x: F.round(x, 6)))


def _graph_answers(spark, d):
    """A model's stored answers for two memories of three: entities from title, number and channel, relations between them, a hint; some in a code fence, some broken."""
    m = t.memories(spark, d).where("memory_id % 3 != 0")
    i = F.col("memory_id")
    word = F.split("title", " ")[0]
    ent = lambda label, kind: F.struct(label.alias("label"), kind.cast("string").alias("type"), F.concat(F.lit(" about "), i.cast("string")).alias("description"))
    node = F.concat(F.lit("Node "), (i % 7).cast("string"))
    entities = F.array(ent(F.concat(F.lit(" "), word), t.pick(("person", "tool", "planet"), i)), ent(node, F.lit(None)), ent(F.col("channel"), F.lit("channel")), ent(F.lit("  "), F.lit("goal")), ent(F.upper(node), F.lit("project")), ent(F.lit("sixth"), F.lit("goal")))
    rel = lambda a, b, kind, w, note: F.struct(a.alias("from"), b.alias("to"), kind.alias("type"), w.cast("double").alias("weight"), note.cast("string").alias("note"))
    rels = F.array(rel(F.lower(node), F.col("channel"), t.pick(("uses", "depends_on", "likes"), i), (i % 13) / 10.0, F.when(i % 4 == 0, F.concat(F.lit("n"), i.cast("string")))), rel(F.col("channel"), F.lit("nobody"), F.lit("owns"), F.lit(None), F.lit("")), rel(F.col("channel"), node, F.lit("leads_to"), F.lit(None), F.lit(None)))
    text = F.to_json(F.struct(entities.alias("entities"), F.when(i % 10 < 8, rels).alias("relations"), F.when(i % 2 == 0, F.substring(F.element_at(F.split("title", " "), -1), 1, 4)).alias("associationHint")))
    return m.select("memory_id", F.when(i % 11 == 1, "broken {").when(i % 5 == 2, F.concat(F.lit("```json\n"), text, F.lit("\n```"))).otherwise(text).alias("answer"))


def _enriched(spark, d):
    m = t.memories(spark, d).withColumn("graph_enriched", F.col("memory_id") % 8 == 1)
    u = m.select("user_id").distinct()
    nodes = u.where("user_id % 2 = 0").select("user_id", F.lit("concept:node-3").alias("node_key"), F.lit("The third").alias("label"), F.lit("concept").alias("node_type"), F.lit("old").alias("description"), F.array(F.lit(-1).cast("long")).alias("sources"))
    relations = u.where("user_id % 3 = 0").select("user_id", F.lit("channel:en").alias("from_key"), F.lit("project:node-3").alias("to_key"), F.lit("leads_to").alias("relation"), F.lit(0.9).alias("weight"), F.lit("was").alias("note"), F.array(F.lit(-2).cast("long")).alias("evidence"), F.array(F.lit("old")).alias("channels"))
    used = u.select("user_id", F.when(F.col("user_id") % 4 == 0, 1000 - 6).otherwise(0).alias("used"))
    return enrich.enriched(m, _graph_answers(spark, d), nodes, relations, used)


_SLUGGED = "coalesce(nullif(regexp_replace(regexp_replace(lower(trim({0}, " + _BLANKS + ")), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), ''), 'untitled')"
_ENRICHED = f"""WITH a AS (SELECT *, memory_id % 8 = 1 AS done, memory_id % 11 = 1 AS broken, string_split(title, ' ')[1] AS word, 'Node ' || memory_id % 7 AS node FROM memories WHERE memory_id % 3 <> 0),
    n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY memory_id) AS nth FROM a WHERE NOT done), ask AS (SELECT * FROM n WHERE nth <= CASE WHEN user_id % 4 = 0 THEN 6 ELSE 1000 END), g AS MATERIALIZED (SELECT * FROM ask WHERE NOT broken),
    f AS MATERIALIZED (SELECT *, kind || ':' || {_SLUGGED.format("label")} AS node_key FROM (SELECT user_id, memory_id, 0 AS place, trim(word, {_BLANKS}) AS label, (['person', 'tool', 'planet'])[memory_id % 3 + 1] AS kind FROM g UNION ALL SELECT user_id, memory_id, 1, node, 'concept' FROM g UNION ALL SELECT user_id, memory_id, 2, channel, 'channel' FROM g UNION ALL SELECT user_id, memory_id, 4, upper(node), 'project' FROM g) WHERE label <> '' AND kind <> 'planet'),
    s AS MATERIALIZED (SELECT user_id, memory_id, channel, 0 AS place, 'project:node-' || memory_id % 7 AS from_key, 'channel:' || {_SLUGGED.format("channel")} AS to_key, (['uses', 'depends_on', 'likes'])[memory_id % 3 + 1] AS relation, memory_id % 13 / 10.0::DOUBLE AS weight, CASE WHEN memory_id % 4 = 0 THEN 'n' || memory_id END AS note FROM g WHERE memory_id % 10 < 8
        UNION ALL SELECT user_id, memory_id, channel, 1, NULL, NULL, 'owns', 0.7, NULL FROM g WHERE memory_id % 10 < 8 UNION ALL SELECT user_id, memory_id, channel, 2, 'channel:' || {_SLUGGED.format("channel")}, 'project:node-' || memory_id % 7, 'leads_to', 0.7, NULL FROM g WHERE memory_id % 10 < 8)"""


@query("i8_enriched_status", sql(f"{_ENRICHED} SELECT memory_id, CASE WHEN done THEN 'already_enriched' WHEN memory_id NOT IN (SELECT memory_id FROM ask) THEN 'daily_cap_reached' WHEN broken THEN 'parse_failed' ELSE 'enriched' END AS status FROM a"))
def i8_status(spark, d):
    return _enriched(spark, d).statuses


@query("i8_enriched_nodes", sql(f"""{_ENRICHED} SELECT user_id, node_key, CASE WHEN stored THEN 'The third' ELSE label END AS label, CASE WHEN stored THEN 'concept' ELSE kind END AS node_type, CASE WHEN stored THEN 'old' ELSE 'about ' || first END AS description, array_to_string(CASE WHEN stored THEN list_prepend(-1, ids) ELSE ids END, ',') AS sources, NOT stored AS created
    FROM (SELECT user_id, node_key, user_id % 2 = 0 AND node_key = 'concept:node-3' AS stored, arg_min(label, (memory_id, place)) AS label, arg_min(kind, (memory_id, place)) AS kind, min(memory_id) AS first, list_sort(list(DISTINCT memory_id)) AS ids FROM f GROUP BY user_id, node_key)"""))
def i8_nodes(spark, d):
    return _enriched(spark, d).nodes.withColumn("sources", F.array_join(F.transform("sources", lambda x: x.cast("string")), ","))


@query("i8_enriched_relations", sql(f"""{_ENRICHED} SELECT user_id, from_key, to_key, relation, greatest(w, CASE WHEN stored THEN 0.9 ELSE 0 END)::DOUBLE AS weight, coalesce(note, CASE WHEN stored THEN 'was' END, '') AS note, array_to_string(CASE WHEN stored THEN list_prepend(-2, ids) ELSE ids END, ',') AS evidence, array_to_string(list_sort(CASE WHEN stored THEN list_append(ch, 'old') ELSE ch END), ',') AS channels, NOT stored AS created
    FROM (SELECT user_id, from_key, to_key, relation, user_id % 3 = 0 AND from_key = 'channel:en' AND to_key = 'project:node-3' AND relation = 'leads_to' AS stored, max(greatest(0.1, least(1, weight))) AS w, arg_max(note, (memory_id, place)) FILTER (note IS NOT NULL) AS note, list_sort(list(DISTINCT memory_id)) AS ids, list(DISTINCT channel) AS ch FROM s WHERE from_key IS NOT NULL AND relation <> 'likes' GROUP BY ALL)"""))
def i8_relations(spark, d):
    out = _enriched(spark, d).relations
    return out.withColumn("evidence", F.array_join(F.transform("evidence", lambda x: x.cast("string")), ",")).withColumn("channels", F.array_join("channels", ","))


@query("i8_enriched_associations", sql(f"""{_ENRICHED}, h AS (SELECT user_id, memory_id, lower(trim(substring(string_split(title, ' ')[-1], 1, 4), {_BLANKS})) AS hint FROM g WHERE memory_id % 2 = 0), m AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_ms DESC, memory_id DESC) AS n FROM memories WHERE NOT archived),
    t AS (SELECT h.memory_id, m.memory_id AS to_id, row_number() OVER (PARTITION BY h.memory_id ORDER BY m.created_ms DESC, m.memory_id DESC) AS k FROM h JOIN m ON m.user_id = h.user_id AND m.n <= 100 AND m.memory_id <> h.memory_id AND (contains(lower(m.title), hint) OR contains(lower(m.content), hint)) WHERE hint <> ''),
    l AS (SELECT memory_id, arg_min(relation, place) AS relation, arg_min(weight, place) AS weight FROM s WHERE relation <> 'likes' GROUP BY memory_id)
    SELECT t.memory_id AS from_id, to_id, CASE coalesce(relation, 'occurs_with') WHEN 'depends_on' THEN 'derives_from' WHEN 'occurs_with' THEN 'co_occurred' WHEN 'leads_to' THEN 'precedes' ELSE 'supports' END AS relation, greatest(0.1, least(1, coalesce(weight, 0.75)))::DOUBLE AS weight FROM t LEFT JOIN l USING (memory_id) WHERE k = 1"""))
def i8_associations(spark, d):
    return _enriched(spark, d).associations


@query("a19_transcript_ends", sql("""WITH l AS (SELECT session_key % 20 AS f, message_id, role, content, row_number() OVER (PARTITION BY session_key % 20 ORDER BY session_key, turn_index, content, role) AS pos, message_id % 7 = 3 AS bad, session_key % 4 = 0 AND turn_index = 2 AS queued, session_key FROM messages),
    g AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY pos DESC) AS back FROM l WHERE NOT bad),
    e AS (SELECT f, arg_min('queued ' || message_id, pos) FILTER (queued) AS q, arg_min(CASE WHEN message_id % 3 = 1 THEN content || chr(10) || 'tool' ELSE content END, pos) FILTER (role = 'user' AND NOT queued) AS u, arg_min(content, pos) FILTER (role = 'assistant' AND NOT queued) AS a, arg_max(content, pos) FILTER (role = 'assistant' AND NOT queued AND back <= 50) AS last, arg_min('s' || session_key, pos) FILTER (role = 'assistant' OR queued) AS s, arg_min('s' || session_key, pos) FILTER (queued) AS qs, count(*) AS lines FROM g GROUP BY f)
    SELECT f::INT AS transcript, CASE WHEN q IS NULL THEN s ELSE qs END AS session_id, coalesce(q, u) AS user_text, CASE WHEN q IS NOT NULL THEN 'queue-operation' WHEN u IS NOT NULL THEN 'user-message' END AS user_source, a AS assistant_text, last AS last_answer, CASE WHEN coalesce(q, u) IS NOT NULL AND a IS NOT NULL THEN 'complete' WHEN coalesce(q, u) IS NOT NULL THEN 'abandoned-before-assistant' ELSE 'missing' END AS status, lines, (SELECT count(*) FROM l WHERE l.f = e.f AND bad) AS malformed FROM e"""))
def a19(spark, d):
    """Conversations as twenty transcripts on disk, some lines of which are broken or queued prompts."""
    i, s, c = F.col("message_id"), F.col("session_key"), F.col("content")
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    session = F.concat(F.lit("s"), s.cast("string"))
    plain = F.to_json(F.struct(F.col("role").alias("type"), F.struct("role", c.alias("content")).alias("message")))
    parts = F.concat(F.lit('{"role":"'), F.col("role"), F.lit('","content":['), F.to_json(part("text", c)), F.lit(',{"type":"tool_result","content":"tool"}]}'))
    answer = F.to_json(F.struct(F.lit("assistant").alias("role"), F.array(part("text", c), part("tool_use", F.lit("no"))).alias("content"), session.alias("sessionId")))
    queued = F.to_json(F.struct(F.lit("queue-operation").alias("type"), F.lit("enqueue").alias("operation"), F.concat(F.lit("queued "), i.cast("string")).alias("content"), session.alias("session_id")))
    line = F.when(i % 7 == 3, "not json {").when((s % 4 == 0) & (F.col("turn_index") == 2), queued).when(F.col("role") == "assistant", answer).when(i % 3 == 1, parts).otherwise(plain)
    path = cleanup.scratch_folder(spark, "transcripts")
    rows = t.messages(spark, d).groupBy((s % 20).alias("f")).agg(F.array_sort(F.collect_list(F.struct("session_key", "turn_index", "content", "role", line.alias("value")))).alias("x"))
    rows.select("f", F.array_join(F.transform("x", lambda x: x["value"]), "\n").alias("value")).repartition("f").write.partitionBy("f").text(path)
    ends = files.transcript_ends(files.read_transcripts(spark, path))
    return ends.select(F.regexp_extract("file", "/f=([0-9]+)/", 1).cast("int").alias("transcript"), *ends.columns[1:])


@query("l13_sections", sql(f"""SELECT memory_id, place, kind, text FROM (SELECT memory_id, unnest([0, 1, 2, 3]) AS place, unnest(['user', 'body', 'assistant', 'recalled']) AS kind, unnest([{_line_sql("title", 999)}, 'then', {_line_sql("content", 99999999)}, 'old']) AS text FROM memories) WHERE text <> ''"""))
def l13(spark, d):
    """The table function in SQL, over texts with four sections."""
    tables.register(spark)
    m = t.memories(spark, d).select("memory_id", F.concat(F.lit("<user>"), "title", F.lit("</user> then <assistant>"), "content", F.lit("</assistant><recalled_context> old </recalled_context>")).alias("content"))
    return spark.sql("SELECT memory_id, s.place, s.kind, s.text FROM {m}, LATERAL sections(content) s", m=m)


@query("l13_extraction_windows", sql("""WITH RECURSIVE m AS MATERIALIZED (SELECT message_id, user_id, ts, length(content) AS chars, row_number() OVER (PARTITION BY user_id ORDER BY ts, message_id) AS step FROM messages),
    go AS (SELECT user_id, step, message_id, ts, chars, 1 AS n, chars AS size, 0 AS no FROM m WHERE step = 1
        UNION ALL SELECT user_id, step, message_id, ts, chars, CASE WHEN cut THEN 1 ELSE n + 1 END, CASE WHEN cut THEN chars ELSE size + chars END, CASE WHEN cut THEN no + 1 ELSE no END FROM (SELECT m.*, g.n, g.size, g.no, m.ts - g.ts > 900000 OR g.n >= 4 OR g.size + m.chars > 4000 AS cut FROM go g JOIN m ON m.user_id = g.user_id AND m.step = g.step + 1))
    SELECT message_id, no::BIGINT AS window_no, chars FROM go"""))
def l13_windows(spark, d):
    tables.register(spark)
    m = t.messages(spark, d).select("message_id", "user_id", "ts", "content")
    return spark.sql("SELECT * FROM extraction_windows(TABLE({m}) PARTITION BY user_id ORDER BY (ts, message_id), 900000, 4, 4000)", m=m)


_IDEAS = f"""SELECT trace_id, (['pending_notification', 'notified', 'read', 'dismissed'])[trace_id % 4 + 1] AS status, CASE WHEN trace_id % 4 >= 1 THEN created_ms END AS notified_ms, CASE WHEN trace_id % 4 >= 1 THEN created_ms + 1 END AS emailed_ms, CASE WHEN trace_id % 8 >= 2 THEN created_ms + 2 END AS read_ms, CASE WHEN trace_id % 4 = 3 THEN created_ms + 3 END AS dismissed_ms, NULL::BIGINT AS starred_ms, created_ms AS updated_ms,
    (['pending_notification', 'notified', 'read', 'dismissed', 'starred', NULL])[trace_id % 6 + 1] AS moved FROM traces"""


@query("k15_idea_status", sql(f"""SELECT trace_id, CASE WHEN moved IS NULL OR moved = 'starred' THEN status ELSE moved END AS status, CASE WHEN moved IS NULL OR moved = 'starred' THEN notified_ms WHEN moved = 'pending_notification' THEN NULL ELSE coalesce(notified_ms, $NOW) END AS notified_ms, CASE WHEN moved = 'pending_notification' THEN NULL ELSE emailed_ms END AS emailed_ms,
    CASE WHEN moved IS NULL OR moved = 'starred' THEN read_ms WHEN moved = 'read' THEN $NOW WHEN moved = 'dismissed' THEN coalesce(read_ms, $NOW) END AS read_ms, CASE WHEN moved IS NULL OR moved = 'starred' THEN dismissed_ms WHEN moved = 'dismissed' THEN $NOW END AS dismissed_ms, CASE WHEN moved = 'starred' THEN $NOW END AS starred_ms, CASE WHEN moved IS NULL THEN updated_ms ELSE $NOW END AS updated_ms FROM ({_IDEAS})"""))
def k15(spark, d):
    i, at = F.col("trace_id"), F.col("created_ms")
    ideas = t.traces(spark, d).select("trace_id", t.pick(("pending_notification", "notified", "read", "dismissed"), i).alias("status"), F.when(i % 4 >= 1, at).alias("notified_ms"), F.when(i % 4 >= 1, at + 1).alias("emailed_ms"), F.when(i % 8 >= 2, at + 2).alias("read_ms"), F.when(i % 4 == 3, at + 3).alias("dismissed_ms"), F.lit(None).cast("long").alias("starred_ms"), at.alias("updated_ms"), F.nullif(t.pick(("pending_notification", "notified", "read", "dismissed", "starred", "-"), i), F.lit("-")).alias("to"))
    return lifecycle.idea_status(ideas, NOW_MS).drop("to")


#: The instant of the reflection: two hours of the first memories are out of its window of 72.
_REFLECTS = EPOCH_MS + 74 * HOUR_MS


def _reflection_answers(spark, d):
    """A model's stored answers, from each user's first memory: lists with blanks, some without summary, in a fence, empty or broken."""
    u = t.memories(spark, d).groupBy("user_id").agg(F.min_by(F.struct("title", "content", "memory_id"), "memory_id").alias("m"))
    i = F.col("user_id")
    text = F.to_json(F.struct(F.array(F.col("m.content"), F.lit(" "), F.lit("keep it")).alias("decisions"), F.array(F.concat(F.lit("learned "), i.cast("string"))).alias("lessons"), F.when(i % 2 == 0, F.array(F.col("m.title"), F.lit(None))).alias("openLoops"), F.when(i % 3 != 0, F.concat(F.lit(" about "), F.col("m.title"))).alias("summary"), F.when(i % 4 == 0, F.array(F.lit("tag"))).alias("tags")))
    return u.select("user_id", F.when(i % 7 == 1, " ").when(i % 7 == 2, "[1]").when(i % 5 == 3, F.concat(F.lit("```json\n"), text, F.lit("\n```"))).otherwise(text).alias("answer"))


_REFLECTED = f"""WITH u AS (SELECT user_id, arg_min(title, memory_id) AS title, arg_min(content, memory_id) AS content, count(*) FILTER (NOT archived AND created_ms >= {EPOCH_MS} + 2 * {HOUR_MS}) AS read FROM memories GROUP BY user_id),
    s AS (SELECT *, CASE WHEN read < 9 THEN 'too few memories' WHEN user_id % 7 = 1 THEN 'empty answer' WHEN user_id % 7 = 2 THEN 'no JSON' END AS skipped, ['reflection', 'distilled'] || CASE WHEN user_id % 4 = 0 THEN ['tag'] ELSE [] END AS tags FROM u), g AS (SELECT * FROM s WHERE skipped IS NULL),
    rows AS (SELECT user_id, 0 AS place, 'episodic' AS store, 'decision' AS category, 'Decision: ' || substring(content, 1, 80) AS title, content, 0.85 AS strength, 0.8 AS confidence, 0.2 AS arousal, tags FROM g WHERE trim(content, {_BLANKS}) <> '' UNION ALL SELECT user_id, 2, 'episodic', 'decision', 'Decision: keep it', 'keep it', 0.85, 0.8, 0.2, tags FROM g
        UNION ALL SELECT user_id, 0, 'semantic', 'lesson', 'Lesson: learned ' || user_id, 'learned ' || user_id, 0.85, 0.8, 0.2, tags FROM g UNION ALL SELECT user_id, 0, 'prospective', 'goal', 'Open loop: ' || title, title, 0.75, 0.7, 0.3, list_append(tags, 'open-loop') FROM g WHERE user_id % 2 = 0 AND trim(title, {_BLANKS}) <> ''
        UNION ALL SELECT user_id, 0, 'episodic', 'conversation', 'Reflection summary: 2024-01-04', trim('about ' || title, {_BLANKS}), 0.8, 0.75, 0.2, tags FROM g WHERE user_id % 3 <> 0)"""


@query("i12_reflection", sql(f"{_REFLECTED} SELECT user_id, place, store, category, title, content, strength::DOUBLE AS strength, confidence::DOUBLE AS confidence, arousal::DOUBLE AS arousal, array_to_string(tags, ',') AS tags FROM rows WHERE (user_id, store, category, title) NOT IN (SELECT (user_id, store, category, title) FROM memories WHERE NOT archived)"))
def i12(spark, d):
    rows = reflection.reflected(t.memories(spark, d), _reflection_answers(spark, d), _REFLECTS, 72, 9)[0]
    return rows.withColumn("tags", F.array_join("tags", ","))


@query("i12_reflection_runs", sql(f"{_REFLECTED} SELECT user_id, read, (SELECT count(*) FROM rows r WHERE r.user_id = s.user_id) AS written, skipped FROM s"))
def i12_runs(spark, d):
    return reflection.reflected(t.memories(spark, d), _reflection_answers(spark, d), _REFLECTS, 72, 9)[1]


def _idea_answers(spark, d):
    """A model's stored answers: of each user every ninth memory as an idea, some of them short, doubtful, repeated or with foreign sources."""
    i, u = F.col("memory_id"), F.col("user_id")
    title = F.when(i % 4 == 0, F.concat(F.lit("The same idea of "), F.col("channel"))).when(i % 4 == 1, F.concat(F.lit("A same, idea of "), F.col("channel"))).when(i % 4 == 2, F.lit("!!!!!!!!!!!!")).otherwise(F.col("title"))
    one = F.struct(i.alias("id"), title.alias("title"), F.col("content").alias("summary"), t.pick(("pattern", "connection", "else"), i).alias("ideaType"), F.col("confidence"), F.array(i.cast("string"), i.cast("string"), F.lit("5"), F.lit("x")).alias("sourceMemoryIds"), F.when(i % 2 == 0, F.array((u * 1000 + 1).cast("string"), F.lit("-1"))).alias("sourceEnsembleIds"))
    every = F.to_json(F.array_sort(F.collect_list(one)))
    m = t.memories(spark, d).where("memory_id % 9 = 0").groupBy("user_id").agg(every.alias("e"))
    return m.select("user_id", t.pick(("aggressive", "conservative", "often"), u).alias("frequency"), F.when(u % 2 == 0, F.concat(F.lit('```json\n{"ideas":'), "e", F.lit("}\n```"))).otherwise(F.col("e")).alias("answer"))


@query("i14_ideas", sql(f"""WITH c AS (SELECT user_id, memory_id, memory_id // 60 % 3 AS e FROM memories WHERE user_id % 5 <> 1 AND memory_id % 2 = 0), fi AS (SELECT user_id, memory_id FROM memories WHERE user_id % 4 = 1 AND memory_id % 9 < 3),
    r AS (SELECT m.user_id, memory_id, row_number() OVER (PARTITION BY m.user_id ORDER BY memory_id) - 1 AS place, trim(CASE memory_id % 4 WHEN 0 THEN 'The same idea of ' || channel WHEN 1 THEN 'A same, idea of ' || channel WHEN 2 THEN '!!!!!!!!!!!!' ELSE title END, {_BLANKS}) AS title, trim(content, {_BLANKS}) AS summary, (['pattern', 'connection', 'insight'])[memory_id % 3 + 1] AS idea_type, confidence, (['aggressive', 'conservative', 'balanced'])[user_id % 3 + 1] AS f FROM memories m WHERE memory_id % 9 = 0 AND (user_id IN (SELECT user_id FROM c) OR user_id IN (SELECT user_id FROM fi))),
    k AS (SELECT *, {_IDEA} AS key FROM r WHERE length(title) >= 10 AND length(summary) >= 30 AND confidence >= CASE f WHEN 'aggressive' THEN {discovery.FREQUENCIES["aggressive"][1]} WHEN 'conservative' THEN {discovery.FREQUENCIES["conservative"][1]} ELSE {discovery.FREQUENCIES["balanced"][1]} END),
    o AS (SELECT * FROM k WHERE (user_id, key) NOT IN (SELECT (user_id, 'same idea of en') FROM memories WHERE user_id % 3 = 0)), q AS (SELECT *, row_number() OVER (PARTITION BY user_id, CASE WHEN key = '' THEN '#' || place ELSE key END ORDER BY place) AS n FROM o),
    w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY place) AS nth FROM q WHERE n = 1), v AS (SELECT user_id, memory_id FROM c UNION SELECT user_id, memory_id FROM fi),
    x AS (SELECT w.*, concat_ws(',', CASE WHEN (user_id, memory_id) IN (SELECT (user_id, memory_id) FROM v) THEN memory_id::VARCHAR END, CASE WHEN memory_id <> 5 AND (user_id, 5) IN (SELECT (user_id, memory_id) FROM v) THEN '5' END) AS memory_ids, CASE WHEN memory_id % 2 = 0 AND (user_id, 1) IN (SELECT (user_id, e) FROM c) THEN (user_id * 1000 + 1)::VARCHAR END AS ensemble_ids FROM w WHERE nth <= CASE f WHEN 'aggressive' THEN {discovery.FREQUENCIES["aggressive"][0]} WHEN 'conservative' THEN {discovery.FREQUENCIES["conservative"][0]} ELSE {discovery.FREQUENCIES["balanced"][0]} END)
    SELECT user_id, place::INT AS place, title, summary, idea_type, confidence, memory_ids, ensemble_ids FROM x WHERE memory_ids <> ''"""))
def i14(spark, d):
    m = t.memories(spark, d)
    changed = m.where("user_id % 5 != 1 AND memory_id % 2 = 0").groupBy("user_id", (F.col("user_id") * 1000 + F.floor(F.col("memory_id") / 60) % 3).alias("ensemble_id")).agg(F.collect_list("memory_id").alias("members"))
    findings = m.where("user_id % 4 = 1 AND memory_id % 9 < 3").select("user_id", "memory_id")
    ideas = m.select("user_id").distinct().select("user_id", F.lit("same idea, of en!").alias("title"), F.when(F.col("user_id") % 3 == 0, NOW_MS - 1000).otherwise(NOW_MS - 2 * DAY_MS).alias("created_ms"))
    out = discovery.discovered(_idea_answers(spark, d), changed, findings, ideas, NOW_MS)
    return out.withColumn("memory_ids", F.array_join("memory_ids", ",")).withColumn("ensemble_ids", F.array_join("ensemble_ids", ","))


def _pulses(spark, d):
    """A pulse at each user's message of turn 2 or later; two users of ten are off."""
    m = t.messages(spark, d)
    p = m.where("role = 'user' AND turn_index >= 2").select(F.col("message_id").alias("pulse_id"), "user_id", "session_key", "ts", F.when(F.col("message_id") % 2 == 0, "recall").alias("intent"), F.col("channel"))
    return checkpoint(pulse.admitted(p, m.select("user_id").distinct().where("user_id % 5 != 3")))


def _predictions(pulses):
    """A model's stored answer to each pulse."""
    i = F.col("pulse_id")
    one = F.struct(F.concat(F.lit("q"), i.cast("string")).alias("predictedQuery"), t.pick(("context", "other", "warning"), i).alias("traceType"), ((i % 15) / 10.0).alias("confidence"), (i % 100).cast("double").alias("ttlHours"), F.when(i % 3 == 0, "habit").otherwise("").alias("sourcePattern"))
    text = F.to_json(F.array(one, F.struct(*[F.lit(None).cast("string").alias(c) for c in ("predictedQuery", "traceType")], *[F.lit(None).cast("double").alias(c) for c in ("confidence", "ttlHours")], F.lit(None).cast("string").alias("sourcePattern"))))
    return pulses.select("pulse_id", F.when(i % 4 == 1, "nothing").when(i % 4 == 2, F.concat(F.lit('{"traces":'), text, F.lit("}"))).otherwise(text).alias("answer"))


def _own_memories(spark, d):
    return t.memories(spark, d).withColumn("user_id", F.col("user_id") % 10)


_PULSES = f"""WITH RECURSIVE p0 AS (SELECT message_id AS pulse_id, user_id, session_key, ts, CASE WHEN message_id % 2 = 0 THEN 'recall' END AS intent, channel FROM messages WHERE role = 'user' AND turn_index >= 2), p1 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, pulse_id) AS step FROM p0 WHERE user_id % 5 <> 3),
    lim AS (SELECT user_id, step, pulse_id, ts AS last, 'ok' AS status FROM p1 WHERE step = 1 UNION ALL SELECT p1.user_id, p1.step, p1.pulse_id, CASE WHEN p1.ts - l.last >= 60000 THEN p1.ts ELSE l.last END, CASE WHEN p1.ts - l.last >= 60000 THEN 'ok' ELSE 'limited' END FROM lim l JOIN p1 ON p1.user_id = l.user_id AND p1.step = l.step + 1),
    p AS MATERIALIZED (SELECT p0.*, coalesce(lim.status, 'disabled') AS status FROM p0 LEFT JOIN lim USING (pulse_id)), ok AS MATERIALIZED (SELECT * FROM p WHERE status = 'ok'),
    said AS (SELECT ok.pulse_id, m.*, row_number() OVER (PARTITION BY ok.pulse_id ORDER BY m.ts DESC, m.message_id DESC) AS n, row_number() OVER (PARTITION BY ok.pulse_id, m.role ORDER BY m.ts DESC, m.message_id DESC) AS k FROM ok JOIN messages m ON m.session_key = ok.session_key AND m.ts <= ok.ts),
    summed AS (SELECT pulse_id, string_agg(role || ': ' || CASE WHEN length(content) > 300 THEN substring(content, 1, 300) || '...' ELSE content END, chr(10) ORDER BY ts, message_id) AS summary FROM said WHERE n <= 20 GROUP BY pulse_id),
    topic AS (SELECT pulse_id, list_distinct(list_filter(regexp_split_to_array(lower(string_agg(substring(content, 1, 200), ' ' ORDER BY ts, message_id)), '[ \\t\\n\\r\\f]+'), lambda w: length(w) > 3)) AS words FROM said WHERE role = 'user' AND k <= 3 GROUP BY pulse_id),
    near AS (SELECT * FROM (SELECT ok.pulse_id, words, m.*, row_number() OVER (PARTITION BY ok.pulse_id ORDER BY m.created_ms DESC, m.memory_id DESC) AS n FROM ok JOIN topic USING (pulse_id) JOIN memories m ON m.user_id % 10 = ok.user_id AND NOT m.archived AND m.created_ms BETWEEN ok.ts - {7 * DAY_MS} AND ok.ts WHERE len(words) > 0) WHERE n <= 100),
    hit AS (SELECT *, row_number() OVER (PARTITION BY pulse_id ORDER BY created_ms DESC, memory_id DESC) AS k FROM near WHERE len(list_filter(words, lambda w: contains(lower(title || ' ' || content), w))) > 0),
    f AS (SELECT pulse_id, list(memory_id ORDER BY k) FILTER (k <= 15) AS ids, flatten(list(tags[1:2] ORDER BY k) FILTER (k <= 5)) AS tags FROM hit GROUP BY pulse_id)"""


@query("i18_pulses", sql(f"""{_PULSES} SELECT p.pulse_id, p.user_id, status, CASE WHEN status = 'ok' THEN coalesce(summary, '') END AS summary, CASE WHEN status = 'ok' THEN coalesce(array_to_string(ids, ','), '') END AS memory_ids, CASE WHEN status = 'ok' THEN coalesce(array_to_string(list_sort(list_distinct(tags)), ','), '') END AS topics
    FROM p LEFT JOIN summed USING (pulse_id) LEFT JOIN f USING (pulse_id)"""))
def i18(spark, d):
    p = _pulses(spark, d)
    found = pulse.related(p.where("status = 'ok'"), t.messages(spark, d), _own_memories(spark, d))
    ids = F.array_join(F.transform("memory_ids", lambda x: x.cast("string")), ",")
    return p.select("pulse_id", "user_id", "status").join(found.select("pulse_id", "summary", ids.alias("memory_ids"), F.array_join(F.array_sort("topics"), ",").alias("topics")), "pulse_id", "left")


@query("i18_pulse_traces", sql(f"""{_PULSES}, a AS (SELECT *, unnest([0, 1]) AS place FROM ok WHERE pulse_id % 4 <> 1)
    SELECT a.pulse_id, a.user_id, place, CASE place WHEN 0 THEN 'q' || a.pulse_id ELSE '' END AS predicted_query, '' AS predicted_context, CASE WHEN place = 1 THEN 'query' ELSE (['context', 'query', 'warning'])[a.pulse_id % 3 + 1] END AS trace_type, CASE place WHEN 0 THEN least(1, a.pulse_id % 15 / 10.0::DOUBLE) ELSE 0.5 END::DOUBLE AS confidence,
        a.ts + CASE place WHEN 0 THEN greatest(1, least(72, a.pulse_id % 100)) ELSE 24 END * {HOUR_MS} AS expires_ms, 'conversation_pulse:' || channel || CASE WHEN intent IS NOT NULL THEN ' [recall]' ELSE '' END || ': ' || CASE WHEN place = 0 AND a.pulse_id % 3 = 0 THEN 'habit' ELSE 'unknown' END AS pattern, coalesce(array_to_string(ids, ','), '') AS memory_ids FROM a LEFT JOIN f USING (pulse_id)"""))
def i18_traces(spark, d):
    p = _pulses(spark, d).where("status = 'ok'")
    found = pulse.matched(p, t.messages(spark, d), _own_memories(spark, d))
    return pulse.predicted(p, _predictions(p), found).withColumn("memory_ids", F.array_join(F.transform("memory_ids", lambda x: x.cast("string")), ","))


@query("i18_warm_memories", sql(f"{_PULSES}, w AS (SELECT user_id, arg_max(ids[1:10], (ts, pulse_id)) AS ids, max(ts) AS ts FROM ok JOIN f USING (pulse_id) GROUP BY user_id) SELECT user_id, array_to_string(ids, ',') AS memory_ids, ts + {30 * MINUTE_MS} AS expires_ms FROM w"))
def i18_warm(spark, d):
    p = _pulses(spark, d).where("status = 'ok'")
    out = pulse.kept_warm(p, t.messages(spark, d), _own_memories(spark, d))
    return out.withColumn("memory_ids", F.array_join(F.transform("memory_ids", lambda x: x.cast("string")), ","))
