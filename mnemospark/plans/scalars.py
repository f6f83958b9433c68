"""Text, time, score and JSON expressions over the tables (rows H of the survey)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.functions import jsonx as J
from mnemospark.functions import scoring as S
from mnemospark.functions import text as T
from mnemospark.functions import timeexpr as X
from mnemospark.operators import content as C
from mnemospark.operators.gates import scanned
from mnemospark.plans.filters import _THREAT, TRIM
from mnemospark.plans.oracle import sql
from mnemospark.registry import query
from mnemospark.sources import tables as t
from mnemospark.sources.tables import DAY_MS, NOW_MS

_COLLAPSED = "regexp_replace(lower(" + TRIM + r"), '[ \t\n\r\f]+', ' ', 'g')"
_HASH_TEXT = TRIM.format(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '\r\n', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n ', chr(10), 'g'), ' \n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')")


def _lit(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def docs(spark, d):
    return t.memories(spark, d)


@query("h1_normalised", sql(f"SELECT memory_id, {_COLLAPSED.format('title')} AS text FROM memories"))
def h1_1(spark, d):
    return docs(spark, d).select("memory_id", T.collapsed(F.col("title")).alias("text"))


@query("h1_tokens", sql("SELECT memory_id, array_to_string(list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda x: length(x) >= 2), ' ') AS tokens FROM memories"))
def h1_2(spark, d):
    return docs(spark, d).select("memory_id", F.array_join(T.tokens(F.col("content")), " ").alias("tokens"))


_HAY = _COLLAPSED.format("title || ' ' || content || ' ' || array_to_string(tags, ' ')")


@query("h1_text_match", sql(f"SELECT memory_id, round(greatest(contains(h, 'the er')::INT::DOUBLE, (contains(h, 'the')::INT + contains(h, 'er')::INT) / 2.0), 6)::DOUBLE AS score FROM (SELECT memory_id, {_HAY} AS h FROM memories)"))
def h1_3(spark, d):
    return docs(spark, d).select("memory_id", F.round(T.text_match("The  er", F.col("title"), F.col("content"), F.col("tags")), 6).alias("score"))


@query("h1_lexical_score", sql("SELECT message_id, round(CASE WHEN e = 0 AND h = 0 THEN 0 ELSE e + s + h / 2.0 END, 6)::DOUBLE AS score FROM (SELECT message_id, CASE WHEN contains(lower(content), 'en le') THEN 5.0 ELSE 0.0 END AS e, CASE WHEN starts_with(lower(content), 'en le') THEN 1.0 ELSE 0.0 END AS s, contains(lower(content), 'en')::INT + contains(lower(content), 'le')::INT AS h FROM messages)"))
def h1_4(spark, d):
    return t.messages(spark, d).select("message_id", F.round(T.lexical_score("`en le`", F.col("content")), 6).alias("score"))


@query("h1_unquoted", sql("SELECT trace_id, trim(predicted_query) AS q FROM (SELECT trace_id, regexp_replace(predicted_query, '[ \\t\\n\\r\\f]+', ' ', 'g') AS predicted_query FROM traces) WHERE trim(predicted_query) <> ''"))
def h1_5(spark, d):
    one = F.trim(F.regexp_replace("predicted_query", T.SPACE + "+", " "))
    return t.traces(spark, d).select("trace_id", T.without_quotes(F.concat(F.lit(' "'), one, F.lit('" '))).alias("q")).where("q != ''")


@query("h1_hash_text", sql(f"SELECT memory_id, {_HASH_TEXT} AS text FROM memories"))
def h1_6(spark, d):
    return docs(spark, d).select("memory_id", T.hash_text(F.col("content")).alias("text"))


@query("h1_hashes", sql(f"SELECT memory_id, sha256(store || chr(10) || category || chr(10) || lower({_HASH_TEXT})) AS memory_hash, sha1(content) AS full_sha1, sha1(substring(content, 1, 200)) AS head_sha1 FROM memories"))
def h1_7(spark, d):
    return docs(spark, d).select("memory_id", T.memory_hash(F.col("store"), F.col("category"), F.col("content")).alias("memory_hash"), F.sha1(F.col("content")).alias("full_sha1"), F.sha1(F.substring("content", 1, 200)).alias("head_sha1"))


@query("h1_message_hashes", sql(f"""SELECT message_id, h AS content_hash, sha256(concat_ws(chr(31), CAST(user_id AS VARCHAR), role, h, channel, CAST(session_key AS VARCHAR), CASE WHEN turn_id IS NOT NULL THEN 'turn:' || turn_id || ':' || turn_index ELSE 'session-turn:' || turn_index END)) AS scope_hash
    FROM (SELECT *, sha256(role || chr(10) || lower({_HASH_TEXT})) AS h FROM messages)"""))
def h1_7_messages(spark, d):
    from mnemospark.operators.dedupe import with_hashes

    return with_hashes(t.messages(spark, d)).select("message_id", "content_hash", "scope_hash")


_SLUG = "coalesce(nullif(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), ''), 'untitled')"


@query("h1_slug", sql(f"SELECT memory_id, 'node:' || {_SLUG.format('title')} AS slug FROM memories"))
def h1_9(spark, d):
    return docs(spark, d).select("memory_id", T.slug(F.col("title"), F.lit("node")).alias("slug"))


@query("h1_dedupe_key", sql(f"SELECT memory_id, sha256({_COLLAPSED.format('title')} || '::' || {_COLLAPSED.format('content')}) AS key FROM memories"))
def h1_10(spark, d):
    return docs(spark, d).select("memory_id", F.sha2(T.dedupe_key(F.col("title"), F.col("content")), 256).alias("key"))


@query("h1_context_stripped", sql("SELECT message_id, CASE WHEN message_id % 3 = 0 THEN content WHEN message_id % 3 = 1 THEN '' ELSE content END AS content, message_id % 3 = 1 AS malformed FROM (SELECT message_id, regexp_replace(content, '^[ \\t\\n\\r\\f]+', '') AS content FROM messages)"))
def h1_11(spark, d):
    i = F.col("message_id") % 3
    clean = F.regexp_replace("content", "^[ \t\n\r\f]+", "")
    raw = F.when(i == 0, F.concat(F.lit("<recalled_context>a <recalled_context>b</recalled_context></recalled_context>\n"), clean)).when(i == 1, F.concat(F.lit("<recalled_context> open "), clean)).otherwise(clean)
    return t.messages(spark, d).select("message_id", C.stripped(raw).alias("x")).select("message_id", "x.content", "x.malformed")


@query("h1_sections")
def h1_12(spark, d):
    raw = F.concat(F.lit("<system>be brief</system>"), F.col("content"), F.lit("<assistant>done</assistant>"))
    return t.messages(spark, d).select("message_id", F.explode(C.sections(raw)).alias("s")).select("message_id", "s.kind", "s.text")


_ONE = TRIM.format("regexp_replace(content, '[ \\t\\n\\r\\f]+', ' ', 'g')")


@query("h1_snippets", sql(f"SELECT memory_id, CASE WHEN length(s) <= 220 THEN s ELSE regexp_replace(substring(s, 1, 219), ' +$', '') || '…' END AS snippet, CASE WHEN length(content) > 160 THEN substring(content, 1, 160) || '...' ELSE content END AS cut FROM (SELECT memory_id, content, {_ONE} AS s FROM memories)"))
def h1_13(spark, d):
    return docs(spark, d).select("memory_id", T.snippet(F.col("content")).alias("snippet"), T.cut(F.col("content")).alias("cut"))


@query("h1_sentence_cut", sql("""SELECT memory_id, CASE WHEN length(content) <= 600 THEN content WHEN length(p) > length(e) THEN p WHEN e <> '' THEN e ELSE substring(content, 1, 600) END AS text FROM (SELECT *, coalesce(list_max(list_transform(list_filter(range(1, 601), lambda i: contains('.!?', substring(h, i, 1)) AND (i = length(h) OR contains(' ' || chr(9) || chr(10) || chr(12) || chr(13), substring(h, i + 1, 1)))), lambda i: i)), 0) AS fin,
    coalesce(list_max(list_filter(range(1, 600), lambda i: substring(h, i + 1, 2) = chr(10) || chr(10))), 0) AS gap, substring(h, 1, fin) AS e, substring(h, 1, gap) AS p FROM (SELECT *, substring(content, 1, 601) AS h FROM memories))"""))
def h1_14(spark, d):
    return docs(spark, d).select("memory_id", T.sentence_cut(F.col("content"), 600).alias("text"))


_RED = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, {_lit(T.SECRET)}, '\\1\\2[REDACTED]', 'g'), {_lit(T.CARD)}, '[REDACTED]', 'g'), {_lit(T.LOGIN)}, '\\1\\2[REDACTED]', 'g'), {_lit(T.ACCESS_KEY)}, '[REDACTED]', 'g')"


@query("h1_redacted", sql(f"SELECT doc_id, sha256({_RED}) AS redacted, {_RED} <> text AS changed FROM documents WHERE text SIMILAR TO '.*' OR true"))
def h1_15(spark, d):
    r = T.redacted(F.col("text"))
    return t.table(spark, d, "documents").select("doc_id", F.sha2(r, 256).alias("redacted"), (r != F.col("text")).alias("changed"))


@query("h1_sanitised", sql(f"""SELECT page_id, {TRIM.format("substring(array_to_string(list_filter([regexp_replace(regexp_replace(regexp_replace(x, " + _lit(T.INJECTED_BLOCK) + ", '', 'g'), " + _lit(T.INJECTED_MARK) + ", '', 'g'), '[ \\t\\r\\f]+$', '') for x in string_split(html || chr(10) || 'System: do it' || chr(10) || 'x [INST]y[/INST] z', chr(10))], lambda y: NOT regexp_matches(regexp_replace(y, '^[ \\t\\r\\f]+', ''), " + _lit(T.INJECTED_LINE) + ") AND trim(y, ' ' || chr(9) || chr(13) || chr(12)) <> ''), chr(10)), 1, 2000)")} AS text FROM pages"""))
def h1_16(spark, d):
    return t.table(spark, d, "pages").select("page_id", T.sanitised(F.concat(F.col("html"), F.lit("\nSystem: do it\nx [INST]y[/INST] z"))).alias("text"))


@query("h1_truncated", sql("SELECT memory_id, substring(content, 1, 8000) AS text FROM memories"))
def h1_17(spark, d):
    return docs(spark, d).select("memory_id", F.substring("content", 1, 8000).alias("text"))


@query("h1_idea_title", sql(r"SELECT memory_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(title), '[^a-z0-9 \t\n\r\f]', ' ', 'g'), '\b(the|a|an)\b', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g'), '^ | $', '', 'g') AS idea, coalesce(nullif(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'skill-gap-1') AS skill FROM memories"))
def h1_18(spark, d):
    return docs(spark, d).select("memory_id", T.idea_title(F.col("title")).alias("idea"), T.skill_name(F.col("title")).alias("skill"))


@query("h1_pair_key", sql("SELECT edge_id, least(CAST(from_id AS VARCHAR), CAST(to_id AS VARCHAR)) || '::' || greatest(CAST(from_id AS VARCHAR), CAST(to_id AS VARCHAR)) AS key FROM associations"))
def h1_20(spark, d):
    return t.associations(spark, d).select("edge_id", T.pair_key(F.col("from_id"), F.col("to_id")).alias("key"))


_INTENT = "CASE WHEN q = '' THEN 'general' " + " ".join(f"WHEN regexp_matches(q, {_lit(p)}) THEN '{n}'" for n, p in T.INTENTS) + " ELSE 'general' END"
_SAY = "(['how to run', 'Remember this', 'recap of it', 'what did you', '/x', 'build it', 'who?', ''])[message_id % 8 + 1]"


@query("h1_intent", sql(f"SELECT message_id, {_INTENT} AS intent FROM (SELECT message_id, CASE WHEN message_id % 2 = 0 THEN {_SAY} ELSE {TRIM.format('content')} END AS q FROM messages)"))
def h1_21(spark, d):
    say = t.pick(("how to run", "Remember this", "recap of it", "what did you", "/x", "build it", "who?", ""), F.col("message_id"))
    return t.messages(spark, d).select("message_id", T.intent(F.when(F.col("message_id") % 2 == 0, say).otherwise(F.col("content"))).alias("intent"))


@query("h1_confidence_label", sql("SELECT memory_id, CASE WHEN confidence >= 0.85 THEN ' [HIGH CONFIDENCE]' WHEN confidence >= 0.5 THEN '' ELSE ' [low confidence]' END AS label FROM memories"))
def h1_22(spark, d):
    return docs(spark, d).select("memory_id", T.confidence_label(F.col("confidence")).alias("label"))


@query("h1_session_key", sql("SELECT message_id, CASE message_id % 3 WHEN 0 THEN 'telegram:' || session_key WHEN 1 THEN 'agent:a:slack:channel:' || session_key ELSE 'conv' || session_key END AS key FROM messages"))
def h1_23(spark, d):
    i, s = F.col("message_id") % 3, F.col("session_key").cast("string")
    session = F.when(i == 0, F.concat(F.lit("agent:a:telegram:direct:"), s)).when(i == 1, F.concat(F.lit("agent:a:slack:channel:"), s)).otherwise("")
    return t.messages(spark, d).select("message_id", T.session_key(session, F.concat(F.lit("conv"), s)).alias("key"))


@query("h1_path_category", sql("SELECT page_id, CASE WHEN contains(p, '/lookup/') THEN 'lookup-indexes' WHEN contains(p, 'zoom-call') THEN 'zoom-calls' WHEN starts_with(p, 'memory/2026-') THEN 'daily-memory' ELSE 'other' END AS category, regexp_replace(regexp_extract(p, '([^/]*)$', 1), '\\.md$', '') AS file FROM (SELECT page_id, (['a/lookup/', 'zoom-call', 'memory/2026-', 'x/'])[page_id % 4 + 1] || page_id || '.md' AS p FROM pages)"))
def h1_24(spark, d):
    from mnemospark.sources.files import file_id, path_category

    p = F.concat(t.pick(("a/lookup/", "zoom-call", "memory/2026-", "x/"), F.col("page_id")), F.col("page_id").cast("string"), F.lit(".md"))
    return t.table(spark, d, "pages").select("page_id", path_category(p).alias("category"), file_id(p).alias("file"))


@query("h1_html_escaped", sql("SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS escaped FROM pages"))
def h1_26(spark, d):
    return t.table(spark, d, "pages").select("page_id", F.sha2(T.html_escaped(F.col("html")), 256).alias("escaped"))


@query("h1_token_estimate", sql("SELECT memory_id, CAST(ceil(length(content) / 4.0) AS BIGINT) AS tokens FROM memories"))
def h1_27(spark, d):
    return docs(spark, d).select("memory_id", T.token_estimate(F.col("content")).alias("tokens"))


@query("h1_briefing", sql("SELECT user_id, '## Briefing' || chr(10) || string_agg('- [' || store || '] ' || title, chr(10) ORDER BY strength DESC, memory_id) AS block FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY strength DESC, memory_id) AS n FROM memories WHERE NOT archived) WHERE n <= 5 GROUP BY user_id"))
def h1_28(spark, d):
    from mnemospark.operators.common import top_per

    best = top_per(docs(spark, d).where("NOT archived").select("user_id", "store", "title", "strength", "memory_id"), ["user_id"], 5, F.desc("strength"), F.asc("memory_id"))
    line = F.struct((-F.col("strength")).alias("o"), "memory_id", F.concat(F.lit("- ["), F.col("store"), F.lit("] "), F.col("title")).alias("line"))
    return best.groupBy("user_id").agg(F.array_sort(F.collect_list(line)).alias("x")).select("user_id", F.concat(F.lit("## Briefing\n"), F.array_join(F.transform("x", lambda x: x["line"]), "\n")).alias("block"))


@query("h1_skill_parts")
def h1_29(spark, d):
    doc = F.concat(F.lit("# Skill\n## Steps\n1. Run `make`\n- check "), F.col("title"), F.lit("\n## Verification\n- all green\n"))
    return docs(spark, d).where("store = 'procedural'").select("memory_id", C.skill_parts(doc).alias("p")).select("memory_id", F.to_json("p.steps").alias("steps"), "p.verification")


@query("h1_skill_document")
def h1_30(spark, d):
    return docs(spark, d).where("store = 'procedural'").select("memory_id", T.skill_document(F.concat_ws("-", "category", "channel"), F.col("title"), F.col("content")).alias("document"))


@query("h1_extracted_memory", sql(f"SELECT memory_id, substring({TRIM.format('title')}, 1, 200) AS title, substring({TRIM.format('content')}, 1, 4000) AS content FROM memories WHERE {TRIM.format('title')} <> '' AND {TRIM.format('content')} <> '' AND store IN ('semantic', 'episodic')"))
def h1_32(spark, d):
    m = docs(spark, d).where(F.col("store").isin("semantic", "episodic"))
    return m.select("memory_id", F.substring(T.trim(F.col("title")), 1, 200).alias("title"), F.substring(T.trim(F.col("content")), 1, 4000).alias("content")).where("title != '' AND content != ''")


@query("h1_procedure_text", sql("SELECT memory_id, concat_ws(chr(10) || chr(10), 'Goal: ' || category, CASE WHEN scope IS NOT NULL THEN 'Scope: ' || scope END, 'Steps: ' || store) AS text FROM memories"))
def h1_33(spark, d):
    return docs(spark, d).select("memory_id", F.concat_ws("\n\n", F.concat(F.lit("Goal: "), "category"), F.when(F.col("scope").isNotNull(), F.concat(F.lit("Scope: "), "scope")), F.concat(F.lit("Steps: "), "store")).alias("text"))


@query("h1_scanned", sql(f"SELECT memory_id, {_THREAT.replace('(x,', '(content,')} AS threat FROM memories"))
def h1_scanned(spark, d):
    return docs(spark, d).select("memory_id", scanned(F.col("content")).alias("threat"))


_NOW8 = "TIMESTAMP '2024-01-09'"


@query("h2_phrase_ranges", sql(f"""SELECT phrase, count(*) AS n FROM (SELECT make_timestamp(created_ms * 1000) AS instant FROM memories) JOIN (VALUES ('yesterday', {_NOW8} - INTERVAL 1 DAY, {_NOW8}),
    ('last week', date_trunc('week', {_NOW8}) - INTERVAL 7 DAY, date_trunc('week', {_NOW8})), ('two weeks ago', date_trunc('week', {_NOW8}) - INTERVAL 14 DAY, date_trunc('week', {_NOW8}) - INTERVAL 7 DAY),
    ('in January', TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-01'), ('2024-01-03', TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-04'), ('on Tuesday', {_NOW8}, {_NOW8} + INTERVAL 1 DAY)) p(phrase, a, b) ON instant >= a AND instant < b GROUP BY phrase"""))
def h2_1(spark, d):
    """Memories of the instants that phrases name: the phrases are scalars of the request, so they are parsed once."""
    phrases = ("yesterday", "last week", "two weeks ago", "in January", "2024-01-03", "on Tuesday")
    ranges = [(p, *r) for p in phrases if (r := X.parse_range(p, t.EPOCH_MS + 8 * DAY_MS))]
    span = F.explode(F.array(*[F.struct(F.lit(p).alias("phrase"), F.lit(a).alias("a"), F.lit(b).alias("b")) for p, a, b in ranges]))
    return docs(spark, d).select("created_ms", span.alias("s")).where("created_ms BETWEEN s.a AND s.b").groupBy(F.col("s.phrase").alias("phrase")).agg(F.count(F.lit(1)).alias("n"))


@query("h2_calendar_bounds", sql(f"SELECT memory_id, epoch_ms(date_trunc('day', make_timestamp(created_ms * 1000))) AS day, epoch_ms(date_trunc('week', make_timestamp(created_ms * 1000))) AS week, epoch_ms(date_trunc('month', make_timestamp(created_ms * 1000))) AS month, epoch_ms(date_trunc('month', make_timestamp(created_ms * 1000)) + INTERVAL 1 MONTH) - 1 AS month_end, strftime(make_timestamp(created_ms * 1000), '%Y-%m-%d') AS day_key, strftime(make_timestamp(created_ms * 1000), '%Y-%m-%d %H:%M') || ' UTC' AS minute FROM memories"))
def h2_2(spark, d):
    c = F.col("created_ms")
    return docs(spark, d).select("memory_id", X.day_start(c).alias("day"), X.week_start(c).alias("week"), X.month_start(c).alias("month"), X.month_end(c).alias("month_end"), X.day_key(c).alias("day_key"), X.minute_text(c).alias("minute"))


@query("h2_weekday_before", sql("SELECT memory_id, epoch_ms(date_trunc('day', ts)) - (CASE WHEN b = 0 THEN 7 ELSE b END) * 86400000 AS day FROM (SELECT memory_id, make_timestamp(created_ms * 1000) AS ts, (isodow(make_timestamp(created_ms * 1000)) - 1 - 1 + 7) % 7 AS b FROM memories)"))
def h2_3(spark, d):
    return docs(spark, d).select("memory_id", X.weekday_before(F.col("created_ms"), 1, False).alias("day"))


@query("h2_recency", sql("SELECT memory_id, round(exp(-0.12 * greatest(0, ($NOW - created_ms) / 86400000.0)), 6) AS freshness, round(exp(-0.08 * greatest(0, ($NOW - last_accessed_ms) / 86400000.0)), 6) AS access FROM memories"))
def h2_4(spark, d):
    return docs(spark, d).select("memory_id", F.round(X.decayed(X.age_days(NOW_MS, F.col("created_ms")), S.FRESHNESS_K), 6).alias("freshness"), F.round(X.decayed(X.age_days(NOW_MS, F.col("last_accessed_ms")), S.ACCESS_K), 6).alias("access"))


@query("h2_interval_tiers", sql("SELECT event_id, CAST(least(86400000, greatest(3600000, floor(value * 1000000 + 0.5))) AS BIGINT) AS interval_ms, greatest(1, CAST(floor(2592000000 / least(86400000, greatest(3600000, floor(value * 1000000 + 0.5)))) AS BIGINT)) AS monthly FROM events"))
def h2_7(spark, d):
    tier = X.interval_tier(F.col("value") * 1_000_000)
    return t.table(spark, d, "events").select("event_id", tier.alias("interval_ms"), X.runs_in(tier, 30).alias("monthly"))


@query("h2_ttl", sql(f"SELECT message_id, ts + (CASE WHEN user_id % 3 = 0 THEN 7 WHEN user_id % 3 = 1 THEN 30 ELSE 90 END)::BIGINT * {DAY_MS} AS expires_ms FROM messages"))
def h2_8(spark, d):
    tier = t.pick(("free", "pro", "ultra"), F.col("user_id"))
    return t.messages(spark, d).select("message_id", X.expires_at(F.col("ts"), tier, F.lit(0)).alias("expires_ms"))


_N_WORDS = "len(list_filter(regexp_split_to_array({0}, '[ \\t\\n\\r\\f]+'), lambda w: w <> ''))"
_CAT = "CASE category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.CATEGORY_BONUS.items()) + " END"
_STO = "CASE store " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.STORE_BONUS.items()) + " END"


def _salience(counted: str, matched: str) -> str:
    return f"""round(least(1.0, 0.3 + least({_N_WORDS.format(counted)} / 200.0, 0.15) + CASE WHEN regexp_matches(lower({matched}), '{S.DECISION}') THEN 0.15 ELSE 0 END + CASE WHEN regexp_matches(lower({matched}), '{S.LESSON}') THEN 0.12 ELSE 0 END
    + CASE WHEN regexp_matches(lower({matched}), '{S.GOAL}') THEN 0.12 ELSE 0 END + {_CAT} + {_STO} + least(len(regexp_extract_all(content, '\\b[A-Z][a-z]+\\b')) / 20.0, 0.08) + least(len(tags) * 0.02, 0.08)), 6)::DOUBLE"""


@query("h3_salience", sql(f"SELECT memory_id, {_salience('content', 'title || chr(32) || content')} AS stored, {_salience('title || chr(32) || content', 'title || chr(32) || content')} AS estimated FROM memories"))
def h3_4(spark, d):
    c = [F.col(x) for x in ("title", "content", "category", "store", "tags")]
    return docs(spark, d).select("memory_id", F.round(S.stored_salience(*c), 6).alias("stored"), F.round(S.estimated_salience(*c), 6).alias("estimated"))


@query("h3_procedural_penalty", sql("SELECT memory_id, CASE WHEN category = 'workflow' AND CAST(json_extract(metadata, '$.observationCount') AS DOUBLE) < 3 THEN 0.5 ELSE 1.0 END::DOUBLE AS factor FROM memories"))
def h3_6(spark, d):
    return docs(spark, d).select("memory_id", S.procedural_factor(F.col("category"), F.col("metadata")).alias("factor"))


@query("h3_linear_decay", sql("SELECT memory_id, round(least(1.0, greatest(0.0, strength - greatest(0.005, CASE WHEN abs(valence) > 0.7 AND arousal > 0.7 THEN 0.01 ELSE 0.02 END - least(access_count * 0.002, 0.01)) * ($NOW - created_ms) / 86400000.0)), 6)::DOUBLE AS strength FROM memories"))
def h3_7(spark, d):
    return docs(spark, d).select("memory_id", F.round(S.linear_decay(F.col("strength"), X.age_days(NOW_MS, F.col("created_ms")), F.col("access_count"), F.col("valence"), F.col("arousal")), 6).alias("strength"))


@query("h3_cluster_confidence", sql("SELECT memory_id, round(greatest(0.55, least(0.95, 0.55 + (access_count - 3) * 0.08 + (strength - 0.75) * 0.5)), 6)::DOUBLE AS confidence FROM memories"))
def h3_12(spark, d):
    return docs(spark, d).select("memory_id", F.round(S.cluster_confidence(F.col("access_count"), F.col("strength")), 6).alias("confidence"))


@query("h3_spend", sql("SELECT memory_id, round(ceil(length(content) / 4.0) / 1000000 * 0.1 + ceil(length(title) / 4.0) / 1000000 * 0.9, 6)::DOUBLE AS usd FROM memories"))
def h3_13(spark, d):
    return docs(spark, d).select("memory_id", S.spend(T.token_estimate(F.col("content")), T.token_estimate(F.col("title"))).alias("usd"))


@query("h3_budgets", sql("SELECT p_partkey, least(CAST(floor(p_retailprice * 10 * 0.12) AS BIGINT) * 4, 8000) AS budget, greatest(192, least(1200, CAST(floor(p_retailprice * 0.35) AS BIGINT))) AS target, greatest(96, least(640, CAST(floor(p_retailprice * 0.2) AS BIGINT))) AS aggressive FROM part"))
def h3_14(spark, d):
    return t.table(spark, d, "part").select("p_partkey", S.injection_budget(F.col("p_retailprice") * 10, F.lit(0.12)).alias("budget"), S.summary_target(F.col("p_retailprice"), "normal").alias("target"), S.summary_target(F.col("p_retailprice"), "aggressive").alias("aggressive"))


@query("h4_tolerant_json", sql("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE '{\"k\":' || k || '}' END AS json FROM event_rows"))
def h4_1(spark, d):
    i, p = F.col("event_id") % 4, F.col("props")
    raw = F.when(i == 0, p).when(i == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(i == 2, F.concat(F.lit("Here it is: "), p, F.lit(" done"))).otherwise("none")
    return t.table(spark, d, "events").select("event_id", J.tolerant_json(raw).alias("json"))


@query("h4_metadata_fields", sql("SELECT memory_id, CAST(json_extract(metadata, '$.observationCount') AS DOUBLE) AS seen, CAST(json_extract(metadata, '$.lastObserved') AS DOUBLE) AS last FROM memories"))
def h4_3(spark, d):
    return docs(spark, d).select("memory_id", J.number(F.col("metadata"), "observationCount").alias("seen"), J.number(F.col("metadata"), "lastObserved").alias("last"))


@query("h4_payload_rows", sql("SELECT event_id, i AS place, k + i AS value FROM event_rows, range(0, 3) r(i)"))
def h4_6(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    items = F.to_json(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(i.cast("long").alias("place"), (k + i).alias("value"))))
    raw = F.when(F.col("event_id") % 4 == 0, items).otherwise(F.concat(F.lit('{"memories":'), items, F.lit("}")))
    return t.table(spark, d, "events").select("event_id", F.explode(J.payload_rows(raw, "struct<place:bigint,value:bigint>")).alias("x")).select("event_id", "x.place", "x.value")


@query("h4_relation_map", sql("SELECT edge_id, CASE relation WHEN 'supports' THEN 'supports' WHEN 'contradicts' THEN 'conflicts_with' WHEN 'derives_from' THEN 'depends_on' WHEN 'co_occurred' THEN 'occurs_with' WHEN 'generalizes' THEN 'supports' WHEN 'precedes' THEN 'leads_to' END AS graph_relation FROM associations"))
def h4_9(spark, d):
    return t.associations(spark, d).select("edge_id", J.mapped(J.RELATION_OF, F.col("relation")).alias("graph_relation"))
