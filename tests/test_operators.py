"""Facts about operators that SQL can't express, against small models."""

import math
import random

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import clustering, compaction, content, context, contradictions, dedupe, gates, greedy, lifecycle, pulse, replay, search, vectorjoin, visibility
from mnemospark.operators import windows as W
from mnemospark.operators.common import latest, sifted
from mnemospark.plans import jobs
from mnemospark.sources import files, tables


@pytest.mark.parametrize(
    ("row", "request_", "seen"),
    [
        ("general", None, True), (None, None, True), (None, "general", True), (None, "coder:general", False), ("general", "general", True), ("general", "random", False), ("coder:general", "general", False), ("coder:general", "coder:general", True),
        ("general", "coder:general", True), ("random", "coder:general", False), ("coder", "coder:general", True), ("peer", "peer:111", False), ("peer:999", "peer:111", False), (None, "peer:111", False), ("general", "peer:111", False), ("peer:111", "peer:111", True), ("coder:general", "writer:general", False),
    ],
)
def test_channels(spark, row, request_, seen):
    df = spark.createDataFrame([(row, request_)], "a string, b string")
    assert df.select(visibility.channel_visible(F.col("a"), F.col("b"))).first()[0] is seen


@pytest.mark.parametrize(
    ("policy", "scope", "channel", "agents", "active", "seen"),
    [
        (None, None, "peer:123", ["peer"], True, False), (None, "123", "peer:123", ["peer"], True, True), (None, "peer:123", "peer:123", ["peer"], True, True), ("permissive", None, "peer:123", ["peer"], True, True), ("strict", None, "peer:123", ["peer"], True, False),
        (None, None, "coder:general", [], True, True), (None, None, "peer", ["peer"], True, False), ("permissive", None, "peer", ["peer"], True, True), (None, None, "general", [], True, True), (None, None, "peer:team", ["peer"], True, False),
        ("permissive", None, "peer:team", ["peer"], True, True), ("permissive", None, "peer:123", ["peer"], False, False), (None, None, visibility.MANAGEMENT, ["peer"], True, True),
    ],
)
def test_bases(spark, policy, scope, channel, agents, active, seen):
    df = spark.createDataFrame([(active, agents, scope, policy, channel)], "a boolean, g array<string>, s string, p string, c string")
    agent = F.lit("peer")
    assert df.select(visibility.base_visible(*[F.col(x) for x in "agsp"], agent, F.col("c"), ("peer",))).first()[0] is seen


def test_near_time_compares_with_kept_rows(spark):
    rows = [(i, "u", t) for i, t in enumerate([0, 4000, 8000, 20000, 3_599_000, 3_603_000, 3_607_500])]
    got = dedupe.near_time_kept(spark.createDataFrame(rows, "message_id long, k string, ts long"), ["k"])
    assert sorted(r.ts for r in got.collect()) == [0, 8000, 20000, 3_599_000, 3_607_500]


def test_rate_limit_edges(spark):
    rows = spark.createDataFrame([(i, 1, t) for i, t in enumerate([0, 10, 60_000, 60_001])], "event_id long, user_id long, ts long")
    open_ = [r.nth for r in lifecycle.fixed_window_limit(rows, 2).orderBy("event_id").collect()]
    closed = [r.nth for r in lifecycle.fixed_window_limit(rows, 2, inclusive=True).orderBy("event_id").collect()]
    assert (open_, closed) == ([1, 2, 3, 1], [1, 2, 1, 2])


def test_leaders(spark):
    rows = [(1, 0, [1.0, 0.0, 0.0]), (2, 0, [0.96, 0.04, 0.0]), (3, 0, [0.95, 0.05, 0.0]), (4, 0, [0.0, 1.0, 0.0])]
    got = clustering.leaders(spark.createDataFrame(rows, "memory_id long, u long, embedding array<double>"), "u")
    assert sorted(r.memory_id for r in got.collect()) == [1, 2, 3]


def test_replay(spark):
    s = replay.scored(spark.createDataFrame([(["a", "b"], ["b", "c", "d"]), (["a"], [])], "ranked array<string>, relevant array<string>")).collect()
    assert (s[0].grounding, round(s[0].coverage, 4), round(s[0].composite, 4)) == (0.5, 0.3333, 0.4167) and s[1].composite == 0


def test_neighbours_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "memory_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -2)
    want = {i: sorted(range(60), key=lambda j: (-s[i, j], j))[:3] for i in range(60)}
    got = {}
    for r in search.neighbours(df, df, 3).orderBy("a", F.desc("score"), "b").collect():
        got.setdefault(r.a, []).append(r.b)
    assert got == want


def test_extraction_windows(spark):
    schema = "message_id long, user_id long, channel string, session_key string, content string, ts long"
    rows = [(1, 1, "c", "s1", "x", 1000), (2, 1, "c", "s1", "y", 2000), (3, 1, "c", "s2", "z", 3000)] + [(10 + i, 2, "c", "s", "w", i) for i in range(25)]
    got = W.extraction_windows(spark.createDataFrame(rows, schema)).groupBy("user_id", "session_key", "session_no", "part_no").count().collect()
    assert sorted((r.user_id, r.session_key, r["count"]) for r in got) == [(1, "s1", 2), (1, "s2", 1), (2, "s", 1), (2, "s", 12), (2, "s", 12)]


def test_greedy_budget(spark):
    rows = spark.createDataFrame([(1, i, n, i) for i, n in enumerate([50, 60, 500, 30])], "session_key long, summary_id long, tokens long, ordinal long")
    assert sorted(r.summary_id for r in W.greedy_budget(rows, ["session_key"], 100).collect()) == [1, 3]


def test_compaction_ends_and_fits(spark):
    rng = random.Random(3)
    rows = [(s, i, rng.randint(20, 200)) for s in range(5) for i in range(40)]
    got = compaction.compacted(spark.createDataFrame(rows, "session_key long, ordinal long, tokens long"), 1500, 800, 8).collect()
    for s in range(5):
        mine = sorted((r.first, r.last, r.depth) for r in got if r.session_key == s)
        assert [x for a, b, _ in mine for x in range(a, b + 1)] == list(range(40)) and all(d == 0 for a, _, d in mine if a >= 32)


def test_content(spark):
    rows = spark.createDataFrame([("<recalled_context>a<recalled_context>b</recalled_context></recalled_context> hi",), ("<recalled_context>a",), ("hi <user>u</user><user>v</user>",), ("",), (None,)], "c string")
    got = [r[0] for r in rows.select(content.stripped(F.col("c"))).collect()]
    assert [(g.content, g.malformed) for g in got[:2]] == [("hi", False), ("", True)] and got[3].content == "" and got[4].content is None
    parts = [r[0] for r in rows.select(content.sections(F.col("c"))).collect()]
    assert [(p.kind, p.text) for p in parts[2]] == [("body", "hi"), ("user", "u\n\nv")] and parts[3] == [] and parts[4] == []


def test_transcripts_and_exports(spark, tmp_path):
    (tmp_path / "in").mkdir()
    texts = {
        "a": '{"role":"user","content":"q","sessionId":"s1"}\nnot json\n\n{"role":"assistant","content":"r"}\n',
        "b": '{"type":"user","message":{"content":[{"text":"one"},{"content":"two"},"three"]}}\n{"type":"queue-operation","operation":"enqueue","content":" queued ","session_id":"s2"}\n{"session_id":"s0"}',
        "c": '{"role":"user","content":"<command-name>x"}\n{"message":{"role":"assistant","content":[{"type":"tool_use","text":"no"},{"type":"text","text":" yes "},{"text":"and"}]}}\n' + '{"role":"user","content":"more"}\n' * 49 + "5\n",
        "d": "nothing\n{}\n",
    }
    for name, text in texts.items():
        (tmp_path / "in" / f"{name}.jsonl").write_text(text)
    ends = {r.file[-7]: tuple(r)[1:] for r in files.transcript_ends(files.read_transcripts(spark, str(tmp_path / "in"))).collect()}
    assert ends == {
        "a": ("s1", "q", "user-message", "r", "r", "complete", 2, 1),
        "b": ("s2", "queued", "queue-operation", None, None, "abandoned-before-assistant", 3, 0),
        "c": (None, "<command-name>x", "user-string-cmd", "yes \nand", None, "complete", 52, 0),
        "d": (None, None, None, None, None, "missing", 1, 1),
    }
    chunks = spark.createDataFrame([("a/lookup/x.md", 5, "t"), ("a/lookup/x.md", 1, "s"), ("MEMORY.md", 1, "m")], "path string, start_line long, content string")
    files.export_chunks(chunks, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    assert {(r.category, r.title) for r in back.collect()} == {("lookup-indexes", "x — Chunk 1/2"), ("lookup-indexes", "x — Chunk 2/2"), ("daily-memory", "MEMORY — Chunk 1/1")}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "memory_id long, embedding array<double>")
    assert search.neighbours(none, none, 3).count() == 0 and search.similar_pairs(none, none, 0.5).count() == 0
    assert search.bm25(spark.createDataFrame([], "memory_id long, content string"), "a word", 3).count() == 0


def near_rows(rng, n, dim):
    """Vectors of a few clusters, a third equal, some null, zero or of another length."""
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(12)]
    rows = []
    for i in range(n):
        c = centres[rng.randrange(12)]
        v = centres[0] if i % 3 == 0 else [x + rng.gauss(0, 0.25) for x in c]
        rows.append((i, i % 2, None if i % 97 == 5 else [0.0] * dim if i % 89 == 3 else v[: dim // 2] if i % 83 == 7 else v))
    return rows


def cosines(rows):
    def unit(v):
        n = math.sqrt(sum(x * x for x in v))
        return [x / (n or 1) for x in v]

    units = [(i, g, unit(v)) for i, g, v in rows if v]
    for i, g, v in units:
        for j, h, w in units:
            if i != j and g == h and len(v) == len(w):
                yield i, j, round(sum(a * b for a, b in zip(v, w, strict=True)), 6) + 0.0


def test_vector_joins_of_blocks(spark, monkeypatch):
    """Several blocks and pivots, pruned pairs, other lengths apart, ties by id."""
    rows = near_rows(random.Random(2), 420, 8)
    df = spark.createDataFrame(rows, "memory_id long, g long, embedding array<double>").repartition(3)
    monkeypatch.setattr(vectorjoin, "BLOCK_BYTES", 40 * 64)
    monkeypatch.setattr(vectorjoin, "PIVOTS", 24)
    every = list(cosines(rows))
    got = {(r.a, r.b): r.score for r in search.similar_pairs(df, df, 0.9, 0.995, same="g").collect()}
    sure = {(i, j) for i, j, s in every if i < j and 0.900001 <= s <= 0.994999}
    maybe = {(i, j) for i, j, s in every if i < j and 0.899999 <= s <= 0.995001}
    assert sure <= set(got) <= maybe and len(sure) > 500
    # All ties with the equal third: ids decide, and no more than k a query leave a task.
    best = {}
    for i, j, s in sorted(every, key=lambda x: (x[0], -x[2], x[1])):
        best.setdefault(i, []).append((j, s))
    near = {}
    for r in search.neighbours(df, df, 4, same="g").orderBy("a", F.desc("score"), "b").collect():
        near.setdefault(r.a, []).append((r.b, r.score))
    assert near.keys() == best.keys() and all([s for _, s in near[i]] == pytest.approx([s for _, s in best[i][:4]], abs=2e-6) for i in best)
    assert [j for j, _ in near[0]] == [j for j, _ in best[0][:4]]


def test_vectors_of_named_groups(spark):
    rows = spark.createDataFrame([(1, "u", [1.0, 0.0]), (2, "u", [1.0, 0.1]), (3, "v", [1.0, 0.0]), (4, None, [1.0, 0.0])], "memory_id long, g string, embedding array<double>")
    assert [(r.a, r.b) for r in search.similar_pairs(rows, rows, 0.5, same="g").collect()] == [(1, 2)]
    assert {(r.a, r.b) for r in search.neighbours(rows, rows, 3, same="g").collect()} == {(1, 2), (2, 1)}


def greedy_model(wants, least, most, marks_all):
    lists, order = {}, {}
    for seed, pos, member, place, counts in wants:
        lists.setdefault(seed, []).append((place, member, counts))
        order[seed] = (pos, seed)
    gone, passed, out = set(), set(), set()
    for seed in sorted(lists, key=order.get):
        if seed in passed:
            continue
        look = [(p, m, c) for p, m, c in sorted(lists[seed]) if m not in gone][:most]
        own = [(p, m) for p, m, c in look if c]
        ok = len(own) >= least and len(look) >= least
        if ok:
            out |= {(seed, m) for _, m in own}
            gone |= {m for _, m in own}
            passed |= {m for _, m in own}
        if marks_all:
            passed |= {m for _, m, _ in look}
    return out


@pytest.mark.parametrize(("least", "most", "marks_all"), [(1, None, False), (3, None, False), (2, 3, True), (3, 4, True)])
def test_greedy_rounds(spark, least, most, marks_all):
    rng = random.Random(least)
    wants = []
    for seed in range(60):
        members = {seed, *rng.sample(range(70), rng.randrange(7)), *([0] if rng.random() < 0.3 else [])}
        pos = rng.randrange(40)
        wants += [(seed, pos, m, 0 if m == seed else rng.randrange(1, 50), rng.random() < 0.8) for m in members]
    df = spark.createDataFrame(wants, "seed long, pos long, member long, place long, counts boolean")
    got = {(r.seed, r.member) for r in greedy.greedy_sets(df, least, most, marks_all).collect()}
    assert got == greedy_model(wants, least, most, marks_all) and got
    assert greedy.greedy_sets(df.limit(0), least).count() == 0


def test_contradiction_scan_ends(spark):
    """The scan ends after three failed answers or when the day's number is told; a settled pair comes back after its cooldown; other ensembles don't repeat a conflict."""
    unit = [[1.0, 0.2 * i] for i in range(8)]
    m = spark.createDataFrame([(i, i // 100, False, f"t{i}", f"text {i}", unit[i % 100]) for i in [*range(8), *range(100, 108), *range(200, 204)]], "memory_id long, user_id long, archived boolean, title string, content string, embedding array<double>")
    ens = [(e, i, 10 + i) for e, u in ((1, 0), (2, 1), (3, 2), (4, 2)) for i in (range(8) if u == 0 else range(100, 108) if u == 1 else range(200, 204))]
    members = spark.createDataFrame(ens, "ensemble_id long, memory_id long, joined_ms long")
    changed = spark.createDataFrame([(1, 0, 50), (2, 1, 50), (3, 2, 50), (4, 2, 60)], "ensemble_id long, user_id long, updated_ms long")
    now = 100 * contradictions.DAY_MS
    conflicts = spark.createDataFrame([(2, '{"pairKey":"200::201","status":"unresolved"}', 0), (2, '{"pairKey":"200::202","status":"resolved","resolvedAt":%d}' % (now - 1), 0), (2, '{"pairKey":"200::203","status":"resolved"}', 0), (2, "no json", 0)], "user_id long, metadata string, updated_ms long")
    fired = spark.createDataFrame([(1, 1)], "user_id long, fired long")
    answer = F.when(F.col("user_id") == 0, F.lit(None)).when(F.col("user_id") == 1, F.lit('[{"score":0.7,"explanation":"x","conflictType":"factual"}]')).otherwise(F.lit('{"score":0.9,"conflictType":7}'))
    got = contradictions.scan(m, members, changed, conflicts, fired, lambda p: p.withColumn("answer", answer), 0, now, budget=10, low=0.0, high=1.0).orderBy("user_id", "nth").collect()
    told = {u: [(r.nth, r.outcome) for r in got if r.user_id == u] for u in (0, 1, 2)}
    assert told[0] == [(1, "failed"), (2, "failed"), (3, "failed")] and told[1] == [(1, "trace"), (2, "trace")]
    assert told[2] == [(1, "conflict"), (2, "conflict"), (3, "conflict")] and [r.pair_key for r in got if r.user_id == 2] == ["200::203", "201::202", "201::203"]
    assert {r.context.split("\n")[0] for r in got if r.user_id == 1} == {"**Contradiction detected** (factual, score: 0.70)"}


def test_blocks_of_unlike_vectors_are_few(spark, monkeypatch):
    """Where pivots exclude nothing, rows don't go to hundreds of blocks."""
    rng = random.Random(5)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(1500)], "memory_id long, embedding array<double>")
    monkeypatch.setattr(vectorjoin, "BLOCK_BYTES", 40_000)
    calls = spark.sparkContext.accumulator(0)

    def picked(s, a, b):
        calls.add(1)
        return (s >= 0.5).nonzero()

    n = vectorjoin.joined(df, df, picked, 0.5, "memory_id", "embedding", None, symmetric=True).count()
    assert n > 1500 and calls.value < 300


def test_gated_pairs_are_those_of_their_texts(spark):
    from mnemospark.operators import capture, gates

    rng = random.Random(6)
    texts = ["costs $5 now", "costs $6 now", "5 and 6", "6 and 5", "on 2024-01-02", "never", "plain", "", None, "not 7", "7"]
    df = spark.createDataFrame([(i, i % 3, rng.choice(texts), [rng.gauss(0, 1) for _ in range(4)]) for i in range(120)], "memory_id long, g long, content string, embedding array<double>")
    known = gates.fact_ids(df, "memory_id", F.col("content"))
    got = sorted(tuple(r) for r in contradictions.gated_pairs(df.select("memory_id", "g", "embedding").join(known, "memory_id"), 0.6, 0.8, 0.1, "g").select("a", "b", "score").collect())
    text = {p: df.select(F.col("memory_id").alias(p), F.col("content").alias(f"{p}_text")) for p in "ab"}
    every = search.similar_pairs(df, df, 0.1, same="g").join(text["a"], "a").join(text["b"], "b")
    want = every.where(capture.worth_checking(F.col("score"), gates.facts_differ(F.col("a_text"), F.col("b_text")), 0.6, 0.8, 0.1)).select("a", "b", "score")
    assert got == sorted(tuple(r) for r in want.collect()) and len(got) > 100


def test_sets_key_by_key(spark):
    """Sets of each key as if its seeds were gone through alone, also of lists that all overlap."""
    rng = random.Random(8)
    vectors = {i: [rng.gauss(0, 1) for _ in range(4)] for i in range(90)}
    key, pos, counts = {i: i % 3 for i in vectors}, {i: rng.randrange(20) for i in vectors}, {i: rng.random() < 0.8 for i in vectors}
    seeds = {i for i in vectors if counts[i] and rng.random() < 0.8}
    every = [(i, j, s) for i, j, s in cosines([(i, key[i], v) for i, v in vectors.items()]) if s >= 0.1]
    wants = [(i, pos[i], j, -s, counts[j]) for i, j, s in every if i in seeds] + [(i, pos[i], i, -2.0, True) for i in seeds]
    rows = spark.createDataFrame([(key[i], i, v, pos[i], i in seeds, counts[i]) for i, v in vectors.items()], "key long, id long, v array<double>, pos long, seeds boolean, counts boolean")
    for least, most in ((2, 5), (3, 9)):
        want = set().union(*(greedy_model([w for w in wants if key[w[0]] == k], least, most, True) for k in range(3)))
        assert {(r.seed, r.member) for r in greedy.near_sets(rows, 0.1, least, most).collect()} == want and want
    df = spark.createDataFrame([(key[w[0]], *w) for w in wants], "key long, seed long, pos long, member long, place double, counts boolean")
    want = set().union(*(greedy_model([w for w in wants if key[w[0]] == k], 3, None, False) for k in range(3)))
    assert {(r.seed, r.member) for r in greedy.keyed_sets(df, 3).collect()} == want and want
    assert greedy.keyed_sets(df.limit(0), 1).count() == 0 and greedy.near_sets(rows.limit(0), 0.1, 2, 9).count() == 0


def test_sifted(spark):
    """All rows that are asked for stay, and nearly all others go, without a shuffle of the rows."""
    rows = spark.range(20000).withColumnRenamed("id", "k").withColumn("text", F.lit("x"))
    ids = spark.range(0, 20000, 50)
    got = sifted(rows, "k", ids)
    kept = {r.k for r in got.collect()}
    assert kept >= set(range(0, 20000, 50)) and len(kept) < 450 and got.columns == ["k", "text"]
    assert sifted(rows, "k", ids.limit(0)).count() == 0


def test_vectors_leave_other_texts_alone(spark, sf_dir):
    """Without a broadcast of either side, only texts of memories that can have a vector are shuffled, also under a semi-join's worth of ids."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        m = jobs.with_vectors(spark, sf_dir)
        plan = m.select("memory_id", "content")._jdf.queryExecution().executedPlan().toString()
        assert "getbit" in plan and m.count() == tables.vectors(spark, sf_dir).join(tables.memories(spark, sf_dir), "memory_id").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_facts_are_found_once(spark):
    rows = spark.createDataFrame([(1, "it costs $5"), (2, "not here"), (3, "so it costs $5")], "i long, t string")
    ids = gates.fact_ids(rows, "i", F.col("t"))
    assert "regexp_extract_all" not in ids._jdf.queryExecution().optimizedPlan().toString()
    assert {r.i: (r.amounts, r.negated) for r in ids.collect()} == {1: (1, 0), 2: (None, 1), 3: (1, 0)}


def test_latest(spark):
    """The last rows up to each mark: brute force, with ties, gaps, keys without rows and buckets of few rows."""
    rng = random.Random(8)
    rows = [(i, rng.choice((1, 1, 1, 2, None)), rng.choice((None, *range(-5, 60))), f"t{i}") for i in range(300)]
    marks = [(i, rng.choice((1, 2, 3, None)), rng.choice((None, *range(-9, 70)))) for i in range(80)]
    r, m = spark.createDataFrame(rows, "id long, k long, ts long, t string"), spark.createDataFrame(marks, "mark long, k long, at long")
    for most in (1, 3, 20):
        want = set()
        for mark, k, at in marks:
            old = sorted(((ts, i, t) for i, key, ts, t in rows if None not in (k, at, ts) and key == k and ts <= at), reverse=True)[:most]
            want |= {(mark, at, i, ts, t, n) for n, (ts, i, t) in enumerate(old, 1)}
        got = [tuple(x) for x in latest(m, r, "k", most, "mark", "at", "ts", "id", ("t",), bucket=7).select("mark", "at", "id", "ts", "t", "place").collect()]
        assert len(got) == len(want) and set(got) == want


def test_pulses_in_rounds(spark):
    """More than RELATED memories count, also where the first FIRST have none; what is kept warm comes from the last pulse with a match, however many pulses follow it."""
    hour = 3_600_000
    ts = 10 * 24 * hour
    pulses = spark.createDataFrame([(1, 1, 1, ts), *[(10 + i, 1, 2, ts + 1 + i) for i in range(20)], (50, 2, 3, ts)], "pulse_id long, user_id long, session_key long, ts long")
    messages = spark.createDataFrame([(1, 1, "user", "about apples", ts), (2, 2, "user", "nothing here", ts), (3, 3, "user", "so", ts)], "message_id long, session_key long, role string, content string, ts long")
    memories = spark.createDataFrame([(i, 1, i == 3, ts - i * 60_000, f"t{i}", "pineapples" if i == 2 or i >= 60 else "pears", ["a", f"b{i}"]) for i in range(120)], "memory_id long, user_id long, archived boolean, created_ms long, title string, content string, tags array<string>")
    found = {r.pulse_id: r for r in pulse.related(pulses, messages, memories).collect()}
    assert found[1].memory_ids == [2, *range(60, 74)] and found[1].topics == ["a", "b2", "b60", "b61", "b62", "b63"] and found[1].summary == "user: about apples"
    assert len(found) == 22 and found[50].memory_ids == [] and found[10].memory_ids == []
    assert [tuple(r) for r in pulse.kept_warm(pulses, messages, memories).collect()] == [(1, [2, *range(60, 69)], ts + pulse.WARM_MS)]


def test_context_takes_blocks(spark):
    """Of hits only their blocks go with a prompt, not their texts."""
    p = spark.createDataFrame([(1, 1, 1, "recall the plan", True, False, 20000, 0.1)], "prompt_id long, session_key long, user_id long, prompt string, first boolean, cron boolean, effective_tokens long, share double")
    none = {"briefings": "session_key long, briefing string", "ideas": "user_id long, rank long, idea_id long, title string, summary string, confidence double, sources long", "said": "prompt_id long, rank long, role string, content string, ts long"}
    briefings, ideas, said = (spark.createDataFrame([], c) for c in none.values())
    hits = spark.createDataFrame([(1, 2, 7, "semantic", "SECOND", None, 1), (1, 1, 8, "semantic", "FIRST", None, 1), (1, 3, 9, "semantic", "THIRD", None, 1)], "prompt_id long, rank long, memory_id long, store string, block string, kb_id string, continuity long")
    (got,) = context.built(p, "pre", "tools", briefings, ideas, hits, said, said, hits.limit(0)).collect()
    assert "FIRST\nSECOND\n" in got.text and "THIRD" not in got.text and got.labels == "Preamble|Preamble|Relevant Recall"
