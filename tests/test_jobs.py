"""Background jobs: what SQL over the given tables doesn't show."""

import random

import pytest
from pyspark.sql import functions as F

from mnemospark.functions import scoring, tables
from mnemospark.operators import cleanup, ensembles, enrich, lifecycle, reflection, tuning

MESSAGES = "message_id long, user_id long, role string, channel string, session_key long, turn_id string, turn_index long, content string, ts long, metadata string, embedded boolean"


def polluted(spark):
    def row(i, content, channel="a", role="user", ts=None, metadata=None):
        return (i, 1, role, channel, None, None, None, content, ts or i, metadata, True)

    block = "<recalled_context>old</recalled_context>"
    return spark.createDataFrame(
        [
            row(1, f"{block}go on"), row(2, f"{block}go on"), row(3, f"{block} other ", metadata=" seen "), row(4, "plain"), row(5, f"{block}plain"),
            row(6, "<recalled_context>open", "b"), row(7, f"{block}  ", "b"), row(8, "kept", "c"), row(9, f"{block}go on", "c", "assistant"), row(10, f"{block}go on", None), row(11, "x", None),
        ],
        MESSAGES,
    )


def test_cleanup_plan(spark):
    rows = polluted(spark)
    plan = {r.message_id: r.action for r in cleanup.cleanup_plan(rows).collect()}
    assert plan == {1: "merge-delete", 2: "patch", 3: "patch", 5: "merge-delete", 6: "delete", 7: "delete", 10: "patch"}
    dry = cleanup.cleanup_plan(rows, apply=False)
    assert {r.message_id: r.action for r in dry.collect()} == {**plan, 1: "patch"}
    (found,) = cleanup.counters(dry, apply=False).collect()
    assert (found.candidates, found.would_patch, found.patched, found.would_delete, found.would_merge_delete, found.malformed) == (7, 4, 0, 2, 1, 1)
    scoped = cleanup.cleanup_plan(rows, rows.where("message_id IN (3, 8)").select("message_id"))
    assert [r.message_id for r in scoped.collect()] == [3]
    assert [r.message_id for r in cleanup.samples(cleanup.cleanup_plan(rows), rows, 2).orderBy(F.desc("ts")).collect()] == [10, 7]
    assert cleanup.cleanup_plan(rows.limit(0)).count() == 0


def test_cleanup_rewrites_what_it_touches(spark, tmp_path):
    """Partitions without planned rows keep their files; one that loses all rows is gone; null is a partition too."""
    path = str(tmp_path / "table")
    polluted(spark).write.partitionBy("channel").parquet(path)
    before = {f.name for f in (tmp_path / "table" / "channel=c").glob("*.parquet")}
    plan = cleanup.cleanup_plan(spark.read.parquet(path))
    assert set(cleanup.apply_plan(spark, path, plan, "channel", 77)) == {"a", "b", None}
    rows = {r.message_id: r for r in spark.read.schema(MESSAGES).parquet(path).collect()}
    assert sorted(rows) == [2, 3, 4, 8, 9, 10, 11]
    assert (rows[2].content, rows[3].content.strip(), rows[4].content, rows[10].content) == ("go on", "other", "plain", "go on")
    assert (rows[2].metadata, rows[3].metadata, rows[4].metadata) == ("recalled_context_cleanup:77", "seen; recalled_context_cleanup:77", None)
    assert (rows[2].embedded, rows[4].embedded) == (False, True)
    assert {f.name for f in (tmp_path / "table" / "channel=c").glob("*.parquet")} == before and not (tmp_path / "table" / "channel=b").exists()
    assert cleanup.apply_plan(spark, path, cleanup.cleanup_plan(spark.read.schema(MESSAGES).parquet(path)), "channel", 78) == []


def test_bounded_weights(spark):
    rng = random.Random(5)
    sets = [[rng.choice((0.0, 0.01, 0.1, 0.3, 2.0)) + rng.random() / 10 for _ in tuning.KEYS] for _ in range(40)]
    got = [r.w for r in spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "i long, w array<double>").select("i", tuning.bounded(F.col("w")).alias("w")).orderBy("i").collect()]
    for s, w in zip(sets, got, strict=True):
        assert w == pytest.approx(list(scoring.bounded_weights(dict(zip(tuning.KEYS, s, strict=True))).values())) and sum(w) == pytest.approx(1)


def test_empty_runs(spark):
    """Jobs over empty tables and broken answers write nothing."""
    memories = spark.createDataFrame([], "memory_id long, user_id long, store string, category string, title string, content string, channel string, archived boolean, created_ms long, last_accessed_ms long, graph_enriched boolean, strength double, confidence double, valence double, arousal double, kb_id string, tags array<string>, embedding array<double>")
    stored = spark.createDataFrame([], "ensemble_id long, user_id long, kind string, centroid array<double>, members array<long>")
    assert [d.count() for d in ensembles.ensemble_tick(memories, stored)] == [0, 0] and ensembles.consolidate(memories, 0).count() == 0
    answers = spark.createDataFrame([(1, "broken"), (2, None)], "user_id long, answer string")
    assert [d.count() for d in reflection.reflected(memories, answers, 0)] == [0, 0]
    nodes = spark.createDataFrame([], "user_id long, node_key string, label string, node_type string, description string, sources array<long>")
    relations = spark.createDataFrame([], "user_id long, from_key string, to_key string, relation string, weight double, note string, evidence array<long>, channels array<string>")
    out = enrich.enriched(memories, answers.withColumnRenamed("user_id", "memory_id"), nodes, relations, spark.createDataFrame([], "user_id long, used long"))
    assert [d.count() for d in (out.statuses, out.nodes, out.links, out.relations, out.associations)] == [0] * 5


def test_tick_dissolves_and_grows(spark):
    """A conflict group stays with one member, a cluster of two doesn't, and a free memory goes to the first ensemble that it is like."""
    def row(i, v, archived=False):
        return (i, 1, archived, i, 0.5, v)

    near = [row(i, [1.0, 0.01 * i]) for i in range(1, 4)]
    memories = spark.createDataFrame([*near, row(10, [0.0, 1.0]), row(11, [0.0, 1.0], True), row(12, [1.0, 0.0]), row(13, [-1.0, 0.0])], "memory_id long, user_id long, archived boolean, created_ms long, strength double, embedding array<double>")
    stored = spark.createDataFrame([(1, 1, "cluster", [1.0, 0.0], [1, 2, 3]), (2, 1, "conflict_group", [0.0, 1.0], [10, 11]), (3, 1, "cluster", [-1.0, 0.0], [13]), (4, 1, "cluster", [1.0, 0.1], [1, 2, 3])], "ensemble_id long, user_id long, kind string, centroid array<double>, members array<long>")
    changes, members = ensembles.ensemble_tick(memories, stored, new=3)
    assert {r.ensemble: (r.action, r.n) for r in changes.collect()} == {"1": ("updated", 4), "2": ("updated", 1), "3": ("archived", 0), "4": ("kept", 3)}
    assert {(r.ensemble, r.memory_id) for r in members.collect()} >= {("1", 12), ("2", 10)}


def test_idea_status(spark):
    rows = spark.createDataFrame([(1, "read", 1, 2, 3, None, None, 4, "pending_notification"), (2, "pending_notification", None, None, None, None, 9, 4, "dismissed"), (3, "read", 1, 2, 3, None, None, 4, "starred"), (4, "dismissed", 1, 2, 3, 4, None, 4, None)], "i long, status string, notified_ms long, emailed_ms long, read_ms long, dismissed_ms long, starred_ms long, updated_ms long, to string")
    got = {r.i: tuple(r)[1:8] for r in lifecycle.idea_status(rows, 50).collect()}
    assert got == {1: ("pending_notification", None, None, None, None, None, 50), 2: ("dismissed", 50, None, 50, 50, 9, 50), 3: ("read", 1, 2, 3, None, 50, 50), 4: ("dismissed", 1, 2, 3, 4, None, 4)}


def test_table_functions(spark):
    tables.register(spark)
    rows = spark.createDataFrame([(1, "<user>a</user>b<assistant>c"), (2, None), (3, "")], "id long, content string")
    got = spark.sql("SELECT id, s.place, s.kind, s.text FROM {r}, LATERAL sections(content) s", r=rows).collect()
    assert {tuple(r) for r in got} == {(1, 0, "user", "a"), (1, 1, "body", "b"), (1, 2, "assistant", "c")}
