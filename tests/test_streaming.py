"""A stream that has run over all files equals the batch operator."""

import datetime
import os
import random

from pyspark.sql import functions as F

from mnemospark.operators import assistant, lifecycle
from mnemospark.streaming import assistant as streams
from mnemospark.streaming import events as E


def folder(spark, tmp_path, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")).orderBy("ts", "event_id")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    return rows, str(tmp_path / "in")


def test_rate_limit_equals_batch(spark, tmp_path, sf_dir):
    rows, path = folder(spark, tmp_path, sf_dir)
    assert E.written(E.rate_limited(E.read_events(spark, path), 3, 6 * 3_600_000), str(tmp_path / "out"), str(tmp_path / "ck"), seconds=120)
    got = {(r.event_id, r.nth, r.allowed) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = lifecycle.fixed_window_limit(rows.select("event_id", "user_id", F.unix_millis("ts").alias("ts")), 3, 6 * 3_600_000)
    assert got == {(r.event_id, r.nth, r.allowed) for r in batch.collect()} and got


def test_dedupe(spark, tmp_path, sf_dir):
    rows, path = folder(spark, tmp_path, sf_dir)
    assert E.written(E.deduplicated(E.read_events(spark, path), ["user_id", "event_type"], band="30 days"), str(tmp_path / "out"), str(tmp_path / "ck"), seconds=120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows.select("user_id", "event_type").distinct().count()


def in_files(spark, tmp_path, rows, schema, parts, last):
    """Rows in order of ts, some to a file, and a last file whose rows carry the watermark past all timers; the file's time is its order."""
    every = [*(rows[i : i + parts] for i in range(0, len(rows), parts)), last]
    for i, part in enumerate(every):
        one = tmp_path / f"one{i}"
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(one))
        (tmp_path / "in").mkdir(exist_ok=True)
        (file,) = one.glob("*.parquet")
        to = tmp_path / "in" / f"{i:04d}.parquet"
        file.rename(to)
        os.utime(to, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def at(ms):
    return datetime.datetime.fromtimestamp(ms / 1000, datetime.UTC)


def stalls_model(rows):
    """By the minute-free definition, event by event, for one session after another."""
    out = set()
    for key in {k for k, _, _ in rows}:
        since, pending, full, told, last = None, 0, None, None, None
        for _, kind, t in [*sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1] != "done")), (key, "end", None)]:
            end = last + assistant.IDLE_MS if t is None and last is not None else t
            if since is not None and pending > 3:
                e = max(full, since + 600_001)
                while True:
                    e = e if told is None else max(e, told + 3_600_001)
                    if e >= end:
                        break
                    out.add((key, e, pending))
                    told = e
            if kind == "done":
                since, pending, full = t, 0, None
            elif kind == "got":
                since = t if since is None else since
                pending += 1
                full = t if pending == 4 else full
            last = t
    return out


def test_stalls_equal_batch(spark, tmp_path):
    """Told by timers, also after a session's last event, and state is dropped when it has been idle."""
    rng = random.Random(7)
    rows, t = [], 1_700_000_000_000
    for _ in range(400):
        t += rng.choice((1, 20_000, 60_000, 200_000, 900_000))
        rows.append((rng.randrange(5), "done" if rng.random() < 0.12 else "got", t))
    want = stalls_model(rows)
    batch = assistant.stalls(spark.createDataFrame(rows, "session_key long, event_type string, ts long"), "got", "done")
    assert {tuple(r) for r in batch.collect()} == want and len(want) > 30 and max(w[1] for w in want) > t
    streams.with_state(spark)
    source = in_files(spark, tmp_path, [(k, e, at(x)) for k, e, x in rows], "session_key long, event_type string, ts timestamp", 57, [(99, "got", at(t + 4 * assistant.IDLE_MS))])
    assert E.written(streams.stalls(source, "got", "done"), str(tmp_path / "out"), str(tmp_path / "ck"), seconds=200)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_repeated_turns_equal_batch(spark, tmp_path):
    """Renewed entries, prefixes, trimmed texts, expiry and eviction."""
    rng = random.Random(8)
    base = "x" * 220
    texts = ["a", " a ", "b", base, base + " tail", base[:199], "", None, *(f"t{i}" for i in range(600))]
    rows, t = [], 1_700_000_000_000
    for i in range(1500):
        t += rng.choice((10, 1000, 60_000, 1_200_000)) if rng.random() < 0.995 else 9_000_000
        rows.append((i, rng.choice((1, 1, 1, 2)), rng.choice(texts[:8]) if rng.random() < 0.3 else rng.choice(texts), t))
    burst = [(2000 + i, 3, f"t{i % 700}", t + i) for i in range(1400)]  # 700 texts in turn: with 500 hashes none is still known
    rows += [*burst, (4000, 3, "t699", t + 2000), (4001, 3, "t0", t + 2001)]
    t += 3000

    def model():
        out, caches = {}, {}
        for i, k, text, now in rows:
            s = (text or "").strip(" \t\n\r\f")
            full, pre = s, ("p", s[:200])
            cache = [(h, u) for h, u in caches.get(k, []) if now - u <= 7_200_000]
            hit = next((h for h in (full, pre) if h in [x for x, _ in cache]), None)
            add = [hit] if hit is not None else [full, pre]
            caches[k] = ([x for x in cache if x[0] not in add] + [(h, now) for h in add])[-500:]
            out[i] = hit is not None
        return out

    want = model()
    frame = spark.createDataFrame(rows, "message_id long, session_key long, content string, ts long")
    assert {r.message_id: r.repeated for r in assistant.repeated_turns(frame).collect()} == want
    assert 100 < sum(want.values()) < len(want) and not any(want[2000 + i] for i in range(1400)) and want[4000]
    streams.with_state(spark)
    source = in_files(spark, tmp_path, [(i, k, x, at(u)) for i, k, x, u in rows], "message_id long, session_key long, content string, ts timestamp", 700, [(9999, 99, "z", at(t + 10**8))])
    assert E.written(streams.repeated_turns(source), str(tmp_path / "out"), str(tmp_path / "ck"), seconds=200)
    got = {r.message_id: r.repeated for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {k: v for k, v in got.items() if k != 9999} == want
    lone = spark.createDataFrame([(1, None, "a", 1), (2, None, "a", 2)], "message_id long, session_key long, content string, ts long")
    assert [r.repeated for r in assistant.repeated_turns(lone).collect()] == [False, False]
