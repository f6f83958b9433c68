"""Operators 11 to 13 against SQL, brute force and exact round trips, on odd rows too."""

import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mnemospark.llm import divergence, middle, spots

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \t ", "one", "Ünï the <P> cut", "<S", "a😀b" * 40, "\x00 nul \x00", "the of and", "x " * 3000, "the end the end"]


def odd_rows(spark, seed=1):
    """Odd texts, null ids, langs and sources, repeated rows, one hot source and a lang without kept terms."""
    rng = random.Random(seed)
    vocab = ["the", "Of", "and", "zürich", "ÉCOLE", "école", "a", "x-y", "it's"] + [f"w{chr(97 + i)}" for i in range(20)]
    texts = ODD + [" ".join(rng.choice(vocab) for _ in range(rng.choice((1, 3, 20, 60)))) for _ in range(120)]
    rows = [(i, t, rng.choice(["en", "en", "de", None]), rng.choice(["s0", "s0", "s1", None, "s2"]), None) for i, t in enumerate(texts)]
    rows += [rows[20]] * 3 + [(None, "no id here", "fr", "s1", 1), (None, "", "fr", "", 1), (7, "seven again", "en", "", 1), (-5, "the minus", "", "ö", 1)]
    return spark.createDataFrame(rows, DOCS)


def duck(rows, sql):
    c = duckdb.connect()
    c.register("documents", rows.toArrow())
    found = c.execute(sql)
    names = [x[0] for x in found.description]
    return sorted((tuple(r[names.index(n)] for n in sorted(names)) for r in found.fetchall()), key=str)


def mine(df):
    return sorted((tuple(r[n] for n in sorted(df.columns)) for r in df.collect()), key=str)


@pytest.mark.parametrize(("op", "sql"), [(divergence.op11, divergence.SQL), (middle.op12, middle.SQL)])
def test_sql(spark, sf_dir, op, sql):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = mine(op(spark, sf_dir))
    assert found == duck(docs, sql) and len(found) > 100


def test_sql_of_odd_rows(spark, tmp_path):
    rows = odd_rows(spark)
    rows.withColumn("term", F.lit(1)).withColumn("vector", F.lit("v")).withColumn("raw", F.lit("r")).write.parquet(str(tmp_path / "documents.parquet"))
    for op, sql in ((divergence.op11, divergence.SQL), (middle.op12, middle.SQL)):
        found = mine(op(spark, str(tmp_path)))
        assert found == duck(rows, sql) and found


def test_divergence_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    assert divergence.audit(none).count() == 0
    few = spark.createDataFrame([(1, "too few", "en", "a", 1), (2, None, "en", "b", 1), (3, "x", None, None, 1)], DOCS)
    assert {tuple(r) for r in divergence.audit(few).collect()} == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}


def test_divergence_weighs_large_counts(spark):
    """SCALE times a count beyond 64 bits."""
    big = 5 * 10**12
    row = spark.range(1).select(divergence._weight(F.lit(big), F.lit(7 * 10**12), F.lit(10)).alias("p")).first()
    assert row.p == 1 + 10**9 * (big + 2) // (7 * 10**12 + 20)


@pytest.mark.parametrize("held", [3, 40, 10**6])
def test_divergence_mends_pairs(held, monkeypatch):
    """Sums of pairs over batches that cut terms, handed on early or not."""
    monkeypatch.setattr(divergence, "HELD", held)
    rng = random.Random(6)
    p0 = {g: rng.randrange(1, 50) for g in range(9)}
    rows = [(lang, idx, g, rng.randrange(1, 10**9), p0[g]) for lang in (0, 1) for idx in range(30) for g in rng.sample(range(9), rng.randrange(1, 9))]
    batches = [pa.RecordBatch.from_pydict(dict(zip(("lang_no", "idx", "gid", "p", "p0"), map(list, zip(*rows[i : i + 7], strict=True)), strict=True))) for i in range(0, len(rows), 7)]
    got, want = {}, {}
    for b in divergence._mended(iter(batches)):
        for r in b.to_pylist():
            got[r["lang_no"], r["a"], r["b"]] = got.get((r["lang_no"], r["a"], r["b"]), 0) + r["value"]

    def f(p, q):
        return (p - q) ** 2 // (p + q)

    for lang, idx, g, p, p_none in rows:
        for lang2, idx2, o, q, q_none in rows:
            if (lang, idx) == (lang2, idx2) and g < o:
                want[lang, g, o] = want.get((lang, g, o), 0) + f(p, q) - f(p, q_none) - f(p_none, q) + f(p_none, q_none)
    assert got == want


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_skip_list(unit):
    rng = random.Random(3)
    for text in ["", "a", " lead", "é\n\n\nü x\n", "".join(rng.choice("ab é😀\n ") for _ in range(5000))]:
        raw = text.encode()
        s = middle.SkipList(raw, unit)
        starts = [*middle.unit_starts(raw, unit).tolist(), len(raw)]
        assert starts[0] == 0 and starts == sorted(set(starts)) and s.n == len(starts) - 1
        for rank in {0, s.n, *(rng.randint(0, s.n) for _ in range(50))}:
            at = starts[rank]
            assert s.reach(rank) == (len(raw[:at].decode()), at)
    if unit == "char":
        assert s.n == 5000 and len(s.lanes) == 4


def test_middle_round_trip(spark):
    rows = odd_rows(spark)
    for unit in ("char", "word", "line"):
        found = middle.fill_in_middle(rows, unit, seed=2).collect()
        texts = sorted((r.text or "").encode() for r in rows.collect())
        assert sorted(bytes(r.restored) for r in found) == texts
        assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert middle.fill_in_middle(rows.limit(0)).count() == 0


def brute_signatures(text):
    """From the definition, word by word; numbers as the operator's for words of equal spelling."""
    words, now = [], b""
    for c in [*text.encode(), 32]:
        inside = c >= 128 or chr(c).isalnum()
        if inside:
            now += bytes([c + 32 if 65 <= c <= 90 else c])
        elif now:
            words.append(now)
            now = b""
    common, anchors = ({x.encode() for x in s.split()} for s in (spots.COMMON, spots.ANCHORS))
    content = [w not in common for w in words]
    if not any(content):
        content = [True] * len(words)
    out = set()
    for i in range(-1, len(words)):
        if i >= 0 and words[i] not in anchors and not (content[i] and spots._hashes(words[i].decode())[0] % np.uint64(spots.RARE_ANCHOR) == 0):
            continue
        chain = [w for w, c in zip(words[i + 1 :], content[i + 1 :], strict=True) if c][: spots.CHAIN]
        if chain:
            out.add((b"^" if i < 0 else words[i], *chain))
    return out


def test_spotsigs(spark, tmp_path):
    rows = odd_rows(spark)
    rows.withColumn("fingerprint", F.lit("x")).withColumn("h", F.lit(1)).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    order = sorted(((r.doc_id, r.text or "") for r in rows.collect()), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    for bucket_rows in (1, 7, 100_000):
        out = spots.compared(spark.read.parquet(str(tmp_path / "documents.parquet")), bucket_rows).collect()
        assert len(out) == len(order)
    got = {}
    for r in spots.op13(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append(r)
    single = {i for i, _ in order if sum(j == i for j, _ in order) == 1}

    def jaccard(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    checked = 0
    for k, (i, text) in enumerate(order):
        j, following = order[(k + 1) % len(order)]
        if i not in single or j not in single:
            continue
        (r,) = got[i]
        third = len(text) // 3
        changed = text[: len(text) - third] + following[:third]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert r.near_edited == pytest.approx(jaccard(brute_signatures(text), brute_signatures(changed)))
        assert r.near_next == pytest.approx(jaccard(brute_signatures(text), brute_signatures(following)))
        checked += 1
    assert checked > 100
    assert len(got[20]) == 4 and sum(r.near_next == 1 for r in got[20]) >= 3  # repeated rows
    assert {r.doc_id: r.fingerprint for r in spots.fingerprints(rows).collect()}[15] == got[15][0].fingerprint
    (one,) = spots.compared(rows.where("doc_id = 30")).collect()
    assert one.near_next == 1 and spots.compared(rows.limit(0)).count() == 0


def test_spotsigs_order_of_corpus(spark, sf_dir):
    """Edits keep most of a fingerprint, next documents share little of it; texts that are equal have one fingerprint."""
    rows = spots.op13(spark, sf_dir).collect()
    long = [r for r in rows if r.n_chars > 200]
    assert sum(r.near_edited for r in long) / len(long) > 0.4 and sum(r.near_next for r in long) / len(long) < 0.1
    assert sum(r.near_edited > r.near_next for r in rows) > 0.95 * len(rows)


def test_near_pairs(spark):
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(300)] + ["the", "a", "is", "of"] * 20
    texts = []
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice((30, 200)))]
        for _ in range(8):
            w = list(base)
            for k in rng.sample(range(len(w)), rng.choice((0, 1, 2, 5))):
                w[k] = rng.choice(vocab)
            texts.append(" ".join(w))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    prints = spots.fingerprints(rows)
    first = {}
    for r in sorted(prints.collect()):
        first.setdefault(r.fingerprint, r.doc_id)
    sets = {i: set(spots.signs_of(f).tolist()) for f, i in first.items() if f}
    for percent in (60, 80, 100):
        want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
        assert {(r.a, r.b) for r in spots.near_pairs(prints, percent).collect()} == want and (want or percent == 100)
