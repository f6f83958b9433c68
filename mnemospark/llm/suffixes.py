"""Removal of repeated passages with suffix arrays.

Operator 5.  A byte goes if some LENGTH-byte string that covers it also starts
anywhere else, in the same text or another.

1. Each string of LENGTH bytes holds an anchor: the ANCHOR-byte string of least
   hash in it (winnowing).  Equal strings have equal anchors, so an anchor's
   surroundings, up to LENGTH bytes to both sides, hold all strings that share it.
2. Anchors that occur once are dropped.  Where all of an occurrence's
   surroundings occur twice, they are repeated as they are.
3. The rest is compared within the anchor: sorting what follows and what precedes
   it shows how far each occurrence agrees with its nearest one, and the
   surroundings are cut to that; mostly nothing of LENGTH bytes is left.
4. What is left is suffix-sorted in two stages, a chunk at a time: only suffixes
   smaller than their successors are sorted directly, the others are induced by a
   scan over the buckets of first bytes, and adjacent common prefixes of LENGTH
   bytes show the repeated strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm._arrays import RollingHash, mix, slices
from mnemospark.llm._shared import stored

LENGTH = 200
ANCHOR = 80
#: Bytes that are suffix-sorted at a time (a group of one anchor is never split).
CHUNK = 1 << 18
_U = np.uint64


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over each window, by doubling."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    p, m = 1, x
    while p * 2 <= width:
        m = f(m[:-p], m[p:])
        p *= 2
    return f(m[:n], m[width - p : width - p + n])


def anchors(h: np.ndarray, width: int) -> np.ndarray:
    """All places where some window of ``width`` hashes has its least one.

    Ties all stay, so equal windows have anchors at equal places in them; in
    periodic text that is one for each period, nearly all with equal surroundings.
    """
    least = _sliding(h, width, np.minimum)
    pad = np.zeros(width - 1, _U)
    return np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), width, np.maximum) == h) if len(least) else np.zeros(0, np.int64)


def _anchor_rows(length: int, anchor: int):
    """Rows of anchors: hash of the anchor, hash of its surroundings, and place << 24 | left << 12 | size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2 = b.column("k1"), b.column("k2")
            for i, _, data, offs in slices(b.column("raw")):
                rolling, docs, found = None, [], []
                if (np.diff(offs) >= length).any():
                    rolling = RollingHash(data)
                    n = len(data) - anchor + 1
                    h = rolling.ranges(np.arange(n), np.arange(n) + anchor)
                    for d in np.flatnonzero(np.diff(offs) >= length).tolist():
                        at = anchors(h[offs[d] : offs[d + 1] - anchor + 1], length - anchor + 1)
                        found.append(at + offs[d])
                        docs.append(np.full(len(at), d))
                if not found:
                    continue
                p, d = np.concatenate(found), np.concatenate(docs)
                lo, hi = np.maximum(offs[d], p - (length - anchor)), np.minimum(offs[d + 1], p + length)
                around = mix(rolling.ranges(lo, hi) + (p - lo).astype(_U) * _U(0x9E3779B97F4A7C15))
                place = (p - offs[d]) << 24 | (p - lo) << 12 | hi - lo
                take = pa.array(d + i)
                for s in range(0, len(p), 50_000):
                    e = s + 50_000
                    yield pa.RecordBatch.from_pydict({"k1": k1.take(take[s:e]), "k2": k2.take(take[s:e]), "place": place[s:e], "ah": h[p[s:e]].view(np.int64), "sh": around[s:e].view(np.int64)})

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From texts with lists of (place, ah, c) to the bytes around each anchor."""
    for b in batches:
        for i in range(b.num_rows):
            raw = b.column("raw")[i].as_py()
            marks = b.column("marks")[i].as_py()
            lo = [(m["place"] >> 24) - (m["place"] >> 12 & 4095) for m in marks]
            around = [raw[x : x + (m["place"] & 4095)] for x, m in zip(lo, marks, strict=True)]
            n = len(marks)
            yield pa.RecordBatch.from_pydict({"ah": pa.array([m["ah"] for m in marks], pa.int64()), "k1": pa.array([b.column("k1")[i].as_py()] * n, pa.int64()), "k2": pa.array([b.column("k2")[i].as_py()] * n, pa.int64()), "lo": pa.array(lo, pa.int64()), "left": pa.array([m["place"] >> 12 & 4095 for m in marks], pa.int32()), "c": pa.array([m["c"] for m in marks], pa.int64()), "around": pa.array(around, pa.binary())})


def two_stage_suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of the bytes t in order of their first ``depth`` bytes (at least).

    Type S (smaller than its successor) is sorted directly; type L is induced.
    """
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    x = t.astype(np.int16)
    step = np.sign(np.append(x[1:], -1) - x)  # +1: S, -1: L, 0: as the successor; the empty suffix is least
    decided = np.where(step != 0, np.arange(n), n - 1)
    decided = np.minimum.accumulate(decided[::-1])[::-1]
    small = step[decided] > 0
    s = np.flatnonzero(small)
    padded = np.concatenate([t, np.zeros(depth, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, depth)
    order = []
    for c in np.unique(t[s]).tolist():  # bucket by bucket: less memory
        own = s[t[s] == c]
        order.append((c, own[np.argsort(np.ascontiguousarray(rows[own]).view(f"S{depth}").ravel(), kind="stable")]))
    directly = dict(order)
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]

    def deal(visited: np.ndarray, above: int) -> np.ndarray:
        """Put the L predecessors of visited suffixes into their buckets; returns those of the bucket ``above`` itself."""
        p = visited - 1
        p = p[p >= 0]
        p = p[~small[p]]
        c = t[p]
        own = p[c == above]
        p, c = p[c > above], c[c > above]
        if len(p):
            o = np.argsort(c, kind="stable")
            p, c = p[o], c[o]
            cuts = np.flatnonzero(np.diff(c)) + 1
            for part, first in zip(np.split(p, cuts), [0, *cuts.tolist()], strict=True):
                induced[c[first]].append(part)
        return own

    induced[t[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        visit = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        while len(visit):
            out.append(visit)
            visit = deal(visit, c)
        if c in directly:
            out.append(directly[c])
            deal(directly[c], c)
    return np.concatenate(out)


def _equal(t: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the common prefix of suffixes a and b has ``length`` bytes."""
    out = np.ones(len(a), bool)
    alive = np.arange(len(a))
    for o in range(0, length, 8):
        o = min(o, length - 8)
        same = (np.lib.stride_tricks.sliding_window_view(t, 8)[a[alive] + o] == np.lib.stride_tricks.sliding_window_view(t, 8)[b[alive] + o]).all(axis=1)
        out[alive[~same]] = False
        alive = alive[same]
        if not len(alive):
            break
    return out


def repeated_windows(t: np.ndarray, starts: np.ndarray, ends: np.ndarray, where: np.ndarray, doc: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(piece, start, end), relative to the piece, of runs of repeated windows.

    Pieces [starts, ends) of t come from ``doc`` at place ``where``; equal windows
    of one place (pieces can overlap in their text) are one occurrence.
    """
    sa = two_stage_suffix_array(t, length)
    piece = np.searchsorted(starts, sa, side="right") - 1
    ok = sa + length <= ends[piece]
    sa, piece = sa[ok], piece[ok]
    if len(sa) < 2:
        return []
    new = np.append(True, ~_equal(t, sa[:-1], sa[1:], length))
    first = np.flatnonzero(new)
    at = where[piece] + sa - starts[piece] + doc[piece] * (1 << 36)
    several = np.minimum.reduceat(at, first) != np.maximum.reduceat(at, first)
    hit = several[np.cumsum(new) - 1]
    sa, piece = sa[hit], piece[hit]
    o = np.argsort(sa)
    sa, piece = sa[o], piece[o]
    if not len(sa):
        return []
    begin = np.append(True, (np.diff(sa) != 1) | (np.diff(piece) != 0))
    b = np.flatnonzero(begin)
    e = np.append(b[1:], len(sa)) - 1
    return [(int(piece[x]), int(sa[x] - starts[piece[x]]), int(sa[y] - starts[piece[x]] + length)) for x, y in zip(b, e, strict=True)]


def _agreement(group: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Longest common prefix of each row of bytes (padded with NULs) with any other of its group, from its neighbours in sorted order.

    Rows that differ in trailing NULs only come in order of size: so no shorter one
    stands between two that agree further.  The last byte of a key is never NUL, as
    numpy's strings ignore trailing NULs.
    """
    n, width = rows.shape
    number = lambda x, kind: x.astype(kind).view(np.uint8).reshape(n, -1)
    key = np.concatenate([number(group, ">u4"), rows, number(sizes, ">u4"), np.ones((n, 1), np.uint8)], axis=1)
    o = np.argsort(np.ascontiguousarray(key).view(f"S{key.shape[1]}").ravel(), kind="stable")
    differ = rows[o[1:]] != rows[o[:-1]]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    common = np.minimum(common, np.minimum(sizes[o[1:]], sizes[o[:-1]])) * (group[o[1:]] == group[o[:-1]])
    out = np.zeros(n, np.int64)
    out[o[1:]] = common
    out[o[:-1]] = np.maximum(out[o[:-1]], common)
    return out


def _spans_of_groups(length: int):
    """Rows sorted by anchor to rows (k1, k2, a, b) of repeated runs."""

    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """rows: (ah, k1, k2, lo, left, c, bytes), whole groups."""
        n = len(rows)
        ah = np.array([r[0] for r in rows])
        group = np.cumsum(np.append(0, ah[1:] != ah[:-1]))
        left = np.array([r[4] for r in rows], np.int64)
        size = np.array([len(r[6]) for r in rows], np.int64)
        after, before = np.zeros((n, length), np.uint8), np.zeros((n, length), np.uint8)
        for i, r in enumerate(rows):
            x = np.frombuffer(r[6], np.uint8)
            y = x[r[4] :][:length]
            after[i, : len(y)] = y
            y = x[: r[4]][::-1][:length]
            before[i, : len(y)] = y
        right = _agreement(group, after, size - left)
        lead = _agreement(group, before, left)
        use = np.flatnonzero(right + lead >= length)
        if not len(use):
            return
        cut = [rows[i][6][left[i] - lead[i] : left[i] + right[i]] for i in use.tolist()]
        start = np.array([rows[i][3] for i in use.tolist()], np.int64) + left[use] - lead[use]
        ids = np.array([hash(rows[i][1:3]) for i in use.tolist()], np.int64)
        doc = np.unique(ids, return_inverse=True)[1].astype(np.int64)
        found: list[tuple[int, int, int]] = []
        # Pieces equal as they are, from several places, are repeated throughout; one of them stands for them in the sort.
        same: dict[bytes, list[int]] = {}
        for j, x in enumerate(cut):
            same.setdefault(x, []).append(j)
        alone = []
        for js in same.values():
            if len({(doc[j], start[j]) for j in js}) > 1:
                found += [(j, 0, len(cut[j])) for j in js]
            alone.append(js[0])
        if len(alone) > len(found) or len(same) > 1:
            sizes = np.array([len(cut[j]) for j in alone], np.int64)
            ends = np.cumsum(sizes)
            t = np.frombuffer(b"".join(cut[j] for j in alone), np.uint8)
            found += [(alone[p], a, b) for p, a, b in repeated_windows(t, ends - sizes, ends, start[alone], doc[alone], length)]
        yield pa.RecordBatch.from_pydict({"k1": pa.array([rows[use[j]][1] for j, _, _ in found], pa.int64()), "k2": pa.array([rows[use[j]][2] for j, _, _ in found], pa.int64()), "a": pa.array([int(start[j]) + a for j, a, _ in found], pa.int64()), "b": pa.array([int(start[j]) + b for j, _, b in found], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("ah", "k1", "k2", "lo", "left", "c", "around")), strict=True):
                if size > CHUNK and row[0] != held[-1][0]:
                    yield from solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[6])
        if held:
            yield from solve(held)

    return run


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: dict[str, list] = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for i in range(b.num_rows):
            raw = b.column("raw")[i].as_py() or b""
            kept, at, removed, spans, end = hashlib.sha256(), 0, 0, 0, -1
            for s in sorted(((s["a"], s["b"]) for s in b.column("spans")[i].as_py() or ())):
                if s[0] > end:
                    kept.update(raw[at : s[0]])
                    spans += 1
                    removed += s[1] - s[0]
                    at = end = s[1]
                elif s[1] > end:
                    removed += s[1] - end
                    at = end = s[1]
            kept.update(raw[at:])
            for k, v in zip(out, (b.column("doc_id")[i].as_py(), len(raw), removed, spans, kept.hexdigest()), strict=True):
                out[k].append(v)
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.string() if k == "kept_sha256" else pa.int64()) for k, v in out.items()})


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(k1, k2, a, b): repeated runs [a, b) of the texts with key (k1, k2), overlapping ones too.  docs: (k1, k2, raw)."""
    found = docs.where(F.length("raw") >= length).mapInArrow(_anchor_rows(length, anchor), "k1 long, k2 long, place long, ah long, sh long")
    by = Window.partitionBy("ah")
    same = Window.partitionBy("ah", "sh")
    found = found.withColumn("n", F.count(F.lit(1)).over(by)).withColumn("mixed", F.min("sh").over(by) != F.max("sh").over(by)).where("n > 1")
    found = found.withColumn("c", F.count(F.lit(1)).over(same)).withColumn("nth", F.row_number().over(same.orderBy("k1", "k2", "place")))
    hits = stored(found.where("c > 1 OR mixed").select("k1", "k2", "place", "ah", "c", "nth", "mixed"), "anchors")
    start = F.shiftright("place", 24) - F.shiftright("place", 12).bitwiseAND(F.lit(4095))
    size = F.col("place").bitwiseAND(F.lit(4095))
    whole = hits.where((F.col("c") > 1) & (size >= length)).select("k1", "k2", start.alias("a"), (start + size).alias("b"))
    # Different surroundings of one anchor, one of each kind.
    marks = hits.where("mixed AND nth = 1").groupBy("k1", "k2").agg(F.collect_list(F.struct("place", "ah", "c")).alias("marks"))  # at most a document's anchors
    cut = docs.join(marks, ["k1", "k2"]).select("k1", "k2", "raw", "marks").mapInArrow(_cut, "ah long, k1 long, k2 long, lo long, left int, c long, around binary")
    part = cut.repartition("ah").sortWithinPartitions("ah", "k1", "k2", "lo").mapInArrow(_spans_of_groups(length), "k1 long, k2 long, a long, b long")
    return whole.union(part)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row.

    A null text counts as empty; texts under ``length`` bytes keep everything; rows
    equal in id and text are occurrences of their own, so they lose everything; null
    ids are ordinary; other columns are ignored.
    """
    if not 8 <= anchor <= length or length > 2000:
        raise ValueError("anchor must be from 8 to length bytes, length at most 2000")
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), raw.alias("raw")).select(F.xxhash64("raw").alias("k1"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k2"), "doc_id", "raw")
    spans = repeated_spans(keyed.select("k1", "k2", "raw"), length, anchor)
    lists = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("spans"))  # at most a document's anchors
    return keyed.join(lists, ["k1", "k2"], "left").select("doc_id", "raw", "spans").mapInArrow(_finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op5(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
