"""Exact joins of vectors by cosine: blocks of rows, dealt to tasks in pairs.

Rows are put into blocks of BLOCK_BYTES at most by group, length and a hash of the id.  Only
vectors of one group and one length meet.  With a threshold, blocks may also lie around
pivots: a pair of blocks is left out if the angle between their pivots less both radii
exceeds the threshold's angle (angles are a metric, so nothing in it could match).  That
is done where it makes less work: around pivots there are more and smaller blocks, and every
row goes to all that its own block meets.  All else is compared by matrix products in the task that has the pair:
neither the driver nor a task ever holds more than blocks of that size, and a strip of scores.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.operators.common import checkpoint

BLOCK_BYTES = 32 << 20
#: Blocks are made smaller, but not under this, until there are about TASKS pairs of them.
LEAST_BYTES, TASKS = 1 << 18, 64
#: Vectors that stand for the places of others, of all lengths together; so many at most are brought to the driver.
PIVOTS = 256
#: Fewer bytes of vectors do without them.
PIVOT_BYTES = 4 << 20
#: Scores at hand at once: rows of a strip, and its bytes.
STRIP, STRIP_BYTES = 512, 16 << 20
#: Estimated ns: for a byte that is shuffled, a pair of rows, a pair of blocks.
BYTE_NS, ROW_NS, BLOCK_NS = 10, 20, 1_000_000
#: What rounding of cosines to six places may add to an angle.
SLACK = 2e-3
_KEYS = ["g", "dim", "pa", "ca", "pb", "cb"]
PAIRS = "a long, b long, score double, g long"


def _rows(df: DataFrame, id_col: str, vector_col: str, group_col: str | None, facts: tuple[str, ...]) -> DataFrame:
    group = F.lit(0) if group_col is None else F.xxhash64(group_col) if dict(df.dtypes)[group_col] == "string" else F.col(group_col)
    group = group if group_col is None else F.when(F.col(group_col).isNotNull(), group)
    cols = [F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), group.cast("long").alias("g"), *[F.coalesce(F.col(f).cast("long"), F.lit(-1)).alias(f) for f in facts]]
    return df.select(*cols).where("id IS NOT NULL AND g IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL)")


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def _pivots(rows: DataFrame) -> dict[int, np.ndarray]:
    """By length, the unit vectors of the rows of least id hash."""
    found = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).select("v").collect()
    by: dict[int, list] = {}
    for r in found:
        by.setdefault(len(r.v), []).append(r.v)
    return {n: _unit(np.array(v)) for n, v in by.items()}


def _placed(rows: DataFrame, pivots: dict[int, np.ndarray], facts: tuple[str, ...]) -> DataFrame:
    """(id, g, dim, pivot, angle, u, facts): u is the unit vector's bytes; zero vectors and lengths without pivots have pivot -1 and no bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column("v")
            sizes = np.asarray(col.value_lengths())
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                x = _unit(col.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(float))
                pivot, angle = np.full(len(at), -1, np.int32), np.full(len(at), math.pi)
                if dim in pivots:
                    s = x @ pivots[dim].T
                    near = s.argmax(axis=1)
                    some = np.abs(x).any(axis=1)
                    pivot[some], angle[some] = near[some], np.arccos(np.clip(s[np.arange(len(at)), near], -1, 1))[some]
                rest = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([rest.column("id"), rest.column("g"), pa.array(np.full(len(at), dim, np.int32)), pa.array(pivot), pa.array(angle), pa.array([y.tobytes() for y in x], pa.binary()), *[rest.column(f) for f in facts]], names=["id", "g", "dim", "pivot", "angle", "u", *facts])

    return rows.mapInArrow(run, ", ".join(["id long, g long, dim int, pivot int, angle double, u binary", *[f"{f} long" for f in facts]]))


def joined(queries: DataFrame, rows: DataFrame, picked: Callable, low: float, id_col: str, vector_col: str, group_col: str | None, symmetric: bool = False, facts: tuple[str, ...] = (), trimmed: Callable | None = None) -> DataFrame:
    """(a, b, score, g) of what ``picked(scores, ids of queries, ids of rows)`` chooses (positions in the matrix) for each pair of blocks; columns of a matrix ascend by id.

    symmetric: queries and rows are the same rows: each unordered pair of rows comes once, if ids aren't repeated.
    facts: whole-number columns (null: -1) of both, which picked gets as two more arguments, arrays by name.
    trimmed: leaves, of a pair of blocks' (a, b, score, facts of a, facts of b), what is to be sent on, as positions.
    """
    # Both are gone through several times: what they come from (facts of texts, joins) isn't made anew for each.
    q = checkpoint(_rows(queries, id_col, vector_col, group_col, facts))
    r = q if symmetric else checkpoint(_rows(rows, id_col, vector_col, group_col, facts))
    n, dim, groups = r.agg(F.count(F.lit(1)), F.max(F.size("v")), F.approx_count_distinct("g")).first()
    parts = max(1, math.ceil(math.sqrt(TASKS / max(1, groups))))

    def blocks(d: DataFrame) -> DataFrame:
        n = F.count(F.lit(1))
        size = n * F.col("dim") * 8
        few = F.when(F.col("pivot") < 0, F.least(F.lit(parts), F.ceil(size / min(LEAST_BYTES, BLOCK_BYTES)))).otherwise(1)
        return d.groupBy("g", "dim", "pivot").agg(F.max("angle").alias("radius"), n.alias("n"), F.greatest(F.ceil(size / BLOCK_BYTES), few).cast("int").alias("chunks"))

    def met(pivots: dict[int, np.ndarray]) -> tuple[DataFrame, ...]:
        """Both sides, their blocks, and the pairs of blocks that must be compared."""
        qp, rp = _placed(q, pivots, facts), _placed(r, pivots, facts)
        qb, rb = blocks(qp), blocks(rp)
        x, y = qb.alias("x"), rb.alias("y")
        pairs = x.join(y, (F.col("x.g") == F.col("y.g")) & (F.col("x.dim") == F.col("y.dim")))
        pairs = pairs.select("x.g", "x.dim", F.col("x.pivot").alias("pa"), F.col("y.pivot").alias("pb"), F.col("x.chunks").alias("na"), F.col("y.chunks").alias("nb"), F.col("x.n").alias("rows_a"), F.col("y.n").alias("rows_b"), (F.col("x.radius") + F.col("y.radius")).alias("reach"))
        if pivots:
            angles = {n: np.arccos(np.clip(p @ p.T, -1, 1)) for n, p in pivots.items()}

            @F.pandas_udf("double")
            def between(dim: pd.Series, i: pd.Series, j: pd.Series) -> pd.Series:
                return pd.Series([angles[d][s, t] if s >= 0 and t >= 0 else 0.0 for d, s, t in zip(dim, i, j, strict=True)], dtype=float)

            pairs = pairs.where((F.col("pa") < 0) | (F.col("pb") < 0) | (between("dim", "pa", "pb") <= F.col("reach") + math.acos(min(1.0, low)) + SLACK))
        return qp, rp, qb, rb, pairs

    def work(pairs: DataFrame) -> float:
        a, b, na, nb = (F.col(c).cast("double") for c in ("rows_a", "rows_b", "na", "nb"))
        ns = (a * nb + b * na) * F.col("dim") * 8 * BYTE_NS + a * b * ROW_NS + na * nb * BLOCK_NS
        return pairs.agg(F.sum(ns)).first()[0] or 0.0

    plan = met({})
    if low > 0 and n and n * dim * 8 > min(BLOCK_BYTES, PIVOT_BYTES):
        around = met(_pivots(r))
        plan = min(plan, around, key=lambda p: work(p[4]))
    qp, rp, qb, rb, pairs = plan
    pairs = pairs.withColumn("ca", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).withColumn("cb", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(*_KEYS)
    if symmetric:
        pairs = pairs.where(F.struct("pa", "ca") <= F.struct("pb", "cb"))

    def chunk(d: DataFrame, of: DataFrame, p: str, c: str) -> DataFrame:
        return d.join(of.select("g", "dim", "pivot", "chunks"), ["g", "dim", "pivot"]).select("g", "dim", F.col("pivot").alias(p), F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias(c), "id", "u", *facts)

    left = chunk(qp, qb, "pa", "ca").join(pairs, ["g", "dim", "pa", "ca"])
    right = chunk(rp, rb, "pb", "cb").join(pairs, ["g", "dim", "pb", "cb"])

    def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        ids = t.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        if not len(ids):
            return ids, np.zeros((0, 1)), {f: np.zeros(0, np.int64) for f in facts}
        u = t.column("u").combine_chunks()
        u = pa.concat_arrays(u.chunks) if isinstance(u, pa.ChunkedArray) else u
        offsets = np.frombuffer(u.buffers()[1], np.int32)[u.offset : u.offset + len(u) + 1]
        x = np.frombuffer(u.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(float).reshape(len(ids), -1)
        return ids[order], x[order], {f: t.column(f).to_numpy()[order] for f in facts}

    def compare(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        g, _, p, c, other, chunk_ = (k.as_py() for k in key)
        (ids, x, fa), (others, y, fb) = matrix(a), matrix(b)
        once = symmetric and (p, c) == (other, chunk_)
        rows_, cols = [], []
        strip = max(1, min(STRIP, STRIP_BYTES // (8 * max(1, len(others)))))
        scores = []
        for i in range(0, len(ids) if len(others) else 0, strip):
            s = np.round(x[i : i + strip] @ y.T, 6) + 0.0
            more = ({f: v[i : i + strip] for f, v in fa.items()}, fb) if facts else ()
            at, to = picked(s, ids[i : i + strip], others, *more)
            if once:
                keep = ids[i + at] < others[to]
                at, to = at[keep], to[keep]
            rows_.append(i + at), cols.append(to), scores.append(s[at, to])
        if not rows_:
            return pa.table({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "score": np.zeros(0), "g": np.zeros(0, np.int64)})
        at, to, score = np.concatenate(rows_), np.concatenate(cols), np.concatenate(scores)
        if trimmed is not None:
            keep = trimmed(ids[at], others[to], score, {f: v[at] for f, v in fa.items()}, {f: v[to] for f, v in fb.items()})
            at, to, score = at[keep], to[keep], score[keep]
        return pa.table({"a": ids[at], "b": others[to], "score": score, "g": np.full(len(at), g, np.int64)})

    return left.groupBy(*_KEYS).cogroup(right.groupBy(*_KEYS)).applyInArrow(compare, PAIRS)


def nearest(s: np.ndarray, a: np.ndarray, b: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of each row's k largest scores of ``least`` or more at other ids, of equal ones those of the least column."""
    lo, hi = np.searchsorted(b, a, "left"), np.searchsorted(b, a, "right")
    for i in np.flatnonzero(hi > lo):
        s[i, lo[i] : hi[i]] = -np.inf
    m = s.shape[1]
    bound = np.full(len(s), least)
    if m > k:
        bound = np.maximum(bound, np.partition(s, m - k, axis=1)[:, m - k])
    at, to = np.nonzero((s >= bound[:, None]) & (s > -np.inf))
    order = np.lexsort((to, -s[at, to], at))
    at, to = at[order], to[order]
    place = np.arange(len(at)) - np.searchsorted(at, at, "left")
    return at[place < k], to[place < k]


def repeated(rows: DataFrame, id_col: str) -> bool:
    """Whether an id has several rows: only ids are shuffled."""
    return bool(rows.groupBy(id_col).count().where("count > 1").take(1))
