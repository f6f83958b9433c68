"""Greedy picks in a given order, as if one after another: in rounds over all tasks or, where members of different keys never meet, key by key.

Each seed, in order, wants a list of members; what an earlier seed took is gone.  A seed
is decided as soon as no earlier undecided seed wants any of its members: then nothing
can change what is left for it.  Every round decides all such seeds at once.  Where lists
overlap much, most seeds wait and there are nearly as many rounds as seeds: keyed_sets and near_sets
go through a key's seeds in order instead, and different keys in different tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.operators.common import checkpoint


def greedy_sets(wants: DataFrame, least: int, most: int | None = None, marks_all: bool = False) -> DataFrame:
    """(seed, member, place): the sets that seeds take when they are gone through by (pos, seed).

    ``wants`` (seed, pos, member, place, counts): the members that a seed would take, itself
    included, ranked by place.  A seed that is itself taken is passed over.  Another looks
    at its members that aren't taken, the first ``most`` of them if given, and takes those
    with ``counts`` if they are ``least`` at least.  marks_all: all that it has looked at
    (taken or not) can't be seeds any more, also where nothing is taken.

    The number of rounds is the length of the longest chain of seeds of which each waits
    for an earlier one.
    """
    live = checkpoint(wants.select("seed", "pos", "member", "place", F.coalesce("counts", F.lit(True)).alias("counts")).where("seed IS NOT NULL AND member IS NOT NULL"))
    out = None
    order = F.struct("pos", "seed")
    while live.take(1):
        first = live.groupBy("member").agg(F.min(order).alias("first"))
        waits = live.join(first, "member").groupBy("seed").agg(F.max(F.col("first") < order).alias("waits"))
        ready = live.join(waits.where("NOT waits").select("seed"), "seed", "left_semi")
        looked = ready
        if most is not None:
            w = Window.partitionBy("seed").orderBy("place", "member")
            looked = ready.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")
        big = looked.groupBy("seed").agg(F.count_if("counts").alias("own"), F.count(F.lit(1)).alias("all")).where((F.col("own") >= least) & (F.col("all") >= least))
        looked = checkpoint(looked.join(big.select("seed", F.lit(True).alias("takes")), "seed", "left").withColumn("takes", F.coalesce("takes", F.lit(False))))
        taken = looked.where("takes AND counts").select("seed", "member", "place")
        out = taken if out is None else out.union(taken)
        gone = taken.select("member").distinct()
        passed = (looked if marks_all else taken).select(F.col("member").alias("seed")).union(ready.select("seed")).distinct()
        live = checkpoint(live.join(passed, "seed", "left_anti").join(gone, "member", "left_anti").select("seed", "pos", "member", "place", "counts"))
    return out if out is not None else wants.select("seed", "member", "place").limit(0)


def keyed_sets(wants: DataFrame, least: int) -> DataFrame:
    """(seed, member, place) as greedy_sets(wants, least) has them, for wants with a ``key`` whose seeds want no members of other keys.

    A key's rows are sorted (by Spark, so they may spill) and read once; what a task holds is one
    seed's list and the ids that are taken.
    """
    rows = wants.select(F.col("key").cast("string").alias("key"), "seed", "pos", "member", F.col("place").cast("double").alias("place"), F.coalesce("counts", F.lit(True)).alias("counts")).where("seed IS NOT NULL AND member IS NOT NULL")
    rows = rows.repartition("key").sortWithinPartitions("key", "pos", "seed", "place", "member").drop("pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, gone, mine, out = (None, None), set(), [], []

        def close() -> None:
            if at[1] is None or at[1] in gone:
                return
            look = [x for x in mine if x[0] not in gone]
            own = [x for x in look if x[2]]
            if len(own) >= least:
                out.extend((at[1], m, p) for m, p, _ in own)
                gone.update(m for m, _, _ in own)

        def made() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["seed", "member", "place"])

        for b in batches:
            for key, seed, member, place, counts in zip(*(b.column(c).to_pylist() for c in ("key", "seed", "member", "place", "counts")), strict=True):
                if (key, seed) != at:
                    close()
                    if key != at[0]:
                        gone.clear()
                    at, mine = (key, seed), []
                mine.append((member, place, counts))
            yield made()
        close()
        yield made()

    return rows.mapInArrow(run, "seed long, member long, place double")


def near_sets(rows: DataFrame, alike: float, least: int, most: int) -> DataFrame:
    """(seed, member, place): sets of the nearest, gone through by (pos, seed): what greedy_sets(..., most=most, marks_all=True) takes of lists that hold, for each seed, itself and all rows of its key with a cosine of ``alike`` or more.

    rows (key, id, v, pos, seeds, counts).  Such lists grow as the square of a key's rows and
    overlap so much that seeds wait for nearly all earlier ones; so a key's vectors (of one length)
    are held in one task, 8 bytes a number, and each seed that is still free is compared with those that aren't taken.
    """
    given = rows.select("key", F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), "pos", "seeds", "counts", F.size("v").alias("dim")).where("key IS NOT NULL AND id IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL)")

    def run(t: pa.Table) -> pa.Table:
        ids, pos = t.column("id").to_numpy(), t.column("pos").to_numpy()
        by_id = np.argsort(ids, kind="stable")
        u = t.column("v").combine_chunks()
        u = (pa.concat_arrays(u.chunks) if isinstance(u, pa.ChunkedArray) else u).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)[by_id]
        norm = np.linalg.norm(u, axis=1, keepdims=True)
        u = u / np.where(norm == 0, 1, norm)
        ids, pos = ids[by_id], pos[by_id]
        seeds, counts = (t.column(c).to_numpy(zero_copy_only=False).astype(bool)[by_id] for c in ("seeds", "counts"))
        live, passed = np.ones(len(ids), bool), ~seeds
        at, x = np.arange(len(ids)), u  # those that weren't taken when last looked
        out = []
        for i in np.lexsort((ids, pos)):
            if passed[i]:
                continue
            if 2 * live[at].sum() < len(at):
                at = at[live[at]]
                x = u[at]
            score = np.round(x @ u[i], 6) + 0.0
            near = np.flatnonzero((score >= alike) & live[at] & (at != i))
            if len(near) >= most > 1:
                near = near[score[near] >= np.partition(score[near], len(near) - most + 1)[len(near) - most + 1]]
            near = near[np.lexsort((ids[at[near]], -score[near]))][: most - 1]
            look, place = np.append(i, at[near]), np.append(-2.0, -score[near])
            own = counts[look]
            if own.sum() >= least:
                out.append((np.full(own.sum(), ids[i]), ids[look[own]], place[own]))
                live[look[own]] = False
            passed[look] = True
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"seed": cols[0], "member": cols[1], "place": cols[2]})

    return given.groupBy("key", "dim").applyInArrow(run, "seed long, member long, place double")
