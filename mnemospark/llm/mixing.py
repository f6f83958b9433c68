"""Mixing sources to target weights by Pfair scheduling.

Operator 3, DataFrame functions only.  Each source's rows, in a reproducible
order and repeated epoch after epoch, form blocks of ``block_rows`` that run across
the epochs, so that none but the mixture's last is short.  Block k of a source of
weight w is released at floor(k / w) and due at ceil((k + 1) / w), and earliest
deadline first over the released blocks fills one block slot after the other.  By
the Pfair theorem every block meets its window, so after any t slots each source
holds between w t - 1 and w t + 1 blocks.

Weights are whole multiples of 1 / UNIT.  The schedule is made span by span, all
spans at once: the counts at the start of a span follow from those of the one
before without its slots, as earliest deadline first does by the end of a span
the blocks of earliest deadlines that fit into it (unit blocks form a matroid).

No row is dropped: the schedule runs until the scarcest-supplied source has been
used in full, and sources that end sooner start again (``epoch`` 1, 2, ...).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm._shared import stored
from mnemospark.llm.rows import numbered

#: Weights are kept to a multiple of 1 / UNIT, at least one each.
UNIT = 10**9
BLOCK_ROWS = 64
#: Slots of a span, at least, and numbers (spans x sources) that say where spans start, at most.
SPAN, STATES = 1024, 1 << 20
#: Target weight of a source in the registered query: its share of rows to this power, normalised.
TEMPER = 0.7


def quotas(weights: Mapping, unit: int = UNIT) -> dict:
    """Integers >= 1 that sum to the unit, by largest remainder; ties by name."""
    total = float(sum(weights.values()))
    if not weights or total <= 0 or min(weights.values()) <= 0:
        raise ValueError("every source needs a positive target weight")
    if len(weights) > unit // 1000:
        raise ValueError("too many sources for their weights to be kept apart")
    names = sorted(weights, key=lambda s: (s is None, str(s)))
    exact = {s: weights[s] / total * unit for s in names}
    share = {s: max(1, int(exact[s])) for s in names}
    order = sorted(names, key=lambda s: (-(exact[s] - int(exact[s])), s is None, str(s)))
    spare = unit - sum(share.values())
    for s in order[: max(0, spare)]:
        share[s] += 1
    share[max(names, key=lambda s: share[s])] += unit - sum(share.values())  # what lifted or rounded shares are off by
    return share


def _after(c: np.ndarray, a: np.ndarray, unit: int, t0: int, t1: int) -> np.ndarray:
    """Blocks done by slot t1 of each source of weight a / unit, if c are done by t0."""
    low = np.maximum(c, a * t1 // unit)  # what is due by then, or done already
    left = t1 - t0 - int((low - c).sum())
    slots = np.arange(t0 + 1, t1)
    # Free slots from each slot on, when all that is due has been placed.
    free = t1 - np.arange(t0, t1)
    for j in np.flatnonzero(low > c).tolist():
        free[1:] -= np.maximum(0, low[j] - np.maximum(c[j], -(-a[j] * slots // unit)))
    free[0] = left
    low = low.copy()
    ready = np.flatnonzero(low * unit < a * t1)
    for j in ready[np.lexsort((ready, -(-(low[ready] + 1) * unit // a[ready])))].tolist():
        if not left:
            break
        r = max(0, int(low[j] * unit // a[j]) - t0)
        if free[: r + 1].min() > 0:
            free[: r + 1] -= 1
            low[j] += 1
            left -= 1
    return low


def schedule(spark: SparkSession, shares: Mapping, slots: int, span: int = SPAN) -> DataFrame:
    """(source, block, slot) of the first ``slots`` slots, by earliest deadline first; ties by name."""
    names = sorted(shares, key=lambda s: (s is None, str(s)))
    weight, unit = np.array([shares[s] for s in names], np.int64), sum(shares.values())
    if slots >= (1 << 62) // unit:
        raise ValueError("too many blocks: take larger ones")
    span = max(span, -(-slots * len(names) // STATES))
    done, starts = np.zeros(len(names), np.int64), []
    for t in range(0, slots, span):
        end = min(t + span, slots)
        starts.append({"t": t, "n": end - t, "done": done.tolist()})
        if end < slots:
            done = _after(done, weight, unit, t, end)
    read = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)
    spans = spark.range(1).select(F.explode(read(starts, "array<struct<t:bigint,n:bigint,done:array<bigint>>>")).alias("s")).select("s.*")
    spans = spans.repartition(min(len(starts), 1000), "t").withColumn("a", read(weight.tolist(), "array<bigint>")).withColumn("names", read(names, "array<string>"))

    def step(s, t):
        # The released block that is due first, as (deadline, source).  Quotients of longs are taken of exact multiples, as Spark divides doubles.
        def window(k, i):
            a = F.get(F.col("a"), i)
            over = (k + 1) * unit
            return F.when(k * unit < a * (t + 1), F.struct(F.round((over + F.pmod(-over, a)) / a).cast("long").alias("d"), i.alias("i")))

        best = F.array_min(F.filter(F.transform(s["done"], window), lambda x: x.isNotNull()))["i"]
        # A transform of one element gives the best source a name, so that it is found once a slot and not once a source.
        return F.transform(
            F.array(best),
            lambda best: F.struct(
                F.transform(s["done"], lambda k, i: F.when(i == best, k + 1).otherwise(k)).alias("done"),
                F.concat(s["out"], F.array(F.struct(best.alias("i"), F.get(s["done"], best).alias("k"), t.alias("slot")))).alias("out"),
            ),
        )[0]

    nothing = F.array().cast("array<struct<i:int,k:bigint,slot:bigint>>")
    run = F.aggregate(F.sequence(F.col("t"), F.col("t") + F.col("n") - 1), F.struct(F.col("done").alias("done"), nothing.alias("out")), step, lambda s: s["out"])
    return spans.select("names", F.explode(run).alias("x")).select(F.get("names", F.col("x.i")).alias("source"), F.col("x.k").alias("block"), F.col("x.slot").alias("slot"))


def mix(docs: DataFrame, weights: Mapping | None = None, id_col: str = "doc_id", source_col: str = "source", ties: list[str] | None = None, block_rows: int = BLOCK_ROWS, temper: float = TEMPER) -> DataFrame:
    """docs with ``block`` (number of the source's block, counted on over its epochs), ``epoch``, ``slot`` (place of the block in the mixture) and ``position`` (place of the row).

    ``weights`` maps every source present to its target; None takes the rows'
    shares to the power ``temper``.  A null source is a source of its own.  An
    empty table gives an empty result; a source without a weight is an error;
    weights of absent sources are ignored, the others then scaled.  Rows equal
    in id and ``ties`` are interchangeable.  Input columns with the names of the
    new ones are replaced.  Time to schedule grows with slots times sources: take
    larger blocks for more rows.
    """
    spark = docs.sparkSession
    docs = docs.drop("block", "epoch", "slot", "position")
    counts = {r[0]: r[1] for r in docs.groupBy(F.col(source_col).cast("string")).count().collect()}  # one row a source
    if not counts:
        z = F.lit(0).cast("long")
        return docs.select("*", z.alias("block"), z.alias("epoch"), z.alias("slot"), z.alias("position"))
    shares = quotas({s: n**temper for s, n in counts.items()} if weights is None else {s: weights[s] for s in counts})
    unit = sum(shares.values())
    blocks = {s: -(-n // block_rows) for s, n in counts.items()}
    # By then every source's last first-time block is done; the mixture ends with the last of them.
    plan = stored(schedule(spark, shares, max(-(-blocks[s] * unit // shares[s]) for s in counts)), "schedule")
    sizes = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps([{"s": s, "last": blocks[s] - 1, "size": n} for s, n in counts.items()])), "array<struct<s:string,last:bigint,size:bigint>>")).alias("z")).select("z.*")
    both = plan.join(sizes, F.col("source").eqNullSafe(F.col("s")))
    last = F.col("block") == F.col("last")
    end = both.where(last).select(F.max("slot")).first()[0] + 1
    # All blocks are full but the very last, which ends with its source's rows.
    full = both.where(F.col("slot") < end).groupBy("s", "size").agg(F.count(F.lit(1)).alias("n"), F.max(last & (F.col("slot") == end - 1)).alias("ends"))
    full = full.select("s", "size", F.when(F.col("ends"), F.col("size")).otherwise(F.col("n") * block_rows).alias("used"))

    new = {k: f"{k}-{uuid.uuid4().hex}" for k in ("row", "last", "n")}
    source = F.col(source_col).cast("string")
    rows = numbered(docs, F.col(id_col), [F.col(c) for c in ties or []], new["row"], by=source)
    r = rows.alias("r").join(F.broadcast(full).alias("p"), F.col(f"r.`{source_col}`").cast("string").eqNullSafe(F.col("p.s")))  # one row a source
    r = r.select("r.*", F.col("p.size").alias(new["n"]), F.floor((F.col("p.used") - 1 - F.col(f"r.`{new['row']}`")) / F.col("p.size")).cast("long").alias(new["last"]))
    r = r.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col(new["last"]))))
    r = r.withColumn(new["n"], F.col("epoch") * F.col(new["n"]) + F.col(new["row"])).withColumn("block", F.floor(F.col(new["n"]) / block_rows).cast("long"))
    places = plan.where(F.col("slot") < end).select(F.col("source").alias("s"), F.col("block").alias("b"), "slot")
    r = r.alias("r").join(places.alias("p"), F.col(f"r.`{source_col}`").cast("string").eqNullSafe(F.col("p.s")) & (F.col("r.block") == F.col("p.b")))
    r = r.withColumn("position", F.col("slot") * block_rows + F.col(f"r.`{new['n']}`") % block_rows)
    return r.select(*[F.col(f"r.`{c}`") for c in docs.columns], "block", "epoch", "slot", "position")


def op3(spark, sf_dir: str) -> DataFrame:
    """Every document in the mixture of sources, once for each epoch it is used in."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix(docs).select("doc_id", "source", "block", "epoch", "slot", "position")
