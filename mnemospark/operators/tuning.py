"""Tuning of recall weights: variations of each user's policy, replayed on what was used, promoted or rejected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions.scoring import WEIGHTS
from mnemospark.operators.common import checkpoint, top_per
from mnemospark.sources.tables import DAY_MS

#: Bounds of a weight; variations a run, and their steps; newest samples; how long a run keeps others away.
LOW, HIGH, VARIATIONS, UP, DOWN, SAMPLES, INTERVAL_MS = 0.02, 0.5, 4, 1.15, 0.85, 50, DAY_MS
KEYS = tuple(WEIGHTS)


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is made once: what a lambda names from outside is made anew for each element."""
    return F.transform(F.array(value), use)[0]


def bounded(weights: Column) -> Column:
    """An array of weights scaled to a sum of 1 inside [LOW, HIGH]: the first that leaves the bounds is held there and the others share the rest, again and again; what rounding leaves goes to the first."""
    n = len(KEYS)
    none = F.array(*[F.lit(False)] * n)
    start = F.struct(weights.alias("v"), none.alias("held"), F.lit(1.0).alias("left"))

    def step(s: Column, _: Column) -> Column:
        own = F.zip_with(s["v"], s["held"], lambda x, h: F.when(h, 0.0).otherwise(F.greatest(x, F.lit(0.0))))
        return _with(own, lambda own: _with(F.aggregate(own, F.lit(0.0), lambda a, x: a + x), lambda total: _with(F.transform(own, lambda x: x / F.when(total > 0, total).otherwise(F.lit(float(n))) * s["left"]), lambda share: placed(s, share))))

    def placed(s: Column, share: Column) -> Column:
        out = F.array_position(F.zip_with(share, s["held"], lambda x, h: ~h & ((x < LOW) | (x > HIGH))), True)
        return _with(out, lambda out: held(s, share, out, F.when(F.get(share, (out - 1).cast("int")) < LOW, LOW).otherwise(HIGH)))

    def held(s: Column, share: Column, out: Column, to: Column) -> Column:
        at = lambda i: i + 1 == out
        found = out > 0
        return F.struct(
            F.when(found, F.transform(s["v"], lambda x, i: F.when(at(i), to).otherwise(x))).otherwise(F.transform(s["v"], lambda x, i: F.when(F.get(s["held"], i), x).otherwise(F.get(share, i)))).alias("v"),
            F.transform(s["held"], lambda h, i: h | (found & at(i))).alias("held"),
            F.when(found, s["left"] - to).otherwise(s["left"]).alias("left"),
        )

    v = F.aggregate(F.sequence(F.lit(0), F.lit(n)), start, step, lambda s: F.transform(s["v"], lambda x: F.greatest(F.lit(LOW), F.least(F.lit(HIGH), x))))
    rest = lambda a: F.lit(1.0) - F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return F.transform(F.array(v), lambda a: F.transform(a, lambda x, i: F.when(i == 0, F.greatest(F.lit(LOW), F.least(F.lit(HIGH), x + rest(a)))).otherwise(x)))[0]


def _draw(at: int, *parts: Column) -> Column:
    """The ``at``-th 32-bit number of a hash of the parts: draws that every run and engine repeats."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *(p.cast("string") for p in parts)), 256), 8 * at + 1, 8), 16, 10).cast("long")


def varied(policies: DataFrame, n: int = VARIATIONS) -> DataFrame:
    """(user_id, generation, candidate, weights): candidate 0 is the policy itself, 1 to n have two or three weights moved up or down, bounded again.

    policies (user_id, generation, weights in order of KEYS).  Which weights move and where to is
    drawn from user, generation and candidate.
    """
    rows = policies.select("user_id", "generation", "weights", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("candidate"))
    base = [F.col("user_id"), F.col("generation"), F.col("candidate")]
    drawn = F.array(*[_draw(0, *base, F.lit(k)) for k in KEYS])
    ups = F.array(*[_draw(1, *base, F.lit(k)) % 2 == 1 for k in KEYS])
    rows = rows.withColumn("drawn", drawn).withColumn("ups", ups).withColumn("moved", 2 + _draw(0, *base, F.lit("moved")) % 2)
    # What is drawn is hashed once a row, not for each weight.
    draws = F.struct("drawn", "ups", F.element_at(F.array_sort("drawn"), F.col("moved").cast("int")).alias("last"))
    moved = _with(draws, lambda d: F.transform("weights", lambda w, i: F.when(F.get(d["drawn"], i) <= d["last"], F.greatest(F.lit(LOW), F.least(F.lit(HIGH), w * F.when(F.get(d["ups"], i), UP).otherwise(DOWN)))).otherwise(w)))
    return rows.select("user_id", "generation", "candidate", F.when(F.col("candidate") == 0, F.col("weights")).otherwise(bounded(moved)).alias("weights"))


def replayed(variants: DataFrame, hits: DataFrame, relevant: DataFrame, k: int = 3) -> DataFrame:
    """(user_id, evaluated, scores): the mean score of each candidate, in order, over the user's logs.

    hits (log_id, user_id, memory_id, signals: array in order of KEYS), a bounded number a log;
    relevant (log_id, relevant: array of distinct ids).  Every hit is read once: its scores under all
    candidates are an array, and the k best of a log are taken from its hits for each candidate at once.  A log's score is
    the mean of the used shares of what is shown and of what was used.
    """
    sets = variants.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("candidate", "weights"))).alias("sets"))  # VARIATIONS + 1 a user
    dot = lambda w: F.round(F.aggregate(F.zip_with("signals", w, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x), 6)
    scored = hits.join(sets, "user_id").select("log_id", "user_id", "memory_id", F.transform("sets", lambda s: dot(s["weights"])).alias("scores"))
    logs = scored.groupBy("log_id", "user_id").agg(F.collect_list(F.struct("scores", "memory_id")).alias("hits"), F.max(F.size("scores")).alias("n")).join(relevant.select("log_id", "relevant"), "log_id")
    best = lambda i: F.slice(F.array_sort(F.transform("hits", lambda h: F.struct((-F.get(h["scores"], i)).alias("s"), h["memory_id"].alias("id")))), 1, k)

    def value(i: Column) -> Column:
        shown = F.transform(best(i), lambda x: x["id"])
        used = F.size(F.array_intersect(shown, F.col("relevant")))
        return F.when((F.size(shown) > 0) & (F.size("relevant") > 0), F.round((F.round(used / F.size(shown), 6) + F.round(used / F.size("relevant"), 6)) / 2, 6)).otherwise(0.0)

    each = logs.select("user_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), value)).alias("candidate", "score"))
    means = each.groupBy("user_id", "candidate").agg(F.count(F.lit(1)).alias("evaluated"), F.round(F.avg("score"), 6).alias("score"))
    return means.groupBy("user_id").agg(F.max("evaluated").alias("evaluated"), F.transform(F.array_sort(F.collect_list(F.struct("candidate", "score"))), lambda x: x["score"]).alias("scores"))


def tuned(policies: DataFrame, logs: DataFrame, hits: DataFrame, relevant: DataFrame, now_ms: int, most: int = SAMPLES, k: int = 3) -> DataFrame:
    """(user_id, candidate, generation, status, score, evaluated, weights): what a tuning run writes, for all users at once.

    policies (user_id, weights, generation, stored, locked, tuned_ms): ``stored`` says whether the
    user has a policy of their own; logs (log_id, user_id, created_ms), of which the newest ``most`` a user count; hits
    and relevant as ``replayed`` takes them.

    Users who are locked, have nothing to replay or were tuned within INTERVAL_MS get one row
    that says so (candidate null).  For the others the best variation, the first of equal ones, is
    promoted (active) if it beats the policy by more than a twentieth, or by 0.05 if that has nothing; all others are
    rejected, and so is the policy that is replaced.  New rows have the next generation.
    """
    newest = top_per(logs.select("log_id", "user_id", "created_ms"), ["user_id"], most, F.desc("created_ms"), F.desc("log_id"))
    variants = checkpoint(varied(policies.where("NOT locked")))
    scores = replayed(variants, hits.join(newest.select("log_id"), "log_id", "left_semi"), relevant, k)
    p = policies.join(scores, "user_id", "left")
    early = F.coalesce(F.lit(now_ms) - F.col("tuned_ms") < INTERVAL_MS, F.lit(False))
    skipped = F.when(F.col("locked"), "locked").when(F.col("evaluated").isNull(), "no samples").when(early, "interval")
    p = p.withColumn("skipped", skipped)
    none = p.where("skipped IS NOT NULL").select("user_id", F.lit(None).cast("int").alias("candidate"), "generation", F.col("skipped").alias("status"), F.lit(None).cast("double").alias("score"), F.lit(0).cast("long").alias("evaluated"), "weights")
    ran = p.where("skipped IS NULL").select("user_id", "stored", "scores", "evaluated", F.col("scores")[0].alias("base"), F.array_max(F.slice("scores", 2, VARIATIONS)).alias("best"))
    first = F.array_position(F.slice("scores", 2, VARIATIONS), F.col("best"))
    wins = (F.col("best") > F.col("base")) & (F.col("best") > F.when(F.col("base") <= 0, 0.05).otherwise(F.col("base") * 1.05))
    ran = ran.withColumn("won", F.when(wins, first))
    rows = variants.join(ran, "user_id")
    own = F.col("candidate") == 0
    status = F.when(own, F.when(F.col("won").isNull(), "active").otherwise("rejected")).when(F.col("candidate") == F.col("won"), "active").otherwise("rejected")
    generation = F.when(own, F.col("generation")).when(F.col("stored"), F.col("generation") + 1).otherwise(1)
    rows = rows.select("user_id", "candidate", generation.alias("generation"), status.alias("status"), F.get("scores", F.col("candidate")).alias("score"), "evaluated", "weights")
    return rows.unionByName(none)
