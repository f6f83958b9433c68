"""Ensembles of memories, and consolidation of sensory ones: clusters that are found, kept and dissolved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.functions import vectors as V
from mnemospark.operators.clustering import mean_vectors
from mnemospark.operators.common import best_per, checkpoint
from mnemospark.operators.greedy import keyed_sets, near_sets
from mnemospark.operators.search import neighbours, similar_pairs
from mnemospark.sources.tables import HOUR_MS

#: What alike, drifted, new and kept clusters are, and how many neighbours are looked at.
ALIKE, DRIFT, NEW, KEPT, NEAR, GROWTH = 0.85, 0.75, 5, 3, 20, 10
#: How titles and texts of consolidated memories begin.
EPISODIC, SEMANTIC, SOURCES = "Episodic cluster: ", "Semantic: ", "Source cluster summary ("


def _with_centroid(members: DataFrame, key: str) -> DataFrame:
    """(key, n, centroid, strength, confidence) of rows (key, embedding, strength): means, and the mean cosine to the centroid."""
    centre = mean_vectors(members, key).select(key, "centroid")
    return members.join(centre, key).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.first("centroid").alias("centroid"), F.round(F.avg("strength"), 6).alias("strength"), F.round(F.avg(V.cosine(F.col("embedding"), F.col("centroid"))), 6).alias("confidence"))


def ensemble_tick(memories: DataFrame, stored: DataFrame, alike: float = ALIKE, drift: float = DRIFT, new: int = NEW, keep: int = KEPT, near: int = NEAR, growth: int = GROWTH) -> tuple[DataFrame, DataFrame]:
    """One tick over the ensembles of all users: (changes, members).

    memories (memory_id, user_id, archived, created_ms, strength, embedding); stored
    (ensemble_id, user_id, kind, centroid, members: array of ids), the ensembles that aren't archived.

    First, memories without ensemble seed new ones, the latest first: a seed and those of
    its ``near`` - 1 nearest memories that lie over ``alike``, without those that are
    in an ensemble by then and archived ones, if ``new`` are left.  Then every ensemble,
    stored ones in order of id before new ones in order of their making, loses members under
    ``drift`` from its centroid, is archived when fewer than ``keep`` are left (conflict
    groups never), and gains those of the ``growth`` memories nearest to its centroid that
    lie over ``alike`` and are in no ensemble at its turn.  All seeds and members count:
    nothing is deferred to a next run.

    changes (ensemble, user_id, action, n, centroid, strength, confidence): ensemble is the stored id
    or "new:" and the seed's; action is created, updated, archived or kept; members
    (ensemble, memory_id) are those of ensembles that go on.
    """
    m = memories.select("memory_id", "user_id", "archived", "created_ms", "strength", "embedding").where("size(embedding) > 0")
    old = stored.select(F.col("ensemble_id").cast("string").alias("ensemble"), "user_id", "kind", "centroid", F.explode_outer("members").alias("memory_id"), F.struct(F.lit(0).alias("kind_no"), F.lit(0).cast("long").alias("pos"), F.col("ensemble_id").alias("no")).alias("turn"))
    clustered = old.where("memory_id IS NOT NULL").select("user_id", "memory_id").distinct()

    # new clusters
    seeds = m.where("NOT archived").join(clustered, ["user_id", "memory_id"], "left_anti")
    close = checkpoint(neighbours(seeds, m, near - 1, same="user_id").where(F.col("score") > alike))
    wants = close.select(F.col("a").alias("seed"), F.col("b").alias("member"), "score").union(seeds.select(F.col("memory_id").alias("seed"), F.col("memory_id").alias("member"), F.lit(2.0).alias("score")))
    # Only seeds with enough neighbours, archived and clustered ones included, are looked at.
    size = Window.partitionBy("seed")
    wants = wants.withColumn("n", F.count(F.lit(1)).over(size)).where(F.col("n") >= new)
    free = m.join(clustered.withColumn("held", F.lit(True)), ["user_id", "memory_id"], "left").where("held IS NULL").select(F.col("memory_id").alias("member"), (~F.col("archived")).alias("counts"))
    order = seeds.select(F.col("memory_id").alias("seed"), (-F.col("created_ms")).alias("pos"), F.col("user_id").alias("key"))
    # In no ensemble, but archived: such members don't count and take no part.
    wants = wants.join(free.where("counts"), "member").join(order, "seed").select("key", "seed", "pos", "member", (-F.col("score")).alias("place"), "counts")
    made = checkpoint(keyed_sets(wants, new))
    born = made.join(order, "seed").join(m.select(F.col("memory_id").alias("seed"), "user_id"), "seed").select(
        F.concat(F.lit("new:"), F.col("seed").cast("string")).alias("ensemble"), "user_id", F.lit("cluster").alias("kind"), F.col("member").alias("memory_id"), F.struct(F.lit(1).alias("kind_no"), "pos", F.col("seed").alias("no")).alias("turn")
    )
    centres = mean_vectors(born.join(m.select("memory_id", "embedding"), "memory_id"), "ensemble").select("ensemble", "centroid")
    every = checkpoint(old.unionByName(born.join(centres, "ensemble").select(*old.columns)))

    # drift and archival: each ensemble for itself
    ens = every.groupBy("ensemble").agg(F.first("user_id").alias("user_id"), F.first("kind").alias("kind"), F.first("turn").alias("turn"), F.first("centroid").alias("centroid"), F.count("memory_id").alias("had"))
    alive = every.where("memory_id IS NOT NULL").join(m.where("NOT archived").select("memory_id", "user_id", "strength", "embedding"), ["memory_id", "user_id"])
    steady = alive.where(F.round(V.cosine(F.col("embedding"), F.col("centroid")), 6) >= drift).select("ensemble", "memory_id", "strength", "embedding")
    left = steady.groupBy("ensemble").agg(F.count(F.lit(1)).alias("left"))
    ens = ens.join(left, "ensemble", "left").withColumn("left", F.coalesce("left", F.lit(0)))
    ends = (F.col("left") < F.when(F.col("kind") == "conflict_group", 1).otherwise(keep)).alias("ends")
    ens = checkpoint(ens.withColumn("ends", ends).withColumn("drifted", F.col("left") != F.col("had")))
    going = ens.where("NOT ends").select("ensemble", "drifted", "user_id", "turn", F.col("centroid").alias("was"))
    kept = checkpoint(steady.join(going.select("ensemble"), "ensemble", "left_semi"))
    moved = mean_vectors(kept.join(going.where("drifted").select("ensemble"), "ensemble", "left_semi"), "ensemble").select("ensemble", F.col("centroid").alias("now"))
    going = checkpoint(going.join(moved, "ensemble", "left").withColumn("centroid", F.coalesce("now", "was")))

    # growth: a memory goes to the first ensemble that may take it at its turn
    numbers = going.select(F.xxhash64("ensemble").alias("memory_id"), "ensemble", "turn", "user_id", F.col("centroid").alias("embedding"))
    reach = neighbours(numbers, m, growth, same="user_id").where(F.col("score") > alike)
    reach = reach.join(numbers.select(F.col("memory_id").alias("a"), "ensemble", "turn", "user_id"), "a").select("ensemble", "turn", "user_id", F.col("b").alias("memory_id"))
    reach = reach.join(kept.select("ensemble", "memory_id"), ["ensemble", "memory_id"], "left_anti")
    # At a turn, earlier ensembles have the members they keep, later ones those they had.
    held_before = kept.join(going.select("ensemble", "turn"), "ensemble").select("memory_id", F.col("turn").alias("by"))
    first_keeper = held_before.groupBy("memory_id").agg(F.min("by").alias("kept_from"))
    last_holder = every.where("memory_id IS NOT NULL").groupBy("memory_id").agg(F.max("turn").alias("had_until"))
    open_ = reach.join(first_keeper, "memory_id", "left").join(last_holder, "memory_id", "left")
    open_ = open_.where(~F.coalesce(F.col("kept_from") < F.col("turn"), F.lit(False)) & ~F.coalesce(F.col("had_until") > F.col("turn"), F.lit(False)))
    open_ = checkpoint(open_.select("ensemble", "turn", "memory_id").join(m.select("memory_id", "archived", "strength", "embedding"), "memory_id"))
    gains = best_per(open_.where("NOT archived"), ["memory_id"], F.asc("turn")).select("ensemble", "memory_id", "strength", "embedding")

    # what is written
    members = kept.unionByName(gains)
    sums = _with_centroid(members, "ensemble").select("ensemble", "n", F.col("centroid").alias("mean"), "strength", "confidence")
    # Archived ones aren't added, but their being found writes the ensemble anew.
    grown = gains.select("ensemble").union(open_.where("archived").select("ensemble")).distinct().withColumn("grown", F.lit(True))
    out = ens.join(sums, "ensemble", "left").join(grown, "ensemble", "left")
    changed = F.col("drifted") | F.coalesce("grown", F.lit(False))
    action = F.when(F.col("ends"), "archived").when(F.col("turn.kind_no") == 1, "created").when(changed, "updated").otherwise("kept")
    changes = out.select("ensemble", "user_id", action.alias("action"), F.coalesce("n", F.lit(0)).alias("n"), F.when(changed & F.col("mean").isNotNull(), F.col("mean")).otherwise(F.col("centroid")).alias("centroid"), "strength", "confidence")
    return changes, members.select("ensemble", "memory_id")


def _short(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(T.trim(F.substring(c, 1, most)), F.lit("…"))).otherwise(c)


def _unit_range(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def consolidate(memories: DataFrame, now_ms: int, age_hours: float = 24, smallest: int = 2, alike: float = 0.75, window: int = 9, repeated: float = 0.92, least: tuple[int, float, float] = (3, 0.8, 0.8)) -> DataFrame:
    """What consolidation of sensory memories writes: (level, source_id, user_id, title, content, embedding, strength, confidence, valence, arousal, n, tags, sources).

    memories (memory_id, user_id, store, archived, kb_id, title, content, strength,
    confidence, valence, arousal, created_ms, last_accessed_ms, tags, embedding).

    Sensory memories of no knowledge base that are older than ``age_hours`` (2 at least)
    are gone through, the last accessed first.  Those of the ``window`` nearest active
    sensory memories of the user (itself among them) with a cosine of ``alike`` or more are
    its cluster and seed no other; if ``smallest`` of them (2 to 12) are of no knowledge base,
    these become the ``sources`` of an episodic memory and are archived.  Episodic ones
    of ``least`` (sources, confidence, strength) are also written as semantic ones, unless
    a semantic memory of the user is ``repeated`` or more alike, one written just before among
    them.  Every memory takes part in one run.
    """
    smallest = min(max(smallest, 2), 12)
    age = int(max(age_hours, 2) * HOUR_MS)
    m = memories.where("NOT archived AND size(embedding) > 0")
    sensory = m.where("store = 'sensory'")
    seeds = sensory.where(F.col("kb_id").isNull() & (F.col("created_ms") <= now_ms - age))
    # Of all within the threshold, not of the nearest few: which these are depends on what is archived by then.
    chosen = F.col("kb_id").isNull() & (F.col("created_ms") <= now_ms - age)
    given = sensory.select(F.col("user_id").alias("key"), F.col("memory_id").alias("id"), F.col("embedding").alias("v"), (-F.col("last_accessed_ms")).alias("pos"), F.coalesce(chosen, F.lit(False)).alias("seeds"), F.col("kb_id").isNull().alias("counts"))
    sets = checkpoint(near_sets(given, alike, smallest, window))

    docs = sets.join(sensory.drop("created_ms", "last_accessed_ms").withColumnRenamed("memory_id", "member"), "member")
    n = F.count(F.lit(1))
    ranked = F.array_sort(F.collect_list(F.struct("place", "member", "title", "content", "tags")))  # ``window`` rows at most
    made = docs.groupBy("seed", "user_id").agg(n.alias("n"), F.avg("valence").alias("valence"), F.avg("arousal").alias("arousal"), ranked.alias("docs"))
    made = made.join(mean_vectors(docs, "seed").select("seed", F.col("centroid").alias("embedding")), "seed")
    lines = F.transform("docs", lambda d, i: F.concat((i + 1).cast("string"), F.lit(". [sensory] "), _short(d["title"], 80), F.lit("\n"), _short(d["content"], 180)))
    tags = F.array_sort(F.array_distinct(F.filter(F.transform(F.flatten(F.transform("docs", lambda d: d["tags"])), lambda x: F.lower(T.trim(x))), lambda x: x != "")))
    episodic = made.select(
        F.lit("episodic").alias("level"),
        F.col("docs")[0]["member"].alias("source_id"),
        "user_id",
        _short(F.concat(F.lit(EPISODIC), F.array_join(F.transform("docs", lambda d: d["title"]), " | ")), 110).alias("title"),
        F.concat(F.lit(SOURCES), F.col("n").cast("string"), F.lit(" memories):\n\n\n\n"), F.array_join(lines, "\n\n")).alias("content"),
        "embedding",
        _unit_range(0.45 + F.least(F.col("n"), F.lit(12)) * 0.05).alias("strength"),
        _unit_range(0.55 + F.least(F.col("n"), F.lit(20)) * 0.02).alias("confidence"),
        F.least(F.lit(1.0), F.col("valence")).alias("valence"),
        F.least(F.lit(1.0), F.col("arousal")).alias("arousal"),
        "n",
        tags.alias("tags"),
        F.transform("docs", lambda d: d["member"]).alias("sources"),
        "seed",
    )
    episodic = checkpoint(episodic)
    strong = episodic.where((F.col("n") >= least[0]) & (F.col("confidence") >= least[1] - 1e-9) & (F.col("strength") >= least[2] - 1e-9))
    # Approximate first (the nearest stored one by blocks), then exact: against those written in the same run, in order.
    known = m.where("store = 'semantic'").select("memory_id", "user_id", "embedding")
    asks = strong.select(F.col("seed").alias("memory_id"), "user_id", "embedding")
    stale = neighbours(asks, known, 1, repeated, same="user_id").select(F.col("a").alias("memory_id")).distinct()
    fresh = asks.join(stale, "memory_id", "left_anti")
    alike_ = similar_pairs(fresh, fresh, repeated, same="user_id")
    order = seeds.select(F.col("memory_id").alias("seed"), (-F.col("last_accessed_ms")).alias("pos"), F.col("user_id").alias("key"))
    rivals = alike_.union(alike_.select("b", "a", "score")).toDF("seed", "member", "score").select("seed", "member").union(fresh.select(F.col("memory_id").alias("seed"), F.col("memory_id").alias("member")))
    # A written one blocks all that are like it: it takes them, itself among them.
    won = keyed_sets(rivals.join(order, "seed").select("key", "seed", "pos", "member", F.lit(0).alias("place"), F.lit(True).alias("counts")), 1).select("seed").distinct()
    semantic = strong.join(won, "seed", "left_semi").select(
        F.lit("semantic").alias("level"), "source_id", "user_id", F.concat(F.lit(SEMANTIC), F.col("title")).alias("title"), "content", "embedding", _unit_range(F.col("strength") * 0.95 + 0.05).alias("strength"), _unit_range(F.col("confidence") + 0.05).alias("confidence"), "valence", "arousal", "n", "tags", "sources", "seed"
    )
    return episodic.unionByName(semantic).withColumnRenamed("seed", "seed_id")
