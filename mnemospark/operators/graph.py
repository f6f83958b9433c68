"""Property-graph queries over nodes (node_id, node_type, label) and relations (from_id, to_id, relation, confidence)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.text import slug
from mnemospark.operators.common import top

OWNER_IN, OWNER_OUT = ("owns", "assigned_to", "leads_to"), ("owns", "assigned_to")
CHAIN = ("depends_on", "leads_to", "decided_in")


def matching(nodes: DataFrame, text: str, n: int = 25) -> DataFrame:
    """The first n nodes whose label or key holds the text."""
    q = text.strip().lower()
    hit = F.contains(F.lower("label"), F.lit(q)) | F.contains(F.lower("node_id"), F.lit(q))
    return top(nodes.where(hit), n, F.asc("node_id"))


def relations_of(nodes: DataFrame, relations: DataFrame, wanted: DataFrame) -> DataFrame:
    """Edges at the wanted nodes with both ends and their direction: from, to or both."""
    w = wanted.select("node_id").distinct()
    a = w.select(F.col("node_id").alias("from_id"), F.lit(True).alias("__a"))
    b = w.select(F.col("node_id").alias("to_id"), F.lit(True).alias("__b"))
    r = relations.join(a, "from_id", "left").join(b, "to_id", "left").where("__a OR __b")
    n1 = nodes.select(F.col("node_id").alias("from_id"), F.col("label").alias("from_label"))
    n2 = nodes.select(F.col("node_id").alias("to_id"), F.col("label").alias("to_label"))
    direction = F.when(F.col("__a") & F.col("__b"), "both").when(F.col("__a"), "from").otherwise("to")
    return r.withColumn("direction", direction).join(n1, "from_id").join(n2, "to_id").select("from_id", "to_id", "relation", "confidence", "direction", "from_label", "to_label").distinct()


def ownership(nodes: DataFrame, relations: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node_id, side, other_id, relation, confidence): owners come in, what is owned goes out."""
    w = wanted.select("node_id")
    inward = relations.where(F.col("relation").isin(*OWNER_IN)).join(w.withColumnRenamed("node_id", "to_id"), "to_id").select(F.col("to_id").alias("node_id"), F.lit("owner").alias("side"), F.col("from_id").alias("other_id"), "relation", "confidence")
    outward = relations.where(F.col("relation").isin(*OWNER_OUT)).join(w.withColumnRenamed("node_id", "from_id"), "from_id").select(F.col("from_id").alias("node_id"), F.lit("owned").alias("side"), F.col("to_id").alias("other_id"), "relation", "confidence")
    return inward.unionByName(outward).join(nodes.select(F.col("node_id").alias("other_id"), "label"), "other_id")


def two_hops(relations: DataFrame, starts: DataFrame, ends: DataFrame) -> DataFrame:
    """(a, via, b, score): paths of two edges, in one direction or the other, for pairs without a direct edge.

    Both edge lists are cut to the edges at the wanted nodes before they meet, so
    the join is as large as the answer.
    """
    e = relations.select("from_id", "to_id", "confidence")
    a, b = starts.select(F.col("node_id").alias("a")).distinct(), ends.select(F.col("node_id").alias("b")).distinct()
    out = None
    for src, dst in (("from_id", "to_id"), ("to_id", "from_id")):
        first = e.join(a, F.col(src) == F.col("a")).select("a", F.col(dst).alias("via"), F.col("confidence").alias("c1"))
        second = e.join(b, F.col(dst) == F.col("b")).select("b", F.col(src).alias("via"), F.col("confidence").alias("c2"))
        one = first.join(second, "via").where("a != b AND via != a AND via != b")
        out = one if out is None else out.unionByName(one)
    out = out.groupBy("a", "via", "b").agg(F.max(F.round(F.col("c1") * F.col("c2"), 6)).alias("score"))
    direct = e.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).union(e.select("to_id", "from_id")).distinct()
    return out.join(direct, ["a", "b"], "left_anti")


def dependency_chain(relations: DataFrame, starts: DataFrame, depth: int = 3, kinds: tuple[str, ...] = CHAIN) -> DataFrame:
    """(node_id, depth): nodes reached over the chain's relations, at their least number of steps.

    One join a step; depth is at most 5, so the plan stays small.
    """
    e = relations.where(F.col("relation").isin(*kinds)).select("from_id", "to_id")
    seen = starts.select("node_id", F.lit(0).alias("depth")).distinct()
    front = seen.select("node_id")
    for i in range(1, min(5, max(1, depth)) + 1):
        front = front.join(e, F.col("node_id") == F.col("from_id")).select(F.col("to_id").alias("node_id")).distinct()
        seen = seen.unionByName(front.withColumn("depth", F.lit(i)))
    return seen.groupBy("node_id").agg(F.min("depth").alias("depth"))


def merged_relations(rows: DataFrame) -> DataFrame:
    """One relation for each (from, to, kind): greatest weight within 0.1 and 1, all evidence."""
    w = F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.max("weight")))
    return rows.groupBy("from_id", "to_id", "relation").agg(w.alias("weight"), F.array_sort(F.collect_set("evidence")).alias("evidence"))


def merged_chain(rows: DataFrame) -> DataFrame:
    """One row for each (depth, node_type, label, relation) of a chain: greatest confidence, all evidence (an array of ids), distinct before it is gathered."""
    by = ["depth", "node_type", "label", "relation"]
    best = rows.groupBy(*by).agg(F.max("confidence").alias("confidence"))
    ids = rows.select(*by, F.explode("evidence").alias("id")).distinct().groupBy(*by).agg(F.array_sort(F.collect_list("id")).alias("evidence"))
    same = None
    for c in by:
        one = F.col(f"b.{c}").eqNullSafe(F.col(f"i.{c}"))
        same = one if same is None else same & one
    return best.alias("b").join(ids.alias("i"), same, "left").select("b.*", F.coalesce("i.evidence", F.array().cast(dict(ids.dtypes)["evidence"])).alias("evidence"))


def merged_nodes(rows: DataFrame) -> DataFrame:
    """One node for each (user, canonical key of kind and label), with the rows it comes from."""
    key = slug(F.col("label"), F.col("kind"))
    return rows.withColumn("canonical_key", key).groupBy("user_id", "canonical_key").agg(F.count(F.lit(1)).alias("mentions"), F.min("source_id").alias("first_source"))


def seed(memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of memories, channels and tags, and the links of each memory to the latter two."""
    tags = memories.select("memory_id", F.explode(F.array_distinct("tags")).alias("tag")).where("tag IS NOT NULL AND tag != ''")
    links = memories.select("memory_id", slug(F.coalesce("channel", F.lit("unknown")), F.lit("channel")).alias("node_id"), F.lit("object").alias("role")).unionByName(
        tags.select("memory_id", slug(F.col("tag"), F.lit("tag")).alias("node_id"), F.lit("topic").alias("role"))
    ).distinct()
    nodes = links.groupBy("node_id").agg(F.count(F.lit(1)).alias("links")).unionByName(memories.select(F.concat(F.lit("memory:"), F.col("memory_id").cast("string")).alias("node_id"), F.lit(0).cast("long").alias("links")))
    return nodes, links


def expansion(seeds: DataFrame, edges: DataFrame, memories: DataFrame, now_ms: int, per_seed: int = 3) -> DataFrame:
    """Memories next to the seeds (memory_id, rank): the strongest few edges of each, either way; the first seed to reach one counts."""
    from mnemospark.functions.scoring import EXPANSION_K
    from mnemospark.functions.timeexpr import age_days, decayed

    both = edges.select(F.col("from_id").alias("memory_id"), F.col("to_id").alias("other"), "weight", "edge_id").unionByName(edges.select(F.col("to_id").alias("memory_id"), F.col("from_id").alias("other"), "weight", "edge_id"))
    near = both.join(seeds, "memory_id").where("other != memory_id")
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("memory_id").orderBy(F.desc("weight"), "edge_id"))).where(F.col("n") <= per_seed)
    near = near.withColumn("m", F.row_number().over(Window.partitionBy("other").orderBy("rank", "n"))).where("m = 1").select(F.col("other").alias("memory_id"), "weight", "rank")
    found = near.join(memories.where(~F.col("archived")), "memory_id").join(seeds.select("memory_id"), "memory_id", "left_anti")
    score = F.col("strength") * F.col("weight") * 0.25 + decayed(age_days(now_ms, F.col("last_accessed_ms")), EXPANSION_K) * 0.15 + F.least(F.col("access_count") / 20, F.lit(1.0)) * 0.1
    return found.select("memory_id", F.col("rank").alias("seed_rank"), F.round(score, 6).alias("score"))
