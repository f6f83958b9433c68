"""Enrichment of the entity graph: what a model finds in memories becomes nodes, links, relations and associations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.operators.common import best_per, checkpoint, top_per

#: Entities and relations taken from an answer; newest memories of a user that a hint is looked up in.
TAKEN, LOOKED = 5, 100
#: Kinds of entities and of relations, and what a relation is as an association.
KINDS = ("person", "project", "goal", "decision", "concept", "tool", "event", "resource", "channel")
RELATIONS = ("mentions", "decided_in", "leads_to", "depends_on", "owns", "uses", "conflicts_with", "supports", "occurs_with", "assigned_to")
ASSOCIATED = {"conflicts_with": "contradicts", "depends_on": "derives_from", "occurs_with": "co_occurred", "leads_to": "precedes"}
_SCHEMA = "entities array<struct<label:string,type:string,description:string>>, relations array<struct<from:string,to:string,type:string,weight:double,note:string>>, associationHint string"


@dataclass
class Enrichment:
    """statuses (memory_id, status); nodes (user_id, node_key, label, node_type, description, sources, created); links (memory_id, node_key); relations (user_id, from_key, to_key, relation, weight, note, evidence, channels, created); associations (from_id, to_id, relation, weight)."""

    statuses: DataFrame
    nodes: DataFrame
    links: DataFrame
    relations: DataFrame
    associations: DataFrame


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), c))


def _key(c: Column) -> Column:
    return F.lower(T.trim(c))


def plain_json(c: Column) -> Column:
    """A model's answer without white space and a code fence around it."""
    return T.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(T.trim(c), r"(?i)^```json\s*", ""), r"^```\s*", ""), r"\s*```$", ""))


def extracted(answers: DataFrame) -> DataFrame:
    """answers (.., answer) with ``ok`` and ``x``: what the JSON in it (perhaps in a code fence) says; ok is false for empty answers and those that are no JSON object."""
    rows = answers.withColumn("__plain", plain_json(F.col("answer")))
    ok = F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json("__plain")), F.lit("OBJECT")), F.lit(False))
    return rows.withColumn("ok", ok).withColumn("x", F.when(F.col("ok"), F.from_json("__plain", _SCHEMA))).drop("__plain")


def enriched(memories: DataFrame, answers: DataFrame, nodes: DataFrame, relations: DataFrame, used: DataFrame, cap: int = 1000) -> Enrichment:
    """Enrich memories (memory_id, user_id, channel, title, content, archived, created_ms, graph_enriched) by answers (memory_id, answer).

    nodes (user_id, node_key, label, node_type, description, sources) and relations
    (user_id, from_key, to_key, relation, weight, note, evidence, channels) are what is stored; used (user_id, used):
    calls of the day, ``cap`` of which are allowed.  Memories are gone through in order of id.

    An entity is the node of its kind and label's slug; one that isn't stored gets
    label and description of its first mention.  Relations join entities of the same answer by
    label (of two with one label the last); repeated ones keep the greatest weight, the last note, all
    evidence and channels.  A hint associates a memory with the newest other active one of its user, of LOOKED, that
    contains it.
    """
    m = memories.select("memory_id", "user_id", F.coalesce(F.nullif(T.trim(F.col("channel")), F.lit("")), F.lit("unknown")).alias("channel"), "graph_enriched")
    left = used.select("user_id", F.greatest(F.lit(0), F.lit(cap) - F.col("used")).alias("left"))
    rows = answers.join(m, "memory_id").join(left, "user_id", "left").withColumn("left", F.coalesce("left", F.lit(cap)))
    # The day's calls go to the first memories that aren't enriched yet: a limit of ``cap`` a user, ranked after it has cut each task's rows.
    asked = top_per(rows.where("NOT graph_enriched"), ["user_id"], cap, F.asc("memory_id")).withColumn("nth", F.row_number().over(Window.partitionBy("user_id").orderBy("memory_id")))
    asked = checkpoint(extracted(asked.where(F.col("nth") <= F.col("left"))).select("memory_id", "user_id", "channel", "ok", "x"))
    status = F.when(F.col("graph_enriched"), "already_enriched").when(F.col("ok").isNull(), "daily_cap_reached").when(F.col("ok"), "enriched").otherwise("parse_failed")
    statuses = rows.join(asked.select("memory_id", "ok"), "memory_id", "left").select("memory_id", status.alias("status"))
    good = asked.where("ok").drop("ok")

    # entities
    found = good.select("memory_id", "user_id", F.posexplode(F.slice(F.coalesce("x.entities", F.array()), 1, TAKEN)).alias("place", "e"))
    kind = F.coalesce("e.type", F.lit("concept"))
    found = found.select("memory_id", "user_id", "place", T.trim(F.col("e.label")).alias("label"), kind.alias("node_type"), T.trim(F.col("e.description")).alias("description")).where((F.col("label") != "") & F.col("node_type").isin(*KINDS))
    found = found.withColumn("node_key", T.slug(F.col("label"), F.col("node_type")))
    links = found.select("memory_id", "node_key").distinct()
    first = F.min(F.struct("memory_id", "place", "label", "node_type", "description"))
    fresh = found.groupBy("user_id", "node_key").agg(first.alias("f"), F.collect_set("memory_id").alias("new_sources"))  # ids of one node
    stored = nodes.select("user_id", "node_key", F.col("label").alias("l"), F.col("node_type").alias("t"), F.col("description").alias("d"), "sources")
    merged = fresh.join(stored, ["user_id", "node_key"], "left")
    known = F.col("sources").isNotNull()
    out_nodes = merged.select("user_id", "node_key", F.when(known, F.col("l")).otherwise(F.col("f.label")).alias("label"), F.when(known, F.col("t")).otherwise(F.col("f.node_type")).alias("node_type"), F.when(known, F.col("d")).otherwise(F.col("f.description")).alias("description"), F.array_sort(F.array_union(F.coalesce("sources", F.array().cast("array<bigint>")), "new_sources")).alias("sources"), (~known).alias("created"))

    # relations
    ends = found.groupBy("memory_id", _key(F.col("label")).alias("name")).agg(F.max_by("node_key", "place").alias("node_key"))
    said = good.select("memory_id", "user_id", "channel", F.posexplode(F.slice(F.coalesce("x.relations", F.array()), 1, TAKEN)).alias("place", "r"))
    said = said.select("memory_id", "user_id", "channel", "place", T.trim(F.col("r.from")).alias("a"), T.trim(F.col("r.to")).alias("b"), F.coalesce("r.type", F.lit("mentions")).alias("relation"), F.coalesce("r.weight", F.lit(0.7)).alias("weight"), F.nullif(T.trim(F.col("r.note")), F.lit("")).alias("note"))
    said = said.where((F.col("a") != "") & (F.col("b") != "") & F.col("relation").isin(*RELATIONS))
    joined = said.withColumns({"name_a": _key(F.col("a")), "name_b": _key(F.col("b"))})
    joined = joined.join(ends.select("memory_id", F.col("name").alias("name_a"), F.col("node_key").alias("from_key")), ["memory_id", "name_a"]).join(ends.select("memory_id", F.col("name").alias("name_b"), F.col("node_key").alias("to_key")), ["memory_id", "name_b"])
    key = ["user_id", "from_key", "to_key", "relation"]
    fresh = joined.groupBy(*key).agg(F.max(_clamp(F.col("weight"))).alias("w"), F.max(F.when(F.col("note").isNotNull(), F.struct("memory_id", "place", "note"))).alias("n"), F.collect_set("memory_id").alias("e"), F.collect_set("channel").alias("c"))
    merged = fresh.join(relations.select(*key, F.col("weight").alias("old"), F.col("note").alias("old_note"), "evidence", "channels"), key, "left")
    none_ids, none_text = F.array().cast("array<bigint>"), F.array().cast("array<string>")
    out_relations = merged.select(*key, F.greatest("w", F.coalesce("old", F.lit(0.0))).alias("weight"), F.coalesce("n.note", "old_note", F.lit("")).alias("note"), F.array_sort(F.array_union(F.coalesce("evidence", none_ids), "e")).alias("evidence"), F.array_sort(F.array_union(F.coalesce("channels", none_text), "c")).alias("channels"), F.col("old").isNull().alias("created"))

    # associations by hint
    hints = good.select("memory_id", "user_id", _key(F.col("x.associationHint")).alias("hint")).where("hint != ''")
    newest = top_per(memories.where("NOT archived").select("user_id", F.col("memory_id").alias("to_id"), "created_ms", "title", "content"), ["user_id"], LOOKED, F.desc("created_ms"), F.desc("to_id"))
    texts = newest.select("user_id", "to_id", "created_ms", F.lower(F.coalesce("title", F.lit(""))).alias("t"), F.lower(F.coalesce("content", F.lit(""))).alias("c"))
    hit = hints.join(texts, "user_id").where((F.col("memory_id") != F.col("to_id")) & (F.contains("t", F.col("hint")) | F.contains("c", F.col("hint"))))
    hit = best_per(hit, ["memory_id"], F.desc("created_ms"), F.desc("to_id")).select("memory_id", "to_id")
    lead = best_per(said, ["memory_id"], F.asc("place")).select("memory_id", "relation", "weight")
    hit = hit.join(lead, "memory_id", "left")
    as_edge = F.coalesce(F.create_map(*[F.lit(x) for kv in ASSOCIATED.items() for x in kv])[F.coalesce("relation", F.lit("occurs_with"))], F.lit("supports"))
    associations = hit.select(F.col("memory_id").alias("from_id"), "to_id", as_edge.alias("relation"), _clamp(F.coalesce("weight", F.lit(0.75))).alias("weight"))
    return Enrichment(statuses, out_nodes, links, out_relations, associations)
