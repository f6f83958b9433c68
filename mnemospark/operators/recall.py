"""Hybrid recall: candidates of several searches, ranked by eight signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.functions import scoring as S
from mnemospark.functions import text as T
from mnemospark.functions import vectors as V
from mnemospark.functions.timeexpr import parse_range
from mnemospark.operators import dedupe
from mnemospark.operators.clustering import diverse
from mnemospark.operators.common import top
from mnemospark.operators.visibility import channel_visible


def eligible(memories: DataFrame, mode: S.Mode, channel: str | None, user_id: int | None = None, tags: Sequence[str] = ()) -> DataFrame:
    """Active rows of a user that the mode, the channel and the tags admit; all of it reaches the scan as filters."""
    m = memories.where(~F.col("archived"))
    if user_id is not None:
        m = m.where(F.col("user_id") == user_id)
    if mode.stores:
        m = m.where(F.col("store").isin(*mode.stores))
    if mode.categories:
        m = m.where(F.col("category").isin(*mode.categories))
    if channel:
        m = m.where(F.col("kb_id").isNotNull() | channel_visible(F.col("channel"), F.lit(channel)))
    if tags:
        wanted = F.array(*[F.lit(t.strip().lower()) for t in tags])
        m = m.where(F.size(F.array_except(wanted, F.transform("tags", lambda t: F.lower(F.trim(t))))) == 0)
    return m


def candidates(memories: DataFrame, vectors: DataFrame, vector: Sequence[float], query: str, now_ms: int, per_search: int = 32) -> DataFrame:
    """(memory_id, vector_score, text_hint): the union of nearest vectors, text hits and, if the query names a time, rows of it."""
    from mnemospark.operators.search import nearest, tiered_text

    ids = memories.select("memory_id")
    near = nearest(vectors.select("memory_id", "embedding"), list(vector), per_search, among=ids).select("memory_id", F.col("score").alias("vector_score"), F.lit(0.0).alias("text_hint"))
    out = near.unionByName(tiered_text(memories, query, per_search).select("memory_id", F.lit(0.0).alias("vector_score"), F.col("hint").alias("text_hint")))
    span = parse_range(query, now_ms)
    if span:
        timed = top(memories.where(F.col("created_ms").between(*span)), per_search, F.asc("created_ms"), F.asc("memory_id"))
        out = out.unionByName(timed.select("memory_id", F.lit(0.0).alias("vector_score"), F.lit(0.0).alias("text_hint")))
    return out.groupBy("memory_id").agg(F.max("vector_score").alias("vector_score"), F.max("text_hint").alias("text_hint"))


def ranked(found: DataFrame, now_ms: int, weights: dict | None = None, channel: str | None = None, boosted: DataFrame | None = None, least: float = S.LEAST_SCORE, boost: float = 0.05) -> DataFrame:
    """Candidates with columns of memories, vector_score and text_score: scored, equal texts reduced to the best, weak ones dropped, graph links boosted."""
    sig = S.signals(now_ms, F.col("vector_score"), F.col("text_score"), channel)
    rows = found.withColumn("score", F.round(S.recall_score(sig, weights), 6))
    rows = dedupe.keep_best(rows)
    rows = rows.withColumn("score", F.round(F.col("score") * S.procedural_factor(F.col("category"), F.col("metadata")), 6)).where(F.col("score") >= least)
    if boosted is not None:
        flag = boosted.select("memory_id").distinct().withColumn("__b", F.lit(boost))
        rows = rows.join(flag, "memory_id", "left").withColumn("score", F.round(F.col("score") + F.coalesce("__b", F.lit(0.0)), 6)).drop("__b")
    return rows


def recall(memories: DataFrame, vectors: DataFrame, vector: Sequence[float], query: str, now_ms: int, mode: str = "general", channel: str | None = None, user_id: int | None = None, limit: int | None = None, links: DataFrame | None = None, weights: dict | None = None) -> DataFrame:
    """The best memories for a query, one lazy plan: (memory_id, title, content, score), up to twice ``limit`` for a later choice of different ones."""
    preset = S.MODES[mode]
    n = min(20, max(1, limit or preset.limit))
    pool = eligible(memories, preset, channel, user_id)
    found = candidates(pool, vectors, vector, query, now_ms, min(100, max(20, 4 * n)))
    rows = found.join(pool, "memory_id").withColumn("text_score", F.col("text_hint"))
    strong = None if links is None else links.where("confidence > 0.7")
    out = ranked(rows, now_ms, {**preset.weights, **(weights or {})}, channel, strong)
    return top(out, 2 * n, F.desc("score"), F.desc("text_score"), F.asc("memory_id")).select("memory_id", "title", "content", "store", "category", "score", "text_score")


def distinct_results(results: DataFrame, limit: int, similarity: float = 0.85) -> DataFrame:
    """The first ``limit`` results that don't repeat one another.  At most 40 rows: one task."""
    few = results.orderBy(F.desc("score"), F.desc("text_score"), F.asc("memory_id"))

    def choose(batches):
        import pandas as pd

        parts = list(batches)
        if parts:
            yield diverse(pd.concat(parts), limit, similarity)

    return few.coalesce(1).sortWithinPartitions(F.desc("score"), F.desc("text_score"), F.asc("memory_id")).mapInPandas(choose, results.schema)


def lexical_fallback(memories: DataFrame, query: str, n: int, now_ms: int) -> DataFrame:
    """Rows of any lexical match, for queries without vector results."""
    t = T.text_match(query, F.col("title"), F.col("content"), F.col("tags"))
    rows = memories.withColumn("vector_score", F.lit(0.0)).withColumn("text_score", F.round(t, 6)).where("text_score > 0")
    out = ranked(rows, now_ms, least=0.0)
    return top(out, n, F.desc("score"), F.desc("text_score"), F.asc("memory_id")).select("memory_id", "score", "text_score")


def query_base(memories: DataFrame, vectors: DataFrame, vector: Sequence[float], kb_id: str, query: str, n: int, now_ms: int) -> DataFrame:
    """The best rows of one knowledge base by vector and text, with a small weight for being in one."""
    chunks = memories.where((F.col("kb_id") == kb_id) & ~F.col("archived")).join(vectors.select("memory_id", "embedding"), "memory_id", "left")
    q = F.array(*[F.lit(float(x)) for x in vector])
    rows = chunks.withColumn("vector_score", F.coalesce(F.round(V.cosine(F.col("embedding"), q), 6), F.lit(0.0))).drop("embedding").withColumn("text_score", F.round(T.text_match(query, F.col("title"), F.col("content"), F.col("tags")), 6))
    return top(ranked(rows, now_ms, {"kb": 0.08}, least=0.0), n, F.desc("score"), F.desc("text_score"), F.asc("memory_id")).select("memory_id", "score")
