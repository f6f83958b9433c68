"""Search: exact vector neighbours, similarity bands, lexical scores and BM25.

Vectors of a query set are compared with all rows by pairs of blocks (``vectorjoin``);
each task keeps the best k of its own block before anything is shuffled.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.functions import vectors as V
from mnemospark.operators import vectorjoin
from mnemospark.operators.common import top, top_per

K1, B = 1.2, 0.75


def nearest(rows: DataFrame, vector: list[float], k: int, id_col: str = "memory_id", vector_col: str = "embedding", among: DataFrame | None = None) -> DataFrame:
    """(all columns but the vector, score): the k rows of highest cosine with one vector; filters on rows stay below the scoring.

    ``among`` has the ids that may be found: scores, not vectors, are shuffled to meet them.
    """
    q = F.array(*[F.lit(float(x)) for x in vector])
    scored = rows.withColumn("score", F.round(V.cosine(F.col(vector_col), q), 6)).drop(vector_col)
    if among is not None:
        scored = scored.join(among.select(id_col), id_col, "left_semi")
    return top(scored, k, F.desc("score"), F.asc(id_col))


def neighbours(queries: DataFrame, rows: DataFrame, k: int, least: float = -1.0, id_col: str = "memory_id", vector_col: str = "embedding", same: str | None = None) -> DataFrame:
    """(a, b, score): for each query row a its k nearest rows b other than itself, of cosine ``least`` or more, in the same group if ``same`` names a column.

    Vectors meet those of their own length.  A task keeps the k best of each query, ties by id.
    """
    pairs = vectorjoin.joined(queries, rows, lambda s, a, b: vectorjoin.nearest(s, a, b, k, least), least, id_col, vector_col, same)
    return top_per(pairs.select("a", "b", "score"), ["a"], k, F.desc("score"), F.asc("b"))


def similar_pairs(queries: DataFrame, rows: DataFrame, low: float, high: float = 1.0, id_col: str = "memory_id", vector_col: str = "embedding", same: str | None = None) -> DataFrame:
    """(a, b, score) with a < b, each pair of a query and a row with a cosine in [low, high] once: only these leave the tasks."""

    def picked(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, to = np.nonzero((s >= low) & (s <= high))
        other = a[at] != b[to]
        return at[other], to[other]

    pairs = vectorjoin.joined(queries, rows, picked, low, id_col, vector_col, same, symmetric=queries is rows)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")
    return pairs if queries is rows and not vectorjoin.repeated(rows, id_col) else pairs.distinct()


def bm25(docs: DataFrame, query: str, k: int, id_col: str = "memory_id", text_col: str = "content") -> DataFrame:
    """(id, score) of the k best rows for the query's distinct tokens.

    Counts of a fixed query's tokens are row-local, so the corpus statistics are
    one small aggregate and no postings are shuffled.
    """
    terms = sorted(set(T.query_tokens(query)))
    if not terms:
        return docs.select(id_col, F.lit(0.0).alias("score")).limit(0)
    low = docs.select(id_col, F.lower(F.coalesce(text_col, F.lit(""))).alias("t"))
    tf = low.select(id_col, F.regexp_count("t", F.lit("[a-z0-9]{2,}")).alias("len"), *[F.when(F.contains("t", F.lit(q)), F.regexp_count("t", F.lit(T.token_pattern(q)))).otherwise(0).alias(f"tf{i}") for i, q in enumerate(terms)])
    stats = tf.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    hits = tf.where(reduce(lambda a, b: a | b, [F.col(f"tf{i}") > 0 for i in range(len(terms))]))
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = float(np.log(1 + (stats["n"] - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5)))
        f = F.col(f"tf{i}")
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / (stats["avg"] or 1.0)))
    return top(hits.select(id_col, F.round(score, 6).alias("score")), k, F.desc("score"), F.asc(id_col))


def tiered_text(docs: DataFrame, query: str, k: int, id_col: str = "memory_id") -> DataFrame:
    """(id, hint): rows that have all tokens of the query in the title (1.0) or else in the content (0.75)."""
    terms = T.query_tokens(query)

    def has(c: str):
        low = F.lower(F.col(c))
        return reduce(lambda a, b: a & b, [F.contains(low, F.lit(q)) & low.rlike(T.token_pattern(q)) for q in terms], F.lit(bool(terms)))

    hint = F.when(has("title"), 1.0).when(has("content"), 0.75)
    return top(docs.select(id_col, hint.alias("hint"), "last_accessed_ms").where("hint IS NOT NULL"), k, F.desc("hint"), F.desc("last_accessed_ms"), F.asc(id_col)).select(id_col, "hint")


def message_search(messages: DataFrame, query: str, k: int, channel: str | None = None, since_ms: int | None = None) -> DataFrame:
    """Messages with their lexical score, best first and newest among equals."""
    if channel is not None:
        messages = messages.where(F.col("channel") == channel)
    if since_ms is not None:
        messages = messages.where(F.col("ts") >= since_ms)
    scored = messages.withColumn("score", F.round(T.lexical_score(query, F.col("content")), 6)).where("score > 0")
    return top(scored, k, F.desc("score"), F.desc("ts"), F.asc("message_id"))


def merged_hits(hits: list[DataFrame], id_col: str, k: int, *order) -> DataFrame:
    """Hits of several searches: of each id the best, then the k best."""
    every = reduce(lambda a, b: a.unionByName(b), hits)
    return top(top_per(every, [id_col], 1, *order), k, *order)
