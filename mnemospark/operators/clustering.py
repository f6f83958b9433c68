"""Clusters of vectors: leaders, centroids, drift, resonance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import vectors as V


def mean_vectors(rows: DataFrame, by: str, vector_col: str = "embedding") -> DataFrame:
    """(by, centroid, n): element-wise means, pre-aggregated by place before the shuffle."""
    parts = rows.select(by, F.posexplode(vector_col).alias("i", "x")).groupBy(by, "i").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "m")))
    return parts.groupBy(by).agg(F.transform(ordered, lambda s: s["m"]).alias("centroid"), F.max("n").alias("n"))


def cohesion(rows: DataFrame, by: str = "ensemble_id") -> DataFrame:
    """rows with their centroid's cosine."""
    return rows.join(mean_vectors(rows, by), by).withColumn("similarity", F.round(V.cosine(F.col("embedding"), F.col("centroid")), 6))


def leaders(rows: DataFrame, by: str, least: float = 0.75, smallest: int = 3, id_col: str = "memory_id", vector_col: str = "embedding") -> DataFrame:
    """(by, id, cluster): each row, in order of id, joins the nearest cluster of its key with a cosine over ``least`` to its running mean, or leads a new one.

    The order decides, so a key's rows run in one pass; only the means are held.
    Clusters of fewer than ``smallest`` rows are left out.
    """
    kind = dict(rows.dtypes)[by]
    ordered = rows.select(F.col(by).alias("k"), F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("v IS NOT NULL").repartition("k").sortWithinPartitions("k", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, sums, sizes = object(), np.zeros((0, 0)), []
        for pdf in batches:
            out = []
            for k, v in zip(pdf["k"], pdf["v"], strict=True):
                v = np.asarray(v, float)
                if k != key:
                    key, sums, sizes = k, np.zeros((0, len(v))), []
                n = np.linalg.norm(sums, axis=1) * np.linalg.norm(v)
                s = np.round(np.divide(sums @ v, n, out=np.zeros(len(sums)), where=n > 0), 9)
                at = int(s.argmax()) if len(s) and s.max() > least else len(sums)
                if at == len(sums):
                    sums, sizes = np.vstack([sums, v]), [*sizes, 0]
                else:
                    sums[at] += v
                sizes[at] += 1
                out.append(at)
            yield pd.DataFrame({"k": pdf["k"], "id": pdf["id"], "cluster": out})

    found = ordered.mapInPandas(run, f"k {kind}, id long, cluster long")
    n = F.count(F.lit(1)).over(Window.partitionBy("k", "cluster"))
    return found.withColumn("n", n).where(F.col("n") >= smallest).select(F.col("k").alias(by), F.col("id").alias(id_col), "cluster", "n")


def in_band(centroids: DataFrame, low: float, high: float, peers: int = 2) -> DataFrame:
    """(id, peers, key): centroids with at least ``peers`` others whose cosine lies in the band: the best few, and a key for the set.

    A centroid is one row an ensemble; pairs are compared a block at a time.
    """
    from mnemospark.operators.search import similar_pairs

    rows = centroids.select(F.col("ensemble_id").alias("memory_id"), F.col("centroid").alias("embedding"))
    pairs = similar_pairs(rows, rows, low, high)
    both = pairs.union(pairs.select("b", "a", "score"))
    w = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    best = both.withColumn("n", F.row_number().over(w)).where(F.col("n") <= peers).groupBy("a").agg(F.array_sort(F.collect_list("b")).alias("peers")).where(F.size("peers") >= peers)
    key = F.concat_ws("|", F.transform(F.array_sort(F.concat(F.array("a"), F.col("peers"))), lambda x: x.cast("string")))
    return best.withColumn("key", key).groupBy("key").agg(F.min("a").alias("ensemble_id"))


def diverse(ranked: pd.DataFrame, n: int, similarity: float = 0.85) -> pd.DataFrame:
    """The first n of ranked rows that don't repeat one another (word pairs in common), filled up with the skipped ones in order.

    For the few rows of one result, after top-k: columns title, content.
    """
    import re

    def pairs(text: str) -> set[str]:
        t = [x for x in re.split("[^a-z0-9]+", text.lower()) if x]
        return set(zip(t, t[1:], strict=False)) if len(t) > 1 else set(t)

    kept, skipped, sets = [], [], []
    for i, (title, content) in enumerate(zip(ranked["title"], ranked["content"], strict=True)):
        if len(kept) >= n:
            break
        mine = pairs(f"{title} {content}")
        near = any((len(mine & s) / len(mine | s) if mine | s else 1.0) >= similarity for s in sets)
        (skipped if near else kept).append(i)
        if not near:
            sets.append(mine)
    return ranked.iloc[[*kept, *skipped][:n]]
