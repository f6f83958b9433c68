"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.rows import order_hash


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, keep: Column | None = None) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled documents, those of least id hash.

    Null ids and labels take no part; of several labels of a document the largest
    counts; of several documents with one id, the one whose text has the least hash.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    own = own.where(keep) if keep is not None else own
    own = own.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    own = own.orderBy(order_hash(F.col("doc_id")), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id")  # at most ``rows`` ids
    return found.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("one")).select("doc_id", F.col("one.text").alias("text"), "label")
