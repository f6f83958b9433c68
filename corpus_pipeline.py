"""The corpus pipeline: filters, near-duplicate removal, mixing and sharding of documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's docs.  All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm import decontaminate, jaccard, mixing, sharding, toxicity
from mnemospark.llm._shared import stored

SHARDS = 40
DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents that go to a Python process at once: texts are long, and both sides hold a batch.
BATCH_ROWS = 1000


def _batches(spark: SparkSession) -> None:
    """Smaller batches for the session, unless they are as small already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(name))
    spark.conf.set(name, min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the factorization machine scores 0.7 or more; the model learns from labels of two folds of three."""
    _batches(spark)
    every, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.clean(docs, toxicity.fit(every, labels, keep=toxicity.learn_rows()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id in each group of near duplicates (five-word shingles, similarity 0.8), and those without id."""
    _batches(spark)
    return jaccard.representatives(docs, size=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage, also with words changed."""
    _batches(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Brings sources to their tempered target weights: every document stays, those of scarce sources come again with each epoch of their source."""
    return mixing.mix(docs, ties=["n_chars", "lang"]).select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts every row into one of SHARDS shards, in a reproducible shuffle: (doc_id, source, n_chars, shard, slot)."""
    return sharding.shard(docs.select("doc_id", "source", "n_chars", F.col("lang").alias("text")), SHARDS).select("doc_id", "source", "n_chars", "shard", "slot")


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontamination", benchmark), ("mixing", mixture), ("sharding", shards)]

#: Classifier, joins by hash order and permutations are beyond SQL: the operators' tests hold near duplicates and the schedule against
#: brute force, decontamination and toxicity against planted cases, shards against their law.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
