"""Reproducible shuffle into shards: a Feistel permutation of global row numbers.

Operator 4, DataFrame functions only.  A row's global number is its rank by
(hash of id and text, id, text); the permutation p of 0..N-1 gives shard ``p mod S`` and
slot ``p div S``, so shard counts differ by one at most, slots have no gaps, and
any row's place, or the row number at any place, is computed from N and the seed.

The Feistel network works on a x b cells (a = ceil(sqrt N), b = ceil(N / a)):
fewer than a cells lie at or beyond N, and a row that lands there walks on along
its cycle, which is back inside after a steps at the latest.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.rows import numbered

ROUNDS = 6
#: Steps that every walk is given at once; the few longer ones, of a chance below 2**-160 once more than 32 cells a side exist, walk on.
LONGEST_WALK = 32


def feistel(x: Column, n: int, seed: int = 0) -> Column:
    """The place of row number x (0 <= x < n) in a pseudorandom permutation of 0..n-1."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    b = max(1, -(-n // a))

    def once(v: Column) -> Column:
        s = F.struct(F.floor(v / F.lit(b)).cast("long").alias("l"), F.pmod(v, F.lit(b)).cast("long").alias("r"))

        def step(s: Column, k: Column) -> Column:
            odd = F.pmod(k, F.lit(2)) == 1
            h = F.xxhash64(F.when(odd, s["l"]).otherwise(s["r"]), k, F.lit(seed))
            return F.struct(
                F.when(odd, s["l"]).otherwise(F.pmod(s["l"] + F.pmod(h, F.lit(a)), F.lit(a))).cast("long").alias("l"),
                F.when(odd, F.pmod(s["r"] + F.pmod(h, F.lit(b)), F.lit(b))).otherwise(s["r"]).cast("long").alias("r"),
            )

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), s, step, lambda s: s["l"] * F.lit(b) + s["r"])

    walks = min(a, LONGEST_WALK)
    out = once(x.cast("long"))
    if a * b > n:
        out = F.aggregate(F.sequence(F.lit(1), F.lit(walks)), out, lambda v, _: F.when(v < n, v).otherwise(once(v)))
        # Cells outside are fewer than a: a walk that long ends.  Nearly no row gets here.
        out = F.when(out < n, out).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(a)), out, lambda v, _: F.when(v < n, v).otherwise(once(v))))
    return out


def shard(docs: DataFrame, shards: int = 40, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with ``shard`` (int) and ``slot`` (long), every row kept.

    Null ids and texts are ordinary values; rows equal in both share their
    numbers in any order; an empty table gives an empty result.  Columns named
    shard or slot in the input are replaced.
    """
    docs = docs.drop("shard", "slot")
    n = docs.select(F.count(F.lit(1))).first()[0]
    row, place = (f"{x}-{uuid.uuid4().hex}" for x in ("row", "place"))
    rows = numbered(docs, F.col(id_col), [F.col(text_col)], row)
    p = rows.withColumn(place, feistel(F.col(row), n, seed))
    return p.withColumn("shard", F.pmod(F.col(place), F.lit(shards)).cast("int")).withColumn("slot", F.floor(F.col(place) / shards).cast("long")).drop(row, place)


def op4(spark, sf_dir: str) -> DataFrame:
    """All documents in 40 shards under the law ``rows``; grown_shard is null (that column is for the law ``key``)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    # Texts equal in length and checksum stand for the text when ties are broken, so texts aren't shuffled.
    facts = docs.select("doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.col("text").isNull().alias("__null"))
    facts = facts.withColumn("text", F.struct("__null", "size", "text_crc32"))
    out = shard(facts, 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
