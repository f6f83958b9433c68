"""Small building blocks of the other operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: 64-bit words of a sieve.
SIEVE = 1 << 18


def checkpoint(df: DataFrame) -> DataFrame:
    """df, written to the folder that spark.checkpoint.dir names: lineage is cut and lost executors don't matter.  Where it is unset: a local folder if Spark runs in this process alone, an error on a cluster, whose executors wouldn't see it."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        found = context.getConf().get("spark.checkpoint.dir")
        if not found and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(found or "file://" + tempfile.mkdtemp(prefix="mnemospark-"))
    return df.checkpoint()


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows: a heap in each task and one merge, no full sort."""
    return df.orderBy(*order).limit(n)


def top_per(df: DataFrame, by: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each key; a limit on the map side precedes the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def best_per(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    return top_per(df, by, 1, *order)


def keyset_page(df: DataFrame, n: int, after: tuple | None, key: str, id_col: str) -> DataFrame:
    """One page in descending (key, id) order after a cursor, with has_more on each row; n + 1 rows are looked at."""
    if after is not None:
        df = df.where((F.col(key) < after[0]) | ((F.col(key) == after[0]) & (F.col(id_col) < after[1])))
    page = top(df, n + 1, F.desc(key), F.desc(id_col))
    w = Window.orderBy(F.desc(key), F.desc(id_col))  # n + 1 rows
    return page.withColumn("__n", F.row_number().over(w)).withColumn("has_more", F.max("__n").over(Window.partitionBy()) > n).where(F.col("__n") <= n).drop("__n")


def upsert(old: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """old with the changed columns of rows whose key is in changes; null in changes keeps the old value."""
    new = changes.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = old.join(new, key, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in old.columns])


def count_if(c: Column) -> Column:
    return F.count_if(c)


def with_runs(rows: DataFrame, keys: list[str], gap: int, ts: str, bucket: int = 3_600_000) -> DataFrame:
    """rows with ``__run``: a key's rows in parts between which more than ``gap`` passes, so that nothing that lasts ``gap`` carries over.

    Parts are cut between buckets of time: only the first and last instants of each (key, bucket) are
    looked at in order, so a key with a third of the rows isn't one task.
    """
    at = F.floor(F.col(ts) / max(bucket, gap))
    marked = rows.withColumn("__bucket", at)
    edges = marked.groupBy("__bucket", *keys).agg(F.min(ts).alias("__lo"), F.max(ts).alias("__hi"))
    by = Window.partitionBy(*keys).orderBy("__bucket")
    opens = F.coalesce(F.col("__lo") - F.lag("__hi").over(by) > gap, F.lit(True)).cast("int")
    edges = edges.withColumn("__run", F.sum(opens).over(by)).select("__bucket", *keys, "__run")
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (*keys, "__bucket")]
    return marked.alias("l").join(edges.alias("r"), on).select("l.*", "r.__run").drop("__bucket")


def sifted(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose ``key`` (a whole number) is among ids, of one column, and a few others, which the join that follows drops.

    A bit for each hash is broadcast, in SIEVE rows of two numbers at most: rows with long
    texts that nobody asks for aren't shuffled.  Far more ids than bits let everything through.
    """
    place = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(64 * SIEVE))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__p").bitwiseAND(F.lit(63)).cast("int"))
    words = ids.select(place(F.col(ids.columns[0])).alias("__p")).groupBy(F.shiftright("__p", 6).alias("__w")).agg(F.bit_or(bit).alias("__b"))
    asked = rows.withColumn("__p", place(F.col(key))).join(F.broadcast(words), F.shiftright("__p", 6) == F.col("__w"))
    return asked.where(F.getbit("__b", F.col("__p").bitwiseAND(F.lit(63)).cast("int")) == 1).select(*rows.columns)


def latest(marks: DataFrame, rows: DataFrame, by: str, most: int, mark: str, at: str, ts: str, id_col: str, carried: tuple[str, ...] = (), bucket: int = 86_400_000) -> DataFrame:
    """(mark, at, id_col, ts, carried, place): of each mark the last ``most`` rows of its key at or before its instant, by (ts, id_col), place 1 the newest.

    Rows are numbered in each key, by buckets of time, so that a key with many rows isn't one
    task, and marks get the number of the last row before them.  A mark then meets two blocks of ``most``
    rows, whatever else its key has.
    """
    r = rows.where(F.col(by).isNotNull() & F.col(ts).isNotNull()).select(by, F.col(ts).alias("__ts"), F.col(id_col).alias("__id"), F.struct(id_col, ts, *carried).alias("__row"))
    m = marks.where(F.col(by).isNotNull() & F.col(at).isNotNull()).select(by, F.col(at).alias("__ts"), F.col(mark).alias("__id"), F.lit(None).cast(r.schema["__row"].dataType).alias("__row"))
    both = r.unionByName(m).withColumn("__bin", F.floor(F.col("__ts") / bucket))
    counts = F.col("__row").isNotNull().cast("long")
    earlier = Window.partitionBy(by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = both.groupBy(by, "__bin").agg(F.sum(counts).alias("__n")).select(by, "__bin", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    so_far = Window.partitionBy(by, "__bin").orderBy("__ts", F.col("__row").isNull(), "__id").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("__n", F.sum(counts).over(so_far)).join(bins, [by, "__bin"]).withColumn("__nth", F.col("__before") + F.col("__n"))
    nth = F.col("__nth")
    held = placed.where("__row IS NOT NULL").select(by, "__row", nth, F.floor(nth / most).alias("__block"))
    blocks = F.array_distinct(F.array(F.floor((nth - most + 1) / most), F.floor(nth / most)))
    wants = placed.where("__row IS NULL AND __nth > 0").select(by, F.col("__id").alias(mark), F.col("__ts").alias(at), nth.alias("__last"), F.explode(blocks).alias("__block"))
    near = wants.join(held, [by, "__block"]).where((nth <= F.col("__last")) & (nth > F.col("__last") - most))
    return near.select(mark, at, "__row.*", (F.col("__last") - nth + 1).alias("place"))
