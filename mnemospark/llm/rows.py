"""Global row numbers without a single-partition sort."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_hash(*columns: Column) -> Column:
    """First 60 bits of an MD5 of the columns: an order that every engine can recompute."""
    text = F.concat_ws("\u001f", *(F.coalesce(c.cast("string"), F.lit("\u0000")) for c in columns))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def numbered(df: DataFrame, key: Column, ties: list[Column], out: str = "row_no", by: Column | None = None, bucket_rows: int = 100_000) -> DataFrame:
    """Add ``out``: 0-based rank of each row by (hash of key and ties, key, ties), within ``by`` if given.

    The hash splits each group evenly over buckets of about ``bucket_rows`` rows
    (256 buckets at least); ranks inside a bucket come from a window over (group,
    bucket), and the counts of lower buckets (groups x buckets small rows,
    pre-aggregated on the map side) are added.  A group that holds a third of the
    rows, or a key that many rows share, is so ranked by many tasks.  Rows equal in
    key and all ties are interchangeable.
    """
    g, k, h, b, r = (f"{x}-{uuid.uuid4().hex}" for x in "gkhbr")
    buckets = max(256, -(-df.count() // bucket_rows))
    d = df.withColumn(g, F.lit(0) if by is None else by).withColumn(k, key).withColumn(h, order_hash(key, *ties))
    d = d.withColumn(b, (F.col(h) % buckets).cast("int"))
    below = Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    base = d.groupBy(F.col(g).alias("g"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(below), F.lit(0))).select("g", "b", "base")
    w = Window.partitionBy(g, b).orderBy(h, k, *ties)
    d = d.withColumn(r, F.row_number().over(w))
    joined = d.alias("d").join(base.alias("s"), F.col(f"d.`{g}`").eqNullSafe(F.col("s.g")) & (F.col(f"d.`{b}`") == F.col("s.b")), "left")
    return joined.select(*[F.col(f"d.`{c}`") for c in df.columns], (F.col("s.base") + F.col(f"d.`{r}`") - 1).alias(out))
