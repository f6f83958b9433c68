"""Bitmaps of hashed keys: filters of bounded size that keep rows nobody asks for out of a shuffle.

A bitmap has every key that it was made of and some others; as keys outgrow it, it
lets more through, and what follows has to be exact by itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 64-bit words of a bitmap: 2 MB.
WORDS = 1 << 18


def _place(*key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(64 * WORDS))


def bitmap(rows: DataFrame, *key: Column) -> np.ndarray:
    """The bitmap of the rows' keys, gathered word by word: WORDS small rows at most reach the driver."""
    place = _place(*key)
    words = rows.select(F.shiftright(place, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
    held = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(WORDS, np.uint64)
    out[held.column("w").to_numpy()] = held.column("b").to_numpy().view(np.uint64)
    return out


def held(rows: DataFrame, bits: np.ndarray, *key: Column, wanted: bool = True) -> DataFrame:
    """The rows whose key the bitmap has, or those (``wanted=False``) whose key it hasn't."""
    schema = rows.schema
    name = f"at-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(name).to_numpy(zero_copy_only=False)
            has = (bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            yield b.select(schema.names).filter(pa.array(has == wanted))

    return rows.withColumn(name, _place(*key)).mapInArrow(run, schema)
