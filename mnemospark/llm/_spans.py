"""Spans of kinds found in texts: order, digest and Arrow batches.

Finders work on a text's UTF-8 bytes, decoded as Latin-1 so that a position is a
byte; all patterns are ASCII, so no match differs.  Spans are reported in code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Span = tuple[int, int, int]  # start, place of its kind in the list of kinds, end


def _points(raw: bytes, spans: list[Span]) -> list[Span]:
    """From bytes to code points."""
    if not spans or raw.isascii():
        return spans
    before = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, out=before[1:])
    return [(int(before[s]), k, int(before[e])) for s, k, e in spans]


def scan(docs: DataFrame, finder: Callable[[], Callable[[bytes], tuple[list[Span], list[Span]]]], kinds: tuple[str, ...], base: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_<kind> of the base kinds, base_sha256, spans) for each row.

    ``finder()`` is called once a task and gives a function from bytes to (base spans, added spans).
    """
    schema = "doc_id long, " + "".join(f"n_{k} long, " for k in base) + "base_sha256 string, spans string"
    nothing = hashlib.sha256(b"").hexdigest()

    def line(spans: list[Span]) -> str:
        return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder()
        for b in batches:
            counts, digests, lines = [[] for _ in base], [], []
            for value in b.column("raw"):
                raw = value.as_py() or b""
                own, added = find(raw)
                own = sorted(_points(raw, own))
                for i, c in enumerate(counts):
                    c.append(sum(s[1] == i for s in own) if own else 0)
                digests.append(hashlib.sha256(line(own).encode()).hexdigest() if own else nothing)
                lines.append(line(sorted(set(own) | set(_points(raw, added)))) if added else line(own))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(lines, pa.string())], names=["doc_id", *[f"n_{k}" for k in base], "base_sha256", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("raw")).mapInArrow(run, schema)
