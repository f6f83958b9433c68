"""Fill-in-middle transformation, cut at ranks that an indexable skip list finds.

Operator 12.  A text is a list of units (code points, words or lines).  The skip list's
lowest lane has one node a unit, every lane above it one node for FANOUT of the lane
below, and each node carries how many units, code points and bytes its link spans.
Descending by accumulated unit widths reaches a cut rank in a few steps a lane, and the
code points and bytes before it have been summed on the way.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FANOUT = 16
#: Where prefix, suffix and middle begin.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = re.compile(b"<[PSM]>")
#: Of 100 texts: so many are cut at all, and of those so many get the suffix first.
CUT, SUFFIX_FIRST = 90, 20
#: Bytes at which a unit ends, for units longer than a code point.
ENDS = {"word": re.compile(rb"[\x20\x09-\x0D]+"), "line": re.compile(rb"\n")}


def unit_starts(raw: bytes, unit: str = "char") -> np.ndarray:
    """Byte offsets at which the units of a text begin: code points; words with the white space behind them; lines with their end."""
    if unit == "char":
        return np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    starts = [m.end() for m in ENDS[unit].finditer(raw)]
    return np.array([x for x in (0, *starts) if x < len(raw)], np.int64)


class SkipList:
    """lanes[0] is the lowest; widths[k] of a node are its (units, code points, bytes)."""

    def __init__(self, raw: bytes, unit: str = "char"):
        starts = unit_starts(raw, unit)
        bytes_of = np.diff(starts, append=len(raw))
        points = np.ones(len(starts), np.int64)
        if unit != "char" and len(starts):
            points = np.add.reduceat((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, starts, dtype=np.int64)
        self.n = len(starts)
        self.lanes = [np.stack([np.ones(self.n, np.int64), points, bytes_of], axis=1)]
        while len(self.lanes[-1]) > FANOUT:
            below = self.lanes[-1]
            self.lanes.append(np.add.reduceat(below, np.arange(0, len(below), FANOUT), axis=0))

    def reach(self, rank: int) -> tuple[int, int]:
        """Code points and bytes before the unit of this rank (0 to n)."""
        at, units, points, size = 0, 0, 0, 0
        for k in range(len(self.lanes) - 1, -1, -1):
            lane = self.lanes[k]
            while at < len(lane) and units + lane[at, 0] <= rank:
                units, points, size, at = units + int(lane[at, 0]), points + int(lane[at, 1]), size + int(lane[at, 2]), at + 1
            at *= FANOUT
        return points, size


def draws(doc_id: int | None, seed: int = 1) -> list[int]:
    """Four 32-bit numbers of a document; a null id counts as empty."""
    text = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(text[i : i + 8], 16) for i in (0, 8, 16, 24)]


def transform(raw: bytes, doc_id: int | None, unit: str = "char", seed: int = 1) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of prefix and of middle or None, output)."""
    units = SkipList(raw, unit)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not units.n or h3 % 100 >= CUT or MARKERS.search(raw):
        return units.n, "plain", None, None, raw
    a, b = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
    (points_a, at), (points_b, to) = units.reach(a), units.reach(b)
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    first, middle, last = raw[:at], raw[at:to], raw[to:]
    spm = h4 % 100 < SUFFIX_FIRST
    out = b"".join((s, last, p, first, m, middle) if spm else (p, first, s, last, m, middle))
    return units.n, "spm" if spm else "psm", points_a, points_b - points_a, out


def restored(out: bytes, form: str) -> bytes:
    """The text, from its output and form alone: it holds no marker, so the first of each kind is the one that was set."""
    if form == "plain":
        return out
    order = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}[form]
    _, mark, rest = out.partition(order[0].encode())
    first, _, rest = rest.partition(order[1].encode())
    second, _, middle = rest.partition(order[2].encode())
    return first + middle + second if form == "psm" else second + middle + first


def fill_in_middle(docs: DataFrame, unit: str = "char", seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, restored) of each row; output and restored are UTF-8 bytes.

    A null text counts as empty and stays plain; a null id draws as an empty one; rows
    of one id draw alike, so repeated rows give equal rows; texts are cut whole, at any
    length, each in memory of some 70 bytes a unit; other columns are ignored; an empty
    table gives an empty result.  Nothing is shuffled.
    """
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary, restored binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        for b in batches:
            rows, size = [], 0
            for i, value in zip(b.column("doc_id").to_pylist(), b.column("raw"), strict=True):
                found = transform(value.as_py() or b"", i, unit, seed)
                rows.append((i, *found, restored(found[4], found[1])))
                size += len(found[4])
                if size > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("raw")).mapInArrow(run, schema)


def op12(spark, sf_dir: str) -> DataFrame:
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS y, CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS c, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS o FROM d),
f AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN o < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1, n - b) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p"""
