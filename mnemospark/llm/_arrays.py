"""Tokenising Arrow text columns with numpy, many documents at a time.

Texts stay UTF-8 bytes.  A slice of a batch is one byte buffer with document
offsets; words are (document, start, end, 64-bit hash) arrays over it, so the
cost per word is a few vector operations and never a Python object.
Slices hold SLICE_BYTES (one document at least), which bounds the memory of a
worker whatever the batch size.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64); wraps silently."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> _U(30)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


@lru_cache(maxsize=None)
def _byte_codes(lower: bool) -> np.ndarray:
    codes = mix((np.arange(256, dtype=np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15))
    if lower:
        codes[65:91] = codes[97:123]
    return codes


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of an odd base and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) <= n:
        size, base = max(n + 1, SLICE_BYTES + 1), 0x5851F42D4C957F2D
        for name, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


class RollingHash:
    """Polynomial hashes of any byte range of a buffer, from one prefix sum."""

    def __init__(self, data: np.ndarray, lower: bool = False):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_byte_codes(lower)[data] * up[: len(data)], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def give_back() -> None:
    """Hands memory that arrays have left back to the system: Spark keeps a task's Python process for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string or binary column; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if "binary" in str(column.type) else "")
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    return (np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)), offs


def slices(column: pa.Array, limit: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of slices of the column."""
    if not len(column):
        return
    data, offs = buffers(column)
    i, n, limit = 0, len(offs) - 1, limit or SLICE_BYTES
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of words in the wider sense: ASCII letters and digits, and all of non-ASCII UTF-8.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True that don't cross a document's border."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    borders = offs[(offs > 0) & (offs < len(inside))]
    first[borders] = inside[borders]
    last = np.zeros(len(inside) + 1, dtype=bool)
    last[1:] = inside
    last[1:-1] &= ~inside[1:]
    last[borders] = inside[borders - 1]
    return np.flatnonzero(first), np.flatnonzero(last)


class Words:
    """The words of a slice: start, end, hash, and first[d]..first[d+1] those of document d."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool = True, inside: np.ndarray | None = None):
        self.start, self.end = runs(~SPACE[data] if inside is None else inside[data], offs)
        self.hash = RollingHash(data, lower).ranges(self.start, self.end)
        self.first = np.searchsorted(self.start, offs)
        self.doc = np.repeat(np.arange(len(offs) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)


_STEPS = mix(np.arange(1, 65, dtype=np.uint64) * _U(0xD1342543DE82EF95)) | _U(1)


def shingles(words: Words, n: int) -> list[np.ndarray]:
    """Per document its sorted distinct n-word shingles; the whole sequence if it has 1 to n-1 words, and none if none."""
    h = words.hash
    whole = np.zeros(max(0, len(h) - n + 1), dtype=np.uint64)
    for i in range(n):
        whole += h[i : i + len(whole)] * _STEPS[i]
    whole = mix(whole)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(whole[a : b - n + 1]))
        elif b > a:
            out.append(mix((h[a:b] * _STEPS[: b - a]).sum(dtype=np.uint64, keepdims=True) + _U(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
