"""Quality rules: counts of each text, and a calibrated logistic regression on hashed n-grams.

Operator 9.  Features are the shares of hashed words and of hashed 4-grams of code points;
the model is fitted on a bounded sample of labelled rows (SAMPLE_ROWS), a fifth
of which calibrates its output to a probability (Platt scaling).  Scoring reads
each text once, in Arrow batches, and holds the probability against a fixed
threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm._arrays import SPACE, RollingHash, Words, mix, slices
from mnemospark.llm._labelled import sample

#: Labelled rows that the model is fitted on, at most.
SAMPLE_ROWS = 2000
#: Slots for words, and as many for character n-grams.
SLOTS = 1 << 15
GRAM = 4
#: Probability of good quality from which a document is kept.
THRESHOLD = 0.5
SCALE = 30.0
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def _grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the n-grams of GRAM code points of each document, and first[d]..first[d+1] those of document d."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    bounds = np.append(lead, len(data))
    first = np.searchsorted(lead, offs)
    n = np.maximum(np.diff(first) - GRAM + 1, 0)
    own = np.append(0, np.cumsum(n))
    i = np.arange(own[-1]) + np.repeat(first[:-1] - own[:-1], n)
    return RollingHash(data).ranges(bounds[i], bounds[i + GRAM]) & np.uint64(SLOTS - 1), own


@dataclass
class Model:
    words: np.ndarray
    grams: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * (raw + self.bias) + self.shift, -30, 30)))


def _shares(total: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = end - first
    return np.where(n > 0, (total[end] - total[first]) / np.maximum(n, 1), 0.0)


def raw_scores(model: Model, data: np.ndarray, offs: np.ndarray, words: Words) -> np.ndarray:
    w = np.zeros(len(words) + 1)
    np.cumsum(model.words[words.hash & np.uint64(SLOTS - 1)], out=w[1:])
    g, first = _grams(data, offs)
    c = np.zeros(len(g) + 1)
    np.cumsum(model.grams[g], out=c[1:])
    return SCALE * (_shares(w, words.first[:-1], words.first[1:]) + _shares(c, first[:-1], first[1:]))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: dict[str, list] = {"doc_id": b.column("doc_id").to_pylist(), "label": b.column("label").to_pylist(), "slots": [], "values": []}
        for _, _, data, offs in slices(b.column("text")):
            words = Words(data, offs, lower=False)
            grams, first = _grams(data, offs)
            for d in range(len(offs) - 1):
                w = words.hash[words.first[d] : words.first[d + 1]] & np.uint64(SLOTS - 1)
                g = grams[first[d] : first[d + 1]]
                slots, values = [], []
                for x, base in ((w, 0), (g, SLOTS)):
                    if len(x):
                        s, n = np.unique(x, return_counts=True)
                        slots.append(s.astype(np.int32) + base)
                        values.append((SCALE * n / len(x)).astype(np.float32))
                out["slots"].append(b"".join(x.tobytes() for x in slots))
                out["values"].append(b"".join(x.tobytes() for x in values))
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(out["doc_id"], pa.int64()), "label": pa.array(out["label"], pa.int32()), "slots": pa.array(out["slots"], pa.binary()), "values": pa.array(out["values"], pa.binary())})


def _descend(loss_gradient, size: int, steps: int, rate: float) -> np.ndarray:
    """Adam on the full batch."""
    x, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = loss_gradient(x)
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x


def train(rows: list[tuple[int, int, bytes, bytes]], steps: int = 120) -> Model:
    """From (doc_id, label, slots, values), in any order.  Without rows of both labels, a model that keeps everything."""
    zero = Model(np.zeros(SLOTS, np.float32), np.zeros(SLOTS, np.float32), 0.0, 1.0, 10.0)
    if len({r[1] for r in rows}) < 2:
        return zero
    rows = sorted(rows)
    held = mix(np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64)) % np.uint64(5) == 0
    y = np.array([r[1] for r in rows], dtype=float)
    idx = [np.frombuffer(r[2], np.int32) for r in rows]
    doc = np.repeat(np.arange(len(rows)), [len(i) for i in idx])
    idx, val = np.concatenate(idx), np.concatenate([np.frombuffer(r[3], np.float32) for r in rows]).astype(float)
    fit = ~held if len(set(y[~held])) == 2 else np.ones(len(rows), bool)
    each = np.where(y > 0, 0.5 / max(1, (y[fit] > 0).sum()), 0.5 / max(1, (y[fit] == 0).sum())) * fit  # both labels weigh the same

    def gradient(x: np.ndarray) -> np.ndarray:
        raw = np.bincount(doc, x[idx] * val, len(rows)) + x[-1]
        err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y) * each
        g = np.bincount(idx, err[doc] * val, 2 * SLOTS + 1) + 1e-5 * x
        g[-1] = err.sum()
        return g

    x = _descend(gradient, 2 * SLOTS + 1, steps, 0.05)
    raw = np.bincount(doc, x[idx] * val, len(rows)) + x[-1]
    test = held if len(set(y[held])) == 2 else fit

    def platt(p: np.ndarray) -> np.ndarray:
        err = (1 / (1 + np.exp(-np.clip((1 + p[0]) * raw[test] + p[1], -30, 30))) - y[test]) / test.sum()
        return np.array([(err * raw[test]).sum(), err.sum()])

    p = _descend(platt, 2, 300, 0.05)
    return Model(x[:SLOTS].astype(np.float32), x[SLOTS:-1].astype(np.float32), float(x[-1]), float(1 + p[0]), float(p[1]))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, keep=None) -> Model:
    """A model of ``labels.quality``, from a bounded sample of labelled documents."""
    found = sample(docs, labels, "quality", rows, keep).mapInArrow(_features, "doc_id long, label int, slots binary, values binary").collect()
    return train([tuple(r) for r in found])


def measures(data: np.ndarray, offs: np.ndarray, words: Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each document of a slice."""
    n = np.diff(words.first)

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total

    solid = ~SPACE[data]
    chars = count(solid & ((data & 0xC0) != 0x80))
    symbols = count(SYMBOLS[data])
    solid = count(solid)
    # lines, each within one document
    breaks = np.flatnonzero(data == 10)
    starts, line_end = np.sort(np.concatenate([breaks + 1, offs[:-1]])), np.sort(np.concatenate([breaks, offs[1:]]))
    full = solid[line_end] > solid[starts]
    starts, line_end = starts[full], line_end[full]
    line_doc = np.searchsorted(offs, starts, side="right") - 1
    key = mix(RollingHash(data).ranges(starts, line_end) + line_doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    dup = np.bincount(line_doc[order[1:]][same], minlength=len(n)).astype(np.int64)
    # 3-word windows
    h = words.hash
    m = max(0, len(h) - 2)
    inside = words.doc[:m] == words.doc[len(h) - m :] if m else np.zeros(0, bool)
    key = mix(h[:m] * np.uint64(3) + mix(h[1 : m + 1]) * np.uint64(5) + mix(h[2 : m + 2] + np.uint64(1)) + words.doc[:m].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) if m else np.zeros(0, np.uint64)
    at = np.flatnonzero(inside)
    order = at[np.argsort(key[at])]
    same = key[order][1:] == key[order][:-1]
    covered = np.zeros(len(h) + 2, bool)
    for hits in (order[1:][same], order[:-1][same]):
        for i in range(3):
            covered[hits + i] = True
    repeat = np.bincount(words.doc[covered[: len(h)]], minlength=len(n)).astype(np.int64)
    return {"n_words": n.astype(np.int64), "word_chars": np.diff(chars[offs]), "n_symbols": np.diff(symbols[offs]), "n_dup_lines": dup, "n_repeat_words": repeat}


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"


def judge(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Counts and verdict for each document, from its whole text.

    A null text counts as empty, and empty texts fail the base rules; a null id is
    passed on; repeated rows are judged alike, each for itself; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in slices(b.column("text")):
                words = Words(data, offs, lower=False)
                m = measures(data, offs, words)
                failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
                p = model.probability(raw_scores(model, data, offs, words))
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id")[i:j]} | m | {"base_failed": failed, "kept": ~failed & (p >= threshold), "probability": p})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def op9(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return judge(docs, fit(docs, labels)).drop("probability")
