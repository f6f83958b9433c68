"""Toxicity: a factorization machine over hashed terms.

Operator 10.  score = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j) where
x_i says whether a term of hash slot i occurs.  The pairwise part finds pairs, such
as an insult with a group mention, that a sum of weights misses.  Fitted on a
bounded sample of labelled rows (SAMPLE_ROWS), in one task.  Slots have weights if the sample
links them with the label, alone (|z| from LEAST_Z) or in a pair whose four cells
(both, one, the other, none) aren't additive (|z| from LEAST_PAIR_Z): so terms that
are harmless alone are kept for the pairs that they form.  Both tests look at the pair
alone: how many other terms there are changes nothing.  Terms are runs of letters,
digits and non-ASCII characters, so marks around a word hide nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm._arrays import ALNUM, Words, give_back, slices
from mnemospark.llm._labelled import sample

#: Labelled rows that the model is fitted on, at most.
SAMPLE_ROWS = 8000
SLOTS = 1 << 20
RANK = 8
LEAST_Z = 4.0
LEAST_PAIR_Z = 8.0
#: Terms that can form such pairs: in a 64th of the rows at least, or in so many rows of label 1 as a pair must share to show.
COMMON = 64
BLOCK = 512
THRESHOLD = 0.7


@dataclass
class Model:
    """index: of a slot, its place + 1 in weights and factors, or 0."""

    index: np.ndarray
    weights: np.ndarray
    factors: np.ndarray
    bias: float

    def logits(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Of n documents, from distinct (document, place) pairs."""
        out = self.bias + np.bincount(doc, self.weights[term], n)
        v = self.factors[term]
        for f in range(v.shape[1]):
            out += 0.5 * (np.bincount(doc, v[:, f], n) ** 2 - np.bincount(doc, v[:, f] ** 2, n))
        return out


def _slots(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, slot) of every term occurrence of a slice."""
    w = Words(data, offs, lower=True, inside=ALNUM)
    return w.doc, (w.hash & np.uint64(SLOTS - 1)).astype(np.int64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = []
        for _, _, data, offs in slices(b.column("text")):
            doc, slot = _slots(data, offs)
            cut = np.searchsorted(doc, np.arange(len(offs)))
            found += [np.unique(slot[cut[d] : cut[d + 1]]).astype(np.int32).tobytes() for d in range(len(offs) - 1)]
        yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "label": b.column("label"), "slots": pa.array(found, pa.binary())})


def fewest(p: float) -> int:
    """In how many rows of label 1 a pair must occur to reach LEAST_PAIR_Z, when p of all rows have it and neither term alone ever does."""
    m = 1
    while ((m + 4 * p) / (m + 4) + p) / np.sqrt(p * (1 - p) / (m + 4)) < LEAST_PAIR_Z:
        m += 1
    return m


def paired(doc: np.ndarray, slot: np.ndarray, y: np.ndarray, df: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Slots of pairs that tell more of the label than the sum of both, from distinct (document, slot) pairs.

    All pairs of the terms that can form one are looked at, a block of terms against another.
    """
    n, p = len(y), y.mean()
    terms = np.flatnonzero(((df * COMMON >= n) | (hits >= fewest(p))) & (df >= 8) & (df <= n - 8))
    at = np.full(SLOTS, -1, np.int32)
    at[terms] = np.arange(len(terms))
    mine = np.flatnonzero(at[slot] >= 0)
    mine = mine[np.argsort(at[slot[mine]], kind="stable")]
    own, doc = at[slot[mine]], doc[mine]
    first = np.searchsorted(own, np.arange(0, len(terms) + BLOCK, BLOCK))
    toxic = np.flatnonzero(y > 0)
    best = np.zeros(len(terms))

    def block(i: int) -> np.ndarray:
        x = np.zeros((n, min(BLOCK, len(terms) - i * BLOCK)), np.float32)
        x[doc[first[i] : first[i + 1]], own[first[i] : first[i + 1]] - i * BLOCK] = 1
        return x

    for i in range(len(first) - 1):
        a = block(i)
        a_toxic, a_all, a_hits = a[toxic], a.sum(axis=0)[:, None], a[toxic].sum(axis=0)[:, None]
        for j in range(i, len(first) - 1):
            b = a if i == j else block(j)
            b_toxic, b_all, b_hits = b[toxic], b.sum(axis=0)[None, :], b[toxic].sum(axis=0)[None, :]
            both, found = a.T @ b, a_toxic.T @ b_toxic
            contrast, noise = np.zeros_like(both), np.zeros_like(both)
            for sign, cell, label in ((1, both, found), (-1, a_all - both, a_hits - found), (-1, b_all - both, b_hits - found), (1, n - a_all - b_all + both, len(toxic) - a_hits - b_hits + found)):
                # Rates are drawn to the mean by four documents' worth of it.
                contrast += sign * (label + 4 * p) / (cell + 4)
                noise += p * (1 - p) / (cell + 4)
            z = np.abs(contrast) / np.sqrt(noise)
            if i == j:
                np.fill_diagonal(z, 0)
            rows, cols = best[i * BLOCK : i * BLOCK + z.shape[0]], best[j * BLOCK : j * BLOCK + z.shape[1]]
            np.maximum(rows, z.max(axis=1), out=rows)
            np.maximum(cols, z.max(axis=0), out=cols)
    return terms[best >= LEAST_PAIR_Z]


def _nothing() -> Model:
    return Model(np.zeros(SLOTS, np.int32), np.zeros(1), np.zeros((1, RANK)), float(np.log(0.01 / 0.99)))


def train(rows: list[tuple[int, int, bytes]], steps: int = 150, seed: int = 1) -> Model:
    """From (doc_id, label, slots), in any order.  Without rows of both labels, every score is 0.01."""
    if len({r[1] for r in rows}) < 2:
        return _nothing()
    rows = sorted(rows)
    y = np.array([r[1] for r in rows], dtype=np.float32)
    each = [np.frombuffer(r[2], np.int32) for r in rows]
    doc, slot = np.repeat(np.arange(len(rows), dtype=np.int32), [len(x) for x in each]), np.concatenate(each)
    df, hits = np.bincount(slot, minlength=SLOTS), np.bincount(slot, y[doc], SLOTS)
    p = float(y.mean())
    # How far a slot's share of toxic documents lies off the mean, in standard errors of a smoothed share.
    z = (hits - df * p) / np.sqrt((df + 4) * p * (1 - p))
    strong = np.union1d(np.flatnonzero((np.abs(z) >= LEAST_Z) & (df >= 3)), paired(doc, slot, y, df, hits))
    index = np.zeros(SLOTS, np.int32)
    index[strong] = np.arange(1, len(strong) + 1)
    n, k = len(rows), len(strong) + 1
    term = index[slot]
    doc, term = doc[term > 0], term[term > 0]
    del slot, each, rows
    # (first row, rows, row and term of each cell, cells in order of term, where a term begins, the terms) of some rows at a time
    parts = []
    cuts = np.searchsorted(doc, np.arange(0, n + 500, 500))
    for i, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        order = np.argsort(term[s:e], kind="stable").astype(np.int32)
        begin = np.flatnonzero(np.append(True, np.diff(term[s:e][order]) != 0)) if e > s else np.zeros(0, np.int64)
        parts.append((i * 500, min(500, n - i * 500), doc[s:e] - i * 500, term[s:e], order, begin, term[s:e][order][begin]))
    del doc, term
    w, v, bias = np.zeros(k, np.float32), np.random.default_rng(seed).normal(0, 0.05, (k, RANK)).astype(np.float32), np.array([np.log(p / (1 - p))])
    moments = [(np.zeros_like(g), np.zeros_like(g)) for g in (w, v, bias)]
    for t in range(1, steps + 1):
        pull, miss = np.zeros((k, RANK + 1), np.float32), 0.0
        for at, size, own, terms, order, begin, names in parts:
            if not size:
                continue
            first = np.searchsorted(own, np.arange(size + 1))
            mine = np.concatenate([w[terms, None], v[terms], np.square(v[terms]).sum(axis=1, keepdims=True)], axis=1)
            sums = np.zeros((size, RANK + 2), np.float32)
            full = np.flatnonzero(np.diff(first))
            if len(full):
                sums[full] = np.add.reduceat(mine, first[:-1][full], axis=0)
            z = bias[0] + sums[:, 0] + 0.5 * (np.square(sums[:, 1:-1]).sum(axis=1) - sums[:, -1])
            err = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[at : at + size]) / n).astype(np.float32)
            miss += float(err.sum())
            if len(begin):
                cell = np.concatenate([err[:, None], err[:, None] * sums[:, 1:-1]], axis=1)[own[order]]
                pull[names] += np.add.reduceat(cell, begin, axis=0)
        for value, g, (m, u) in ((w, pull[:, 0] + 1e-5 * w, moments[0]), (v, pull[:, 1:] - pull[:, :1] * v + 1e-4 * v, moments[1]), (bias, np.array([miss]), moments[2])):
            m += 0.1 * (g - m)
            u += 0.001 * (g * g - u)
            value -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(u / (1 - 0.999**t)) + 1e-8)
    model = Model(index, w.astype(float), v.astype(float), float(bias[0]))
    model.weights[0] = 0
    model.factors[0] = 0
    return model


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of all rows as rows: the bias under slot -1, and the kept slots."""
    model = train([tuple(r.values()) for b in batches for r in b.to_pylist()])
    give_back()
    slots = np.flatnonzero(model.index)
    values = np.concatenate([model.weights[model.index[slots], None], model.factors[model.index[slots]]], axis=1)
    yield pa.RecordBatch.from_pydict({"slot": pa.array([-1, *slots.tolist()], pa.int32()), "numbers": pa.array([np.array([model.bias]).tobytes(), *(x.tobytes() for x in values)], pa.binary())})


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, keep=None) -> Model:
    """A model of ``labels.toxic``, from a bounded sample of labelled documents, which meet in one task; the driver gets the model's rows."""
    found = sample(docs, labels, "toxic", rows, keep).mapInArrow(_features, "doc_id long, label int, slots binary").repartition(1).mapInArrow(_trained, "slot int, numbers binary").collect()
    if not found:
        return _nothing()
    found = sorted(found)
    numbers = np.array([np.frombuffer(r.numbers, float) for r in found[1:]]).reshape(-1, RANK + 1)
    model = Model(np.zeros(SLOTS, np.int32), np.append(0.0, numbers[:, 0]), np.concatenate([np.zeros((1, RANK)), numbers[:, 1:]]), float(np.frombuffer(found[0].numbers, float)[0]))
    model.index[[r.slot for r in found[1:]]] = np.arange(1, len(found))
    del found, numbers
    give_back()
    return model


def _scores(model: Model, text: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end row, scores) of slices of a column."""
    k = len(model.weights)
    for i, j, data, offs in slices(text):
        doc, slot = _slots(data, offs)
        term = model.index[slot].astype(np.int64)
        pair = np.unique(doc[term > 0] * k + term[term > 0])
        yield i, j, 1 / (1 + np.exp(-np.clip(model.logits(pair // k, pair % k, j - i), -30, 30)))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of each document, from its whole text.

    Null and empty texts get the model's base score; a null id is passed on;
    repeated rows are scored alike; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, s in _scores(model, b.column("text")):
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id")[i:j], "score": s, "predicted": (s >= threshold).astype(np.int32)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score ``threshold`` or more; columns are untouched and nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for i, j, s in _scores(model, b.column("text")):
                keep[i:j] = s < threshold
            yield b.filter(pa.array(keep))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def learn_rows():
    """The labels that may be learnt from, as a Column (a session must exist)."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1


def op10(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score(docs, fit(docs, labels, keep=learn_rows()))
    return out.select("doc_id", F.coalesce(~learn_rows(), F.lit(False)).alias("held_out"), "score", "predicted")
