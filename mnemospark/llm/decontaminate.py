"""Benchmark decontamination by latent semantic retrieval.

Operator 7.  Words hash to SLOTS slots; those of the benchmark items get an IDF
weight from all documents.  A distributed randomised SVD of the items' TF-IDF rows
(A^T A applied to a thin random basis, block by block, then orthonormalised) gives
the latent space; a basis of the items keeps the inner product with each item,
where one of the corpus would drop the rare words that mark a passage.  Windows of
each document, of lengths that follow the items', are projected; where the share of an item that a window holds is high
enough, the longest common subsequence of words and a check of the item's last part
(the answer) decide, so that passages with words changed, dropped or inserted are
found too.  Where the window's cosine with the item is low (the item's words are
common ones, or few beside rarer words of other items), the subsequence must lie in
a span not much longer than the item.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm._arrays import ALNUM, Words, slices

SLOTS = 1 << 18
RANK = 256
WINDOW, STEP = 48, 24
#: Items of more words than this take windows and steps of twice the length, from twice as many again twice that, and so on.
LONGEST = 60
#: A window is a candidate for an item from this share of the item's weight; below this cosine in the latent space, words in order count within SPAN times the item's length.
LEAST_COSINE, LEAST_SHARE = 0.3, 0.3
SPAN = 1.5
#: Leaks: so much of the item's words in order; or less of them if the answer is there too.
LEAST_LCS, LEAST_LCS_WITH_ANSWER, LEAST_ANSWER = 0.75, 0.6, 0.6
#: Items of fewer words count only when found whole.
SHORT = 8
#: Words of the benchmark in one index, about: larger benchmarks are searched in parts, each with an index of its own.  An index
#: has at most as many rows of RANK floats as its part has different words and items.
PART_WORDS = 1 << 18
_BLOCK = 4096


def _lowered(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.lower(F.col(text_col)).alias("text"))


def _words(data: np.ndarray, offs: np.ndarray) -> Words:
    return Words(data, offs, lower=True, inside=ALNUM)


@dataclass
class Index:
    """place: of a slot, its row + 1 in weights and basis, or 0.  items: (id, word hashes).  lengths: for windows of WINDOW << c words, their items' places and the least squared weight that holds one of them once."""

    place: np.ndarray
    weights: np.ndarray
    basis: np.ndarray
    items: list[tuple[int, np.ndarray]]
    latent: np.ndarray
    norms: np.ndarray
    lengths: list[tuple[np.ndarray, float]]


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, data, offs in slices(b.column("text")):
            w = _words(data, offs)
            own = [w.hash[w.first[d] : w.first[d + 1]].view(np.int64) for d in range(j - i)]
            yield pa.RecordBatch.from_pydict({"id": b.column("id")[i:j], "words": pa.array(own, pa.list_(pa.int64()))})


def _frequencies(place: np.ndarray, terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms + 1, np.int64)
        for b in batches:
            for _, _, data, offs in slices(b.column("text")):
                w = _words(data, offs)
                p = place[(w.hash & np.uint64(SLOTS - 1)).astype(np.int64)]
                own = np.unique(w.doc[p > 0] * (terms + 1) + p[p > 0])
                total += np.bincount(own % (terms + 1), minlength=terms + 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"p": at.astype(np.int64), "c": total[at]})

    return run


def _rows(words: list[np.ndarray], place: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Unit TF-IDF rows of items."""
    a = np.zeros((len(words), len(weights)), np.float32)
    for r, w in enumerate(words):
        np.add.at(a[r], place[(w.view(np.uint64) & np.uint64(SLOTS - 1)).astype(np.int64)], 1)
    a *= weights
    return a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-9)


def _applied(items: DataFrame, place: np.ndarray, weights: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A^T A basis, summed over the items' partitions in blocks of rows."""
    width = basis.shape[1]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(basis.shape, np.float64)
        for b in batches:
            words = [np.array(x, dtype=np.int64) for x in b.column("words").to_pylist()]
            for i in range(0, len(words), 64):
                a = _rows(words[i : i + 64], place, weights)
                total += a.T @ (a @ basis)
        cuts = range(0, len(total), _BLOCK)
        yield pa.RecordBatch.from_pydict({"block": pa.array(list(cuts), pa.int64()), "data": pa.array([total[i : i + _BLOCK].tobytes() for i in cuts], pa.binary())})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": pdf.block[:1], "data": [sum(np.frombuffer(x) for x in pdf.data).tobytes()]})

    found = items.mapInArrow(partial, "block long, data binary").groupBy("block").applyInPandas(add, "block long, data binary").collect()
    out = np.zeros(basis.shape)
    for block, data in found:
        out[block : block + _BLOCK] = np.frombuffer(data).reshape(-1, width)
    return out


def index(docs: DataFrame, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", rank: int = RANK, seed: int = 5) -> Index | None:
    """The latent index of a benchmark, or of a part of one; None if it has no words.  Its size is bounded by SLOTS x RANK and the items."""
    items = _lowered(benchmark, id_col, text_col).where("id IS NOT NULL").mapInArrow(_item_words, "id long, words array<long>")
    own = sorted((r[0], np.array(r[1], dtype=np.int64)) for r in items.collect() if r[1])
    if not own:
        return None
    used = np.unique(np.concatenate([w for _, w in own]).view(np.uint64) & np.uint64(SLOTS - 1)).astype(np.int64)
    place = np.zeros(SLOTS, np.int32)
    place[used] = np.arange(1, len(used) + 1)
    n = docs.count()
    counts = _lowered(docs, "doc_id", "text").mapInArrow(_frequencies(place, len(used)), "p long, c long").groupBy("p").agg(F.sum("c").alias("c")).collect()
    df = np.zeros(len(used) + 1)
    for p, c in counts:
        df[p] = c
    weights = (np.maximum(0, np.log((n + 1) / (df + 1))) + 1).astype(np.float32)  # 1 at least: no item is without weight
    weights[0] = 0
    width = min(rank + 8, len(own), len(used))
    basis = np.random.default_rng(seed).normal(size=(len(used) + 1, width)).astype(np.float32)
    for _ in range(2):
        basis = np.linalg.qr(_applied(items, place, weights, basis))[0].astype(np.float32)
    # Rayleigh-Ritz: the singular directions inside the found subspace.
    values, turn = np.linalg.eigh(basis.T.astype(float) @ _applied(items, place, weights, basis))
    keep = np.argsort(-values)[:rank]
    basis = (basis @ turn[:, keep[values[keep] > 1e-9]].astype(np.float32)).astype(np.float32)
    raw = np.zeros((len(own), basis.shape[1]), np.float32)
    for i in range(0, len(own), 256):
        part = [w for _, w in own[i : i + 256]]
        for r, w in enumerate(part):
            p = place[(w.view(np.uint64) & np.uint64(SLOTS - 1)).astype(np.int64)]
            raw[i + r] = (basis[p] * weights[p][:, None]).sum(axis=0)
    norms = np.maximum((raw**2).sum(axis=1), 1e-9)
    repeats = np.array([np.unique(w.view(np.uint64) & np.uint64(SLOTS - 1), return_counts=True)[1].max() for _, w in own])
    size = np.array([len(w) for _, w in own])
    level = np.maximum(0, np.ceil(np.log2(size / LONGEST))).astype(int)
    groups = [np.flatnonzero(level == c) for c in range(level.max() + 1)]
    lengths = [(g, float((norms[g] / repeats[g]).min(initial=np.inf))) for g in groups]
    return Index(place, weights, basis * weights[:, None], own, raw, norms, lengths)


def indexes(docs: DataFrame, benchmark: DataFrame, part_words: int = PART_WORDS) -> Iterator[Index]:
    """Indexes of the parts of a benchmark, so that none outgrows what a task and the driver can hold."""
    words = _lowered(benchmark, "item_id", "text").mapInArrow(_item_words, "id long, words array<long>").agg(F.sum(F.size("words"))).first()[0] or 0
    parts = max(1, -(-words // part_words))
    for i in range(parts):
        ix = index(docs, benchmark.where(F.pmod(F.xxhash64(F.col("item_id").cast("long")), F.lit(parts)) == i))
        if ix is not None:
            yield ix


def lcs(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over the item."""
    at: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in text.tolist():
        m = at.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def shares(item: np.ndarray, text: np.ndarray) -> tuple[float, float]:
    """Shares in order of an item and of its last third."""
    answer = item[-max(1, len(item) // 3) :]
    return lcs(item, text) / len(item), lcs(answer, text) / len(answer)


def leaked(item: np.ndarray, share: float, said: float) -> bool:
    return share >= (1 if len(item) < SHORT else LEAST_LCS) or len(item) >= SHORT and share >= LEAST_LCS_WITH_ANSWER and said >= LEAST_ANSWER


def narrow_shares(item: np.ndarray, text: np.ndarray) -> tuple[float, float]:
    """The best shares of an item over spans of the text of SPAN times its length."""
    width, step = max(len(item), int(len(item) * SPAN)), max(1, len(item) // 8)
    best = (0.0, 0.0)
    for s in range(0, max(1, len(text) - width + step), step):
        best = max(best, shares(item, text[s : s + width]), key=lambda x: (leaked(item, *x), x))
        if best == (1, 1):
            break
    return best


def leaks_of(ix: Index, words: Words, docs: int) -> list[tuple[int, int, float, float, float]]:
    """(document, place of the item, cosine, share in order, share of the answer) of the leaks of a slice."""
    p = ix.place[(words.hash & np.uint64(SLOTS - 1)).astype(np.int64)]
    hit = np.flatnonzero(p)
    mass = np.zeros(len(p) + 1)
    np.cumsum(ix.weights[p].astype(float) ** 2, out=mass[1:])
    n = np.diff(words.first)
    grids = []  # for each length: documents, starts, ends of its steps, whether the document's last, and the windows (their first steps) that can hold an item
    need = np.zeros(int((-(-n // STEP)).sum()), bool)
    for c, (_, least) in enumerate(ix.lengths):
        count = -(-n // (STEP << c))
        doc = np.repeat(np.arange(docs), count)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        start = words.first[doc] + nth * (STEP << c)
        end = np.minimum(start + (WINDOW << c), words.first[doc + 1])
        last = nth == count[doc] - 1
        # Each word of a window adds its squared weight to the inner product as often as the item has it: with less weight no item is held (twice the room for the latent space).
        full = np.flatnonzero(((nth == 0) | ~last) & (mass[end] - mass[start] >= 0.5 * LEAST_SHARE * least))
        grids.append((doc, start, end, last, nth, full))
        before = np.cumsum(-(-n // STEP)) - -(-n // STEP)
        cover = np.zeros(len(need) + 1, np.int64)
        np.add.at(cover, before[doc[full]] + (nth[full] << c), 1)
        np.add.at(cover, before[doc[full]] + -(-(end[full] - words.first[doc[full]]) // STEP), -1)
        need |= np.cumsum(cover[:-1]) > 0
    # Latent vectors of the steps of STEP words; longer windows add those of shorter ones.
    sums = np.zeros((len(need), ix.basis.shape[1]), np.float32)
    if len(need):
        _, start, _, _, _, _ = grids[0]
        end = np.minimum(start + STEP, words.first[grids[0][0] + 1])
        a, b = np.searchsorted(hit, start), np.searchsorted(hit, end)
        used = np.flatnonzero(need & (b > a))
        for i in range(0, len(used), 2048):
            at = used[i : i + 2048]
            size = b[at] - a[at]
            first = np.cumsum(size) - size
            flat = p[hit[np.arange(size.sum()) + np.repeat(a[at] - first, size)]]
            sums[at] = np.add.reduceat(ix.basis[flat], first, axis=0)
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    for c, (group, _) in enumerate(ix.lengths):
        doc, start, end, last, nth, full = grids[c]
        if c and len(sums):
            sums = np.add.reduceat(sums, np.flatnonzero(grids[c - 1][4] % 2 == 0), axis=0)
        latent, norms = ix.latent[group], ix.norms[group]
        for i in range(0, len(full) if len(group) else 0, 2048):
            at = full[i : i + 2048]
            x = sums[at]
            two = ~last[at]
            x[two] += sums[at[two] + 1]
            dots = x @ latent.T
            cosine = dots / (np.linalg.norm(x, axis=1, keepdims=True) * np.sqrt(norms) + 1e-9)
            for r, g in zip(*np.nonzero(dots >= LEAST_SHARE * norms), strict=True):
                t = int(group[g])
                d, item = int(doc[at[r]]), ix.items[t][1]
                lo = max(words.first[d], start[at[r]] - len(item))
                hi = min(words.first[d + 1], end[at[r]] + len(item))
                text = words.hash[lo:hi].view(np.int64)
                share, said = shares(item, text)
                if cosine[r, g] < LEAST_COSINE and leaked(item, share, said):
                    share, said = narrow_shares(item, text)
                if leaked(item, share, said):
                    best[d, t] = max(best.get((d, t), (0.0, 0.0, 0.0)), (float(share), float(said), float(cosine[r, g])))
    return [(d, t, c, share, said) for (d, t), (share, said, c) in sorted(best.items())]


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share, answer_share) of each benchmark item found in a document.

    Null and empty texts and items hold nothing; items without id are ignored; rows
    with null ids are searched too; repeated rows give repeated results; without
    items the result is empty.
    """
    schema = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double"
    found = []
    for ix in indexes(docs, benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(ix)  # of PART_WORDS words

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ix = shared.value
            for b in batches:
                for i, j, data, offs in slices(b.column("text")):
                    leaks = leaks_of(ix, _words(data, offs), j - i)
                    ids = b.column("id")
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([ids[i + f[0]].as_py() for f in leaks], pa.int64()), "item_id": pa.array([ix.items[f[1]][0] for f in leaks], pa.int64())} | {c: pa.array([f[k] for f in leaks], pa.float64()) for k, c in ((2, "cosine"), (3, "lcs_share"), (4, "answer_share"))})

        found.append(_lowered(docs, "doc_id", "text").mapInArrow(run, schema))
    return reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a benchmark item; rows and columns are otherwise untouched, and nothing is shuffled."""
    columns, schema, low = docs.columns, docs.schema, f"lowered-{uuid.uuid4().hex}"
    kept = docs
    for ix in indexes(docs, benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(ix)  # of PART_WORDS words

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                held = np.zeros(b.num_rows, bool)
                for i, j, data, offs in slices(b.column(low)):
                    for f in leaks_of(shared.value, _words(data, offs), j - i):
                        held[i + f[0]] = True
                yield b.select(columns).filter(pa.array(~held))

        kept = kept.withColumn(low, F.lower("text")).mapInArrow(run, schema)
    return kept


def op7(spark, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
