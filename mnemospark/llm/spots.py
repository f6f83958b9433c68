"""Document fingerprints: SpotSigs, chains of content words that follow common words.

Operator 13.  Wherever an anchor (an article or a form of "to be") stands, the next
CHAIN content words and the anchor form a signature; a fingerprint is the sorted set of
a text's signatures, so it depends on the text alone.  Sets are compared by Jaccard,
and pairs whose set lengths already exclude the wanted likeness are never compared:
``near_pairs`` partitions sets by length and joins within a partition and its neighbour.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm._arrays import ALNUM, Words, mix, slices

CHAIN = 2
#: Common words of English, German, French and Spanish, in that order; the anchors are articles and forms of "to be".
ANCHORS = "a an the is are was were be been der die das den dem des ein eine einen einem einer ist sind war waren le la les un une est sont était el los las una es son era fue"
COMMON = ANCHORS + " of and to in that it for on with as by this at from or not but have has had he she they you we i und in von zu mit sich auf für im nicht als auch an am er sie es wir ich hat haben de et du que pour par qui dans avec sur pas au aux en il elle ne ce se plus y del por con no su para al lo como más o si"
#: Of other words, those whose hash is a multiple of this are anchors too, so that texts without articles (tables, other languages) have signatures.
RARE_ANCHOR = 16
#: Documents in a bucket of neighbouring ids, about.
BUCKET_ROWS = 100_000
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


@lru_cache
def _hashes(words: str) -> np.ndarray:
    data = np.frombuffer(words.encode(), np.uint8)
    return np.unique(Words(data, np.array([0, len(data)]), lower=True, inside=ALNUM).hash)


def signatures(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct 32-bit signatures of each document of a slice.

    The start of a text counts as an anchor, and in a text of common words alone each
    word is content: only texts without words have no signature.  The last chains of a
    text may be shorter.
    """
    w = Words(data, offs, lower=True, inside=ALNUM)
    h, n = w.hash, len(offs) - 1
    content = ~np.isin(h, _hashes(COMMON))
    content |= (np.bincount(w.doc[content], minlength=n) == 0)[w.doc]
    spots = np.flatnonzero(np.isin(h, _hashes(ANCHORS)) | (content & (h % np.uint64(RARE_ANCHOR) == 0)))
    chain = np.append(np.flatnonzero(content), len(h))
    # (document, hash, first word that may follow) of every anchor, starts of texts first
    full = np.flatnonzero(np.diff(w.first))
    doc = np.concatenate([full, w.doc[spots]])
    sig = np.concatenate([np.full(len(full), 1, np.uint64), h[spots]]) * _A
    k = np.searchsorted(chain, np.concatenate([w.first[full], spots + 1]))
    own = np.append(w.doc, n)
    codes = np.append(h, np.uint64(0))
    alive = np.ones(len(doc), bool)
    for i in range(CHAIN):
        at = chain[np.minimum(k + i, len(chain) - 1)]
        here = own[at] == doc
        if i == 0:
            alive = here
        sig = mix(sig + np.where(here, codes[at], np.uint64(7)) * _B + _C)
    key = np.unique((doc[alive].astype(np.uint64) << np.uint64(32)) | (sig[alive] >> np.uint64(32)))
    return np.split((key & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.searchsorted(key >> np.uint64(32), np.arange(1, n)))


def text_of(signs: np.ndarray) -> str:
    """A fingerprint as text: eight hexadecimal digits for each signature, ascending."""
    return signs.astype(">u4").tobytes().hex()


def signs_of(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray, at_least: float = 0.0) -> float:
    """Jaccard of two sorted sets, or 0 as soon as set lengths or the ranges of their members exclude ``at_least``; two empty sets are alike."""
    if not len(a) and not len(b):
        return 1.0
    few, many = sorted((len(a), len(b)))
    if not few or few < at_least * many or a[0] > b[-1] or b[0] > a[-1]:
        return 0.0
    shared = int(np.isin(a, b, assume_unique=True).sum())
    found = shared / (few + many - shared)
    return found if found >= at_least else 0.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of each row, from its whole text; nothing is shuffled.

    Null texts count as empty and have the empty fingerprint; a null id is passed on;
    equal texts have equal fingerprints, repeated rows included; other columns are
    ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in slices(b.column("raw")):
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[i:j], pa.array([text_of(s) for s in signatures(data, offs)], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("raw")).mapInArrow(run, "doc_id long, fingerprint string")


def near_pairs(prints: DataFrame, percent: int = 80) -> DataFrame:
    """(a, b, likeness) of the pairs of different fingerprints with 100 x shared >= percent x all, a < b being the least doc_id of each fingerprint.

    ``prints`` is what ``fingerprints`` gives; documents of one fingerprint are one member
    (join on the fingerprint for the others), empty fingerprints have no partner.  Sets are
    dealt to partitions of lengths that differ by the threshold at most, so a set only
    meets sets of its own and the next partition; there, candidates share one of their
    rarest signatures (so many that two sets without a common one can't be near).
    """
    t = percent / 100
    sets = prints.where("doc_id is not null and fingerprint != ''").groupBy("fingerprint").agg(F.min("doc_id").alias("id"))
    sets = sets.select("id", "fingerprint", (F.length("fingerprint") / 8).cast("int").alias("n"))
    signs = sets.select("id", "n", F.explode(F.expr("transform(sequence(0, n - 1), i -> substring(fingerprint, 8 * i + 1, 8))")).alias("sign"))
    often = signs.groupBy("sign").agg(F.count(F.lit(1)).alias("df"))
    ordered = signs.join(often, "sign").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "sign"))).alias("signs"))
    first = F.slice("signs", F.lit(1), (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int"))
    rare = ordered.select("id", "n", F.floor(F.log("n") / math.log(1 / t) if percent < 100 else F.col("n")).cast("int").alias("part"), F.explode(first).alias("x")).select("id", "n", "part", F.col("x.sign").alias("sign"))
    small = rare.select("id", "n", "sign", F.explode(F.array("part", F.col("part") + 1)).alias("part")).alias("s")
    large = rare.alias("l")
    smaller = F.struct("s.n", "s.id") < F.struct("l.n", "l.id")
    pairs = small.join(large, (F.col("s.part") == F.col("l.part")) & (F.col("s.sign") == F.col("l.sign")) & smaller & (100 * F.col("s.n") >= percent * F.col("l.n")))
    pairs = pairs.select(F.least("s.id", "l.id").alias("a"), F.greatest("s.id", "l.id").alias("b")).distinct()
    own = sets.select("id", "fingerprint")
    pairs = pairs.join(own.select(F.col("id").alias("a"), F.col("fingerprint").alias("x")), "a").join(own.select(F.col("id").alias("b"), F.col("fingerprint").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in batches:
            shares = [likeness(signs_of(x), signs_of(y), t - 1e-9) for x, y in zip(c.column("x").to_pylist(), c.column("y").to_pylist(), strict=True)]
            keep = pa.array([s > 0 for s in shares])
            yield pa.RecordBatch.from_arrays([c.column("a"), c.column("b"), pa.array(shares, pa.float64())], names=["a", "b", "likeness"]).filter(keep)

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, likeness double")


def _placed(docs: DataFrame, bucket_rows: int) -> DataFrame:
    """(bucket, guest, known, id, h, raw): texts in buckets of neighbouring (id, h), h a hash of the text.

    A bucket also holds, as its guest, the row that follows its last one in descending
    order, which is the first of another bucket.  Bounds are quantiles of all ids; a
    repeated id that takes several of them is split by h.  The driver gets numbers of
    buckets only.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("raw"))
    texts = texts.select("id", F.coalesce("raw", F.lit(b"")).alias("raw")).withColumn("h", F.xxhash64("raw"))
    keys = texts.select("id", "h")
    size = keys.agg(F.count(F.lit(1)), F.count("id")).first()
    k = max(512, -(-size[1] // bucket_rows))
    bounds = np.array(keys.agg(F.percentile_approx("id", [i / k for i in range(1, k)], 20 * k)).first()[0] or [], np.int64)
    unknown = 1 + (size[0] - size[1]) // bucket_rows

    def buckets(ids: pa.Array, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        x = ids.fill_null(0).to_numpy()
        share = h.astype(float) / 2.0**64 + 0.5
        low, high = np.searchsorted(bounds, x, "left"), np.searchsorted(bounds, x, "right")
        inside = low + np.minimum(np.floor(share * (high - low + 1)), high - low).astype(np.int64)
        return np.where(known, unknown + inside, np.minimum(np.floor(share * unknown), unknown - 1).astype(np.int64)), known, x

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place, known, x = buckets(b.column("id"), b.column("h").to_numpy())
            yield pa.RecordBatch.from_pydict({"bucket": place, "known": pa.array(known), "id": x, "h": b.column("h")})

    heads = keys.mapInArrow(keyed, "bucket long, known boolean, id long, h long").groupBy("bucket").agg(F.max(F.struct("known", "id", "h")).alias("head")).orderBy("bucket").collect()  # a row for each bucket
    own = np.array([r.bucket for r in heads], np.int64)
    after = np.roll(own, -1)
    first = [np.array([r.head[i] for r in heads]) for i in range(3)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "guest", "known", "id", "h", "raw"]
        for b in batches:
            if not b.num_rows:
                continue
            h = b.column("h").to_numpy()
            place, known, x = buckets(b.column("id"), h)
            at = np.searchsorted(own, place)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.zeros(len(h), bool)), pa.array(known), pa.array(x), b.column("h"), b.column("raw")], names=names)
            lead = np.flatnonzero((first[0][at] == known) & (first[1][at] == x) & (first[2][at] == h))
            if len(lead):
                yield pa.RecordBatch.from_arrays([pa.array(after[at[lead]]), pa.array(np.ones(len(lead), bool)), pa.array(known[lead]), pa.array(x[lead]), pa.array(h[lead]), b.column("raw").take(pa.array(lead))], names=names)

    return texts.mapInArrow(run, "bucket long, guest boolean, known boolean, id long, h long, raw binary")


def edited(raw: bytes, following: bytes) -> tuple[int, bytes]:
    """Code points of a text, and the text with its last third replaced by as many of the following text's first code points, or all."""
    lead = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    n = len(lead)
    third = n // 3
    start = np.flatnonzero((np.frombuffer(following, np.uint8) & 0xC0) != 0x80)
    cut = int(start[third]) if third < len(start) else len(following)
    return n, raw[: int(lead[n - third])] + following[:cut] if third else raw


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Each document's fingerprint against that of its edited text and of the next document in descending order of id.

    Rows of one id follow each other by a hash of their text, those without id come
    last, and the first row follows the last.  Null texts count as empty.  Rows equal in
    id and text are each their own document and next to each other.  Other columns are
    ignored; an empty table gives an empty result.  Texts are shuffled once, by ranges of
    id, and each task holds two of them and a slice at a time.
    """
    placed = _placed(docs, bucket_rows).repartition("bucket").sortWithinPartitions("bucket", "guest", F.desc("known"), F.desc("id"), F.desc("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row seen, which waits for its next
        for b in batches:
            guests, ids = b.column("guest").to_pylist(), [i if k else None for i, k in zip(b.column("id").to_pylist(), b.column("known").to_pylist(), strict=True)]
            for i, j, data, offs in slices(b.column("raw")):
                rows = [] if held is None else [held]
                signs = signatures(data, offs)
                rows += [(guests[i + r], ids[i + r], data[offs[r] : offs[r + 1]].tobytes(), signs[r]) for r in range(j - i)]
                held = rows[-1]
                # A bucket's rows end with its guest, which has no next here.
                pairs = [(x, y) for x, y in zip(rows[:-1], rows[1:], strict=True) if not x[0]]
                changed = [edited(x[2], y[2]) for x, y in pairs]
                after = [s for _, _, d, o in slices(pa.array([c for _, c in changed], pa.large_binary())) for s in signatures(d, o)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array([x[1] for x, _ in pairs], pa.int64()),
                        "n_chars": pa.array([n for n, _ in changed], pa.int64()),
                        "edited_sha256": pa.array([hashlib.sha256(c).hexdigest() for _, c in changed], pa.string()),
                        "fingerprint": pa.array([text_of(x[3]) for x, _ in pairs], pa.string()),
                        "edited_fingerprint": pa.array([text_of(s) for s in after], pa.string()),
                        "near_edited": pa.array([likeness(x[3], s) for (x, _), s in zip(pairs, after, strict=True)], pa.float64()),
                        "near_next": pa.array([likeness(x[3], y[3]) for x, y in pairs], pa.float64()),
                    }
                )

    return placed.mapInArrow(run, OUT)


def op13(spark, sf_dir: str) -> DataFrame:
    return compared(spark.read.parquet(f"{sf_dir}/documents.parquet"))
