"""Source divergence audit: how far the sources of a language lie apart in their words.

Operator 11.  A CountVectorizer for each language (minDF, largest vocabulary) builds
exact sparse vectors of the documents, which are summed by (lang, source, term) as
integers.  Two groups are compared on the terms that either of them has; all other
terms of the vocabulary have one and the same summand and are counted, not listed:

    sum over all terms f(p, q) = V f(p0, q0) + alone(g, o) + alone(o, g) + both(g, o)

where p0 and q0 are the weights of a term without occurrence, alone(g, o) sums
f(p, q0) - f(p0, q0) over the terms of g, from a histogram of their counts, and both
mends the terms that g and o share, whose rows meet sorted by term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm._shared import Scratch, stored

SCALE = 1_000_000_000
MIN_DOCS = 10
TOP_TERMS = 10
MOST_TERMS = 2**31 - 1
#: A term that no text has: keeps a language without any kept term from being an error.
NO_TERM = "\x00"
#: Bytes to themselves, A-Z to a-z, and all other ASCII to spaces.
_FOLD = bytes(c if c > 127 else c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in range(256))
#: Sums that a task holds before it hands them on.
HELD = 1 << 20


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as their terms, one space between two: runs of ASCII letters and non-ASCII characters, only A-Z lower-cased."""
    for b in batches:
        texts = [b" ".join((x.as_py() or b"").translate(_FOLD).split()) for x in b.column("raw")]
        yield pa.RecordBatch.from_arrays([b.column("lang_no"), b.column("source"), pa.array(texts, pa.binary()).cast(pa.string())], names=["lang_no", "source", "text"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang_no, source, idx, n): sums of a task's sparse vectors, handed on at HELD keys."""
    sources, keys, sums = {}, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def out() -> pa.RecordBatch:
        pair = keys >> 31
        return pa.RecordBatch.from_arrays([pa.array((pair >> 16).astype(np.int32)), pa.array(list(sources), pa.string()).take(pa.array(pair & 0xFFFF)), pa.array((keys & 0x7FFFFFFF).astype(np.int32)), pa.array(sums)], names=["lang_no", "source", "idx", "n"])

    for b in batches:
        for i in range(0, b.num_rows, 2048):
            c = b.slice(i, 2048)
            own = c.column("source").to_pylist()
            if len(sources) + len(set(own)) > 0xFFFF:
                yield out()
                sources, keys, sums = {}, np.zeros(0, np.int64), np.zeros(0, np.int64)
            pair = (c.column("lang_no").to_numpy().astype(np.int64) << 16) + np.array([sources.setdefault(x, len(sources)) for x in own], np.int64)
            own = np.repeat(pair, np.asarray(c.column("indices").value_lengths()))
            new = (own << 31) | c.column("indices").flatten().to_numpy()
            keys, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
            sums = np.bincount(at, np.concatenate([sums, c.column("values").flatten().to_numpy().astype(np.int64)]), len(keys)).astype(np.int64)
            if len(keys) > HELD:
                yield out()
                keys, sums = keys[:0], sums[:0]
    if len(keys):
        yield out()


def _weight(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE (n + 2) / (total + 2 v)), exact also where SCALE n needs more than 64 bits."""
    wide = lambda c: c.cast("decimal(19,0)")
    exact = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(n + 2), wide(total + 2 * v))
    return 1 + F.when(n < 2**33, F.call_function("div", F.lit(SCALE) * (n + 2), total + 2 * v)).otherwise(exact).cast("long")


def _part(p, q):
    """f(p, q) of columns."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _mended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang_no, a, b, value): for each pair of groups a < b the sum, over the terms that both have, of what their own sums say wrongly.

    Rows come sorted by term.  Pairs of a term's rows are taken at one distance after another; at most
    HELD sums of pairs are held.
    """
    names, kept, held = ["lang_no", "a", "b", "value"], [], 0
    rest: list[np.ndarray] | None = None

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // (p + q)

    def compact() -> list[np.ndarray]:
        cols = [np.concatenate(c) for c in zip(*kept, strict=True)]
        order = np.lexsort((cols[2], cols[1], cols[0]))
        cols = [c[order] for c in cols]
        first = np.flatnonzero(np.append(True, (np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)))
        return [*(c[first] for c in cols[:3]), np.add.reduceat(cols[3], first)]

    def batch(cols: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cols[0].astype(np.int32)), *map(pa.array, cols[1:])], names=names)

    def pairs(lang: np.ndarray, idx: np.ndarray, gid: np.ndarray, p: np.ndarray, p0: np.ndarray) -> Iterator[pa.RecordBatch]:
        nonlocal kept, held
        at, d = np.arange(len(lang)), 1
        while True:
            at = at[at + d < len(lang)]
            at = at[(lang[at] == lang[at + d]) & (idx[at] == idx[at + d])]
            if not len(at):
                return
            i, j = at, at + d
            value = f(p[i], p[j]) - f(p[i], p0[j]) - f(p0[i], p[j]) + f(p0[i], p0[j])
            kept.append([lang[i], np.minimum(gid[i], gid[j]), np.maximum(gid[i], gid[j]), value])
            held += len(at)
            if held > HELD:
                kept = [compact()]
                held = len(kept[0][0])
                if held > HELD // 2:
                    yield batch(kept[0])
                    kept, held = [], 0
            d += 1

    for b in batches:
        cols = [b.column(c).to_numpy().astype(np.int64) for c in ("lang_no", "idx", "gid", "p", "p0")]
        cols = cols if rest is None else [np.concatenate(c) for c in zip(rest, cols, strict=True)]
        if len(cols[0]):
            # The last term may go on in the next batch.
            open_ = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
            cut = len(open_) - int(open_.sum())
            yield from pairs(*(c[:cut] for c in cols))
            rest = [c[cut:] for c in cols]
    if rest is not None:
        yield from pairs(*rest)
    if kept:
        yield batch(compact())


def counts(docs: DataFrame, work: Scratch, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(gid, lang_no, lang, source, v) of each group, (lang_no, gid, idx, n) of its kept terms, and (lang_no, idx, term).

    One fit for each language, whose texts are read from a table that is partitioned by
    language.  A fit brings the language's vocabulary to the driver and its transformation
    broadcasts it: terms that MIN_DOCS documents have, not all words.
    """
    spark = docs.sparkSession
    own = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    groups = work.stored(own.select("lang", "source").distinct().withColumn("gid", F.monotonically_increasing_id()), "groups")
    langs = sorted(r.lang for r in groups.select("lang").distinct().toLocalIterator())
    if not langs:
        none = spark.createDataFrame([], "lang_no int, gid long, idx int, n long, term string")
        return groups.withColumn("lang_no", F.lit(0)).withColumn("v", F.lit(0).cast("long")), none.select("lang_no", "gid", "idx", "n"), none.select("lang_no", "idx", "term")
    numbers = spark.createDataFrame(list(enumerate(langs)), "lang_no int, lang string")
    groups = groups.join(F.broadcast(numbers), "lang")
    path = f"{work.path}/terms"
    own = own.join(F.broadcast(numbers), "lang").select("lang_no", "source", F.col("text").cast("binary").alias("raw"))
    own.mapInArrow(_folded, "lang_no int, source string, text string").write.partitionBy("lang_no").parquet(path)
    words = spark.read.schema("source string, text string, lang_no int").parquet(path)
    pad = spark.range(min_docs).select(F.array(F.lit(NO_TERM)).alias("terms"))
    vectorizer = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_docs), vocabSize=MOST_TERMS)
    vectors = vocabulary = sizes = None
    for no in range(len(langs)):
        texts = words.where((F.col("lang_no") == no) & (F.col("text") != "")).select("source", F.split("text", " ").alias("terms"))
        model = vectorizer.fit(texts.select("terms").union(pad))
        model.write().save(f"{work.path}/model-{no}")
        known = spark.read.parquet(f"{work.path}/model-{no}/data").select(F.lit(no).alias("lang_no"), F.posexplode("vocabulary").alias("idx", "term")).where(F.col("term") != NO_TERM)
        found = model.transform(texts).select(F.lit(no).alias("lang_no"), "source", F.unwrap_udt("vector").alias("vector"))
        size = known.groupBy("lang_no").agg(F.count(F.lit(1)).alias("v"))
        vectors, vocabulary, sizes = (new if old is None else old.union(new) for old, new in ((vectors, found), (vocabulary, known), (sizes, size)))
    cells = vectors.select("lang_no", "source", F.col("vector.indices").alias("indices"), F.col("vector.values").alias("values")).mapInArrow(_summed, "lang_no int, source string, idx int, n long")
    sums = cells.groupBy("lang_no", "source", "idx").agg(F.sum("n").alias("n")).join(groups.select("lang_no", "source", "gid"), ["lang_no", "source"])
    sums = work.stored(sums.select("lang_no", "gid", "idx", "n"), "sums")
    groups = groups.join(F.broadcast(sizes), "lang_no", "left").withColumn("v", F.coalesce("v", F.lit(0).cast("long")))  # a row for each language
    return groups, sums, work.stored(vocabulary, "vocabulary")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): all other sources of the language by distance, and the terms that set a source apart, ``top`` at most.

    Null texts, langs and sources are read as empty strings, each an ordinary value;
    repeated rows count as often as they occur; texts without terms still make their
    group occur; a language without kept terms gives pairs of value 0.  Values that
    tie are ranked by the item's bytes.  Other columns are ignored, and an empty table
    gives an empty result.  Texts of any length are read whole.
    """
    with Scratch(docs.sparkSession, "divergence") as work:
        return stored(_audit(docs, work, min_docs, top), "divergence")


def _audit(docs: DataFrame, work: Scratch, min_docs: int, top: int) -> DataFrame:
    groups, sums, vocabulary = counts(docs, work, min_docs)
    none = F.lit(0).cast("long")
    totals = sums.groupBy("gid").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, "gid", "left").withColumn("total", F.coalesce("total", none))
    # With v = 0 there is no term to weigh; 1 stands in for the divisor.
    groups = work.stored(groups.withColumn("p0", F.when(F.col("v") > 0, _weight(none, F.col("total"), F.col("v"))).otherwise(1)), "weights")
    own = sums.join(groups.select("gid", "total", "v", "p0"), "gid")
    own = work.stored(own.select("lang_no", "gid", "idx", "p0", _weight(F.col("n"), F.col("total"), F.col("v")).alias("p")), "own")

    # pairs of sources
    g, o = groups.select("lang_no", "gid", "v", "p0").alias("g"), groups.select("lang_no", "gid", "p0").alias("o")
    others = (F.col("g.lang_no") == F.col("o.lang_no")) & (F.col("g.gid") != F.col("o.gid"))
    base = g.join(o, others).select("g.gid", F.col("o.gid").alias("other"), (F.col("g.v") * _part(F.col("g.p0"), F.col("o.p0"))).alias("value"))
    bars = own.groupBy("lang_no", "gid", "p0", "p").agg(F.count(F.lit(1)).alias("k")).alias("g")
    alone = bars.join(o, others).select("g.gid", F.col("o.gid").alias("other"), (F.col("k") * (_part(F.col("g.p"), F.col("o.p0")) - _part(F.col("g.p0"), F.col("o.p0")))).alias("value"))
    alone = work.stored(alone.groupBy("gid", "other").agg(F.sum("value").alias("value")), "alone")
    both = own.repartition("lang_no", "idx").sortWithinPartitions("lang_no", "idx").mapInArrow(_mended, "lang_no int, a long, b long, value long")
    both = work.stored(both.groupBy("a", "b").agg(F.sum("value").alias("value")), "both")

    def turned(d: DataFrame, a: str, b: str) -> DataFrame:
        return d.select(F.col(a).alias("gid"), F.col(b).alias("other"), "value")

    pairs = base.union(alone).union(turned(alone, "other", "gid")).union(turned(both, "a", "b")).union(turned(both, "b", "a"))
    pairs = pairs.groupBy("gid", "other").agg(F.sum("value").alias("value"))
    names = groups.select("gid", "lang", "source")
    pairs = pairs.join(groups.select(F.col("gid").alias("other"), F.col("source").alias("item")), "other").select("gid", "item", "value")

    # terms that a source has more of than its language
    langs = groups.groupBy("lang_no").agg(F.sum("total").alias("total"), F.max("v").alias("v"))
    whole = sums.groupBy("lang_no", "idx").agg(F.sum("n").alias("n")).join(langs, "lang_no").select("lang_no", "idx", _weight(F.col("n"), F.col("total"), F.col("v")).alias("q"))
    whole = whole.join(vocabulary, ["lang_no", "idx"])
    apart = own.join(whole, ["lang_no", "idx"]).where("p > q").select("gid", F.col("term").alias("item"), _part(F.col("p"), F.col("q")).alias("value"))

    order = Window.partitionBy("gid").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    apart = apart.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out = pairs.withColumn("part", F.lit("pair")).unionByName(apart.withColumn("part", F.lit("term")))
    return out.join(names, "gid").select("lang", "source", "part", "item", "value", "rank")


def op11(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
pairs AS (SELECT DISTINCT lang, source FROM docs),
n AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
cells AS (SELECT p.lang, p.source, k.term, coalesce(n.n, 0) AS n FROM pairs p JOIN kept k USING (lang) LEFT JOIN n USING (lang, source, term)),
p AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM cells JOIN sizes USING (lang)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q FROM (SELECT lang, term, sum(n) AS n FROM n GROUP BY ALL) JOIN sizes USING (lang)),
values_of AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value FROM pairs a JOIN pairs b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS s, y.source AS t, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f ON f.lang = a.lang AND f.s = a.source AND f.t = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM values_of)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10"""
