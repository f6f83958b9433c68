"""Near duplicates by a grouped prefix join on word n-grams.

Operator 1.  Two documents link when 100 |A n B| >= percent |A u B| for their
sets of distinct n-word shingles (ASCII lower case).

1. All shingles get one global order: light ones by hash, then the heaviest,
   rarest first.  Any order is right; this one keeps common passages out of the
   prefixes.  Weights come from local counts over all documents; the table of
   heavy shingles has at most HEAVY entries, whatever the corpus.
2. Documents with equal sets are one class, classes with equal prefix and size
   one group.  Only groups have postings (shingle, group), for the first
   n - ceil(t n) + 1 shingles.
   Postings of short lists that the bounds below exclude are dropped.
3. In ROUNDS rounds each posting is compared with the NEAR ones before it in its
   list, in an order of size classes and then by a hash that differs from list to
   list and round to round, and each class likewise within its group.  Of those
   partners that the sets' parity maps allow, the most alike and the one of least
   id are verified on whole texts; links give components, whose members need no
   more comparing.  This costs a number of pairs in proportion to the postings.
4. Then, in each list that holds several components, the groups outside its
   largest one are joined with all others, unless all their members are in one
   component already, expanded to members of different components, and verified.
   Every pair that passes the size, position and parity bounds is so either
   verified or connected: no link is lost, and what a group of near copies has
   in one component isn't paired.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm._arrays import Words, give_back, shingles, slices
from mnemospark.llm._bitmaps import bitmap, held
from mnemospark.llm._shared import Scratch, stored
from mnemospark.llm.components import components

#: Entries of the table of heavy shingles, at most.
HEAVY = 1 << 16
#: A shingle is heavy if more than this share of the documents has it.
HEAVY_SHARE = 1 / 20000
#: 64-bit words of a set's parity map: bit k says whether an odd number of its shingles hash to k.
MAP_WORDS = 16
#: Words of the map folded for postings.
FOLDED = 4
#: Lists of so many postings at most are settled at once: a posting that can't link with any other of its list is dropped.
FEW = 8
#: Sets of more shingles than this also have a wide map, of a bit or so for each shingle: the small one tells them nothing.
WIDE = 64 * MAP_WORDS
#: Neighbours before it in a list that a posting is compared with in each round.
NEAR = 8
ROUNDS = 1
#: Lists of more postings than this are split for the rounds, at random.
SPLIT = 1 << 14
#: Texts that one verifying run compares with one pivot.
FAN = 64


def _parity(s: np.ndarray, bits: int) -> np.ndarray:
    odd = np.bincount((s >> np.uint64(7)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _counts(size: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held, docs = [], 0, 0

        def local():
            h, n = np.unique(np.concatenate(sets), return_counts=True)
            keep = n >= max(3, share * docs)
            return pa.RecordBatch.from_pydict({"h": h[keep].view(np.int64), "c": n[keep].astype(np.int64)})

        for b in batches:
            for _, _, data, offs in slices(b.column("text")):
                found = shingles(Words(data, offs), size)
                sets += found
                docs += len(found)
                held += sum(map(len, found))
                if held > 2_000_000:
                    yield local()
                    sets, held, docs = [], 0, 0
        if sets:
            yield local()
        sets = []
        give_back()

    return run


def heavy_shingles(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the heaviest shingles and the rank of each, rarest first."""
    n = docs.select(F.count(F.lit(1))).first()[0]
    found = docs.select("text").mapInArrow(_counts(size, HEAVY_SHARE), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    rows = found.where(F.col("c") >= max(3, HEAVY_SHARE * n)).orderBy(F.desc("c"), "h").limit(HEAVY).toArrow()
    h, c = rows.column("h").to_numpy().view(np.uint64), rows.column("c").to_numpy()
    del rows
    give_back()
    by_hash = np.argsort(h)
    rank = np.empty(len(h), np.int64)
    rank[np.lexsort((h, c))] = np.arange(len(h))
    return h[by_hash], rank[by_hash]


def _ordered(s: np.ndarray, heavy: np.ndarray, rank: np.ndarray) -> np.ndarray:
    if not len(heavy) or not len(s):
        return s
    at = np.searchsorted(heavy, s)
    at[at == len(heavy)] = 0
    is_heavy = heavy[at] == s
    if not is_heavy.any():
        return s
    return np.concatenate([s[~is_heavy], s[is_heavy][np.argsort(rank[at[is_heavy]])]])


def _describe(size: int, percent: int, heavy: np.ndarray, rank: np.ndarray, prefixes: bool):
    """Per document its set size and fingerprints of its set and prefix, or with ``prefixes`` the prefix itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in slices(b.column("text")):
                n, sets, heads, lists, maps, wide = [], [], [], [], [], []
                for s in shingles(Words(data, offs), size):
                    p = _ordered(s, heavy, rank)[: len(s) - -(-percent * len(s) // 100) + 1] if len(s) else s
                    n.append(len(s))
                    heads.append(hashlib.md5(p.tobytes() + len(s).to_bytes(8, "little")).digest())
                    if prefixes:
                        lists.append(p.view(np.int64))
                    else:
                        sets.append(hashlib.md5(s.tobytes()).digest())
                        maps.append(_parity(s, 64 * MAP_WORDS))
                        wide.append(_parity(s, 1 << (len(s) - 1).bit_length()) if len(s) > WIDE else None)
                ids, head = b.column("id")[i:j], pa.array(heads, pa.binary())
                if prefixes:
                    cut = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                    yield pa.RecordBatch.from_pydict({"id": ids, "n": pa.array(n, pa.int64()), "head": head, "prefix": pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64)))})
                else:
                    yield pa.RecordBatch.from_pydict({"id": ids, "n": pa.array(n, pa.int64()), "head": head, "whole": pa.array(sets, pa.binary()), "map": pa.array(maps, pa.list_(pa.int64())), "wide": pa.array(wide, pa.list_(pa.int64()))})
        n = sets = heads = lists = maps = wide = None
        give_back()

    return run


def _verify(size: int, percent: int):
    """Rows (a, salt, id, text), sorted so that in each (a, salt) the rows of a come first: its members that link with a."""

    def linked(p: np.ndarray, s: np.ndarray) -> bool:
        if 100 * min(len(p), len(s)) < percent * max(len(p), len(s)):
            return False
        both = len(np.intersect1d(p, s, assume_unique=True))
        return 100 * both >= percent * (len(p) + len(s) - both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pivots = None, []
        for b in batches:
            a, salt, ids = (b.column(c).to_pylist() for c in ("a", "salt", "id"))
            left, right = [], []
            for i, _, data, offs in slices(b.column("text")):
                for k, s in enumerate(shingles(Words(data, offs), size), start=i):
                    if (a[k], salt[k]) != key:
                        key, pivots = (a[k], salt[k]), []
                    if ids[k] == a[k]:
                        pivots.append(s)
                    elif any(linked(p, s) for p in pivots):
                        left.append(a[k])
                        right.append(ids[k])
            yield pa.RecordBatch.from_pydict({"u": pa.array(left, pa.int64()), "v": pa.array(right, pa.int64())})
        pivots = None
        give_back()

    return run


def _differ(map1, map2, words: int = MAP_WORDS):
    return sum(F.bit_count(map1[i].bitwiseXOR(map2[i])) for i in range(words))


def _folded(of: str) -> Column:
    """A parity map folded to FOLDED words: the same bound, if a weaker one, in rows of a few bytes."""
    return F.array(*[reduce(Column.bitwiseXOR, [F.col(of)[k] for k in range(i, MAP_WORDS, FOLDED)]) for i in range(FOLDED)])


def _may_link(n1, map1, n2, map2, percent: int, words: int = MAP_WORDS):
    """Parity maps differ in no more bits than the sets may in shingles: a bound that no link breaks."""
    return (100 + percent) * _differ(map1, map2, words) <= (100 - percent) * (n1 + n2)


def _may_link_wide(n1, wide1, n2, wide2, percent: int):
    """The same bound on the wide maps, the longer one folded onto the shorter; sizes that may link differ by one doubling at most."""

    def folded(x, y):
        half = (F.size(x) / 2).cast("int")
        return F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda i, j: i.bitwiseXOR(j))).otherwise(x)

    differ = F.aggregate(F.zip_with(folded(wide1, wide2), folded(wide2, wide1), lambda i, j: F.bit_count(i.bitwiseXOR(j))), F.lit(0), lambda t, x: t + x)
    return F.coalesce((100 + percent) * differ <= (100 - percent) * (n1 + n2), F.lit(True))


def _links(scratch: Scratch, docs: DataFrame, pairs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b, long) that link.  Pivots with many partners are split into runs of about FAN.

    What several queries read is stored, and joins merge: plans stay small, and nothing is broadcast, which the driver would hold.
    """
    x, y = (classes.select(F.col("rep").alias(c), F.struct("n", "map").alias(f"of_{c}")).hint("merge") for c in ("a", "b"))
    pairs = pairs.join(x, "a").join(y, "b").where(_may_link(F.col("of_a.n"), F.col("of_a.map"), F.col("of_b.n"), F.col("of_b.map"), percent)).select("a", "b", "long")
    # Only pairs of two long sets look up the wide maps.
    x, y = (classes.where(F.col("n") > WIDE).select(F.col("rep").alias(c), F.struct("n", "wide").alias(f"of_{c}")).hint("merge") for c in ("a", "b"))
    pairs = scratch.stored(pairs, "pairs")
    far = pairs.where("long").join(x, "a").join(y, "b").where(_may_link_wide(F.col("of_a.n"), F.col("of_a.wide"), F.col("of_b.n"), F.col("of_b.wide"), percent))
    pairs = scratch.stored(pairs.where("NOT long").select("a", "b").union(far.select("a", "b")), "fitting")
    fan = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / FAN).cast("int").alias("runs"))
    members = pairs.join(fan.hint("merge"), "a").select("a", F.pmod(F.xxhash64("b"), F.col("runs")).cast("int").alias("salt"), F.col("b").alias("id"))
    pivots = fan.select("a", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("salt"), F.col("a").alias("id"))
    needs = scratch.stored(members.union(pivots), "needs")
    rows = held(docs.where("id IS NOT NULL"), bitmap(needs, F.col("id")), F.col("id")).join(needs, "id").select("a", "salt", "id", "text")
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("id") != F.col("a"), "id")
    return scratch.stored(rows.mapInArrow(_verify(size, percent), "u long, v long").distinct(), "links")


def _labelled(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """classes with the component that each belongs to so far."""
    return classes.join(labels.hint("merge"), classes["rep"] == labels["node"], "left").select(*classes.columns, F.coalesce("component", "rep").alias("label"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs.

    component_id is the smallest id reachable over links, the own one included.
    Null and empty texts have no shingles and link with nothing; a text of fewer
    than ``size`` words is one shingle; rows with one id are one document and
    linked; a row without id has no component; other columns are ignored.
    """
    with Scratch(docs.sparkSession, "jaccard") as scratch:
        return stored(_near_duplicates(scratch, docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), size, percent), "components")


def _near_duplicates(scratch: Scratch, every: DataFrame, size: int, percent: int) -> DataFrame:
    heavy, rank = heavy_shingles(every, size)
    facts = scratch.stored(every.mapInArrow(_describe(size, percent, heavy, rank, False), "id long, n long, head binary, whole binary, map array<long>, wide array<long>"), "facts")
    used = facts.where("id IS NOT NULL AND n > 0")
    classes = used.groupBy("n", "head", "whole").agg(F.min("id").alias("rep"), F.first("map").alias("map"), F.first("wide").alias("wide"))
    group = Window.partitionBy("n", "head")
    classes = scratch.stored(classes.withColumn("gid", F.min("rep").over(group)).withColumn("entries", F.count(F.lit(1)).over(group)).withColumn("small", _folded("map")).withColumn("cut", F.floor(F.log("n") / math.log(100 / percent)) if percent < 100 else F.col("n")), "classes")
    groups = classes.where("rep = gid").select("gid", "head").distinct()

    # Postings of one document for each group, with the place of the shingle in the order: those of lists with several groups.
    lists = every.where("id IS NOT NULL").mapInArrow(_describe(size, percent, heavy, rank, True), "id long, n long, head binary, prefix array<long>")
    lists = lists.join(groups, (F.col("id") == F.col("gid")) & (lists["head"] == groups["head"])).select("gid", "prefix")
    postings = lists.select("gid", F.posexplode("prefix").alias("i", "h"))
    shared = postings.withColumn("entries", F.count(F.lit(1)).over(Window.partitionBy("h"))).where("entries > 1")
    shared = shared.join(classes.where("rep = gid").select("gid", "n", "small", "cut", (F.col("entries") == 1).alias("alone")), "gid")

    def fits(n1, i1, n2, i2):
        """Sizes allow a link, and so does the number of shingles from the first common one on."""
        total = n1 + n2
        return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & ((100 + percent) * F.least(n1 - i1, n2 - i2) >= percent * total)

    # Most lists hold a few documents that share a shingle by chance.
    few = shared.where(F.col("entries") <= FEW).groupBy("h").agg(F.collect_list(F.struct("gid", "i", "entries", "n", "small", "cut", "alone")).alias("x"))
    # A group's map is that of one class: it says nothing of a group's other classes.
    may = lambda p, q: (p["gid"] != q["gid"]) & fits(p["n"], p["i"], q["n"], q["i"]) & (~(p["alone"] & q["alone"]) | _may_link(p["n"], p["small"], q["n"], q["small"], percent, FOLDED))
    few = few.select("h", F.explode(F.filter("x", lambda p: F.exists("x", lambda q: may(p, q)))).alias("x")).select("h", "x.*")
    shared = scratch.stored(few.unionByName(shared.where(F.col("entries") > FEW)).drop("alone"), "postings")

    def near(rows: DataFrame, node: str, list_of: list[str], nth: int) -> DataFrame:
        """(b, id, differ, long): of each row the NEAR rows before it in its list, split if long, that may link and aren't in one component with it."""
        order = F.xxhash64(node, *list_of, F.lit(nth))
        split = F.pmod(F.xxhash64(node, F.lit(~nth)), F.ceil(F.col("entries") / SPLIT)).alias("split")
        w = Window.partitionBy(*list_of, "cut", "split").orderBy(order, node).rowsBetween(-NEAR, -1)
        before = rows.withColumn("split", split).withColumn("before", F.collect_list(F.struct(F.col(node).alias("id"), "n", "i", "small", "label")).over(w))
        may = F.filter("before", lambda p: (p["id"] != F.col(node)) & (p["label"] != F.col("label")) & fits(F.col("n"), F.col("i"), p["n"], p["i"]) & _may_link(F.col("n"), F.col("small"), p["n"], p["small"], percent, FOLDED))
        may = F.transform(may, lambda p: F.struct(_differ(F.col("small"), p["small"], FOLDED).alias("differ"), p["id"].alias("id"), ((F.col("n") > WIDE) & (p["n"] > WIDE)).alias("long")))
        return before.select(F.col(node).alias("b"), F.explode(may).alias("x")).select("b", "x.*")

    links, labels = [], None
    several = classes.where("entries > 1").select("gid", "rep", "n", "head", "small", "cut", "entries", F.lit(0).alias("i"))
    for nth in range(ROUNDS):
        labelled = classes.select("gid", "rep", F.col("rep").alias("label")) if labels is None else _labelled(classes.select("gid", "rep"), labels)
        pairs = near(shared.join(labelled.where("rep = gid").select("gid", "label"), "gid"), "gid", ["h"], nth)
        kin = several.join(labelled.select("rep", "label"), "rep")
        pairs = pairs.union(near(kin, "rep", ["n", "head"], nth))
        best = pairs.groupBy("b").agg(F.min(F.struct("differ", "id", "long")).alias("x"), F.min(F.struct("id", "differ", "long")).alias("y"))
        best = best.select("b", F.explode(F.array(F.struct("x.id", "x.long"), F.struct("y.id", "y.long"))).alias("x"))
        best = best.select(F.least("b", "x.id").alias("a"), F.greatest("b", "x.id").alias("b"), "x.long").distinct()
        links.append(_links(scratch, every, best, classes, size, percent))
        labels = components(reduce(DataFrame.union, links))
    # What is left: lists whose groups are not all connected.
    labelled = scratch.stored(_labelled(classes.select("gid", "rep", "n", "small"), labels), "labels")
    spread = labelled.groupBy("gid").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), (F.count(F.lit(1)) == 1).alias("alone"))
    rows = shared.select("h", "gid", "n", "i").join(spread.hint("merge"), "gid").withColumn("own", F.when(F.col("lo") == F.col("hi"), F.col("lo")))
    major = rows.groupBy("h", "own").agg(F.count(F.lit(1)).alias("c")).groupBy("h").agg(F.max(F.when(F.col("own").isNotNull(), F.struct("c", "own")))["own"].alias("major"), F.count(F.lit(1)).alias("parts"), F.max(F.col("own").isNull()).alias("mixed"))
    rows = rows.join(major.where("parts > 1 OR mixed").hint("merge"), "h").withColumn("main", F.coalesce(F.col("own") == F.col("major"), F.lit(False)))
    rows = scratch.stored(rows.select("h", "gid", "n", "i", "alone", "own", "main"), "open")
    rows = rows.join(classes.where("rep = gid").select("gid", "map").hint("merge"), "gid")
    x, y = rows.where("NOT main").alias("x"), rows.alias("y")
    ordered = F.col("y.main") | (F.col("x.gid") < F.col("y.gid"))
    same = F.coalesce(F.col("x.own") == F.col("y.own"), F.lit(False))
    # A group of one class is its class: what its parity map excludes needs no expansion.
    may = ~(F.col("x.alone") & F.col("y.alone")) | _may_link(F.col("x.n"), F.col("x.map"), F.col("y.n"), F.col("y.map"), percent)
    rest = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.gid") != F.col("y.gid")) & ordered & ~same & fits(F.col("x.n"), F.col("x.i"), F.col("y.n"), F.col("y.i")) & may)
    rest = scratch.stored(rest.select(F.col("x.gid").alias("g1"), F.col("y.gid").alias("g2"), (F.col("x.alone") & F.col("y.alone")).alias("alone"), ((F.col("x.n") > WIDE) & (F.col("y.n") > WIDE)).alias("long")).distinct(), "rest")
    inside = spread.where("lo != hi").select(F.col("gid").alias("g1"), F.col("gid").alias("g2"))
    m1, m2 = (labelled.select(F.col("gid").alias(f"g{k}"), F.col("rep").alias(f"r{k}"), F.col("label").alias(f"l{k}"), F.col("n").alias(f"n{k}"), F.col("small").alias(f"small{k}")) for k in (1, 2))
    expanded = rest.where("NOT alone").select("g1", "g2").union(inside).join(m1, "g1")
    expanded = expanded.join(m2, (expanded["g2"] == m2["g2"]) & (F.col("l1") != F.col("l2")) & ((expanded["g1"] != expanded["g2"]) | (F.col("r1") < F.col("r2"))) & _may_link(F.col("n1"), F.col("small1"), F.col("n2"), F.col("small2"), percent, FOLDED))
    rest = rest.where("alone").select(F.col("g1").alias("r1"), F.col("g2").alias("r2"), "long").union(expanded.select("r1", "r2", (F.col("n1") > WIDE) & (F.col("n2") > WIDE)))
    rest = rest.select(F.least("r1", "r2").alias("a"), F.greatest("r1", "r2").alias("b"), "long").distinct()
    more = _links(scratch, every, rest, classes, size, percent)

    own = scratch.stored(used.join(classes.select("n", "head", "whole", "rep").hint("merge"), ["n", "head", "whole"]).select("id", "rep", "n"), "own")
    # An id with several texts connects their classes.
    several = own.groupBy("id").agg(F.min("rep").alias("v"), F.max("rep").alias("w")).where("v != w").select("id", "v")
    bridges = own.join(several.hint("merge"), "id").select(F.col("rep").alias("u"), "v")
    final = components(labels.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more).union(bridges))
    found = own.select("id", "rep").distinct().join(final.hint("merge"), F.col("rep") == F.col("node"), "left").groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("c"))
    out = facts.select("id", "n").join(found.hint("merge"), "id", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("c", "id").alias("component_id"))


def representatives(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of near duplicates the row of least id; rows without id stay; of rows with one id, the one of least text and other columns.

    Rows whose id isn't in a bitmap of the ids that go, or come more than once, stay
    as they are and aren't shuffled.
    """
    name = f"id-{uuid.uuid4().hex}"
    found = near_duplicates(docs, size, percent, id_col, text_col).where("doc_id IS NOT NULL")
    touched = found.groupBy(F.col("doc_id").alias("id")).agg(F.min(F.col("doc_id") == F.col("component_id")).alias("keep"), F.count(F.lit(1)).alias("c")).where("c > 1 OR NOT keep")
    touched = stored(touched, "touched")
    bits, key = bitmap(touched, F.col("id")), F.col(id_col).cast("long")
    asked = held(docs.where(F.col(id_col).isNotNull()), bits, key).withColumn(name, key)
    asked = asked.join(touched, F.col(name) == touched["id"], "left").where("keep IS NULL OR keep")
    first = Window.partitionBy(name).orderBy(*[F.col(c) for c in (text_col, *(x for x in docs.columns if x not in (id_col, text_col)))])
    once = asked.where("c IS NULL OR c = 1").select(*docs.columns)
    several = asked.where("c > 1").withColumn(name, F.row_number().over(first)).where(F.col(name) == 1).select(*docs.columns)
    sure = held(docs.where(F.col(id_col).isNotNull()), bits, key, wanted=False)
    return sure.union(once).union(several).union(docs.where(F.col(id_col).isNull()))


def op1(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=4, percent=85)
