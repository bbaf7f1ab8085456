"""N-gram Jaccard join on sets of word shingles, with token-combination prefixes.

Documents of one set are one class, held by its smallest doc_id. Shingles are ordered by class of
frequency and hash. If two sets reach the similarity, at most ``n // 5`` shingles of a set of n are
missing in the other, so a prefix with one more *unit* than that must share one: a rare shingle is a
unit, and of a group of frequent shingles each but the first is one, since two of them have to meet.
Rare shingles are indexed alone, frequent ones as pairs within their group.

1.  Every set's shingles under ``SHARE`` of the hash range are dealt out by shingle and counted. Those
    in more than ``RARE`` sets are frequent; the others yield candidate pairs. Where a task finds more
    than ``RARE`` sets of a shingle by itself, it sends out only as many as show it to be frequent, so
    that a shingle of a large share of all documents is no load on one task.
2.  Sets whose rare shingles in that range fall short of the units needed are extended: all their
    shingles are classed, further rare ones are indexed, and where they still do not suffice, pairs of
    frequent ones. Similar sets differ in size by a quarter at most, so groups are cut for two
    neighbouring levels of size each, one of which a similar set shares.
3.  An index entry of many sets is not expanded into all its pairs: its most central set (fewest rare
    shingles) is compared with all others, and only sets that are not connected then go on to further
    comparisons: they meet all others of the entry of like size in blocks, where histograms of their
    shared shingles bound each pair's overlap and rule nearly all pairs out without a look at the sets.
4.  Candidates that bounds on the overlap cannot exclude are verified on the whole sets; a set with
    many candidates is dealt out as several copies.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import bitfilter
from tarn.llm.common import lean, modest, table, written
from tarn.llm.components import components

#: Words of a shingle; similarity as PER / OUT_OF; 1 in SLACK shingles at most may be missing.
WORDS, PER, OUT_OF, SLACK = 5, 80, 100, 5
#: A shingle of more sets than this is frequent; the share of the hash range counted for every set.
RARE, SHARE = 16, 1 / 3
TOP = (1 << 63) - 1
LIMIT = int(TOP * SHARE)
#: Sets of fewer shingles index frequent shingles alone.
LEAST_PAIRED = 40
#: Cells of a histogram; members and outsiders in a block.
CELLS, MEMBERS, OUTSIDERS = 128, 500, 250
CACHED = 100_000
#: Rows of shingles that a task looks through at once; bits of a count that is sent with a key below 0.
ROOM, COUNT_BITS = 1 << 20, 22
#: Candidates of a set for each copy of it; keys that the number of copies is looked up under.
PER_COPY, SPREAD = 256, 64
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


class _Hashes(dict):
    """64-bit hashes of words, computed once for each word; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, hashes: dict) -> np.ndarray:
    """The sorted distinct 63-bit hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.int64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(WORDS, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        h = mixed(h * _MIX[0] + w[i : len(w) - size + 1 + i])
    return np.unique((h >> np.uint64(1)).astype(np.int64))


def _each(docs: DataFrame, id_col: str, text_col: str, schema: str, make: Callable, only: Callable | None = None, then: Callable = iter) -> DataFrame:
    """mapInArrow over (id, text) of rows with an id: ``make(ids, sets)`` returns the columns of a batch. ``only`` picks ids first; ``then`` gets the batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from then(made(batches))

    def made(batches):
        hashes = _Hashes()
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            if only is not None and batch.num_rows:
                batch = batch.filter(pa.array(only(batch.column(0).to_numpy(zero_copy_only=False))))
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                columns = make(ids, [shingles(t, hashes) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns.values()], list(columns))

    return modest(docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))).mapInArrow(lean(run), schema)


def _heads(ids, sets):
    digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
    return {
        "doc": ids,
        "n": np.array([len(s) for s in sets], np.int64),
        "w": np.array([np.searchsorted(s, LIMIT) for s in sets], np.int64),
        "d1": np.array([int.from_bytes(d[:8], signed=True) for d in digests], np.int64),
        "d2": np.array([int.from_bytes(d[8:], signed=True) for d in digests], np.int64),
    }


def _rows(below: int | None):
    """One row per shingle, up to ``below`` or all."""

    def make(ids, sets):
        cut = sets if below is None else [s[: np.searchsorted(s, below)] for s in sets]
        return {"t": np.concatenate([*cut, np.zeros(0, np.int64)]), "doc": np.repeat(ids, [len(s) for s in cut])}

    return make


def thinned(batches, most: int) -> Iterator[pa.RecordBatch]:
    """(t, doc) batches with no more rows of a key from each ``ROOM`` rows than show that it has more than ``most``.

    What the left out rows say, that a document stood under so many such keys, goes as one row with a
    key below 0 that holds the count.
    """

    def settle(k, d):
        order = np.argsort(k, kind="stable")
        k, d = k[order], d[order]
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        nth = np.arange(len(k)) - np.repeat(starts, np.diff(np.append(starts, len(k))))
        over = nth > most
        docs, times = np.unique(d[over], return_counts=True)
        spread = (mixed(docs.astype(np.uint64)) >> np.uint64(44)).astype(np.int64)
        counts = -1 - ((spread << COUNT_BITS) | times)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([k[~over], counts])), pa.array(np.concatenate([d[~over], docs]))], names=["t", "doc"])

    ks, ds, n = [], [], 0
    for batch in batches:
        ks.append(batch.column(0).to_numpy(zero_copy_only=False))
        ds.append(batch.column(1).to_numpy(zero_copy_only=False))
        n += batch.num_rows
        if n >= ROOM:
            yield settle(np.concatenate(ks), np.concatenate(ds))
            ks, ds, n = [], [], 0
    if n:
        yield settle(np.concatenate(ks), np.concatenate(ds))


def _whole(ids, sets):
    offsets = np.cumsum([0, *map(len, sets)], dtype=np.int32)
    return {"doc": ids, "s": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))}


def of_ids(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, schema: str, make: Callable) -> DataFrame:
    """What ``make`` makes of the documents whose id is in ``ids`` (column doc, distinct)."""
    keys = ids.select("doc", F.xxhash64("doc").alias("h"))
    test = bitfilter.build(keys.select(F.expr("doc").alias("h")), "h")
    return _each(docs, id_col, text_col, schema, make, test).join(ids.select("doc"), "doc", "left_semi")


def meet(rows: DataFrame, key: str, most: int) -> DataFrame:
    """What meets under a key, from (key, doc), thinned or not: a table of (kind, a, b, c), read in key order by bounded memory.

    kind 0: a pair of a key of up to ``most`` documents, c times; 1: a document that stood c times
    under keys of more; 2: such a key (a).
    """
    picks = [np.array([(i, j) for i in range(s) for j in range(i + 1, s)]).T for s in range(most + 1)]

    def out(kind, a, b, c):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(c)], names=["kind", "a", "b", "c"])

    def counted(a, b):
        if not len(a):
            return a, b, np.zeros(0, np.int64)
        at = np.lexsort((b, a))
        a, b = a[at], b[at]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        return a[new], b[new], np.diff(np.append(new, len(a))).astype(np.int64)

    def run(batches):
        held_k, held_d = np.zeros(0, np.int64), np.zeros(0, np.int64)
        big = None  # the key that is known to be of many, whose documents are passed on as they come
        for batch in batches:
            k, d = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            if (sent := k < 0).any():
                yield out(1, d[sent], d[sent], (-1 - k[sent]) & ((1 << COUNT_BITS) - 1))
                k, d = k[~sent], d[~sent]
            k, d = np.concatenate([held_k, k]), np.concatenate([held_d, d])
            if not len(k):
                continue
            starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            last = int(starts[-1])
            done = len(k) if len(k) - last > most or k[last] == big else last  # a short last run waits for the next batch
            yield from settle(k[:done], d[:done], big)
            big = k[-1] if done == len(k) else None
            held_k, held_d = k[done:], d[done:]
        yield from settle(held_k, held_d, big)

    def settle(k, d, big):
        if not len(k):
            return
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        sizes = np.diff(np.append(starts, len(k)))
        known = k[starts] == big if big is not None else np.zeros(len(starts), bool)
        many = (sizes > most) | known
        firsts, seconds = [], []
        for s in np.unique(sizes[~many & (sizes > 1)]).tolist():
            group = d[starts[~many & (sizes == s)][:, None] + np.arange(s)]
            firsts.append(group[:, picks[s][0]].ravel())
            seconds.append(group[:, picks[s][1]].ravel())
        if firsts:
            x, y = np.concatenate(firsts), np.concatenate(seconds)
            a, b, c = counted(np.minimum(x, y)[x != y], np.maximum(x, y)[x != y])
            yield out(0, a, b, c)
        if many.any():
            inside = np.repeat(many, sizes)
            docs, times = np.unique(d[inside], return_counts=True)
            yield out(1, docs, docs, times.astype(np.int64))
            new = starts[many & ~known]
            yield out(2, k[new], d[new], np.zeros(len(new), np.int64))

    dealt = rows.repartition(key).sortWithinPartitions(key)
    return dealt.select(key, "doc").mapInArrow(lean(run), "kind int, a long, b long, c long")


def level(n):
    """The level of size of a set; similar sets are of one level or of neighbouring ones."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(OUT_OF / PER) + 1e-9).astype(np.int64)


def signatures(n: int, rare: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The index entries of one extended set: hashes of single shingles and of pairs of frequent ones."""
    need = n // SLACK + 1
    rare, frequent = np.sort(rare), np.sort(frequent)
    found = [rare[:need][rare[:need] >= LIMIT]]  # those under the limit have met already
    missing = need - len(rare)
    if missing > 0:
        for at in (int(level(n)), int(level(n)) + 1):
            size = (OUT_OF / PER) ** at
            if size < LEAST_PAIRED:
                found.append((mixed(frequent[:missing].astype(np.uint64) + np.uint64(at) * _MIX[0]) >> np.uint64(1)).astype(np.int64))
                continue
            groups = max(1, int(size / 8))
            group = (mixed(frequent.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            first = np.ones(len(frequent), bool)
            first[order[1:]] = group[order[1:]] != group[order[:-1]]
            units = np.cumsum(~first)
            end = int(np.searchsorted(units, missing)) + 1
            taken = order[order < end]
            for gap in range(1, len(taken)):
                same = group[taken[gap:]] == group[taken[:-gap]]
                if not same.any():
                    break
                x, y = frequent[taken[:-gap][same]].astype(np.uint64), frequent[taken[gap:][same]].astype(np.uint64)
                found.append((mixed(mixed(x + np.uint64(at) * _MIX[0]) * _MIX[1] + y) >> np.uint64(1)).astype(np.int64))
    return np.unique(np.concatenate(found))


def _signature_rows(per_doc: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for doc, n, shared, rare, frequent in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                s = signatures(n, np.array(rare, np.int64), np.array(frequent, np.int64))
                columns = [s, *(np.full(len(s), x) for x in (doc, n, shared, len(rare)))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["t", "doc", "n", "u", "r"])

    return per_doc.mapInArrow(lean(run), "t long, doc long, n long, u long, r long")


def _histograms(rows: DataFrame) -> DataFrame:
    """(doc, h): how many of a document's shingles fall into each of ``CELLS`` cells of the hash range."""
    return rows.groupBy("doc", F.expr(f"int(pmod(t, {CELLS}))").alias("c")).agg(F.count(F.lit(1)).cast("int").alias("k")).groupBy("doc").agg(F.collect_list(F.struct("c", "k")).alias("h"))


def _across(hubs: DataFrame, histograms: DataFrame) -> DataFrame:
    """Pairs (a, b) of a hub's documents (main, doc, g, n) in different components, one of them outside the
    main one, that the histograms allow to be similar: two sets share at most the sum of the smaller counts
    of all cells. Members of a level of size and outsiders of that level and its neighbours are dealt into
    blocks of bounded size, all blocks against all."""
    both = written(hubs.withColumn("l", F.floor(F.log("n") / np.log(OUT_OF / PER) + 1e-9).cast("long")).join(histograms, "doc"), "hub-histograms")
    outside = both.where("g <> main").withColumn("l", F.explode(F.array(F.col("l") - 1, F.col("l"), F.col("l") + 1)))
    members = both.groupBy("main", "l").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("nb"))
    sizes = written(members.join(outside.groupBy("main", "l").agg(F.ceil(F.count(F.lit(1)) / OUTSIDERS).cast("int").alias("nc")), ["main", "l"]), "hub-sizes")
    spread = F.xxhash64("doc")
    members = both.join(sizes, ["main", "l"]).withColumn("i", F.pmod(spread, "nb")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nc") - 1))).withColumn("out", F.lit(False))
    outsiders = outside.join(sizes, ["main", "l"]).withColumn("j", F.pmod(spread, "nc")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumn("out", F.lit(True))
    columns = ["main", "l", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "out", "doc", "g", "n", "h"]

    def block(t: pa.Table) -> pa.Table:
        out = t.column("out").to_numpy(zero_copy_only=False)
        doc, g, n = (t.column(c).to_numpy() for c in ("doc", "g", "n"))
        cells = np.zeros((len(doc), CELLS), np.int32)
        h = t.column("h").combine_chunks()
        at = np.repeat(np.arange(len(doc)), h.value_lengths().to_numpy())
        cells[at, h.flatten().field("c").to_numpy()] = h.flatten().field("k").to_numpy()
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        own, mine, size = doc[~out], cells[~out], n[~out]
        parts = g[~out]
        for x in np.flatnonzero(out).tolist():
            both_n = size + n[x]
            most = np.minimum(mine, cells[x]).sum(1)
            ok = (most * (OUT_OF + PER) >= both_n * PER) & (parts != g[x])
            a.append(np.minimum(own[ok], doc[x]))
            b.append(np.maximum(own[ok], doc[x]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return members.select(columns).unionByName(outsiders.select(columns)).groupBy("main", "l", "i", "j").applyInArrow(block, "a long, b long")


def _copied(pairs: DataFrame, rows: DataFrame, side: str, other: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` of the pairs with ``copy_<side>``, the copy of that set that each is compared with, and (doc, n): sets of more than one copy.

    A set has one copy for each ``PER_COPY`` of its pairs. Their number is looked up under several keys, so
    that this too is spread.
    """
    many = written(pairs.groupBy(F.col(side).alias("doc")).agg(F.ceil(F.count(F.lit(1)) / PER_COPY).alias("n")).where("n > 1"), "many-candidates")
    spread = F.xxhash64(other)
    keyed = many.select(F.col("doc").alias("_d"), "n", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_z"))
    found = rows.withColumn("_s", F.pmod(spread, F.lit(SPREAD)).cast("int")).join(keyed, (F.col(side) == F.col("_d")) & (F.col("_s") == F.col("_z")), "left")
    return found.withColumn(f"copy_{side}", F.pmod(F.shiftright(spread, 8), F.coalesce("n", F.lit(1)))).drop("_d", "_s", "_z", "n"), many


def similar(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b), a written table, whose whole sets reach the similarity."""
    ids = written(pairs.select(F.col("a").alias("doc")).union(pairs.select(F.col("b").alias("doc"))).distinct(), "candidate-ids")
    sets = written(of_ids(docs, ids, id_col, text_col, "doc long, s array<long>", _whole).dropDuplicates(["doc"]), "candidate-sets")

    def copies(many: DataFrame, side: str) -> DataFrame:
        numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("n", F.lit(1)) - 1)).alias(f"copy_{side}")
        return sets.join(many, "doc", "left").select(F.col("doc").alias(side), F.col("s").alias(f"s{side}"), numbers)

    rows, many_b = _copied(pairs, pairs, "b", "a")
    rows, many_a = _copied(pairs, rows, "a", "b")
    both = rows.join(copies(many_b, "b"), ["b", "copy_b"]).join(copies(many_a, "a"), ["a", "copy_a"])
    common = F.size(F.array_intersect("sa", "sb"))
    found = both.select("a", "b", common.alias("i"), (F.size("sa") + F.size("sb")).alias("both"))
    return found.where(F.col("i") * OUT_OF >= (F.col("both") - F.col("i")) * PER).select("a", "b")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = RARE) -> DataFrame:
    """(doc, n, component): every document's set size and the smallest id reachable by links.

    Ids identify documents; rows that repeat an id give a row each. Rows without id link with nothing,
    since no link could name them: they have a set size and no component. Null, empty and word-free
    texts have no shingles, link with nothing and are their own component. An empty table gives an empty table.
    """
    heads = written(_each(docs, id_col, text_col, "doc long, n long, w long, d1 long, d2 long", _heads), "heads")
    classes = written(heads.where("n > 0").groupBy("d1", "d2").agg(F.min("doc").alias("rep"), F.first("n").alias("n"), F.first("w").alias("w"), F.count(F.lit(1)).alias("size")), "classes")
    of_class = heads.join(classes.select("d1", "d2", "rep"), ["d1", "d2"], "left")

    # 1. Shingles of low hash. Documents that may repeat a class go through a join, all others not.
    spare = written(of_class.where("rep <> doc").select("doc"), "copies")
    copy = bitfilter.build(spare.withColumn("h", F.col("doc")), "h")
    thin = functools.partial(thinned, most=rare)
    plain = _each(docs, id_col, text_col, "t long, doc long", _rows(LIMIT), lambda x: ~copy(x), thin)
    doubted = _each(docs, id_col, text_col, "t long, doc long", _rows(LIMIT), copy).join(classes.select(F.col("rep").alias("doc")), "doc", "left_semi")
    doubted = doubted.select("t", "doc").mapInArrow(lean(thin), "t long, doc long")
    met = written(meet(plain.unionByName(doubted), "t", rare), "met")

    # 2. Sets short of rare shingles.
    frequent_in = met.where("kind = 1").groupBy("a").agg(F.sum("c").alias("f"))
    sets = classes.select(F.col("rep").alias("doc"), "n", "w")
    stats = written(sets.join(frequent_in, F.col("doc") == F.col("a"), "left").select("doc", "n", "w", F.coalesce("f", F.lit(0)).alias("f")), "sets")
    short = written(stats.where(f"w - f < n div {SLACK} + 1").select("doc", "n"), "short")
    rows = written(of_ids(docs, short, id_col, text_col, "t long, doc long", _rows(None)).distinct(), "short-shingles")
    shared = rows.groupBy("t").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    known = met.where("kind = 2").select(F.col("a").alias("t"), F.lit(True).alias("low"))
    shared = shared.join(known, "t", "left").select("t", F.expr(f"case when t < {LIMIT} then low is not null else k > {rare} end").alias("many"))
    shared = written(shared, "shared-shingles")
    classed = rows.join(shared, "t", "left").groupBy("doc").agg(
        F.count("many").alias("u"), F.collect_list(F.when(~F.coalesce("many", F.lit(False)), F.col("t"))).alias("rare"), F.collect_list(F.when(F.col("many"), F.col("t"))).alias("frequent")
    )
    # A set linked to another short one shares enough shingles with short sets; the pairs of a short and a long set have met already.
    able = short.join(classed, "doc").where(f"u * {OUT_OF} >= n * {PER}").select("doc", "n", "u", "rare", "frequent")
    index = written(_signature_rows(able), "signatures")
    entries = index.groupBy("t").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("r", "doc"))["doc"].alias("lead")).where("k > 1")
    entries = written(entries, "entries")
    met_short = written(meet(index.join(entries.where(f"k <= {rare}").select("t"), "t", "left_semi").select("t", "doc"), "t", rare), "met-short")
    large = entries.where(f"k > {rare}").select("t", "lead")

    # 3. Candidates, bounded by what the low range leaves possible.
    def size(side):
        return stats.select(F.col("doc").alias(side), F.col("n").alias(f"n{side}"), F.col("w").alias(f"w{side}"), F.col("f").alias(f"f{side}"))

    low = met.where("kind = 0").groupBy("a", "b").agg(F.sum("c").alias("c")).join(size("a"), "a").join(size("b"), "b")
    most = F.col("c") + F.least("fa", "fb") + F.least(F.expr("na - wa"), F.expr("nb - wb"))
    low = low.where(most * (OUT_OF + PER) >= (F.col("na") + F.col("nb")) * PER).select("a", "b")
    stars = index.join(large, "t").where("lead <> doc").select(F.least("lead", "doc").alias("a"), F.greatest("lead", "doc").alias("b"))
    found = written(low.union(met_short.where("kind = 0").select("a", "b")).union(stars).distinct(), "candidates")
    links = written(similar(docs, found, id_col, text_col), "similar")

    # 4. What large entries have left unconnected.
    if not large.isEmpty():
        inside = index.join(large.select("t"), "t", "left_semi").select("t", "doc", "n")
        of = components(links).select(F.col("node").alias("doc"), "component")
        now = written(inside.join(of, "doc", "left").withColumn("g", F.coalesce("component", "doc")).drop("component"), "connected")
        per = now.groupBy("t", "g").agg(F.count(F.lit(1)).alias("k"))
        main = written(per.groupBy("t").agg(F.max_by("g", F.struct("k", "g")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1").drop("parts"), "unconnected")
        hubs = written(now.join(main, "t").select("main", "doc", "g", "n").distinct(), "hubs")
        if not hubs.isEmpty():
            inner = rows.join(hubs.select("doc").distinct(), "doc", "left_semi").join(shared.select("t"), "t", "left_semi")
            new = _across(hubs, _histograms(inner)).distinct().join(found, ["a", "b"], "left_anti")
            links = links.union(written(similar(docs, written(new, "candidates"), id_col, text_col), "similar"))
    of = components(links).select(F.col("node").alias("rep"), "component")
    found = of_class.join(of, "rep", "left").select("doc", "n", F.coalesce("component", "rep", "doc").alias("component"))
    nameless = docs.where(F.col(id_col).isNull()).select(F.lit(0).cast("long").alias(id_col), F.col(text_col).alias(text_col))
    nameless = _each(nameless, id_col, text_col, "doc long, n long, w long, d1 long, d2 long", _heads)
    return found.unionByName(nameless.select(F.lit(None).cast("long").alias("doc"), "n", F.lit(None).cast("long").alias("component")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that link to one of a smaller id; all columns kept. Rows without id stay."""
    gone = written(groups(docs, id_col, text_col).where("doc <> component").select(F.col("doc").alias("_gone")).distinct(), "near-copies")
    return docs.join(gone, F.col(id_col) == F.col("_gone"), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    """op8_ngram_jaccard_join."""
    out = groups(table(spark, sf_dir, "documents"))
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
