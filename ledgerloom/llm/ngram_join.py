"""N-gram Jaccard join by T-occurrence search (operator 4).

A document is its set of hashed 5-word shingles. Links need a Jaccard similarity of 75 %, hence
T = ceil(0.75 n) common shingles at least for a set of n. Of the shingles in hash order, the first
n - T + t of either document then hold t common ones, t = 1 + n div 8; these prefixes are inverted.

1. Copies of whole texts collapse to their first document. Shingles held once drop out of the inverted
   lists, and with them all documents that keep too few shared ones: first over prefixes, then, for the
   documents that are left, over whole sets, where T shared shingles are needed. Most documents end here.
2. A star round: in the lists of a few sampled shingles the document that shares most is a pivot; each document
   is compared with the pivot it meets most often. This settles groups of near copies with one comparison
   for each member, so no list is ever expanded into all of its pairs.
3. T-occurrence search among the components that are left (DivideSkip). A document's T - t longest lists are set
   aside; documents that share t short lists with another component gather, with their sets, in small groups
   named after the pivots of their lists. There each one asks: its short lists are merged by a heap that skips what
   cannot occur t times, what does is looked up in the long lists by binary search, and documents that reach the
   required overlap are links. Only links that join two components leave a group, so rows grow with documents.

Every pair that can reach the threshold and is not yet known to be connected is compared, so the
components are those of all links. Defined results: texts of fewer than five words are one shingle;
null, empty or blank texts have no shingles and link with nothing, nor do rows of null doc_id (their
component is null); several texts of one doc_id share its component; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import BROADCAST_MB, SLICED, components, cut, groups_for, lean, measured_mb, release, sliced, unsliced, without

WORDS, PERCENT = 5, 75
SAMPLED = 24  # shingles of a document that take part in a star round
GROUP, TILES = 1 << 19, 16  # shingles searched together (a document counts for 256 more); parts of a larger group
DENSE = 1 << 12  # entries of short lists from which they may be added up
ENTRIES, HOT = 1 << 18, 1 << 14  # entries sent together; repeats from which a shingle is dealt out by document
HOTS = 1 << 20  # shingles dealt out so, whatever the table's size: 16 MB that every task knows
BUCKET_BYTES = 6 << 20
LOT = 1 << 18
_r = np.random.default_rng(4)
_TABLE = _r.integers(0, 1 << 64, 256, np.uint64)
_TABLE[65:91] = _TABLE[97:123]  # A-Z hash as a-z
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: list = []


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    return (h * np.uint64(0x94D049BB133111EB)) ^ (h >> np.uint64(32))


def _powers(n: int):
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * LOT)
        _POWERS[:] = [np.cumprod(np.full(size, b, np.uint64)) for b in (_BASE, _BACK)]
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    blank = np.concatenate([[True], _BLANK[data], [True]])
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    up, back = _powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * back[:-1])])
    return _mix((sums[end] - sums[start]) * up[start] + (end - start).astype(np.uint64) * _STEP)


def _combined(w: np.ndarray, size: int) -> np.ndarray:
    out = np.full(len(w) - size + 1, np.uint64(int(size) * int(_STEP) % (1 << 64)), np.uint64)
    for j in range(size):
        out = out * _BASE + w[j:len(w) - size + 1 + j]
    return _mix(out)


def _sets_of(lot: list[bytes]):
    raw = b" ".join(lot)
    w = word_hashes(raw)
    blank = np.concatenate([[True], _BLANK[np.frombuffer(raw, np.uint8)]])
    begins = np.flatnonzero(blank[:-1] & ~blank[1:]) if len(raw) else np.zeros(0, int)
    edges = np.searchsorted(begins, np.cumsum([0] + [len(x) + 1 for x in lot]))
    every = _combined(w, WORDS) if len(w) >= WORDS else np.zeros(0, np.uint64)
    for a, b in zip(edges[:-1], edges[1:]):
        yield np.unique(every[a:b - WORDS + 1]) if b - a >= WORDS else _combined(w[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def shingle_sets(texts):
    """Sorted distinct shingle hashes of each text, one after the other; texts go through numpy in lots."""
    lot, size = [], 0
    for t in texts:
        lot.append((t or "").encode())
        size += len(lot[-1])
        if size > LOT:
            yield from _sets_of(lot)
            lot, size = [], 0
    if lot:
        yield from _sets_of(lot)


def need(n):
    """T: common shingles that a set of n needs with any partner."""
    return -(-PERCENT * n // 100)


LEAST = f"(({PERCENT} * n + 99) div 100)"


def common(n):
    """t: common shingles within the two prefixes."""
    return 1 + n // 8


def overlap(n, m):
    """Common shingles that sets of n and m need."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def _packed(to: np.ndarray, **arrays) -> pd.DataFrame:
    """One row for each value of ``to``, with the entries that go there as bytes."""
    by = np.argsort(to, kind="stable")
    parts = np.split(by, np.flatnonzero(np.diff(to[by])) + 1)
    rows = [(int(to[p[0]]), *(a[p].tobytes() for a in arrays.values())) for p in parts if len(p)]
    return pd.DataFrame(rows, columns=["bucket", *arrays])


def _unpacked(b: pd.DataFrame, **kinds) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(b[k]), t) for k, t in kinds.items()]


def _runs(*keys: np.ndarray) -> np.ndarray:
    """True where a run of equal keys begins; keys are in order."""
    first = np.ones(len(keys[0]), bool)
    if len(first):
        first[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return first


def _lots(batches, entries):
    """Entries (h, d, n) of documents, some ENTRIES together."""
    held, size = [], 0
    for b in batches:
        for doc, s in zip(b.doc_id, shingle_sets(b.text)):
            if len(s):
                p = entries(s)
                held.append((p, np.full(len(p), doc, np.int64), np.full(len(p), len(s), np.int32)))
                size += len(p)
                if size >= ENTRIES:
                    yield [np.concatenate(x) for x in zip(*held)]
                    held, size = [], 0
    if size:
        yield [np.concatenate(x) for x in zip(*held)]


def _by_doc(d: np.ndarray, buckets: int) -> np.ndarray:
    return ((d.astype(np.uint64) * _STEP >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def shared_in_prefix(docs: DataFrame, buckets: int) -> DataFrame:
    """(node, n): documents that keep enough shared shingles in their prefix in hash order.

    A shingle that several documents of a lot hold sends one entry to its own bucket; the other documents
    already know it to be shared and their entries go to buckets of documents, so no bucket grows with a hot shingle.
    """

    def send(batches):
        for h, d, n in _lots(batches, lambda s: s[:len(s) - need(len(s)) + common(len(s))]):
            order = np.lexsort((d, h))
            h, d, n = h[order], d[order], n[order]
            first = _runs(h)
            at = np.flatnonzero(first)
            known = (d[at] != d[np.append(at[1:], len(h)) - 1])[np.cumsum(first) - 1]
            to = np.where(known & ~first, _by_doc(d, buckets), (h % np.uint64(buckets)).astype(np.int64))
            yield _packed(to, h=h, d=d, n=n, known=known)

    def find(b: pd.DataFrame) -> pd.DataFrame:
        h, d, n, known = _unpacked(b, h=np.uint64, d=np.int64, n=np.int32, known=bool)
        order = np.lexsort((d, h))
        h, d, n, known = h[order], d[order], n[order], known[order]
        first = _runs(h)
        at = np.flatnonzero(first)
        many = known | (d[at] != d[np.append(at[1:], len(h)) - 1])[np.cumsum(first) - 1]
        d, n = d[many], n[many].astype(np.int64)
        order = np.lexsort((n, d))
        d, n = d[order], n[order]
        at = np.flatnonzero(_runs(d, n))
        return sliced(buckets, d[at], n[at], np.diff(np.append(at, len(d))))

    def gather(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(d, n, int(x.sum())) for d, n, x in unsliced(b, 1)], columns=["node", "n", "k"])

    sent = docs.select("doc_id", "text").mapInPandas(send, "bucket long, h binary, d binary, n binary, known binary")
    found = sent.groupBy("bucket").applyInPandas(find, SLICED)
    return found.groupBy("slice").applyInPandas(gather, "node long, n long, k long").where(f"k >= 1 + {LEAST} div 8").select("node", "n")


def hot_shingles(docs: DataFrame, buckets: int) -> DataFrame:
    """(h, df): the HOTS most repeated shingles whose repeats within lots add up to more than HOT.

    Their entries never gather by shingle; which shingles these are only decides how work is dealt out. A shingle beyond
    the HOTS first ones has less than 1 / HOTS of all entries, so what gathers by one shingle stays a small part.
    """

    def send(batches):
        for h, _, _ in _lots(batches, lambda s: s):
            h = np.sort(h)
            at = np.flatnonzero(_runs(h))
            n = np.diff(np.append(at, len(h)))
            h, n = h[at[n > 1]], n[n > 1]
            if len(h):
                yield _packed((h % np.uint64(buckets)).astype(np.int64), h=h, n=n.astype(np.int32))

    def find(b: pd.DataFrame) -> pd.DataFrame:
        h, n = _unpacked(b, h=np.uint64, n=np.int32)
        order = np.argsort(h, kind="stable")
        at = np.flatnonzero(_runs(h[order]))
        df = np.add.reduceat(n[order].astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
        return pd.DataFrame({"h": h[order][at][df > HOT].view(np.int64), "df": df[df > HOT]})

    sent = docs.select("doc_id", "text").mapInPandas(send, "bucket long, h binary, n binary")
    return sent.groupBy("bucket").applyInPandas(find, "h long, df long").orderBy(F.desc("df"), "h").limit(HOTS)


def shared_lists(docs: DataFrame, hot: DataFrame, buckets: int) -> DataFrame:
    """(node, n, k, short array, few array) of documents that keep enough shared shingles, by whole sets.

    ``short``: shingles of the document's short inverted lists: all but the T - t longest in the order (df, hash), of which
    those held once, n - k, come first and lead nowhere. ``few``: its SAMPLED shingles of least hash. df is the number of
    documents that hold a shingle, for a hot one the number that was counted in lots; it is the same for all documents.
    """
    spark = docs.sparkSession
    rows = hot.collect()
    hot_h = np.array([r.h for r in rows], np.int64).view(np.uint64)
    hot_df = np.array([r.df for r in rows], np.int64)
    order = np.argsort(hot_h)
    shared = spark.sparkContext.broadcast((hot_h[order], hot_df[order]))

    def send(batches):
        hot_h, hot_df = shared.value
        for h, d, n in _lots(batches, lambda s: s):
            at = np.minimum(np.searchsorted(hot_h, h), max(len(hot_h) - 1, 0))
            is_hot = hot_h[at] == h if len(hot_h) else np.zeros(len(h), bool)
            df = np.where(is_hot, hot_df[at], 0) if len(hot_h) else np.zeros(len(h), np.int64)
            yield _packed(np.where(is_hot, _by_doc(d, buckets), (h % np.uint64(buckets)).astype(np.int64)), h=h, d=d, n=n, df=df.astype(np.int64))

    def find(b: pd.DataFrame) -> pd.DataFrame:
        h, d, n, df = _unpacked(b, h=np.uint64, d=np.int64, n=np.int32, df=np.int64)
        order = np.lexsort((d, h))
        h, d, n, df = h[order], d[order], n[order], df[order]
        which = np.cumsum(_runs(h)) - 1
        held = np.bincount(which, _runs(h, d), which[-1] + 1).astype(np.int64)[which]
        df = np.where(df > 0, df, held)
        many = df > 1
        return sliced(buckets, d[many], n[many].astype(np.int64), h[many], df[many])

    def gather(b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for d, n, x in unsliced(b, 2):
            h, df = x[:, 0].view(np.uint64), x[:, 1]
            if len(h) >= need(n):
                short = h[np.lexsort((h, df))[:len(h) - need(n) + common(n)]]
                rows.append((d, n, len(h), short.view(np.int64), np.sort(h)[:SAMPLED].view(np.int64)))
        return pd.DataFrame(rows, columns=["node", "n", "k", "short", "few"])

    sent = docs.select("doc_id", "text").mapInPandas(send, "bucket long, h binary, d binary, n binary, df binary")
    found = sent.groupBy("bucket").applyInPandas(find, SLICED)
    return found.groupBy("slice").applyInPandas(gather, "node long, n long, k long, short array<long>, few array<long>")


def _stars(found: DataFrame) -> DataFrame:
    """(a, b): each document with the pivot that it meets most often in the lists of its sampled shingles.

    A list's pivot is the document that shares most; minima and maxima are pre-aggregated, lists are never gathered.
    """
    e = found.select("node", "n", (F.col("k") / F.col("n")).alias("share"), F.explode("few").alias("h"))
    pivot = e.groupBy("h").agg(F.max(F.struct("share", F.bitwise_not("node").alias("other"), "n")).alias("p"), F.count(F.lit(1)).alias("held")).where("held > 1")
    pivot = pivot.select("h", F.bitwise_not("p.other").alias("b"), F.col("p.n").alias("m"))
    met = e.join(pivot, "h").where(f"node <> b and {PERCENT} * n <= 100 * m and {PERCENT} * m <= 100 * n").groupBy(F.col("node").alias("a"), "b").agg(F.count(F.lit(1)).alias("k"))
    return met.groupBy("a").agg(F.max(F.struct("k", "b")).alias("best")).select("a", F.col("best.b").alias("b"))


def _routed(found: DataFrame, comp: DataFrame, cluster: DataFrame) -> DataFrame:
    """(key, tile, other, node, c): the groups of documents in which pairs of different components can meet.

    Of the short lists only those with documents of two components count, and of their documents only those that have
    t such lists. A list is named after its least pivot, so the lists of one family have few names and a document's set
    travels once to each name it has. A name with more than GROUP is split into tiles, or by list if these were many.
    """
    e = found.join(comp, "node", "left").join(cluster, "node", "left")
    e = e.select("node", "n", F.coalesce("component", "node").alias("c"), F.coalesce("g", "node").alias("g"), F.explode("short").alias("h"))
    lists = e.groupBy("h").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.min("g").alias("name")).where("x <> y").select("h", "name")
    e = cut(e.join(lists, "h").select("node", "n", "c", "h", "name"))
    enough = e.groupBy("node", "n").agg(F.count(F.lit(1)).alias("mixed")).where("mixed >= 1 + n div 8").select("node", "n")
    e = cut(e.join(_small(enough, measured_mb(enough, F.lit(24)) < BROADCAST_MB), ["node", "n"], "left_semi"))
    weight = F.sum(F.col("n") + 256)

    def sized(rows: DataFrame) -> DataFrame:
        per = rows.groupBy("key").agg(weight.alias("w"), F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y")
        return per.select("key", F.expr(f"cast((w + {GROUP - 1}) div {GROUP} as int)").alias("tiles"))

    named = e.select(F.xxhash64("name").alias("key"), "node", "n", "c").distinct()
    sizes = cut(sized(named))
    few, many = sizes.where(f"tiles <= {TILES}"), sizes.where(f"tiles > {TILES}")
    rows = named.join(few, "key")
    if not many.isEmpty():
        by_list = e.join(many.select(F.col("key").alias("k")), F.xxhash64("name") == F.col("k"), "left_semi").select(F.xxhash64("name", "h").alias("key"), "node", "n", "c")
        rows = rows.unionAll(by_list.join(sized(by_list), "key"))
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    key = F.xxhash64("key", F.least("tile", "other"), F.greatest("tile", "other"))
    return rows.select(key.alias("key"), "tile", "other", "node", "n", "c")


def merged(lists: list[np.ndarray], t: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, counts) of what occurs in ``t`` of the sorted lists: a heap merges them and skips what cannot reach t.

    Lists so dense that the heap could skip next to nothing are added up in place instead.
    """
    total, lo, hi = sum(map(len, lists)), min(x[0] for x in lists), max(x[-1] for x in lists)
    if total >= DENSE and total >= 2 * (hi - lo + 1):
        k = np.bincount(np.concatenate(lists) - lo)
        at = np.flatnonzero(k >= t)
        return at + lo, k[at]
    lists = [x.tolist() for x in lists]
    heap = [(x[0], k) for k, x in enumerate(lists)]
    heapq.heapify(heap)
    at, found = [0] * len(lists), []
    while len(heap) >= t:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap)[1])
        goal = top + 1
        if len(popped) >= t:
            found.append((top, len(popped)))
        else:
            while len(popped) < t - 1:
                popped.append(heapq.heappop(heap)[1])
            goal = max(goal, heap[0][0])
        for k in popped:
            at[k] = bisect_left(lists[k], goal, at[k])
            if at[k] < len(lists[k]):
                heapq.heappush(heap, (lists[k][at[k]], k))
    found = np.array(found, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def reaching(lists: list[np.ndarray], lo: int, hi: int, least: int, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, overlaps) of the places in [lo, hi) that occur in ``least`` of the sorted lists: DivideSkip.

    The least - t longest lists are set aside; the short ones are merged, and what occurs there t times is looked up in the
    long ones by binary search, as long as it can still reach ``least``.
    """
    spans = (x[i:j] for x in lists for i, j in [np.searchsorted(x, (lo, hi))])
    spans = sorted((x for x in spans if len(x)), key=len)
    if len(spans) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    aside = max(0, least - t)
    places, k = merged(spans[:len(spans) - aside], min(t, least))
    for left, x in zip(range(aside, 0, -1), spans[len(spans) - aside:]):
        able = k + left >= least
        places, k = places[able], k[able]
        if not len(places):
            break
        k = k + (x[np.minimum(np.searchsorted(x, places), len(x) - 1)] == places)
    return places[k >= least], k[k >= least]


def search(b: pd.DataFrame) -> pd.DataFrame:
    """Links (a, b) that join different components among the documents of one group, one for each joint.

    The documents of the largest component (of the one tile, where two meet) are looked up but do not ask.
    """
    n, c, two = b.n.to_numpy(), b.c.to_numpy(), (b.tile != b.other).any()
    if two:
        asked = (b.tile < b.other).to_numpy()
    else:
        names, count = np.unique(c, return_counts=True)
        asked = c == names[count.argmax()]
    order = np.lexsort((n, ~asked))
    n, c, node = n[order], c[order], b.node.to_numpy()[order]
    sets, first = [np.frombuffer(b.set.iloc[i], np.uint64) for i in order], int(asked.sum())
    every, own = np.unique(np.concatenate(sets), return_inverse=True)
    place = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    by = np.argsort(own, kind="stable")
    lists = np.split(place[by], np.flatnonzero(np.diff(own[by])) + 1)
    ends = np.cumsum([len(x) for x in sets])
    root = {int(k): int(k) for k in c}

    def find(k):
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    out = []
    for p in range(first, len(sets)):
        mine = [lists[s] for s in own[ends[p] - len(sets[p]):ends[p]] if len(lists[s]) > 1]
        small, large = need(int(n[p])), 100 * int(n[p]) // PERCENT
        spans = [(np.searchsorted(n[:first], small), np.searchsorted(n[:first], large, "right"))]
        if not two:
            spans.append((first + np.searchsorted(n[first:p], small), p))
        for whole, (lo, hi) in zip((not two, False), spans):
            if lo < hi and not (whole and find(int(c[p])) == find(int(c[0]))):
                for q, k in zip(*reaching(mine, lo, hi, overlap(int(n[p]), int(n[lo])), common(int(n[p])))):
                    x, y = find(int(c[p])), find(int(c[q]))
                    if x != y and k >= overlap(int(n[p]), int(n[q])):
                        root[x] = y
                        out.append((int(node[p]), int(node[q])))
                        if whole:  # one component: joined to one, joined to all
                            break
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def searched(found: DataFrame, comp: DataFrame, cluster: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) among documents of different components, enough to join all that are linked."""
    rows = cut(_routed(found, comp, cluster))
    rows = _small(rows, measured_mb(rows, F.lit(48)) < BROADCAST_MB)
    sent = sets.select(F.col("node").alias("m"), F.expr("length(set) div 8").alias("size"), "set").join(rows, (F.col("node") == F.col("m")) & (F.col("n") == F.col("size")))
    return sent.select("key", "tile", "other", "node", "n", "c", "set").groupBy("key").applyInPandas(search, "a long, b long")


def _overlap_reaches(a: np.ndarray, b: np.ndarray) -> bool:
    """The smaller sorted set probes the larger one by binary search."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < PERCENT * len(b):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose sets reach the threshold: the smaller set probes the larger by binary search."""

    @F.pandas_udf("boolean")
    def near(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_overlap_reaches(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in zip(x, y)], dtype="bool")

    def side(name: str, column: str) -> DataFrame:
        ids = _small(pairs.select(F.col(name).alias("node")).distinct(), small)
        return sets.join(ids, "node", "left_semi").select(F.col("node").alias(name), F.col("set").alias(column))

    small = measured_mb(pairs, F.lit(32)) < BROADCAST_MB
    return side("a", "x").join(_small(pairs, small), "a").join(side("b", "y"), "b").where(near("x", "y")).select("a", "b").distinct()


def _small(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(copies (doc_id, mark, first), component (node, component)) of ``docs(doc_id, text, mark)``; nodes are doc_ids."""
    lean(docs.sparkSession)
    buckets = groups_for(docs, BUCKET_BYTES)
    ids = docs.select("doc_id", "mark", F.xxhash64(F.lit(1), "text").alias("twin")).distinct()
    first = ids.groupBy("mark", "twin").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    copies = cut(ids.join(first.drop("last"), ["mark", "twin"]).where("doc_id > first").select("doc_id", "mark", "first"))
    rest = without(docs, copies)
    def only(some: DataFrame) -> DataFrame:
        ids = some.select(F.col("node").alias("w")).distinct()
        return rest.select("doc_id", "text").join(_small(ids, measured_mb(ids, F.lit(32)) < BROADCAST_MB), F.col("doc_id") == F.col("w"), "left_semi")

    def encode(batches):
        for b in batches:
            yield pd.DataFrame({"node": b.doc_id, "set": [s.tobytes() for s in shingle_sets(b.text)]})

    left = cut(shared_in_prefix(rest, buckets).select("node"))
    some = only(left)
    hot = cut(hot_shingles(some, buckets))
    found = cut(shared_lists(some, hot, buckets))
    sets = cut(only(found).mapInPandas(encode, "node long, set binary").where("length(set) > 0"))
    met = cut(_stars(found))
    cluster = met.select(F.col("a").alias("node"), F.col("b").alias("g")).unionAll(met.select(F.col("b").alias("node"), F.col("b").alias("g"))).groupBy("node").agg(F.min("g").alias("g"))
    links = cut(_verified(met, sets))
    links = links.unionAll(cut(searched(found, components(links), cluster, sets)))
    # a copy keeps a document's other texts and its own first one together
    links = links.unionAll(copies.select(F.col("doc_id").alias("a"), F.col("first").alias("b")))
    return copies, components(links)


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, n_shingles, component_id) of every distinct (doc_id, text)."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    _, comp = linked(d.where(r"doc_id is not null and text rlike '[^\\x20\\x09-\\x0D]'"))
    comp = cut(comp)
    if measured_mb(comp, F.lit(32)) < BROADCAST_MB:
        comp = F.broadcast(comp)

    @F.pandas_udf("long")
    def n_shingles(texts: pd.Series) -> pd.Series:
        return pd.Series([len(s) for s in shingle_sets(texts)], dtype="int64")

    own = d.select("doc_id", "mark", n_shingles(F.coalesce("text", F.lit(""))).alias("n_shingles"))
    own = own.join(comp, F.col("doc_id") == F.col("node"), "left")
    alone = (F.col("n_shingles") == 0)
    return own.select("doc_id", "mark", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.coalesce("component", "doc_id")).alias("component_id"))


def report(docs: DataFrame) -> DataFrame:
    return groups(docs).select("doc_id", "n_shingles", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, with all their columns, that are the first of their group; repeated rows of one doc_id stay."""
    gone = cut(groups(docs).where("component_id < doc_id").select("doc_id", "mark").distinct())
    return without(docs, gone)
