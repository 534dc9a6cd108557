"""Phrase collocations from depth-limited count tries (operator 12).

The texts of a task are dealt into shards of ``SHARD`` bytes. A shard's count trie holds every phrase of up to
``depth`` words that may reach the minimum, with its occurrences; it is serialised in the order of its words
and cut at ranges of its two-word prefixes (ranges of their hash, so no sampling is needed and no range is
larger for a frequent first word). Runs of one range are k-way merged, ``FAN`` at a time until one is left.
A walk over the merged trie gives a phrase its left parts (its ancestors); right parts come by suffix links, a
join of each depth with the one above it; one-word parts come from the words' own tries.

What may reach the minimum is known from a pass before: each shard counts its words and pairs by hash, counts
are summed by range of the hash, and the hashes that reach the minimum set bits of one filter. The filter
only keeps phrases out of the tries that cannot reach the minimum, as every phrase is at most as frequent
as its words and pairs; counts in the tries are exact whatever it lets through, so its size (``BITS`` at
most, whatever the table's) decides about space and not about results. A pass over the documents has no
state beyond a shard.

Defined results: null text counts as empty, null lang as ``und``; rows count as often as they stand;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut

MINIMUM, TOP, DEPTH, ABSORBED = 30, 2000, 4, 80  # occurrences, rows of a language, words, per cent
SHARD, BLOCK = 16 << 20, 1 << 20  # bytes of text of a shard, and that are split at once
FAN = 64  # runs merged at once
BITS, BITS_EACH, PROBES = 1 << 29, 16, 3  # of the filter: at most, for each hash, bits set by one
TO_PIECES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
NONE, BREAK = 0, 1  # ids of no word at all, and of a piece's end
NODES = "lang string, kind int, range long, run long, trie binary, words long"


class Words:
    """Words of one language in a shard: ids in the order of the text, a BREAK between pieces."""

    def __init__(self):
        self.ids = defaultdict()
        self.ids.default_factory = self.ids.__len__
        assert (self.ids[b""], self.ids[b"\n"]) == (NONE, BREAK)
        self.found = []

    def add(self, texts: list[bytes]) -> None:
        data, at = b"\n".join(texts).translate(TO_PIECES) + b"\n", 0
        while at < len(data):
            end = data.find(b"\n", min(at + BLOCK, len(data) - 1)) + 1
            words = data[at:end].replace(b"\n", b" \n ").split(b" ")
            found = np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words))
            self.found.append(found[found != NONE])
            at = end

    def close(self) -> tuple[list[bytes], np.ndarray]:
        return list(self.ids), np.concatenate(self.found)


def shards(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """(lang, words by id, ids) of each language of each shard of a task's rows (lang, bytes of the text)."""
    langs, size = defaultdict(Words), 0
    for batch in batches:
        texts = defaultdict(list)
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            texts[lang].append(text)
            size += len(text)
            if size >= SHARD:
                for x in texts:
                    langs[x].add(texts[x])
                yield from ((x, *langs[x].close()) for x in sorted(langs))
                langs, size = defaultdict(Words), 0
                texts.clear()
        for x in texts:
            langs[x].add(texts[x])
    yield from ((x, *langs[x].close()) for x in sorted(langs))


class Hashes:
    """Places of words and pairs of a shard's language in one space of hashes, cut into ``ranges`` (a power of two)."""

    def __init__(self, lang: str, words: list[bytes], ids: np.ndarray, ranges: int):
        seed = xxhash.xxh64_intdigest(lang.encode())
        of = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))
        self.shift = np.uint64(64 - (ranges.bit_length() - 1))
        self.words = self._place(of)
        here = (ids[:-1] > BREAK) & (ids[1:] > BREAK)
        self.at = np.flatnonzero(here)  # where pairs begin
        left, right = of[ids[:-1][here]], of[ids[1:][here]]
        mixed = (left * np.uint64(0x9E3779B97F4A7C15) ^ right >> np.uint64(29)) + right * np.uint64(0xC2B2AE3D27D4EB4F)
        self.pairs = self._place((mixed ^ mixed >> np.uint64(31)) * np.uint64(0x165667B19E3779F9))

    def _place(self, h: np.ndarray) -> np.ndarray:
        top = h >> self.shift if self.shift < 64 else np.zeros_like(h)
        return top << np.uint64(32) | h & np.uint64(0xFFFFFFFF)


def range_of(place: np.ndarray) -> np.ndarray:
    return (place >> np.uint64(32)).astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _probes(places: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Bits that a hash sets; ``bits`` is a power of two."""
    h = (places ^ places >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    step = (h >> np.uint64(33)) * np.uint64(2) + np.uint64(1)
    for i in range(PROBES):
        yield ((h >> np.uint64(3)) + np.uint64(i) * step) & np.uint64(bits - 1)


def passes(places: np.ndarray, bits: np.ndarray) -> np.ndarray:
    ok = np.ones(len(places), bool)
    for p in _probes(places, 8 * len(bits)):
        ok &= (bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return ok


def frequent_filter(texts: DataFrame, minimum: int, ranges: int) -> np.ndarray:
    """A bit filter that every word and pair with ``minimum`` occurrences passes, and few others."""
    def count(batches):
        for lang, words, ids in shards(batches):
            h = Hashes(lang, words, ids, ranges)
            often = np.bincount(ids, minlength=len(words))[BREAK + 1:]
            pairs, n = np.unique(h.pairs, return_counts=True)
            places, n = summed(np.r_[h.words[BREAK + 1:], pairs], np.r_[often, n])
            own = range_of(places)
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)] if len(own) else []
            rows = [(int(own[lo]), places[lo:hi].astype("<u4").tobytes(), n[lo:hi].astype("<i8").tobytes()) for lo, hi in zip(cuts, cuts[1:])]
            columns = list(zip(*rows)) or [()] * 3
            kinds = pa.int64(), pa.binary(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["range", "keys", "counts"])

    def reach(group: pa.Table) -> pa.Table:
        keys, n = summed(*(np.frombuffer(b"".join(group.column(c).to_pylist()), t) for c, t in (("keys", "<u4"), ("counts", "<i8"))))
        keys = keys[n >= minimum].astype(np.uint64) | np.uint64(group.column("range")[0].as_py() << 32)
        return pa.table({"place": keys.astype(np.int64)})

    counted = texts.mapInArrow(count, "range long, keys binary, counts binary")
    found = cut(counted.groupBy("range").applyInArrow(reach, "place long"))
    bits = min(BITS, max(1 << 15, 1 << (BITS_EACH * found.count() - 1).bit_length()))

    def positions(batches):
        for batch in batches:
            places = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(list(_probes(places, bits))).astype(np.int64) + 1)], ["bit"])

    chunks = found.mapInArrow(positions, "bit long").groupBy(F.bitmap_bucket_number("bit").alias("chunk"))
    out = np.zeros(bits // 8, np.uint8)
    for chunk, bitmap in chunks.agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit"))).collect():  # bounded by BITS
        size = min(len(bitmap), len(out))
        out[(chunk - 1) * size:chunk * size] = np.frombuffer(bytes(bitmap), np.uint8)[:size]
    return out


def _lines(words: list[bytes], counts: np.ndarray, level: int, below: list[bytes] | None, starts) -> list[bytes]:
    """A line for each node of a level, tabs in front by depth, the lines of its subtree behind it."""
    tabs = b"\t" * level
    if below is None:
        return [b"%b%b\t%d\n" % (tabs, w, n) for w, n in zip(words, counts.tolist())]
    return [b"%b%b\t%d\n%b" % (tabs, w, n, b"".join(below[lo:hi])) for w, n, lo, hi in zip(words, counts.tolist(), starts, starts[1:])]


def trie(lang: str, words: list[bytes], ids: np.ndarray, bits: np.ndarray, ranges: int, depth: int) -> Iterator[tuple[int, int, bytes]]:
    """(kind, range, serialised part) of a shard's trie: kind 1 has single words, kind 2 the phrases of two words and more."""
    h = Hashes(lang, words, ids, ranges)
    kept = passes(h.words, bits)
    kept[:BREAK + 1] = False
    order = sorted(np.flatnonzero(kept).tolist(), key=words.__getitem__)
    rank = np.full(len(words), -1, np.int64)
    rank[order] = np.arange(len(order))
    names = [words[i] for i in order]
    often = np.bincount(ids, minlength=len(words))
    yield from _by_range(1, range_of(h.words[order]), _lines(names, often[order], 0, None, ()))
    ok = np.zeros(len(ids), bool)  # a pair that may be frequent begins here
    ok[h.at] = passes(h.pairs, bits)
    place = np.zeros(len(ids), np.uint64)
    place[h.at] = h.pairs
    at = rank[ids]
    ok[:-1] &= (at[:-1] >= 0) & (at[1:] >= 0)
    size, node, starts, levels = max(len(names), 1), at, np.flatnonzero(ok), []
    for level in range(2, depth + 1):
        keys, first, inverse, n = np.unique(node[starts] * size + at[starts + level - 1], return_index=True, return_inverse=True, return_counts=True)
        levels.append((keys // size, keys % size, n, place[starts[first]]))
        node = np.zeros(len(ids), np.int64)
        node[starts] = inverse
        starts = starts[ok[starts + level - 1]]
    below, cuts = None, ()
    for level in range(depth, 2, -1):
        parents, last, n, _ = levels[level - 2]
        below = _lines([names[i] for i in last.tolist()], n, level - 2, below, cuts)
        cuts = np.searchsorted(parents, np.arange(len(levels[level - 3][0]) + 1)).tolist()
    left, right, n, where = levels[0]
    pairs = [names[i] + b" " + names[j] for i, j in zip(left.tolist(), right.tolist())]
    yield from _by_range(2, range_of(where), _lines(pairs, n, 0, below, cuts))


def _by_range(kind: int, ranges: np.ndarray, lines: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    order = np.argsort(ranges, kind="stable")
    own = ranges[order]
    cuts = np.flatnonzero(np.diff(own)) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield kind, int(ranges[part[0]]), b"".join(lines[i] for i in part.tolist())


def parsed(part: bytes) -> Iterator[tuple[tuple[bytes, ...], int]]:
    """(words, occurrences) of the nodes of a serialised part, in order."""
    path = []
    for line in part.split(b"\n")[:-1]:
        head, _, n = line.rpartition(b"\t")
        word = head.lstrip(b"\t")
        if (level := len(head) - len(word)) == 0:
            path = word.split(b" ")
            width = len(path) - 1
        else:
            path = path[:width + level]
            path.append(word)
        yield tuple(path), int(n)


def merged(parts: list[bytes]) -> Iterator[tuple[tuple[bytes, ...], int]]:
    """k-way merge of sorted runs; equal nodes become one."""
    for path, same in groupby(heapq.merge(*map(parsed, parts)), key=itemgetter(0)):
        yield path, sum(n for _, n in same)


def _merge_run(group: pa.Table) -> pa.Table:
    lines = []
    for path, n in merged(group.column("trie").to_pylist()):
        level = max(len(path) - 2, 0)
        lines.append(b"\t" * level + (path[-1] if level else b" ".join(path)) + b"\t%d\n" % n)
    first = group.slice(0, 1)
    at = group.schema.get_field_index("trie")
    return first.set_column(at, "trie", pa.array([b"".join(lines)], pa.binary())).select([c.split()[0] for c in NODES.split(", ")])


def walk(parts: list[bytes], minimum: int) -> Iterator[tuple]:
    """(words, occurrences, those of its ancestors of two words and more) of nodes that reach the minimum."""
    above = {}
    for path, n in merged(parts):
        above[len(path)] = n
        if n >= minimum:
            yield path, n, [above[k] for k in range(2, len(path))]


def phrases(docs: DataFrame, minimum: int = MINIMUM, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, m, first, prefix, suffix, a, ancestors) of phrases that reach the minimum, (lang, n) of all words)."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    runs = texts.rdd.getNumPartitions()
    ranges = 1 << (2 * runs - 1).bit_length()
    sent = texts.sparkSession.sparkContext.broadcast(frequent_filter(texts, minimum, ranges))
    names = [c.split()[0] for c in NODES.split(", ")]
    types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]

    def tries(batches):
        run = TaskContext.get().partitionId()
        for lang, words, ids in shards(batches):
            rows = [(lang, 0, 0, run, None, int((ids > BREAK).sum()))]
            rows += [(lang, kind, r, run, part, None) for kind, r, part in trie(lang, words, ids, sent.value, ranges, depth)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def walked(group: pa.Table) -> pa.Table:
        lang, out = group.column("lang")[0].as_py(), []
        for path, n, ancestors in walk(group.column("trie").to_pylist(), minimum):
            texts = [b" ".join(p).decode() for p in (path, path[:1], path[:-1], path[1:])]
            out.append((lang, texts[0], len(path), *texts[1:], n, ancestors))
        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64())]
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 8, kinds)], ["lang", "phrase", "m", "first", "prefix", "suffix", "a", "ancestors"])

    made = cut(texts.mapInArrow(tries, NODES))
    parts = made.where("kind > 0")
    while runs > FAN:
        runs = -(-runs // FAN)
        parts = parts.withColumn("run", F.expr(f"run div {FAN}")).groupBy("lang", "kind", "range", "run").applyInArrow(_merge_run, NODES)
    found = parts.groupBy("lang", "kind", "range").applyInArrow(walked, "lang string, phrase string, m int, first string, prefix string, suffix string, a long, ancestors array<long>")
    return cut(found), made.where("kind = 0").groupBy("lang").agg(F.sum("words").alias("n"))


SCORE = "cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(lefts[k - 1] as decimal(19,0)) + cast(rights[k - 1] as decimal(19,0)))"


def collocations(docs: DataFrame, minimum: int = MINIMUM, top: int = TOP, depth: int = DEPTH, absorbed: int = ABSORBED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to ``depth`` words.

    A phrase is dropped where a longer one that holds it has ``absorbed`` per cent of its occurrences: if any has,
    one with a single word more has, as it occurs at least as often and so is among the phrases too.
    """
    found, totals = phrases(docs, minimum, depth)
    single = found.where("m = 1").select("lang", F.col("phrase").alias("first"), F.col("a").alias("fa"))
    above = found.where("m = 1").select("lang", F.col("phrase").alias("suffix"), F.col("a").alias("sa"), F.array().cast("array<long>").alias("sr"))
    levels = []
    for m in range(2, depth + 1):
        d = found.where(F.col("m") == m).join(above, ["lang", "suffix"]).withColumn("rights", F.concat(F.array("sa"), "sr")).drop("sa", "sr")
        above = d.select("lang", F.col("phrase").alias("suffix"), F.col("a").alias("sa"), F.col("rights").alias("sr"))
        levels.append(d)
    d = levels[0]
    for more in levels[1:]:
        d = d.unionByName(more)
    d = d.join(single, ["lang", "first"]).withColumn("lefts", F.concat(F.array("fa"), "ancestors"))
    longer = found.where("m > 2").select("lang", F.explode(F.array("prefix", "suffix")).alias("phrase"), "a")
    d = d.join(longer.groupBy("lang", "phrase").agg(F.max("a").alias("most")), ["lang", "phrase"], "left")
    d = d.where(f"most IS NULL OR 100 * most < {int(absorbed)} * a")
    cuts = f"transform(sequence(1, m - 1), k -> named_struct('score', {SCORE}, 'k', k, 'l', lefts[k - 1], 'r', rights[k - 1]))"
    d = d.withColumn("cut", F.array_min(F.expr(cuts))).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    d = d.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return d.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
