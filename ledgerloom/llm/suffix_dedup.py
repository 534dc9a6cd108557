"""Repeated-window removal by depth-limited radix sort of suffixes (operator 8).

A byte goes when a ``depth``-byte window over it also starts in a document of smaller doc_id. Two
suffixes that agree on ``depth`` bytes share the least of the hashed k-grams in them, so suffixes are
dealt out by that minimiser, which is the most significant digit; a run of neighbouring suffixes with
one minimiser travels as one string. Two rounds keep traffic low: the first sends minimisers alone and
finds those that two documents hold; the second sends the strings of these only. Where strings are
equal, all their windows are; the windows of the others are ordered by most-significant-digit passes
of eight bytes, in which a suffix that stands alone drops out, down to ``depth`` bytes and no further:
the groups that are left are exactly the repeated windows, compared byte by byte.

Copies of whole texts are settled before by one grouping, so a hot text is handled once. Equal strings of
one batch are settled where they are read and only the first goes on. A minimiser
that many documents of one map batch hold sends one entry to its own bucket; the others are already
known to be shared and are dealt out by document instead.

Defined results: null text is empty; rows of equal (doc_id, text) get equal results; a null doc_id
removes nothing and loses nothing; several texts of one doc_id do not affect each other; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import SLICED, cut, groups_for, lean, sliced, unsliced, without

DEPTH, GRAM = 50, 18
SEGMENT = 1 << 19  # bytes hashed at once
BUFFER = 1 << 19  # entries a mapper gathers before it sends them
BUCKET_BYTES = 8 << 20  # source bytes behind a bucket
_r = np.random.default_rng(20)
_TABLE = _r.integers(0, 1 << 64, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: minimisers are compared as 48 bits, six bytes on the wire; two that agree by chance only cost a comparison of bytes
_KEEP = np.uint64((1 << 48) - 1)
_POWERS: list = []


def _powers(n: int):
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * SEGMENT)
        both = [np.cumprod(np.full(size, b, np.uint64)) for b in (_BASE, _BACK)]
        _POWERS[:] = both
    return _POWERS[0][:n], _POWERS[1][:n]


def minimisers(data: np.ndarray, gram: int, depth: int) -> np.ndarray:
    """For each window of ``depth`` bytes the least mixed hash of its k-grams."""
    n = len(data)
    up, back = _powers(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * back)])
    h = (sums[gram:] - sums[:-gram]) * up[:n - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    size, w = 1, depth - gram + 1
    while 2 * size <= w:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[:len(h) - (w - size)], h[w - size:]) if w > size else h


def runs(segments: list[bytes], gram: int, depth: int):
    """(segment, start, windows, minimiser) of maximal runs of windows with one minimiser, and the joined bytes."""
    data = np.frombuffer(b"".join(segments), np.uint8)
    sizes = np.array([len(s) for s in segments], np.int64)
    if len(data) < depth:
        return np.zeros((0, 3), np.int64), np.zeros(0, np.uint64), data, np.zeros(0, np.int64)
    least = minimisers(data, gram, depth)
    ends = np.cumsum(sizes)
    own = np.repeat(np.arange(len(sizes)), sizes)[:len(least)]
    valid = ends[own] - np.arange(len(least)) >= depth
    fresh = valid.copy()
    fresh[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    at = np.flatnonzero(fresh)
    stop = np.flatnonzero(valid & ~np.concatenate([valid[1:] & ~fresh[1:], [False]]))
    return np.stack([own[at], at, stop - at + 1], 1), least[at] & _KEEP, data, ends - sizes


def msd_groups(data: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """Group of each suffix after ordering by ``depth`` bytes within its first group; -1 where it stands alone."""
    out = np.full(len(at), -1, np.int64)
    live, now = np.arange(len(at)), group.astype(np.int64)
    for lo in range(0, depth, 8):
        digit = np.zeros(len(live), np.uint64)
        for i in range(lo, min(lo + 8, depth)):
            digit = (digit << np.uint64(8)) | data[at[live] + i]
        order = np.lexsort((digit, now))
        live, now, digit = live[order], now[order], digit[order]
        new = np.ones(len(live), bool)
        new[1:] = (now[1:] != now[:-1]) | (digit[1:] != digit[:-1])
        now = np.cumsum(new) - 1
        many = np.bincount(now, minlength=1)[now] > 1 if len(now) else np.zeros(0, bool)
        live, now = live[many], now[many]
    out[live] = now
    return out


def _segments(batches, extra=lambda b, i: None):
    """(doc_id, mark, offset, bytes, extra) in lots of about SEGMENT bytes; long texts are cut with overlap."""
    lot, size = [], 0
    for b in batches:
        for i, (doc, mark, text) in enumerate(zip(b.doc_id, b.mark, b.text)):
            raw, more = text.encode(), extra(b, i)
            for lo in range(0, max(1, len(raw) - DEPTH + 1), SEGMENT):
                lot.append((doc, mark, lo, raw[lo:lo + SEGMENT + DEPTH - 1], more))
                size += len(lot[-1][3])
                if size >= SEGMENT:
                    yield lot
                    lot, size = [], 0
    if lot:
        yield lot


def _six(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8")[:, 0].astype(np.uint64)


def _dealt(h: np.ndarray, doc: np.ndarray, mark: np.ndarray, buckets: int) -> pd.DataFrame:
    """Entries by bucket; see the module's words on minimisers that a batch holds often."""
    order = np.lexsort((doc, h))
    sh, sd = h[order], doc[order]
    first = np.ones(len(sh), bool)
    first[1:] = sh[1:] != sh[:-1]
    start = np.flatnonzero(first)
    lowest, highest = sd[start], sd[np.append(start[1:], len(sh)) - 1]
    shared = (lowest != highest)[np.cumsum(first) - 1]
    known, lead = np.zeros(len(h), bool), np.zeros(len(h), bool)
    known[order], lead[order] = shared, first
    to = np.where(known & ~lead, doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20), h) % np.uint64(buckets)
    out = []
    by = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.diff(to[by])) + 1
    for part in np.split(by, cuts):
        if len(part):
            out.append((int(to[part[0]]), _six(h[part]), doc[part].tobytes(), mark[part].tobytes(), known[part].tobytes()))
    return pd.DataFrame(out, columns=["bucket", "h", "doc", "mark", "known"])


def shared_minimisers(docs: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, mark, h binary): the minimisers of each document that another doc_id holds too."""

    def send(batches):
        held, n = [], 0
        for lot in _segments(batches):
            table, h, _, _ = runs([x[3] for x in lot], GRAM, DEPTH)
            ids, marks = np.array([x[0] for x in lot], np.int64), np.array([x[1] for x in lot], np.int64)
            held.append((h, ids[table[:, 0]], marks[table[:, 0]]))
            n += len(h)
            if n >= BUFFER:
                yield _dealt(*map(np.concatenate, zip(*held)), buckets)
                held, n = [], 0
        if n:
            yield _dealt(*map(np.concatenate, zip(*held)), buckets)

    def find(b: pd.DataFrame) -> pd.DataFrame:
        doc, mark, known = (np.frombuffer(b"".join(b[c]), t) for c, t in (("doc", np.int64), ("mark", np.int64), ("known", bool)))
        h = _from_six(b"".join(b.h))
        order = np.lexsort((doc, h))
        h, doc, mark, known = h[order], doc[order], mark[order], known[order]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        start, which = np.flatnonzero(first), np.cumsum(first) - 1
        many = (doc[start] != doc[np.append(start[1:], len(h)) - 1])[which] | known
        h, doc, mark = h[many], doc[many], mark[many]
        return sliced(buckets, doc, mark, h)

    def gather(b: pd.DataFrame) -> pd.DataFrame:
        rows = [(d, m, np.unique(x[:, 0].view(np.uint64)).tobytes()) for d, m, x in unsliced(b, 1)]
        return pd.DataFrame(rows, columns=["doc_id", "mark", "h"])

    sent = docs.select("doc_id", "mark", "text").mapInPandas(send, "bucket long, h binary, doc binary, mark binary, known binary")
    found = sent.groupBy("bucket").applyInPandas(find, SLICED)
    return found.groupBy("slice").applyInPandas(gather, "doc_id long, mark long, h binary")


def _base(docs: DataFrame) -> DataFrame:
    """All rows by a key that is never null: both joins with texts read one and the same shuffle of them."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(-1 << 63)).alias("key"), F.xxhash64("text").alias("mark"))


def repeats(docs: DataFrame, shared: DataFrame, buckets: int) -> DataFrame:
    """Spans (start, end) by (doc_id, mark), packed by slice: what smaller doc_ids hold too."""
    lists = shared.select(F.col("doc_id").alias("key"), "mark", "h")
    held = _base(docs).join(lists.hint("shuffle_hash"), ["key", "mark"]).select("doc_id", "mark", "text", "h")

    def send(batches):
        rows, n = [], 0
        for lot in _segments(batches, lambda b, i: np.frombuffer(b.h.iloc[i], np.uint64)):
            table, h, data, base = runs([x[3] for x in lot], GRAM, DEPTH)
            raw = data.tobytes()
            edge = np.searchsorted(table[:, 0], np.arange(len(lot) + 1))
            for k, (doc, mark, lo, _, want) in enumerate(lot):
                mine = slice(edge[k], edge[k + 1])
                hit = np.flatnonzero(np.isin(h[mine], want)) + edge[k]
                for i in hit:
                    s, w = int(table[i, 1]), int(table[i, 2])
                    rows.append((int(h[i] % np.uint64(buckets)), int(h[i].view(np.int64)), doc, mark, lo + s - int(base[k]), raw[s:s + w + DEPTH - 1]))
                n += len(hit)
            if n >= BUFFER // 8:
                yield _packed(_first_of_equal(rows, buckets))
                rows, n = [], 0
        if rows:
            yield _packed(_first_of_equal(rows, buckets))

    def find(b: pd.DataFrame) -> pd.DataFrame:
        lowest: dict[bytes, int] = {}
        entries, gone = [], []
        for h, doc, mark, start, size, data in zip(b.h, b.doc, b.mark, b.start, b.sizes, b.data):
            at, data = 0, zlib.decompress(data)
            for e in zip(np.frombuffer(h, np.int64).tolist(), np.frombuffer(doc, np.int64).tolist(), np.frombuffer(mark, np.int64).tolist(), np.frombuffer(start, np.int64).tolist(), np.frombuffer(size, np.int64).tolist()):
                if e[4] < 0:
                    gone.append((e[1], e[2], e[3], e[3] - e[4]))
                    continue
                s = data[at:at + e[4]]
                at += e[4]
                entries.append((*e[:4], s))
                if lowest.get(s, e[1]) >= e[1]:
                    lowest[s] = e[1]
        open_: dict[int, list] = {}
        for h, doc, mark, start, s in entries:
            if lowest[s] < doc:
                gone.append((doc, mark, start, start + len(s)))
            else:
                open_.setdefault(h, []).append((doc, mark, start, s))
        strings = [(g, *x) for g, (h, xs) in enumerate(open_.items()) if len({x[0] for x in xs}) > 1 for x in xs]
        del entries, lowest, open_
        lot, size, last = [], 0, None
        for x in strings:  # whole minimiser groups, some millions of windows at once
            if size > 1 << 21 and x[0] != last:
                gone += _windows(lot)
                lot, size = [], 0
            lot.append(x)
            size, last = size + len(x[4]), x[0]
        if lot:
            gone += _windows(lot)
        a = np.array(gone, np.int64).reshape(-1, 4)
        return sliced(buckets, a[:, 0].copy(), a[:, 1].copy(), a[:, 2], a[:, 3])

    sent = held.mapInPandas(send, "bucket long, h binary, doc binary, mark binary, start binary, sizes binary, data binary")
    return sent.groupBy("bucket").applyInPandas(find, SLICED)


def _first_of_equal(rows: list, buckets: int) -> list:
    """Of equal strings only those of the least document go on to their minimiser; the others are spans already, dealt out by document.

    So a string that many documents hold goes to its bucket once for each lot.
    """
    least: dict[bytes, int] = {}
    for r in rows:
        if least.get(r[5], r[2]) >= r[2]:
            least[r[5]] = r[2]
    return [r if r[2] == least[r[5]] else ((r[2] * 0x9E3779B97F4A7C15 >> 20) % buckets, *r[1:5], -len(r[5])) for r in rows]


def _packed(rows: list) -> pd.DataFrame:
    """Rows (bucket, h, doc_id, mark, start, string) by bucket; a number below zero instead of a string is a span's length."""
    rows.sort(key=lambda r: r[0])
    out, lo = [], 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or rows[i][0] != rows[lo][0]:
            part = rows[lo:i]
            ints = [np.array([r[k] for r in part], np.int64).tobytes() for k in (1, 2, 3, 4)]
            sizes = [r[5] if isinstance(r[5], int) else len(r[5]) for r in part]
            out.append((part[0][0], *ints, np.array(sizes, np.int64).tobytes(), zlib.compress(b"".join(r[5] for r in part if not isinstance(r[5], int)), 1)))
            lo = i
    return pd.DataFrame(out, columns=["bucket", "h", "doc", "mark", "start", "sizes", "data"])


def _windows(lot: list) -> list:
    """Spans of windows that a smaller doc_id holds, among strings (group, doc_id, mark, start, bytes)."""
    data = np.frombuffer(b"".join(x[4] for x in lot), np.uint8)
    sizes = np.array([len(x[4]) for x in lot], np.int64)
    base = np.cumsum(sizes) - sizes
    n = sizes - DEPTH + 1
    own = np.repeat(np.arange(len(lot)), n)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = base[own] + inner
    doc = np.array([x[1] for x in lot], np.int64)
    group = msd_groups(data, at, np.array([x[0] for x in lot], np.int64)[own], DEPTH)
    live = np.flatnonzero(group >= 0)
    if not len(live):
        return []
    least = np.full(group.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group[live], doc[own[live]])
    hit = live[doc[own[live]] > least[group[live]]]
    if not len(hit):
        return []
    cut_ = np.flatnonzero((np.diff(own[hit]) != 0) | (np.diff(inner[hit]) > 1)) + 1
    first, last = hit[np.concatenate([[0], cut_])], hit[np.concatenate([cut_ - 1, [len(hit) - 1]])]
    return [(lot[o][1], lot[o][2], lot[o][3] + int(a), lot[o][3] + int(b) + DEPTH) for o, a, b in zip(own[first].tolist(), inner[first].tolist(), inner[last].tolist())]


def _union(spans: np.ndarray) -> np.ndarray:
    """Maximal runs covered by (start, end) rows."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)
    return np.stack([spans[new, 0], reach[last]], 1)


def spans_of(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, spans binary of disjoint (start, end) pairs) of documents that lose bytes; mark is xxhash64(text)."""
    lean(docs.sparkSession)
    buckets = groups_for(docs, BUCKET_BYTES)
    d = docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).where("doc_id is not null and text is not null")
    d = d.withColumn("doc_id", F.col("doc_id").cast("long"))
    twin = F.xxhash64(F.lit(1), "text")
    sizes = d.select("doc_id", "mark", twin.alias("twin"), F.octet_length("text").alias("n")).where(f"n >= {DEPTH}").distinct()
    first = sizes.groupBy("mark", "twin").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    copies = cut(sizes.join(first.drop("last"), ["mark", "twin"]).where("doc_id > first").select("doc_id", "mark", "n"))
    rest = without(d.where(F.octet_length("text") >= DEPTH), copies)
    parts = repeats(docs, shared_minimisers(rest, buckets), buckets)

    def whole(batches):
        for b in batches:
            doc, mark, n = (b[c].to_numpy(np.int64) for c in ("doc_id", "mark", "n"))
            yield sliced(buckets, doc, mark, np.zeros(len(n), np.int64), n)

    def gather(b: pd.DataFrame) -> pd.DataFrame:
        rows = [(d, m, _union(x).tobytes()) for d, m, x in unsliced(b, 2)]
        return pd.DataFrame(rows, columns=["doc_id", "mark", "spans"])

    every = parts.unionAll(copies.mapInPandas(whole, SLICED))
    return every.groupBy("slice").applyInPandas(gather, "doc_id long, mark long, spans binary")


@F.pandas_udf(T.StructType().add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string"))
def _digest(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    out = []
    for text, held in zip(texts, spans):
        raw = text.encode()
        u = _union(np.frombuffer(held, np.int64).reshape(-1, 2)) if held is not None else np.zeros((0, 2), np.int64)
        at, kept = 0, hashlib.sha256()
        for a, e in u.tolist():
            kept.update(raw[at:a])
            at = e
        kept.update(raw[at:])
        out.append((len(raw), int((u[:, 1] - u[:, 0]).sum()), len(u), kept.hexdigest()))
    return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    spans = spans_of(docs).select(F.col("doc_id").alias("key"), "mark", "spans")
    d = _base(docs).join(spans.hint("shuffle_hash"), ["key", "mark"], "left")
    return d.select("doc_id", _digest("text", "spans").alias("kept")).select("doc_id", "kept.*")
