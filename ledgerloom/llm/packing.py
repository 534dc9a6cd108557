"""Packing of documents into training sequences by sum of squares (operator 13).

A document is the ids of its text and an end id. Whole windows of a long document are sequences of their
own; the rest of it, or a shorter document, goes online into the fill level that keeps the sum of the
squared counts of partially filled windows smallest. A level array holds these counts, so a placement is
one pass over the levels whatever the number of windows. Every task packs what it reads: texts and ids are
never shuffled. What is still open at the end of a task, or when ``OPEN`` windows are open, is settled: the
emptiest windows are cut to fill the fullest, so one window at most stays open. These last windows, less
than one sequence for each task, meet in groups of ``NEAR`` tasks and are settled again; what a group has
left is cut into sequences whose lengths are powers of two, which need no padding.

Equal white-space-separated chunks have equal ids where a tokenizer drops white space, so a worker
remembers the ids of chunks it has met. For other tokenizers whole texts are encoded.

Defined results: null text counts as empty, and an empty text is the end id alone; one document for every
input row, also where doc_ids repeat or are null; extra columns are ignored; an empty table gives no
pieces. Which documents share a sequence follows from the order in which a task reads them.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut

SIZE, END = 4096, 2  # ids of a sequence; the id that ends a document
OPEN = 1024  # windows a task keeps open at most, hence OPEN * SIZE ids
NEAR = 16  # tasks whose last windows are settled together
MEMO, CHUNK = 500_000, 64  # chunks a worker remembers, twice, and the longest of them
MARKS, LATIN = frozenset(".,;:!?)"), "\u0250"  # below it every letter is a letter in any version of Unicode, and composed


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies have for each byte: printable ones stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            kinds = json.load(f).get("pre_tokenizer") or {}
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        first, *others = kinds.get("pretokenizers") or [kinds]
        drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
        self.apart = bool(drops) and not any(x.get("add_prefix_space") for x in others) and not self._ids(" ")
        self.letters, self.tokenize = _byte_letters(), self.library.model.tokenize
        try:
            self.words = self.apart and all(self._word(w.lower()) == self._ids(w) for w in ("q", "Word", "Ünité", "straße", "Ångström"))
        except Exception:  # a model that does not know these letters
            self.words = False
        self.memo = _Memo(self)

    def _ids(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of one lower-case word by the model alone: half of what a call of the whole library costs."""
        mapped = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
        return pack(f"<{len(found := self.tokenize(mapped))}I", *[t.id for t in found])

    def __call__(self, text: str) -> bytes:
        if not self.apart:
            return self._ids(text)
        return b"".join(map(self.memo.__getitem__, text.replace("\n", " ").split(" ")))


class _Memo(dict):
    """Ids by chunk. Half of it is forgotten at a time, the half that was not asked for of late."""

    def __init__(self, owner: Encoder):
        super().__init__()
        self.owner, self.old = owner, {}

    def __missing__(self, chunk: str) -> bytes:
        """Latin words in capitals or with a mark behind them are made from the word: the tokenizer splits there anyway."""
        ids = self.old.get(chunk)
        if ids is None:
            word = chunk.lower() if self.owner.words and (chunk.isascii() or max(chunk) < LATIN) else ""
            if word.isalpha():
                ids = self.owner._word(word) if word == chunk else self[word]
            elif word[-1:] in MARKS and word[:-1].isalpha():
                ids = self[word[:-1]] + self[word[-1]]
            else:
                ids = self.owner._ids(chunk)
        if len(chunk) <= CHUNK:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Packer:
    """Windows of one task. A piece is (doc_id, start, ids, doc_tokens), a window [fill, pieces]."""

    def __init__(self, size: int, first_sequence: int):
        self.size, self.next = size, first_sequence
        self.counts = np.zeros(size + 1, np.int64)  # open windows of each fill level; none at 0 and size
        self.levels: dict[int, list] = {}
        self.open, self.done = 0, []

    def add(self, doc_id, ids: bytes) -> None:
        n = len(ids) // 4
        whole = n - n % self.size
        for start in range(0, whole, self.size):
            self._close([(doc_id, start, ids[4 * start:4 * (start + self.size)], n)])
        if whole < n:
            self._place((doc_id, whole, ids[4 * whole:], n))

    def level_for(self, n: int) -> int:
        """The level (0: a new window) at which ``n`` more ids add least to the sum of squares; ties to the fullest."""
        counts = self.counts
        grows = counts[n:] - counts[:self.size + 1 - n]  # half of what is added, less one
        grows = np.where(counts[:self.size + 1 - n] > 0, 2 * grows + 2, np.iinfo(np.int64).max)
        grows[0] = 2 * counts[n] + 1
        if n < self.size:
            grows[-1] -= grows[-1] < np.iinfo(np.int64).max  # a window that becomes full is no longer counted
        return len(grows) - 1 - int(np.argmin(grows[::-1]))

    def _place(self, piece: tuple) -> None:
        n = len(piece[2]) // 4
        level = self.level_for(n)
        pieces = self._pop(level) if level else []
        pieces.append(piece)
        if level + n == self.size:
            self._close(pieces)
        else:
            self._push(level + n, pieces)
            if self.open > OPEN:
                self.settle()

    def _push(self, level: int, pieces: list) -> None:
        self.levels.setdefault(level, []).append(pieces)
        self.counts[level] += 1
        self.open += 1

    def _pop(self, level: int) -> list:
        self.counts[level] -= 1
        self.open -= 1
        return self.levels[level].pop()

    def _close(self, pieces: list) -> None:
        offset = 0
        for doc_id, start, ids, n in pieces:
            length = len(ids) // 4
            self.done.append((doc_id, start, length, zlib.crc32(ids), n, self.next, offset, None))
            offset += length
        self.next += 1

    def settle(self) -> None:
        """Fill the fullest windows with pieces of the emptiest, cut where needed, until one is open at most."""
        windows = [[level, self._pop(level)] for level in sorted(self.levels) for _ in range(len(self.levels[level]))]
        low = 0
        while low < len(windows) - 1:
            room, pieces = self.size - windows[-1][0], windows[-1][1]
            while room and low < len(windows) - 1:
                doc_id, start, ids, n = windows[low][1].pop()
                take = min(room, len(ids) // 4)
                if rest := ids[:len(ids) - 4 * take]:
                    windows[low][1].append((doc_id, start, rest, n))
                pieces.append((doc_id, start + len(rest) // 4, ids[len(rest):], n))
                room -= take
                windows[low][0] -= take
                low += not windows[low][0]
            if room:  # all other windows are used up
                windows[-1][0] = self.size - room
                break
            self._close(pieces)
            windows.pop()
        for level, pieces in windows[low:]:
            self._push(level, pieces)

    def last(self) -> list:
        """Pieces of the window that settling leaves open."""
        self.settle()
        return [p for level in sorted(self.levels) for _ in range(len(self.levels[level])) for p in self._pop(level)]

    def finish(self) -> None:
        """Cut what is open after settling at lengths that are powers of two."""
        pieces = self.last()[::-1]
        left = sum(len(p[2]) // 4 for p in pieces)
        while left:
            room, own = 1 << left.bit_length() - 1, []
            left -= room
            while room:
                doc_id, start, ids, n = pieces.pop()
                take = min(room, len(ids) // 4)
                own.append((doc_id, start, ids[:4 * take], n))
                if take < len(ids) // 4:
                    pieces.append((doc_id, start + take, ids[4 * take:], n))
                room -= take
            self._close(own)

    def flush(self) -> list:
        rows, self.done = self.done, []
        return rows


LONGS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _table(rows: list, doc_id: pa.DataType) -> pa.Table:
    names = ["doc_id", *LONGS, "ids", "task"]
    types = [doc_id, *[pa.int64()] * len(LONGS), pa.binary(), pa.int64()]
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names)


def packed(docs: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of ``docs(doc_id, text)``.

    ``path`` is a tokenizers file that every executor can read. Sequences hold ``size`` ids, or a power of two
    below it. Places in sequence_id are not dense: each task, and each group of last windows, has a range of its own.
    """
    fields = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in LONGS)}"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        encode, packer, finish, kind = encoder(path), Packer(size, task << 33), np.uint32(end).tobytes(), None
        for batch in batches:
            kind = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                packer.add(doc_id, encode(text or "") + finish)
            yield from _table([(*r, task) for r in packer.flush()], kind).to_batches()
        if kind:
            last = packer.last()
            rows = packer.flush() + [(doc_id, start, len(ids) // 4, 0, n, 0, 0, ids) for doc_id, start, ids, n in last]
            yield from _table([(*r, task) for r in rows], kind).to_batches()

    def settle(last: pa.Table) -> pa.Table:
        tasks = last.column("task").to_pylist()
        packer, windows = Packer(size, (1 << 62) + (tasks[0] // NEAR << 33)), defaultdict(list)
        for task, *piece in zip(tasks, *(last.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens"))):
            windows[task].append(tuple(piece))
        for task in sorted(windows):
            pieces = sorted(windows[task], key=lambda p: (p[1], p[2], p[3]))  # an order that a rerun has as well
            packer._push(sum(len(p[2]) // 4 for p in pieces), pieces)
        packer.finish()
        return _table([(*r, 0) for r in packer.flush()], last.schema.field("doc_id").type).drop_columns(["ids", "task"])

    found = cut(docs.select("doc_id", F.col("text").cast("string")).mapInArrow(pack, f"{fields}, ids binary, task long"))
    last = found.where("ids IS NOT NULL").groupBy(F.expr(f"task div {NEAR}").alias("near")).applyInArrow(settle, fields)
    return found.where("ids IS NULL").drop("ids", "task").unionByName(last)
