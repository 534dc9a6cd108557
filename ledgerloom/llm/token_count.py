"""Token counts by a compiled finite-state transducer (operator 5).

The BPE vocabulary is compiled, lazily and deterministically, into a transducer over characters.
Its state is what later merges can still see: the longest suffix that may begin a piece, and the
last token of every prefix inside that suffix. A transition carries the change of the emitted
token count. A text is cut into blocks of ``BLOCK`` characters, wherever that falls. Each block has
a state map from the state before it to (state after it, emitted); maps compose associatively, and a
parallel prefix scan over the blocks' maps gives the running counts, the last of them the text's.

A place between two characters that stand together in no piece resets every state. What follows a
block's first reset is therefore the same for every state and is counted at once; only the head
before it waits for the state that comes in. A block without a reset is all head.

Defined results: null text counts as empty (0 tokens); one row per input row; rows may repeat;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import lean

SPACE = "▁"
START = ("", (None,), (0,))  # state after a reset: suffix, last token of every prefix that ends in it, counts relative to now
BLOCK = 4096  # characters of a block, whose state map is computed on its own
MEMO = 400_000  # chunk outputs kept by one worker before its memory is dropped
STATES = 300_000  # compiled states kept by one worker before compilation starts anew


class PieceTransducer:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != 2 or model.normalizer_spec.name != "identity" or not model.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback and no normalisation can be compiled")
        if model.normalizer_spec.remove_extra_whitespaces or not model.normalizer_spec.add_dummy_prefix:
            raise ValueError("only models that keep white space and add the first space can be compiled")
        self.score = {p.piece: p.score for p in model.pieces if p.type == 1}
        self.alphabet = {c for p in self.score for c in p}
        self.inside = {p[i:i + 2].replace(SPACE, " ") for p in self.score for i in range(len(p) - 1)}
        self.starts = {p[:i] for p in self.score for i in range(1, len(p))}
        self.longest = max(map(len, self.score))
        if any(SPACE in p.lstrip(SPACE) for p in self.score) or "\n" in self.alphabet:
            self.chunks = re.compile(r"(?s).+").findall  # no known reset: one chunk
        else:
            self.chunks = re.compile(r" *[^ \n]+| +|\n").findall
        self.fits: dict[tuple[str, str], bool] = {}
        self.memo = _Memo(self)
        self._reset()

    def _reset(self) -> None:
        self.ids, self.states, self.step = {START: 0}, [START], {}

    def merged(self, text: str) -> list[str]:
        """Reference segmentation of a short string: best merge first, leftmost on ties."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def _fit(self, left: str | None, right: str) -> bool:
        key = (left or "", right)
        if (known := self.fits.get(key)) is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            self.fits[key] = known = self.merged(key[0] + right) == ([left, right] if left else [right])
        return known

    def _compile(self, state: int, c: str) -> tuple[int, int]:
        suffix, last, counts = self.states[state]
        if c not in self.alphabet:
            new, delta = START, len(c.encode())
        else:
            seen = suffix + c
            for i in range(len(seen)):  # exactly one last token agrees with what stands before it
                token = seen[i:]
                if (token in self.score or len(token) == 1) and self._fit(last[i], token):
                    delta = counts[i] + 1
                    break
            else:
                raise AssertionError(f"no last token after {seen!r}")
            keep = next((k for k in range(len(seen)) if seen[k:] in self.starts), len(seen))
            last, counts = (*last, token), (*(x - delta for x in counts), 0)
            new = (seen[keep:], last[keep:], counts[keep:])
        if (to := self.ids.get(new)) is None:
            to = self.ids[new] = len(self.states)
            self.states.append(new)
        self.step[state, c] = to, delta
        return to, delta

    def run(self, state: int, text: str) -> tuple[int, int]:
        """The state map of ``text`` at ``state``: where it leads and what it emits."""
        emitted, step = 0, self.step
        for c in text.replace(" ", SPACE):
            state, delta = step.get((state, c)) or self._compile(state, c)
            emitted += delta
        return state, emitted

    def chunk(self, text: str) -> int:
        """Emitted by a chunk that begins at a reset and ends before one; the end flushes nothing more."""
        if len(self.states) > STATES:
            self._reset()
        return self.run(0, text)[1]

    def block(self, text: str) -> tuple:
        """State map of a block: (head, None) without a reset, else (head, (state after the block, emitted after the head))."""
        reset = next((i for i in range(1, len(text)) if text[i - 1:i + 1] not in self.inside), None)
        if reset is None:
            return text, None
        *chunks, last = self.chunks(text[reset:])
        emitted = sum(map(self.memo.__getitem__, chunks))
        state, n = self.run(0, last)  # the next block may go on with it
        return text[:reset], (self.states[state], emitted + n)

    def then(self, a: tuple, b: tuple) -> tuple:
        """The map of one block after another; associative."""
        (head, rest), (next_head, next_rest) = a, b
        if rest is None and head[-1] + next_head[0] in self.inside:
            return head + next_head, next_rest
        state, emitted = rest or (START, 0)  # two heads that meet at a reset: the second needs no state
        state, n = self.run(self._enter(state, next_head[0]), next_head)
        if next_rest is None:
            return head, (self.states[state], emitted + n)
        return head, (next_rest[0], emitted + n + next_rest[1])

    def _enter(self, state: tuple, c: str) -> int:
        """Number of a state (they are numbered anew after a reset of the tables); 0 if ``c`` resets it."""
        if not state[0] or state[0][-1].replace(SPACE, " ") + c not in self.inside:
            return 0
        if (known := self.ids.get(state)) is None:
            known = self.ids[state] = len(self.states)
            self.states.append(state)
        return known

    def scan(self, blocks: list[str]) -> list[int]:
        """Running counts after each block of one text, whatever the places it was cut at."""
        return [self._emitted(m) for m in prefixes(self._maps(blocks), self.then)]

    def count(self, text: str | None) -> int:
        """The scan's last value: its upward sweep alone, as no running counts are asked for."""
        if not text:
            return 0
        maps = self._maps([text[i:i + BLOCK] for i in range(0, len(text), BLOCK)])
        while len(maps) > 1:
            maps = pairwise(maps, self.then)
        return self._emitted(maps[0])

    def _maps(self, blocks: list[str]) -> list[tuple]:
        found = [b.replace(SPACE, " ") for b in blocks if b]
        return [self.block(b if i else " " + b) for i, b in enumerate(found)]

    def _emitted(self, m: tuple) -> int:
        """What a map emits at the start state."""
        head, rest = m
        return self.run(0, head)[1] + (rest[1] if rest else 0)


def pairwise(maps: list, then: Callable) -> list:
    """Upward sweep: each map composed with its right neighbour, an odd last one as it is."""
    return [then(maps[i], maps[i + 1]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]


def prefixes(maps: list, then: Callable) -> list:
    """Parallel prefix scan: pairs are composed and scanned, places between them filled in from these."""
    if len(maps) < 2:
        return maps
    pairs = prefixes(pairwise(maps, then), then)
    return [pairs[i // 2] if i % 2 or i + 1 == len(maps) else then(pairs[i // 2 - 1], m) if i else m for i, m in enumerate(maps)]


class _Memo(dict):
    def __init__(self, owner: PieceTransducer):
        super().__init__()
        self.owner = owner

    def __missing__(self, chunk: str) -> int:
        n = self.owner.chunk(chunk)
        if len(chunk) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[chunk] = n
        return n


@lru_cache(maxsize=2)
def transducer(path: str) -> PieceTransducer:
    return PieceTransducer(path)


def token_counter(path: str):
    @F.pandas_udf("long")
    def n_tokens(texts: pd.Series) -> pd.Series:
        count = transducer(path).count
        return pd.Series([count(t) for t in texts], dtype="int64")

    return n_tokens


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs``; no shuffle."""
    lean(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"),
                          token_counter(path)(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
