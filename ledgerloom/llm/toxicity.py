"""Toxicity scores of restored text (operator 7).

Noisy-channel restoration: a character trigram model is counted over all documents; a word that
looks disguised (digits or symbols for letters, separators between single letters, repeated
letters) spans a lattice of readings, and Viterbi finds the likeliest one under channel and
language model. Where the look may be ordinary (a doubled letter, a digit or symbol at the end, two dots)
the plain word counts as well. In a word of letters alone each doubled letter is decided by itself, which gives the same reading.
Single characters in a row are read as one or several words. A logistic model over words and word beginnings of the restored text gives the score.

Labels are learned from at most ``SAMPLE`` rows (least hash, outside the held-out fifth) and at
most ``FEATURES`` features; the language model and the scoring cover every row and whole texts. Null
and empty texts score the prior; rows may repeat; extra columns are ignored; an empty table gives
an empty result; without labels of both kinds every score is the prior (0.5 where there are none).
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, held_out, lean

SAMPLE, FEATURES, SUPPORT = 8000, 1000, 3
MEMO = 300_000
# Which letters a digit or symbol may stand for.
READINGS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
            "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¢": "c"}
SEPARATORS = " .-_*~'"
SWAP, DROP, COLLAPSE = 1.5, 0.2, 0.7  # channel costs in nats: read a symbol as a letter, skip a separator, shorten a run
PAIR = 3.0  # read a doubled letter as one: most are ordinary spelling
N = 60  # 0 word boundary, 1-26 a-z, 27-58 Latin letters with marks, 59 any other letter
_CODE = np.zeros(0x250, np.int64)
for _c in range(0x250):
    _s = chr(_c).lower()[:1]
    _CODE[_c] = ord(_s) - 96 if "a" <= _s <= "z" else 27 + ord(_s) - 0xE0 if len(_s) == 1 and 0xE0 <= ord(_s) <= 0xFF else 59 if chr(_c).isalpha() else 0
_CODES = _CODE.tolist()
DISGUISED = re.compile(r"[^\W\d_][^\w\s]*[0-9@$!|+(€£¢]+[^\w\s]*[^\W\d_]|[0-9@$!|+€£¢]+[^\W\d_]{2}|([^\W\d_])\1\1|(?:[^\W_][.\-_*~']){3}")
# Ordinary spelling or disguise: the restored words stand beside the plain ones.
DOUBTFUL = re.compile(r"[^\W_][0-9@$!|+(€£¢]+$|([^\W\d_])\1|(?<![^\W_])(?:[^\W_][.\-_*~']){2}[^\W_]")
MIXED = re.compile(r"^[^\W_]*[^\W\d_][0-9]+[^\W\d_][^\W_]*$")  # letters and digits alone, a digit between letters
SPELLED = 3  # least number of single characters in a row that are read as words
LEFT, RIGHT = "\"'`.,;:!?()[]{}<>*%&#~-_+=/\\^", "\"'`.,;:!?()[]{}<>*%&#$~-_|+=/\\^"
RIGHT_PLAIN = "".join(c for c in RIGHT if c not in READINGS)
WORDS = re.compile(r"[^\W_]+")
TWICE, THRICE = re.compile(r"(.)\1", re.S), re.compile(r"(.)\1\1", re.S)


def code(c: str) -> int:
    return _CODES[ord(c)] if ord(c) < 0x250 else 59


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(points < 0x250, _CODE[np.minimum(points, 0x24F)], 59)


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of all character trigrams of all documents; at most N ** 3 rows come to the driver."""

    def count(batches):
        total, held, size = np.zeros(N ** 3, np.int64), [], 0

        def add():
            c = np.concatenate([*held, np.zeros(2, np.int64)])
            return np.bincount(c[:-2] * N * N + c[1:-1] * N + c[2:], minlength=N ** 3)

        for b in batches:
            for t in b.text:
                held.append(codes(f"  {t} "))
                size += len(held[-1])
                if size > 1 << 20:
                    total += add()
                    held, size = [], 0
        total += add()
        at = np.flatnonzero(total)
        yield pd.DataFrame({"gram": at.astype(np.int32), "n": total[at]})

    rows = (docs.select("text").where("text is not null").mapInPandas(count, "gram int, n long")
            .groupBy("gram").agg(F.sum("n").alias("n")).toPandas())
    out = np.zeros(N ** 3)
    out[rows.gram.to_numpy(int)] = rows.n
    return out.reshape(N, N, N)


def language_model(counts: np.ndarray) -> np.ndarray:
    """Interpolated trigram costs (negative log probabilities, float32)."""
    uni = counts.sum((0, 1)) + 0.5
    uni /= uni.sum()
    two = counts.sum(0)
    bi = (two + 20 * uni) / (two.sum(1, keepdims=True) + 20)
    tri = (counts + 20 * bi[None]) / (counts.sum(2, keepdims=True) + 20)
    return -np.log(tri).astype(np.float32)


def lattice(word: str) -> list[list[tuple[int, str, float]]]:
    """For each place of a word the readings (next place, letters, channel cost)."""
    out, i, n = [], 0, len(word)
    run = [1] * (n + 1)
    for i in range(n - 2, -1, -1):
        run[i] = run[i + 1] + 1 if word[i] == word[i + 1] else 1
    for i, c in enumerate(word):
        arcs = []
        letters = [(c, 0.0)] if len(c) == 1 and c.isalpha() else []
        letters += [(x, SWAP) for x in READINGS.get(c, "")]
        for x, cost in letters:
            arcs.append((i + 1, x, cost))
            if run[i] >= 3:
                arcs += [(i + run[i], x, cost + COLLAPSE), (i + run[i], x + x, cost + COLLAPSE)]
            elif run[i] == 2:
                arcs.append((i + 2, x, cost + PAIR))
        if c == " ":
            arcs.append((i + 1, " ", 0.0))
        if c in SEPARATORS or not letters:
            arcs.append((i + 1, "", DROP))
        out.append(arcs)
    return out


def single(word: str, cost: list[float]) -> str:
    """``restore`` for letters alone and no run over two: whether one run is shortened bears on no other, as its neighbours' letters stay."""
    out, at = [], 0
    for m in TWICE.finditer(word):
        i, x = m.start(), code(m[1])
        before, after = code(word[i - 1]) if i else 0, code(word[i + 2]) if i + 2 < len(word) else 0
        if cost[(before * N + x) * N + after] + PAIR < cost[(before * N + x) * N + x] + cost[(x * N + x) * N + after]:
            out.append(word[at:i + 1])
            at = i + 2
    return "".join(out) + word[at:]


def restore(word: str, cost: np.ndarray | list[float]) -> str:
    """The likeliest reading of a disguised word (lower case); ``cost`` as an array or, for many words, as its flat list."""
    if isinstance(cost, np.ndarray):
        cost = cost.ravel().tolist()
    if word.isalpha() and not THRICE.search(word):
        return single(word, cost)
    place = [dict() for _ in range(len(word) + 1)]
    place[0][0, 0] = (0.0, None, "")
    for i, arcs in enumerate(lattice(word)):
        for state, (so_far, _, _) in place[i].items():
            for j, letters, channel in arcs:
                (a, b), total = state, so_far + channel
                for x in letters:
                    k = code(x)
                    total += cost[(a * N + b) * N + k]
                    a, b = b, k
                if (a, b) not in place[j] or total < place[j][a, b][0]:
                    place[j][a, b] = (total, (i, state), letters)
    ends = place[-1]
    if not ends:
        return word
    state = min(ends, key=lambda s: ends[s][0] + cost[(s[0] * N + s[1]) * N])
    at, out = len(word), []
    while at or state != (0, 0):
        _, back, letters = place[at][state]
        out.append(letters)
        if back is None:
            break
        at, state = back
    return "".join(reversed(out))


def spelled(tokens: list[str]):
    """Runs of tokens that are single characters once punctuation around them is off, joined by blanks."""
    run: list[str] = []
    for t in tokens:
        c = t if len(t) == 1 else t.strip(LEFT)
        if len(c) == 1:
            run.append(c)
        elif run:
            if len(run) >= SPELLED:
                yield " ".join(run)
            run = []
    if len(run) >= SPELLED:
        yield " ".join(run)


class Reader:
    """Features of a text as restored, all or the ``wanted`` ones; remembers what each token gives."""

    def __init__(self, cost: np.ndarray, wanted=None):
        self.cost, self.wanted = cost.ravel().tolist(), None if wanted is None else frozenset(wanted)
        self.heads = frozenset(f[:-1] for f in wanted or () if f.endswith("…"))
        self.memo, self.barren, self.singles = {}, set(), set()  # tokens with features, without, of a single character

    def words(self, token: str) -> tuple[str, ...]:
        held = token if token.isalpha() else token.lstrip(LEFT).rstrip(RIGHT_PLAIN)
        if held.isalpha() and not TWICE.search(held):
            return (held,)
        bare = held.rstrip(RIGHT)
        if DISGUISED.search(bare):  # a digit inside may be meant as it stands: h2o, utf8mb4
            plain = WORDS.findall(bare) if MIXED.search(bare) else ()
            known = tuple(dict.fromkeys((*WORDS.findall(restore(bare, self.cost)), *plain)))
        else:
            known = tuple(WORDS.findall(bare))
        if DOUBTFUL.search(held):
            known = tuple(dict.fromkeys((*known, *WORDS.findall(restore(held, self.cost)))))
        return known

    def learn(self, token: str) -> tuple[str, ...]:
        given, all_ = [], self.wanted is None
        for w in self.words(token):
            if len(w) >= 3:
                if all_ or w in self.wanted:
                    given.append(w)
                if len(w) > 4:
                    if all_ or w[:4] in self.heads:
                        given.append(w[:4] + "…")
                    if all_ or w[:5] in self.heads:
                        given.append(w[:5] + "…")
        if len(token) <= 64:
            if given:
                self.memo[token] = tuple(given)
            else:
                self.barren.add(token)
        if len(token) == 1 or not token.isalpha() and len(token.strip(LEFT)) == 1:
            self.singles.add(token)
        return tuple(given)

    def features(self, text: str) -> set[str]:
        if len(self.memo) + len(self.barren) + len(self.singles) >= MEMO:  # between texts: a text's own tokens are all known below
            self.memo.clear(), self.barren.clear(), self.singles.clear()
        found: set[str] = set()
        tokens = text.lower().split()
        for token in set(tokens) - self.barren:
            known = self.memo.get(token)
            found.update(self.learn(token) if known is None else known)
        if b"\1" * SPELLED in bytes(map(self.singles.__contains__, tokens)):
            for run in spelled(tokens):
                found.update(WORDS.findall(restore(run, self.cost)))
        return found if self.wanted is None else found & self.wanted


class ToxicityModel:
    def __init__(self, cost: np.ndarray, weights: dict[str, float], bias: float):
        self.cost, self.weights, self.bias = cost, weights, bias
        self._reader = None

    def __getstate__(self):
        return self.__dict__ | {"_reader": None}

    def score(self, text: str | None) -> float:
        if self._reader is None:
            self._reader = Reader(self.cost, self.weights)
        known = self._reader.features(text or "")
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(self.weights[k] for k in sorted(known)), -30, 30))))


def _logistic(rows: list[list[int]], y: np.ndarray, width: int, steps: int = 400, decay: float = 1e-5) -> np.ndarray:
    x = np.zeros((len(rows), width + 1), np.float32)
    x[:, width] = 1
    for i, r in enumerate(rows):
        x[i, r] = 1
    w, m, v = np.zeros(width + 1), 0.0, 0.0
    w[width] = np.log(y.mean() / (1 - y.mean()))
    for k in range(1, steps + 1):
        g = x.T @ ((1 / (1 + np.exp(-(x @ w)))) - y) / len(y)
        g[:width] += decay * w[:width]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.999 ** k)) + 1e-8)
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, width: int = FEATURES) -> ToxicityModel:
    """Count the language model over all of ``docs``, then fit on a bounded labelled sample."""
    lean(docs.sparkSession)
    cost = language_model(trigram_counts(docs))
    learn = labels.select("doc_id", F.col("toxic").alias("y")).where("doc_id is not null and y in (0, 1)").where(~held_out(F.col("doc_id")))
    learn = learn.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2")
    learn = learn.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", "y")
    # of a doc_id with several texts the least one is learned from: rows that repeat do not add to the sample
    seen = cut(docs.select("doc_id", "text").join(F.broadcast(learn), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")))

    def tally(batches):
        reader, all_, bad = Reader(cost), Counter(), Counter()
        n = [0, 0]
        for b in batches:
            for t, y in zip(b.text, b.y):
                f = reader.features(t or "")
                n[y] += 1
                all_.update(f)
                if y:
                    bad.update(f)
        yield pd.DataFrame({"feature": ["", *all_], "bad": [n[1], *(bad[k] for k in all_)], "n": [sum(n), *all_.values()]})

    counted = seen.mapInPandas(tally, "feature string, bad long, n long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    total = counted.where("feature = ''").first()
    if not total or not 0 < total.bad < total.n:
        return ToxicityModel(cost, {}, 0.0)
    base = total.bad / total.n
    gain = (F.log((F.col("bad") + 0.5 * base) / (F.col("n") + 0.5)) - F.log(F.lit(base))) * F.sqrt("bad")
    best = counted.where(f"feature <> '' and bad >= {SUPPORT}").orderBy(gain.desc(), "feature").limit(width).select("feature").toPandas().feature
    index = {k: i for i, k in enumerate(best)}

    def pick(batches):
        reader = Reader(cost, index)
        for b in batches:
            yield pd.DataFrame({"y": b.y, "has": [sorted(index[k] for k in reader.features(t or "")) for t in b.text]})

    rows = seen.mapInPandas(pick, "y int, has array<int>").toPandas()
    rows = rows.assign(key=[tuple(h) for h in rows.has]).sort_values(["key", "y"])
    w = _logistic([list(h) for h in rows.has], rows.y.to_numpy(float), len(index))
    return ToxicityModel(cost, {k: float(w[i]) for k, i in index.items()}, float(w[-1]))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``; a narrow map once the model is fitted."""
    model = fit(docs, labels)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.coalesce("text", F.lit(""))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
