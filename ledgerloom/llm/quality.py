"""Quality classifier by gated-attention multiple-instance learning (operator 10).

A document is a bag of passages of ``PASSAGE`` bytes; every passage of the whole text is encoded
(character-class and class-pair rates, repetition, line breaks, its own length), a gated attention network learns from
document labels which passages matter, and the attention-weighted passage representation is scored.
A passage's features come from that passage alone.

The fit uses at most ``SAMPLE`` labelled documents (those of least hash, outside the held-out fifth) with whole texts of
``FIT_BYTES`` together; scoring covers every row and is a narrow map. Null and empty texts are one empty passage and get a
score too; rows may repeat, of a doc_id with several texts the least one is learned from; extra columns are ignored;
without usable labels the score is the prior 0.5.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, held_out, lean

SAMPLE, FIT_BYTES = 4000, 24 << 20
PASSAGE = 512
BLOCK = 8192  # passages encoded at once: bounds memory for very long texts
SINGLE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CLASS = np.zeros(256, np.int64)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = (0 if "a" <= _c <= "z" else 1 if "A" <= _c <= "Z" else 2 if "0" <= _c <= "9" else 3 if _c == " " else 4 if _c == "\n"
                  else 6 + SINGLE.index(_c) if _c in SINGLE else 5 if _b >= 128 else 6 + len(SINGLE))
N_CLASS = 7 + len(SINGLE)
COARSE = np.minimum(np.arange(N_CLASS), 9)
COARSE[[6 + SINGLE.index(c) for c in ".,"]] = 6
COARSE[[6 + SINGLE.index(c) for c in "|<>{}[]="]] = 7
COARSE[[6 + SINGLE.index(c) for c in "!#$%&*"]] = 8
N_PAIR = 10
WIDTH = N_CLASS + N_PAIR * N_PAIR + 4


def encode(text: str | None) -> np.ndarray:
    """(passages, WIDTH) float32 features of every passage of a text."""
    raw = (text or "").encode()
    data = np.frombuffer(raw, np.uint8)
    n = max(1, -(-len(data) // PASSAGE))
    out = np.zeros((n, WIDTH), np.float32)
    if not len(data):
        return out
    for lo in range(0, n, BLOCK):
        part = data[lo * PASSAGE:(lo + BLOCK) * PASSAGE]
        m = -(-len(part) // PASSAGE)
        at = np.arange(len(part)) // PASSAGE
        size = np.bincount(at, minlength=m)[:, None]
        kind = _CLASS[part]
        rows = out[lo:lo + m]
        rows[:, :N_CLASS] = np.bincount(at * N_CLASS + kind, minlength=m * N_CLASS).reshape(m, N_CLASS) / size
        few = COARSE[kind]
        pair = few[:-1] * N_PAIR + few[1:]
        rows[:, N_CLASS:-4] = np.bincount(at[1:] * N_PAIR * N_PAIR + pair, minlength=m * N_PAIR ** 2).reshape(m, -1) / size
    for k in range(n):
        part = raw[k * PASSAGE:(k + 1) * PASSAGE]
        ratio, size = len(zlib.compress(part, 1)) / (len(part) + 16), np.log1p(len(part)) / 10
        out[k, -4:] = ratio, size, ratio * size, min(1.0, 20 * part.count(b"\n") / len(part))
    return np.sqrt(out)


class GatedAttention:
    """score = sigmoid(w . sum_k a_k h_k + b), h = tanh(x E), a = softmax(u . (tanh(h V) * sigmoid(h G)))."""

    def __init__(self, prior: float = 0.5, hidden: int = 24, gate: int = 12, seed: int = 11):
        r = np.random.default_rng(seed)
        s = lambda *d: r.normal(0, 1 / np.sqrt(d[0]), d)
        self.mean, self.std = np.zeros(WIDTH), np.ones(WIDTH)
        self.p = {"E": s(WIDTH, hidden), "e": np.zeros(hidden), "V": s(hidden, gate), "G": s(hidden, gate), "u": s(gate), "w": np.zeros(hidden), "b": np.array(np.log(prior / (1 - prior)))}

    def _forward(self, x, bag, n):
        p = self.p
        h = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["G"])))
        s = (t * g) @ p["u"]
        top = np.full(n, -np.inf)
        np.maximum.at(top, bag, s)
        a = np.exp(s - top[bag])
        a /= np.bincount(bag, a, n)[bag]
        z = np.zeros((n, h.shape[1]))
        np.add.at(z, bag, a[:, None] * h)
        return h, t, g, a, z, 1 / (1 + np.exp(-np.clip(z @ p["w"] + p["b"], -30, 30)))

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = 60, rate: float = 0.01, decay: float = 1e-3):
        every = np.concatenate(bags)
        self.mean, self.std = every.mean(0), every.std(0) + 0.02
        bags = [(b - self.mean) / self.std for b in bags]
        r, m, v, step = np.random.default_rng(3), {}, {}, 0
        for epoch in range(epochs):
            order = r.permutation(len(bags))
            for lo in range(0, len(order), 64):
                some = order[lo:lo + 64]
                x, bag, n = np.concatenate([bags[i] for i in some]), np.repeat(np.arange(len(some)), [len(bags[i]) for i in some]), len(some)
                h, t, g, a, z, q = self._forward(x, bag, n)
                p, d = self.p, (q - y[some]) / n
                dz = d[:, None] * p["w"]
                da = (dz[bag] * h).sum(1)
                ds = a * (da - np.bincount(bag, a * da, n)[bag])
                dt, dg = ds[:, None] * p["u"] * g * (1 - t * t), ds[:, None] * p["u"] * t * g * (1 - g)
                dh = a[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["G"].T
                de = dh * (1 - h * h)
                grad = {"E": x.T @ de, "e": de.sum(0), "V": h.T @ dt, "G": h.T @ dg, "u": (t * g).T @ ds, "w": z.T @ d, "b": d.sum()}
                step += 1
                for k in p:
                    gk = grad[k] + (decay * p[k] if k != "b" else 0)
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * gk
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * gk * gk
                    p[k] = p[k] - rate * (1 - 0.9 * epoch / epochs) * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
        return self

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        x = (np.concatenate(bags) - self.mean) / self.std
        return self._forward(x, np.repeat(np.arange(len(bags)), [len(b) for b in bags]), len(bags))[-1]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, fit_bytes: int = FIT_BYTES) -> GatedAttention:
    """Fit on labelled documents outside the held-out fifth; conflicting labels of an id are dropped.

    At most ``sample`` of them, in the order of their hash as far as their texts add up to ``fit_bytes``.
    """
    lean(docs.sparkSession)
    learn = labels.select("doc_id", F.col("quality").alias("y")).where("doc_id is not null and y in (0, 1)").where(~held_out(F.col("doc_id")))
    learn = learn.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2")
    learn = learn.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", "y")

    def encoded(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "y": b.y, "bag": [encode(t).tobytes() for t in b.text]})

    texts = cut(docs.select("doc_id", "text").join(F.broadcast(learn), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")))
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    within = texts.select("doc_id", F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).over(order).alias("so_far")).where(F.col("so_far") <= fit_bytes)
    rows = texts.join(F.broadcast(within), "doc_id").select("doc_id", "y", "text").mapInPandas(encoded, "doc_id long, y int, bag binary").toPandas()
    if rows.y.nunique() < 2:
        return GatedAttention(0.5)
    rows = rows.sort_values("doc_id")
    bags = [np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in rows.bag]
    return GatedAttention(float(rows.y.mean())).fit(bags, rows.y.to_numpy(float))


def scorer(model: GatedAttention):
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out, bags, held = [], [], 0
        for t in texts:
            bags.append(encode(t))
            held += len(bags[-1])
            if held >= BLOCK:
                out.append(model.score(bags))
                bags, held = [], 0
        if bags:
            out.append(model.score(bags))
        return pd.Series(np.concatenate(out) if out else [], dtype="float64")

    return score


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    score = scorer(fit(docs, labels))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.coalesce("text", F.lit(""))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns."""
    return docs.where(scorer(fit(docs, labels))(F.coalesce("text", F.lit(""))) >= threshold)
