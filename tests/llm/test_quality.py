import math
import zlib

import numpy as np
import pytest

from ledgerloom.llm import quality


def test_encode_covers_whole_texts():
    assert quality.encode(None).shape == (1, quality.WIDTH) and quality.encode("").sum() == 0
    long = quality.encode("word " * 200_000)
    assert len(long) == -(-1_000_000 // quality.PASSAGE) and np.isfinite(long).all()
    a = quality.encode("calm words here " * 100)
    b = quality.encode("calm words here " * 100 + "!!%%$$" * 100)
    assert not np.allclose(a[:, 6:40].max(0), b[:, 6:40].max(0))


def test_attention_learns_one_bad_passage():
    r = np.random.default_rng(0)
    bags, y = [], []
    for i in range(400):
        bag = r.normal(0, 1, (r.integers(1, 8), quality.WIDTH)).astype(np.float32)
        y.append(i % 2)
        if y[-1]:
            bag[r.integers(len(bag)), :5] += 5
        bags.append(bag)
    y = np.array(y, float)
    m = quality.GatedAttention(0.5).fit(bags[:300], y[:300], epochs=30)
    assert ((m.score(bags[300:]) >= 0.5) == y[300:]).mean() > 0.9


def test_held_out_rule_and_edges(spark):
    docs = spark.createDataFrame([(i, f"good text number {i} " * 5 if i % 2 else "BAD!! %%% " * 9, "x") for i in range(200)] + [(None, None, "x"), (7, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    rows = quality.score_quality(docs, labels).collect()
    assert len(rows) == 202 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    right = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id != 7]
    assert sum(r.predicted == r.doc_id % 2 for r in right) / len(right) > 0.95
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {r.doc_id for r in rows if r.predicted} - {7}
    assert quality.score_quality(docs.limit(0), labels.limit(0)).count() == 0


def small(seed):
    r = np.random.default_rng(seed)
    bags = [r.normal(0, 1, (k, quality.WIDTH)) for k in (1, 4, 2)]
    m = quality.GatedAttention(0.4, hidden=3, gate=2, seed=seed)
    m.p["w"] = r.normal(0, 1, 3)
    return m, bags


def by_hand(p, bag):
    """Score of one bag from the formula, passage by passage."""
    dot = lambda x, y: sum(float(a) * float(b) for a, b in zip(x, y))
    hidden, weight = [], []
    for x in bag:
        h = [math.tanh(dot(x, p["E"][:, j]) + p["e"][j]) for j in range(len(p["e"]))]
        s = sum(u * math.tanh(dot(h, p["V"][:, j])) / (1 + math.exp(-dot(h, p["G"][:, j]))) for j, u in enumerate(p["u"]))
        hidden.append(h)
        weight.append(math.exp(s))
    z = [sum(w * h[j] for w, h in zip(weight, hidden)) / sum(weight) for j in range(len(p["e"]))]
    return 1 / (1 + math.exp(-(dot(z, p["w"]) + float(p["b"]))))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_scores_equal_the_formula(seed):
    m, bags = small(seed)
    assert m.score(bags) == pytest.approx([by_hand(m.p, b) for b in bags], abs=1e-12)


def test_one_step_follows_the_numerical_gradient():
    """The first step of the fit goes down the gradient of the loss: its sign in each parameter is that of a finite difference."""
    m, bags = small(5)
    y = np.array([1.0, 0.0, 1.0])
    mean, std = np.concatenate(bags).mean(0), np.concatenate(bags).std(0) + 0.02
    scaled = [(b - mean) / std for b in bags]
    start = {k: np.array(v, float) for k, v in m.p.items()}

    def loss(p):
        q = np.array([by_hand(p, b) for b in scaled])
        return -(y * np.log(q) + (1 - y) * np.log(1 - q)).mean()

    m.fit(bags, y, epochs=1, rate=1e-3, decay=0.0)
    r = np.random.default_rng(0)
    for k, v in start.items():
        for i in r.permutation(v.size)[:12]:
            at = np.unravel_index(i, v.shape)
            up, down = ({**start, k: v.copy()} for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            slope = (loss(up) - loss(down)) / 2e-5
            step = float(m.p[k][at] - v[at])
            if abs(slope) > 1e-6:
                assert step == pytest.approx(-1e-3 * np.sign(slope), rel=0.02)


def test_query_form_over_repeats_long_texts_and_clashing_names(spark):
    long = "a fine long text goes on here " * 20_000
    docs = spark.createDataFrame([(i, "good words in a row " * 9, 1.0, 1) for i in range(60)] + [(7, "good words in a row " * 9, 1.0, 1), (1000, long, 0.0, 0), (1000, long, 0.0, 0)], "doc_id long, text string, score double, predicted int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    rows = quality.score_quality(docs, labels).collect()
    assert len(rows) == 63 and [f for f in rows[0].asDict()] == ["doc_id", "held_out", "score", "predicted"]
    assert len({r.score for r in rows if r.doc_id == 1000}) == 1 and len({r.score for r in rows if r.doc_id == 7}) == 1
