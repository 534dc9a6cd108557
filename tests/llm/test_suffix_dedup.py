import hashlib
import random

import numpy as np

from ledgerloom.llm import suffix_dedup as d


def brute(docs):
    """docs: (doc_id, text) with distinct ids."""
    held, out = {}, {}
    raws = {i: (t or "").encode() for i, t in docs}
    for i, raw in raws.items():
        for s in range(len(raw) - d.DEPTH + 1):
            w = raw[s:s + d.DEPTH]
            held[w] = min(held.get(w, i), i)
    for i, raw in raws.items():
        gone = np.zeros(len(raw) + 1, int)
        for s in range(len(raw) - d.DEPTH + 1):
            if held[raw[s:s + d.DEPTH]] < i:
                gone[s:s + d.DEPTH] = 1
        g = gone[:-1]
        kept = bytes(b for b, x in zip(raw, g) if not x)
        out[i] = (len(raw), int(g.sum()), int((np.diff(np.concatenate([[0], g, [0]])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_msd_groups():
    r = np.random.default_rng(0)
    data = r.integers(0, 2, 3000).astype(np.uint8)
    at, group = np.arange(2900), r.integers(0, 3, 2900)
    got = d.msd_groups(data, at, group, 11)
    raw = data.tobytes()
    keys = [(int(g), raw[a:a + 11]) for a, g in zip(at, group)]
    for key in set(keys):
        ids = {int(x) for x, k in zip(got, keys) if k == key}
        assert len(ids) == 1 and (ids == {-1}) == (keys.count(key) == 1)


def test_random_texts_equal_brute_force(spark, monkeypatch):
    r = random.Random(3)
    pool = ["".join(r.choice("abcdé ") for _ in range(r.randint(60, 200))) for _ in range(12)]
    docs = []
    for i in range(150):
        parts = [r.choice(pool)[r.randint(0, 30):] if r.random() < .6 else "".join(r.choice("xyzw\n") for _ in range(r.randint(0, 80))) for _ in range(r.randint(0, 6))]
        docs.append((i * 3 % 151, "".join(parts)))
    docs += [(500, docs[7][1]), (501, docs[7][1]), (502, "ab" * 4000), (503, "ab" * 3000 + "c"), (504, None), (505, "short"), (506, "short")]
    df = spark.createDataFrame([(*x, "m") for x in docs], "doc_id long, text string, mark string")
    got = {x.doc_id: tuple(x)[1:] for x in d.report(df).collect()}
    assert got == brute(docs)


def test_fixture_and_edges(spark):
    docs = [(x.doc_id, x.text) for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {x.doc_id: tuple(x)[1:] for x in d.report(df).collect()} == brute(docs)
    t = "".join(map(chr, range(40, 120)))
    odd = spark.createDataFrame([(None, t), (1, t), (1, t), (1, "z" + t), (2, t)], "doc_id long, text string")
    assert sorted((x.doc_id or 0, x.n_removed) for x in d.report(odd).collect()) == [(0, 0), (1, 0), (1, 0), (1, 0), (2, 80)]
    assert d.report(df.limit(0)).count() == 0


def test_large_ids_beside_null(spark):
    t, big = "".join(map(chr, range(40, 120))), (1 << 60) + 1
    df = spark.createDataFrame([(None, t), (big, t), (big - 1, "q" * 60), (3, t), (None, None)], "doc_id long, text string")
    got = sorted((str(x.doc_id), x.n_bytes, x.n_removed) for x in d.report(df).collect())
    assert got == sorted([("None", 80, 0), (str(big), 80, 80), (str(big - 1), 60, 0), ("3", 80, 0), ("None", 0, 0)])
