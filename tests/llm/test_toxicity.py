import numpy as np
import pytest

from ledgerloom.llm import toxicity as t

TEXT = "that idiot and this moron are pathetic losers or worthless clowns while the calm people read stupid books "


@pytest.fixture(scope="module")
def cost():
    c = t.codes("  " + TEXT * 50)
    n = np.bincount(c[:-2] * t.N ** 2 + c[1:-1] * t.N + c[2:], minlength=t.N ** 3)
    return t.language_model(n.reshape(t.N, t.N, t.N))


@pytest.mark.parametrize("seen,meant", [("m0r0n", "moron"), ("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("idiooooot", "idiot"), ("w0rthl3ss", "worthless"), ("i d i o t", "idiot"), ("$tup1d", "stupid")])
def test_restores(cost, seen, meant):
    assert t.restore(seen, cost) == meant
    assert meant in t.Reader(cost).features(f"so {seen} it is")


def test_viterbi_is_the_best_path(cost):
    def every(word, i=0):
        if i == len(word):
            yield "", 0.0
            return
        for j, letters, c in t.lattice(word)[i]:
            for rest, more in every(word, j):
                yield letters + rest, c + more

    def price(s, channel):
        k = [0, 0, *map(t.code, s), 0]
        return channel + sum(cost[a, b, c] for a, b, c in zip(k, k[1:], k[2:]))

    for word in ("m0r.0n", "1|l33", "aaab", "s-c.um"):
        best = min(price(s, c) for s, c in every(word))
        got = t.restore(word, cost)
        assert min(price(s, c) for s, c in every(word) if s == got) == pytest.approx(best, abs=1e-4)


def test_learns_and_edges(spark):
    r = np.random.default_rng(1)
    calm = "river stone cloud paper light garden winter bridge".split()
    docs = []
    for i in range(400):
        words = list(r.choice(calm, 20))
        if i % 4 == 0:
            words[r.integers(20)] = r.choice(["moron", "m0r0n", "i d i o t", "idiot", "idiooot"])
        docs.append((i, " ".join(words), 9))
    docs += [(None, None, 9), (5, "", 9), (6, "x" * 200_000, 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string, y int")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(None, 1, 1), (2, 1, None)], "doc_id long, quality int, toxic int")
    rows = t.score_toxicity(df, labels).collect()
    assert len(rows) == 403 and all(0 <= x.score <= 1 for x in rows)
    held = [x for x in rows if x.held_out and x.doc_id is not None and x.doc_id not in (5, 6)]
    assert held and all(x.predicted == int(x.doc_id % 4 == 0) for x in held)
    assert t.score_toxicity(df.limit(0), labels.limit(0)).count() == 0
    twice = t.score_toxicity(df.unionAll(df.where("doc_id < 50 or doc_id is null")), labels).collect()
    assert len(twice) == 403 + 52 + 1  # 5 and 6 have a second text
    by_id = {}
    for x in twice:
        if x.doc_id is not None and x.doc_id != 5:
            by_id.setdefault(x.doc_id, set()).add((x.score, x.predicted))
    assert all(len(v) == 1 for i, v in by_id.items() if i != 6)


@pytest.fixture(scope="module")
def reader():
    c = t.codes("  " + ("a moron and a loser met a traitor or scum " + TEXT + "they die at tras tree see ") * 50)
    n = np.bincount(c[:-2] * t.N ** 2 + c[1:-1] * t.N + c[2:], minlength=t.N ** 3)
    return t.Reader(t.language_model(n.reshape(t.N, t.N, t.N)))


@pytest.mark.parametrize("seen,meant", [("i d i o t.", "idiot"), ("l o s e r,", "loser"), ("s c u m.", "scum"), ('"i d i o t"', "idiot"), ("i  d  i  o  t", "idiot"), ("a m o r o n", "moron"),
                                        ("idio7", "idiot"), ("tra$", "tras"), ("tra$,", "tras"), ("stuupid", "stupid"), ("d.i.e", "die"), ("d.i.e.", "die")])
def test_ordinary_disguises(reader, seen, meant):
    assert meant in reader.features(f"so, {seen} they said")


def test_ordinary_spelling_stays(reader):
    assert {"tree", "windows7", "see"} <= reader.features("tree windows7! see.")


@pytest.mark.parametrize("seen", ["h2o", "b2b", "utf8mb4", "mp3", "covid19", "3d"])
def test_ordinary_words_with_digits_keep_their_plain_form(cost, seen):
    assert seen in t.Reader(cost).words(seen)


def test_fit_equals_plain_python():
    """The logistic fit against its formula, term by term."""
    import math

    r = np.random.default_rng(5)
    rows = [sorted(set(r.integers(0, 6, r.integers(0, 4)).tolist())) for _ in range(60)]
    y = np.array([float(bool({0, 1} & set(x)) != (i % 11 == 0)) for i, x in enumerate(rows)])
    got = t._logistic(rows, y, 6, steps=50)
    w, m, v = [0.0] * 7, [0.0] * 7, [0.0] * 7
    w[6] = math.log(y.mean() / (1 - y.mean()))
    for k in range(1, 51):
        g = [0.0] * 7
        for x, target in zip(rows, y):
            p = 1 / (1 + math.exp(-(w[6] + sum(w[j] for j in x))))
            for j in (*x, 6):
                g[j] += (p - target) / len(rows)
        for j in range(7):
            g[j] += 1e-5 * w[j] if j < 6 else 0
            m[j], v[j] = 0.9 * m[j] + 0.1 * g[j], 0.999 * v[j] + 0.001 * g[j] ** 2
            w[j] -= 0.1 * (m[j] / (1 - 0.9 ** k)) / (math.sqrt(v[j] / (1 - 0.999 ** k)) + 1e-8)
    assert got == pytest.approx(w, abs=1e-3)


def test_doubled_letters_need_no_lattice(cost, monkeypatch):
    """Each doubled letter of a plain word is decided by itself: the same reading as the best of all paths, without one."""
    def every(word, i=0):
        if i == len(word):
            yield "", 0.0
            return
        for j, letters, c in lattice(word)[i]:
            for rest, more in every(word, j):
                yield letters + rest, c + more

    def price(s, channel):
        k = [0, 0, *map(t.code, s), 0]
        return channel + sum(float(cost[a, b, c]) for a, b, c in zip(k, k[1:], k[2:]))

    lattice = t.lattice
    monkeypatch.setattr(t, "lattice", lambda word: pytest.fail(f"lattice of {word}"))
    r = np.random.default_rng(3)
    words = ["tt", "aab", "baa", "eessnn", "ssееtt", "ññ", *("".join(c * int(r.integers(1, 3)) for c in r.choice(list("aeimnorst"), 5)) for _ in range(60))]
    shorter = 0
    for word in words:
        if t.THRICE.search(word):
            continue
        got = t.restore(word, cost)
        assert min(price(s, c) for s, c in every(word) if s == got) == pytest.approx(min(price(s, c) for s, c in every(word)), abs=1e-4)
        shorter += got != word
    assert shorter > 5
    assert {"stupid", "stuupid", "tree"} <= t.Reader(cost).features('so "stuupid, tree.')


def test_wanted_features_are_those_of_all(cost, monkeypatch):
    words = "m0r0n i d i o t. idiooooot stuupid tra$ d.i.e h2o tree loser, losers worthless a I the book! \"s c u m\" n°5 ___ ".split(" ")
    r = np.random.default_rng(4)
    texts = ["", " ".join(words), *(" ".join(r.choice(words, 12)) for _ in range(30)), "." * 70 + "a b c " + "x" * 70]
    full = [t.Reader(cost).features(x) for x in texts]
    wanted = sorted(set().union(*full))[::2]
    for memo in (t.MEMO, 4):
        monkeypatch.setattr(t, "MEMO", memo)
        some, all_ = t.Reader(cost, wanted), t.Reader(cost)
        for x, f in [*zip(texts, full)] * 2:
            assert all_.features(x) == f and some.features(x) == f & set(wanted)
