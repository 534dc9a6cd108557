import random
import re
from collections import Counter

import numpy as np

from ledgerloom.llm import line_dedup
from ledgerloom.llm import ngram_join as j


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    inter = Counter()
    for ids in by.values():
        for x in range(len(ids)):
            for y in range(x):
                inter[min(ids[x], ids[y]), max(ids[x], ids[y])] += 1
    for (a, b), k in inter.items():
        if 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(spark, docs):
    df = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, mark int")
    assert {x.doc_id: tuple(x)[1:] for x in j.report(df).collect()} == brute(docs)


def test_sets():
    texts = ["A b C d e f a b c d e", "\tone  two\n", "", None, " ", "É é x y z", "a b c d e " * 3000]
    assert [len(s) for s in j.shingle_sets(texts)] == [len(shingles(t)) for t in texts]
    a, b = j.shingle_sets(["A b c d e", "a B\nc\td e"])
    assert (a == b).all() and next(j.shingle_sets(["a b"])) != next(j.shingle_sets(["ab"]))


def test_random_near_copies(spark):
    r = random.Random(8)
    word = lambda: r.choice(["ka", "lo", "mi", "ne", "ru"]) + r.choice(["sa", "to", "vi", "x", "zu"]) + r.choice("abcdefgh")
    hot = [word() for _ in range(30)]
    docs, n = [], 0
    for g in range(60):
        base = [word() for _ in range(r.randint(3, 120))] + (hot if g % 3 == 0 else [])
        for _ in range(r.choice([1, 1, 2, 5, 12])):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 20))):
                w[r.randrange(len(w))] = word()
            docs.append((n * 7 % 1009, " ".join(w)))
            n += 1
    docs += [(2000, docs[0][1]), (2001, docs[0][1].upper()), (2002, None), (2003, ""), (2004, " "), (2005, "a b"), (2006, "A  b"), (2007, "b a")]
    check(spark, docs)


def test_fixture_filter_and_edges(spark, sf_dir):
    docs = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(spark, docs)
    t = "some words that are long enough to be a set of shingles here"
    odd = spark.createDataFrame([(None, t, "a"), (5, t, "b"), (5, t, "b"), (3, t, "c"), (4, "other words that are not at all alike to it", "d"), (7, None, "e")], "doc_id long, text string, component_id string")
    kept = j.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(None, t, "a"), (3, t, "c"), (4, "other words that are not at all alike to it", "d"), (7, None, "e")], key=str)
    assert j.report(odd.limit(0)).count() == 0


def near_copies(m, seed=3):
    """m copies of ten lines of twenty words, each word changed with two percent chance."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(3))
    base = [[word() for _ in range(20)] for _ in range(10)]
    return [(i, "\n".join(" ".join(word() if r.random() < 0.02 else w for w in line) for line in base)) for i in range(m)]


def test_rows_grow_with_a_group_and_not_with_its_square(spark, monkeypatch):
    """Fragments that line dedup leaves of near copies share hot shingles without linking: no step may make rows by pairs."""
    made, routed, searched = [], j._routed, j.searched

    def counted(step):
        def run(*a):
            out = j.cut(step(*a))
            made[-1].append(out.count())
            return out
        return run

    monkeypatch.setattr(j, "_routed", counted(routed))
    monkeypatch.setattr(j, "searched", counted(searched))
    for m in (150, 1200):
        docs = line_dedup.dedup(spark.createDataFrame(near_copies(m), "doc_id long, text string")).collect()
        made.append([])
        check(spark, [tuple(x) for x in docs])
        left = sum(1 for x in docs if x.text.strip())
        assert 0 < made[-1][0] <= 4 * left and made[-1][1] < left  # a document travels once to each name of its lists


def test_large_groups_and_hot_shingles_are_split(spark, monkeypatch):
    docs = [(i, t) for i, t in near_copies(120, 5)] + [(1000 + i, " ".join(t.split("\n")[:3])) for i, t in near_copies(60, 5)]
    monkeypatch.setattr(j, "HOT", 3)
    monkeypatch.setattr(j, "ENTRIES", 2000)
    for group, tiles, hots in ((4000, 99, 1 << 20), (3000, 1, 2)):  # tiles alone; lists, tiles of these, and hot shingles beyond those told to all
        monkeypatch.setattr(j, "HOTS", hots)
        monkeypatch.setattr(j, "GROUP", group)
        monkeypatch.setattr(j, "TILES", tiles)
        check(spark, docs)


def test_merges_equal_counting():
    r = random.Random(2)
    for dense in (1, 1 << 30):
        for _ in range(200):
            lists = [np.array(sorted(r.sample(range(80), r.randint(1, 60)))) for _ in range(r.randint(1, 12))]
            t, lo, hi = r.randint(1, 4), r.randint(0, 30), r.randint(31, 80)
            old, j.DENSE = j.DENSE, dense
            least = t + r.randint(0, 5)
            got = dict(zip(*map(np.ndarray.tolist, j.reaching(lists, lo, hi, least, t))))
            j.DENSE = old
            n = Counter(int(p) for x in lists for p in x if lo <= p < hi)
            assert got == {p: k for p, k in n.items() if k >= least}
