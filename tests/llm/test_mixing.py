import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import mixing as m


def fill(budget, kids):
    """kids: name -> (stock, weight). Level by bisection, independent of the ordered pass."""
    if sum(c for c, _ in kids.values()) <= budget:
        return {k: float(c) for k, (c, _) in kids.items()}
    lo, hi = 0.0, budget / min(w for _, w in kids.values()) + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(c, mid * w) for c, w in kids.values()) < budget else (lo, mid)
    return {k: min(c, lo * w) for k, (c, w) in kids.items()}


def weight(path):
    return m.WEIGHTS.get("/".join(path), m.WEIGHTS.get("*/" + path[1], 1.0) if len(path) == 2 else 1.0)


def brute(rows, mark=None):
    """``mark``: hash of each text, by which rows of equal doc_id are ordered; rows of equal place are taken together."""
    t = lambda x: x.count(" ") + 1 if x else 0
    stock = defaultdict(int)
    docs = []
    for i, text, lang, source in rows:
        source, lang = source or "unknown", lang or "unknown"
        d = hashlib.md5(source.encode()).hexdigest()[0]
        leaf = ("web" if d < "8" else "forum" if d < "c" else "curated", lang, source)
        stock[leaf] += t(text)
        docs.append((i, t(text), leaf, (mark or {}).get(text, 0)))
    due = {(): float(int(sum(stock.values()) * m.FRACTION))}
    for level in range(3):
        kids = defaultdict(dict)
        for leaf in stock:
            path = leaf[:level + 1]
            kids[path[:-1]][path] = (m.MAX_EPOCHS * sum(v for k, v in stock.items() if k[:level + 1] == path), weight(path))
        due = {k: v for p, b in due.items() for k, v in fill(b, kids[p]).items()}
    out = []
    for leaf, total in stock.items():
        owed = int(round(due[leaf], 6))
        full = min(owed // total, m.MAX_EPOCHS) if total else 0
        rest = owed - full * total if full < m.MAX_EPOCHS else 0
        so_far, at = 0, {}
        key = lambda x: (hashlib.md5(f"{m.SEED}|{full}|{'' if x[0] is None else x[0]}".encode()).hexdigest(), x[0] is not None, x[0] or 0, x[3])
        for x in sorted((x for x in docs if x[2] == leaf), key=key):
            at.setdefault(key(x), so_far)
            copies = full + (at[key(x)] < rest)
            so_far += x[1]
            if copies:
                out.append((x[0], *leaf, x[1], copies))
    return sorted(out, key=str)


def test_fixture_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    want = brute(rows)
    got = sorted(map(tuple, m.report(docs).collect()), key=str)
    assert got == want
    got_tokens, all_tokens = sum(x[4] * x[5] for x in want), sum(x.count(" ") + 1 for _, x, *_ in rows if x)
    assert abs(got_tokens / all_tokens - m.FRACTION) < 0.1 and any(x[5] > 1 for x in want)


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 10), ("a", "x", "2", 1000), ("a", "y", "3", 1000), ("b", "x", "4", 1000)], "_domain string, _lang string, _source string, t long")
    got = {r._source: r._due for r in m.budgets(leaves, 400 / 3010, 1, {}).collect()}
    assert got == {"1": 10, "2": 90, "3": 100, "4": 200}
    got = {r._source: r._due for r in m.budgets(leaves.where("_domain = 'b' or _lang = 'x' and _source = '1'"), 600 / 1010, 1, {}).collect()}
    assert got == {"1": 10, "4": 590}


def test_ties_repeats_and_nulls_equal_brute_force(spark):
    """A hot leaf, a third of its rows without doc_id, repeated rows, one doc_id with several texts."""
    rows = [(i, "w " * (i % 7) + "w", "en", "hot") for i in range(300)]
    rows += [(None, f"text number {i} without an id", "en", "hot") for i in range(150)]
    rows += [(None, "the same text", "en", "hot")] * 40 + [(5, "five again", "en", "hot")] * 40 + [(i, "a b", None, None) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    mark = {r.text: r.m for r in docs.select("text", F.xxhash64("text").alias("m")).collect()}
    got = sorted(map(tuple, m.report(docs).collect()), key=str)
    assert got == brute(rows, mark)


def test_edges(spark):
    rows = [(1, "a b c", None, None, 5, 7, "x"), (1, "a b c", None, None, 5, 7, "x"), (None, "d e", "en", "s", 5, 7, "x"), (2, None, "en", "s", 5, 7, None), (3, "", "de", "s", 5, 7, "x"), (4, "w " * 50_000, "en", "t", 5, 7, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens int, n_copies int, domain string")
    out = m.mix(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "domain", "n_tokens", "n_copies"]
    got = sorted(((r.doc_id, r.source or "unknown", r.n_tokens, r.n_copies) for r in out.collect()), key=str)
    assert got == sorted(((x[0], x[3], x[4], x[5]) for x in brute([r[:4] for r in rows])), key=str)
    assert m.mix(docs.limit(0)).count() == 0
    assert m.mix(docs, fraction=5.0).agg(F.sum("n_copies")).first()[0] == 2 * 5  # both rows of 1, the null id, 2 (in a leaf that has tokens) and 4; a leaf without tokens gives none
