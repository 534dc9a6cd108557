import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import collocations as c

SCHEMA = "doc_id long, lang string, text string"


def brute(docs, minimum, top=2000, depth=4):
    counts, totals = defaultdict(Counter), Counter()
    for _, lang, text in docs:
        lower = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for m in range(1, depth + 1):
                counts[lang or "und"].update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        found = [p for p in f if len(p) > 1 and f[p] >= minimum]
        kept = []
        for p in found:
            a = f[p]
            if any(100 * f[q] >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q in found if len(q) > len(p)):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def got(df, **more):
    return sorted(tuple(r) for r in c.collocations(df, **more).collect())


def texts(n, seed, words="the of Of THE a-b é É x\x01y \xa0 ①② w1 w2 w3 w4".split(" ")):
    r, gaps = random.Random(seed), [" "] * 12 + ["  ", "\t", ". ", ",", "\n", "\r", "\x0b", "!? ", ":", "\x1c"]
    return ["".join(r.choice(words) + r.choice(gaps) for _ in range(r.randint(0, 60))) + "new york city hall " * r.randint(0, 3) for _ in range(n)]


def test_equals_brute_force(spark):
    docs = [(i, ["en", "de", None, "und", "é"][i % 5], t) for i, t in enumerate(texts(150, 1))]
    want = brute(docs, 8)
    assert len(want) > 50 and {x[0] for x in want} == {"en", "de", "und", "é"}
    df = spark.createDataFrame(docs, SCHEMA)
    assert got(df, minimum=8) == want
    assert got(df, minimum=8, top=5) == brute(docs, 8, 5)
    assert got(df, minimum=8, depth=2) == brute(docs, 8, depth=2)
    assert got(df, minimum=8, depth=3) == brute(docs, 8, depth=3)


def test_many_runs_are_merged_in_turns(spark):
    docs = [(i, "en", t) for i, t in enumerate(texts(160, 2))]
    assert got(spark.createDataFrame(docs, SCHEMA).repartition(70), minimum=5) == brute(docs, 5)


def test_filter_decides_about_space_only(spark, monkeypatch):
    """A filter of 64 bits lets everything through."""
    monkeypatch.setattr(c, "BITS", 64)
    docs = [(i, "en", t) for i, t in enumerate(texts(60, 3))]
    assert got(spark.createDataFrame(docs, SCHEMA), minimum=6) == brute(docs, 6)


def test_odd_rows(spark):
    docs = [(1, None, None), (2, "en", ""), (3, "en", " \t.,\n"), (4, "en", "a b " * 20_000), (4, "en", "a b " * 20_000), (None, "de", "x" * 100_000),
            (5, "en", "a a a a a a " * 10), (6, None, "Q R. q r"), (7, "und", "q r")]
    df = spark.createDataFrame(docs, SCHEMA)
    assert got(df, minimum=3) == brute(docs, 3)
    more = df.selectExpr("*", "1 AS words", "'x' AS range", "2 AS run", "3 AS phrase", "4 AS a", "5 AS n", "6 AS rank")
    assert got(more, minimum=3) == brute(docs, 3)
    assert got(df.limit(0)) == []
    assert got(df.where("doc_id = 2")) == []


def test_exact_beyond_64_bits(spark):
    """The score's product as the query computes it."""
    a, l, r = 9_000_000_000_000_001, 9_000_000_000_000_002, 9_100_000_000_000_000
    d = spark.createDataFrame([(a, [l], [r])], "a long, lefts array<long>, rights array<long>")
    assert d.selectExpr(f"transform(array(1), k -> {c.SCORE})[0] AS s").first().s == 2_000_000 * a // (l + r)


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_shards_and_blocks_of_any_size(monkeypatch, block):
    monkeypatch.setattr(c, "BLOCK", block)
    monkeypatch.setattr(c, "SHARD", 700)
    docs = texts(80, 4)
    batches = [pa.RecordBatch.from_pydict({"lang": ["en"] * 20, "text": [t.encode() for t in docs[i:i + 20]]}) for i in range(0, 80, 20)]
    found, shards = Counter(), list(c.shards(batches))
    assert len(shards) > 5
    everything, parts = np.full(8, 255, np.uint8), defaultdict(list)
    for lang, words, ids in shards:
        for kind, r, part in c.trie(lang, words, ids, everything, 4, 4):
            assert [p for p, _ in c.parsed(part)] == sorted(p for p, _ in c.parsed(part))
            parts[kind, r].append(part)
    for own in parts.values():
        for path, n, ancestors in c.walk(own, 1):
            found[path] += n
            assert len(ancestors) == max(len(path) - 2, 0)
    want = Counter()
    for text in docs:
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", text.encode().lower()):
            words = re.findall(rb"[^\x20\x09]+", piece)
            for m in range(1, 5):
                want.update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    assert found == want


def test_filter_passes_what_was_set():
    places = np.random.default_rng(1).integers(0, 1 << 40, 5000).astype(np.uint64)
    bits = np.zeros(1 << 14, np.uint8)
    for p in c._probes(places, 8 * len(bits)):
        np.bitwise_or.at(bits, p >> np.uint64(3), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))
    assert c.passes(places, bits).all()
    others = np.random.default_rng(2).integers(0, 1 << 40, 5000).astype(np.uint64)
    assert c.passes(others, bits).mean() < 0.05
