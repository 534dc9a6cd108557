import hashlib
import re

import pytest

from ledgerloom.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for i, text in sorted({x[:2] for x in docs}, key=str):
        w, hit, held = words(text), set(), set()
        for item, t in items:
            v = words(t)
            for win in [v[s:s + 13] for s in range(max(1, len(v) - 12))] if v else []:
                for s in range(len(w) - len(win) + 1):
                    if w[s:s + len(win)] == win:
                        hit |= set(range(s, s + len(win)))
                        held |= {item} - {None}
        ids = ",".join(sorted(map(str, held)))
        out.append((i, len(w), len(hit), len(held), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


LONG = " ".join(f"w{i % 37}x{i // 37}" for i in range(60))
ITEMS = [(1, LONG), (2, "one Two"), (3, "solo"), (4, None), (5, "..."), (6, LONG), (None, "nameless item here"), (10, "É é tres quatre"), (1, "and once more")]
DOCS = [(1, LONG.upper(), 5), (2, None, 5), (3, "", 5), (4, "one two one two ONE", 5), (4, "a solo", 5), (4, "a solo", 5), (None, "É é tres quatre cinq", 5), (5, "é é tres quatre", 5),
        (6, "filler " * 400 + "one two", 5), (7, " ".join(LONG.split()[5:40]) + " tail " + LONG, 5), (8, "nameless item here and once more", 5), (9, "x" * 100_000, 5)]


@pytest.mark.parametrize("broadcast_mb", [64, 0])
def test_equals_brute_force(spark, broadcast_mb, monkeypatch):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, n_words int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    f = d.find
    monkeypatch.setattr(d, "find", lambda a, b: f(a, b, broadcast_mb=broadcast_mb))
    assert sorted(map(tuple, d.report(docs, items).collect()), key=str) == brute(DOCS, ITEMS)


def test_empty_tables_and_filter(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, mark int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert {(r.n_hit, r.contaminated) for r in d.report(docs, items.limit(0)).collect()} == {(0, False)}
    assert d.report(docs.limit(0), items).count() == 0
    kept = d.keep_clean(docs, items)
    bad = {x[0] for x in brute(DOCS, ITEMS) if x[-1]}
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted((x for x in DOCS if not any(b[0] == x[0] and b[1] == len(words(x[1])) and b[-1] for b in brute(DOCS, ITEMS))), key=str)
    assert bad


def test_item_ids_of_text_and_large_ids(spark):
    from ledgerloom.llm import decontaminate as d

    big = (1 << 60) + 1
    docs = spark.createDataFrame([(big, "alpha beta gamma"), (None, "alpha beta gamma"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([("b", "alpha beta"), ("a", "beta gamma"), (None, "gamma"), ("c", "delta")], "item_id string, text string")
    for mb in (32, 0):  # broadcast and shuffle joins
        got = {(x.doc_id, x.n_words, x.n_hit, tuple(sorted(x.item_ids))) for x in d.find(docs, items, broadcast_mb=mb).collect()}
        assert got == {(big, 3, 3, ("a", "b")), (None, 3, 3, ("a", "b")), (4, 0, 0, ())}
    assert d.report(docs, items).count() == 3
