import hashlib
import zlib

import pytest

from ledgerloom.llm import manifest

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """Root, and for every node the siblings of each level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for path, i in zip(paths, at):
            run = level[i // 8 * 8:i // 8 * 8 + 8]
            path.append((run[:i % 8], run[i % 8 + 1:]))
        level, at = [sha(*level[i:i + 8]) for i in range(0, len(level), 8)], [i // 8 for i in at]
    return level[0], paths


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = own, *tree([leaf(r) for r in own])
    root, above = tree([trees[x][1] for x in langs])
    found = []
    for lang, up in zip(langs, above):
        own, subroot, paths = trees[lang]
        for r, path in zip(own, paths):
            path, h = path + up, leaf(r)
            folded = h
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                folded = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for left, right in path:
                folded = sha(*left, folded, *right)
            found.append((r[0], h, subroot, root, sha(*(x for p in path for x in p[0] + p[1])), folded, folded == root))
    return sorted(found, key=str)


def reported(df):
    return sorted((tuple(r) for r in manifest.report(df).collect()), key=str)


@pytest.mark.parametrize("sizes", [[1], [3], [8, 1], [9, 64, 65], [600, 513, 2], [1] * 12])
def test_equals_brute_force(spark, sizes):
    rows = [(1000 * k + i, f"s{i % 3}", f"l{k}", i, f"Text Ä {i}") for k, n in enumerate(sizes) for i in range(n)]
    assert reported(spark.createDataFrame(rows, COLUMNS)) == brute(rows)


def test_more_rounds(spark, monkeypatch):
    """Blocks of eight: four rounds in one tree, fewer in others."""
    monkeypatch.setattr(manifest, "DEPTH", 1)
    monkeypatch.setattr(manifest, "BLOCK", 8)
    rows = [(i, "s", "l%d" % (i % 7 > 1), i, "A" * (i % 5)) for i in range(700)]
    assert reported(spark.createDataFrame(rows, COLUMNS)) == brute(rows)


def test_odd_rows(spark):
    """Nulls in any column, empty and long texts, repeated rows and ids, languages that look like null, clashing columns."""
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, "", "", 0, ""), (1, "s", "", 2, "B"), (1, "s", "", 2, "B"),
            (2, None, "-", 3, None), (3, "s", None, None, "Q" * 300_000), (4, "s", "é", 1, "Ä:é"), (5, "s", "=", 1, "1:x"), (12, "s", "=", 1, "XY"),
            (15, "S", "=", 1, None), (7, None, None, None, "\0Z")]
    df = spark.createDataFrame(rows, COLUMNS)
    assert reported(df) == brute(rows)
    more = df.selectExpr("*", "'x' AS tree", "1 AS pos", "2 AS h", "3 AS path", "4 AS levels", "5 AS total", "6 AS root", "7 AS block", "8 AS _stretch")
    assert reported(more) == brute(rows)
    assert manifest.report(df.limit(0)).collect() == []


def test_fields_do_not_run_together(spark):
    rows = [(1, "a", "bc", None, ""), (1, "ab", "c", None, ""), (1, "a", "b", None, "c")]
    assert len({r.leaf for r in manifest.report(spark.createDataFrame(rows, COLUMNS)).collect()}) == 3
