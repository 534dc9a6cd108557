import hashlib
import random

from ledgerloom.llm import line_dedup


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return a == b
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def brute(docs, least=line_dedup.MIN_CHARS):
    seen, out = [], {}
    for i, text in sorted(set(docs)):
        lines, kept, gone = text.split("\n"), [], 0
        for s in lines:
            if s.strip(" ") and any(s == t or (len(s) >= least and len(t) >= least and one_edit(s, t)) for t in seen):
                gone += 1
            else:
                kept.append(s)
            seen.append(s)
        out[i] = (len(lines), gone, "\n".join(kept))
    return out


def lines(r):
    base = ["the quick brown fox jumps over", "x" * 20, "x" * 19, "ähnliche Zeile mit Umlaut üöä", "short", "", "  ", "aaaaaaaaaaaaaaaaaaaaab", "abababababababababababab"]
    s = r.choice(base)
    for _ in range(r.choice([0, 0, 1, 1, 2])):
        i, op = r.randint(0, len(s)), r.random()
        c = r.choice("abxé ")
        s = s[:i] + c + s[i:] if op < .4 else s[:i] + s[i + 1:] if op < .7 else s[:i] + c + s[i + 1:]
    return s


def test_equals_brute_force(spark):
    r = random.Random(5)
    docs = [(i, "\n".join(lines(r) for _ in range(r.randint(1, 12)))) for i in range(120)] + [(200, ""), (201, "z" * 12_000 + "\n" + "z" * 12_001)]
    df = spark.createDataFrame([(*d, "n") for d in docs], "doc_id long, text string, pos string")
    want = brute(docs)
    got = {x.doc_id: (x.n_lines, x.n_removed, x.kept_sha256) for x in line_dedup.report(df).collect()}
    assert got == {k: (*v[:2], hashlib.sha256(v[2].encode()).hexdigest()) for k, v in want.items()}
    assert {x.doc_id: x.text for x in line_dedup.dedup(df).collect()} == {k: v[2] for k, v in want.items()}


def test_edges(spark):
    rows = [(1, "one line that is long enough\nshort", 9), (1, "one line that is long enough\nshort", 9), (None, "one line that is long enouqh", 3), (2, None, 1), (3, "short\nnew", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    out = line_dedup.dedup(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "short", 5), (1, "short", 5), (None, rows[2][1], 28), (2, None, None), (3, "new", 3)], key=str)
    assert line_dedup.dedup(df.limit(0)).count() == 0 and line_dedup.report(df.limit(0)).count() == 0
