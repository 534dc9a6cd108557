import hashlib
import re

import pytest

from ledgerloom.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
REST = {"access": (re.compile(r"AKIA[A-Z0-9]+"), 20), "hex": (re.compile(r"[0-9a-f]+"), 24)}


def base(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    for i, (k, (p, least)) in enumerate(REST.items()):
        out += [(m.start(), i + 1, k, m.end()) for m in p.finditer(text) if len(m[0]) >= least]
    return sorted(out)


def spans(text):
    """Brute force: every weak part against every other part."""
    found = [(s, r, k, e, secrets.KINDS[r][2], "base") for s, r, k, e in base(text)]
    for r, (k, p, role, strength) in enumerate(secrets.KINDS):
        if strength == "weak":
            for m in re.finditer(p, text or "", re.A):
                if k != "weak_secret" or (re.search("[0-9]", m[0]) and re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0])):
                    found.append((m.start(), r, k, m.end(), role, "weak"))
    needs = {"identifier": ["secret"], "secret": ["identifier"], "endpoint": ["identifier", "secret"]}

    def near(x, role):
        return any(y is not x and y[4] == role and (y[0] - x[3] <= secrets.REACH if (y[0], y[1], y[3]) > (x[0], x[1], x[3]) else x[0] - y[3] <= secrets.REACH) for y in found)

    return sorted(x[:4] for x in found if x[5] == "base" or all(near(x, r) for r in needs[x[4]]))


def expect(text):
    b = base(text)
    join = lambda xs: ",".join(f"{k}:{s}:{e}" for s, _, k, e in xs)
    return (*(sum(x[2] == k for x in b) for k in ("assign", "access", "hex")), hashlib.sha256(join(b).encode()).hexdigest(), join(spans(text)))


TEXTS = [None, "", "password: hunter22 ok", "é😀 API_KEY = \"abc.def/1\" x", "secret=token:abcdefgh", "token: ab secret=abcdef", "AKIA" + "Z" * 16 + " AKIA123 akia", "AKIAAKIA" + "B" * 12,
         "deadbeef" * 3 + "g" + "deadbeef" * 2, "user=bob " + "x " * 50 + "passwd='s3cr3t99'", "user=bob " + "x " * 300 + "passwd='s3cr3t99'", "https://a.b/c only",
         "https://a.b/c user: bob token=abcdef1", "Aa1" * 20, "login=zed " + "Aa1" * 20 + " http://h/x", "token=abcdef " * 3000, "pAsSwD=" + "a" * 50_000, "ſecret=abcdefgh toKen=abcdefgh", "\x00token=abcdefgh\x01 s"]


def test_equals_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], "x"), (None, TEXTS[3], "x")], "doc_id long, text string, spans string")
    got = {r.doc_id: tuple(r)[1:] for r in secrets.report(docs).collect()}
    assert len(got) == len(TEXTS) + 1
    for i, t in enumerate(TEXTS):
        assert got[i] == expect(t), (i, t and t[:80])
    assert secrets.report(docs.limit(0)).count() == 0


def test_whole_fixture(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: expect(r.text) for r in docs.collect()}
    assert {r.doc_id: tuple(r)[1:] for r in secrets.report(docs).collect()} == want
