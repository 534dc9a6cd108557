import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer

from ledgerloom.llm import packing
from ledgerloom.llm.packing import Encoder, Packer, packed

PATH = P.path("word_bpe_49k.json")
PARTS = ["the", "Ing", " ", "  ", "\n", "\t", "\x1c", "\x85", "　", "é", "é", "́", "İ", "Σ", "'s", "'", "1", "2a", "<|endoftext|>", "<|start", "oftext|>",
         "😀", ".", "!?", "ﬁ", "한", "ᄒ", "ᅡ", "\0", "A"]


LIBRARY = Tokenizer.from_file(PATH)


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def check(got, docs, size=4096):
    """Pieces cover every document once, sequences are gapless, and only those whose length is a power of two are short."""
    want = {i: [*library(t or ""), 2] for i, t in docs}
    at, sequences = {i: 0 for i in want}, {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        ids = want[r.doc_id]
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids) and r.length > 0
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())
        at[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert at == {i: len(x) for i, x in want.items()}
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end == size or end & (end - 1) == 0 and end < size
    return sequences


def test_ids_equal_the_library():
    encode, lib, r = Encoder(PATH), LIBRARY, random.Random(3)
    assert encode.apart
    for _ in range(4000):
        x = "".join(r.choice(PARTS) for _ in range(r.randint(0, 30)))
        for _ in range(2):  # also from memory
            assert list(np.frombuffer(encode(x), "<u4")) == lib.encode(x, add_special_tokens=False).ids, x


def test_other_tokenizers_take_whole_texts():
    path = P.path("byte_bpe_50k.json")
    encode = Encoder(path)
    assert not encode.apart
    assert list(np.frombuffer(encode("a  b\nc"), "<u4")) == Tokenizer.from_file(path).encode("a  b\nc", add_special_tokens=False).ids


def test_level_adds_least_to_the_sum_of_squares():
    r, p, size = random.Random(1), Packer(16, 0), 16
    for _ in range(3000):
        n = r.randint(1, size - 1)

        def squares(level):
            c = p.counts.copy()
            c[level] -= level > 0
            c[level + n] += level + n < size
            return int((c ** 2).sum())

        levels = [h for h in range(size - n + 1) if h == 0 or p.counts[h]]
        assert squares(p.level_for(n)) == min(map(squares, levels))
        p.add(0, bytes(4 * n))
        assert [len(p.levels.get(h, [])) for h in range(size)] == list(p.counts[:size])


def test_windows_stay_bounded(monkeypatch):
    """Documents of which no two fit together: windows are settled, none is lost or padded."""
    monkeypatch.setattr(packing, "OPEN", 20)
    p = Packer(64, 0)
    for i in range(500):
        p.add(i, np.arange(33, dtype="<u4").tobytes())
        assert p.open <= 21
    p.finish()
    rows = p.flush()
    assert sum(r[2] for r in rows) == 500 * 33 and p.open == 0
    fills = {}
    for r in rows:
        fills[r[5]] = fills.get(r[5], 0) + r[2]
    assert sum(f < 64 for f in fills.values()) <= 6 and all(f & (f - 1) == 0 for f in fills.values())


def test_packs_documents(spark):
    r = random.Random(5)
    docs = [(i, " ".join(r.choice(["the", "ing", "Qz", "12", "."]) for _ in range(r.choice([0, 3, 50, 900, 4095, 4096, 9000])))) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    sequences = check(packed(df, PATH).collect(), docs)
    assert sum(sum(n for _, n in s) < 4096 for s in sequences.values()) <= 12


def test_small_sequences(spark):
    docs = [(i, "a b c " * (i % 40)) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(40)
    check(packed(df, PATH, size=64).collect(), docs, 64)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " \n\t"), (4, "Σ<|endoftext|>" * 3), (5, "word " * 200_000), (6, "x" * 70_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS ids", "'a' AS task", "2 AS start", "0 AS near")
    check(packed(df, PATH).collect(), docs)
    assert packed(df.limit(0), PATH).count() == 0
    again = spark.createDataFrame([(None, "a"), (None, "a"), (7, "b"), (7, "b")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.start, r.length) for r in packed(again, PATH).collect()) == [(0, 0, 2), (0, 0, 2), (7, 0, 2), (7, 0, 2)]
    assert {type(r.doc_id) for r in packed(again.selectExpr("string(doc_id) AS doc_id", "text"), PATH).collect()} == {str, type(None)}


def test_query_over_the_table(spark):
    from ledgerloom.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(queries.QUERIES["op13_packing"](spark, sf).collect(), docs)
