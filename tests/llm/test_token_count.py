import random

import pytest

P = pytest.importorskip("public_tokenizers")
import sentencepiece

from ledgerloom.llm import token_count
from ledgerloom.llm.token_count import PieceTransducer, count_tokens

PATH = P.path("piece_bpe_32k.model")
PARTS = ["a", "e", "th", "er", "in", " ", "  ", "\n", "é", "①", "▁", "😀", "\t", "ing", "tion", "A", "1", "<s>", "　", "x", "the", "\0"]


def test_counts_and_scans_equal_the_library():
    lib, t, r = sentencepiece.SentencePieceProcessor(model_file=PATH), PieceTransducer(PATH), random.Random(7)
    for _ in range(3000):
        x = "".join(r.choice(PARTS) for _ in range(r.randint(0, 40)))
        assert t.count(x) == len(lib.encode(x)), x
        cuts = sorted(r.randint(0, len(x)) for _ in range(3))
        blocks = [x[i:j] for i, j in zip([0, *cuts], [*cuts, len(x)])]
        ends = [j for i, j in zip([0, *cuts], [*cuts, len(x)]) if j > i]
        assert t.scan(blocks) == [len(lib.encode(x[:j])) for j in ends], blocks


def test_blocks_of_any_size(monkeypatch):
    lib, t, r = sentencepiece.SentencePieceProcessor(model_file=PATH), PieceTransducer(PATH), random.Random(8)
    texts = ["".join(r.choice(PARTS) for _ in range(400)) for _ in range(20)] + ["a" * 3000, "the" * 900, " " * 500, "\n" * 500, "é①" * 300]
    want = [len(lib.encode(x)) for x in texts]
    for size in (1, 2, 3, 16, 255, 4096):
        monkeypatch.setattr(token_count, "BLOCK", size)
        assert [t.count(x) for x in texts] == want, size


def test_states_survive_a_reset_of_the_tables(monkeypatch):
    """Maps carry states, not numbers: the tables may start anew between two blocks."""
    monkeypatch.setattr(token_count, "STATES", 5)
    monkeypatch.setattr(token_count, "BLOCK", 7)
    lib, t, r = sentencepiece.SentencePieceProcessor(model_file=PATH), PieceTransducer(PATH), random.Random(9)
    for _ in range(200):
        x = "".join(r.choice(PARTS) for _ in range(60))
        assert t.count(x) == len(lib.encode(x)), x


def test_edge_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (None, "a", 0), (3, "a b" * 50_000, 0), (3, "a b" * 50_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(df, PATH).collect())
    long = len(lib.encode("a b" * 50_000))
    assert got == [(0, 1, 1, False), (1, 0, 0, False), (2, 0, 0, False), (3, 150_000, long, True), (3, 150_000, long, True)]
    assert count_tokens(df.limit(0), PATH).count() == 0
