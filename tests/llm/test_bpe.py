"""Ids against two public encoders of the same vocabulary."""

import random

import numpy as np
import pytest
from compare import ROOT
from hypothesis import given, settings
from hypothesis import strategies as st

from meshloom.llm import bpe

tiktoken = pytest.importorskip("tiktoken")
RANKS = bpe.read_ranks(bpe.DEFAULT_VOCABULARY)
TABLE = bpe.PairTable(RANKS)
REFERENCE = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=RANKS, special_tokens={})
SCHEMA = "doc_id long, text string, ids string"


def encode(texts):
    flat, sizes = bpe.encode_texts(TABLE, texts)
    ends = np.cumsum(sizes)
    return [flat[e - n : e].tolist() for e, n in zip(ends, sizes)]


def wanted(text):
    return REFERENCE.encode_ordinary(text) if text else []


ODD = ["", None, " ", "   ", " a  b\n\n c ", "\t\t x", "a \n b", "  x", "x  ", "<|endoftext|> hi", "don't WE'LL they've", "x" * 5000, "ab" * 700, "ё" * 400 + " ё", "é\u0301\u0301", "日本語" * 150, "🛰️📡👩‍🚒", "\u00a0\u2003a", "a\u00a0 b", "\r\n\r\n", "1234567 89", "a" * 255, "a" * 256, "a" * 257]


def test_odd_texts():
    assert encode(ODD) == [wanted(t) for t in ODD]


@given(st.lists(st.text(alphabet=st.sampled_from("ab c\n\t'stré1½ж北\u00a0."), max_size=60), max_size=8))
@settings(max_examples=150, deadline=None)
def test_random_texts(texts):
    assert encode(texts) == [wanted(t) for t in texts]


def test_long_pieces_take_the_same_merges():
    rng = random.Random(4)
    for n in (257, 600, 3000):
        word = "".join(rng.choice("abcdet") for _ in range(n))
        ids = TABLE.byte_ids[np.frombuffer(word.encode(), dtype=np.uint8)][None, :]
        assert TABLE.merge_long(word.encode()).tolist() == TABLE.merge_rows(ids)[0].tolist() == wanted(word)


def test_long_pieces_of_many_kinds():
    rng = random.Random(5)
    vocabulary = [t.decode() for t in RANKS if t.isalpha() and t.isascii() and len(t) > 3][:3000]
    kinds = [
        lambda n: "".join(rng.choice(vocabulary) for _ in range(n // 6)), lambda n: "".join(chr(97 + rng.randrange(26)) for _ in range(n)), lambda n: "a" * n, lambda n: ("ab" * n)[:n],
        lambda n: rng.choice(vocabulary) * (n // 6), lambda n: "".join(rng.choice("étàñçЖ北🛰") for _ in range(n // 3)),
    ]
    for n in (257, 258, 1000, 9000):
        for make in kinds:
            word = make(n)
            assert TABLE.merge_long(word.encode()).tolist() == REFERENCE._core_bpe.encode_single_piece(word.encode())


def test_all_documents_round_trip(spark):
    from meshloom.sources.tables import read

    docs = read(spark, f"{ROOT}/sf0.01", "documents")
    rows = bpe.encode(docs).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert list(r.ids) == wanted(r.text) and REFERENCE.decode(list(r.ids)) == (r.text or "")


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "a b", "x"), (2, "y" * 100_000, "x")], SCHEMA)
    got = sorted((str(r.doc_id), len(r.ids)) for r in bpe.encode(df).collect())
    assert got == sorted([("1", 0), ("1", 0), ("None", 2), ("2", len(wanted("y" * 100_000)))])
    assert bpe.encode(spark.createDataFrame([], SCHEMA)).count() == 0
