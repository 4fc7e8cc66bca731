"""Exact encoding against the public library that reads the same vocabulary."""

import os
import random

import pytest

from lodeflow.llm.bpe import PIECES, Encoder, read_ranks
from lodeflow.llm.encode import VOCABULARY, encode_corpus

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="needs the vocabulary file")


@pytest.fixture(scope="module")
def both():
    import tiktoken

    with open(VOCABULARY, "rb") as f:
        ranks = read_ranks(f.read())
    return Encoder(ranks), tiktoken.Encoding("check", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def test_random_texts(both):
    ours, theirs = both
    rng = random.Random(7)
    signs = ["a", "b", " ", "e", "th", "ing", "龍", "契", "士", "覚", "é", "́", "🎉", "1", "23", "的", "中", "。", "\n", "\r\n", "\t", "ー", "ァ", "'s", "<|endoftext|>", "​", "שלום", "𠮷"]
    for _ in range(3000):
        text = "".join(rng.choices(signs, k=rng.randint(0, 40)))
        assert ours.encode(text) == theirs.encode_ordinary(text), text


def test_long_pieces(both):
    ours, theirs = both
    for text in ("a" * 50_000, "龍" * 5_000, " " * 30_000, "ab" * 20_000, "".join(random.Random(1).choices("abcdefgh", k=40_000))):
        assert ours.encode(text) == theirs.encode_ordinary(text)


def test_corpus(spark, both):
    rows = [(1, "Hello 世界"), (2, ""), (3, None), (3, None), (4, "<|endoftext|>")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in encode_corpus(df).collect())
    assert got == sorted((i, both[1].encode_ordinary(t) if t else []) for i, t in rows)
    assert encode_corpus(df.where("false")).count() == 0
