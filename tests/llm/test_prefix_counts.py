"""Prefix counts against the tokenizers library, prefix by prefix."""

import random

import pytest
from pyspark.sql import functions as F

from pagemill.llm import prefix_counts as P
from pagemill.llm.queries import tokenizer

WORD = tokenizer("word_bpe_49k.json")
PARTS = [
    "a", "e", "t", "h", "s", " ", "'", "'re", "'s", "'ll", "1", "é", "é", "İ", "ı", "ß", " ",
    "<|endoftext|>", "<|", "|>", "<|startoftext|>", "ก", "ำ", "漢", "가", "ᆨ", "한", "!", "...",
    "--", "\n", "\t", "\x1c", " ", "\U0001f600", "\U0001f469‍\U0001f467", "ﬁ", "̈", "́", "Å", "q̣̇",
    "The", "ing", "tion", "ྲཱྀ", "ো", "_", "#", "Ω", "\0", "\x7f",
]


@pytest.fixture(scope="module")
def encoder():
    return P.PrefixEncoder.of(WORD)


def count(encoder, text):
    return len(encoder.library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("seed", range(4))
def test_every_prefix_as_the_library_counts_it(encoder, seed):
    draw = random.Random(seed)
    for _ in range(400):
        text = "".join(draw.choice(PARTS) for _ in range(draw.randint(1, 14)))
        assert encoder.counts(text).tolist() == [count(encoder, text[:k]) for k in range(1, len(text) + 1)], repr(text)


def test_long_words_and_slices(encoder, monkeypatch):
    draw = random.Random(1)
    word = "".join(draw.choice("abcdehitnos") for _ in range(5000))
    marks = "=-" * 2000
    for text in (word, "a" * 5000, marks, f"{word} and {marks}\n" * 3):
        got = encoder.counts(text)
        assert got[-1] == count(encoder, text)
        for k in draw.sample(range(1, len(text)), 15):
            assert got[k - 1] == count(encoder, text[:k])
    whole = encoder.counts(f"{word} some more words " * 4)
    monkeypatch.setattr(P, "SLICE", 100)
    assert (encoder.counts(f"{word} some more words " * 4) == whole).all()


def test_memory_of_words_is_bounded(encoder, monkeypatch):
    monkeypatch.setattr(P, "KEPT", 50)
    monkeypatch.setattr(P, "KEPT_PAIRS", 50)
    own = P.PrefixEncoder(WORD)
    text = " ".join(f"word{i}x{i * 7}" for i in range(400)) * 2
    assert own.counts(text)[-1] == count(encoder, text)
    assert len(own.words) <= 50 and len(own.older) <= 50 and len(own.pieces) <= 50


def test_table(spark, encoder):
    texts = [None, "", "  \n ", "one two three", "one two three", "It's the <|endoftext|> of 'refs", "x" * 3000]
    rows = [(i % 6, t, "own", [1]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, `fits` string, `a.b` array<int>").repartition(3)
    out = P.prefix_counts(docs, WORD, budgets=[2, 0])
    assert out.columns == ["doc_id", "a.b", "prefix_tokens", "fits"]
    got = sorted(
        (r.doc_id, tuple(r.prefix_tokens), tuple(r.fits), r.n, r.five)
        for r in out.withColumn("n", P.n_tokens(F.col("prefix_tokens"))).withColumn("five", P.tokens_before(F.col("prefix_tokens"), F.lit(5))).collect()
    )
    want = []
    for i, t in enumerate(t or "" for t in texts):
        counts = [count(encoder, t[:k]) for k in range(1, len(t) + 1)]
        fits = tuple(max([k + 1 for k, c in enumerate(counts) if c <= b], default=0) for b in (2, 0))
        want.append((i % 6, tuple(counts), fits, count(encoder, t), count(encoder, t[:5])))
    assert got == sorted(want)


def test_empty_table_and_only_text(spark):
    docs = spark.createDataFrame([], "text string")
    assert P.prefix_counts(docs, WORD).collect() == []
    one = spark.createDataFrame([("a b",), (None,)], "text string")
    assert sorted(len(r.prefix_tokens) for r in P.prefix_counts(one, WORD).collect()) == [0, 3]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        P.PrefixEncoder(tokenizer("byte_bpe_50k.json"))
