"""Token counting and BPE coding against the library on whole texts."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from dockflow.llm.bpe_codec import encode_decode, encode_long
from dockflow.llm.token_counts import count_long, count_tokens
from dockflow.llm.word_encoder import WordEncoder

FILE = public_tokenizers.path("word_bpe_49k.json")
PARTS = [
    "the", "'s", "'re", "don't", "!!!", "'", "İ", "é", "́", "한", "각", "中文字", "12345", "<|endoftext|>", "<|startoftext|>",
    "naïve", "ZZ", " ", "\xa0", "\x1f", "\x0b", "😀", "ﬁ", "Σς", "a" * 37, "#$%", "²½ª", "\n", "\t ",
]


@pytest.fixture(scope="module")
def encoder():
    return WordEncoder.from_file(FILE)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def random_text(rng, most):
    parts = PARTS[: rng.randint(2, len(PARTS))]
    spaced = rng.random()
    return "".join(rng.choice(parts) + (" " if rng.random() < spaced else "") for _ in range(rng.randint(0, most)))


def test_random_texts_agree_with_the_library(encoder, library):
    rng = random.Random(7)
    for _ in range(400):
        text = random_text(rng, 120)
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode_texts([text])[0], dtype="<u4").tolist() == ids
        assert encode_long(encoder, text, leaf=rng.choice([5, 16, 64]), window=rng.choice([2, 4, 16])).tolist() == ids
        assert count_long(encoder, text, chunk=rng.choice([16, 40, 100]), overlap=rng.choice([4, 8])) == len(ids)
        assert encoder.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)


def test_memory_of_words_may_overflow(library):
    small = WordEncoder.from_file(FILE, remembered=3)
    texts = [f"word{i} and wörd{i} 中{i}" for i in range(20)] * 2
    got = [np.frombuffer(b, dtype="<u4").tolist() for b in small.encode_texts(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_text_without_white_space(encoder, library):
    text = "".join(random.Random(3).choices("abcdefgh", k=5000))
    ids = library.encode(text, add_special_tokens=False).ids
    assert encode_long(encoder, text, leaf=100, window=8).tolist() == ids
    assert count_long(encoder, text, chunk=200, overlap=16) == len(ids)


ROWS = [(1, None, 5), (1, "", 6), (None, "Two words", 7), (2, "Two words", 8), (2, "Two words", 8), (3, "x y " * 9000, 9)]


def test_rows_nulls_repeats_and_clashing_names(spark, library):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, n_tokens bigint")
    counted = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in count_tokens(df, FILE).collect())
    long = len(library.encode("x y " * 9000, add_special_tokens=False).ids)
    assert counted == [(0, 9, 2), (1, 0, 0), (1, 0, 0), (2, 9, 2), (2, 9, 2), (3, 36000, long)]
    coded = encode_decode(df, FILE).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"], len(r["ids"]) // 4) for r in coded) == [
        (a, n, n) for a, _, n in counted
    ]
    assert {r["decoded"] for r in coded if r["n_tokens"] == 2} == {"two</w> words</w>"}
    assert count_tokens(df.limit(0), FILE).collect() == [] and encode_decode(df.limit(0), FILE).collect() == []
