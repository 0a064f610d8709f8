from pathlib import Path

import pytest

from corpusmill.llm import bpe
from tests.conftest import rows

pytestmark = pytest.mark.skipif(not Path(bpe.VOCABULARY).exists(), reason="no vocabulary")
TEXTS = [
    "Hello world, don't we'll I'LL <|endoftext|> 2030-01-01",
    "  \n\n  x\t\ty   ",
    "中文句子，ー" * 20,
    "x" * 20_000,
    "ab" * 3_000,
    "🤖é́ ٠١½ 한국어 ไทย 　 \x85\x1c",
    " ",
    "a",
    "é",
]


def naive(encoder, word):
    """Merges the lowest rank first, leftmost of equals, by looking at all pairs again and again."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        found = [(encoder.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in encoder.ranks]
        if not found:
            return tuple(encoder.ranks[p] for p in parts)
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_ranks(bpe.VOCABULARY))


@pytest.mark.parametrize("word", ["hello", "a", "ab", " thereafter", "aaaaaaaaab", "日本語の", "ééé", "\x00\x01", "<|endoftext|>"])
def test_segment_tree_against_naive_merges(encoder, word):
    assert encoder.merge(word.encode()) == naive(encoder, word.encode())
    assert encoder.spelling(word) == naive(encoder, word.encode())


@pytest.mark.parametrize("text", TEXTS)
def test_same_ids_as_the_public_library(encoder, text):
    tokenizers = pytest.importorskip("tokenizers")
    public = tokenizers.Tokenizer.from_file(bpe.VOCABULARY.replace(".tiktoken", ".json"))
    public.encode_special_tokens = True
    assert list(encoder.encode(text)) == public.encode(text, add_special_tokens=False).ids


def test_round_trip(encoder):
    words = {i: w for w, i in encoder.ranks.items()}
    for text in TEXTS:
        assert b"".join(words[i] for i in encoder.encode(text)).decode() == text


def test_corpus(spark):
    data = [(1, None, "x"), (2, "", "x"), (3, "hi", "x"), (3, "hi", "x"), (4, " ", None)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, ids string")
    got = rows(bpe.encode_corpus(df))
    assert [(i, len(x)) for i, x in got] == [(1, 0), (2, 0), (3, 1), (3, 1), (4, 1)]
    assert rows(bpe.encode_corpus(df.limit(0))) == []
