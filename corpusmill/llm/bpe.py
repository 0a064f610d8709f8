"""Encoding of a whole corpus with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# The public pre-tokenisation pattern of this vocabulary, for any text and, spelled out, for ASCII text.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ASCII_PATTERN = (
    r"""'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"""
)
#: Spellings remembered by a task; the memory is emptied beyond that.
REMEMBERED = 400_000
_NONE = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and their ids, which also order the merges."""
    lines = Path(path).read_bytes().splitlines()
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line)}


class Encoder:
    """Byte-pair merges by a segment tree over the ranks of adjacent pairs, with a memory of spellings."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.any = regex.compile(PATTERN)
        self.ascii = re.compile(ASCII_PATTERN)
        self.known: dict[str, tuple[int, ...]] = {}
        # Two bytes that stand side by side in no vocabulary entry are never merged across: a text may be cut there.
        self.joined = {t[i : i + 2] for t in ranks for i in range(len(t) - 1)}

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Ids of one spelling: the tree's root is the lowest rank, leftmost first, until no pair can be merged."""
        n = len(word)
        parts: list[bytes] = [word[i : i + 1] for i in range(n)]
        if n == 1:
            return (self.ranks[word],)
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.ranks.get
        tree = [_NONE] * (2 * size)
        for i in range(n - 1):
            if (r := rank(parts[i] + parts[i + 1])) is not None:
                tree[size + i] = r * n + i
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            while k > 1:
                k >>= 1
                least = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == least:
                    break
                tree[k] = least

        def pair(i: int) -> int:
            j = after[i]
            if j >= n or (r := rank(parts[i] + parts[j])) is None:
                return _NONE
            return r * n + i

        while tree[1] != _NONE:
            i = tree[1] % n
            j = after[i]
            parts[i] += parts[j]
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if j < n - 1:
                put(j, _NONE)
            put(i, pair(i))
            if before[i] >= 0:
                put(before[i], pair(before[i]))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[parts[i]])
            i = after[i]
        return tuple(out)

    def spelling(self, token: str) -> tuple[int, ...]:
        """Ids of one pre-token; a long one is first cut where no vocabulary entry could join its parts."""
        found = self.known.get(token)
        if found is None:
            word = token.encode()
            if token.isascii():
                found = self.merge(word)
            else:
                cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.joined]
                pieces = [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]
                found = tuple(chain.from_iterable(map(self.piece, pieces)))
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.known[token] = found
        return found

    def piece(self, word: bytes) -> tuple[int, ...]:
        found = self.known.get(word)  # type: ignore[call-overload]
        if found is None:
            found = self.known[word] = self.merge(word)  # type: ignore[index]
        return found

    def encode(self, text: str) -> Iterator[int]:
        tokens = (self.ascii if text.isascii() else self.any).findall(text)
        return chain.from_iterable(map(self.spelling, tokens))


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(read_ranks(path))
        for batch in batches:
            lists = [
                np.fromiter(encoder.encode(text), np.int32) if text else np.empty(0, np.int32)
                for text in batch.column(1).to_pylist()
            ]
            offsets = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = np.concatenate([np.empty(0, np.int32), *lists])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return run


def encode_corpus(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Token ids of every document's text: doc_id, ids (array<int>), without special tokens.

    Spellings of special tokens in a text are ordinary text. Null and empty texts give an empty list,
    blank texts are encoded as they stand. One pass, no shuffle: each task keeps the spellings it has
    merged, and a very long spelling costs n log n by the segment tree. Repeated rows stay; other
    columns are not read. Every executor reads the vocabulary at the given path.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(_encode(vocabulary), f"doc_id {kind}, ids array<int>")
