"""Words of a text: a longest run of letters and digits, or one Han character; case does not matter."""

from __future__ import annotations

import re

import numpy as np

WORD = re.compile("[㐀-鿿]|[^\\W_㐀-鿿]+")
HAN = re.compile("[㐀-鿿]")
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordIds(dict):
    """64-bit ids of words, the same in every task; emptied when it has grown large."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, seed=17)
        return value

    def of(self, text: str) -> np.ndarray:
        words = WORD.findall(text.lower())
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def grams(ids: np.ndarray, n: int) -> np.ndarray:
    """64-bit values of all runs of n words, in order; runs are put together from runs of half their length."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    golden = np.uint64(0x9E3779B97F4A7C15)
    out, have = mix(ids), 1
    for digit in bin(n)[3:]:
        out = mix(out[:-have] * golden + out[have:])
        have *= 2
        if digit == "1":
            out = mix(out[:-1] * golden + ids[have:])
            have += 1
    return out


def text_value(ids: np.ndarray) -> int:
    """A signed 64-bit value of a whole sequence of words."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(ids.tobytes())).view(np.int64))
