"""64-bit hashes of runs of words, from prefix sums of powers: any run of any length costs one subtraction and one multiplication."""

from __future__ import annotations

import numpy as np
import xxhash

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Words whose hashes a worker remembers.
REMEMBERED = 400_000


class _Hashes(dict):
    """word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word, 7)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value
        return value


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Rolling:
    """Prefix sums of a word sequence, and from them the hash of each run of k words."""

    def __init__(self) -> None:
        self.hashes = _Hashes()
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _scale(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 2 * len(self.powers))
            ones = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
            for x in ones:
                x[0] = 1
            self.powers, self.inverse = (np.multiply.accumulate(x) for x in ones)

    def sums(self, words: list[bytes]) -> np.ndarray:
        n = len(words)
        self._scale(n + 1)
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, n)
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * self.powers[:n], dtype=np.uint64)))

    def grams(self, sums: np.ndarray, k: int) -> np.ndarray:
        """The hash of the k words from each position on."""
        h = sums[k:] - sums[:-k]
        return mixed(h * self.inverse[: len(h)])

    def between(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hashes of the words from start to end, for arrays of both."""
        return mixed((sums[end] - sums[start]) * self.inverse[start])

    def shingles(self, text: bytes, k: int) -> np.ndarray:
        """Hashes of the k-word shingles of a lower-cased text, repeats included; with fewer words the whole is the one shingle."""
        words = text.lower().split()  # bytes: lower-cases A-Z and splits at \x20 and \x09-\x0D only
        return self.grams(self.sums(words), min(k, len(words))) if words else np.zeros(0, np.uint64)
