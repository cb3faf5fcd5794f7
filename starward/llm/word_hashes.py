"""Words of texts as numbers and hashes; a word is a run without ASCII white space."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multiplier of the rolling hashes, and those of the finaliser of the public MurmurHash3.
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX_1, MIX_2, HALF = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)


class Numbers(dict):
    """Words to numbers in the order of their first appearance."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class Words:
    """The words of some texts, one after the other, with two independent hashes of each."""

    def __init__(self, texts: list[bytes]):
        numbers, places, sizes = Numbers(), [], []
        for text in texts:
            words = text.split()
            places.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
            sizes.append(len(words))
        digests = b"".join(map(xxhash.xxh3_128_digest, numbers))
        table = np.frombuffer(digests, np.uint64).reshape(-1, 2)
        self.places = np.concatenate(places) if places else np.zeros(0, np.uint32)
        self.hashes = [np.ascontiguousarray(table[:, k])[self.places] for k in (0, 1)]
        self.sizes = np.array(sizes, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def windows(self, size: int) -> np.ndarray:
        """First words of all windows of ``size`` words that stay within one text."""
        left = np.repeat(self.starts + self.sizes, self.sizes) - np.arange(len(self.places))
        return np.flatnonzero(left >= size)

    def texts_of(self, words: np.ndarray) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)[words]

    def rolling(self, size: int, which: int = 0) -> np.ndarray:
        """Hash of ``size`` words from every word on; meaningful where ``windows`` says so."""
        hashes = self.hashes[which]
        whole = max(len(hashes) - size + 1, 0)
        rolled = hashes[:whole].copy()
        for k in range(1, size):
            rolled *= STEP
            rolled += hashes[k : whole + k]
        return mix(rolled)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    values = values ^ (values >> HALF)
    values *= MIX_1
    values ^= values >> HALF
    values *= MIX_2
    return values ^ (values >> HALF)
