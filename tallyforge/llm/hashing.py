"""Stable 64-bit hashes of words and vectorised mixing."""

from __future__ import annotations

import numpy as np
import xxhash


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (xor-shift and multiply)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def letter(word: str) -> int:
    """Four bits of a word's first letter or digit, or of its first character if it has none."""
    return ord(next(filter(str.isalnum, word), word[0])) * 0x9E3779B1 >> 28 & 15


class WordHashes(dict):
    """Hash of a word, remembered; a dictionary that starts anew when it grows large. The upper four bits are those of its first character."""

    MOST = 500_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) >> 4 | letter(word) << 60
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))
