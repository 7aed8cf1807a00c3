"""Words and word shingles as 64-bit hashes, by worker."""

from __future__ import annotations

import numpy as np
import xxhash

from basalt.llm import caches

CACHED_WORDS = 300_000
CACHED_LENGTH = 64


class WordHashes(dict):
    """A 64-bit hash of each word; the table is emptied when full, which changes nothing."""

    def __missing__(self, word: bytes) -> int:
        out = xxhash.xxh3_64_intdigest(word)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = out
        return out


_hashes = WordHashes()
caches.register("words", _hashes.clear)


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased A-Z; words are ``[^\\x20\\x09-\\x0D]+``. Both are what bytes' own methods do."""
    return text.lower().split() if text else []


def hashed(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, tokens), np.uint64, len(tokens))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: bytes | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all ``size``-word shingles; a shorter text is one shingle, no words none."""
    h = hashed(words(text))
    if not len(h):
        return h
    k = min(size, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        out = mixed(out + np.uint64(0x9E3779B97F4A7C15)) ^ h[j : len(h) - k + 1 + j]
    return np.unique(mixed(out))
