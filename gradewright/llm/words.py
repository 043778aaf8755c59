"""Word hashing and window arithmetic on numpy arrays, shared by the operators on word runs."""

from __future__ import annotations

import numpy as np
import xxhash

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


class WordHashes(dict):
    """Word to 64-bit hash, remembered; forgotten as a whole when it grows too large."""

    def __init__(self, limit: int = 1_000_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def hash_words(words: list, memo: WordHashes) -> np.ndarray:
    """The words' hashes as unsigned 64-bit numbers."""
    return np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits (a finaliser of the murmur family)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def gram_hashes(w: np.ndarray, n: int) -> np.ndarray:
    """The hash of every run of n words, by doubling: log n passes whatever n is."""
    if len(w) < n:
        return np.empty(0, dtype=np.uint64)
    done, have, block, size = None, 0, w, 1
    rest = n
    while rest:
        if rest & 1:
            if done is None:
                done, have = block, size
            else:
                p = np.uint64(pow(_BASE, have, 1 << 64))
                k = len(block) - have
                done, have = done[:k] + p * block[have:have + k] if k > 0 else done[:0], have + size
        rest >>= 1
        if rest:
            p = np.uint64(pow(_BASE, size, 1 << 64))
            block = block[:-size] + p * block[size:]
            size *= 2
    return mix(done[: len(w) - n + 1])


def _sliding(a: np.ndarray, n: int, pick) -> np.ndarray:
    size, block = 1, a
    while size * 2 <= n:
        block = pick(block[:-size], block[size:])
        size *= 2
    off = n - size
    return pick(block[: len(a) - n + 1], block[off: off + len(a) - n + 1]) if off else block


def sliding_min(a: np.ndarray, n: int) -> np.ndarray:
    """The least of every n neighbours; len(a) - n + 1 values."""
    return _sliding(a, n, np.minimum)
