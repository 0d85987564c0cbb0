"""Words as 64-bit hashes, for operators on word sequences. Words are runs of bytes without [\\x20\\x09-\\x0D]."""

from __future__ import annotations

import numpy as np
import xxhash

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Words that a worker remembers.
CACHE_WORDS = 100_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * GOLDEN + np.uint64(seed)) | np.uint64(1)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE_WORDS:
            self[word] = value
        return value


_known = WordHashes()


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_known.__getitem__, words), dtype=np.uint64, count=len(words))


def windows(hashes: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A hash for each run of size consecutive entries; empty if there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k, c in enumerate(constants(size, seed)):
        total += hashes[k : k + n] * c
    return mix(total)


def members(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """For each value whether it is among the others; a table of bits decides most of them."""
    if not len(among) or not len(values):
        return np.zeros(len(values), bool)
    bits = np.uint64((1 << max(12, int(len(among)).bit_length() + 3)) - 1)
    table = np.zeros(int(bits) + 1, bool)
    table[(mix(among) & bits).astype(np.int64)] = True
    found = table[(mix(values) & bits).astype(np.int64)]
    at = np.flatnonzero(found)
    if len(at):
        found[at] = np.isin(values[at], among)
    return found
