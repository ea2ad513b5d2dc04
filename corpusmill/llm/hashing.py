"""Hashes of the words and character n-grams of a whole text, computed by numpy on its bytes."""

from __future__ import annotations

import numpy as np

PRIME = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Bytes of words: digits, letters and all of UTF-8 beyond ASCII.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Bytes that end a word where only white space does.
BLANK_BYTE = np.zeros(256, bool)
BLANK_BYTE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit integers over all bits (the finaliser of a splitmix generator)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x ^= x >> np.uint64(27)
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(31))


_POWERS = np.array([1], np.uint64)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        size = 1 << (n - 1).bit_length()
        _POWERS = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, PRIME))))
    return _POWERS[:n]


def word_hashes(raw: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, start and end of each maximal run of bytes for which inside holds."""
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start, end
    size = end - start
    at = np.flatnonzero(inside)
    place = at - np.repeat(start, size)
    value = (raw[at].astype(np.uint64) + np.uint64(1)) * powers(int(size.max()))[place]
    first = np.cumsum(size) - size
    return mix(np.add.reduceat(value, first) + size.astype(np.uint64)), start, end


def gram_hashes(raw: np.ndarray, blank: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-byte windows whose inner bytes aren't blank; blanks at the ends mark a word's edge."""
    if len(raw) < n:
        return np.zeros(0, np.uint64)
    m = len(raw) - n + 1
    h = np.full(m, np.uint64(n), np.uint64)
    for i in range(n):
        h = h * PRIME + raw[i : i + m]
    seen = np.concatenate(([0], np.cumsum(blank)))
    return mix(h[seen[n - 1 : n - 1 + m] == seen[1 : 1 + m]])


def as_bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
