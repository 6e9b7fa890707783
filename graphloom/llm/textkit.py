"""Vectorised words and word hashes of many texts at once (numpy over UTF-8 bytes)."""

from __future__ import annotations

import numpy as np

U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes inside words: all but space and \t \n \v \f \r.
WORD = np.ones(256, bool)
WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes inside alphanumeric words: digits, letters and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, U), np.ones(1, U)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, 1 << 20)
        for k, base in enumerate((_BASE, _INVERSE)):
            step = np.full(n, base, U)
            step[0] = 1
            _powers[k] = np.cumprod(step, dtype=U)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each text the index of its first word (one more at the end).

    No word crosses the border of two texts.
    """
    n = len(data)
    if not n:
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(offsets), np.int64)
    mask = np.zeros(n + 2, bool)
    mask[1:-1] = inside[data]
    begins = mask[1:-1] & ~mask[:-2]
    ends = mask[1:-1] & ~mask[2:]
    border = offsets[1:-1]
    border = border[(border > 0) & (border < n)]
    begins[border] = mask[1:-1][border]
    ends[border - 1] = mask[1:-1][border - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def span_hashes(lowered: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: differences of one running polynomial, shifted to a common power."""
    n = len(lowered)
    power, inverse = _tables(n + 1)
    running = np.empty(n + 1, U)
    running[0] = 0
    np.cumsum((lowered.astype(U) + U(1)) * power[:n], out=running[1:])
    return mix((running[ends] - running[starts]) * inverse[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


_LANES = np.random.default_rng(20240229).integers(1, 1 << 63, 64, dtype=np.int64).astype(U) * U(2) + U(1)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one text; with fewer words the whole sequence is one; none without words."""
    n = len(words)
    if not n:
        return words
    size = min(n, k)
    out = np.zeros(n - size + 1, U)
    for j in range(size):
        out += words[j : n - size + 1 + j] * _LANES[j]
    return mix(out + U(size))
