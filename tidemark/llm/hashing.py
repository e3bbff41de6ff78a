"""Vector hashing of words and word windows straight from UTF-8 bytes.

A run of symbols v_s..v_e-1 hashes to sum(v_i * B^(e-i)) mod 2^64. With prefix sums of v_i * B^-i any run
costs two lookups and a product, so every window of every document comes from a handful of array operations.
Results are finished by a 64-bit mixer.
"""

from __future__ import annotations

import numpy as np

#: Fixed odd multipliers: byte level, and two independent ones at word level.
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_MASK = (1 << 64) - 1
_BLOCK = 1 << 20

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^0..B^n and B^-0..B^-n modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        made = []
        for b in (base, inverse):
            p = np.full(size, b & _MASK, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        have = (made[0], made[1])
        if size <= 4 * _BLOCK:
            _powers[base] = have
    return have


def _prefix(values: np.ndarray, base: int) -> np.ndarray:
    _, inv = powers(base, len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * inv[: len(values)], dtype=np.uint64, out=out[1:])
    return out


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where words start and end; a word never crosses into the next document."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = ~_IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(word[1:] & (~word[:-1] | edge))
    ends = np.flatnonzero(word[:-1] & (~word[1:] | edge))
    return starts, ends


def hash_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word, and each document's first word (with one more entry for the total).

    Works through blocks of about a megabyte cut between words, so that a very long document needs memory for
    its words but not for a 64-bit copy of all its bytes.
    """
    starts, ends = word_bounds(data, offsets)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + _BLOCK, side="right")))
        block = data[lo : ends[j - 1]].astype(np.uint64) + np.uint64(1)
        pre = _prefix(block, BYTE_BASE)
        pw, _ = powers(BYTE_BASE, len(block))
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((pre[e] - pre[s]) * pw[e] + (e - s).astype(np.uint64))
        i = j
    return out, starts, ends, np.searchsorted(starts, offsets)


def windows(words: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of each run of k word hashes, document borders ignored; len(words)-k+1 of them, or none."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    base = WORD_BASES[which]
    pre = _prefix(words, base)
    pw, _ = powers(base, len(words))
    return mix((pre[k:] - pre[:-k]) * pw[k : len(words) + 1])


def runs(words: np.ndarray, first: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of each document's whole word sequence."""
    base = WORD_BASES[which]
    pre = _prefix(words, base)
    pw, _ = powers(base, len(words))
    return mix((pre[first[1:]] - pre[first[:-1]]) * pw[first[1:]] + np.diff(first).astype(np.uint64))
