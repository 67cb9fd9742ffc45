"""Numpy kernels on concatenated text bytes: polynomial prefix hashes, words, shingles, sliding minima.

All arithmetic is modulo 2**64.  The hash of bytes[i:j] is
``(S[j] - S[i]) * P**-i`` with ``S[i] = sum(T[b_k] * P**k, k < i)``: any
substring's hash costs two look-ups.
"""

from __future__ import annotations

import numpy as np

__all__ = ["mix", "prefix_sums", "powers", "inverse_powers", "substring_hash", "gram_hashes", "word_bounds", "shingle_hashes", "sliding_min", "sliding_max", "LOWER"]

P = 0x9E3779B97F4A7C15 | 1
P_INV = pow(P, -1, 1 << 64)
#: Random value per byte (seeded, so that all workers agree).
BYTE = np.random.default_rng(20240229).integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A-Z lower-cased, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers = {P: np.ones(1, np.uint64), P_INV: np.ones(1, np.uint64)}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers[base]
    if len(have) < n:
        size = max(n + n // 4, 1 << 16)
        full = np.full(size, base, dtype=np.uint64)
        full[0] = 1
        have = _powers[base] = np.multiply.accumulate(full)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S for bytes (uint8) or for 64-bit symbols (uint64)."""
    out = np.zeros(len(data) + 1, np.uint64)
    values = BYTE[data] if data.dtype == np.uint8 else data
    np.cumsum(values * _power(P, len(data)), out=out[1:])
    return out


def powers(n: int) -> np.ndarray:
    """P**i for i < n."""
    return _power(P, n)


def inverse_powers(n: int) -> np.ndarray:
    """P**-i for i < n."""
    return _power(P_INV, n)


def substring_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    inverse = _power(P_INV, len(sums))
    return mix((sums[end] - sums[start]) * inverse[start])


def gram_hashes(sums: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all substrings of ``width`` bytes, also across documents."""
    n = len(sums) - width
    return mix((sums[width:] - sums[:n]) * _power(P_INV, n)) if n > 0 else np.zeros(0, np.uint64)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends of the words (runs without ASCII white space) and, per document, the index of its first word
    (one more entry at the end).  Words never cross documents."""
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    np.logical_not(SPACE[data], out=inside[1:-1])
    begins = inside[1:-1] & ~inside[:-2]
    stops = inside[1:-1] & ~inside[2:]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[firsts] = inside[1:-1][firsts]
    lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    stops[lasts] = inside[1:-1][lasts]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Per document the sorted distinct hashes of its k-word shingles over A-Z lower-cased words; a document with
    fewer words is one shingle, without words it has none."""
    low = LOWER[data]
    starts, ends, first = word_bounds(low, offsets)
    words = substring_hash(prefix_sums(low), starts, ends)
    m = len(words)
    if m >= k:
        joined = words[:m - k + 1].copy()
        for j in range(1, k):
            joined = joined * np.uint64(P) + words[j:m - k + 1 + j]
        joined = mix(joined)
    else:
        joined = np.zeros(0, np.uint64)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(joined[a:b - k + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            h = np.uint64(b - a)
            one = np.full(1, h, np.uint64)
            for w in words[a:b]:
                one = one * np.uint64(P) + w
            out.append(mix(one))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` over every full window, by doubling: windows of 1, 2, 4, ... and two overlapping ones at the end."""
    n = len(x)
    if n < width:
        return x[:0]
    have = 1
    while 2 * have <= width:
        x = op(x[:-have], x[have:])
        have *= 2
    return op(x[:n - width + 1], x[width - have:width - have + n - width + 1]) if have < width else x


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i:i+width]) for every full window."""
    return _sliding(x, width, np.minimum)


def sliding_max(x: np.ndarray, width: int) -> np.ndarray:
    return _sliding(x, width, np.maximum)
