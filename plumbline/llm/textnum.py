"""Words and shingles of many texts at once, as 64-bit hashes in numpy.

A word's hash is a polynomial over its bytes (A-Z as a-z) modulo 2**64, read off one running sum over the slice and
finished by a mixing function. All functions take the concatenated UTF-8 bytes of some texts and their offsets.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C13  # odd, 3 modulo 8
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def randoms(n: int, seed: int) -> np.ndarray:
    """``n`` fixed 64-bit values, the same on every machine."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


_BYTE = randoms(256, 11)
_BYTE[65:91] = _BYTE[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown by doubling and kept."""
    have = _powers.get(base, np.ones(1, U))
    while len(have) < n:
        have = np.concatenate([have, have * U(pow(base, len(have), 1 << 64))])
    _powers[base] = have
    return have[:n]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words begin (one more entry than texts)."""
    n = len(data)
    if not n:
        return np.empty(0, U), np.zeros(len(offsets), np.int64)
    solid = ~_BLANK[data]
    border = np.zeros(n + 1, bool)
    border[0] = border[n] = True
    border[offsets] = True
    border[1:n] |= solid[1:] != solid[:-1]
    edges = np.flatnonzero(border)
    begin = edges[:-1]
    own = solid[begin]
    begin, end = begin[own], edges[1:][own]
    sums = np.zeros(n + 1, U)
    np.cumsum(_BYTE[data] * _power(_BASE, n), out=sums[1:])
    hashes = mix((sums[end] - sums[begin]) * _power(_INVERSE, n)[begin] + (end - begin).astype(U))
    return hashes, np.searchsorted(begin, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``width`` words of every text, repeats included, and where each text's begin.

    A text of fewer words has one shingle, its whole word sequence; a text without words has none.
    """
    hashes, at = words(data, offsets)
    counts = np.diff(at)
    factors = randoms(width, 23) | U(1)
    short = (counts > 0) & (counts < width)
    sizes = np.where(short, 1, np.maximum(counts - width + 1, 0))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(starts[-1], U)
    if len(hashes) >= width:
        runs = np.zeros(len(hashes) - width + 1, U)
        for k in range(width):
            runs += hashes[k : len(runs) + k] * factors[k]
        text = np.repeat(np.arange(len(counts)), np.where(short, 0, sizes))
        inside = np.arange(len(text)) - np.repeat(np.cumsum(np.where(short, 0, sizes)) - np.where(short, 0, sizes), np.where(short, 0, sizes))
        out[starts[text] + inside] = runs[at[text] + inside] + U(width)
    for i in np.flatnonzero(short):
        out[starts[i]] = (hashes[at[i] : at[i + 1]] * factors[: counts[i]]).sum(dtype=U) + U(counts[i])
    return mix(out), starts


def distinct(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values sorted and without repeats."""
    parts, sizes = [], [0]
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        part = np.sort(values[a:b])
        if len(part) > 1:
            part = part[np.concatenate([[True], part[1:] != part[:-1]])]
        parts.append(part)
        sizes.append(len(part))
    return (np.concatenate(parts) if parts else np.empty(0, U)), np.cumsum(sizes)
