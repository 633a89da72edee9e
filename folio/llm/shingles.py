"""Word shingles as sorted arrays of 64-bit hashes, computed over whole batches of texts.

Words are runs of characters outside ``[\\x20\\x09-\\x0D]`` with A-Z lowered; a text's set holds its distinct shingles of
five words, or with fewer words all of them as one shingle.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

WORDS = 5
LONG = 1 << 18  # bytes of a long text that are read in one step

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit depends on every other."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x632BE59BD9B4E019))
_PLACE = mix(np.arange(1, WORDS + 1, dtype=np.uint64) * _U(0xD6E8FEB86659FD93)) | _U(1)


@lru_cache(1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for factor in (_BASE, _INVERSE):
        column = np.full(size, factor, np.uint64)
        column[0] = 1
        out.append(np.multiply.accumulate(column))
    return out[0], out[1]


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(20, int(size).bit_length()))


def _between_words(data: np.ndarray) -> list[int]:
    """Where a long text is cut: every ``LONG`` bytes, at the next white space."""
    cuts = [0]
    while cuts[-1] < len(data):
        at = cuts[-1] + LONG
        while at < len(data) and not (white := _WHITE[data[at : at + LONG]]).any():
            at += LONG
        cuts.append(at + int(white.argmax()) if at < len(data) else len(data))
    return cuts


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and each text's first word."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    if len(offsets) == 2 and len(data) > 2 * LONG and len(cuts := _between_words(data)) > 2:
        parts = [words(data[a:b], np.array([0, b - a]))[0] for a, b in zip(cuts, cuts[1:])]
        return np.concatenate(parts), np.array([0, sum(map(len, parts))])
    white = _WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.append(True, white[:-1]) | edge[:-1]
    after = np.append(white[1:], True) | edge[1:]
    start = np.flatnonzero(before & ~white)
    end = np.flatnonzero(after & ~white)
    up, down = powers(len(data))
    sums = np.append(_U(0), np.cumsum(_BYTE[_LOWER[data]] * up[: len(data)], dtype=np.uint64))
    hashes = mix((sums[end + 1] - sums[start]) * down[start] + (end - start + 1).astype(np.uint64))
    return hashes, np.searchsorted(start, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each text's every shingle, as they come, and each text's first."""
    word, first = words(data, offsets)
    n = np.diff(first)
    count = np.where(n >= WORDS, n - WORDS + 1, (n > 0).astype(np.int64))
    begin = np.append(0, np.cumsum(count))
    if not begin[-1]:
        return np.zeros(0, np.uint64), begin
    if len(n) == 1 and n[0] >= WORDS:  # one text: no positions are needed
        out = np.full(count[0], WORDS, np.uint64)
        for j in range(WORDS):
            out += word[j : j + count[0]] * _PLACE[j]
        return mix(out), begin
    at = np.repeat(first[:-1] - begin[:-1], count) + np.arange(begin[-1])
    padded = np.append(word, np.zeros(WORDS, np.uint64))
    have = np.repeat(np.minimum(n, WORDS), count)
    short = (have < WORDS).any()
    out = have.astype(np.uint64)
    for j in range(WORDS):
        part = padded[at + j] * _PLACE[j]
        if short:
            part[have <= j] = 0
        out += part
    return mix(out), begin


def distinct(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's values sorted and without repeats."""
    values = values.copy()
    cuts = begin.tolist()
    for a, b in zip(cuts, cuts[1:]):
        if b - a > 1:
            values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    keep[begin[:-1][np.diff(begin) > 0]] = True
    return values[keep], np.append(0, np.cumsum(keep))[begin]
