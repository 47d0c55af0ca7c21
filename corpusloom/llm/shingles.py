"""Word shingles of whole texts as 64-bit hashes, over UTF-8 bytes."""

from __future__ import annotations

import hashlib

import numpy as np

from .bpe import span_hashes
from .common import mixed

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First bytes and ends of the words of all texts, and the n + 1 bounds of each text's words."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~_BLANK[data]
    opens = word.copy()
    opens[1:] &= ~word[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    opens[first] = word[first]
    closes = np.append(opens[1:] | ~word[1:], True) & word
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z lower-cased, and the n + 1 bounds of each text's words."""
    starts, ends, bounds = word_places(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    low = _LOWER[data]
    hashes = mixed(span_hashes(low, starts, ends) + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > 64).tolist():  # long words: no polynomial
        hashes[i] = int.from_bytes(hashlib.blake2b(low[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return hashes, bounds


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """For each text the ascending distinct hashes of its shingles of ``size`` words; a text of fewer words has its whole
    sequence as one, a text without words none."""
    hashes, bounds = word_hashes(data, offsets)
    m = len(hashes)
    mixes = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5), np.uint64(0x85EBCA77C2B2AE63)]
    shingle = np.zeros(max(0, m - size + 1), np.uint64)
    for j in range(size):
        shingle = mixed(shingle * mixes[j % 5] + hashes[j : j + len(shingle)])
    out = []
    at = bounds.tolist()
    for a, b in zip(at, at[1:]):
        if b - a >= size:
            s = np.sort(shingle[a : b - size + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif b > a:
            out.append(np.array([int.from_bytes(hashlib.blake2b(hashes[a:b].tobytes(), digest_size=8).digest(), "little")], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
