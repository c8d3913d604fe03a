"""Word shingles of whole texts as 64-bit hashes, straight from Arrow's buffers.

Words are runs of characters other than space and tab to carriage return; A-Z count as a-z.
A text's shingles are its runs of ``k`` words; a shorter text has one, its whole word sequence.
Hashes are 64 bits wide: two different shingles of one comparison meet with a chance below 1e-12.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    value = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _ODD)
    value[65:91] = value[97:123]
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    return value, space


_VALUE, _SPACE = _tables()
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words before each text, with the total last)."""
    texts = texts.fill_null("").cast(pa.large_binary())
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    gap = _SPACE[data]
    first = ~gap
    first[1:] &= gap[:-1]
    first[ends[:-1][ends[:-1] < len(data)]] = True  # each text starts anew
    first &= ~gap
    starts = np.flatnonzero(first)
    last = ~gap
    last[:-1] &= gap[1:]
    cut = ends[1:][(ends[1:] > 0)] - 1
    last[cut] = True
    last &= ~gap
    stops = np.flatnonzero(last) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * _powers(_BASE, len(data)), out=sums[1:])
    h = (sums[stops] - sums[starts]) * _powers(_INVERSE, len(data))[starts]
    return mix(h + (stops - starts).astype(np.uint64) * _ODD), np.searchsorted(starts, ends)


def shingle_hashes(texts: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each shingle in text order, row it belongs to, words of each row)."""
    words, at = word_hashes(texts)
    n = len(texts)
    counts = np.diff(at)
    each = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    owner = np.repeat(np.arange(n), each)
    before = np.zeros(n + 1, np.int64)
    np.cumsum(each, out=before[1:])
    start = np.arange(before[-1]) - np.repeat(before[:-1], each) + np.repeat(at[:-1], each)
    length = np.minimum(counts, k)
    size = np.repeat(length, each)
    h = size.astype(np.uint64)
    for i in range(k):
        has = i < size
        h = np.where(has, h * _ODD + words[np.where(has, start + i, 0)] if len(words) else h, h)
    return mix(h), owner, counts


def distinct(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each row, sorted within it."""
    if not len(hashes):
        return hashes, owner
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[keep], o[keep]
