"""Word and shingle hashes over whole texts, as array operations on their UTF-8 bytes.

Words are maximal runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased; all these
are single bytes in UTF-8, so working on bytes equals working on characters. A word's hash is a
polynomial over seeded 64-bit byte values (mod 2^64) followed by a mixing step; equal words have
equal hashes in every task, whatever their position.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 5  # odd, so that powers are invertible mod 2^64
_MASK = (1 << 64) - 1
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE[_SPACE] = 0
_STEP = np.random.default_rng(21).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse (mod 2^64)."""
    if len(_pow[0]) <= n:
        size = max(n + 1, CHUNK)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base & _MASK, np.uint64)
            p[0] = 1
            _pow[k] = np.cumprod(p, dtype=np.uint64)
    return _pow[0], _pow[1]


CHUNK = (1 << 20) + 1


def word_spans(
    data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each word; words never cross documents.

    ``gap`` says which byte values separate words.
    """
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    word = ~gap[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    first = first[:-1]
    begins = word.copy()
    begins[1:] &= ~word[:-1] | first[1:]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | first[1:]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(offsets, start, "right") - 1


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range [start, end) of ``data``, independent of its place."""
    p, q = powers(len(data))
    acc = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * p[: len(data)], out=acc[1:])
    return mix((acc[end] - acc[start]) * q[start])


# For operators that look at letters only: tokens are runs of letters, digits and non-ASCII bytes.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def words(
    data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _SPACE
) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word in order, word offsets by document)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    start, end, doc = word_spans(data, offsets, gap)
    return range_hashes(data, start, end), np.searchsorted(doc, np.arange(len(offsets)))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` word hashes (ignoring document borders)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out += h[k : k + len(out)] * _STEP[k]
    return mix(out + np.uint64(n))


def shingle_sets(
    data: np.ndarray, offsets: np.ndarray, n: int = 5
) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each document concatenated, offsets by document).

    A document with fewer than ``n`` words has one shingle, its whole word sequence; one
    without words has none.
    """
    h, at = words(data, offsets)
    docs = len(at) - 1
    count = np.diff(at)
    whole = ngrams(h, n)
    keep = np.zeros(len(whole), bool)
    doc = np.zeros(len(whole), np.int64)
    if len(whole):
        of = np.repeat(np.arange(docs), count)
        keep = of[: len(whole)] == of[n - 1 :]
        doc = of[: len(whole)]
    short = np.flatnonzero((count > 0) & (count < n))
    extra = np.array(
        [int(ngrams(h[at[d] : at[d + 1]], int(count[d]))[0]) for d in short.tolist()], np.uint64
    )
    value = np.concatenate([whole[keep], extra])
    doc = np.concatenate([doc[keep], short])
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(docs + 1))
