"""Vectorised words and shingles over a run of texts, straight from their UTF-8 bytes.

A word is a run of bytes other than 0x20 and 0x09-0x0D, after A-Z are lower-cased; that
is `[^\\x20\\x09-\\x0D]+` on the text, since UTF-8 has those bytes nowhere else.
"""

from __future__ import annotations

import numpy as np

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.ones(256, dtype=bool)
IN_WORD[[0x20, 9, 10, 11, 12, 13]] = False

#: Letters, digits and all beyond ASCII: words without punctuation.
IN_NAME = np.zeros(256, dtype=bool)
IN_NAME[48:58] = IN_NAME[97:123] = IN_NAME[128:] = True

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
#: Odd multipliers of the words of a shingle.
_PLACES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 12)
        have = np.empty(size, dtype=np.uint64)
        have[0] = 1
        filled = 1
        while filled < size:
            take = min(filled, size - filled)
            have[filled : filled + take] = have[:take] * np.uint64(pow(base, filled, 1 << 64))
            filled += take
        if size <= 1 << 22:
            _POWERS[base] = have
    return have


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its first byte, words before each text: one more than texts). Texts never share a word."""
    hashes, starts, _, first = located_words(data, offsets)
    return hashes, starts, first


def located_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = IN_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As words(), with the end byte of each word too. table: the lower-cased bytes that words are made of."""
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(offsets), dtype=np.int64)
    low = LOWER[data]
    inside = table[low]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    total = (low.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n)[:n]
    np.cumsum(total, out=total)
    hashes = total[ends - 1]
    hashes -= np.where(starts > 0, total[starts - 1], np.uint64(0))
    hashes *= _powers(_INVERSE, n)[starts]
    return mix(hashes), starts, ends, np.searchsorted(starts, offsets)


def shingle_sets(hashes: np.ndarray, first: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """For each text its distinct k-word shingles as sorted 64-bit hashes; a shorter text is one shingle of all its words."""
    out = []
    rolled = shingles(hashes, k)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            out.append(short_shingle(hashes[a:b]))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words, across texts too; callers take those inside a text."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        total = mix(total) + hashes[i : i + n] * _PLACES[i % 5]
    return mix(total, k)


def short_shingle(hashes: np.ndarray) -> np.ndarray:
    """The one shingle of a text with fewer words than a shingle has; its length keeps it apart from the others."""
    total = np.zeros(1, dtype=np.uint64)
    for i in range(len(hashes)):
        total = mix(total) + hashes[i : i + 1] * _PLACES[i % 5]
    return mix(total, 1000 + len(hashes))
