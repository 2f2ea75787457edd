"""Counting quotient filter over 64-bit fingerprints, in the rank-and-select form.

A fingerprint is split into a quotient (its high bits) and a remainder. Per filter there are
one bit for each quotient that occurs, one bit for each slot that ends its quotient's run,
the remainders in order, and counters for those seen more than once. Quotient and remainder
together give the fingerprint back, so filters decode and merge without loss, and memory is
some bits above the remainder for each distinct fingerprint.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<BBQQ")


def build(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints and their counts."""
    found, counts = np.unique(values.astype(np.uint64), return_counts=True)
    return found, counts.astype(np.uint64)


def encode(found: np.ndarray, counts: np.ndarray, skip: int = 0) -> bytes:
    """found: sorted, distinct, alike in their `skip` highest bits (the block that the filter covers)."""
    n = len(found)
    q = max(1, int(np.ceil(np.log2(max(n, 1) / 0.75))) if n else 1)
    q = min(q, 64 - skip - 1)
    r = 64 - skip - q
    inner = (found << np.uint64(skip)) >> np.uint64(skip)
    quotient = (inner >> np.uint64(r)).astype(np.int64)
    width = -(-r // 8)
    remainder = (inner & np.uint64((1 << r) - 1)).astype("<u8").view(np.uint8).reshape(n, 8)[:, :width]
    occupied = np.zeros(1 << q, dtype=bool)
    occupied[quotient] = True
    run_end = np.ones(n, dtype=bool)
    run_end[:-1] = quotient[1:] != quotient[:-1]
    many = counts > 1
    return b"".join(
        [
            _HEAD.pack(q, skip, n, int(found[0]) if n else 0),
            np.packbits(occupied).tobytes(),
            np.packbits(run_end).tobytes(),
            remainder.tobytes(),
            np.packbits(many).tobytes(),
            counts[many].astype("<u8").tobytes(),
        ]
    )


def decode(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    q, skip, n, first = _HEAD.unpack_from(data)
    at = _HEAD.size
    r = 64 - skip - q

    def bits(count: int) -> np.ndarray:
        nonlocal at
        size = -(-count // 8)
        out = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=count).astype(bool)
        at += size
        return out

    occupied, run_end = np.flatnonzero(bits(1 << q)), bits(n)
    width = -(-r // 8)
    remainder = np.zeros((n, 8), dtype=np.uint8)
    remainder[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
    at += n * width
    many = bits(n)
    counts = np.ones(n, dtype=np.uint64)
    counts[many] = np.frombuffer(data, "<u8", int(many.sum()), at)
    if not n:
        return np.zeros(0, np.uint64), counts
    # the k-th run belongs to the k-th quotient that occurs
    run = np.cumsum(run_end) - run_end
    found = (occupied[run].astype(np.uint64) << np.uint64(r)) | remainder.reshape(-1).view("<u8")
    if skip:
        found |= np.uint64((first >> (64 - skip)) << (64 - skip))
    return found, counts


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted filters, merged two by two without a sort; counts of equal fingerprints add up."""
    runs = list(parts) or [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
    while len(runs) > 1:
        runs = [merge_two(*runs[i : i + 2]) for i in range(0, len(runs) - 1, 2)] + runs[len(runs) & ~1 :]
    return runs[0]


def merge_two(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint of b adds to its equal in a, or goes in where its remainder belongs."""
    (found, counts), (more, n) = a, b
    at = np.searchsorted(found, more)
    same = at < len(found)
    same[same] = found[at[same]] == more[same]
    counts = counts.copy()
    counts[at[same]] += n[same]
    return np.insert(found, at[~same], more[~same]), np.insert(counts, at[~same], n[~same])
