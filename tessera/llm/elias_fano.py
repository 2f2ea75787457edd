"""Elias-Fano sequences and an n-gram trie of two levels over them."""

from __future__ import annotations

import mmap
import os
import struct

import numpy as np

_HEAD = struct.Struct("<QQQQ")
#: Quantised log10 probabilities run from -LOWEST to 0.
LOWEST = 16.0
#: The last 16-bit value is left for what has no probability.
STEPS = (1 << 16) - 2

#: Ones of each byte; and the place of its k-th one, from the highest bit.
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.int8)
_PLACE = np.zeros((256, 8), dtype=np.int8)
for _byte in range(256):
    _at = np.flatnonzero(np.unpackbits(np.array([_byte], np.uint8)))
    _PLACE[_byte, : len(_at)] = _at


class EliasFano:
    """A sorted sequence of 64-bit numbers: low bytes as they are, high bits in unary, one zero after each bucket."""

    def __init__(self, data: memoryview | bytes):
        self.n, self.width, words, self.buckets = _HEAD.unpack_from(data)
        at = _HEAD.size
        self.low = np.frombuffer(data, np.uint8, self.n * self.width, at).reshape(self.n, self.width)
        at += self.n * self.width
        self.high = np.frombuffer(data, np.uint8, words * 8, at).reshape(words, 8)
        at += words * 8
        self.zeros = np.frombuffer(data, "<u4", words + 1, at)

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        n = len(values)
        most = int(values[-1]) if n else 0
        width = min(7, -(-max(0, (most // max(n, 1)).bit_length()) // 8))
        high = (values >> np.uint64(8 * width)).astype(np.int64)
        buckets = int(high[-1]) + 1 if n else 1
        words = -(-(n + buckets) // 64)
        bits = np.zeros(words * 64, dtype=np.uint8)
        bits[high + np.arange(n)] = 1
        # what follows the last bucket is neither asked for nor counted as a bucket
        packed = np.packbits(bits)
        zeros = np.concatenate([[0], np.cumsum(64 - bits.reshape(words, 64).sum(axis=1, dtype=np.int64))])
        low = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(n, 8)[:, :width]
        return _HEAD.pack(n, width, words, buckets) + low.tobytes() + packed.tobytes() + zeros.astype("<u4").tobytes()

    def _select(self, k: np.ndarray, before: np.ndarray, flip: int) -> np.ndarray:
        """The place of the k-th bit (from 0) that is one, or zero if flip is 255. before: such bits before each word."""
        out = np.empty(len(k), dtype=np.int64)
        for a in range(0, len(k), 1 << 16):
            part = k[a : a + (1 << 16)]
            word = np.searchsorted(before, part, side="right") - 1
            rest = part - before[word]
            bytes_ = self.high[word] ^ np.uint8(flip)
            until = np.cumsum(_ONES[bytes_], axis=1, dtype=np.int16)
            byte = (until <= rest[:, None]).sum(axis=1)
            row = np.arange(len(part))
            rest = rest - np.where(byte > 0, until[row, byte - 1], 0)
            out[a : a + (1 << 16)] = word * 64 + byte * 8 + _PLACE[bytes_[row, byte], rest]
        return out

    def until(self, bucket: np.ndarray) -> np.ndarray:
        """How many values lie in buckets up to each given one (-1: none): the place of its zero, less the zeros before."""
        asked = bucket >= 0
        k = bucket[asked]
        out = np.zeros(len(bucket), dtype=np.int64)
        out[asked] = self._select(k, self.zeros, 255) - k
        return out

    def lows(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), dtype=np.uint64)
        for i in range(self.width):
            out |= self.low[at, i].astype(np.uint64) << np.uint64(8 * i)
        return out

    def find(self, values: np.ndarray, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """The place of each value, from start to end if given, or -1: its bucket by the unary part, then a binary search among
        the low parts."""
        if not self.n:
            return np.full(len(values), -1, dtype=np.int64)
        bucket = (values >> np.uint64(8 * self.width)).astype(np.int64)
        inside = bucket < self.buckets
        bucket = np.where(inside, bucket, 0)
        low = values & np.uint64((1 << (8 * self.width)) - 1)
        a, b = self.until(bucket - 1), self.until(bucket)
        if start is not None:
            a, b = np.maximum(a, start), np.minimum(b, end)
        stop = b.copy()
        while (open_ := np.flatnonzero(a < b)).size:
            mid = (a[open_] + b[open_]) >> 1
            less = self.lows(mid) < low[open_]
            a[open_] = np.where(less, mid + 1, a[open_])
            b[open_] = np.where(less, b[open_], mid)
        near = np.minimum(a, self.n - 1)
        return np.where(inside & (a < stop) & (self.lows(near) == low), a, -1)

    def get(self, at: np.ndarray) -> np.ndarray:
        """The values at the given places."""
        ones = np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros
        high = self._select(at, ones, 0) - at
        return (high.astype(np.uint64) << np.uint64(8 * self.width)) | self.lows(at)


def quantised(logs: np.ndarray) -> np.ndarray:
    """log10 values as 16-bit steps of a fixed scale, so that they do not depend on what else is stored."""
    return np.rint((np.clip(logs, -LOWEST, 0) + LOWEST) * (STEPS / LOWEST)).astype("<u2")


def restored(steps: np.ndarray) -> np.ndarray:
    return steps.astype(np.float64) * (LOWEST / STEPS) - LOWEST


class Trie:
    """Contexts, pointers to their successors, successors, and each successor's quantised probability.

    Successors are kept relative to their context: each is its word's number plus the last value of the context before,
    so the whole level is one rising sequence. A pointer and the next one bound a context's part of it. The levels lie
    side by side in a file in memory, which is mapped and read in place.
    """

    def __init__(self, data: memoryview | bytes):
        sizes = struct.unpack_from("<4Q", data)
        at, parts = 32, []
        for size in sizes:
            parts.append(memoryview(data)[at : at + size])
            at += size
        self.contexts, self.pointers, self.successors = (EliasFano(p) for p in parts[:3])
        self.steps = np.frombuffer(parts[3], "<u2")

    @staticmethod
    def encode(contexts: np.ndarray, counts: np.ndarray, successors: np.ndarray, logs: np.ndarray) -> bytes:
        """contexts: sorted, distinct numbers; counts: their successors, one at least; successors: numbers, sorted within a context."""
        pointers = np.concatenate([[0], np.cumsum(counts)]).astype(np.uint64)
        last = successors[pointers[1:].astype(np.int64) - 1]
        before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(last, dtype=np.uint64)])[:-1]
        relative = successors + np.repeat(before, counts)
        parts = [EliasFano.encode(contexts), EliasFano.encode(pointers), EliasFano.encode(relative), quantised(logs).tobytes()]
        return struct.pack("<4Q", *map(len, parts)) + b"".join(parts)

    @classmethod
    def mapped(cls, data: bytes) -> Trie:
        """The levels in a file of their own, without a name and in memory alone, mapped to be read."""
        file = os.memfd_create("levels")
        try:
            with open(file, "wb", closefd=False) as f:
                f.write(data)
            return cls(memoryview(mmap.mmap(file, 0, access=mmap.ACCESS_READ)))
        finally:
            os.close(file)

    def bounds(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the successors of contexts of these ranks begin and end."""
        return self.pointers.get(rank).astype(np.int64), self.pointers.get(rank + 1).astype(np.int64)

    def lookup(self, contexts: np.ndarray, follow: np.ndarray, words: np.ndarray) -> np.ndarray:
        """log10 of each (context, word), or nan. contexts: distinct ones; follow: how many of the words are asked after each.

        The pointers bound a context's successors; a word is searched between them, relative to the value before.
        """
        rank = self.contexts.find(contexts)
        known = np.repeat(rank >= 0, follow)
        out = np.full(len(words), np.nan)
        follow, rank = follow[rank >= 0], rank[rank >= 0]
        if not len(rank):
            return out
        start, end = self.bounds(rank)
        before = np.where(start > 0, self.successors.get(np.maximum(start - 1, 0)), np.uint64(0))
        asked = np.flatnonzero(known)
        at = self.successors.find(words[asked] + np.repeat(before, follow), np.repeat(start, follow), np.repeat(end, follow))
        hit = at >= 0
        out[asked[hit]] = restored(self.steps[at[hit]])
        return out
