"""Elias-Fano sequences and the n-gram trie levels built of them, in one anonymous memory map, with vectorised queries."""

from __future__ import annotations

import mmap

import numpy as np

_BYTE_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)
#: _SELECT[b, k]: position of the k-th set bit of byte b.
_SELECT = np.zeros((256, 8), np.uint8)
for _b in range(256):
    _SELECT[_b, : _BYTE_ONES[_b]] = [i for i in range(8) if _b >> i & 1]


def mapped(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """The arrays, copied into one anonymous memory map, eight-byte aligned."""
    at, places = 0, []
    for a in arrays:
        places.append(at)
        at += -(-a.nbytes // 8) * 8
    buf = mmap.mmap(-1, max(at, 8))
    out = []
    for a, place in zip(arrays, places, strict=True):
        view = np.frombuffer(buf, a.dtype, a.size, place)
        view[:] = a.ravel()
        out.append(view)
    return out


class EliasFano:
    """A non-decreasing sequence of n values under u, in about 2 + log2(u / n) bits each: low bits as they are, high bits in unary.

    The unary part has a running count of ones for each byte group of eight, from which both kinds of bits are selected.
    """

    def __init__(self, values: np.ndarray):
        values = values.astype(np.uint64)
        self.n = len(values)
        top = int(values[-1]) + 1 if self.n else 1
        self.shift = np.uint64(max(0, (top // max(self.n, 1)).bit_length() - 1))
        kind = next(t for t, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if int(self.shift) <= bits)
        low = (values & ((np.uint64(1) << self.shift) - np.uint64(1))).astype(kind)
        high = (values >> self.shift).astype(np.int64)
        self.buckets = int(high[-1]) + 1 if self.n else 1
        bits = np.zeros(-(-(self.n + self.buckets + 1) // 64) * 64, np.uint8)
        bits[high + np.arange(self.n)] = 1
        packed = np.packbits(bits, bitorder="little")
        ones = _BYTE_ONES[packed].reshape(-1, 8).sum(1, dtype=np.int64)
        self.low, self.bits, self.ones = mapped([low, packed, np.concatenate([[0], np.cumsum(ones)])])

    def _select(self, k: np.ndarray, zero: bool) -> np.ndarray:
        """Position of the k-th one, or zero, counted from 0."""
        before = 64 * np.arange(len(self.ones)) - self.ones if zero else self.ones
        group = np.searchsorted(before, k, "right") - 1
        left = k - before[group]
        at = group * 8
        flip = np.uint8(0xFF if zero else 0)
        for _ in range(7):
            here = _BYTE_ONES[self.bits[at] ^ flip]
            on = left >= here
            left = np.where(on, left - here, left)
            at = at + on
            if not on.any():
                break
        return at * 8 + _SELECT[self.bits[at] ^ flip, left]

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        high = self._select(i, False) - i
        return (high.astype(np.uint64) << self.shift) | self.low[i].astype(np.uint64)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """For each x the first position whose value is not less, or n: the bucket of its high bits, then a search of the low bits inside it."""
        x = x.astype(np.uint64)
        high = np.minimum(x >> self.shift, np.uint64(self.buckets)).astype(np.int64)
        over = high >= self.buckets
        h = np.where(over, self.buckets - 1, high)
        lo = np.where(h > 0, self._select(np.maximum(h - 1, 0), True) - h + 1, 0)
        hi = self._select(h, True) - h
        want = x & ((np.uint64(1) << self.shift) - np.uint64(1))
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            less = open_ & (self.low[np.minimum(mid, max(self.n - 1, 0))].astype(np.uint64) < want)
            lo = np.where(less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        return np.where(over, self.n, lo)


class Trie:
    """Two levels under hashed contexts: contexts, monotone pointers to their successors, and the successors themselves.

    Successors are kept relative to their context: each context's run starts at the last value of the run before, so the level is
    one rising sequence. Every context and successor has values of its own, 16 bits each.
    """

    def __init__(self, contexts: np.ndarray, pointers: np.ndarray, successors: np.ndarray, context_values: np.ndarray, successor_values: np.ndarray):
        self.contexts, self.pointers = EliasFano(contexts), EliasFano(pointers)
        sizes = np.diff(pointers)
        tops = successors[pointers[1:] - 1] + np.uint64(1) if len(sizes) else successors[:0]
        self.base = EliasFano(np.concatenate([[np.uint64(0)], np.cumsum(tops, dtype=np.uint64)]))
        start = np.concatenate([[np.uint64(0)], np.cumsum(tops, dtype=np.uint64)])[:-1]
        self.successors = EliasFano(successors + np.repeat(start, sizes))
        self.context_values, self.successor_values = mapped([context_values, successor_values])
        self.context_width = context_values.shape[1] if context_values.ndim > 1 else 1

    def find_contexts(self, contexts: np.ndarray) -> np.ndarray:
        """Their positions, or -1."""
        n = self.contexts.n
        if not n:
            return np.full(len(contexts), -1)
        at = self.contexts.successor(contexts)
        safe = np.minimum(at, n - 1)
        return np.where((at < n) & (self.contexts[safe] == contexts), safe, -1)

    def find_successors(self, at: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Positions of words under contexts at `at` (-1: none), or -1."""
        n = self.successors.n
        if not n:
            return np.full(len(at), -1)
        ok = at >= 0
        c = np.where(ok, at, 0)
        base = self.base[c]
        beyond = words >= self.base[c + 1] - base
        sought = base + np.where(beyond, np.uint64(0), words)
        place = self.successors.successor(sought)
        safe = np.minimum(place, n - 1)
        inside = (place >= self.pointers[c].astype(np.int64)) & (place < self.pointers[c + 1].astype(np.int64))
        return np.where(ok & ~beyond & inside & (self.successors[safe] == sought), safe, -1)
