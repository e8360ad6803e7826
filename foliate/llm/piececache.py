"""Encoding of whole texts piece by piece, where a tokenizer never merges across the pieces.

Each distinct piece is encoded once by the library, in batches that it spreads over its threads; texts are then put together from
the pieces' ids with numpy. The result is that of encoding the whole text. Pieces are known by a 64-bit hash of their characters, so
no Python object is made for a piece that has been seen.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from .bytetext import Powers, mixed

#: Pieces kept between chunks, and ids of theirs; beyond either the cache starts anew. Some 30 MB in a Python worker.
CACHED = 600_000
POOLED = 3_000_000
#: Longer pieces, among them texts that are taken whole, are not kept.
LONG = 128


@dataclass
class Pieces:
    """Pieces `joined[starts[i]:ends[i]]`, `counts[r]` of them in row r; `codes` are the code points of `joined`."""

    joined: str
    codes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray

    def hashes(self) -> np.ndarray:
        n = len(self.codes)
        up, down = Powers.to(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed(self.codes.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        value = (total[self.ends] - total[self.starts]) * down[self.starts]
        return mixed(value + (self.ends - self.starts).astype(np.uint64))


def code_points(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts in a row, their code points, and where each begins and the last ends."""
    joined = "".join(texts)
    return joined, np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def pieces(joined: str, codes: np.ndarray, bounds: np.ndarray, begins: np.ndarray) -> Pieces:
    """Pieces that begin where `begins` says and at the start of each text, and reach to the next one."""
    begins[bounds[:-1][np.diff(bounds) > 0]] = True
    starts = np.flatnonzero(begins)
    return Pieces(joined, codes, starts, np.append(starts[1:], len(codes)), np.diff(np.searchsorted(starts, bounds)))


class CachedEncoder:
    """Ids of texts: `cut` makes pieces of them, `encode` gives ids and a flag for each of a list of new pieces."""

    def __init__(self, cut: Callable[[list[str]], Pieces], encode: Callable[[list[str]], tuple[list[list[int]], np.ndarray]], end: int | None = None, cached: int = CACHED):
        self.cut, self.encode, self.end, self.cached = cut, encode, end, cached
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flags = np.zeros(0, bool)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _add(self, keys: np.ndarray, new: list[str]) -> None:
        """Ids of new pieces, whose hashes rise, go to the end of the pool, and their places among the sorted keys."""
        ids, flags = self.encode(new)
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        need = self.used + int(sizes.sum())
        while len(self.pool) < need:
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : need] = np.fromiter((x for one in ids for x in one), np.uint32, need - self.used)
        at = np.searchsorted(self.keys, keys)
        starts = self.used + np.cumsum(sizes, dtype=np.int64) - sizes
        self.keys, self.starts, self.sizes, self.flags = (np.insert(old, at, x) for old, x in ((self.keys, keys), (self.starts, starts), (self.sizes, sizes), (self.flags, flags)))
        self.used = need

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in a row, how many each has (with the end id, if there is one), and whether all pieces of each are flagged."""
        if len(self.keys) > self.cached or self.used > POOLED:
            self._reset()
        p = self.cut([t or "" for t in texts])
        keys, first, own = np.unique(p.hashes(), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inner = at < len(self.keys)
        new[inner] = self.keys[at[inner]] != keys[inner]
        fresh = first[new]
        if len(fresh):
            self._add(keys[new], [p.joined[s:e] for s, e in zip(p.starts[fresh].tolist(), p.ends[fresh].tolist(), strict=True)])
            at = np.searchsorted(self.keys, keys)
        place = at[own]
        # The end id is one more piece behind each text's own.
        sizes = self.sizes[place].astype(np.int64)
        tops = np.cumsum(p.counts)
        text_sizes = np.diff(np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], tops])])
        flat = self.pool[np.arange(int(sizes.sum())) + np.repeat(self.starts[place] - (np.cumsum(sizes) - sizes), sizes)]
        good = np.diff(np.concatenate([[0], np.cumsum(self.flags[place])])[np.concatenate([[0], tops])]) == p.counts
        if self.end is not None:
            flat = np.insert(flat, np.cumsum(text_sizes), self.end)
            text_sizes = text_sizes + 1
        if len(fresh) and (long := keys[new][p.ends[fresh] - p.starts[fresh] > LONG]).size:
            gone = np.searchsorted(self.keys, long)
            self.keys, self.starts, self.sizes, self.flags = (np.delete(x, gone) for x in (self.keys, self.starts, self.sizes, self.flags))
        return flat, text_sizes, good
