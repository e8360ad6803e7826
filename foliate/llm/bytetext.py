"""Words of Arrow text columns as numpy arrays over the UTF-8 bytes, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Multiplier of the polynomial word hash; odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
CHUNK_BYTES = 1 << 20

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: `[^\x20\x09-\x0D]+`
SPACED = ~_WHITE
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of text whose A-Z are lower-cased
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64))


class Powers:
    """Powers of BASE and of its inverse, grown as needed and kept for the next chunk."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, CHUNK_BYTES + 1)
            for name, factor in (("up", BASE), ("down", BASE_INVERSE)):
                steps = np.full(size, factor, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls.up, cls.down


@dataclass
class Words:
    """Words of a chunk of rows: `data[starts[i]:ends[i]]` belongs to row `row[i]`; `first[r]` is the first word of row r."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit value for each word, equal for equal bytes wherever they stand."""
        n = len(self.data)
        up, down = Powers.to(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[self.data] * up[:n], out=total[1:])
        value = (total[self.ends] - total[self.starts]) * down[self.starts]
        return mixed(value + (self.ends - self.starts).astype(np.uint64))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64, len(column) + 1, column.offset * 8)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most `limit` bytes of text, or one row where a single text is longer; none is empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = raw(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def split(column: pa.Array, letters: np.ndarray = SPACED, lower: bool = True) -> Words:
    data, offsets = raw(column)
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = letters[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:n]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | cut[1:n]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(closes) + 1
    first = np.searchsorted(starts, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, offsets, starts, ends, row, first)


def joined(words: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words with one space after each: bytes, starts and ends in them."""
    lengths = words.ends - words.starts
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if not len(starts):
        return b"", starts, ends
    source = np.arange(ends[-1] + 1) + np.repeat(words.starts - starts, lengths + 1)
    out = words.data[np.minimum(source, len(words.data) - 1)]
    out[ends] = 0x20
    return out.tobytes(), starts, ends
