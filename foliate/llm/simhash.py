"""SimHash fingerprints and near-duplicate classes.

Candidates come from an inverted index on positional bytes. Two 64-bit fingerprints that differ in at most three
bits agree in at least five of their eight bytes, so at least three of those five fall in one half of the bytes.
The index therefore holds, for each half, its four triples of positional bytes: eight postings for a fingerprint,
and every wanted pair meets in one of them. Pairs that meet are tallied over all eight positions, those with
fewer than five shared bytes are dropped, and the rest are verified by their differing bits. A posting list yields
only the edges of a spanning forest, never all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import chunks, joined, split
from .columns import mapped
from .components import connected
from .store import written

SHINGLE = 3
SEED = 42
MAX_BITS = 3
MIN_BYTES = 8 - MAX_BITS
#: Bit masks of the indexed triples of byte positions.
TRIPLES = [sum(0xFF << 8 * i for i in c) for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for c in combinations(half, 3)]
#: Posting lists longer than this are cut again by the bytes outside their triple.
DENSE = 2048
_ONES = np.uint64(0x0101010101010101)


def fingerprints(column: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Unsigned fingerprints of a text column; texts without a word, empty and null ones get zero."""
    words = split(column)
    buf, starts, ends = joined(words)
    counts = words.counts
    n_shingles = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    total = int(n_shingles.sum())
    out = np.zeros(len(counts), np.uint64)
    if not total:
        return out
    row_at = np.concatenate([[0], np.cumsum(n_shingles)])
    within = np.arange(total) - np.repeat(row_at[:-1], n_shingles)
    i = np.repeat(words.first[:-1], n_shingles) + within
    last = np.minimum(i + shingle, np.repeat(words.first[1:], n_shingles)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(buf[s:e], seed) for s, e in zip(starts[i].tolist(), ends[last].tolist(), strict=True)), np.uint64, total)
    # Eight bit planes are summed in the bytes of 64-bit words, at most 255 rows at a time.
    block = np.flatnonzero(within % 255 == 0)
    sums = np.zeros((len(block), 8, 8), np.int64)
    for k in range(8):
        plane = np.add.reduceat((hashes >> np.uint64(k)) & _ONES, block)
        sums[:, :, k] = plane.view(np.uint8).reshape(-1, 8)
    full = np.flatnonzero(n_shingles)
    bits = np.add.reduceat(sums.reshape(-1, 64), np.searchsorted(block, row_at[full]), axis=0)
    major = 2 * bits > n_shingles[full][:, None]
    out[full] = np.packbits(major, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprinted(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(key, fp): the fingerprint of each row, as a signed long."""
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            fp = fingerprints(batch.column(1), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["key", "fp"])

    return mapped(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")), run, f"key {kind.simpleString()}, fp long")


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Count filter over positional bytes, then the number of differing bits."""
    x = a ^ b
    shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(1)
    near = shared >= MIN_BYTES
    near[near] = np.bitwise_count(x[near]) <= MAX_BITS
    return near


class _Forest:
    """Union-find over the positions of one stretch of postings."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def root(self, i: int) -> int:
        label = self.label
        while label[i] != i:
            label[i] = label[label[i]]
            i = int(label[i])
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """The pairs that joined two trees."""
        new = []
        differ = self.label[a] != self.label[b]
        for i, j in zip(a[differ].tolist(), b[differ].tolist(), strict=True):
            x, y = self.root(i), self.root(j)
            if x != y:
                self.label[max(x, y)] = min(x, y)
                new.append((i, j))
        if new:
            self.label = self.label[self.label]
        return new


def _links(group: np.ndarray, fp: np.ndarray, mask: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the near pairs within runs of equal `group`; rows are sorted by it."""
    out: list[tuple[int, int]] = []
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    ends = np.concatenate([starts[1:], [len(group)]])
    forest = _Forest(len(group))
    sizes = ends - starts
    for s, e in zip(starts[sizes > DENSE].tolist(), ends[sizes > DENSE].tolist(), strict=True):
        outside = [i for i in range(8) if not mask >> 8 * i & 0xFF]
        part = fp[s:e]
        for c in combinations(outside, MIN_BYTES - 3):
            sub = part & np.uint64(sum(0xFF << 8 * i for i in c))
            order = np.argsort(sub, kind="stable")
            out += _cut(sub[order], part[order], order + s, forest, mask | sum(0xFF << 8 * i for i in c))
    few = np.repeat(sizes <= DENSE, sizes) & np.repeat(sizes > 1, sizes)
    at = np.flatnonzero(few)
    return out + _pairs(group[at], fp[at], at, forest)


def _cut(group: np.ndarray, fp: np.ndarray, at: np.ndarray, forest: _Forest, mask: int) -> list[tuple[int, int]]:
    """As _pairs, but runs longer than DENSE are cut by bits: they agree in the five bytes of `mask`, and of the eight threes of
    bits in the other three bytes near fingerprints share five. As fingerprints are distinct, what shares those too is 512 at most."""
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(starts, len(group)))
    long = np.repeat(sizes > DENSE, sizes)
    out = _pairs(group[~long], fp[~long], at[~long], forest)
    if long.any():
        group, fp, at = group[long], fp[long], at[long]
        free = [i for i in range(64) if not mask >> i & 1]
        threes = [sum(1 << i for i in free[k : k + 3]) for k in range(0, len(free), 3)]
        for c in combinations(threes, MIN_BYTES):
            sub = fp & np.uint64(mask | sum(c))
            order = np.argsort(sub, kind="stable")
            out += _pairs(sub[order], fp[order], at[order], forest)
    return out


def _pairs(group: np.ndarray, fp: np.ndarray, at: np.ndarray, forest: _Forest) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    step, left = 1, np.arange(len(group))
    while True:
        left = left[left + step < len(group)]
        left = left[group[left] == group[left + step]]
        if not len(left):
            return out
        near = left[_near(fp[left], fp[left + step])]
        out += forest.join(at[near], at[near + step])
        step += 1


def linked(distinct: DataFrame) -> DataFrame:
    """Edges (u, v) that connect the fingerprints of `distinct(fp)` as all their links would."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def found(slot: np.ndarray, part: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in np.unique(slot).tolist():
                own = slot == k
                mine = fp[own]
                edges = np.array(_links(part[own], mine, TRIPLES[k]), np.int64).reshape(-1, 2)
                if len(edges):
                    yield pa.RecordBatch.from_arrays([pa.array(mine[edges[:, i]].view(np.int64)) for i in (0, 1)], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            slot, part, fp = (np.asarray(batch.column(i)) for i in range(3))
            held.append((slot, part, fp.view(np.uint64)))
            # The last posting list of the batch may go on in the next one.
            slot, part, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            last = int(np.flatnonzero((slot != slot[-1]) | (part != part[-1]))[-1]) + 1 if (slot[0], part[0]) != (slot[-1], part[-1]) else 0
            yield from found(slot[:last], part[:last], fp[:last])
            held = [(slot[last:], part[last:], fp[last:])]
        if held:
            yield from found(*(np.concatenate(x) for x in zip(*held, strict=True)))

    slots = F.explode(F.array(*[F.struct(F.lit(k).cast("int").alias("slot"), F.lit(m - (1 << 64) if m >> 63 else m).cast("long").alias("mask")) for k, m in enumerate(TRIPLES)])).alias("s")
    postings = distinct.select("fp", slots).select(F.col("s.slot").alias("slot"), F.col("fp").bitwiseAND(F.col("s.mask")).alias("part"), "fp")
    return mapped(postings.repartition("slot", "part").sortWithinPartitions("slot", "part"), run, "u long, v long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(key, fp, component): `component` is the least key that is reachable over links of at most three bits.

    Texts that are null, empty or without a word share the fingerprint zero and so one class. Rows with equal keys
    stay separate rows. A null key is never a component while its class has another; columns besides key and text
    are not read, so their names cannot clash. An empty table gives an empty result.
    """
    prints = written(fingerprinted(docs, key, text, shingle), "simhash")
    distinct = prints.groupBy("fp").agg(F.min("key").alias("least"), F.count("*").alias("n"))
    distinct = written(distinct, "simhash-distinct")
    roots = connected(linked(distinct.select("fp")))
    classes = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"), ((F.col("n") > 1) | F.col("root").isNotNull()).alias("shared"))
    shared = written(classes.where("shared").drop("shared"), "simhash-classes")
    least = shared.groupBy("root").agg(F.min("least").alias("component"))
    members = shared.join(least, "root").select("fp", "component")
    return prints.join(members, "fp", "left").select(F.col("key").alias(key), "fp", F.coalesce("component", "key").alias("component"))
