"""Near-duplicate classes by the Jaccard similarity of word shingles: SimHash, an inverted index on positional bytes, verified exactly.

A text's fingerprint has 512 bits, each the majority over its distinct five-word shingles. Texts of similarity 0.8 differ in 15 % of them
at most on average, so that they share 17 of the 64 positional bytes. The index holds the bytes of each of the eight 64-bit words but the
last, 56 postings for a text; inside a posting list texts meet that share one more byte of that word, so a pair meets unless it shares at
most one byte in every word: sure from nine shared bytes on, and missed about once in 9,000 times at a similarity of 0.8, in sets of five
and six shingles once in 3,000. Pairs that meet are tallied over all 64 positions, those with fewer than MIN_BYTES shared bytes or more
than RADIUS differing bits are dropped. Posting lists that are read together yield one edge for each text, to the least of its class, never
all pairs. Groups that these links connect are then read together, and within each the pairs that the fingerprints don't rule out are
verified by their shingle sets; classes follow verified links only, whichever candidates brought a group together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import chunks, mixed, split
from .columns import mapped
from .components import connected
from .simhash import _Forest
from .store import written

SHINGLE = 5
SIMILAR = 0.8
#: 64-bit words of a fingerprint.
WORDS = 8
#: Differing bits of a fingerprint above which a pair is not verified: five standard deviations over those of SIMILAR.
RADIUS = 120
#: The same for the first two words, which are looked at before the others: six standard deviations.
RADIUS_2 = 46
#: Least number of shared bytes: SIMILAR shares fewer once in 100,000 times.
MIN_BYTES = 5
#: Different sets of fewer shingles than this have no similarity of SIMILAR: 3 of 4 are too few.
LEAST_SHINGLES = 4
#: Runs of more texts than this that share two bytes are searched from text to text, so that a large class makes no square of pairs.
DENSE = 512
#: Elements of a comparison's arrays at a time.
BLOCK = 1 << 17
_ORDER = np.uint64(0x9FB21C651E98DF25)
_ONES = np.uint64(0x0101010101010101)
_SEEDS = mixed(np.arange(1, WORDS + 1, dtype=np.uint64))
#: One vote on each bit that all texts have, which keeps short texts that differ by a shingle nearer, and the bits that ties give.
_VOTE, _TIE = np.unpackbits(mixed(mixed(np.arange(1, 2 * WORDS + 1, dtype=np.uint64))).view(np.uint8), bitorder="little").astype(np.int64).reshape(2, -1)
#: Positions with a list of their own.
_LISTED = np.array([i for i in range(8 * WORDS) if i % 8 != 7])


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of all rows, sorted within each, and where each row's begin; fewer words than five are one shingle."""
    words = split(column)
    h, counts = words.hashes(), words.counts
    n = np.where(counts > 0, np.maximum(counts - SHINGLE + 1, 1), 0)
    row = np.repeat(np.arange(len(n)), n)
    first = np.repeat(words.first[:-1], n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    end = np.repeat(words.first[1:], n)
    value = np.zeros(len(row), np.uint64)
    for k in range(SHINGLE):
        there = first + k < end
        value[there] = (value[there] + h[first[there] + k]) * _ORDER
    value = mixed(value)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[new], np.searchsorted(row[new], np.arange(len(n) + 1))


def fingerprints(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """WORDS unsigned words for each row's distinct shingles; rows without any have the common votes."""
    n = np.diff(at)
    votes = np.zeros((len(n), 64 * WORDS), np.int64)
    full = np.flatnonzero(n)
    if len(full):
        # Eight bit planes are summed in the bytes of 64-bit words, at most 255 shingles at a time.
        block = np.flatnonzero((np.arange(len(values)) - np.repeat(at[:-1], n)) % 255 == 0)
        first = np.searchsorted(block, at[:-1][full])
        sums = np.zeros((len(block), 8, 8), np.int64)
        for w in range(WORDS):
            h = mixed(values ^ _SEEDS[w])
            for k in range(8):
                sums[:, :, k] = np.add.reduceat((h >> np.uint64(k)) & _ONES, block).view(np.uint8).reshape(-1, 8)
            votes[full, 64 * w : 64 * w + 64] = np.add.reduceat(sums.reshape(-1, 64), first, axis=0)
    return np.packbits(2 * (votes + _VOTE) + _TIE > n[:, None] + 1, axis=1, bitorder="little").view(np.uint64)


def _signed(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A hash of each row's shingle set, zero for none, and its fingerprint, null for sets that are too small to be near another."""
    values, at = shingles(column)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(values))])
    size = np.diff(at)
    print_ = np.where(size > 0, mixed(total[at[1:]] - total[at[:-1]] + size.astype(np.uint64)), np.uint64(0))
    signs = fingerprints(values, at)
    return print_, pa.array([x.tobytes() if n >= LEAST_SHINGLES else None for x, n in zip(signs, size.tolist(), strict=True)], pa.binary())


def prints(rows: DataFrame) -> DataFrame:
    """(key, fp, sign) of `rows(key, text)`: see `_signed`."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            print_, signs = _signed(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(print_.view(np.int64)), signs], ["key", "fp", "sign"])

    return mapped(rows, sign, f"key {rows.schema['key'].dataType.simpleString()}, fp long, sign binary")


def _words(column: pa.Array) -> np.ndarray:
    """Fingerprints of a binary column without nulls."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, WORDS)


def _near(signs: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows a and b of `signs` share MIN_BYTES positional bytes and differ in RADIUS bits at most."""
    near = np.bitwise_count(signs[a, :2] ^ signs[b, :2]).sum(1, dtype=np.int64) <= RADIUS_2
    some = np.flatnonzero(near)
    x = signs[a[some]] ^ signs[b[some]]
    shared = (x.view(np.uint8).reshape(-1, 8 * WORDS) == 0).sum(1)
    near[some] = (shared >= MIN_BYTES) & (np.bitwise_count(x).sum(1, dtype=np.int64) <= RADIUS)
    return near


def _linked(slot: np.ndarray, fp: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts of whole posting lists that are connected to a lesser one by near pairs, and the least one each.

    `slot` is 256 times the position of a byte and the byte.
    """
    texts, own = np.unique(fp, return_inverse=True)
    forest = _Forest(len(texts))
    data, place = signs.view(np.uint8).reshape(-1, 8 * WORDS), slot >> 8
    for step in range(1, 8):
        at = np.flatnonzero(place % 8 + step < 8)
        group = slot[at] << 8 | data[at, place[at] + step]
        order = np.argsort(group, kind="stable")
        at, group = at[order], group[order]
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(at) else at
        sizes = np.diff(np.append(starts, len(at)))
        for s, n in zip(starts[sizes > DENSE].tolist(), sizes[sizes > DENSE].tolist(), strict=True):
            _spread(at[s : s + n], own, signs, forest)
        few = np.repeat((sizes <= DENSE) & (sizes > 1), sizes)
        at, group = at[few], group[few]
        left, ahead = np.arange(len(at)), 1
        while True:
            left = left[left + ahead < len(at)]
            left = left[group[left] == group[left + ahead]]
            if not len(left):
                break
            for k in range(0, len(left), BLOCK):
                a, b = at[left[k : k + BLOCK]], at[left[k : k + BLOCK] + ahead]
                apart = forest.label[own[a]] != forest.label[own[b]]
                a, b = a[apart], b[apart]
                near = _near(signs, a, b)
                forest.join(own[a[near]], own[b[near]])
            ahead += 1
    # Trees are joined under their least text, so that a label leads to it.
    label = forest.label
    while (label[label] != label).any():
        label = label[label]
    more = np.flatnonzero(label != np.arange(len(texts)))
    return texts[more], texts[label[more]]


def _spread(run: np.ndarray, own: np.ndarray, signs: np.ndarray, forest: _Forest) -> None:
    """Joins what is near in `run`: texts that are reached are compared with those that are not, never with each other."""
    left = run
    while len(left):
        queue, left = left[:1], left[1:]
        while len(queue) and len(left):
            part = queue[: max(1, BLOCK // len(left))]
            queue = queue[len(part) :]
            near = _near(signs, np.repeat(part, len(left)), np.tile(left, len(part))).reshape(len(part), len(left))
            hit = near.any(0)
            forest.join(own[part[near[:, hit].argmax(0)]], own[left[hit]])
            queue, left = np.concatenate([queue, left[hit]]), left[~hit]


def linked(distinct: DataFrame) -> DataFrame:
    """Edges (u, v) that connect the texts of `distinct(fp, sign)` as all candidate pairs would; v is the lesser one."""

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                fp, sign = (batch.column(i).slice(k, 1024) for i in (0, 1))
                data = _words(sign).view(np.uint8).reshape(-1, 8 * WORDS)
                own = pa.array(np.repeat(np.arange(len(fp)), len(_LISTED)))
                slots = (_LISTED.astype(np.int32) << 8 | data[:, _LISTED]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(slots), fp.take(own), sign.take(own)], ["slot", "fp", "sign"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def edges(slot: np.ndarray, fp: np.ndarray, signs: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in _linked(slot, fp, signs)], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = np.asarray(batch.column(0)).astype(np.int64), np.asarray(batch.column(1)), _words(batch.column(2))
            # The last posting list of the batch may go on in the next one.
            first = int(np.searchsorted(now[0], now[0][-1]))
            if held and (first or held[0][0][0] != now[0][0]):
                held.append(tuple(x[:first] for x in now))
                yield edges(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
            elif first:
                yield edges(*(x[:first] for x in now))
            held.append(tuple(x[first:] for x in now))
        if held:
            yield edges(*(np.concatenate(x) for x in zip(*held, strict=True)))

    postings = mapped(distinct.where("sign is not null").select("fp", "sign"), posted, "slot int, fp long, sign binary")
    return mapped(postings.repartition("slot").sortWithinPartitions("slot"), found, "u long, v long")


def classes(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each row the first row that it is connected to by similarities of SIMILAR or more."""
    n = len(at) - 1
    label, left = np.full(n, -1), np.arange(n)
    signs, sizes = fingerprints(values, at), np.diff(at)
    while len(left):
        label[left[0]] = left[0]
        queue, left, root = [left[0]], left[1:], left[0]
        while queue and len(left):
            p = queue.pop()
            ratio = np.minimum(sizes[left], sizes[p]) >= SIMILAR * np.maximum(sizes[left], sizes[p])
            some = np.flatnonzero(ratio)
            some = some[np.bitwise_count(signs[left[some]] ^ signs[p]).sum(1, dtype=np.int64) <= RADIUS]
            near = []
            for s in some.tolist():
                q = left[s]
                both = len(np.intersect1d(values[at[p] : at[p + 1]], values[at[q] : at[q + 1]], assume_unique=True))
                # In whole numbers: both / (all - both) >= 4 / 5.
                if 9 * both >= 4 * (sizes[p] + sizes[q]):
                    near.append(s)
            label[left[near]] = root
            queue += left[near].tolist()
            left = np.delete(left, near)
    return label


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, component): `component` is the least key that is reachable over links of similarity SIMILAR or more.

    Texts that are null, empty or without a word are one class. A group of candidates is read by one task, with its distinct texts
    in memory as shingle hashes. Rows with equal keys stay separate rows; columns besides key and text are not read.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    signed = written(prints(rows), "similar")
    distinct = written(signed.groupBy("fp").agg(F.min("key").alias("least"), F.first("sign").alias("sign")), "similar-distinct")
    groups = connected(linked(distinct))
    members = distinct.join(groups.withColumnRenamed("node", "fp"), "fp").select("fp", "root", F.col("least").alias("key"))
    texts = rows.join(members, "key").select("root", "fp", "text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # fingerprint and shingles of each text of the group being read
        root = None

        def settled() -> pa.RecordBatch:
            fps = np.array([x[0] for x in held], np.int64)
            at = np.concatenate([[0], np.cumsum([len(x[1]) for x in held])])
            label = classes(np.concatenate([x[1] for x in held]), at)
            return pa.RecordBatch.from_arrays([pa.array(fps), pa.array(fps[label])], ["fp", "label"])

        for batch in chunks(batches, "text"):
            values, at = shingles(batch.column(2))
            for r, (now, fp) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if now != root and held:
                    yield settled()
                    held.clear()
                root = now
                if not held or held[-1][0] != fp:
                    held.append((fp, values[at[r] : at[r + 1]].copy()))
        if held:
            yield settled()
        held.clear()

    found = written(mapped(texts.repartition("root").sortWithinPartitions("root", "fp"), verify, "fp long, label long"), "similar-classes")
    labelled = distinct.join(found, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    component = labelled.groupBy("label").agg(F.min("least").alias("component"))
    last = labelled.join(component, "label").select("fp", "component")
    return signed.select("key", "fp").join(last, "fp").select(F.col("key").alias(key), "component")
