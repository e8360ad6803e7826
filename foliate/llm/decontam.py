"""Benchmark decontamination by winnowed fingerprints.

A text's k-grams (k = 5 words) are hashed, and of each 9 k-grams in a row the least is kept, the rightmost of
equals. Two texts that share 13 words share a window of 9 k-grams and therefore keep the same one at the same place
in it: every shared span of 13 words is met. Kept k-grams of documents are joined with those of the benchmark, and
each meeting is extended word by word as far as a span of 13 words around it can reach. Items of fewer than 13 words are one
window of their own length; for these the hash of every run of that many words is joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import ALNUM, Words, chunks, mixed, split
from .columns import mapped

SPAN = 13
GRAM = 5
WINDOW = SPAN - GRAM + 1
#: Words that are carried on either side of a k-gram: no span of 13 words that holds it reaches further.
REACH = SPAN - GRAM
#: Size of the Bloom filter over benchmark fingerprints, whatever their number: half a megabyte. A fuller filter passes more rows to the exact join.
FILTER_BITS = 1 << 22
MERGED = 32
_STEP = np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n word hashes; as many as there are runs."""
    m = max(len(h) - n + 1, 0)
    out = np.full(m, n, np.uint64)
    for j in range(n):
        out = out * _STEP + h[j : j + m]
    return mixed(out)


def _inside(words: Words, n: int) -> np.ndarray:
    """For each run of n words of the chunk, whether it stays in one row."""
    m = max(len(words.row) - n + 1, 0)
    return words.row[:m] == words.row[n - 1 : n - 1 + m]


def winnowed(words: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams that winnowing keeps; rows of fewer than 13 words keep none."""
    grams = gram_hashes(h, GRAM)
    m = len(grams) - WINDOW + 1
    if m <= 0:
        return np.zeros(0, np.int64), grams[:0]
    best, at = grams[:m].copy(), np.arange(m)
    for j in range(1, WINDOW):
        other = grams[j : j + m]
        better = other <= best
        best[better] = other[better]
        at[better] = np.flatnonzero(better) + j
    kept = np.zeros(len(grams), bool)
    kept[at[_inside(words, SPAN)[:m]]] = True
    where = np.flatnonzero(kept)
    return where, grams[where]


def _around(words: Words, h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the words from REACH before to REACH after each k-gram, zero outside its row."""
    i = at[:, None] + np.arange(-REACH, GRAM + REACH)
    safe = np.clip(i, 0, len(h) - 1)
    own = (i == safe) & (words.row[safe] == words.row[at][:, None])
    return np.where(own, h[safe], np.uint64(0))


def _binary_rows(a: np.ndarray) -> pa.Array:
    width = a.shape[1] * 8
    return pa.Array.from_buffers(pa.binary(width), len(a), [None, pa.py_buffer(np.ascontiguousarray(a).tobytes())]).cast(pa.binary())


def _probe(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    hit = np.ones(len(h), bool)
    for shift in (0, 21, 42):
        bit = (h >> np.uint64(shift)) & np.uint64(FILTER_BITS - 1)
        hit &= (filter_[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return hit


def _fingerprints(texts: DataFrame, keys: list[str], only: np.ndarray | None, short: list[int] | None, header: bool) -> DataFrame:
    """Rows (keys, n_words, size, gram, at, around); with `header` also a row of size zero for each text.

    As items (`short` is None) rows of 1 to 12 words give their own single window; as documents they give every run
    of each length in `short`. `size` is 13 for winnowed k-grams, else the length of the run.
    """
    fields = [f"{k} {texts.schema[k].dataType.simpleString()}" for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            words = split(batch.column(len(keys)), ALNUM)
            h = words.hashes()
            counts = words.counts
            found = [(SPAN, *winnowed(words, h))]
            if short is None:
                for n in np.unique(counts[(counts > 0) & (counts < SPAN)]).tolist():
                    at = words.first[:-1][counts == n]
                    found.append((n, at, gram_hashes(h, n)[at]))
            else:
                for n in short:
                    at = np.flatnonzero(_inside(words, n))
                    found.append((n, at, gram_hashes(h, n)[at]))
            if only is not None:
                found = [(n, at[hit], g[hit]) for n, at, g in found for hit in [_probe(only, g)]]
            size = np.concatenate([np.full(len(at), n, np.int32) for n, at, _ in found])
            at = np.concatenate([x[1] for x in found])
            gram = np.concatenate([x[2] for x in found]).view(np.int64)
            row = words.row[at]
            around = _binary_rows(_around(words, h, at))
            within = at - words.first[row]
            if header:
                n = len(counts)
                row = np.concatenate([np.arange(n), row])
                # Size zero meets nothing; the text's hash as its gram deals these rows out evenly.
                size = np.concatenate([np.zeros(n, np.int32), size])
                gram = np.concatenate([np.asarray(batch.column(0).field("h")), gram])
                within = np.concatenate([np.zeros(n, np.int64), within])
                around = pa.concat_arrays([pa.nulls(n, around.type), around])
            taken = [batch.column(i).take(pa.array(row)) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(counts[row].astype(np.int64)), *map(pa.array, (size, gram, within)), around], [*keys, "n_words", "size", "gram", "at", "around"])

    return mapped(texts, run, ", ".join([*fields, "n_words long, size int, gram long, at long, around binary"]))


def _filter(items: DataFrame) -> tuple[np.ndarray, list[int]]:
    """The Bloom filter of the items' fingerprints, of fixed size, and the lengths of short items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, sizes = np.zeros(FILTER_BITS, bool), set()
        for batch in batches:
            h = np.asarray(batch.column(1)).view(np.uint64)
            for shift in (0, 21, 42):
                bits[(h >> np.uint64(shift)) & np.uint64(FILTER_BITS - 1)] = True
            sizes |= set(batch.column(0).to_pylist())
        if sizes:
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits, bitorder="little").tobytes()]), pa.array([sorted(sizes)], pa.list_(pa.int32()))], ["bits", "sizes"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, sizes = np.zeros(FILTER_BITS // 8, np.uint8), set()
        for batch in batches:
            for b, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                bits |= np.frombuffer(b, np.uint8)
                sizes |= set(s)
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()]), pa.array([sorted(sizes)], pa.list_(pa.int32()))], ["bits", "sizes"])

    # Partial filters are merged in two steps, so the last task reads MERGED of them at most.
    kind = "bits binary, sizes array<int>"
    got = mapped(mapped(mapped(items.select("size", "gram"), run, kind).repartition(MERGED), merged, kind).repartition(1), merged, kind).collect()
    bits, sizes = (np.frombuffer(got[0][0], np.uint8), got[0][1]) if got else (np.zeros(FILTER_BITS // 8, np.uint8), [])
    return bits, [n for n in sizes if n < SPAN]


def _extended(met: DataFrame) -> DataFrame:
    """(row_key, item, n_words, from, to): words [from, to) of the document that occur as a window of the item; from is null in rows without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            has = np.flatnonzero(np.asarray(table["other"].is_valid()))
            start, end = np.full(batch.num_rows, -1), np.full(batch.num_rows, -1)
            if len(has):
                a, b = (np.frombuffer(b"".join(table[k].take(pa.array(has)).to_pylist()), np.uint64).reshape(len(has), -1) for k in ("around", "other"))
                same = (a == b) & (a != 0)
                size = np.asarray(table["size"].take(pa.array(has)))
                at = np.asarray(table["at"].take(pa.array(has)))
                left = np.cumprod(same[:, :REACH][:, ::-1], axis=1).sum(1)
                right = np.cumprod(same[:, REACH:], axis=1).sum(1)
                whole = (size == SPAN) & (right >= GRAM) & (left + right >= SPAN)
                # A run of a short item is compared over its own length.
                brief = (size < SPAN) & (right >= size)
                start[has] = np.where(whole, at - left, np.where(brief, at, -1))
                end[has] = np.where(whole, at + right, np.where(brief, at + size, -1))
            none = start < 0
            item = pa.array(np.where(none, None, np.array(table["item_id"].to_pylist(), object)), table["item_id"].type)
            yield pa.RecordBatch.from_arrays([table["row_key"], table["n_words"], table["size"], item, *(pa.array(x, pa.int64(), mask=none) for x in (start, end))], ["row_key", "n_words", "size", "item", "from", "to"])

    kinds = {f.name: f.dataType.simpleString() for f in met.schema.fields}
    return mapped(met, run, f"row_key {kinds['row_key']}, n_words long, size int, item {kinds['item_id']}, `from` long, `to` long")


def _merged(rows: DataFrame) -> DataFrame:
    """`rows` with `spans`, the union of their sorted `runs`, and the words in them, `n_hit`."""
    place = rows.columns.index("runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column(place)
            sizes = np.asarray(runs.value_lengths().fill_null(0))
            row = np.repeat(np.arange(len(sizes)), sizes)
            flat = runs.flatten()
            start, end = (np.asarray(flat.field(k), np.int64) for k in (0, 1))
            # Rows are set apart by more than any of them holds, so one running maximum serves all.
            far = row * (int(end.max(initial=0)) + 1)
            top = np.maximum.accumulate(end + far) if len(end) else end
            new = np.ones(len(start), bool)
            new[1:] = (start[1:] + far[1:] > top[:-1]) | (row[1:] != row[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(start)) - 1 if len(first) else first
            a, b, owner = start[first], top[last] - far[last], row[first]
            bounds = np.searchsorted(owner, np.arange(len(sizes) + 1))
            spans = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(a), pa.array(b)], ["from", "to"]))
            hit = np.bincount(owner, b - a, len(sizes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, spans, pa.array(hit)], [*batch.schema.names, "spans", "n_hit"])

    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return mapped(rows, run, f"{own}, spans array<struct<`from`:bigint,to:bigint>>, n_hit long")


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """(key, n_words, n_hit, spans, items): hit words, their merged spans [from, to) in words and the distinct items met.

    Rows with equal keys and equal texts share a result and are each returned. Null and empty texts have no words
    and no hits. An item without words meets nothing; repeated items count by their distinct ids, a null id being
    left out of `items` while its words still count as hit. A document row is one result row; other columns are not read.
    """
    grams = _fingerprints(items.select(F.col(item_key).alias("item_id"), F.col("text").cast("string").alias("text")), ["item_id"], None, None, False)
    bits, short = _filter(grams)
    keyed = docs.select(F.struct(F.col(key).alias("k"), F.xxhash64("text").alias("h")).alias("row_key"), F.col("text").cast("string").alias("text"))
    mine = _fingerprints(keyed, ["row_key"], bits, short, True)
    # One row for each distinct neighbourhood and item: a gram that repeats inside an item at the same surroundings meets once.
    others = grams.select("item_id", "size", "gram", F.col("around").alias("other")).distinct()
    met = mine.join(others, ["size", "gram"], "left").select("row_key", "n_words", "size", "at", "around", "item_id", "other")
    hits = _extended(met)
    per_row = hits.groupBy("row_key").agg(
        F.max("n_words").alias("n_words"),
        F.count(F.when(F.col("size") == 0, 1)).alias("copies"),
        F.sort_array(F.collect_set(F.when(F.col("from").isNotNull(), F.struct("from", "to")))).alias("runs"),
        F.sort_array(F.collect_set("item")).alias("items"),
    )
    out = _merged(per_row).select(F.col("row_key.k").alias(key), "n_words", "n_hit", "spans", "items", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return out.drop("copy")
