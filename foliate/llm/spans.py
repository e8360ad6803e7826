"""Removal of passages that repeat across documents, by sliding spans of sentences.

A span is a run of consecutive sentences: from each sentence on, the shortest run of two sentences or more with at least 20 words,
and likewise the shortest run that ends with it. So a passage of two sentences and 20 words or more that two documents
share is covered by spans that lie inside it, whatever stands around it. A single sentence of 40 words or more is a span too. Spans
are compared by the hash of their words over all documents. Of equal spans the first stays, by key and place; sentences covered
by any other are removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import SPACED, chunks, mixed, split
from .columns import fresh, mapped
from .store import written

MIN_SENTENCES = 2
MIN_WORDS = 20
LONE_WORDS = 40
#: Sentences of more words are cut after the word of least hash in each window of WINDOW words, so that text without punctuation has
#: spans too: of 50 shared words the first cut is among the first 12, and a span of 20 to 31 words follows, whatever stands around.
MAX_SENTENCE = 49
WINDOW = 12
_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".!?"]] = True
#: Full stops of other scripts, by their last three bytes or two.
_WIDE_STOPS = np.array([int.from_bytes(c.encode()) for c in "。！？｡।॥።။។"])
_TWO_BYTE_STOPS = np.array([int.from_bytes(c.encode()) for c in "؟۔։"])
_CLOSERS = np.zeros(256, bool)
_CLOSERS[[ord(c) for c in "\"')]}*_"]] = True
_FACTOR = 0x9FB21C651E98DF25
_INVERSE = pow(_FACTOR, -1, 1 << 64)


@dataclass
class Sentences:
    """Sentences of a chunk of rows: words [first[i], first[i + 1]) of the chunk, in row `row[i]`; bytes from `start[i]`; `at[r]` is row r's first sentence."""

    row: np.ndarray
    at: np.ndarray
    words: np.ndarray
    start: np.ndarray
    offsets: np.ndarray
    prefix: np.ndarray
    inverse: np.ndarray

    def hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the words of sentences [a, b), from sums of word hashes times rising powers, wherever they stand."""
        lo, hi = self.words[a], self.words[b]
        return mixed((self.prefix[hi] - self.prefix[lo]) * self.inverse[lo] + (hi - lo).astype(np.uint64))


def sentences(column: pa.Array) -> Sentences:
    words = split(column, SPACED)
    n = len(words.starts)
    h = words.hashes()
    last = words.ends - 1
    # Closing quotes and brackets after a full stop belong to the sentence.
    for _ in range(2):
        inner = (last > words.starts) & _CLOSERS[words.data[last]] if n else np.zeros(0, bool)
        last = last - inner
    stop = _STOPS[words.data[last]] if n else np.zeros(0, bool)
    high = np.flatnonzero((words.data[last] >= 0x80) & (last - words.starts >= 1)) if n else np.zeros(0, np.int64)
    two = words.data[last[high] - 1].astype(np.int64) << 8 | words.data[last[high]]
    three = np.where(last[high] - words.starts[high] >= 2, words.data[np.maximum(last[high] - 2, 0)].astype(np.int64) << 16, 0) | two
    stop[high] = np.isin(two, _TWO_BYTE_STOPS) | np.isin(three, _WIDE_STOPS)
    newline = np.concatenate([[0], np.cumsum(words.data == 0x0A)])
    after = np.append(words.starts[1:], len(words.data))
    end = stop | (newline[np.minimum(after, len(words.data))] > newline[words.ends])
    end[words.first[1:][words.counts > 0] - 1] = True
    bounds = np.flatnonzero(end) + 1
    size = np.diff(bounds, prepend=0)
    window = np.flatnonzero(np.repeat(size > MAX_SENTENCE, size) & (np.repeat(bounds, size) - np.arange(n) >= WINDOW))
    least, cut = h[window], window.copy()
    for k in range(1, WINDOW):
        lower = h[window + k] <= least
        least[lower] = h[window[lower] + k]
        cut[lower] = window[lower] + k
    end[cut] = True
    edges = np.concatenate([[0], np.flatnonzero(end) + 1]) if n else np.zeros(1, np.int64)
    row = words.row[edges[:-1]]
    up, inverse = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)])) for x in (_FACTOR, _INVERSE))
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:n])])
    return Sentences(row, np.searchsorted(row, np.arange(len(words.counts) + 1)), edges, words.starts[edges[:-1]], words.offsets, prefix, inverse)


def runs(s: Sentences) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the spans of all rows, as sentence numbers of the chunk; none crosses rows, none repeats."""
    n = len(s.row)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i = np.arange(n)
    begin, close = s.at[s.row], s.at[s.row + 1]
    ahead = np.maximum(np.searchsorted(s.words, s.words[i] + MIN_WORDS), i + MIN_SENTENCES)
    back = np.minimum(np.searchsorted(s.words, s.words[i + 1] - MIN_WORDS, "right") - 1, i + 1 - MIN_SENTENCES)
    lone = s.words[i + 1] - s.words[i] >= LONE_WORDS
    f, b = ahead <= close, back >= begin
    both = np.unique(np.concatenate([i[f] * (n + 1) + ahead[f], back[b] * (n + 1) + i[b] + 1, i[lone] * (n + 1) + i[lone] + 1]))
    return both // (n + 1), both % (n + 1)


def spans(docs: DataFrame) -> DataFrame:
    """(h, key, part, at) of every span of `docs(key, part, text)`: hash, and first and end sentence of the row packed into `at`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            s = sentences(batch.column(2))
            a, b = runs(s)
            row = s.row[a]
            packed = (a - s.at[row]) << 32 | (b - s.at[row])
            own = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(s.hashes(a, b).view(np.int64)), batch.column(0).take(own), batch.column(1).take(own), pa.array(packed)], ["h", "key", "part", "at"])

    return mapped(docs, run, f"h long, key {docs.schema['key'].dataType.simpleString()}, part int, at long")


def _cut(text: bytes, s: Sentences, r: int, gone: np.ndarray) -> str:
    """The row's text without the sentences in `gone`; white space stays with the sentence before it."""
    lo, hi = s.at[r], s.at[r + 1]
    base = s.offsets[r]
    edges = np.append(s.start[lo:hi] - base, len(text)).tolist()
    edges[0] = 0
    kept = b"".join(text[edges[k] : edges[k + 1]] for k in np.flatnonzero(~gone).tolist())
    return kept.decode("utf-8", "surrogatepass").strip()


ADDED = ("_sentences", "_removed_count", "_removed")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", added: tuple[str, str, str] = ADDED) -> DataFrame:
    """`docs` with `text` freed of repeated spans, and three columns more, named by `added`: how many sentences the text had, how many are removed, and their numbers.

    All columns are kept, whatever their names; only those in `added` must be new. Null texts stay null.
    Repeats inside one document count too. Rows with the same key and text are one document: they are changed alike, and each
    is returned. A null key counts as the least. Texts without a repeated span stay as they are, byte for byte; the others
    are trimmed of white space at their ends. An empty table gives an empty one.
    """
    if clash := {c.lower() for c in added} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns are there already: {sorted(clash)}")
    own_key, own_part, marks_name = (fresh(c, [*docs.columns, *added]) for c in ("_key", "_part", "_gone"))
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.hash(f"`{text}`").alias("part"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    found = spans(rows)
    first = found.groupBy("h").agg(F.min(F.struct("key", "part", "at")).alias("first"), F.max(F.struct("key", "part", "at")).alias("last"))
    # Spans found once are the bulk; a span twice in equal rows only has the same least and greatest place.
    repeated = written(first.where(~F.col("first").eqNullSafe(F.col("last"))).select("h", "first"), "repeated-spans")
    # A span that a third of all documents hold is one key of this join; adaptive execution splits it.
    later = found.join(repeated, "h").where(~F.struct("key", "part", "at").eqNullSafe(F.col("first")))
    gone = written(later.groupBy("key", "part").agg(F.collect_set("at").alias("gone")), "removed-spans")
    gone = gone.select(F.col("key").alias(own_key), F.col("part").alias(own_part), F.col("gone").alias(marks_name))
    joined = docs.join(gone, docs[key].eqNullSafe(gone[own_key]) & (F.hash(docs[text]) == gone[own_part]), "left").select(docs["*"], gone[marks_name])
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            column = batch.column(place)
            s = sentences(column)
            out, removed = [], []
            for r, (t, marks) in enumerate(zip(column.to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)):
                hit = np.zeros(s.at[r + 1] - s.at[r], bool)
                for m in marks or ():
                    hit[m >> 32 : m & 0xFFFFFFFF] = True
                out.append(_cut(t.encode("utf-8", "surrogatepass"), s, r, hit) if hit.any() else t)
                removed.append(np.flatnonzero(hit).tolist())
            columns = [*(batch.column(i) for i in range(batch.num_columns - 1))]
            columns[place] = pa.array(out, pa.string())
            columns += [pa.array(np.diff(s.at), pa.int64()), pa.array([len(x) for x in removed], pa.int64()), pa.array(removed, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], *added])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return mapped(joined, run, f"{schema}, `{added[0]}` long, `{added[1]}` long, `{added[2]}` array<long>")
