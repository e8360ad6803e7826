"""Token ids as ORC files: integer run-length encoding, row indexes, and Bloom filters on the document id.

Rows are dealt out by ranges of the id and sorted, so each file and stripe holds a narrow range: readers take stripes in
parallel and skip those whose statistics or Bloom filters exclude an id.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytetext import chunks
from .columns import mapped
from .piececache import LONG, CachedEncoder, Pieces, code_points, pieces
from .store import new_path, written

END = 0
STRIPE_BYTES = 64 << 20
ROWS_PER_INDEX = 1000
#: Threads of the library in one Python worker.
THREADS = 2
#: Characters whose classes have long been settled. The split pattern is run here by another library than the
#: tokenizer's; where a text has other characters, on which Unicode versions may differ, the tokenizer gets it whole.
SETTLED = ((0x0, 0x558), (0x2000, 0x2065), (0x20A0, 0x20BE), (0x3041, 0x3097), (0x30A1, 0x30FB), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4))
LETTER, DIGIT, OTHER, BLANK, WHITE, UNSETTLED = range(6)


_UNSETTLED = regex.compile(f"[^{''.join(f'{chr(a)}-{chr(b - 1)}' for a, b in SETTLED)}]")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 ones for themselves, the rest from U+0100 on."""
    own = {b for r in ((0x21, 0x7F), (0xA1, 0xAD), (0xAE, 0x100)) for b in range(*r)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point in the split pattern; the last entry stands for all beyond."""
    out = np.full(0x10000, UNSETTLED, np.uint8)
    for lo, hi in SETTLED:
        for c in range(lo, hi):
            x = chr(c)
            out[c] = BLANK if x == " " else WHITE if regex.match(r"\s", x) else LETTER if regex.match(r"\p{L}", x) else DIGIT if regex.match(r"\p{N}", x) else OTHER
    return out


def begins(codes: np.ndarray, kind: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the pieces of the split pattern begin: runs of letters, digits, others, each with the blank before it; white space; English endings."""
    n = len(codes)
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    space = np.minimum(kind, WHITE) >= BLANK
    run = np.where(space, BLANK, kind)
    new = first[:n].copy()
    new[1:] |= run[1:] != run[:-1]
    last = first[1:].copy()
    last[:-1] |= run[1:] != run[:-1]
    # The last of several white characters stands alone before a word; a blank, also as the only one, goes to that word.
    closing = space & last & ~first[1:]
    taken = closing & (kind == BLANK)
    out = new | closing
    behind = np.zeros(n, bool)
    behind[1:] = taken[:-1]
    out &= ~behind
    quote = np.flatnonzero((codes == 0x27) & new & last & ~behind)
    quote = quote[quote + 1 < n]
    quote = quote[~first[quote + 1]]
    one = codes[quote + 1]
    # Beyond the text's end stands a character that no ending holds.
    two = np.where((quote + 2 < n) & ~first[np.minimum(quote + 2, n)], codes[np.minimum(quote + 2, n - 1)], 0)
    size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
    for a, b in ("re", "ve", "ll"):
        size[(one == ord(a)) & (two == ord(b))] = 2
    hit = size > 0
    out[quote[hit] + 1] = False
    after = quote[hit] + 1 + size[hit]
    out[after[after < n]] = True
    return out


class ByteLevel:
    """Encoder of a byte-level BPE file of the tokenizers library. Merges stay inside the pieces of its split pattern, so each distinct piece goes through the library once."""

    def __init__(self, path: str, end: int | None = END):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = byte_letters()
        #: A text that holds one of these is taken whole, as the library finds them before it splits.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.encode = CachedEncoder(self._cut, self._new, end)

    def _cut(self, texts: list[str]) -> Pieces:
        joined, codes, bounds = code_points(texts)
        table = classes()
        kind = table[np.minimum(codes, len(table) - 1)]
        begin = begins(codes, kind, bounds) if len(codes) else np.zeros(0, bool)
        whole = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(kind == UNSETTLED)])[bounds])).tolist()
        if any(a in joined for a in self.added):
            whole += [r for r, t in enumerate(texts) if any(a in t for a in self.added)]
        for r in whole:
            begin[bounds[r] + 1 : bounds[r + 1]] = False
        return pieces(joined, codes, bounds, begin)

    def _new(self, names: list[str]) -> tuple[list[list[int]], np.ndarray]:
        """Ids of new pieces: short ones by the library's model alone, as they need no splitting; whole texts by the tokenizer."""
        whole = [k for k, x in enumerate(names) if len(x) > LONG or _UNSETTLED.search(x) or any(a in x for a in self.added)]
        got = dict(zip(whole, self.tokenizer.encode_batch_fast([names[k] for k in whole], add_special_tokens=False), strict=True))
        tokenize = self.tokenizer.model.tokenize
        ids = [got[k].ids if k in got else [t.id for t in tokenize(x.encode().decode("latin-1").translate(self.letters))] for k, x in enumerate(names)]
        return ids, np.ones(len(names), bool)


@lru_cache(maxsize=1)
def shared(path: str, end: int | None) -> ByteLevel:
    """One encoder for all tasks of a Python worker, so that later tasks find the pieces of earlier ones."""
    return ByteLevel(path, end)


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end: int | None = END) -> DataFrame:
    """(key, ids, at): the ids of each whole text and the end id, and the row's place in its partition; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = shared(path, end), 0
        for batch in chunks(batches, "text"):
            flat, sizes, _ = encoder.encode(batch.column(1).to_pylist())
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat.view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(np.arange(before, before + batch.num_rows))], ["key", "ids", "at"])
            before += batch.num_rows

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return mapped(rows, run, f"key {kind}, ids array<int>, at long").withColumnRenamed("key", key)


def saved(docs: DataFrame, path: str, to: str, key: str = "doc_id", text: str = "text") -> str:
    """Write the ids of all texts to ORC files in `to`, in ascending order of the key (null first) over files `part` = 0, 1, ...

    The texts are dealt out by ranges of the key before they are encoded, so each is encoded once. Equal keys go
    together, in the order of their texts, which `at` numbers within each file's range.
    """
    rows = docs.select(F.col(key).alias(key), F.col(text).cast("string").alias("text")).repartitionByRange(F.col(key)).sortWithinPartitions(key, "text")
    tokens = encoded(rows, path, key, "text").withColumn("part", F.spark_partition_id())
    (
        tokens.write.option("orc.bloom.filter.columns", key)
        .option("orc.bloom.filter.fpp", 0.01)
        .option("orc.row.index.stride", ROWS_PER_INDEX)
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.create.index", "true")
        .option("compression", "zstd")
        .orc(to)
    )
    return to


def loaded(spark: SparkSession, at: str, keys: list | None = None, key: str = "doc_id") -> DataFrame:
    """Rows (key, ids, at, part) of the files; with `keys`, only these, found by statistics and Bloom filters."""
    rows = spark.read.orc(at)
    return rows if keys is None else rows.where(F.col(key).isin(keys))


def summed_up(spark: SparkSession, at: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) read from the files: the ids before each row in the files' order, and its own.

    `start` is a running sum within each file, plus the totals of the files before it, of which there is one row each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1)
            values = ids.values.cast(pa.uint32(), safe=False)
            raw = memoryview(np.asarray(values).astype("<u4", copy=False)).cast("B")
            bounds = ids.offsets.to_pylist()
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(np.diff(bounds), pa.int64()), pa.array(crc, pa.int64())], ["key", "at", "part", "n_tokens", "ids_crc32"])

    rows = loaded(spark, at, None, key).select(F.col(key).alias("key"), "ids", "at", "part")
    sums = written(mapped(rows, run, f"key {rows.schema['key'].dataType.simpleString()}, at long, part int, n_tokens long, ids_crc32 long"), "token-sums")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = sums.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    within = sums.withColumn("within", F.coalesce(F.sum("n_tokens").over(own), F.lit(0)))
    return within.join(totals, "part").select(F.col("key").alias(key), (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def stored(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the ids of all texts to new files in the shared folder and sum them up."""
    spark = docs.sparkSession
    return summed_up(spark, saved(docs, path, new_path(spark, "token-ids"), key, text), key)
