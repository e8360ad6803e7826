"""A trigram language model in sharded Elias-Fano tries.

Texts are taken in batches. A batch sends each of its distinct words and trigrams once, with its training count, to the shard
that the word, or the trigram's first two words, fall in; n-grams of texts that are only scored go along with a count of zero. A shard sums up the
counts of all batches, builds its trie of contexts (two words) and successors, and answers each batch in the batch's own
order: exact counts of words, and quantised values of contexts and successors. Batch and answers meet again, and the texts are scored.
So no table of n-grams is ever in one place, and a hot word or pair is one entry a batch, however often it occurs.

With c a training count, d the discount, L the weight of pairs, n(uv) the successors seen after uv, N all tokens, V the
distinct ones and V1 those seen once:

    p(w | uv) = max(c(uvw) - d, 0) / c(uv) + d n(uv) / c(uv) p(w | v)       and p(w | v) where uv is new
    p(w | v)  = L c(vw) / c(v) + (1 - L) p(w)                               and p(w) where v is new
    p(w)      = (c(w) - V1 / V) / N, and V1 / N together for all words that training lacks (as one more type)

Text that is only scored is mostly new, which is why the discount is high and the weight of pairs is low.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import chunks, mixed, split
from .columns import mapped
from .eliasfano import Trie
from .store import written

DISCOUNT = 0.8
PAIRS = 0.1
#: Of the base score: added to every count.
ALPHA = 0.1
#: Bounds of V1 / V, for training sets too small to tell.
ONCE = (0.05, 0.95)
#: Tokens of a batch at least, but for the last of a task; and training tokens of a shard on average.
BATCH_TOKENS = 1 << 20
SHARD_TOKENS = 1 << 20
START, END, PAD = (int(x) for x in mixed(np.arange(101, 104, dtype=np.uint64)))
CONTEXT_BITS = 48
#: Quantised values are steps of log10, 65535 standing for none.
STEP = 1 / 4096
NONE = 65535
#: log10 of the least value: counts reach from 1 to nearly 1e16, probabilities from little over 1e-16 to 1.
COUNTS, SHARES = 0.0, -(NONE - 1) * STEP
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)


def _packed(*arrays: tuple[np.ndarray, int]) -> bytes:
    """Byte planes of unsigned arrays, `width` bytes each, behind their lengths."""
    head = np.array([len(arrays), *(n for a, width in arrays for n in (len(a), width))], np.uint32).tobytes()
    planes = [np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes() for a, width in arrays]
    return zstandard.compress(head + b"".join(planes), 1)


def _unpacked(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    shape = np.frombuffer(raw, np.uint32, 2 * n, 4).reshape(n, 2).tolist()
    at, out = 4 + 8 * n, []
    for size, width in shape:
        full = np.zeros((size, 8), np.uint8)
        full[:, :width] = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size).T
        out.append(full.view(np.uint64).ravel())
        at += size * width
    return out


def _ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, the most frequent first, and the place of each value among them: mostly small, so that few bytes of it tell."""
    distinct, at, times = np.unique(values, return_inverse=True, return_counts=True)
    order = np.argsort(-times, kind="stable")
    rank = np.empty(len(order), np.uint64)
    rank[order] = np.arange(len(order), dtype=np.uint64)
    return distinct[order], rank[at]


def _quantised(p: np.ndarray, least: float) -> np.ndarray:
    """Codes of positive numbers, from `least` in log10 on and sixteen decades up; NONE for zero."""
    with np.errstate(divide="ignore"):
        code = np.rint((np.log10(p) - least) / STEP)
    return np.where(p > 0, np.clip(code, 0, NONE - 1), NONE).astype(np.uint16)


def _value(code: np.ndarray, least: float) -> np.ndarray:
    return np.where(code == NONE, 0.0, 10.0 ** (code * STEP + least))


class Batch:
    """Token hashes of some texts, END after each, and their distinct words and trigrams in the order in which shards see them."""

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray, held: np.ndarray):
        self.tokens, self.sizes, self.held = tokens, sizes, held
        n = len(tokens)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        one = np.concatenate([[np.uint64(START)], tokens[:-1]])
        one[starts] = START
        two = np.concatenate([[np.uint64(START)], one[:-1]])
        two[starts] = START
        # Behind each END one more trigram tells the context (last word, END).
        self.previous = one
        u, v, w = np.concatenate([two, tokens[ends - 2] if n else one[:0]]), np.concatenate([one, tokens[ends - 1]]), np.concatenate([tokens, np.full(len(ends), PAD, np.uint64)])
        u[n:] = np.where(sizes > 1, u[n:], np.uint64(START))
        trained = np.repeat(~held, sizes)
        trained = np.concatenate([trained, ~held])
        context = mixed(u * _PAIR + v) >> np.uint64(64 - CONTEXT_BITS)
        follow = w >> np.uint64(32)
        del u, v, w, two
        order = np.lexsort((follow, context)).astype(np.int32)
        c, f = context[order], follow[order]
        del context, follow
        new_c = np.concatenate([[True], c[1:] != c[:-1]])
        new = new_c | np.concatenate([[True], f[1:] != f[:-1]])
        rank = (np.cumsum(new) - 1).astype(np.int32)
        self.trigram = np.empty(len(order), np.int32)
        self.trigram[order] = rank
        self.contexts = c[new_c]
        self.follow = f[new]
        self.pointers = np.append(np.flatnonzero(new_c[new]), len(self.follow))
        self.counts = np.bincount(rank, trained[order], len(self.follow)).astype(np.uint64)
        self.context_of = (np.cumsum(new_c[new]) - 1).astype(np.int32)
        # The context (v, w) that begins at a token's predecessor is that of the trigram one place on.
        after = np.arange(1, n + 1, dtype=np.int32)
        after[ends - 1] = n + np.arange(len(ends))
        self.next = after
        self.words, self.word = np.unique(tokens, return_inverse=True)
        self.word_counts = np.bincount(self.word, trained[:n], len(self.words)).astype(np.uint64)

    def pieces(self, shards: int) -> Iterator[tuple[int, slice, slice]]:
        """(shard, slice of the words, slice of the contexts) of each shard that this batch needs; hashes rise, and shards are ranges of them."""
        w = (self.words >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
        c = (self.contexts >> np.uint64(CONTEXT_BITS - 32)) * np.uint64(shards) >> np.uint64(32)
        edges = np.arange(shards + 1, dtype=np.uint64)
        a, b = np.searchsorted(w, edges), np.searchsorted(c, edges)
        for s in np.flatnonzero((np.diff(a) > 0) | (np.diff(b) > 0)).tolist():
            yield s, slice(a[s], a[s + 1]), slice(b[s], b[s + 1])


def _stored(tokens: list[np.ndarray], sizes: list[np.ndarray], held: list[np.ndarray]) -> bytes:
    words, at = _ranked(np.concatenate(tokens))
    return _packed((words, 8), (at, 4), (np.concatenate(sizes).astype(np.uint64), 4), (np.concatenate(held).astype(np.uint64), 1))


def _batch(blob: bytes) -> Batch:
    words, at, sizes, held = _unpacked(blob)
    return Batch(words[at.astype(np.int64)], sizes.astype(np.int64), held.astype(bool))


def tokenised(docs: DataFrame, key: str, text: str, held_out: Column, batch_tokens: int) -> DataFrame:
    """(batch, keys, blob, n_docs, n_tokens): texts in batches; n_docs and n_tokens count the training texts."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(key).alias("key"), F.coalesce(held_out, F.lit(False)).alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, sizes, held, keys = [], [], [], []

        def done() -> pa.RecordBatch:
            size, out = np.concatenate(sizes), np.concatenate(held)
            values = pa.concat_arrays(keys)
            own = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            return pa.RecordBatch.from_arrays([own, pa.array([_stored(tokens, sizes, held)]), pa.array([int((~out).sum())]), pa.array([int(size[~out].sum())])], ["keys", "blob", "n_docs", "n_tokens"])

        for batch in chunks(batches, "text"):
            words = split(batch.column(0))
            counts = words.counts + 1
            full = np.full(int(counts.sum()), END, np.uint64)
            full[np.arange(len(words.row)) + words.row] = words.hashes()
            tokens.append(full)
            sizes.append(counts)
            held.append(np.array(batch.column(2).to_pylist(), bool))
            keys.append(batch.column(1))
            if sum(map(len, tokens)) >= batch_tokens:
                yield done()
                tokens, sizes, held, keys = [], [], [], []
        if tokens:
            yield done()

    made = mapped(rows, run, f"keys array<{kind}>, blob binary, n_docs long, n_tokens long")
    return written(made.withColumn("batch", F.monotonically_increasing_id()), "lm-batches")


def _asked(batches: DataFrame, shards: int) -> DataFrame:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows:
            for number, blob in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                b = _batch(blob)
                out: tuple[list, list, list] = ([], [], [])
                for s, w, c in b.pieces(shards):
                    ctx, p = b.contexts[c], b.pointers[c.start : c.stop + 1]
                    own = slice(p[0], p[-1]) if len(ctx) else slice(0, 0)
                    steps = [np.diff(x, prepend=x[:1] * 0) for x in (b.words[w], ctx)]
                    out[0].append(s)
                    out[1].append(number)
                    out[2].append(_packed((steps[0], 8), (b.word_counts[w], 5), (steps[1], 6), (np.diff(p) if len(ctx) else ctx, 4), (b.follow[own], 4), (b.counts[own], 5)))
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["shard", "batch", "blob"])

    return mapped(batches.select("batch", "blob"), run, "shard int, batch long, blob binary")


class Shard:
    """Counts of one shard over all batches, and its trie."""

    def __init__(self, blobs: list[bytes]):
        parts = [self.read(b) for b in blobs]
        words, counts = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        self.words, at = np.unique(words, return_inverse=True)
        self.counts = np.bincount(at, counts, len(self.words)).astype(np.uint64)
        context = np.concatenate([np.repeat(p[2], p[3]) for p in parts])
        follow, counts = (np.concatenate([p[i] for p in parts]) for i in (4, 5))
        seen = counts > 0
        context, follow, counts = context[seen], follow[seen], counts[seen]
        order = np.lexsort((follow, context))
        c, f = context[order], follow[order]
        new_c = np.concatenate([[True], c[1:] != c[:-1]]) if len(c) else np.zeros(0, bool)
        new = new_c | np.concatenate([[True], f[1:] != f[:-1]]) if len(c) else new_c
        count = np.bincount(np.cumsum(new) - 1, counts[order], int(new.sum())) if len(c) else np.zeros(0)
        pointers = np.append(np.flatnonzero(new_c[new]), len(count))
        sizes = np.diff(pointers)
        total = np.add.reduceat(count, pointers[:-1]) if len(sizes) else np.zeros(0)
        values = np.stack([_quantised(total, COUNTS), _quantised(DISCOUNT * sizes / np.maximum(total, 1), SHARES)], 1)
        share = _quantised((count - DISCOUNT) / np.repeat(total, sizes), SHARES)
        self.trie = Trie(c[new_c], pointers, f[new], values, share)

    @staticmethod
    def read(blob: bytes) -> list[np.ndarray]:
        words, counts, contexts, sizes, follow, times = _unpacked(blob)
        return [np.cumsum(words, dtype=np.uint64), counts, np.cumsum(contexts, dtype=np.uint64), sizes.astype(np.int64), follow, times]

    def answer(self, blob: bytes) -> bytes:
        words, _, contexts, sizes, follow, _ = self.read(blob)
        at = self.trie.find_contexts(contexts)
        values = self.trie.context_values.reshape(-1, 2)
        found = np.where((at >= 0)[:, None], values[at], NONE) if len(values) else np.full((len(at), 2), NONE)
        place = self.trie.find_successors(np.repeat(at, sizes), follow)
        share = np.where(place >= 0, self.trie.successor_values[place], NONE) if self.trie.successors.n else np.full(len(place), NONE)
        pairs, shares = _ranked(found[:, 0].astype(np.uint32) << 16 | found[:, 1].astype(np.uint32)), _ranked(share)
        return _packed((self.counts[np.searchsorted(self.words, words)], 5), (pairs[0], 4), (pairs[1], 4), (shares[0], 2), (shares[1], 4))

    @staticmethod
    def answered(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Counts of the words, codes of the contexts' totals and of the mass that they spare, and of the trigrams' shares."""
        counts, pairs, at, shares, place = _unpacked(blob)
        pair = pairs[at.astype(np.int64)]
        return counts, pair >> np.uint64(16), pair & np.uint64(0xFFFF), shares[place.astype(np.int64)]


def _answered(asked: DataFrame, shards: int) -> DataFrame:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []

        def done() -> pa.RecordBatch:
            shard = Shard([b for _, _, b in held])
            kinds, once = int((shard.counts > 0).sum()), int((shard.counts == 1).sum())
            return pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in held], pa.int32()), pa.array([n for _, n, _ in held], pa.int64()), pa.array([shard.answer(b) for _, _, b in held], pa.binary()), *(pa.array([x] * len(held), pa.int64()) for x in (kinds, once))], ["shard", "batch", "blob", "kinds", "once"])

        for part in rows:
            for row in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                if held and held[0][0] != row[0]:
                    yield done()
                    held = []
                held.append(row)
        if held:
            yield done()

    return mapped(asked.repartition(shards, "shard").sortWithinPartitions("shard"), run, "shard int, batch long, blob binary, kinds long, once long")


def scored(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row, learning from those that are not held out.

    A null text is empty and has its end as its only token; a null `held_out` is false. Without training texts all
    counts are zero and every word is the one unknown type. Rows with equal keys each get a row and each count in
    training. Other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    batches = tokenised(docs, key, text, held_out, batch_tokens)
    trained = batches.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count("*")).first()
    n_docs, n_tokens = int(trained[0]), int(trained[1])
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_tokens // SHARD_TOKENS + 1)
    answers = written(_answered(_asked(batches, shards), shards), "lm-answers", clean=True)
    by_shard = answers.groupBy("shard").agg(F.max("kinds").alias("k"), F.max("once").alias("o"))
    n_kinds, n_once = map(int, by_shard.agg(F.coalesce(F.sum("k"), F.lit(0)), F.coalesce(F.sum("o"), F.lit(0))).first())
    floor = n_tokens + ALPHA * (n_kinds + 1)
    off = min(max(n_once / max(n_kinds, 1), ONCE[0]), ONCE[1])
    unknown = off * n_kinds / n_tokens if n_tokens else 1.0

    def score(keys: pa.Array, blob: bytes, parts: list[bytes]) -> pa.RecordBatch:
        b = _batch(blob)
        got = [np.concatenate(x) for x in zip(*map(Shard.answered, parts), strict=True)]
        count = got[0].astype(np.int64)[b.word]
        total, spare, share = (_value(x.astype(np.int64), least) for x, least in zip(got[1:], (COUNTS, SHARES, SHARES), strict=True))
        n = len(b.tokens)
        base = (count + ALPHA) / floor
        p1 = np.where(count > 0, (count - off) / max(n_tokens, 1), unknown)
        before = np.concatenate([[0], count[:-1]])
        before[b.previous == np.uint64(START)] = n_docs
        pair = total[b.context_of[b.trigram[b.next]]]
        p2 = np.where(before > 0, PAIRS * pair / np.maximum(before, 1) + (1 - PAIRS) * p1, p1)
        ctx = b.context_of[b.trigram[:n]]
        known = total[ctx] > 0
        p3 = np.where(known, share[b.trigram[:n]] + spare[ctx] * p2, p2)
        edges = np.cumsum(b.sizes) - b.sizes
        sums = lambda x: np.add.reduceat(x, edges)
        columns = [keys, pa.array(b.held), pa.array(b.sizes), pa.array(sums((count > 0).astype(np.int64))), pa.array(np.full(len(edges), n_tokens)), pa.array(sums(np.log10(base))), pa.array(sums(np.log10(np.minimum(p3, 1.0))))]
        return pa.RecordBatch.from_arrays(columns, ["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, blob, parts, number = None, None, [], None
        for part in rows:
            for i, (at, shard, own) in enumerate(zip(*(part.column(k).to_pylist() for k in (0, 1, 3)), strict=True)):
                if at != number:
                    if number is not None:
                        yield score(keys, blob, parts)
                    number, parts = at, []
                if shard < 0:
                    keys, blob = part.column(2)[i].values, own
                else:
                    parts.append(own)
        if number is not None:
            yield score(keys, blob, parts)

    both = batches.select("batch", F.lit(-1).alias("shard"), "keys", "blob").unionByName(answers.select("batch", "shard", F.lit(None).cast(f"array<{kind}>").alias("keys"), "blob"))
    meet = both.repartition("batch").sortWithinPartitions("batch", "shard")
    return mapped(meet, run, f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("key", key)
