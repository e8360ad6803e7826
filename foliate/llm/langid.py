"""Language identification by hyperdimensional n-gram profiles.

Every letter has a fixed random vector of +1 and -1. An n-gram's vector binds (multiplies) the vectors of its letters, each
rotated by its place; a text's vector bundles (adds) the vectors of its n-grams, and a language's prototype bundles
its texts, each at unit length. A text takes the language whose prototype has the greatest cosine with its vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import chunks
from .columns import mapped

DIM = 1024
GRAM = 3
UNKNOWN = "und"
CHUNK_BYTES = 128 << 10
#: n-gram vectors kept between chunks; beyond this the cache starts anew, so memory does not grow with the text.
CACHED = 40_000
#: n-grams whose vectors are multiplied at once.
BLOCK = 8192


def held_out(key: Column, parts: int, remainder: int) -> Column:
    """Whether crc32 of the key as text leaves `remainder`; a null key is never held out."""
    return F.coalesce(F.crc32(key.cast("string")) % parts == remainder, F.lit(False))


class Encoder:
    """n-gram counts and vectors of texts. Letters are what Unicode calls alphabetic, in lower case; all else is one blank between words."""

    _alpha: np.ndarray | None = None

    def __init__(self, dim: int = DIM):
        self.dim = dim
        if Encoder._alpha is None:
            Encoder._alpha = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        self.letters: dict[int, np.ndarray] = {}
        self._reset()

    def _reset(self) -> None:
        self.slot: dict[int, int] = {}
        self.vectors = np.zeros((1024, self.dim), np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) > CACHED:
                self.letters.clear()
            bits = np.random.Generator(np.random.PCG64([20240, code])).integers(0, 2, self.dim, np.int8)
            self.letters[code] = 2 * bits - 1
        return self.letters[code]

    def vectors_of(self, grams: np.ndarray) -> np.ndarray:
        """Rows of +1 and -1 for packed n-grams (21 bits a letter)."""
        if len(self.slot) + len(grams) > CACHED:
            self._reset()
        where = np.empty(len(grams), np.int64)
        for k, g in enumerate(grams.tolist()):
            if g not in self.slot:
                at = len(self.slot)
                if at == len(self.vectors):
                    self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
                bound = np.ones(self.dim, np.int8)
                for place in range(GRAM):
                    bound *= np.roll(self.letter(g >> 21 * place & 0x1FFFFF), place)
                self.vectors[at] = bound
                self.slot[g] = at
            where[k] = self.slot[g]
        return self.vectors[where]

    def bundled(self, weights: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """`weights` times the vectors of the n-grams, a block of these at a time, so that a text of many distinct ones takes no more memory."""
        out = np.zeros((len(weights), self.dim), np.float32)
        for k in range(0, len(grams), BLOCK):
            out += weights[:, k : k + BLOCK] @ self.vectors_of(grams[k : k + BLOCK]).astype(np.float32)
        return out

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams of the texts, and a row of counts for each text."""
        lowered = [f" {t.lower()} " if t else "  " for t in texts]
        codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        row = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
        alpha = self._alpha[codes]
        keep = alpha.copy()
        keep[0] = True
        keep[1:] |= ~alpha[1:] & (alpha[:-1] | (row[1:] != row[:-1]))
        letters = np.where(alpha, codes, 0x20)[keep].astype(np.int64)
        row = row[keep]
        m = len(letters) - GRAM + 1
        inner = (row[:m] == row[GRAM - 1 :]) & (letters[1 : m + 1] != 0x20)
        packed = sum(letters[j : j + m][inner] << 21 * (GRAM - 1 - j) for j in range(GRAM))
        grams, at = np.unique(packed, return_inverse=True)
        table = np.bincount(row[:m][inner] * len(grams) + at, minlength=len(texts) * len(grams))
        return grams, table.reshape(len(texts), len(grams)).astype(np.float32)


def trained(docs: DataFrame, text: str = "text", lang: str = "lang", dim: int = DIM) -> dict[str, np.ndarray]:
    """The unit prototype of each language; rows without a language are skipped.

    What reaches the driver is one vector for each language. The sums run over every row given.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sums = Encoder(dim), {}
        for batch in chunks(batches, "text", CHUNK_BYTES):
            grams, table = encoder.counts(batch.column(0).to_pylist())
            if not len(grams):
                continue
            table /= np.maximum(np.sqrt((table**2).sum(1, keepdims=True)), 1)
            langs = batch.column(1).to_pylist()
            names = sorted(set(langs))
            weights = np.array([[x == n for x in langs] for n in names], np.float32) @ table
            for name, vector in zip(names, encoder.bundled(weights, grams), strict=True):
                sums[name] = sums.get(name, 0) + vector.astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()])], ["lang", "v"])

    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    parts = mapped(rows, run, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x"))
    sums = parts.groupBy("lang", "i").agg(F.sum("x").alias("x"))
    found: dict[str, np.ndarray] = {}
    for r in sums.collect():
        found.setdefault(r.lang, np.zeros(dim))[r.i] = r.x
    return {k: v / np.linalg.norm(v) for k, v in sorted(found.items()) if np.linalg.norm(v) > 0}


def identified(docs: DataFrame, prototypes: dict[str, np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score): the language of the whole text and its cosine, from 0 to 1.

    Null and empty texts, texts without a letter, and every text when there is no prototype give `und` with score 0. Of equal
    cosines the first language by name wins. Rows with equal keys each get a row; other columns are not read.
    """
    names = list(prototypes)
    matrix = np.array([prototypes[n] for n in names], np.float32)
    dim = matrix.shape[1] if names else DIM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(dim)
        for batch in chunks(batches, "text", CHUNK_BYTES):
            grams, table = encoder.counts(batch.column(1).to_pylist())
            best, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            if len(grams) and names:
                vectors = encoder.bundled(table, grams)
                norm = np.linalg.norm(vectors, axis=1)
                cosine = vectors @ matrix.T / np.maximum(norm, 1e-9)[:, None]
                top = cosine.argmax(1)
                some = table.sum(1) > 0
                best = [names[k] if ok else UNKNOWN for k, ok in zip(top.tolist(), some.tolist(), strict=True)]
                score = np.where(some, np.clip(cosine[np.arange(len(top)), top], 0, 1), 0).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best), pa.array(score)], ["key", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return mapped(rows, run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)


def predicted(docs: DataFrame, learn_from: Callable[[DataFrame], DataFrame], key: str = "doc_id") -> DataFrame:
    """Prototypes from `learn_from(docs)`, applied to all of `docs`."""
    return identified(docs, trained(learn_from(docs)), key)
