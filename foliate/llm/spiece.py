"""SentencePiece models run by the tokenizers library.

The model file's protobuf is read here; from it the normaliser, the metaspace marker, the vocabulary with its scores and the byte
fallback are rebuilt. Unigram models keep their scores. BPE models get the merges that their scores imply: every pair of pieces
whose joining is a piece, best score first.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import appended
from .piececache import CachedEncoder, Pieces, code_points, pieces

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Threads of the library in one Python worker.
THREADS = 2
#: New pieces that the library gets in one string.
JOINED = 64


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message: varints as int, all else as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = buf[at]
            at += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return value

    while at < len(buf):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}[kind] if kind != 2 else varint()
        yield tag >> 3, buf[at : at + size]
        at += size


@dataclass
class Model:
    pieces: list[tuple[str, float, int]]
    kind: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)


def parsed(buf: bytes) -> Model:
    pieces, trainer, normal = [], {}, {}
    for number, value in _fields(buf):
        if number == 1:
            own = dict(_fields(value))
            pieces.append((own[1].decode(), struct.unpack("<f", own.get(2, bytes(4)))[0], own.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normal = dict(_fields(value))
    return Model(pieces, trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), normal.get(2, b""), bool(normal.get(3, 1)), bool(normal.get(4, 1)))


def merges(model: Model) -> list[tuple[str, str]]:
    """Pairs in the order in which the scores join them; of equal scores the longer left side goes first, as the leftmost symbol has grown longest."""
    score = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER)}
    found = []
    for piece, s in score.items():
        for i in range(1, len(piece)):
            if piece[:i] in score and piece[i:] in score:
                found.append((-s, -i, piece[:i], piece[i:]))
    found.sort()
    return [(a, b) for _, _, a, b in found]


def _base(model: Model):
    from tokenizers import Tokenizer, decoders, models

    if model.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocab, merges(model), unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    elif model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unknown, model.byte_fallback)
    else:
        raise ValueError(f"model type {model.kind} is neither unigram nor BPE")
    out = Tokenizer(core)
    steps = [decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse()]
    out.decoder = decoders.Sequence([*steps, decoders.Strip(" ", 1, 0)] if model.dummy_prefix else steps)
    return out


def normaliser(model: Model):
    """Text to what the model's pieces are matched with: its character map, blanks as it treats them, and the metaspace marker."""
    from tokenizers import normalizers

    mapped = normalizers.Precompiled(model.charsmap) if model.charsmap else None

    def run(text: str) -> str:
        if mapped is not None:
            text = mapped.normalize_str(text)
        if model.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (SPACE if model.dummy_prefix else "") + text.replace(" ", SPACE)

    return run


class Codec:
    """Encoder and decoder of one model. `encode` flags the pieces that decode to themselves."""

    def __init__(self, buf: bytes, threads: int = THREADS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.model = parsed(buf)
        self.tokenizer = _base(self.model)
        self.normal = normaliser(self.model)
        # Words are independent unless a piece holds the marker behind another character.
        self.apart = not any(SPACE in p.lstrip(SPACE) for p, _, kind in self.model.pieces if kind in (NORMAL, USER))
        self.spelling = [p if kind in (NORMAL, USER) else "" for p, _, kind in self.model.pieces]
        self.marked = [p.startswith(SPACE) for p in self.spelling]
        self.encode = CachedEncoder(self._cut, self._new)

    def _cut(self, texts: list[str]) -> Pieces:
        joined, codes, bounds = code_points([self.normal(t) for t in texts])
        begins = np.zeros(len(codes), bool)
        if self.apart:
            marker = codes == ord(SPACE)
            begins[1:] = marker[1:] & ~marker[:-1]
        return pieces(joined, codes, bounds, begins)

    def _new(self, names: list[str]) -> tuple[list[list[int]], np.ndarray]:
        """Ids of new pieces, and whether they decode to them. Pieces with one marker, in front, go in rows of JOINED: each has the ids from one marker to the next."""
        found: dict[int, list[int]] = {}
        if self.apart:
            single = [k for k, x in enumerate(names) if x[0] == SPACE and x.count(SPACE) == 1]
            rows = [single[k : k + JOINED] for k in range(0, len(single), JOINED)]
            for row, got in zip(rows, self.tokenizer.encode_batch_fast(["".join([names[k] for k in r]) for r in rows], add_special_tokens=False), strict=True):
                ids = got.ids
                cuts = [i for i, x in enumerate(ids) if self.marked[x]]
                if len(cuts) == len(row) and cuts[0] == 0:
                    found.update((k, ids[a:b]) for k, a, b in zip(row, cuts, [*cuts[1:], len(ids)], strict=True))
        left = [k for k in range(len(names)) if k not in found]
        found.update(zip(left, [e.ids for e in self.tokenizer.encode_batch_fast([names[k] for k in left], add_special_tokens=False)], strict=True))
        out = [found[k] for k in range(len(names))]
        good = np.array(["".join([self.spelling[i] for i in ids]) == name for ids, name in zip(out, names, strict=True)], bool)
        # Bytes and unknown characters are spelled by the library alone.
        other = np.flatnonzero(~good).tolist()
        good[other] = [back == self.plain(names[k]) for k, back in zip(other, self.decode([out[k] for k in other]), strict=True)]
        return out, good

    def plain(self, normal: str) -> str:
        """What the ids of a normalised text should decode to."""
        out = normal.replace(SPACE, " ")
        return out[1:] if self.model.dummy_prefix and out.startswith(" ") else out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoded(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text", decode: bool = False, check: bool = False) -> DataFrame:
    """(key, ids, n_tokens, ids_crc32[, decoded][, round_trip]): each whole text's ids; null and empty texts have none.

    `model` is the file's content, sent with the plan: a vocabulary has a fixed size. `decoded` is the text made from the
    ids again, `round_trip` whether it is the text as the model normalises it. Rows with equal keys each get a row; other
    columns are not read.
    """

    def make():
        codec = Codec(model)

        def work(column: pa.Array) -> list[pa.Array]:
            texts = column.to_pylist()
            flat, sizes, good = codec.encode(texts)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            raw = flat.astype("<u4", copy=False).tobytes()
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int32)))
            out = [ids, pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())]
            if decode:
                out.append(pa.array(codec.decode(ids.to_pylist()), pa.string()))
            if check:
                # Pieces that decode to themselves make up a text that does; only texts with others are decoded whole.
                for r in np.flatnonzero(~good).tolist():
                    good[r] = codec.decode([flat[ends[r] : ends[r + 1]].tolist()])[0] == codec.plain(codec.normal(texts[r] or ""))
                out.append(pa.array(good))
            return out

        return work

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = "ids array<int>, n_tokens long, ids_crc32 long" + ", decoded string" * decode + ", round_trip boolean" * check
    return appended(rows, "text", make, schema, 1 << 20).drop("text").withColumnRenamed("key", key)
