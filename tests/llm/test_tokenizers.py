import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from foliate.llm import spiece, store, tokenfile

BPE_FILE = str(public_tokenizers.path("byte_bpe_50k.json"))
PIECE_FILE = str(public_tokenizers.path("piece_bpe_32k.model"))
ODD = [" ", "  ", " " * 17, " " * 33, "\n", "\t", "a", "the", "'s", "don't", "#", "é", "𝄞", "<|endoftext|>", "<s>", "</s>", "<0x41>", "▁", "日本", "1", "٣", "²", " ", "\x85", "ß", "Ա՘"]


def texts(seed, n=300):
    rnd = random.Random(seed)
    made = ["".join(rnd.choice(ODD) for _ in range(rnd.randrange(20))) for _ in range(n)]
    return [None, "", " ", "x" * 5000, "word " * 40000, *made]


def per_text(flat, sizes, _=None):
    bounds = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    flat = flat.tolist()
    return [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _field(number, value):
    def varint(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def unigram_model():
    """A small unigram model with byte fallback, written field by field."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256))]
    pieces += [(p, -1.0 - k / 7, 1) for k, p in enumerate(["▁", "▁a", "▁th", "e", "the", "▁the", "a", "b", "ab", "▁ab", "n", "d", "and", "s", "t", "h"])]
    out = b"".join(_field(1, _field(1, p.encode()) + _field(2, s) + _field(3, k)) for p, s, k in pieces)
    return out + _field(2, _field(3, 1) + _field(35, 1) + _field(40, 0) + _field(41, 1) + _field(42, 2)) + _field(3, _field(1, b"identity") + _field(3, 1) + _field(4, 1))


def test_pieces_match_the_sentencepiece_library():
    buf = spiece.model_bytes(PIECE_FILE)
    mine, theirs = spiece.Codec(buf), sentencepiece.SentencePieceProcessor(model_proto=buf)
    rows = texts(1)
    got = per_text(*mine.encode(rows))
    assert got == theirs.encode([t or "" for t in rows])
    assert mine.decode(got) == [theirs.decode(x) for x in got]


def test_unigram_scores_and_fallback():
    buf = unigram_model()
    mine, theirs = spiece.Codec(buf), sentencepiece.SentencePieceProcessor(model_proto=buf)
    rnd = random.Random(4)
    rows = ["", "the ab and", *("".join(rnd.choice("abthe nds éz") for _ in range(rnd.randrange(1, 40))) for _ in range(300))]
    assert per_text(*mine.encode(rows)) == theirs.encode(rows)


def test_whole_texts_match_the_tokenizers_library(monkeypatch):
    mine = tokenfile.ByteLevel(BPE_FILE, None)
    mine.encode.cached = 50
    rows = texts(2)
    reference = Tokenizer.from_file(BPE_FILE)
    want = [e.ids for e in reference.encode_batch([t or "" for t in rows], add_special_tokens=False)]
    assert [x for i in range(0, len(rows), 40) for x in per_text(*mine.encode(rows[i : i + 40]))] == want


def test_pieces_are_those_of_the_split_pattern():
    rnd = random.Random(5)
    mine, reference = tokenfile.ByteLevel(BPE_FILE, None), Tokenizer.from_file(BPE_FILE)
    rows = ["".join(rnd.choice("ab'stremlvd  \n\t1٣é_-.! ⅷ²\x1c") for _ in range(rnd.randrange(40))) for _ in range(5000)]
    assert per_text(*mine.encode(rows)) == [e.ids for e in reference.encode_batch(rows, add_special_tokens=False)]


def test_long_pieces_are_not_kept():
    mine = tokenfile.ByteLevel(BPE_FILE, None)
    mine.encode(["क" * 21_000, "x" * 500, "a b c"])
    assert len(mine.encode.keys) == 3


def test_repeated_ids_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", [5], 2, "k"), (1, "c", None, None, None), (None, None, None, 1, "x")], "doc_id long, text string, ids array<int>, n_tokens int, key string")
    got = spiece.encoded(docs, spiece.model_bytes(PIECE_FILE), check=True).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.round_trip) for r in got) == [(0, 0, True), (1, 1, True), (1, 2, True)]


def test_files_hold_ids_in_key_order(spark):
    rows = [((i * 37) % 400, t) for i, t in enumerate(texts(3))] + [(-5, t) for t in ("a b", "a b", "c", "", "longer than any of these", None)] + [(None, "z")]
    docs = spark.createDataFrame([(k, t, 1, "p") for k, t in rows], "doc_id long, text string, ids int, part string").repartition(5)
    at = tokenfile.saved(docs, BPE_FILE, store.new_path(spark, "ids"))
    got = tokenfile.summed_up(spark, at).collect()
    reference = Tokenizer.from_file(BPE_FILE)
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    # The order of `start` is that of the files, also among rows that share a key.
    files = tokenfile.loaded(spark, at).orderBy("part", "at").collect()
    assert [(r.doc_id, len(r.ids)) for r in files] == [(r.doc_id, r.n_tokens) for r in sorted(got, key=lambda r: r.start)]
    ids = lambda t: [*reference.encode(t or "", add_special_tokens=False).ids, 0]
    crc = lambda x: zlib.crc32(struct.pack(f"<{len(x)}I", *x))
    by_key = lambda x: (x[0] is not None, x[0] or 0)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=lambda x: (by_key(x), x[1:])) == sorted(((k, len(ids(t)), crc(ids(t))) for k, t in rows), key=lambda x: (by_key(x), x[1:]))
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [k for k, _ in sorted(rows, key=by_key)]
    assert tokenfile.loaded(spark, at, [-5]).count() == 6


@pytest.mark.parametrize("schema", ["doc_id long, text string"])
def test_empty_tables(spark, schema):
    none = spark.createDataFrame([], schema)
    assert tokenfile.stored(none, BPE_FILE).count() == 0
    assert spiece.encoded(none, spiece.model_bytes(PIECE_FILE), check=True).count() == 0


def test_round_trips(spark):
    docs = spark.createDataFrame(list(enumerate(t for t in texts(6) if not t or "▁" not in t)), "doc_id long, text string")
    assert all(r.round_trip for r in spiece.encoded(docs, spiece.model_bytes(PIECE_FILE), check=True).collect())
    one = spiece.encoded(docs.where("doc_id = 4"), spiece.model_bytes(PIECE_FILE), decode=True).first()
    assert one.decoded == "word " * 40000 and one.n_tokens == len(one.ids)
