import math
import os
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliate.llm import ngramlm, store


def brute(rows):
    seq = {i: [*(w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())), "END"] for i, (_, t, _) in enumerate(rows)}
    train = [seq[i] for i, (_, _, h) in enumerate(rows) if not h]
    one = Counter(w for s in train for w in s)
    n, v = sum(one.values()), len(one)
    off = min(max(sum(c == 1 for c in one.values()) / v, 0.05), 0.95)
    two, three = Counter(), Counter()
    for s in train:
        p = ["S", "S", *s, "PAD"]
        two.update(zip(p[1:-1], p[2:-1], strict=False))
        three.update(zip(p, p[1:], p[2:], strict=False))
    ctx, kinds = Counter(), Counter()
    for (a, b, _), c in three.items():
        ctx[a, b] += c
        kinds[a, b] += 1
    one["S"] = len(train)
    out = []
    for i, (key, _, h) in enumerate(rows):
        p = ["S", "S", *seq[i]]
        base = score = 0
        for a, b, w in zip(p, p[1:], p[2:], strict=False):
            p0 = (one[w] + 0.1) / (n + 0.1 * (v + 1))
            p1 = (one[w] - off) / n if one[w] else off * v / n
            p2 = p1 if not one[b] else ngramlm.PAIRS * two[b, w] / one[b] + (1 - ngramlm.PAIRS) * p1
            p3 = p2 if not ctx[a, b] else (max(three[a, b, w] - ngramlm.DISCOUNT, 0) + ngramlm.DISCOUNT * kinds[a, b] * p2) / ctx[a, b]
            base, score = base + math.log10(p0), score + math.log10(p3)
        out.append((key, h, len(seq[i]), sum(one[w] > 0 for w in seq[i]), n, base, score))
    return sorted(out, key=lambda r: r[0])


@pytest.mark.parametrize("tokens", [40, 1 << 20])
def test_scores_match_brute_force(spark, tokens):
    rnd = random.Random(6)
    vocab = ["The", "the", "é", "a.", *(f"w{i}" for i in range(20))]
    rows = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([0, 1, 2, 9, 60]))), i % 7 == 3) for i in range(60)]
    rows += [(100, None, False), (101, "", True), (102, " \n", False), (103, "never seen before", True), (104, rows[5][1], False), (105, "x y " * 3000, False)]
    docs = spark.createDataFrame([(k, t, h, "s") for k, t, h in rows], "doc_id long, text string, h boolean, shard string").repartition(3)
    got = sorted((tuple(r) for r in ngramlm.scored(docs, F.col("h"), batch_tokens=tokens).collect()), key=lambda r: r[0])
    want = brute(rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and abs(g[6] - w[6]) <= ngramlm.STEP * w[2]  # the bound of the quantisation


def test_no_rows_and_no_training(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string")
    assert ngramlm.scored(docs.limit(0), F.lit(True)).count() == 0
    got = ngramlm.scored(docs, F.lit(True)).collect()
    assert len(got) == 2 and all(r.n_known == 0 and r.train_tokens == 0 and r.n_tokens == 3 for r in got)


def _shuffled(spark):
    """Bytes of the shuffle files that executors keep, by name."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    paths = (files.apply(i).getPath() for i in range(files.size()))
    return {p: os.path.getsize(p) for p in paths if re.search(r"shuffle_.*\.data$", p) and os.path.exists(p)}


def test_the_questions_to_shards_are_deleted_once_answered(spark):
    rnd = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(f"w{rnd.randrange(5000)}" for _ in range(200))) for i in range(200)], "doc_id long, text string")
    before, setting = _shuffled(spark), spark.conf.get(store.CLEANUP)
    found = ngramlm.scored(docs, F.col("doc_id") % 9 == 0, batch_tokens=4000)
    for _ in range(50):
        left = sum(size for path, size in _shuffled(spark).items() if path not in before)
        if left < 20_000:
            break
        time.sleep(0.2)
    assert left < 20_000  # the questions take more than 300,000, the sums of counts a few thousand
    assert spark.conf.get(store.CLEANUP) == setting
    assert found.count() == 200 and found.count() == 200


def test_written_rows_can_be_made_again_after_cleaning(spark):
    made = spark.range(1000).repartition(3, "id")
    assert made.count() == 1000
    assert store.written(made, "again", clean=True).count() == store.written(made, "again", clean=True).count() == made.count() == 1000


def test_frequent_words_of_a_stored_batch_come_first():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    tokens = words[np.minimum(rng.zipf(1.3, 50_000) - 1, len(words) - 1)]
    sizes, held = np.full(10, 5000), np.arange(10) % 3 == 0
    blob = ngramlm._stored([tokens[:20_000], tokens[20_000:]], [sizes[:4], sizes[4:]], [held[:4], held[4:]])
    kept, at, _, _ = ngramlm._unpacked(blob)
    times = np.bincount(at.astype(np.int64), minlength=len(kept))
    assert (np.diff(times) <= 0).all()
    batch = ngramlm._batch(blob)
    assert (batch.tokens == tokens).all() and (batch.sizes == sizes).all() and (batch.held == held).all()


def test_answers_number_their_codes_by_frequency_and_lose_none():
    rng = np.random.default_rng(4)
    n = 20_000
    contexts = np.unique(rng.integers(0, 1 << 48, n, dtype=np.uint64))
    n = len(contexts)
    sizes, counts = np.minimum(rng.zipf(2.0, n), 50), rng.zipf(2.0, n)
    counts[rng.random(n) < 0.3] = 0
    follow = np.concatenate([np.sort(rng.choice(1 << 20, k, replace=False)) for k in sizes]).astype(np.uint64)
    times = np.repeat(counts, sizes).astype(np.uint64)
    words = np.arange(1, 100, dtype=np.uint64)
    blob = ngramlm._packed((np.diff(words, prepend=words[:1] * 0), 8), (words - np.uint64(1), 5), (np.diff(contexts, prepend=contexts[:1] * 0), 6), (sizes, 4), (follow, 4), (times, 5))
    shard = ngramlm.Shard([blob])
    answer = shard.answer(blob)
    known, total, spare, share = ngramlm.Shard.answered(answer)
    assert (known == words - np.uint64(1)).all()
    sums = counts * sizes
    divided = lambda a, b: np.divide(a, b, out=np.zeros(len(b)), where=b > 0)
    assert (total == ngramlm._quantised(sums, ngramlm.COUNTS)).all()
    assert (spare == ngramlm._quantised(divided(ngramlm.DISCOUNT * sizes * (sums > 0), sums), ngramlm.SHARES)).all()
    each = np.repeat(sums, sizes)
    assert (share == ngramlm._quantised(divided((times - ngramlm.DISCOUNT) * (times > 0), each), ngramlm.SHARES)).all()
    assert len(answer) < 0.8 * len(ngramlm._packed((known, 5), (total, 2), (spare, 2), (share, 2)))
    nothing = ngramlm._packed(*((words[:0], width) for width in (8, 5, 6, 4, 4, 5)))
    assert [len(x) for x in ngramlm.Shard.answered(ngramlm.Shard([nothing]).answer(nothing))] == [0, 0, 0, 0]
