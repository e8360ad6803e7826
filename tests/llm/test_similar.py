import random

import numpy as np

import corpus_pipeline
from foliate.llm import similar


def sets(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(x, y):
    return len(x & y) / len(x | y)


def test_stage_drops_copies_of_four_fifths(spark):
    rnd = random.Random(5)
    text = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    docs, wide = {}, []
    for i in range(60):
        base = text(rnd.choice([60, 200, 400]))
        docs[i] = " ".join(base)
        for k in range(3):
            copy = list(base)
            for _ in range(max(1, round(len(base) * rnd.choice([0.004, 0.01, 0.02, 0.04])))):
                copy[rnd.randrange(len(copy))] = "edited"
            docs[1000 + 3 * i + k] = " ".join(copy)
    docs |= {5000: "", 5001: None, 5002: "one two", 5003: "One  two", 5004: "one three"}
    label, own = {k: k for k in docs}, {k: sets(t) for k, t in docs.items()}
    for a in sorted(docs):
        for b in sorted(docs):
            if a < b and jaccard(own[a], own[b]) >= 0.8:
                wide.append(jaccard(own[a], own[b]))
                x, y = sorted((label[a], label[b]))
                label = {k: x if v == y else v for k, v in label.items()}
    assert sum(0.8 <= j < 0.95 for j in wide) > 50
    table = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert {r.doc_id for r in corpus_pipeline.one_of_each(spark, table, "").collect()} == set(label.values())


def test_links_need_four_fifths(spark):
    words = [f"w{i}" for i in range(104)]
    edit = lambda at: " ".join("x" if i in at else w for i, w in enumerate(words))
    docs = [(1, " ".join(words)), (2, edit({20, 80})), (3, edit({20, 21, 22, 80, 81, 82}))]
    a, b, c = (sets(t) for _, t in docs)
    assert jaccard(a, b) >= 0.8 > max(jaccard(a, c), jaccard(b, c))
    assert sorted(tuple(r) for r in similar.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()) == [(1, 1), (2, 1), (3, 3)]


def test_empty_table(spark):
    assert similar.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_index_finds_what_all_pairs_find(monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (60, 64), np.uint8)
    signs = np.repeat(base, 12, axis=0)
    for row in signs[::2]:  # the others are farther from each other, or share few bytes
        for at in rng.integers(0, 64, 9):
            row[at] ^= 1 << rng.integers(8)
    for row in signs[1::4]:
        row ^= (rng.random(64) < 0.9).astype(np.uint8)
    signs = np.concatenate([signs, rng.integers(0, 256, (300, 64), np.uint8)])
    signs = np.unique(signs[rng.permutation(len(signs))].view(np.uint64).reshape(-1, 8), axis=0)
    a, b = np.triu_indices(len(signs), 1)
    x = signs[a] ^ signs[b]
    shared = x.view(np.uint8).reshape(-1, 8, 8) == 0
    near = (shared.sum((1, 2)) >= similar.MIN_BYTES) & (np.bitwise_count(x).sum(1) <= similar.RADIUS) & (np.bitwise_count(x[:, :2]).sum(1) <= similar.RADIUS_2)
    met = near & (shared.sum(2) >= 2).any(1)
    assert met.sum() > 500 and (near & (shared.sum((1, 2)) >= 9)).sum() <= met.sum()

    def classes(edges):
        label = np.arange(len(signs))
        for u, v in edges:
            x, y = sorted((label[u], label[v]))
            label[label == y] = x
        return label.tolist()

    # Rows of the index in the order of their slots, as a task reads them.
    slot = (similar._LISTED << 8 | signs.view(np.uint8).reshape(-1, 64)[:, similar._LISTED]).ravel()
    own = np.repeat(np.arange(len(signs)), len(similar._LISTED))
    order = np.argsort(slot, kind="stable")
    for dense in (similar.DENSE, 2):
        monkeypatch.setattr(similar, "DENSE", dense)
        texts, least = similar._linked(slot[order], own[order], signs[own[order]])
        assert classes(zip(texts, least, strict=True)) == classes(zip(a[met], b[met], strict=True))
        assert len(texts) == len(signs) - len(set(classes(zip(a[met], b[met], strict=True))))


def test_fingerprints_follow_the_majority():
    sets = [[5], [1, 2, 3, 4], list(range(1, 600)), []]
    at = np.cumsum([0, *map(len, sets)])
    got = similar.fingerprints(np.array([v for s in sets for v in s], np.uint64), at)
    for row, values in zip(got, sets, strict=True):
        for w, seed in enumerate(similar._SEEDS):
            h = similar.mixed(np.array(values, np.uint64) ^ seed)
            for bit in range(64):
                vote = int(similar._VOTE[64 * w + bit])
                twice = 2 * (int((h >> np.uint64(bit) & np.uint64(1)).sum()) + vote)
                assert int(row[w]) >> bit & 1 == (twice > len(values) + 1 or twice == len(values) + 1 and similar._TIE[64 * w + bit])


def test_simhash_index_misses_no_link_of_four_fifths(spark):
    rnd = random.Random(9)
    docs, pairs = [], 0
    for i in range(1500):  # sizes from eight words on: the smallest sets that can be near another
        words = [f"w{rnd.randrange(10**7)}" for _ in range(rnd.choice([8, 9, 12, 30, 60, 150]))]
        copy = words + ["more"] if len(words) < 20 else list(words)
        while len(words) >= 20 and jaccard(sets(" ".join(words)), sets(" ".join(copy))) > 0.87:
            copy[rnd.randrange(len(copy))] = "edited"
        if jaccard(sets(" ".join(words)), sets(" ".join(copy))) >= 0.8:
            docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
            pairs += 1
    assert pairs > 900
    rows = similar.prints(spark.createDataFrame(docs, "key long, text string")).cache()
    of = {r.fp: r.key for r in rows.collect()}
    assert {tuple(sorted((of[e.u], of[e.v]))) for e in similar.linked(rows).collect()} == {(2 * i, 2 * i + 1) for i in {k // 2 for k, _ in docs}}
    assert len(docs) == 2 * pairs
