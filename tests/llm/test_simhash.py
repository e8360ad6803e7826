import random
import re

import xxhash

from foliate.llm import simhash


def brute(rows):
    def fp(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
        return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [fp(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {x: min(rows[i][0] for i in range(len(rows)) if label[i] == x) for x in set(label)}
    return sorted((rows[i][0], prints[i], least[label[i]]) for i in range(len(rows)))


def test_near_duplicates_match_brute_force(spark):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(400)] + ["Ä", "été", "THE"]
    rows = []
    for i in range(60):
        base = [rnd.choice(words) for _ in range(rnd.choice([1, 2, 3, 40, 300]))]
        for _ in range(rnd.choice([1, 1, 2, 5])):
            copy = list(base)
            if rnd.random() < 0.7:
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append((1000 - len(rows), rnd.choice([" ", "\n", "  "]).join(copy)))
    rows += [(5001, None), (5002, ""), (5003, " \t\n"), (5004, "one"), (5004, "one"), (5005, "x " * 30000)]
    docs = spark.createDataFrame([(k, t, "z", "z") for k, t in rows], "doc_id long, text string, fp string, component string")
    got = sorted((r[0], r[1] & (1 << 64) - 1, r[2]) for r in simhash.near_duplicates(docs).collect())
    assert got == brute(rows)


def test_dense_posting_lists_keep_every_link(monkeypatch):
    import numpy as np

    monkeypatch.setattr(simhash, "DENSE", 8)
    rnd = random.Random(3)
    centre = rnd.getrandbits(64)
    fps = np.unique(np.array([centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(5))) for _ in range(200)], np.uint64))
    label = np.arange(len(fps))
    for mask in simhash.TRIPLES:
        part = fps & np.uint64(mask)
        order = np.argsort(part, kind="stable")
        for i, j in simhash._links(part[order], fps[order], mask):
            a, b = label[order[i]], label[order[j]]
            label[label == max(a, b)] = min(a, b)
    want = np.arange(len(fps))
    for i in range(len(fps)):
        for j in range(i):
            if int(fps[i] ^ fps[j]).bit_count() <= 3:
                want[want == max(want[i], want[j])] = min(want[i], want[j])
    assert (label == want).all()


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
