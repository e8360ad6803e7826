import random
import re

from foliate.llm import decontam


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = []
    for key, text in docs:
        w, hit, met = words(text), set(), set()
        for item, t in items:
            v = words(t)
            n = min(13, len(v))
            runs = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
            at = [i for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in runs] if n else []
            hit |= {i + j for i in at for j in range(n)}
            met |= {item} if at else set()
        out.append((key, len(w), len(hit), sorted(met)))
    return sorted(out)


def test_contaminated_matches_brute_force(spark):
    rnd = random.Random(5)
    vocab = [f"W{i}" for i in range(60)] + ["Été", "x9", "the"]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([1, 2, 5, 12, 13, 14, 30, 60])))) for i in range(30)]
    items += [(3, items[3][1]), (77, items[4][1]), (78, ""), (79, None), (80, "a a a a a a a a a a a a a a a a"), (81, "b b")]
    docs = []
    for i in range(80):
        w = [rnd.choice(vocab) for _ in range(rnd.choice([0, 3, 12, 50, 200]))]
        for _ in range(rnd.choice([0, 1, 3])):
            v = words(rnd.choice(items)[1])
            s = rnd.randrange(len(v)) if v else 0
            w[rnd.randrange(len(w) + 1) :][:0] = []
            at = rnd.randrange(len(w) + 1)
            w[at:at] = v[s : s + rnd.choice([5, 12, 13, 14, 99])]
        docs.append((i, rnd.choice([" ", ", ", "\n"]).join(w)))
    docs += [(500, None), (501, ""), (502, "a " * 40), (503, docs[5][1]), (503, docs[5][1]), (504, "... !!"), (505, "a " * 20000 + items[6][1])]
    df = spark.createDataFrame([(k, t, 1, 1) for k, t in docs], "doc_id long, text string, size int, item_id int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontam.contaminated(df, bench).collect())
    assert got == brute(docs, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:3] for r in decontam.contaminated(docs, none).collect()] == [(1, 3, 0)]
    assert decontam.contaminated(docs.limit(0), none).count() == 0
