import random
import re

from foliate.llm import spans


def cut(text):
    """Sentences as (words, text up to the next one)."""
    found, at = [], 0
    tokens = list(re.finditer(r"[^\x20\x09-\x0D]+", text))
    own = []
    for i, m in enumerate(tokens):
        own.append(m)
        until = tokens[i + 1].start() if i + 1 < len(tokens) else len(text)
        bare = m[0]
        for _ in range(2):
            if len(bare) > 1 and bare[-1] in "\"')]}*_":
                bare = bare[:-1]
        if bare[-1] in ".!?" or "\n" in text[m.end() : until] or i + 1 == len(tokens):
            found.append(([x[0].encode().lower() for x in own], text[at:until]))
            own, at = [], until
    return found


def brute(docs):
    cuts = [(key, cut(text or "")) for key, text in docs]
    places = {}
    for d, (key, s) in enumerate(cuts):
        for i in range(len(s)):
            ends = [e for e in range(i + 2, len(s) + 1) if sum(len(x[0]) for x in s[i:e]) >= 20]
            own = {(i, ends[0])} if ends else set()
            begins = [b for b in range(i - 1, -1, -1) if sum(len(x[0]) for x in s[b : i + 1]) >= 20]
            own |= {(begins[0], i + 1)} if begins else set()
            own |= {(i, i + 1)} if len(s[i][0]) >= 40 else set()
            for a, b in own:
                places.setdefault(tuple(w for x in s[a:b] for w in x[0]), set()).add((key, a, b, d))
    gone = [set() for _ in docs]
    for at in places.values():
        for key, a, b, d in at:
            if (key, a) > min(x[:2] for x in at):
                gone[d] |= set(range(a, b))
    return [(key, (docs[d][1] if not gone[d] else "".join(t for k, (_, t) in enumerate(s) if k not in gone[d]).strip()), len(s), len(gone[d])) for d, (key, s) in enumerate(cuts)]


def test_matches_brute_force(spark):
    rnd = random.Random(8)
    sentence = lambda: " ".join(rnd.choice(["Ab", "cd", "é", "x1"]) + str(rnd.randrange(99)) for _ in range(rnd.choice([1, 3, 8, 15, 45]))) + rnd.choice([".", "!", '."', "\n", " ..."])
    passages = [[sentence() for _ in range(rnd.choice([1, 2, 3, 6]))] for _ in range(12)]
    docs = []
    for i in range(70):
        parts = [sentence() for _ in range(rnd.choice([0, 1, 4, 12]))]
        for _ in range(rnd.choice([0, 1, 2])):
            at = rnd.randrange(len(parts) + 1)
            parts[at:at] = rnd.choice(passages)
        docs.append((i * 11 % 70, rnd.choice([" ", "\n", "  "]).join(parts)))
    docs += [(200, None), (201, ""), (202, " \n "), (203, docs[3][1].upper()), (204, "word. " * 90)]
    df = spark.createDataFrame([(k, t, 1, "h") for k, t in docs], "doc_id long, text string, part int, h string").repartition(3)
    got = sorted(((r.doc_id, r.text, r._sentences, r._removed_count) for r in spans.deduplicated(df).collect()), key=lambda r: r[0])
    want = sorted(brute(docs), key=lambda r: r[0])
    assert [(g, w) for g, w in zip(got, want, strict=True) if g != w] == []


def test_same_rows_and_unpunctuated_text(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    docs = [(1, "Start here. " + long), (2, "Other start " + long), (3, "one two three. four five."), (3, "one two three. four five."), (None, "a " * 30)]
    got = {}
    for r in spans.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got[1][0]._removed_count == 0 and [r._removed_count for r in got[3]] == [0, 0]
    assert len(got[2][0].text) < len(long) / 10


def test_empty_table(spark):
    assert spans.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_unpunctuated_passages_in_differing_contexts(spark):
    rnd = random.Random(4)
    words = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    docs = []
    for k, n in enumerate([51, 55, 60, 80] * 8):
        around, passage = rnd.choice([0, 3, 30]), words(n)
        docs.append((2 * k, " ".join(words(around) + passage + words(around))))
        docs.append((2 * k + 1, " ".join(words(3) + passage + words(rnd.choice([3, 30])))))
    docs += [(1000, "one two " + "spam " * 70), (1001, "spam " * 55 + "three")]
    got = {r.doc_id: r for r in spans.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    missed = [k for k, _ in docs if k % 2 and len(got[k].text.split()) > len(dict(docs)[k].split()) - 20]
    assert missed == []


def test_stops_of_other_scripts():
    import pyarrow as pa

    assert [len(spans.sentences(pa.array([t])).row) for t in ("एक दो। तीन", "هل هذا؟ نعم", "一。 二！ 三", "é ü à")] == [2, 2, 3, 1]
