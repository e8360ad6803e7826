import collections
import random
import re

from foliate.llm import quality


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = collections.Counter(runs)
    repeated = len({i + j for i, r in enumerate(runs) if n[r] > 1 for j in range(5)})
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), repeated, len(w) < 10 or 100 * repeated > 20 * len(w)


def test_counts_match_brute_force(spark):
    rnd = random.Random(2)
    texts = [None, "", " \n\t ", "a\n\na\n a", "\x0bx\x0cy  z\r\n" * 9, "é𝄞 # * $ % & | < >", "a b c d e a b c d e", "a " * 5, "a " * 6, "x y z " * 9000]
    for _ in range(60):
        vocab = [f"w{i}" for i in range(rnd.choice([2, 10, 500]))]
        texts.append("".join(rnd.choice(vocab) + rnd.choice([" ", "\n", "  ", "# "]) for _ in range(rnd.choice([3, 9, 10, 40, 400]))))
    docs = spark.createDataFrame([(i, t, None if i % 3 else "en", f"s{i % 2}", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_words int")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judged(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_fences_follow_the_group(spark):
    rnd = random.Random(4)
    plain = lambda: " ".join("".join(rnd.choice("abcdef") for _ in range(rnd.randrange(3, 8))) for _ in range(60))
    dense = lambda: " ".join(w + "#" for w in plain().split())
    rows = [(i, plain(), "en", "prose") for i in range(300)] + [(1000 + i, dense(), "en", "tags") for i in range(300)]
    rows += [(2000, dense(), "en", "prose"), (2001, " ".join(w for x in plain().split() for w in (x, x)), "en", "prose"), (2002, plain(), "en", "rare"), (2002, plain(), "en", "rare")]
    kept = collections.defaultdict(list)
    for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect():
        kept[r.doc_id].append(r.kept)
    assert all(kept[i] == [True] for i in range(300)) and all(kept[1000 + i] == [True] for i in range(300))
    assert kept[2000] == [False] and kept[2001] == [False] and kept[2002] == [True, True]


def test_empty_table(spark):
    assert quality.judged(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0
