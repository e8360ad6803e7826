import random

import numpy as np

from foliate.llm import langid

SOUNDS = {"aa": ["ka", "to", "mi"], "bb": ["sch", "ung", "ein"], "cc": ["été", "oux", "è"]}


def _text(rnd, lang, n=60):
    return " ".join("".join(rnd.choice(SOUNDS[lang]) for _ in range(3)) for _ in range(n))


def test_held_out_accuracy_and_odd_texts(spark):
    rnd = random.Random(1)
    rows = [(i, _text(rnd, lang, rnd.choice([5, 60])), lang, "en") for i in range(240) for lang in [rnd.choice("abc") * 2]]
    rows += [(900, None, "aa", ""), (901, "", "aa", ""), (902, "123 !!", "aa", ""), (903, _text(rnd, "bb", 20000), None, ""), (903, "x", None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    got = {r.doc_id: r for r in langid.predicted(docs, lambda d: d.where("doc_id % 4 <> 2")).collect()}
    assert len(got) == len({r[0] for r in rows})
    assert all(got[i].lang_pred == lang for i, _, lang, _ in rows[:240])
    assert all((got[i].lang_pred, got[i].score) == ("und", 0) for i in (900, 901, 902))
    assert all(0 <= r.score <= 1 for r in got.values())


def test_vectors_match_their_definition():
    encoder = langid.Encoder(64)
    grams, table = encoder.counts(["Ab, ab!", None, "b"])
    plain = np.zeros((3, 64))
    for row, text in enumerate(["  ab ab ", "", " b "]):
        t = " " + " ".join(text.split()) + " "
        for i in range(len(t) - 2):
            if t[i + 1] != " ":
                plain[row] += np.prod([np.roll(encoder.letter(ord(c)), 2 - j) for j, c in enumerate(t[i : i + 3])], axis=0)
    assert (table @ encoder.vectors_of(grams) == plain).all()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.predicted(docs, lambda d: d).count() == 0
    alone = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in langid.predicted(alone, lambda d: d).collect()] == [(1, "und", 0.0)]
