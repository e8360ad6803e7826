import random

from pyspark.sql import functions as F

from foliate.llm import toxicity


def _docs(rnd, n):
    plain = [f"wo{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        words, bad = [rnd.choice(plain) for _ in range(rnd.choice([4, 40, 200]))], i % 5 == 1
        if bad:
            words.insert(rnd.randrange(len(words)), rnd.choice(["idiot", "Zorgus", "vlim" + rnd.choice("abcdefghij") + rnd.choice("klmnop")]))
        docs.append((i, " ".join(words) + ".", "en", 0.0))
        labels.append((i, int(bad)))
    return docs, labels


def test_held_out_labels_words_and_stems(spark):
    docs, labels = _docs(random.Random(3), 1200)
    docs += [(5000, None, "", 1.0), (5001, "", "", 1.0), (5002, "wo1 " * 30000 + "idiot", "", 1.0), (5002, "!!! 123", "", 1.0)]
    labels += [(7777, 1), (None, 1), (3, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, score double")
    model = toxicity.fitted(d, spark.createDataFrame(labels, "doc_id long, toxic int"), F.col("doc_id") % 3 != 0)
    assert any(s.startswith("vlim") for s in model.stems) and any(s.startswith("zorgus") for s in [*model.stems, *model.strength])
    got = {}
    for r in toxicity.scored(d, model).collect():
        got.setdefault(r.doc_id, []).append(r.score)
    y = dict(labels)
    wrong = [i for i in range(1200) if i % 3 == 0 and i != 3 and (got[i][0] >= 0.5) != bool(y[i])]
    assert not wrong
    assert all(0 <= s <= 1 for v in got.values() for s in v)
    assert max(got[5000] + got[5001]) < 0.5 and sorted(x >= 0.5 for x in got[5002]) == [False, True]


def test_grammar_tells_contexts_apart():
    model = toxicity.Model(toxicity.seed_classes())
    names = toxicity.GRAMMAR.features
    kinds = lambda t: {names[k] for k, v in enumerate(toxicity.features(t, model)[: len(names)]) if v}
    assert kinds("what an idiot") == {"insult"}
    assert kinds("you idiot") == {"insult+aimed"}
    assert kinds("you are not an idiot") == {"insult+not+aimed"}
    assert kinds("not today. idiot") == {"insult"}
    assert kinds("a witness said idiot") == {"insult+said"}
    assert kinds("I will kill you") == {"threat"}
    assert kinds("stupid idiot") == {"insult", "insult+heaped"}


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (2, "fine")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fitted(docs, none)
    assert toxicity.scored(docs, model).count() == 2 and toxicity.scored(docs.limit(0), model).count() == 0
