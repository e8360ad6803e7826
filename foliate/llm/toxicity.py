"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words are mapped to classes: insult, threat, target, negation, report (of somebody's speech), intensifier and other. Each transducer
reads a class string and has weights on its arcs; the grammar is their composition, compiled once into one table of
(state, class) -> (state, feature). A clause scores by the arcs its words take, so that the same insult counts apart
when it stands alone, is aimed at somebody, is negated or is reported. The classes' seed words are below; insults and threats
that they lack are found as words that separate labelled texts, and the weights of the arcs are fitted to labels.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import chunks
from .columns import mapped, released
from .store import written

#: Seed words of each class, in the languages of the corpus.
SEEDS = {
    "insult": "idiot idiots moron fool stupid dumb loser pathetic worthless scum trash garbage disgusting clown imbecile jerk idiota estúpido imbécil dumm dummkopf trottel abschaum crétin stupide minable ordure",
    "threat": "kill hurt destroy beat shoot stab burn töten umbringen tuer frapper matar golpear",
    "target": "you your you're u he she they them him her these those du ihr euch tu vous toi ils elles usted ustedes ellos tú",
    "negation": "not no never isn't aren't don't nobody nicht kein keine nie pas jamais ne nunca jamás ningún",
    "report": "said says say quote quoted according reported reportedly wrote claims claimed sagte laut dit selon dijo según",
    "intensifier": "very so such really total complete absolute utter sehr so très muy total",
}
CLASSES = ["other", *SEEDS]
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, INTENSIFIER = range(7)
#: Bound of the labelled rows that the fit looks at, the first by a hash of their ids.
MAX_LABELLED = 20_000
#: What a word or stem ("abc*") has to be to join the insults: log odds, and a likelihood ratio that chance alone reaches for about
#: one in as many as there are. Both follow the sample, so a rare word of a small one can pass, and none is cut off by number.
MIN_LOG_ODDS = 3.2
#: Likelihood ratio from which the sample can speak against a seed word: a chance of one in a thousand.
CLEAR = 10.8
STEMS = range(3, 9)
#: A longer stem stands for a shorter one if it is in this share of its toxic texts.
SAME = 0.95
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;:\n…]", re.UNICODE)
_BREAKS = frozenset(".!?;:\n…")


@dataclass(frozen=True)
class Transducer:
    """Arcs (state, class) -> (next state, emitted symbol); a class without an arc stays and emits nothing. State 0 is initial."""

    states: int
    arcs: dict[tuple[int, int], tuple[int, str]]

    def step(self, state: int, symbol: int) -> tuple[int, str]:
        return self.arcs.get((state, symbol), (state, ""))


#: Two words of scope after a negation.
NEGATED = Transducer(3, {(s, NEGATION): (2, "") for s in range(3)} | {(2, c): (1, "not" if c in (INSULT, THREAT) else "") for c in (OTHER, INSULT, THREAT, TARGET, INTENSIFIER, REPORT)} | {(1, c): (0, "not" if c in (INSULT, THREAT) else "") for c in (OTHER, INSULT, THREAT, TARGET, INTENSIFIER, REPORT)})
#: The rest of a clause after a word of report.
REPORTED = Transducer(2, {(s, REPORT): (1, "") for s in range(2)} | {(1, c): (1, "said") for c in (INSULT, THREAT)})
#: A target named before, within the clause.
AIMED = Transducer(2, {(s, TARGET): (1, "") for s in range(2)} | {(1, c): (1, "aimed") for c in (INSULT, THREAT)})
#: An insult or threat that follows another or an intensifier.
HEAPED = Transducer(2, {(s, c): (1, "heaped" if s else "") for s in range(2) for c in (INSULT, THREAT)} | {(0, INTENSIFIER): (1, ""), (1, INTENSIFIER): (1, "")})


class Grammar:
    """The composition of transducers that read the same clause, as one table."""

    def __init__(self, *parts: Transducer):
        self.start = (0,) * len(parts)
        self.states = {self.start: 0}
        self.arcs: list[list[tuple[int, str]]] = []
        todo = [self.start]
        while len(self.arcs) < len(todo):
            own = todo[len(self.arcs)]
            row = []
            for c in range(len(CLASSES)):
                moved = [p.step(s, c) for p, s in zip(parts, own, strict=True)]
                to = tuple(x[0] for x in moved)
                if to not in self.states:
                    self.states[to] = len(todo)
                    todo.append(to)
                marks = [x[1] for x in moved if x[1]]
                row.append((self.states[to], "+".join([CLASSES[c], *marks]) if c in (INSULT, THREAT) else ""))
            self.arcs.append(row)
        self.features = sorted({f for row in self.arcs for _, f in row if f})
        index = {f: k for k, f in enumerate(self.features)}
        self.table = [[(to, index.get(f, -1)) for to, f in row] for row in self.arcs]


GRAMMAR = Grammar(NEGATED, REPORTED, AIMED, HEAPED)
#: Of each text: matches of each feature, matched clauses, matches of the learned words, share of matched words, and one.
N_FEATURES = len(GRAMMAR.features) + 4


@dataclass
class Model:
    classes: dict[str, int]
    strength: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES))


    def read(self, word: str) -> tuple[int, float]:
        """Class and strength of a word: its own, or else those of its longest stem."""
        if word in self.classes:
            return self.classes[word], self.strength.get(word, 1.0)
        for n in reversed(STEMS):
            if len(word) >= n and word[:n] in self.stems:
                return INSULT, self.stems[word[:n]]
        return OTHER, 1.0

    def finder(self) -> re.Pattern:
        """Finds a word of insult or threat in lower-case text."""
        words = sorted((re.escape(w) + r"(?![^\W\d_])" for w, c in self.classes.items() if c in (INSULT, THREAT)), key=len, reverse=True)
        stems = sorted(map(re.escape, self.stems), key=len, reverse=True)
        return re.compile(rf"(?<![^\W\d_])(?:{'|'.join([*stems, *words]) or '(?!)'})")


def pruned(found: dict[str, tuple[int, float]]) -> dict[str, float]:
    """Of words and stems with their toxic texts and log odds, those that no shorter stem makes needless, each as long as it stays the same set of texts."""
    kept: dict[str, float] = {}
    for name in sorted(found, key=lambda x: (len(x.rstrip("*")), x)):
        bare = name.rstrip("*")
        if any(bare.startswith(k[:-1]) for k in kept if k.endswith("*")):
            continue
        best = max((x for x in found if x.startswith(bare) and x.endswith("*") and found[x][0] >= SAME * found[name][0]), key=len, default=name)
        kept[best] = min(found[best][1], 8.0)
    return dict(sorted(kept.items(), key=lambda x: (-found[x[0]][0] * x[1], x[0])))


def seed_classes() -> dict[str, int]:
    found: dict[str, int] = {}
    for name, words in SEEDS.items():
        for w in words.split():
            found.setdefault(w, CLASSES.index(name))
    return found


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def features(text: str | None, model: Model) -> np.ndarray:
    """What the grammar matches in the whole text: log counts of each kind of match, and sums over clauses."""
    out = np.zeros(N_FEATURES)
    out[-1] = 1
    table = GRAMMAR.table
    state = words = clauses = learned = 0
    hot = False
    for t in tokens(text):
        if t in _BREAKS:
            clauses += hot
            state, hot = 0, False
            continue
        words += 1
        kind, strength = model.read(t)
        state, feature = table[state][kind]
        if feature >= 0:
            out[feature] += 1
            learned += strength
            hot = True
    clauses += hot
    n = len(GRAMMAR.features)
    matched = out[:n].sum()
    out[:n] = np.log1p(out[:n])
    out[n : n + 3] = np.log1p(clauses), np.log1p(learned), 10 * matched / max(words, 10)
    return out


def _sampled(labels: DataFrame, key: str, label: str, learn: Column | None, limit: int) -> DataFrame:
    rows = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    if learn is not None:
        rows = rows.where(learn)
    # Repeated labels of a key are one; toxic if any is.
    return rows.groupBy(F.col(key).alias("key")).agg(F.max((F.col(label) > 0).cast("int")).alias("y")).orderBy(F.xxhash64("key"), "key").limit(limit)


def fitted(docs: DataFrame, labels: DataFrame, learn: Column | None = None, key: str = "doc_id", label: str = "toxic", text: str = "text", limit: int = MAX_LABELLED) -> Model:
    """A model from at most `limit` labelled rows, those first by a hash of their key, and the texts with these keys.

    `learn` is a condition on the labels' rows. Rows of equal key and text count once, and so do repeated labels. Only counts of telling
    words, and features of the sampled texts, reach the driver; the sample bounds both. Without labels of both kinds, or without
    documents, the model keeps its seed words and plain prior weights.
    """
    sample = F.broadcast(_sampled(labels, key, label, learn, limit))  # at most `limit` pairs of a key and a bit
    texts = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).join(sample, "key").where(F.col("text").isNotNull()).dropDuplicates(["key", "text"]).select("text", "y")
    model = Model(seed_classes())

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 18):
            found: dict[str, list[int]] = {}
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = set(tokens(t)) - _BREAKS
                for w in own | {f"{w[:n]}*" for w in own for n in STEMS if len(w) >= n}:
                    found.setdefault(w, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *(pa.array([v[k] for v in found.values()], pa.int64()) for k in (0, 1))], ["w", "clean", "toxic"])

    totals = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("bad")).first()
    bad, good = int(totals.bad), int(totals.n - totals.bad)
    if bad and good:
        counts = mapped(texts, words, "w string, clean long, toxic long").groupBy("w").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        counts = written(counts, "toxic-words")
        n, share = F.col("toxic") + F.col("clean"), bad / (bad + good)
        odds = F.log((F.col("toxic") + 0.5) / (bad + 1)) - F.log((F.col("clean") + 0.5) / (good + 1))
        part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
        ratio = 2 * (part(F.col("toxic"), n * share) + part(F.col("clean"), n * (1 - share)))
        held = counts.select("w", odds.alias("odds"), ratio.alias("ratio"), "toxic")
        # A word has to be evidence by itself: ordinary words of long texts reach the ratio, not the odds.
        rows = held.where((F.col("odds") >= MIN_LOG_ODDS) & (F.col("ratio") >= 2 * math.log(max(counts.count(), 2)))).select("w", "toxic", "odds").collect()
        for w, odds in pruned({r.w: (r.toxic, r.odds) for r in rows}).items():
            if w.endswith("*"):
                model.stems[w[:-1]] = odds
            else:
                model.strength[w] = odds
                model.classes.setdefault(w, INSULT)
        # Seed words that labelled clean texts hold as often are no evidence here.
        for r in held.where((F.col("ratio") >= CLEAR) & F.col("w").isin(sorted(w for w, c in seed_classes().items() if c in (INSULT, THREAT))) & (F.col("odds") < 0.5)).collect():
            model.classes[r.w] = OTHER

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            rows = [features(t, model) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x.tolist() for x in rows], pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    # Equal feature rows are many, as most texts match nothing: their counts are what is fitted.
    kinds = mapped(texts, matched, "x array<double>, y int").groupBy("x").agg(F.sum("y").alias("bad"), F.count("*").alias("n")).collect()
    model.weights = _logistic(np.array([k.x for k in kinds]).reshape(-1, N_FEATURES), np.array([k.bad for k in kinds], float), np.array([k.n for k in kinds], float))
    return model


def _logistic(x: np.ndarray, bad: np.ndarray, n: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the prior is a rise with each kind of match and a low base rate."""
    prior = np.full(N_FEATURES, 0.5)
    prior[[k for k, f in enumerate(GRAMMAR.features) if "not" in f or "said" in f]] = 0.0
    prior[-1] = -3.0
    w = prior.copy()
    if not len(x):
        return w
    scale = np.full(N_FEATURES, ridge)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (bad - n * p) - scale * (w - prior)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(scale), gradient)
        w = w + step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def with_scores(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """`docs` and the probability of the label for each whole text; null, empty and wordless texts get the base rate. Only the text goes to Python, and only the score comes back."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hot, empty = model.finder(), features("", model)
        for texts in batches:
            # A text without any such word matches no clause, so its features are those of the empty one.
            rows = np.array([features(t, model) if t and hot.search(t.lower()) else empty for t in texts]).reshape(-1, N_FEATURES)
            yield pd.Series(1 / (1 + np.exp(-np.clip(rows @ model.weights, -30, 30))))
        released()

    return docs.withColumn(name, score(F.col(text).cast("string")))


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of each row; other columns are not read."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return with_scores(rows, model).select(F.col("key").alias(key), "score")
