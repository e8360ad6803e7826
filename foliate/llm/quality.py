"""Quality rules whose thresholds follow each language and source, in DataFrame expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
#: Groups with fewer documents take the thresholds of their language, and languages with fewer those of all documents.
MIN_GROUP = 200
SKETCH_K = 400
#: Interquartile ranges beyond the quartiles at which a document is an outlier of its group.
FENCE = 3.0
#: For each measured share: the slack beyond the fence, so that groups without any spread keep ordinary documents.
SLACK = {"symbol_share": 0.03, "stutter_share": 0.1, "dup_line_share": 0.4}
#: The mean word length of a text of n words may stray by this over the root of n besides.
LENGTH_NOISE = 7.5
MEASURES = [*SLACK, "word_length"]


def let(value: Column, body) -> Column:
    """`body(value)` with value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the text."""

    def covered(at: Column) -> Column:
        step = lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW)))
        return F.aggregate(F.transform(at, step), F.lit(0), lambda n, x: n + x)

    def positions(pairs: Column) -> Column:
        like = lambda x, i: F.coalesce(x["h"] == F.get(pairs, i)["h"], F.lit(False))
        hit = F.filter(pairs, lambda x, i: like(x, i - 1) | like(x, i + 1))
        return F.sort_array(F.transform(hit, lambda x: x["i"]))

    def of(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda x, i: F.named_struct(F.lit("h"), x, F.lit("i"), i)))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(let(pairs, positions), covered))

    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) < WINDOW + 1, F.lit(0)).otherwise(let(hashes, of))


def _counts(text: Column) -> Column:
    bare = lambda s, chars: F.translate(s, chars, "")
    is_word = lambda s: F.length(bare(s, WHITE)) > 0

    def of_lines(lines: Column) -> Column:
        return F.named_struct(F.lit("n_lines"), F.size(lines), F.lit("n_dup_lines"), F.size(lines) - F.size(F.array_distinct(lines)))

    def of_words(words: Column) -> Column:
        stutter = F.size(F.filter(words, lambda w, i: F.coalesce(w == F.get(words, i - 1), F.lit(False))))
        return F.named_struct(F.lit("n_words"), F.size(words), F.lit("n_stutter"), stutter, F.lit("n_repeat_words"), _repeated(words))

    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), is_word)
    return F.struct(
        F.length(bare(text, WHITE)).alias("word_chars"),
        (F.length(text) - F.length(bare(text, SYMBOLS))).alias("n_symbols"),
        let(lines, of_lines).alias("l"),
        let(words, of_words).alias("w"),
    )


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(key, lang, source, counts, shares, base_failed): what the rules look at, one row for each document; a null text counts as empty."""
    found = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(source).alias("source"), _counts(F.coalesce(F.col(text), F.lit(""))).alias("c"))
    names = {"n_words": "c.w.n_words", "word_chars": "c.word_chars", "n_symbols": "c.n_symbols", "n_lines": "c.l.n_lines", "n_dup_lines": "c.l.n_dup_lines", "n_stutter": "c.w.n_stutter", "n_repeat_words": "c.w.n_repeat_words"}
    flat = found.select("key", "lang", "source", *[F.col(v).cast("long").alias(k) for k, v in names.items()])
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return flat.select(
        "*",
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_stutter", "n_words").alias("stutter_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("word_chars", "n_words").alias("word_length"),
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))).alias("base_failed"),
    )


def sketches(rows: DataFrame) -> DataFrame:
    """A KLL sketch of every measure for each language and source, of the rows that pass the base rules. Sketches merge: across batches and into wider groups."""
    return rows.where(~F.col("base_failed")).groupBy("lang", "source").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(m, SKETCH_K).alias(m) for m in MEASURES])


def merged(parts: DataFrame, *by: str) -> DataFrame:
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(m, SKETCH_K).alias(m) for m in MEASURES])


def thresholds(parts: DataFrame) -> DataFrame:
    """(lang, source, m_low, m_high for each measure m): the fences of each group, of its language where the group is small, or of all."""

    def fences(df: DataFrame, tag: str) -> DataFrame:
        quartile = lambda m, q: F.kll_sketch_get_quantile_double(F.col(m), F.lit(q))
        cols = [c for m in MEASURES for c in (quartile(m, 0.25).alias(f"{m}_1{tag}"), quartile(m, 0.75).alias(f"{m}_3{tag}"))]
        return df.select(*[c for c in df.columns if c in ("lang", "source")], (F.col("n") >= MIN_GROUP).alias(f"enough{tag}"), *cols)

    by_lang = fences(merged(parts, "lang"), "_l").withColumnRenamed("lang", "lang_l")
    overall = fences(merged(parts), "_a")
    joined = fences(parts, "").join(by_lang, F.col("lang").eqNullSafe(F.col("lang_l"))).crossJoin(F.broadcast(overall))  # `overall` is one row
    pick = lambda c: F.when(F.col("enough"), F.col(c)).when(F.col("enough_l"), F.col(f"{c}_l")).otherwise(F.col(f"{c}_a"))
    out = []
    for m in MEASURES:
        q1, q3 = pick(f"{m}_1"), pick(f"{m}_3")
        out += [(q1 - FENCE * (q3 - q1)).alias(f"{m}_low"), (q3 + FENCE * (q3 - q1)).alias(f"{m}_high")]
    return joined.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), *out)


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row for each document with its counts, `base_failed` and `kept`.

    A document is kept if it passes the base rules and lies within the fences of its language and source. Null
    languages and sources are groups of their own. Empty and null texts fail. Documents whose whole group failed
    have no fences and are not kept. Other columns are not read.
    """
    rows = written(measured(docs, key, text, lang, source), "quality")
    limits = thresholds(sketches(rows))
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    within = [F.col(m) <= F.col(f"{m}_high") + slack for m, slack in SLACK.items()]
    noise = LENGTH_NOISE / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    within += [F.col("word_length") <= F.col("word_length_high") + noise, F.col("word_length") >= F.col("word_length_low") - noise]
    kept = F.coalesce(~F.col("base_failed") & reduce(Column.__and__, within), F.lit(False))
    return joined.select(F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stutter", "base_failed", kept.alias("kept"))
