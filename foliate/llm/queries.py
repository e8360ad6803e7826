"""Queries over the driver's tables, one for each operator of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, htmltext, langid, ngramlm, quality, simhash, spans, spiece, tokenfile, toxicity


def tokenizer_file(name: str) -> str:
    """Where the public tokenizers package keeps a vocabulary; every executor has it."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = langid.held_out(F.col("doc_id"), 4, 2)
    found = langid.predicted(table(spark, sf_dir, "documents"), lambda docs: docs.where(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op3_trigram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramlm.scored(table(spark, sf_dir, "documents"), langid.held_out(F.col("doc_id"), 10, 0))


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = spiece.model_bytes(tokenizer_file("piece_bpe_32k.model"))
    return spiece.encoded(table(spark, sf_dir, "documents"), model, check=True).drop("ids")


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.stored(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extracted(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = langid.held_out(F.col("doc_id"), 5, 0)
    model = toxicity.fitted(docs, labels, ~held_out)
    return toxicity.scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", F.col("_sentences").alias("n_sentences"), F.col("_removed_count").alias("n_removed"), F.col("_removed").alias("removed"))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op9 counts, without its verdict: the part that SQL can say."""
    found = quality.measured(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES = {"op1_langid": op1_langid, "op2_simhash": op2_simhash, "op3_trigram_trie": op3_trigram_trie, "op4_winnowing": op4_winnowing, "op5_sentencepiece": op5_sentencepiece, "op6_token_ids": op6_token_ids, "op7_html": op7_html, "op8_toxicity": op8_toxicity, "op9_quality": op9_quality, "op10_sentence_spans": op10_sentence_spans, "quality_counts": quality_counts}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a text as op4's contract has them.
_ALNUM_WORDS = f"list_filter(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: len(x) > 0)"

ORACLE_SQL: dict[str, str] = {
    "op4_winnowing": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM_WORDS} AS w FROM benchmark), items AS (SELECT item_id, w, least(len(w), {decontam.SPAN}) AS size FROM b WHERE len(w) > 0),
wanted AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS win FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM items)),
sizes AS (SELECT DISTINCT size FROM items),
runs AS (SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS win FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
met AS (SELECT runs.r, runs.i, runs.size, wanted.item_id FROM runs JOIN wanted USING (size, win)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT r, i, size FROM met)) GROUP BY r),
named AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM met GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)""",
    "quality_counts": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
runs AS (SELECT r, i, array_to_string(w[i:i + {quality.WINDOW - 1}], ' ') AS win FROM (SELECT r, w, unnest(range(1, len(w) - {quality.WINDOW - 2})) AS i FROM d WHERE len(w) >= {quality.WINDOW})),
twice AS (SELECT r, win FROM runs GROUP BY 1, 2 HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {quality.WINDOW})) AS p FROM runs JOIN twice USING (r, win)) GROUP BY r),
c AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN lines USING (r) LEFT JOIN covered USING (r))
SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED_PERCENT} * n_words AS base_failed FROM c""",
}
