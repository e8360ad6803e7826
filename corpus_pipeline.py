"""From raw documents to token ids: toxicity, near duplicates, repeated passages, benchmark passages, SentencePiece.

Each stage takes the documents that the one before has kept and returns documents with the same columns; the last returns
token ids. Stages work on rows, not ids: rows that share a doc_id but not a text are judged apart, and rows equal in both are one
document, of which the near-duplicate stage keeps one row. Columns besides are carried along, whatever their names. An empty table
passes through as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.llm import decontam, langid, similar, spans, spiece, toxicity
from foliate.llm.columns import fresh, row_id
from foliate.llm.queries import tokenizer_file
from foliate.llm.store import written

def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; null and empty texts get the base rate and stay. The model is fitted to the labels of documents outside the held-out fifth."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fitted(docs, labels, ~langid.held_out(F.col("doc_id"), 5, 0))
    score = fresh("_score", docs.columns)
    return toxicity.with_scores(docs, model, name=score).where(F.col(score) < 0.5).drop(score)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each class of documents that share four fifths of their five-word shingles; texts without a word are one class."""
    row = fresh("_row", docs.columns)
    rows = docs.withColumn(row, row_id("doc_id", "text"))
    found = similar.near_duplicates(rows, row)
    least = found.where(F.col(row) == F.col("component")).select(row).distinct()
    return rows.join(least, row, "left_semi").dropDuplicates([row]).drop(row)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the sentence spans that an earlier document has; documents of which nothing is left go, null and empty ones stay."""
    before, removed, _ = added = tuple(fresh(c, docs.columns) for c in spans.ADDED)
    found = spans.deduplicated(docs, added=added)
    whole = (F.col(removed) > 0) & (F.col(removed) == F.col(before))
    kept = found.where(~whole)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.drop(*added)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words are benchmark passages; texts without words stay."""
    row = fresh("_row", docs.columns)
    rows = docs.withColumn(row, row_id("doc_id", "text"))
    found = decontam.contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), row)
    bad = found.where((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).select(row).distinct()
    return rows.join(bad, row, "left_anti").drop(row)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each kept document, and whether they decode to its text."""
    return spiece.encoded(docs, spiece.model_bytes(tokenizer_file("piece_bpe_32k.model")), check=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", one_of_each),
    ("repeated passages", drop_repeats),
    ("benchmark passages", drop_contaminated),
    ("sentencepiece", encode),
]

#: Fingerprints, fitted models and tokenizers are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
