"""Corpus pipeline: language, near-duplicates, benchmark passages, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns what it keeps of ``docs``; the result is
written as Parquet and read again as the next stage's documents. All stages but the last
return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclograin.llm import bpe, decontamination, langid, simhash
from cyclograin.llm.queries import table, vocabulary_path
from cyclograin.operators.attach import scratch_path

#: A text whose ranking lies this near to the farthest possible has no known language.
LEAST_SCORE = 0.1


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of no known language: without letters, or far from every learned profile."""
    # the row travels as one value, so no column of the documents can clash with the prediction's
    packed = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), F.col("text").alias("read"))
    found = langid.predict(packed, langid.learn(docs), "read", ["row"])
    kept = found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, the one with the smallest id."""
    return simhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which at least one word in twenty belongs to a benchmark passage."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and of the text decoded from them, for each document."""
    return bpe.round_trip(docs, bpe.Codec(docs, "text", vocabulary_path()), "text", ["doc_id"])


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("bpe_encode", encode_tokens),
]

#: SQL can express neither the rankings nor the merges; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
