"""The corpus pipeline: documents pass the stages in order; each stage works on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bytebpe, langid, mixing, neardup
from millrace.llm.shared import new_name, read_table, small_batches, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go; the column ``lang`` is what a document declares."""
    small_batches(spark)
    model = langid.fit(docs)
    found = langid.identify(docs, model, "text", F.col("lang"), F.col("source"), taken="found_language")
    return found.where("not found_language.rejected").select(*docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: SimHash candidates, exact Jaccard of five-word shingles."""
    small_batches(spark)
    return neardup.keep_one_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens stand in the target proportions of source, language and topic."""
    name = new_name(docs, "n_words")
    counted = docs.withColumn(name, mixing.word_count(F.col("text")))  # a column of its own, which is counted once
    mixed = mixing.mix(counted, F.col("source"), F.col("lang"), mixing.form_topic(F.col("text"), F.col(name)), F.col(name), taken="mixed_as")
    return mixed.select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; a digest of the decoded bytes shows that nothing is lost."""
    small_batches(spark)
    return bytebpe.encode(docs.select("doc_id", "lang", "source", "text"), VOCABULARY, public_tokenizers.PATTERN, digests=True)


STAGES = [("language_id", language), ("simhash_dedup", dedup), ("mixing", mixing_stage), ("byte_bpe", byte_bpe)]

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")

#: The stages use hashes and models that DuckDB's SQL lacks; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again before the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
