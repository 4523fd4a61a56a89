"""A corpus from raw documents to packed sequences, in stages that each read what the one before wrote."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codescope.llm import language, lines, mixing, ngram_join, packing
from codescope.llm.common import batches_of, write_through

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; those without a letter or of doubtful language go.

    Written here: texts go to the workers and back in batches that are small whatever the reader of the stage has set.
    """
    with batches_of(spark, 1000):
        return write_through(spark, language.keep_known(spark, docs), "known")


def recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines of templates that an earlier document has; documents of which nothing is left go."""
    kept = lines.drop_recurring_lines(spark, docs)
    kept = kept.where(~((F.col("lines_dropped") > 0) & (F.btrim("text", F.lit(" \t\n\x0b\f\r")) == "")))
    if "n_chars" in docs.columns:
        length = F.when(F.col("lines_dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))
        kept = kept.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return kept.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets of Jaccard 0.8 or more."""
    return ngram_join.keep_one(spark, docs, words=5, percent=80)


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at tempered source weights: each at least once, none more than about twice."""
    return mixing.mix_sources(spark, docs, repeats=2.0).select(docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' tokens in sequences of 2048."""
    return packing.pack_documents(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("line_dedup", recurring_lines),
    ("ngram_jaccard_join", near_duplicates),
    ("source_mixing", source_weights),
    ("best_fit_packing", packed_sequences),
]

#: Learned weights and tokenizers cannot be stated in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = write_through(spark, stage(spark, docs, sf_dir), name)
    return docs
