"""Corpus pipeline: documents to packed training sequences.

Language ID, quality, line de-duplication, near-copy removal and packing; each
stage is written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.llm import best_fit, langid, line_dedup, ngram_join, quality
from cataloom.llm.common import written
from cataloom.llm.queries import (GOOD, LINE_DOCUMENTS, language_model, quality_model, tokens)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; texts without letters (null, empty) go."""
    return langid.keep_identified(docs, "text", language_model(spark, sf_dir))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as of good quality."""
    return quality.keep_good(docs, "text", quality_model(spark, sf_dir), GOOD)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many of them share; n_chars follows the text."""
    kept = line_dedup.LineIndex(spark, LINE_DOCUMENTS).insert(docs).dedup(docs)
    n = F.when(F.col("_n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return kept.select(*[n.cast(f.dataType).alias(f.name) if f.name == "n_chars" else f.name
                         for f in docs.schema])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.drop_near_copies(docs, "doc_id", "text")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 2048 tokens."""
    pieces = best_fit.tokenize_pieces(docs, "doc_id", "text", tokens())
    return best_fit.pack(pieces).withColumnRenamed("id", "doc_id")


STAGES = [("language_id", language), ("quality", good), ("line_dedup", lines),
          ("ngram_jaccard", near_copies), ("best_fit_packing", packed)]

#: SQL can express neither the language model nor the classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
