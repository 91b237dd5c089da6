"""Registered queries over the driver tables, each with its DuckDB oracle.

Every query reads whole tables (or frames Spark derives from them).  Column
names are aliased identically on both sides; doubles are rounded to 6 places
on both sides; counts are BIGINT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, sf, name)


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# --- shared frames ----------------------------------------------------------------

def store_frame(spark: SparkSession, sf: str) -> DataFrame:
    """The embedding store: every document, with its vector if it has one."""
    d = t(spark, sf, "documents")
    e = t(spark, sf, "embeddings")
    return d.join(e, d.doc_id == e.vec_id, "left").select(
        F.col("source").alias("dataset_id"), F.col("doc_id").cast("string").alias("pk"),
        F.col("text").alias("text_chunk"), "embedding")


def question_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Questions: benchmark passages, each with the vector of the same id."""
    b = t(spark, sf, "benchmark")
    e = t(spark, sf, "embeddings")
    return b.join(e, b.item_id == e.vec_id).select(
        F.col("item_id").alias("qid"), F.col("text").alias("question"), "embedding")


def ask_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Questions of all kinds: benchmark passages; the first words of the document
    with a passage's id, scoped to a source or to 'all', with its vector (found by
    both halves); nation names without a vector (mostly unanswered)."""
    passages = question_frame(spark, sf).withColumn("dataset_id", F.lit(None).cast("string"))
    d = t(spark, sf, "documents").join(t(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id")),
                                       "doc_id")
    e = t(spark, sf, "embeddings")
    words = F.array_join(F.slice(F.split("text", " "), 1, 3), " ")
    phrases = d.join(e, d.doc_id == e.vec_id, "left").select(
        (F.col("doc_id") + 1_000_000).alias("qid"), words.alias("question"), "embedding",
        F.when(F.col("lang") == "en", F.lit(" all ")).otherwise(F.col("source")).alias("dataset_id"))
    names = t(spark, sf, "nation").select(
        (F.col("n_nationkey").cast("bigint") + 2_000_000).alias("qid"), F.col("n_name").alias("question"),
        F.lit(None).cast("array<float>").alias("embedding"), F.lit("").alias("dataset_id"))
    return passages.unionByName(phrases).unionByName(names)


STORE_SQL = """
  SELECT d.source AS dataset_id, CAST(d.doc_id AS VARCHAR) AS pk, d.text AS text_chunk,
         e.embedding AS embedding
  FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id"""
QUESTIONS_SQL = """
  SELECT b.item_id AS qid, b.text AS question, e.embedding AS qv
  FROM benchmark b JOIN embeddings e ON b.item_id = e.vec_id"""


ASK_SQL = """
  SELECT b.item_id AS qid, b.text AS question, e.embedding AS qv, CAST(NULL AS VARCHAR) AS scope
  FROM benchmark b JOIN embeddings e ON b.item_id = e.vec_id
  UNION ALL
  SELECT d.doc_id + 1000000, array_to_string(string_split(d.text, ' ')[1:3], ' '), e.embedding,
         CASE WHEN d.lang = 'en' THEN NULL ELSE d.source END
  FROM documents d JOIN benchmark b ON b.item_id = d.doc_id LEFT JOIN embeddings e ON d.doc_id = e.vec_id
  UNION ALL
  SELECT n_nationkey + 2000000, n_name, NULL, NULL FROM nation"""
IN_SCOPE_SQL = "(q.scope IS NULL OR q.scope = s.dataset_id)"


def cos_sql(a: str, b: str) -> str:
    a2, b2 = f"CAST({a} AS DOUBLE[])", f"CAST({b} AS DOUBLE[])"
    return (f"(1 - list_dot_product({a2}, {b2}) / "
            f"sqrt(list_dot_product({a2}, {a2}) * list_dot_product({b2}, {b2})))")


def dot_sql(a: str, b: str) -> str:
    return f"list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


NORM_SQL = ("trim(regexp_replace(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'),"
            " '\\s+', ' ', 'g'))")
PREVIEW_SQL = ("CASE WHEN length({x}) > 200 THEN substr({x}, 1, 200) || '…' ELSE {x} END")
