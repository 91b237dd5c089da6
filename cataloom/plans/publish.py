"""Publish: table rows -> text chunks with stable keys -> vectors -> store.

One lazy DataFrame per dataset (scan -> PII guard -> chunk text -> key), all
datasets unioned, embedded in Arrow batches, and written with one
partition-replacing write.  Column choice happens at plan time, so the Parquet
scan reads only the kept columns and the key candidates.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.functions import rules
from cataloom.functions.vector import sanitize_vector
from cataloom.operators.chunk import chunk_frame, pk_expr, row_to_json
from cataloom.operators.embed import embed_text
from cataloom.operators.util import union_all
from cataloom.sources import store as sink
from cataloom.sources.tables import scan_rows_limit


def publish_chunks(tables: dict[str, DataFrame], limit: int | None = None,
                   include=None, exclude=None, guard: str | None = rules.PUBLISH_PII,
                   hash_key: bool = False) -> DataFrame:
    """(dataset_id, pk, text_chunk) for every dataset (``limit=None`` = whole tables)."""
    parts = []
    for ds, df in tables.items():
        rows = scan_rows_limit(df, limit) if limit else df
        parts.append(chunk_frame(rows, ds, include, exclude, guard, hash_key))
    return union_all(parts)


def publish(spark: SparkSession, tables: dict[str, DataFrame], store_table: str,
            limit: int | None = None, include=None, exclude=None,
            embedder: Callable | None = None, dims: int = 64, truncate: bool = True,
            on_duplicate: str = "error", hash_key: bool = False) -> DataFrame:
    """Publish every dataset into the store table; returns the summary
    (dataset_id, status, total_rows, inserted, target): rows of the input, and
    rows this run wrote.  ``truncate=False`` appends the rows whose key the
    table doesn't have.  Vectors are stored rounded and finite."""
    chunks = publish_chunks(tables, limit, include, exclude, hash_key=hash_key)
    vectors = stored(embed_text(chunks, "text_chunk", dims=dims, embedder=embedder))
    if truncate:
        added = sink.replace_by_dataset(spark, vectors, store_table, list(tables), on_duplicate)
        added = added.where(F.col("dataset_id").isin(list(tables)))
    else:
        added = sink.append_absent(spark, vectors, store_table, ["dataset_id", "pk"])
    counts = added.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("inserted"))
    totals = chunks.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("total_rows"))
    names = spark.createDataFrame([(d,) for d in tables], "dataset_id string")
    out = names.join(totals, "dataset_id", "left").join(counts, "dataset_id", "left")
    for c in ("total_rows", "inserted"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0)).cast("bigint"))
    return out.select(
        "dataset_id",
        F.when(F.col("inserted") > 0, F.lit("published")).otherwise(F.lit("no-new-rows")).alias("status"),
        "total_rows", "inserted", F.lit(store_table).alias("target"))


def stored(vectors: DataFrame) -> DataFrame:
    """Vectors as the store holds them: finite, rounded, single precision."""
    return vectors.withColumn("embedding", sanitize_vector("embedding").cast("array<float>"))


def publish_append(spark: SparkSession, resolved: DataFrame, warehouse: str, store_path: str,
                   limit: int | None = None, embedder: Callable | None = None,
                   dims: int = 64) -> DataFrame:
    """Legacy publish: for each resolved dataset root read the table, whole
    row as JSON text, embed, insert-if-absent on (dataset_id, pk).  The list
    of roots is catalog metadata (one row per dataset), read on the driver to
    plan one scan per dataset; the data itself never leaves the executors."""
    plan = [(r["dataset_id"], r["root"], r["tried"]) for r in
            resolved.select("dataset_id", "root", "tried").collect()]
    parts, meta = [], []
    for ds, root, tried in plan:
        meta.append((ds, root, tried))
        if root is None:
            continue
        df = spark.read.parquet(f"{warehouse.rstrip('/')}/{root}")
        if limit:
            df = scan_rows_limit(df, limit)
        key = F.coalesce(pk_expr(df.columns), F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256))
        j = row_to_json(df).select(F.lit(ds).alias("dataset_id"), key.alias("pk"), "text_chunk")
        parts.append(j)
    summary = spark.createDataFrame(meta, "dataset_id string, chosen_path string, tried_paths string")
    if not parts:
        return summary.withColumn("total_rows", F.lit(0).cast("bigint")).withColumn(
            "inserted", F.lit(0).cast("bigint"))
    batch = stored(embed_text(union_all(parts), "text_chunk", dims=dims, embedder=embedder))
    batch = batch.select("dataset_id", "pk", "text_chunk", "embedding")
    totals = batch.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("total_rows"))
    _, added = sink.insert_absent_rows(spark, batch, store_path, ["dataset_id", "pk"], ledger=True)
    ins = added.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("inserted"))
    return (summary.join(totals, "dataset_id", "left").join(ins, "dataset_id", "left")
            .select("dataset_id", "chosen_path", "tried_paths",
                    F.coalesce("total_rows", F.lit(0)).cast("bigint").alias("total_rows"),
                    F.coalesce("inserted", F.lit(0)).cast("bigint").alias("inserted")))
