"""Catalog rebuild from what exists, and the per-dataset detail object."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.operators import catalog as cat
from cataloom.sources.tables import dataset_id_of, list_columns


def sync_catalog(spark: SparkSession, tables: dict[str, DataFrame],
                 now: _dt.datetime = cat.DEFAULT_NOW, approx: bool = False,
                 sizes: DataFrame | None = None, rsd: float = 0.05,
                 indexed_dates=None, profile: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(catalog_datasets, catalog_columns) rebuilt in one pass.

    Datasets: one row per table with its row count.  Columns: every column
    with type text, PII flag, indexed flag and null/distinct ratios (always
    the 7-column form).  No tables -> two empty frames.  Distinct counts are
    exact; ``approx=True`` asks for HyperLogLog++ counts of relative error
    ``rsd`` instead.  The size of a table never changes the method.  ``profile``: a
    profile at hand (``profile_store``, which reads only changed files) is used
    instead of reading the tables."""
    if not tables:
        return (spark.createDataFrame([], cat.DATASETS_SCHEMA),
                spark.createDataFrame([], "dataset_id string, column_name string, data_type string, "
                                          "pii_flag boolean, null_ratio double, distinct_ratio double, "
                                          "indexed boolean"))
    present = {n: df for n, df in tables.items() if df is not None}
    prof = profile if profile is not None else cat.profile_columns(present, approx=approx, rsd=rsd)
    # one row per column: materialised once, read by both returned frames
    from cataloom.operators.util import cut_lineage
    prof = cut_lineage(prof)
    # the profile already counted every table's rows: reuse them (missing -> 0)
    counted = prof.groupBy("dataset_id").agg(F.max("row_count").cast("bigint").alias("row_count"))
    names = spark.createDataFrame([(dataset_id_of(n), n) for n in tables], "dataset_id string, table_name string")
    counts_df = names.join(counted, "dataset_id", "left").select(
        "dataset_id", "table_name", F.coalesce("row_count", F.lit(0)).cast("bigint").alias("row_count"))
    datasets = cat.build_datasets(spark, tables, now=now, sizes=sizes, counts=counts_df)
    cols = list_columns(spark, present)
    cols = cat.flag_pii(cols)
    cols = cat.flag_indexed(cols, date_names=indexed_dates) if indexed_dates else cat.flag_indexed(cols)
    columns = (cols.join(prof.select("dataset_id", "column_name", "null_ratio", "distinct_ratio"),
                         ["dataset_id", "column_name"], "left")
               .select("dataset_id", "column_name", "data_type", "pii_flag", "null_ratio",
                       "distinct_ratio", "indexed", "ordinal"))
    return datasets, columns


#: What the detail shows of a column, by name.
DETAIL_FIELDS = ("column_name", "data_type", "pii_flag", "null_ratio", "distinct_ratio", "indexed")


def assemble_detail(datasets: DataFrame, columns: DataFrame,
                    edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(detail, lineage) for every dataset.

    detail: dataset_id, meta struct, columns sorted by name (one array per
    dataset, bounded by the table's width), each with the fields of the catalog
    that ``columns`` has: type, PII flag, null and distinct ratio, indexed.  lineage: every edge touching a
    dataset, newest first (NULL times last).  The
    lineage is a flat, globally sorted frame rather than a per-dataset array:
    the range partitioning of the sort on (dataset_id, time, ...) splits a
    dataset with millions of edges over many tasks."""
    meta = datasets.select("dataset_id", F.struct(*[c for c in datasets.columns]).alias("meta"))
    fields = [c for c in DETAIL_FIELDS if c in columns.columns]
    cols = (columns.groupBy("dataset_id")
            .agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("columns")))
    empty_cols = F.array().cast(cols.schema["columns"].dataType)
    detail = (meta.join(cols, "dataset_id", "left")
              .select("dataset_id", "meta", F.coalesce("columns", empty_cols).alias("columns")))
    from cataloom.operators.lineage import lineage_touching
    ids = datasets.select("dataset_id")
    touching = lineage_touching(edges, ids)
    lineage = touching.orderBy(F.col("dataset_id"), F.col("updated_at").desc_nulls_last(),
                               F.col("src_dataset_id"), F.col("dst_dataset_id"))
    return detail, lineage
