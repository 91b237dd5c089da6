"""Catalog operators: the datasets frame, counts, profiles, flags and reads.

Every operator takes and returns DataFrames.  Per-table work (counts,
profiles) is one aggregate per table, unioned into one job; nothing is
collected except schemas.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.functions.text import ntz_lit
from pyspark.sql import types as T

from cataloom.functions import rules
from cataloom.operators.util import maybe_broadcast, spread
from cataloom.sources.tables import dataset_id_of

# Fixed clock used when the caller gives none, so results are repeatable.
DEFAULT_NOW = _dt.datetime(2024, 1, 1, 0, 0, 0)

DATASETS_SCHEMA = T.StructType([
    T.StructField("dataset_id", T.StringType(), False),
    T.StructField("name", T.StringType(), True),
    T.StructField("source", T.StringType(), True),
    T.StructField("created_at", T.TimestampNTZType(), True),
    T.StructField("row_count", T.LongType(), True),
    T.StructField("size_bytes", T.LongType(), True),
    T.StructField("last_profiled_at", T.TimestampNTZType(), True),
    T.StructField("table_name", T.StringType(), True),
])
CATALOG_COLUMNS = ["dataset_id", "name", "source", "created_at", "row_count",
                   "size_bytes", "last_profiled_at"]

# Source label of the driver tables (fixed values for the test catalog).
TPCH_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def default_source(table: str) -> str:
    if table in TPCH_TABLES:
        return "tpch"
    if table == "events":
        return "events"
    return "corpus"


def _union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


# --- #36 row_counts ------------------------------------------------------------

def row_counts(spark: SparkSession, tables: dict[str, DataFrame | None]) -> DataFrame:
    """(dataset_id, table_name, row_count) per table; a missing table counts 0.

    ``count(*)`` on Parquet reads only footers; the per-table aggregates are
    unioned so one job computes them all."""
    frames = []
    for name, df in tables.items():
        if df is None:
            frames.append(spark.range(1).select(
                F.lit(dataset_id_of(name)).alias("dataset_id"),
                F.lit(name).alias("table_name"), F.lit(0).cast("bigint").alias("row_count")))
        else:
            frames.append(df.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(dataset_id_of(name)).alias("dataset_id"),
                F.lit(name).alias("table_name"), F.col("row_count").cast("bigint")))
    return _union_all(frames)


# --- #18 datasets frame -----------------------------------------------------------

def build_datasets(spark: SparkSession, tables: dict[str, DataFrame | None],
                   now: _dt.datetime = DEFAULT_NOW, sources: dict | None = None,
                   sizes: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """catalog_datasets rebuilt from what exists: one row per table.
    ``counts`` (dataset_id, table_name, row_count) can be passed when another
    pass (the profile) has already counted the rows."""
    counts = counts if counts is not None else row_counts(spark, tables)
    src = sources or {}
    src_map = F.create_map(*[x for n in tables for x in
                             (F.lit(n), F.lit(src.get(n, default_source(n))))])
    out = counts.select(
        "dataset_id", F.col("table_name").alias("name"),
        src_map[F.col("table_name")].alias("source"),
        ntz_lit(now).alias("created_at"),
        "row_count",
        F.lit(None).cast("bigint").alias("size_bytes"),
        ntz_lit(now).alias("last_profiled_at"),
        "table_name")
    if sizes is not None:
        out = (out.drop("size_bytes")
               .join(sizes.select("table_name", F.col("size_bytes").cast("bigint")),
                     "table_name", "left")
               .select(*DATASETS_SCHEMA.fieldNames()))
    return out


# --- #37 profile_columns ----------------------------------------------------------

# Longest value that is compared as it is; longer ones by their SHA-256.
INLINE_BYTES = 31


def _short(c: F.Column, plain: F.Column) -> F.Column:
    return F.when(F.octet_length(c) > INLINE_BYTES, F.sha2(c.cast("binary"), 256)).otherwise(plain)


def value_slots(name: str, dt: T.DataType) -> F.Column:
    """A column's value as struct(i long, d double, s string): one slot is set,
    none for NULL, and equal slots mean equal values of that column."""
    c = F.col("`" + name.replace("`", "``") + "`")
    i, d, s = F.lit(None).cast("long"), F.lit(None).cast("double"), F.lit(None).cast("string")
    if isinstance(dt, (T.IntegralType, T.BooleanType)):
        i = c.cast("long")
    elif isinstance(dt, T.DateType):
        i = F.unix_date(c).cast("long")
    elif isinstance(dt, T.TimestampType):
        i = F.unix_micros(c)
    elif isinstance(dt, (T.FloatType, T.DoubleType)):
        d = c.cast("double")
    elif isinstance(dt, T.StringType):
        s = _short(c, c)
    elif isinstance(dt, T.BinaryType):
        s = _short(c, F.hex(c))
    elif isinstance(dt, T.ArrayType) and isinstance(dt.elementType, (T.FloatType, T.DoubleType)):
        text = F.to_json(F.transform(c.cast("array<double>"), lambda x: x + F.lit(0.0)))
        s = _short(text, text)                  # + 0.0: one zero, as in a grouping
    elif isinstance(dt, (T.ArrayType, T.StructType, T.MapType)):
        s = _short(F.to_json(c), F.to_json(c))
    else:                                       # decimals, zone-less times, intervals
        s = c.cast("string")
    return F.struct(i.alias("i"), d.alias("d"), s.alias("s"))


def _exact_profile(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Counts of all columns of all tables by one aggregation.

    Each value becomes a narrow row (column number, value; long values as
    digests), rows are counted per (column, value) with map-side combine, then
    per column: every table is read once and a hot value is one row a task."""
    names, frames = [], []
    for table, df in tables.items():
        first, fields = len(names), df.schema.fields
        names += [(first + j, dataset_id_of(table), f.name, j + 1) for j, f in enumerate(fields)]
        numbers = [str(first + j) for j in range(len(fields))]
        values = spread(df).select(*[value_slots(f.name, f.dataType).alias(n)
                                     for n, f in zip(numbers, fields)])
        frames.append(values.unpivot([], numbers, "c", "v").select(F.col("c").cast("int"), "v.*"))
    per_value = _union_all(frames).groupBy("c", "i", "d", "s").agg(F.count(F.lit(1)).alias("n"))
    null = F.col("i").isNull() & F.col("d").isNull() & F.col("s").isNull()
    per_column = per_value.groupBy("c").agg(
        F.sum("n").alias("row_count"), F.sum(F.when(null, F.col("n")).otherwise(0)).alias("null_count"),
        F.sum(F.when(null, 0).otherwise(1)).alias("distinct_count"))
    schema = spark.createDataFrame(names, "c int, dataset_id string, column_name string, ordinal int")
    return schema.join(per_column, "c", "left").select(        # an empty table has no values
        "dataset_id", "column_name", "ordinal",
        *[F.coalesce(n, F.lit(0).cast("bigint")).alias(n)
          for n in ("row_count", "null_count", "distinct_count")])


def _sketch_profile(name: str, df: DataFrame, rsd: float) -> DataFrame:
    """The same counts of one table with a HyperLogLog++ sketch per column,
    merged map-side (constant memory per column)."""
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, f in enumerate(fields):
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.MapType):           # maps are not comparable: serialize
            col = F.to_json(col)
        aggs.append(F.count_if(col.isNull()).alias(f"_n{i}"))
        aggs.append(F.approx_count_distinct(col, rsd).cast("bigint").alias(f"_d{i}"))
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{f.name.replace(chr(39), chr(39) * 2)}', {i + 1}, _n{i}, _d{i}"
                      for i, f in enumerate(fields))
    return wide.selectExpr(
        f"'{dataset_id_of(name)}' AS dataset_id", "_rows AS row_count",
        f"stack({len(fields)}, {stack}) AS (column_name, ordinal, null_count, distinct_count)")


def profile_columns(tables: dict[str, DataFrame], approx: bool = False,
                    rsd: float = 0.05) -> DataFrame:
    """null_ratio and distinct_ratio of every column of every table.

    ratio = count / rows, NULL for an empty table.  ``approx=True`` uses
    HyperLogLog++ (one sketch per partition, merged map-side) instead of an
    exact distinct, which at scale avoids one shuffle of every value."""
    if approx:
        counts = _union_all([_sketch_profile(n, df, rsd) for n, df in tables.items()])
    else:
        counts = _exact_profile(next(iter(tables.values())).sparkSession, tables)
    return counts.select(
        "dataset_id", "column_name", "ordinal", "row_count",
        F.try_divide(F.col("null_count").cast("double"), F.col("row_count")).alias("null_ratio"),
        F.try_divide(F.col("distinct_count").cast("double"), F.col("row_count")).alias("distinct_ratio"))


# --- #20 / #21 / #24 flags on the columns frame --------------------------------------

def flag_pii(columns: DataFrame, policy: str = rules.CATALOG_PII) -> DataFrame:
    return columns.withColumn("pii_flag", rules.catalog_pii("column_name", policy))


def flag_indexed(columns: DataFrame, rules_df: DataFrame | None = None,
                 date_names=rules.INDEXED_DATE_NAMES) -> DataFrame:
    """indexed flag; ``rules_df(dataset_id, column_name)`` adds per-dataset
    extra names (broadcast: it is a small rules table whose size is checked)."""
    out = columns.withColumn("indexed", rules.indexed("column_name", date_names))
    if rules_df is not None:
        extra = rules_df.select("dataset_id", "column_name").distinct().withColumn("_r", F.lit(True))
        out = (out.join(maybe_broadcast(extra), ["dataset_id", "column_name"], "left")
               .withColumn("indexed", F.col("indexed") | F.coalesce("_r", F.lit(False)))
               .drop("_r"))
    return out


def map_type(columns: DataFrame, extended: bool = False, type_col: str = "data_type") -> DataFrame:
    return columns.withColumn("target_type", rules.map_type(type_col, extended))


# --- #1, #22, #23, #25, #27 reads ----------------------------------------------------

def scan_catalog(datasets: DataFrame) -> DataFrame:
    """The 7 catalog columns ordered by COALESCE(name, dataset_id), NULLs last."""
    return (datasets.select(*CATALOG_COLUMNS)
            .orderBy(F.coalesce("name", "dataset_id").asc_nulls_last()))


def search_catalog(datasets: DataFrame, q: str | None) -> DataFrame:
    """Rows whose 'id name source' text contains the trimmed query (any case)."""
    q = (q or "").strip()
    if not q:
        return datasets
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in
                                     ("dataset_id", "name", "source")]))
    return datasets.where(hay.contains(q.lower()))


def filter_source(datasets: DataFrame, source: str | None) -> DataFrame:
    return datasets if not source else datasets.where(F.col("source") == F.lit(source))


def lookup_dataset(datasets: DataFrame, dataset_id: str) -> DataFrame:
    """Point lookup, at most one row (empty = not found)."""
    return datasets.where(F.col("dataset_id") == F.lit(dataset_id)).limit(1)


# Size units of the byte text.
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def size_text(n) -> F.Column:
    """Bytes as 'x.y UNIT' with base 1024, capped at PB; 0/NULL -> '0 B'."""
    n = F.col(n) if isinstance(n, str) else n
    d = n.cast("double")
    i = F.least(F.floor(F.log(1024.0, d)), F.lit(len(SIZE_UNITS) - 1)).cast("int")
    units = F.array(*[F.lit(u) for u in SIZE_UNITS])
    val = F.round(d / F.pow(F.lit(1024.0), i), 1)
    return (F.when(n.isNull() | (n == 0), F.lit("0 B"))
            .otherwise(F.concat(F.format_string("%.1f", val), F.lit(" "),
                                F.element_at(units, i + 1))))


def display_status(datasets: DataFrame) -> DataFrame:
    return datasets.select(
        "*",
        F.when(F.col("last_profiled_at").isNotNull(), F.lit("profiled"))
         .otherwise(F.lit("unprofiled")).alias("status"),
        F.coalesce(F.col("row_count"), F.lit(0)).cast("bigint").alias("row_count_shown"),
        size_text("size_bytes").alias("size_text"))


# --- #41 schema_infer_by_name --------------------------------------------------------

def schema_infer_by_name(spark: SparkSession, datasets: DataFrame, name_col: str = "name") -> DataFrame:
    """Column template chosen by a substring of the dataset name, exploded to
    (dataset_id, column_name, data_type, pii_flag, ordinal).  The templates are
    a five-row broadcast table (fixed size)."""
    trows = []
    all_t = list(rules.SCHEMA_TEMPLATES) + [((), rules.DEFAULT_TEMPLATE)]
    for tid, (_, cols) in enumerate(all_t):
        for j, (cn, dt, pii) in enumerate(cols, start=1):
            trows.append((tid, cn, dt, pii, j))
    templates = spark.createDataFrame(
        trows, "template_id int, column_name string, data_type string, pii_flag boolean, ordinal int")
    keyed = datasets.select("dataset_id", rules.template_id(F.col(name_col)).alias("template_id"))
    return keyed.join(F.broadcast(templates), "template_id").drop("template_id")
