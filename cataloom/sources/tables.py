"""Table sources: reading datasets, listing tables/columns/files, samples.

Listing is done with Spark itself (``binaryFile`` with the content column
pruned reads only file metadata, in parallel), and schemas come from
``df.schema`` - driver metadata, no rows read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLE_NAMES = ("region", "nation", "customer", "supplier", "part", "orders",
               "lineitem", "events", "documents", "embeddings", "pages",
               "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, root: str, name: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(f"{root.rstrip('/')}/{name}.{fmt}")


def load_tables(spark: SparkSession, root: str, names=TABLE_NAMES) -> dict[str, DataFrame]:
    """name -> lazy DataFrame for every table of a directory."""
    return {n: read_table(spark, root, n) for n in names}


# --- #7 type_name ----------------------------------------------------------

def type_name(dt: T.DataType) -> str:
    """Source-style type text of a Spark type (bigint, varchar, decimal(12,2),
    timestamp(6), array(varchar), map(varchar, varchar), row(a bigint, ...))."""
    simple = {
        T.ByteType: "tinyint", T.ShortType: "smallint", T.IntegerType: "integer",
        T.LongType: "bigint", T.FloatType: "real", T.DoubleType: "double",
        T.BooleanType: "boolean", T.StringType: "varchar", T.BinaryType: "varbinary",
        T.DateType: "date", T.TimestampNTZType: "timestamp(6)",
        T.TimestampType: "timestamp(6) with time zone",
    }
    for cls, name in simple.items():
        if isinstance(dt, cls):
            return name
    if isinstance(dt, T.DecimalType):
        return f"decimal({dt.precision},{dt.scale})"
    if isinstance(dt, T.ArrayType):
        return f"array({type_name(dt.elementType)})"
    if isinstance(dt, T.MapType):
        return f"map({type_name(dt.keyType)}, {type_name(dt.valueType)})"
    if isinstance(dt, T.StructType):
        return "row(" + ", ".join(f"{f.name} {type_name(f.dataType)}" for f in dt.fields) + ")"
    return dt.simpleString()


# --- #6 list_columns ---------------------------------------------------------

COLUMNS_SCHEMA = T.StructType([
    T.StructField("dataset_id", T.StringType(), False),
    T.StructField("table_name", T.StringType(), False),
    T.StructField("column_name", T.StringType(), False),
    T.StructField("data_type", T.StringType(), False),
    T.StructField("ordinal", T.IntegerType(), False),
])


def dataset_id_of(table: str) -> str:
    return f"ds_{table}"


def list_columns(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(dataset_id, table_name, column_name, data_type, ordinal) of every table.

    Built from ``df.schema`` only; the result is as large as the schemas, not
    the data."""
    rows = []
    for name, df in tables.items():
        for i, f in enumerate(df.schema.fields, start=1):
            rows.append((dataset_id_of(name), name, f.name, type_name(f.dataType), i))
    return spark.createDataFrame(rows, COLUMNS_SCHEMA)


# --- #5 list_tables / #38 table_size ----------------------------------------

def list_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, rel_path, length) of every file below ``root``; contents unread."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.load(root).select("path", "length")
    return df.withColumn("rel_path", _below(F.col("path"), root))


def _below(path, root: str) -> F.Column:
    """The part of a file path below ``root``, whatever scheme either is written with."""
    plain = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root.rstrip("/"))
    return F.regexp_replace(path, "^.*?" + re.escape(plain) + "/", "")


def table_of_path(path, root: str) -> F.Column:
    """The table a file below ``root`` belongs to."""
    return _table_of(_below(path, root))


def _table_of(rel_path) -> F.Column:
    first = F.split(rel_path, "/").getItem(0)
    return F.regexp_replace(first, r"\.parquet$", "")


def list_tables(spark: SparkSession, root: str) -> DataFrame:
    """Tables of a directory (a ``name.parquet`` file or a ``name/`` folder), by name."""
    files = list_files(spark, root, "*.parquet")
    return (files.select(_table_of(F.col("rel_path")).alias("table_name"))
            .distinct().orderBy("table_name"))


def table_size(spark: SparkSession, root: str) -> DataFrame:
    """(table_name, size_bytes, n_files): summed file sizes per table."""
    files = list_files(spark, root, "*.parquet")
    return (files.groupBy(_table_of(F.col("rel_path")).alias("table_name"))
            .agg(F.sum("length").alias("size_bytes"), F.count("*").alias("n_files")))


# --- #2 / #3 scans -------------------------------------------------------------

def scan_path_sample(spark: SparkSession, path: str, fmt: str = "parquet", n: int = 50,
                     order_by=None) -> DataFrame:
    """First n rows of a path-addressed table, in key order (a sample is the feature)."""
    df = spark.read.format(fmt).load(path)
    order = order_by or [df.columns[0]]
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in order]).limit(n)


def scan_rows_limit(df: DataFrame, limit: int | None = 200, order_by=None) -> DataFrame:
    """``SELECT * ... LIMIT n`` feeding publish; ``limit=None`` = whole table."""
    if limit is None:
        return df
    if not isinstance(limit, int) or limit <= 0:
        raise ValueError("limit must be a positive integer")
    order = order_by or [df.columns[0]]
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in order]).limit(limit)


# --- #4 resolve_table_root -----------------------------------------------------

def root_candidates(datasets: DataFrame, name_col: str = "table_name") -> DataFrame:
    """(dataset_id, pos, candidate) in probing order: table_path, data_path,
    datasets/NAME, datasets/entity_NNN (for ds_entity_NNN ids), demo/NAME,
    NAME.parquet, NAME."""
    from cataloom.functions.text import id_to_entity
    cols = set(datasets.columns)
    n = F.col(name_col)
    cands = [
        F.col("table_path") if "table_path" in cols else F.lit(None).cast("string"),
        F.col("data_path") if "data_path" in cols else F.lit(None).cast("string"),
        F.concat(F.lit("datasets/"), n),
        F.concat(F.lit("datasets/"), id_to_entity(F.col("dataset_id"))),
        F.concat(F.lit("demo/"), n),
        F.concat(n, F.lit(".parquet")),
        n,
    ]
    return (datasets.select("dataset_id", F.posexplode(F.array(*cands)).alias("pos", "candidate"))
            .where(F.col("candidate").isNotNull() & (F.col("candidate") != "")))


def resolve_table_root(datasets: DataFrame, listing: DataFrame,
                       name_col: str = "table_name") -> DataFrame:
    """First candidate root that exists in ``listing(root)``, plus all tried.

    One equi-join of every dataset's candidates with the listing of existing
    roots (no per-dataset probing)."""
    cands = root_candidates(datasets, name_col)
    roots = listing.select(F.col("root").alias("candidate")).distinct()
    hit = cands.join(roots.withColumn("_exists", F.lit(True)), "candidate", "left")
    return (hit.groupBy("dataset_id").agg(
        F.min_by(F.when(F.col("_exists"), F.col("candidate")),
                 F.when(F.col("_exists"), F.col("pos"))).alias("root"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "candidate"))),
                                 lambda x: x["candidate"]), " | ").alias("tried")))
