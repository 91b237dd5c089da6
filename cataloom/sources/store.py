"""Sinks and table changes.

Plain Parquet has no MERGE/DELETE, so every change is an anti join plus a
write.  The embedding store is a catalog table partitioned by dataset_id:
replacing a dataset writes a new folder, points the partition to it (or drops it
when the new data is empty) and then removes the old files.  Counted results are materialised with a
reliable checkpoint before the write, so the count and the write see the same
rows.
"""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cataloom.operators.util import BROADCAST_MAX_ROWS, cut_lineage, maybe_broadcast
from cataloom.sources.ledger import KeyLedger

# Rows of one written file of a dataset.
ROWS_PER_FILE = 1_000_000
STORE_SCHEMA = "dataset_id string, pk string, text_chunk string, embedding array<float>"


def _ident(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)?", name):
        raise ValueError(f"bad table name {name!r}")
    return name


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


# --- #11 create_table_typed --------------------------------------------------------

def create_table_typed(spark: SparkSession, path: str, schema, table: str | None = None,
                       partition_by: list[str] | None = None, if_not_exists: bool = True) -> DataFrame:
    """Typed, empty Parquet table at ``path`` (registered as ``table`` when
    given); returns the table read back."""
    st = schema if isinstance(schema, T.StructType) else spark.createDataFrame([], schema).schema
    if table:
        # materialise the (empty, typed) location first so the table never
        # points at a missing folder
        w0 = spark.createDataFrame([], st).write.mode("ignore")
        (w0.partitionBy(*partition_by) if partition_by else w0).parquet(path)
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in st.fields)
        part = f" PARTITIONED BY ({', '.join(partition_by)})" if partition_by else ""
        ine = "IF NOT EXISTS " if if_not_exists else ""
        spark.sql(f"CREATE TABLE {ine}{_ident(table)} ({cols}) USING parquet{part} "
                  f"LOCATION {_lit(path)}")
        return spark.table(table)
    w = spark.createDataFrame([], st).write.mode("ignore" if if_not_exists else "errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.schema(st).parquet(path)


def ensure_store(spark: SparkSession, table: str, path: str, schema: str = STORE_SCHEMA) -> DataFrame:
    """The embedding store table, partitioned by dataset_id."""
    return create_table_typed(spark, path, schema, table=table, partition_by=["dataset_id"])


# --- #12 replace_by_dataset --------------------------------------------------------------

def _location(spark: SparkSession, table: str, dataset_id: str | None = None) -> str | None:
    """Where the table, or one partition of it, is stored; None without that partition."""
    part = "" if dataset_id is None else f" PARTITION (dataset_id = {_lit(dataset_id)})"
    try:
        rows = spark.sql(f"DESCRIBE FORMATTED {_ident(table)}{part}").collect()
    except AnalysisException as e:
        if dataset_id is not None and e.getCondition() == "PARTITIONS_NOT_FOUND":
            return None
        raise
    return [r["data_type"] for r in rows if r["col_name"] == "Location"][0 if part else -1]


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def replace_by_dataset(spark: SparkSession, new: DataFrame, table: str,
                       dataset_ids: list[str] | None = None,
                       on_duplicate: str = "error", rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Replace every listed dataset's rows by ``new``'s rows for it.

    The new rows are written beside the old ones, in a folder of their own below the
    table's; then each partition is pointed to its new folder (one catalog change per
    dataset; a listed dataset without rows loses its partition), and the old files are
    removed last.  A run that fails before the switch leaves the old rows visible and
    at most an unused folder.  ``on_duplicate``: 'error' fails when (dataset_id, pk)
    repeats, 'keep_first' keeps the first by text.  A row without a dataset is an error.
    Rows are materialised once, then clustered by (dataset_id, hash(pk) mod the
    dataset's row count over ``rows_per_file``), so the number of writing tasks
    of a dataset follows its size.  Returns the table read back."""
    cols = spark.table(table).columns
    data = new.select(*cols)
    if on_duplicate == "keep_first":
        data = dedupe_batch(data, ["dataset_id", "pk"], ["text_chunk"]).select(*cols)
    data = cut_lineage(data)
    if on_duplicate == "error":
        dup = (data.groupBy("dataset_id", "pk").agg(F.count(F.lit(1)).alias("c"))
               .where("c > 1").limit(1).collect())
        if dup:
            raise ValueError(f"duplicate key {dup[0]['dataset_id']}/{dup[0]['pk']}")
    files = F.ceil(F.count(F.lit(1)) / F.lit(rows_per_file))
    sizes = data.groupBy("dataset_id").agg(files.alias("n")).collect()   # catalog names
    present = {r["dataset_id"]: i for i, r in enumerate(sizes)}
    if None in present:
        raise ValueError("rows without a dataset_id")
    root = f"{_location(spark, table)}/_versions/{uuid.uuid4().hex[:12]}"
    if present:
        _write_version(data, [(r["dataset_id"], present[r["dataset_id"]], r["n"]) for r in sizes], root)
    name, old = _ident(table), []
    key_ledger(spark, table, ["dataset_id", "pk"]).forget()
    for d in sorted(present):
        old.append(_location(spark, table, d))
        part = f"PARTITION (dataset_id = {_lit(d)})"
        to = f"{root}/_part={present[d]}"
        if old[-1] is None:
            spark.sql(f"ALTER TABLE {name} ADD {part} LOCATION {_lit(to)}")
        else:
            spark.sql(f"ALTER TABLE {name} {part} SET LOCATION {_lit(to)}")
    for d in sorted(set(dataset_ids or []) - set(present)):
        old.append(_location(spark, table, d))
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION (dataset_id = {_lit(d)})")
    spark.catalog.refreshTable(table)
    for path in old:
        if path is not None:
            _remove(spark, path)
    return spark.table(table)


def _write_version(data: DataFrame, parts: list[tuple], root: str) -> None:
    """A folder for each dataset (numbered: names may hold any character)."""
    numbers = data.sparkSession.createDataFrame(parts, "dataset_id string, _part int, _files long")
    (data.join(F.broadcast(numbers), "dataset_id")           # one row for each dataset
     .repartition("_part", F.pmod(F.xxhash64("pk"), F.col("_files")))
     .drop("dataset_id", "_files").write.partitionBy("_part").parquet(root))


def key_ledger(spark: SparkSession, table: str, keys: list[str]) -> KeyLedger:
    """The ledger that is kept next to a store table (a hidden folder)."""
    return KeyLedger(spark, f"{_location(spark, table)}/_keys", keys)


def append_absent(spark: SparkSession, new: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """Append the rows of ``new`` whose key the *table* doesn't have, through the
    table, so its partitions are known; returns the rows that were added.  Keys are
    looked up in the table's ledger; the stored rows are not read."""
    cols = spark.table(table).columns
    batch = dedupe_batch(new.select(*cols), keys)
    ledger = key_ledger(spark, table, keys)
    fresh = cut_lineage(ledger.absent(batch, spark.table(table)).select(*cols))
    noted = ledger.begin(fresh)
    fresh.write.insertInto(table)
    spark.catalog.refreshTable(table)
    ledger.commit(noted)
    return fresh


# --- #13 insert_if_absent --------------------------------------------------------------------

def dedupe_batch(new: DataFrame, keys: list[str], order_by: list[str] | None = None) -> DataFrame:
    """First row per key (smallest ``order_by``, else smallest row).

    A ``min_by`` aggregate, not a window: partial aggregation keeps one row
    per key per task before the shuffle, so a key repeated in a third of all
    rows never lands in one task as a whole."""
    rest = [c for c in new.columns if c not in keys]
    if not rest:
        return new.select(*keys).distinct()
    order = order_by or rest
    row = F.struct(*[F.col(c) for c in rest])
    rank = F.struct(*[F.col(c) for c in order], F.xxhash64(*[F.col(c) for c in rest]).alias("_h"))
    g = new.groupBy(*keys).agg(F.min_by(row, rank).alias("_r"))
    return g.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*new.columns)


def read_or_none(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame | None:
    """The table at ``path``; None only when the path does not exist."""
    try:
        return spark.read.format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def insert_if_absent(spark: SparkSession, new: DataFrame, target_path: str, keys: list[str],
                     order_by: list[str] | None = None, fmt: str = "parquet",
                     partition_by: list[str] | None = None,
                     ledger: bool = False) -> tuple[DataFrame, int]:
    """``INSERT ... ON CONFLICT (keys) DO NOTHING``: dedupe the batch, drop the keys the
    target has, append.  Returns (target after, number of rows actually inserted).
    ``ledger``: keys are looked up in a ledger below the target (the first of ``keys`` is the
    dataset) instead of in the target's rows."""
    after, fresh = insert_absent_rows(spark, new, target_path, keys, order_by, fmt, partition_by, ledger)
    return after, fresh.count()


def insert_absent_rows(spark: SparkSession, new: DataFrame, target_path: str, keys: list[str],
                       order_by: list[str] | None = None, fmt: str = "parquet",
                       partition_by: list[str] | None = None,
                       ledger: bool = False) -> tuple[DataFrame, DataFrame]:
    """As ``insert_if_absent``, but returns the inserted rows."""
    batch = dedupe_batch(new, keys, order_by)
    existing = read_or_none(spark, target_path, fmt)
    book = KeyLedger(spark, f"{target_path.rstrip('/')}/_keys", keys) if ledger else None
    if book is not None:
        fresh = book.absent(batch, batch.limit(0) if existing is None else existing)
    else:
        fresh = batch if existing is None else batch.join(existing.select(*keys), keys, "left_anti")
    fresh = cut_lineage(fresh)          # the rows that are counted are those written
    noted = book.begin(fresh) if book else None
    w = fresh.write.mode("append").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(target_path)
    if book:
        book.commit(noted)
    return spark.read.format(fmt).load(target_path), fresh


# --- #14 / #15 / #16 catalog changes -------------------------------------------------------------

def upsert_dataset(datasets: DataFrame, updates: DataFrame) -> DataFrame:
    """Delete rows whose id *or* name matches an update, then add the updates.
    The OR is two left-anti equi joins; repeated updates of an id count once."""
    updates = dedupe_batch(updates.select(*datasets.columns), ["dataset_id"])
    u_ids = updates.select("dataset_id").distinct()
    u_names = updates.where(F.col("name").isNotNull()).select("name").distinct()
    kept = (datasets.join(maybe_broadcast(u_ids), "dataset_id", "left_anti")
            .join(maybe_broadcast(u_names), "name", "left_anti"))
    return kept.select(*datasets.columns).unionByName(updates.select(*datasets.columns))


def update_attrs(target: DataFrame, updates: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """``UPDATE target SET cols = updates.cols WHERE key matches`` (NULL in an
    update keeps the old value); of repeated updates of a key the smallest row counts."""
    updates = dedupe_batch(updates.select(key, *cols), [key])
    u = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in cols])
    j = target.join(u, key, "left")
    for c in cols:
        j = j.withColumn(c, F.coalesce(F.col(f"_new_{c}"), F.col(c)))
    return j.select(*target.columns)


def delete_cascade(datasets: DataFrame, columns: DataFrame, edges: DataFrame,
                   ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove datasets from the three catalog frames; an edge goes when its
    src or dst is removed (two anti joins)."""
    i = maybe_broadcast(ids.select("dataset_id").distinct(), BROADCAST_MAX_ROWS)
    d = datasets.join(i, "dataset_id", "left_anti")
    c = columns.join(i, "dataset_id", "left_anti")
    e = (edges.join(i.withColumnRenamed("dataset_id", "src_dataset_id"), "src_dataset_id", "left_anti")
         .join(i.withColumnRenamed("dataset_id", "dst_dataset_id"), "dst_dataset_id", "left_anti")).select(*edges.columns)
    return d, c, e


# --- #17 drop_all -------------------------------------------------------------------------------

def drop_all(spark: SparkSession, database: str) -> DataFrame:
    """Drop every table of a database and verify none is left.  Returns
    (table_name, dropped) plus the count left after."""
    names = [t.name for t in spark.catalog.listTables(_ident(database)) if not t.isTemporary]
    for n in names:
        spark.sql(f"DROP TABLE IF EXISTS {_ident(database)}.`{n}`")
    left = len([t for t in spark.catalog.listTables(database) if not t.isTemporary])
    return spark.createDataFrame([(n, True, left) for n in names],
                                 "table_name string, dropped boolean, left_after bigint")


def unique_name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:10]}"
