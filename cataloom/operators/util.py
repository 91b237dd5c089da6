"""Small shared helpers: size-checked broadcast, checkpoints, unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows above which a side is never broadcast (the other way is a shuffle join).
BROADCAST_MAX_ROWS = 200_000
# Bytes above which a side is never broadcast.
BROADCAST_MAX_BYTES = 64 * 1024 * 1024
# Bytes of a read split (the default of spark.sql.files.maxPartitionBytes).
SPLIT_BYTES = 128 * 1024 * 1024
# Stored bytes that are worth a task of their own.
MIN_TASK_BYTES = 1024 * 1024


def bounded_rows(df: DataFrame, max_rows: int) -> int | None:
    """Row count if it is at most ``max_rows`` else None.  Counts at most
    max_rows + 1 rows, so the check itself is bounded."""
    n = df.limit(max_rows + 1).count()
    return n if n <= max_rows else None


def _row_bytes(df: DataFrame) -> Column:
    """Bytes of a row: 8 a field, the length of texts, 8 an array element."""
    size = F.lit(0).cast("long")
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            size = size + F.coalesce(F.size(c), F.lit(0)) * 8
        size = size + 8
    return size


def maybe_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                    max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast hint only when the frame is proven small in rows and bytes (at
    most max_rows + 1 rows are looked at); otherwise leave the join strategy to
    Catalyst/AQE (sort-merge or shuffle-hash)."""
    seen = df.select(_row_bytes(df).alias("b")).limit(max_rows + 1).agg(
        F.count(F.lit(1)).alias("n"), F.sum("b").alias("b")).first()
    return F.broadcast(df) if seen["n"] <= max_rows and (seen["b"] or 0) <= max_bytes else df


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the cluster's ``spark.checkpoint.dir`` (shared
    storage, so it survives executor loss)."""
    from cataloom.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared scratch folder: lineage is cut,
    and later joins are planned from its real size."""
    from cataloom.session import scratch_path
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_index(df: DataFrame, order_cols: list[str], name: str = "idx") -> DataFrame:
    """0-based consecutive index in ``order_cols`` order without a single-task
    window: sort (range-partitioned), tag rows with their partition and
    position, checkpoint, then add each partition's offset (one row per
    partition, so the offsets table is tiny and broadcast)."""
    from pyspark.sql import Window
    tagged = cut_lineage(df.orderBy(*order_cols)
                         .withColumn("_pid", F.spark_partition_id())
                         .withColumn("_mid", F.monotonically_increasing_id()))
    per = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_min"))
    offsets = per.withColumn(
        "_off", F.coalesce(F.sum("_cnt").over(
            Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (tagged.join(F.broadcast(offsets.select("_pid", "_min", "_off")), "_pid")
            .withColumn(name, (F.col("_off") + F.col("_mid") - F.col("_min")).cast("bigint"))
            .drop("_pid", "_mid", "_min", "_off"))


def rank_within(df: DataFrame, keys: list[str], order_cols: list, name: str = "rank") -> DataFrame:
    """1-based position of each row among those of its keys, in ``order_cols`` order, with no
    key in one task: rows are sorted over all tasks by (keys, order), counted in each task, and
    the counts of earlier tasks (a row for each task and key) are added."""
    from pyspark.sql import Window
    tagged = written(df.orderBy(*keys, *order_cols)
                     .withColumn("_pid", F.spark_partition_id())
                     .withColumn("_mid", F.monotonically_increasing_id()), "ranked")
    per = tagged.groupBy(*keys, "_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_pid")) - F.col("_n")
    offsets = per.withColumn("_before", before).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_pid").alias("_p"), "_first", "_before")
    same = F.col("_pid") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    rank = (F.col("_before") + F.col("_mid") - F.col("_first") + 1).cast("int")
    return (tagged.join(offsets, same).withColumn(name, rank)
            .drop("_pid", "_mid", "_p", "_first", "_before", *[f"_k{i}" for i in range(len(keys))]))


def _file_bytes(spark, path: str) -> int:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path))
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen()


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin an input that is too small to fill the cluster.

    A table in fewer files than cores, with less than one read split of bytes
    per core, scans in a few tasks, and CPU-heavy work fused onto the scan
    would run on a few cores.  Only then the rows are shuffled: at most
    ``SPLIT_BYTES`` per core ever move.  Decided from the file list of the plan
    and at most as many file lengths as cores; no job runs."""
    spark = df.sparkSession
    target = min_partitions or spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    if not files or len(files) >= target:
        return df
    size = sum(_file_bytes(spark, f) for f in files)
    if size >= target * SPLIT_BYTES:
        return df
    n = min(target, size // MIN_TASK_BYTES)
    return df.repartition(n) if n > len(files) else df
