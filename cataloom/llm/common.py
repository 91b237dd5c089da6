"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cataloom.session import scratch_path
from cataloom.sources.tables import read_table

#: Texts are handled in blocks of about this many characters, so the memory of
#: a task does not follow the number of rows in an Arrow batch.
BLOCK_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The named columns of a table (all others, clashing names too, are pruned)."""
    return read_table(spark, sf_dir, name).select(*cols)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared checkpoint folder and read back, so
    neither a lost executor nor a second reader computes ``df`` again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def positions(df: DataFrame, order_cols: list[str]) -> DataFrame:
    """``df`` with ``idx``, the 0-based place of a row in the order of ``order_cols``: sorted over
    all tasks and written with each row's place in its task, then shifted by the rows of the
    tasks before (one number for each task)."""
    part, at = F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")
    rows = written(df.orderBy(*order_cols).select("*", part, at), "ordered")
    tasks = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n") - F.col("_first")
    shift = tasks.select("_part", before.alias("_shift"))
    return (rows.join(F.broadcast(shift), "_part")
            .withColumn("idx", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift"))


def own_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like the wanted ones that ``df`` doesn't have (names differ in more than
    case), for columns an operator adds for itself."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column as Python strings; null is the empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def blocks(texts: list[str], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """(from, to) row ranges of about ``limit`` characters each."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def sub_batches(batches: Iterator[pa.RecordBatch], name: str
                ) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Batches cut into blocks, each with its texts."""
    for b in batches:
        if b.num_rows:
            texts = texts_of(b, name)
            for lo, hi in blocks(texts):
                yield b.slice(lo, hi - lo), texts[lo:hi]


def out(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A record batch from columns (lists, numpy arrays or Arrow arrays)."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) and c.type == f.type
         else pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type)
         for c, f in zip(columns, schema)], schema=schema)


def ascii_lower(col):
    """Lower-case A-Z only (Unicode letters stay), inside generated code."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def most_frequent(counts: DataFrame, n_col: str, limit: int) -> DataFrame:
    """The rows with the largest counts, whole count classes, at most ``limit`` rows
    (all of them if there are fewer): a size bound without a global sort."""
    steps = (counts.groupBy(F.floor(F.log2(F.col(n_col).cast("double")) * 8).alias("step"))
             .agg(F.count(F.lit(1)).alias("rows"), F.min(n_col).alias("low"))
             .orderBy(F.desc("step")).collect())  # at most 8 rows for each power of two
    total, low = 0, None
    for s in steps:
        if (total := total + s["rows"]) > limit:
            break
        low = s["low"]
    return counts.filter(F.lit(False) if low is None else F.col(n_col) >= low)


def hash_sample(df: DataFrame, key_cols: list[str], rows: int) -> DataFrame:
    """About ``rows`` rows at most, chosen by a hash of their keys (all if there are fewer):
    the same rows whatever the partitioning, without a sort."""
    n = df.count()
    if n <= rows:
        return df
    spread = 1 << 40
    return df.filter(F.pmod(F.xxhash64(F.lit("sample"), *key_cols), F.lit(spread))
                     < int(spread * (rows / n)))


def held_out(col):
    """Rows no model may learn labels from: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (in place on a fresh array); published constants."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def numbers(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random odd 64-bit multipliers."""
    with np.errstate(over="ignore"):
        base = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return mix64(base + np.uint64(seed)) | np.uint64(1)


def range_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values[start:end] per range (empty ranges give 0)."""
    total = np.zeros(len(values) + 1, dtype=np.float64)
    np.cumsum(values, dtype=np.float64, out=total[1:])
    return total[ends] - total[starts]
