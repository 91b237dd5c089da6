"""Profiles kept per file, so a catalog sync reads only the files that changed.

For each file of a table the store keeps mergeable counts of every column: exact ones (each
different value of the file once, with its number of rows) or sketches.  A sync compares the
listing of the folder with the files it knows by path, length and time, reads the new and
changed ones, and adds their counts as a version; the row that lists them is written last, so a
failed sync leaves nothing visible.  A profile merges the counts of the files that exist now.
"""

from __future__ import annotations

import math
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cataloom.operators.catalog import value_slots
from cataloom.operators.util import union_all
from cataloom.sources.tables import dataset_id_of, table_of_path

_FILES = "table_name string, path string, length long, modified timestamp, version string"
_VALUES = "table_name string, path string, column_name string, i long, d double, s string, n long"
_SKETCHES = ("table_name string, path string, column_name string, row_count long, "
             "null_count long, sketch binary")
#: Stored bytes of a table whose values a task counts at once, and different values of files that
#: a task merges: both bound the hash map of the task.
PIECE_BYTES = 8 * 1024 * 1024
MERGE_ROWS = 1_000_000
#: Size of a sketch: 2 ** this registers (relative error about 0.8 %).
SKETCH_LG = 14


#: Types whose values take few bytes as they are; the others are moved as text or digest.
_PLAIN = (T.IntegralType, T.BooleanType, T.DateType, T.TimestampType, T.FloatType, T.DoubleType)


def _text_slot(name: str) -> F.Column:
    """A value that is text already, as ``catalog.value_slots`` gives it."""
    return F.struct(F.lit(None).cast("long").alias("i"), F.lit(None).cast("double").alias("d"),
                    F.col(name).alias("s"))


class ProfileStore:
    """``exact``: keep the different values of each file (exact distinct counts); otherwise one
    sketch per file and column (constant size).  A store holds one kind."""

    def __init__(self, spark: SparkSession, path: str, exact: bool = True):
        self.spark, self.path, self.exact = spark, path.rstrip("/"), exact

    def _stored(self, what: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{what}/*")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def listing(self, root: str) -> DataFrame:
        """(table_name, path, length, modified) of the Parquet files below ``root``."""
        files = (self.spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                 .option("pathGlobFilter", "*.parquet").load(root))      # contents are not read
        return files.select(table_of_path(F.col("path"), root).alias("table_name"), "path", "length",
                            F.col("modificationTime").alias("modified"))

    def sync(self, root: str) -> list[str]:
        """Bring the counts up to the files below ``root``; returns the paths that were read
        (as many as the scan that reads them lists anyway)."""
        known = self._stored("files", _FILES).select("path", "length", "modified")
        new = self.listing(root).join(known, ["path", "length", "modified"], "left_anti").collect()
        if not new:
            return []
        version = uuid.uuid4().hex[:12]
        by_table: dict[str, dict[str, int]] = {}
        for r in new:
            by_table.setdefault(r["table_name"], {})[r["path"]] = r["length"]
        frames = [self._counts(table, sizes) for table, sizes in sorted(by_table.items())]
        union_all(frames).write.parquet(f"{self.path}/counts/version={version}")
        self.spark.createDataFrame(
            [(r["table_name"], r["path"], r["length"], r["modified"], version) for r in new],
            _FILES).write.parquet(f"{self.path}/files/{version}")
        return sorted(r["path"] for r in new)

    def _counts(self, table: str, sizes: dict[str, int]) -> DataFrame:
        """Counts of the files of a table (path -> bytes).  Rows of large files are dealt to
        tasks of about ``PIECE_BYTES``, long values as digests; a file is known by a number
        until its values are counted."""
        df = self.spark.read.parquet(*sizes)
        fields = df.schema.fields
        numbers = [str(i) for i in range(len(fields))]
        files = self.spark.createDataFrame(list(enumerate(sizes)), "file int, path string")
        plain = [isinstance(f.dataType, _PLAIN) for f in fields]
        rows = df.select(F.col("_metadata.file_path").alias("path"), *[
            (F.col("`" + f.name.replace("`", "``") + "`") if p else
             value_slots(f.name, f.dataType)["s"]).alias(n) for n, f, p in zip(numbers, fields, plain)])
        # as many rows as files, known from the listing
        rows = rows.join(F.broadcast(files), "path").drop("path")
        pieces = math.ceil(sum(sizes.values()) / PIECE_BYTES)
        if pieces > 1:
            # by a running number: even, and without the sort of a round robin
            rows = rows.withColumn("at", F.monotonically_increasing_id()).repartition(pieces, "at")
        rows = rows.select("file", *[
            (value_slots(n, f.dataType) if p else _text_slot(n)).alias(n)
            for n, f, p in zip(numbers, fields, plain)])
        cells = rows.unpivot("file", numbers, "c", "v").select("file", F.col("c").cast("int"), "v.*")
        names = F.array(*[F.lit(f.name) for f in fields])
        named = [F.lit(table).alias("table_name"), "path",
                 F.element_at(names, F.col("c") + 1).alias("column_name")]
        if self.exact:
            per = cells.groupBy("file", "c", "i", "d", "s").agg(F.count(F.lit(1)).alias("n"))
            return per.join(F.broadcast(files), "file").select(*named, "i", "d", "s", "n")
        null = F.col("i").isNull() & F.col("d").isNull() & F.col("s").isNull()
        zero = (F.col("d") + F.lit(0.0)).alias("d")                # one zero, as in a grouping
        value = F.when(~null, F.to_json(F.struct("i", zero, "s")))
        per = cells.groupBy("file", "c").agg(
            F.count(F.lit(1)).alias("row_count"), F.count_if(null).alias("null_count"),
            F.hll_sketch_agg(value, SKETCH_LG).alias("sketch"))
        return per.join(F.broadcast(files), "file").select(*named, "row_count", "null_count", "sketch")

    def _counted(self) -> DataFrame:
        """The stored counts of all versions."""
        schema = T.StructType.fromDDL(_VALUES if self.exact else _SKETCHES).add("version", "string")
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/counts")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _current(self, root: str) -> DataFrame:
        """Stored counts of the files that exist now, as they are."""
        live = (self._stored("files", _FILES).join(self.listing(root).drop("table_name"),
                                                   ["path", "length", "modified"])
                .select("path", "version").distinct())
        return self._counted().join(live, ["path", "version"])

    def profile(self, root: str) -> DataFrame:
        """(dataset_id, column_name, row_count, null_ratio, distinct_ratio) of the files below
        ``root`` that have been synced; ratios as in ``catalog.profile_columns``."""
        cur = self._current(root)
        if self.exact:
            # dealt first: values of a table in one file are different, so nothing would be
            # combined before a shuffle; the rows are counted from the files' footers
            value = ["table_name", "column_name", "i", "d", "s"]
            tasks = math.ceil(self._counted().count() / MERGE_ROWS)
            cur = cur.select(*value, "n")
            cur = cur.repartition(tasks, *value) if tasks > 1 else cur
            per = cur.groupBy(*value).agg(F.sum("n").alias("n"))
            null = F.col("i").isNull() & F.col("d").isNull() & F.col("s").isNull()
            counts = per.groupBy("table_name", "column_name").agg(
                F.sum("n").alias("row_count"),
                F.sum(F.when(null, F.col("n")).otherwise(0)).alias("null_count"),
                F.sum(F.when(null, 0).otherwise(1)).alias("distinct_count"))
        else:
            counts = cur.groupBy("table_name", "column_name").agg(
                F.sum("row_count").alias("row_count"), F.sum("null_count").alias("null_count"),
                F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_count"))
        prefix = dataset_id_of("")
        return counts.select(
            F.concat(F.lit(prefix), "table_name").alias("dataset_id"), "column_name", "row_count",
            F.try_divide(F.col("null_count").cast("double"), F.col("row_count")).alias("null_ratio"),
            F.try_divide(F.col("distinct_count").cast("double"), F.col("row_count"))
            .alias("distinct_ratio"))
