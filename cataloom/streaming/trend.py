"""Streaming twin of the ingest trend: daily counts per group, maintained from micro-batches.

A micro-batch adds its own (group, day, count) rows to a change log, in a folder of its number;
a replayed batch overwrites that folder, so nothing is counted twice.  The count of a day is the
sum over the log.  No event is too late: counts need no state that a watermark would have to
close.  ``compact`` folds the log into one base table, so its size follows groups and days, not
batches.  A log belongs to one checkpoint (batch numbers start again with a new one).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cataloom.operators.series import TREND_POINTS

_COUNTS = "grp string, day timestamp_ntz, n long"


def daily_deltas(events: DataFrame, ts: str, group: str) -> DataFrame:
    """(grp, day, n) of some events; days of the wall clock (of the session, for instants)."""
    day = F.col(ts).cast("timestamp_ntz").cast("date").cast("timestamp_ntz")
    return (events.where(F.col(ts).isNotNull())
            .groupBy(F.col(group).cast("string").alias("grp"), day.alias("day"))
            .agg(F.count(F.lit(1)).alias("n")))


def start_daily_counts(events: DataFrame, ts: str, group: str, out_path: str, checkpoint: str,
                       available_now: bool = True) -> StreamingQuery:
    """Start the query; ``available_now`` processes what exists and stops."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        daily_deltas(batch, ts, group).write.mode("overwrite").parquet(
            f"{out_path}/log/batch_id={batch_id}")

    w = events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def _read(spark: SparkSession, path: str, number: str) -> DataFrame:
    try:
        return spark.read.schema(f"{_COUNTS}, {number} long").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{_COUNTS}, {number} long")


def _parts(spark: SparkSession, out_path: str) -> tuple[DataFrame, DataFrame, int]:
    """(newest base, log after it, last batch of the base)."""
    base = _read(spark, f"{out_path}/base", "upto")
    last = base.agg(F.max("upto")).first()[0]           # from folder names
    last = -1 if last is None else last
    log = _read(spark, f"{out_path}/log", "batch_id").where(F.col("batch_id") > last)
    return base.where(F.col("upto") == last), log, last


def current_counts(spark: SparkSession, out_path: str) -> DataFrame:
    """(grp, day, n): the number of events of every group and day seen so far."""
    base, log, _ = _parts(spark, out_path)
    return (base.select("grp", "day", "n").unionByName(log.select("grp", "day", "n"))
            .groupBy("grp", "day").agg(F.sum("n").alias("n")))


def compact(spark: SparkSession, out_path: str) -> int:
    """Fold the log into a new base and return its last batch.  Run it between runs of the
    query.  The new base counts from the moment its folder is complete; older parts are then
    removed, and parts left behind by a failure are not counted again."""
    base, log, last = _parts(spark, out_path)
    newest = log.agg(F.max("batch_id")).first()[0]
    if newest is None:
        return last
    (base.select("grp", "day", "n").unionByName(log.select("grp", "day", "n"))
     .groupBy("grp", "day").agg(F.sum("n").alias("n"))
     .write.mode("overwrite").parquet(f"{out_path}/base/upto={newest}"))
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(out_path).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder, upto in (("log", newest), ("base", newest - 1)):
        home = fs_path(f"{out_path}/{folder}")
        for s in fs.listStatus(home) if fs.exists(home) else ():
            name = s.getPath().getName()
            if "=" in name and int(name.split("=")[1]) <= upto:
                fs.delete(s.getPath(), True)
    return newest


def trend_from_counts(counts: DataFrame, n: int = TREND_POINTS) -> DataFrame:
    """Last n days per group from maintained counts (same rule as row_trend)."""
    from pyspark.sql import Window
    w = Window.partitionBy("grp").orderBy(F.col("day").desc())
    last = counts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    g = last.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("day", "n"))).alias("_s"))
    return g.select("grp", F.transform("_s", lambda x: x["day"]).alias("days"),
                    F.transform("_s", lambda x: x["n"]).alias("points"))
