"""Per-group ingest trend (last n daily counts) and its 0..1 scaling.

Daily counts are a two-key group-by (partial aggregation before the shuffle,
so a hot group is pre-counted in every task); the last n days per group use
``row_number() <= n``, planned as a WindowGroupLimit; only n points per group
are ever collected into one array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TREND_POINTS = 14


def daily_counts(df: DataFrame, ts: str, group: str) -> DataFrame:
    return (df.groupBy(F.col(group).alias("grp"),
                       F.date_trunc("day", F.col(ts)).alias("day"))
            .agg(F.count(F.lit(1)).alias("n")))


def trend_points(df: DataFrame, ts: str, group: str, n: int = TREND_POINTS) -> DataFrame:
    """(grp, day, n, pos): the last n days with data per group, pos 1 = oldest."""
    d = daily_counts(df, ts, group)
    w = Window.partitionBy("grp").orderBy(F.col("day").desc())
    last = d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    w2 = Window.partitionBy("grp").orderBy("day")
    return last.drop("_r").withColumn("pos", F.row_number().over(w2))


def row_trend(df: DataFrame, ts: str, group: str, n: int = TREND_POINTS) -> DataFrame:
    """(grp, days, points): oldest -> newest arrays of at most n entries."""
    p = trend_points(df, ts, group, n)
    g = p.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("day", "n"))).alias("_s"))
    return g.select("grp", F.transform("_s", lambda x: x["day"]).alias("days"),
                    F.transform("_s", lambda x: x["n"]).alias("points"))


def trend_scale(points: DataFrame, value: str = "n", group: str = "grp") -> DataFrame:
    """y = (v - min) / span per group, span 0 -> 1; non-finite values dropped
    first; groups with fewer than 2 finite points are dropped."""
    v = F.col(value).cast("double")
    finite = points.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    stats = finite.groupBy(group).agg(F.min(value).cast("double").alias("_min"),
                                      F.max(value).cast("double").alias("_max"),
                                      F.count(F.lit(1)).alias("_cnt"))
    span = F.col("_max") - F.col("_min")
    return (finite.join(stats.where(F.col("_cnt") >= 2), group)
            .withColumn("y", (F.col(value).cast("double") - F.col("_min"))
                        / F.when(span == 0, F.lit(1.0)).otherwise(span))
            .drop("_min", "_max", "_cnt"))
