"""Join shapes used by the catalog: NOT EXISTS, per-row counts, scalar
subqueries.  All are equi joins or joins with a one-row aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def anti_join_new(new: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key does not exist in ``target`` (NOT EXISTS).

    A left-anti join; Catalyst picks broadcast or sort-merge by size, and AQE
    splits a skewed key's partition."""
    return new.join(target.select(*keys).distinct(), keys, "left_anti")


def lateral_count(left: DataFrame, right: DataFrame, key: str, out: str = "cnt") -> DataFrame:
    """``LEFT JOIN LATERAL (SELECT count(*) ...) ON TRUE`` with COALESCE 0:
    aggregate the right side first (partial aggregation before the shuffle,
    so a hot key is pre-counted per task), then one left equi join."""
    counts = right.groupBy(key).agg(F.count(F.lit(1)).alias(out))
    return (left.join(counts, key, "left")
            .withColumn(out, F.coalesce(F.col(out), F.lit(0)).cast("bigint")))


def scalar_subquery(df: DataFrame, aggs: dict[str, Column],
                    source: DataFrame | None = None) -> DataFrame:
    """Attach aggregates of ``source`` (default ``df``) to every row as SCALAR
    subqueries (``DataFrame.scalar()``); Catalyst merges subqueries over the
    same plan into one aggregate job and inlines the value."""
    src = df if source is None else source
    out = df
    for name, agg in aggs.items():
        out = out.withColumn(name, src.agg(agg).scalar())
    return out
