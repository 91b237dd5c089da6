"""Connected components of an edge table, in Spark.

Each round maps every node to the node with the smallest hash among itself
and its neighbours (one aggregation with map-side combine, so a hub costs one
row per task), replaces edges by the edges between those parents and drops
loops and repeats.  Hash order contracts stars in two rounds and chains by a
constant factor a round.  Every round is written to the shared checkpoint
folder; joins on hub nodes are plain equi joins that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm.common import written

MAX_ROUNDS = 100


def _rank(col: str):
    return F.struct(F.xxhash64(col).alias("h"), F.col(col).alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, root): one row for each node of an edge between
    two different nodes; nodes share ``root`` (one of them) iff connected.
    Null ends and loops are ignored; no edges give no rows."""
    e = written(edges.filter("a <> b")
                .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                .distinct(), "edges")
    parents: list[DataFrame] = []
    while not e.isEmpty():
        if len(parents) >= MAX_ROUNDS:
            raise RuntimeError("components did not settle")
        both = e.select(F.col("a").alias("u"), F.col("b").alias("w")).unionByName(
            e.select(F.col("b").alias("u"), F.col("a").alias("w")))
        p = written(both.groupBy("u").agg(F.min(_rank("w")).alias("m"))
                    .select("u", F.least(F.col("m"), _rank("u"))["v"].alias("parent")), "parents")
        parents.append(p)
        pa, pb = (p.select(F.col("u").alias(c), F.col("parent").alias(f"p{c}")) for c in "ab")
        e = written(e.join(pa, "a").join(pb, "b").filter("pa <> pb")
                    .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
                    .distinct(), "edges")
    if not parents:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    lab = parents[0].select(F.col("u").alias("node"), F.col("parent").alias("root"))
    for p in parents[1:]:
        lab = (lab.join(p.withColumnRenamed("u", "root"), "root", "left")
               .select("node", F.coalesce("parent", "root").alias("root")))
    return written(lab, "components")
