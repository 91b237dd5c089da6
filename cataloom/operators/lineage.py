"""Dataset lineage over an edge-list DataFrame
(src_dataset_id, dst_dataset_id, transform_type, updated_at).

Closure is a breadth-first search written as equi joins, several hops to a
round: a round joins the frontier hop by hop with the edges, keeps the shortest
count of each (root, node), drops what earlier rounds reached, and is written
below ``spark.checkpoint.dir``, so a lost executor recomputes one round, not the
whole history.  A hot node (one source with a third of all edges) is a skewed
join key: AQE's skew-join split handles it.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.functions.text import ntz_lit

from cataloom.operators.util import spread, union_all, with_index, written

EDGE_COLUMNS = ["src_dataset_id", "dst_dataset_id", "transform_type", "updated_at"]
# Fixed values of the derived lineage: edge kinds and the 1 hour lag of ingest.
INGEST, MODEL = "ingest", "model"
DOWNSTREAM_EVERY = 3


def edges_from_orders(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Test lineage from the driver tables: cust_<c> -> ord_<o> (priority,
    order date) and ord_<o> -> item_<o>_<line> ('ship', ship date)."""
    e1 = orders.select(
        F.concat(F.lit("cust_"), F.col("o_custkey").cast("string")).alias("src_dataset_id"),
        F.concat(F.lit("ord_"), F.col("o_orderkey").cast("string")).alias("dst_dataset_id"),
        F.col("o_orderpriority").alias("transform_type"),
        F.col("o_orderdate").alias("updated_at"))
    e2 = lineitem.select(
        F.concat(F.lit("ord_"), F.col("l_orderkey").cast("string")).alias("src_dataset_id"),
        F.concat(F.lit("item_"), F.col("l_orderkey").cast("string"), F.lit("_"),
                 F.col("l_linenumber").cast("string")).alias("dst_dataset_id"),
        F.lit("ship").alias("transform_type"),
        F.col("l_shipdate").alias("updated_at"))
    return e1.unionByName(e2)


def lineage_touching(edges: DataFrame, ids: DataFrame, id_col: str = "dataset_id") -> DataFrame:
    """Edges where src = id OR dst = id, for every id of ``ids``.

    The OR join is two equi joins (hash-joinable) unioned; a self-loop is
    reported once."""
    i = ids.select(F.col(id_col).alias("dataset_id")).distinct()
    by_src = edges.join(i, edges.src_dataset_id == i.dataset_id)
    by_dst = (edges.where(F.col("src_dataset_id") != F.col("dst_dataset_id"))
              .join(i, edges.dst_dataset_id == i.dataset_id))
    cols = ["dataset_id"] + EDGE_COLUMNS
    return by_src.select(*cols).unionByName(by_dst.select(*cols))


def lineage_for(edges: DataFrame, dataset_id: str) -> DataFrame:
    """One dataset's edges, newest first (NULL times last)."""
    return (edges.where((F.col("src_dataset_id") == dataset_id) | (F.col("dst_dataset_id") == dataset_id))
            .orderBy(F.col("updated_at").desc_nulls_last(), "src_dataset_id", "dst_dataset_id"))


def lineage_derive(datasets: DataFrame, now: _dt.datetime | None = None,
                   index_col: str | None = None) -> DataFrame:
    """Edges implied by the catalog: ``<source_snake>_<name>_raw -> id``
    ('ingest', one hour before profiling) for every dataset, and
    ``id -> <name>_mart`` ('model', at profiling time) for every third dataset
    in dataset_id order (or ``index_col`` order)."""
    nowc = ntz_lit(now or _dt.datetime(2024, 1, 1))
    t = F.coalesce(F.col("last_profiled_at").cast("timestamp_ntz"), nowc)
    d = datasets if index_col else with_index(datasets, ["dataset_id"], "_idx")
    idx = F.col(index_col) if index_col else F.col("_idx")
    snake = F.lower(F.regexp_replace(F.col("source"), r"\s+", "_"))
    up = d.select(F.concat(snake, F.lit("_"), F.col("name"), F.lit("_raw")).alias("src_dataset_id"),
                  F.col("dataset_id").alias("dst_dataset_id"), F.lit(INGEST).alias("transform_type"),
                  (t - F.expr("INTERVAL 1 HOUR")).alias("updated_at"))
    down = d.where(idx % DOWNSTREAM_EVERY == 0).select(
        F.col("dataset_id").alias("src_dataset_id"),
        F.concat(F.col("name"), F.lit("_mart")).alias("dst_dataset_id"),
        F.lit(MODEL).alias("transform_type"), t.alias("updated_at"))
    return up.unionByName(down)


# Hops of the first round of a closure, and the most of a later one.
FIRST_HOPS, MOST_HOPS = 4, 16


def lineage_closure(edges: DataFrame, roots: DataFrame, direction: str = "downstream",
                    max_hops: int | None = None, root_col: str = "root") -> DataFrame:
    """(root, node, hops): every node reachable from each root, at its
    shortest hop count; a root is reached by itself at no hops and is not reported.

    A round walks several hops in one plan (4, then 8, then 16 at a time) without
    looking back, keeps the shortest count of each pair and compares only the result
    with what was reached before; pairs at its last hop are the next frontier.  It
    ends when a round's last hop reaches nothing new, or at ``max_hops``."""
    if direction.startswith("down"):
        e = edges.select(F.col("src_dataset_id").alias("node"), F.col("dst_dataset_id").alias("next"))
    else:
        e = edges.select(F.col("dst_dataset_id").alias("node"), F.col("src_dataset_id").alias("next"))
    # Edges and rounds are written tables: no round reads the source again, and
    # Catalyst plans each join from real sizes (a small frontier is broadcast, a
    # large one is shuffled, with AQE splits for a hot node).  The hops of a round
    # share one shuffle of the edges.
    e = written(spread(e.where("node IS NOT NULL AND next IS NOT NULL AND node <> next")), "edges")
    start = roots.select(F.col(root_col).alias("root")).where("root IS NOT NULL").distinct()
    frontier = start.select("root", F.col("root").alias("node"))
    reached: list[DataFrame] = []
    hop, step = 0, FIRST_HOPS
    while max_hops is None or hop < max_hops:
        last = hop + step if max_hops is None else min(hop + step, max_hops)
        walks, now = [], frontier
        for h in range(hop + 1, last + 1):
            now = (now.join(e, "node").select("root", F.col("next").alias("node"))
                   .where("root <> node").distinct())
            walks.append(now.withColumn("hops", F.lit(h)))
        new = union_all(walks).groupBy("root", "node").agg(F.min("hops").alias("hops"))
        if reached:
            new = new.join(union_all(reached).select("root", "node"), ["root", "node"], "left_anti")
        new = written(new, "reached")             # one table for each round
        reached.append(new)
        frontier = new.where(F.col("hops") == last).select("root", "node")
        if frontier.isEmpty():
            break
        hop, step = last, min(2 * step, MOST_HOPS)
    if not reached:
        return frontier.select("root", "node", F.lit(0).alias("hops")).limit(0)
    return union_all(reached)


def lineage_dangling(nodes: DataFrame, edges: DataFrame, node_col: str = "node_id") -> DataFrame:
    """Integrity report: edges whose src or dst is not a node, and nodes that
    no edge touches.  Columns: kind, src_dataset_id, dst_dataset_id, node_id."""
    n = nodes.select(F.col(node_col).alias("_n")).distinct()
    bad_src = (edges.join(n, edges.src_dataset_id == n._n, "left_anti")
               .select(F.lit("missing_src").alias("kind"), "src_dataset_id", "dst_dataset_id",
                       F.lit(None).cast("string").alias("node_id")))
    bad_dst = (edges.join(n, edges.dst_dataset_id == n._n, "left_anti")
               .select(F.lit("missing_dst").alias("kind"), "src_dataset_id", "dst_dataset_id",
                       F.lit(None).cast("string").alias("node_id")))
    ends = (edges.select(F.col("src_dataset_id").alias("_n"))
            .unionByName(edges.select(F.col("dst_dataset_id").alias("_n"))).distinct())
    orphans = (n.join(ends, "_n", "left_anti")
               .select(F.lit("orphan_node").alias("kind"),
                       F.lit(None).cast("string").alias("src_dataset_id"),
                       F.lit(None).cast("string").alias("dst_dataset_id"),
                       F.col("_n").alias("node_id")))
    return bad_src.unionByName(bad_dst).unionByName(orphans)
