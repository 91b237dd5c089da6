"""Registered lineage and series queries (#58-#63)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cataloom.operators import lineage as lin
from cataloom.operators import series
from cataloom.queries import query, r6, t

EDGES_SQL = """
  SELECT 'cust_' || CAST(o_custkey AS VARCHAR) AS src_dataset_id, 'ord_' || CAST(o_orderkey AS VARCHAR) AS dst_dataset_id,
         o_orderpriority AS transform_type, o_orderdate AS updated_at FROM orders
  UNION ALL
  SELECT 'ord_' || CAST(l_orderkey AS VARCHAR), 'item_' || CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR),
         'ship', l_shipdate FROM lineitem"""


def _edges(spark, sf):
    return lin.edges_from_orders(t(spark, sf, "orders"), t(spark, sf, "lineitem"))


@query("lineage_touching", f"""
WITH e AS ({EDGES_SQL}), ids AS (SELECT 'ord_' || CAST(o_orderkey AS VARCHAR) AS dataset_id FROM orders)
SELECT ids.dataset_id, e.* FROM e JOIN ids ON e.src_dataset_id = ids.dataset_id OR e.dst_dataset_id = ids.dataset_id""")
def q_lineage_touching(spark, sf):
    """Every order's edges (its customer edge and its line-item edges)."""
    ids = t(spark, sf, "orders").select(
        F.concat(F.lit("ord_"), F.col("o_orderkey").cast("string")).alias("dataset_id"))
    return lin.lineage_touching(_edges(spark, sf), ids)


@query("lineage_derive", """
WITH d AS (SELECT 'ds_' || CAST(s_suppkey AS VARCHAR) AS dataset_id, s_name AS name,
                  'Supplier Nation ' || CAST(s_nationkey AS VARCHAR) AS source,
                  TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(s_suppkey AS INTEGER)) AS last_profiled_at
           FROM supplier),
di AS (SELECT *, row_number() OVER (ORDER BY dataset_id) - 1 AS idx FROM d)
SELECT lower(regexp_replace(source, '\\s+', '_', 'g')) || '_' || name || '_raw' AS src_dataset_id,
       dataset_id AS dst_dataset_id, 'ingest' AS transform_type, last_profiled_at - INTERVAL 1 HOUR AS updated_at FROM di
UNION ALL
SELECT dataset_id, name || '_mart', 'model', last_profiled_at FROM di WHERE idx % 3 = 0""")
def q_lineage_derive(spark, sf):
    """Suppliers as catalog datasets; derived ingest/model edges."""
    s = t(spark, sf, "supplier").select(
        F.concat(F.lit("ds_"), F.col("s_suppkey").cast("string")).alias("dataset_id"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("Supplier Nation "), F.col("s_nationkey").cast("string")).alias("source"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
         + F.make_dt_interval(days=F.col("s_suppkey").cast("int"))).alias("last_profiled_at"))
    return lin.lineage_derive(s)


@query("lineage_closure", f"""
WITH RECURSIVE e AS ({EDGES_SQL}),
r(root, node, hops) AS (
  SELECT 'cust_' || CAST(c_custkey AS VARCHAR), 'cust_' || CAST(c_custkey AS VARCHAR), 0 FROM customer
  UNION
  SELECT r.root, e.dst_dataset_id, r.hops + 1 FROM r JOIN e ON e.src_dataset_id = r.node WHERE r.hops < 10)
SELECT root, node, CAST(min(hops) AS INTEGER) AS hops FROM r WHERE hops > 0 GROUP BY root, node""")
def q_lineage_closure(spark, sf):
    """Everything downstream of every customer (orders, then line items)."""
    roots = t(spark, sf, "customer").select(
        F.concat(F.lit("cust_"), F.col("c_custkey").cast("string")).alias("root"))
    return lin.lineage_closure(_edges(spark, sf), roots, "downstream", max_hops=10)


@query("lineage_dangling", f"""
WITH e AS ({EDGES_SQL}),
n AS (SELECT 'cust_' || CAST(c_custkey AS VARCHAR) AS node_id FROM customer
      UNION SELECT 'ord_' || CAST(o_orderkey AS VARCHAR) FROM orders)
SELECT 'missing_src' AS kind, src_dataset_id, dst_dataset_id, NULL AS node_id FROM e
  WHERE src_dataset_id NOT IN (SELECT node_id FROM n)
UNION ALL SELECT 'missing_dst', src_dataset_id, dst_dataset_id, NULL FROM e
  WHERE dst_dataset_id NOT IN (SELECT node_id FROM n)
UNION ALL SELECT 'orphan_node', NULL, NULL, node_id FROM n
  WHERE node_id NOT IN (SELECT src_dataset_id FROM e UNION SELECT dst_dataset_id FROM e)""")
def q_lineage_dangling(spark, sf):
    """Nodes = customers and orders: item edges dangle, customers without
    orders are orphans."""
    c = t(spark, sf, "customer").select(F.concat(F.lit("cust_"), F.col("c_custkey").cast("string")).alias("node_id"))
    o = t(spark, sf, "orders").select(F.concat(F.lit("ord_"), F.col("o_orderkey").cast("string")).alias("node_id"))
    e = _edges(spark, sf).select("src_dataset_id", "dst_dataset_id")
    return lin.lineage_dangling(c.unionByName(o), e)


TREND_SQL = """
WITH d AS (SELECT event_type AS grp, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1, 2),
l AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY day DESC) AS r FROM d)"""


@query("row_trend", f"""{TREND_SQL}
SELECT grp, string_agg(CAST(n AS VARCHAR), ',' ORDER BY day) AS points,
       strftime(min(day), '%Y-%m-%d') AS first_day, CAST(count(*) AS BIGINT) AS n_points
FROM l WHERE r <= 14 GROUP BY grp""")
def q_row_trend(spark, sf):
    tr = series.row_trend(t(spark, sf, "events"), "ts", "event_type", 14)
    return tr.select("grp", F.array_join(F.transform("points", lambda x: x.cast("string")), ",").alias("points"),
                     F.date_format(F.element_at("days", 1), "yyyy-MM-dd").alias("first_day"),
                     F.size("points").cast("bigint").alias("n_points"))


@query("trend_scale", f"""{TREND_SQL},
p AS (SELECT grp, day, n FROM l WHERE r <= 14),
s AS (SELECT grp, min(n) AS mn, max(n) AS mx, count(*) AS c FROM p GROUP BY grp)
SELECT p.grp, strftime(p.day, '%Y-%m-%d') AS day, CAST(p.n AS BIGINT) AS n,
       round((p.n - s.mn) / CASE WHEN s.mx = s.mn THEN 1.0 ELSE CAST(s.mx - s.mn AS DOUBLE) END, 6) AS y
FROM p JOIN s USING (grp) WHERE s.c >= 2""")
def q_trend_scale(spark, sf):
    p = series.trend_points(t(spark, sf, "events"), "ts", "event_type", 14)
    sc = series.trend_scale(p, "n", "grp")
    return sc.select("grp", F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("n").cast("bigint").alias("n"),
                     r6("y").alias("y"))
