"""Lineage (closure vs brute force, touching, dangling, derive) and the trend series."""

import datetime as dt
from collections import deque

from pyspark.sql import functions as F

from cataloom.operators import lineage as lin
from cataloom.operators import series

EDGE = "src_dataset_id string, dst_dataset_id string, transform_type string, updated_at timestamp_ntz"


def _edges(spark, pairs):
    return spark.createDataFrame([(a, b, "t", dt.datetime(2024, 1, 1 + i % 20)) for i, (a, b) in enumerate(pairs)],
                                 EDGE)


def _bfs(pairs, root, max_hops=None):
    adj = {}
    for a, b in pairs:
        adj.setdefault(a, []).append(b)
    seen, out, dq = {root}, {}, deque([(root, 0)])
    while dq:
        n, h = dq.popleft()
        if max_hops is not None and h >= max_hops:
            continue
        for m in adj.get(n, []):
            if m not in seen:
                seen.add(m)
                out[m] = h + 1
                dq.append((m, h + 1))
    return out


def test_closure_matches_bfs_with_cycle(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("d", "e"), ("b", "e")]
    e = _edges(spark, pairs)
    roots = spark.createDataFrame([("a",), ("x",), ("z",)], "root string")
    got = {(r.root, r.node): r.hops for r in lin.lineage_closure(e, roots).collect()}
    want = {(r, n): h for r in ("a", "x", "z") for n, h in _bfs(pairs, r).items()}
    assert got == want
    up = {(r.root, r.node): r.hops for r in
          lin.lineage_closure(e, spark.createDataFrame([("e",)], "root string"), "upstream").collect()}
    assert up[("e", "b")] == 1 and up[("e", "a")] == 2
    capped = lin.lineage_closure(e, roots, max_hops=1).collect()
    assert {(r.root, r.node) for r in capped} == {("a", "b"), ("x", "y")}


def test_closure_of_long_chains_and_cycles(spark):
    """Several rounds: a chain of 40 hops, a ring, a hub, repeated edges and loops."""
    pairs = [(f"n{i}", f"n{i + 1}") for i in range(40)] + [("n10", "n25"), ("n30", "n5"), ("n7", "n7")]
    pairs += [(f"r{i}", f"r{(i + 1) % 23}") for i in range(23)] + [("n3", "r0"), ("r20", "n39")]
    pairs += [("hub", f"n{i}") for i in range(0, 40, 3)] + pairs[:5]
    roots = ["n0", "n12", "r4", "hub", "nowhere", "n40"]
    e = _edges(spark, pairs).unionByName(_edges(spark, [(None, "n1"), ("n1", None)]))
    asked = spark.createDataFrame([(r,) for r in roots + [None, "n0"]], "root string")
    for cap in (None, 1, 4, 5, 11, 40):
        rows = lin.lineage_closure(e, asked, max_hops=cap).collect()
        want = {(r, n): h for r in roots for n, h in _bfs(pairs, r, cap).items()}
        assert {(r.root, r.node): r.hops for r in rows} == want and len(rows) == len(want)
    assert lin.lineage_closure(e, asked, max_hops=0).count() == 0
    assert lin.lineage_closure(e, asked.limit(0)).count() == 0


def test_touching_self_loop_once(spark):
    e = _edges(spark, [("a", "a"), ("a", "b"), ("c", "a"), ("c", "d")])
    ids = spark.createDataFrame([("a",)], "dataset_id string")
    got = sorted((r.src_dataset_id, r.dst_dataset_id) for r in lin.lineage_touching(e, ids).collect())
    assert got == [("a", "a"), ("a", "b"), ("c", "a")]
    newest = [r.dst_dataset_id for r in lin.lineage_for(e, "a").collect()]
    assert newest[0] == "a" or len(newest) == 3


def test_dangling_on_demo_graph(spark):
    nodes = spark.createDataFrame([(n,) for n in ["db2", "fivetran", "Snowflake", "transform_silver",
                                                  "current_dataset"]], "node_id string")
    edges = spark.createDataFrame([("db2", "fivetran"), ("fivetran", "transform_bronze"),
                                   ("transform_bronze", "transform_silver"),
                                   ("transform_silver", "current_dataset")],
                                  "src_dataset_id string, dst_dataset_id string")
    rep = lin.lineage_dangling(nodes, edges).collect()
    bad = [r for r in rep if r.kind != "orphan_node"]
    assert len({(r.src_dataset_id, r.dst_dataset_id) for r in bad}) == 2
    assert [r.node_id for r in rep if r.kind == "orphan_node"] == ["Snowflake"]


def test_derive_every_third(spark):
    ds = spark.createDataFrame([(f"ds_{i:03d}", f"n{i}", "SAP ECC", dt.datetime(2025, 8, 20, 12, i))
                                for i in range(1, 8)],
                               "dataset_id string, name string, source string, last_profiled_at timestamp_ntz")
    e = lin.lineage_derive(ds).collect()
    ups = [r for r in e if r.transform_type == "ingest"]
    downs = sorted(r.src_dataset_id for r in e if r.transform_type == "model")
    assert len(ups) == 7 and ups[0].src_dataset_id.startswith("sap_ecc_n")
    assert downs == ["ds_001", "ds_004", "ds_007"]
    r1 = [r for r in ups if r.dst_dataset_id == "ds_001"][0]
    assert r1.updated_at == dt.datetime(2025, 8, 20, 11, 1)


def test_row_trend_last_14(spark):
    rows = [(dt.datetime(2024, 1, d, 10), "g") for d in range(1, 21) for _ in range(d)]
    rows += [(dt.datetime(2024, 1, 3), "h")]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, kind string")
    tr = {r.grp: r for r in series.row_trend(df, "ts", "kind").collect()}
    assert tr["g"].points == list(range(7, 21)) and len(tr["g"].days) == 14
    assert tr["h"].points == [1]


def test_trend_scale(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", float("nan")), ("b", 5.0), ("b", 5.0),
                                ("c", 2.0), ("c", float("inf"))], "grp string, n double")
    out = {(r.grp, r.n): r.y for r in series.trend_scale(df).collect()}
    assert out == {("a", 1.0): 0.0, ("a", 3.0): 1.0, ("b", 5.0): 0.0}
