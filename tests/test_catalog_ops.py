"""Catalog frame operators on the driver tables."""

import datetime as dt

from pyspark.sql import functions as F

from cataloom.operators import catalog as cat
from cataloom.plans import sync
from cataloom.sources import tables as src
from tests.conftest import SF_SMALL


def test_row_counts_missing_table_is_zero(spark):
    tabs = {"region": src.read_table(spark, SF_SMALL, "region"), "ghost": None}
    got = {r[0]: r[2] for r in cat.row_counts(spark, tabs).collect()}
    assert got == {"ds_region": 5, "ds_ghost": 0}


def test_profile_ratios_and_empty_table(spark):
    df = spark.createDataFrame([(1, None), (1, "a"), (2, "a"), (None, "b")], "x int, y string")
    empty = spark.createDataFrame([], "x int")
    p = {(r["dataset_id"], r["column_name"]): r for r in
         cat.profile_columns({"t": df, "e": empty}).collect()}
    assert p[("ds_t", "x")]["null_ratio"] == 0.25 and p[("ds_t", "x")]["distinct_ratio"] == 0.5
    assert p[("ds_t", "y")]["null_ratio"] == 0.25 and p[("ds_t", "y")]["distinct_ratio"] == 0.5
    assert p[("ds_e", "x")]["null_ratio"] is None and p[("ds_e", "x")]["distinct_ratio"] is None
    a = {r["column_name"]: r for r in cat.profile_columns({"t": df}, approx=True).collect()}
    assert a["x"]["distinct_ratio"] == 0.5


def test_scan_catalog_orders_nulls_last(spark):
    ds = spark.createDataFrame([("b", None), ("a", "zeta"), ("c", "alpha")], "dataset_id string, name string")
    for c in ("source", "created_at", "row_count", "size_bytes", "last_profiled_at"):
        ds = ds.withColumn(c, F.lit(None).cast("string"))
    order = [r["dataset_id"] for r in cat.scan_catalog(ds).collect()]
    assert order == ["c", "b", "a"]      # 'alpha' < 'b' (coalesce) < 'zeta'


def test_search_filter_lookup(spark):
    ds = cat.build_datasets(spark, src.load_tables(spark, SF_SMALL))
    assert {r[0] for r in cat.search_catalog(ds, "  NATION ").select("name").collect()} == {"nation"}
    assert cat.search_catalog(ds, "   ").count() == 14
    assert cat.filter_source(ds, None).count() == 14
    assert cat.filter_source(ds, "events").count() == 1
    assert cat.lookup_dataset(ds, "ds_orders").count() == 1
    assert cat.lookup_dataset(ds, "nope").count() == 0


def test_size_text(spark):
    df = spark.createDataFrame([(0,), (None,), (1023,), (1024,), (1536,), (1024 ** 6 * 3,)], "n bigint")
    got = [r[0] for r in df.select(cat.size_text("n")).collect()]
    assert got == ["0 B", "0 B", "1023.0 B", "1.0 KB", "1.5 KB", "3072.0 PB"]


def test_display_status(spark):
    df = spark.createDataFrame([(None, None, None), (5, 2048, dt.datetime(2024, 1, 1))],
                               "row_count bigint, size_bytes bigint, last_profiled_at timestamp_ntz")
    rows = cat.display_status(df).collect()
    assert [(r.status, r.row_count_shown, r.size_text) for r in rows] == [
        ("unprofiled", 0, "0 B"), ("profiled", 5, "2.0 KB")]


def test_sync_catalog_and_detail(spark):
    tabs = src.load_tables(spark, SF_SMALL)
    d, c = sync.sync_catalog(spark, tabs)
    assert d.count() == 14 and c.count() == 63
    assert set(c.columns) >= {"dataset_id", "column_name", "data_type", "pii_flag", "null_ratio",
                              "distinct_ratio", "indexed"}
    e0, c0 = sync.sync_catalog(spark, {})
    assert e0.count() == 0 and c0.count() == 0


def test_list_tables_and_sizes(spark):
    names = [r[0] for r in src.list_tables(spark, SF_SMALL).collect()]
    assert len(names) == 14 and names == sorted(names)
    sizes = src.table_size(spark, SF_SMALL).collect()
    assert all(r.size_bytes > 0 for r in sizes)


def test_resolve_table_root_first_existing(spark):
    ds = spark.createDataFrame([("ds_entity_007", "t1", None), ("ds_b", "b", "custom/b"), ("ds_c", "c", None)],
                               "dataset_id string, table_name string, table_path string")
    listing = spark.createDataFrame([("datasets/entity_007",), ("demo/t1",), ("custom/b",)], "root string")
    got = {r.dataset_id: (r.root, r.tried) for r in src.resolve_table_root(ds, listing).collect()}
    assert got["ds_entity_007"][0] == "datasets/entity_007"
    assert got["ds_b"][0] == "custom/b"
    assert got["ds_c"][0] is None and got["ds_c"][1].startswith("datasets/c | demo/c")


def test_approx_profile_within_error(spark):
    li = src.read_table(spark, SF_SMALL, "lineitem")
    ex = {r.column_name: r.distinct_ratio for r in cat.profile_columns({"l": li}).collect()}
    ap = {r.column_name: r.distinct_ratio for r in cat.profile_columns({"l": li}, approx=True, rsd=0.05).collect()}
    for c, v in ex.items():
        assert abs(ap[c] - v) <= 3 * 0.05 * v + 1e-9, (c, v, ap[c])


def test_detail_has_all_fields_of_a_column(spark):
    from cataloom.plans import sync
    t = spark.createDataFrame([(1, None), (2, "x"), (3, "x")], "customer_id int, email string")
    d, c = sync.sync_catalog(spark, {"people": t})
    edges = spark.createDataFrame([], "src_dataset_id string, dst_dataset_id string, transform_type string, "
                                      "updated_at timestamp")
    detail, _ = sync.assemble_detail(d, c, edges)
    got = {x.column_name: x.asDict() for x in detail.first().columns}
    want = {r.column_name: {k: r[k] for k in sync.DETAIL_FIELDS} for r in c.collect()}
    assert got == want and got["email"]["pii_flag"] and abs(got["email"]["null_ratio"] - 1 / 3) < 1e-4


def test_exact_profile_of_every_type(spark):
    long_a, long_b = "x" * 40 + "a", "x" * 40 + "b"
    df = spark.sql(f"""
        SELECT * FROM VALUES
          (1, 0.0D, 'a', X'00', true, DATE'2024-01-01', TIMESTAMP'2024-01-01 00:00:00', 1.10BD, array(0.0D), map('k', 1), named_struct('p', 1, 'q', 'x')),
          (2, -0.0D, '{long_a}', X'0000', false, DATE'2024-01-02', TIMESTAMP'2024-01-01 00:00:00.000001', 1.1BD, array(-0.0D), map('k', 2), named_struct('p', 1, 'q', 'y')),
          (2, double('NaN'), '{long_b}', X'00', NULL, DATE'2024-01-02', NULL, 1.20BD, array(0.0D, 0.0D), map('k', 1), NULL),
          (NULL, double('NaN'), '', NULL, true, NULL, TIMESTAMP'2024-01-01 00:00:00', NULL, NULL, NULL, named_struct('p', NULL, 'q', 'y'))
        AS t(i, d, s, b, f, day, ts, dec, arr, m, st)""").withColumn("we`ird", F.col("s")).withColumn(
            "ntz", F.col("ts").cast("timestamp_ntz"))
    rows = {r.column_name: r for r in cat.profile_columns({"t": df}).collect()}
    for n in df.columns:
        c = F.col("`" + n.replace("`", "``") + "`")
        want = df.agg(F.count_distinct(F.to_json(c) if n == "m" else c), F.count_if(c.isNull())).first()
        assert (rows[n].distinct_ratio * 4, rows[n].null_ratio * 4) == tuple(want), n
    assert [rows[n].ordinal for n in df.columns] == list(range(1, len(df.columns) + 1))


def test_spread_only_of_small_inputs_in_few_files(spark, monkeypatch):
    from cataloom.operators import util
    li = src.read_table(spark, SF_SMALL, "lineitem")
    assert util.spread(li, 4) is li                             # too small to be worth a task
    monkeypatch.setattr(util, "MIN_TASK_BYTES", 1024)
    spread = util.spread(li, 4)
    assert spread is not li and spread.count() == li.count()
    monkeypatch.setattr(util, "SPLIT_BYTES", 1024)
    assert util.spread(li, 4) is li                             # large: the scan has splits enough
    few = spark.range(10)
    assert util.spread(few, 4) is few                           # not a file scan


def test_profile_store_reads_only_changed_files(spark):
    """Files added, changed and removed: only new ones are read, and the profile is that of a full read."""
    import os
    import shutil

    from cataloom.operators.profile_store import ProfileStore
    from cataloom.session import scratch_path
    root = scratch_path(spark, "profiled").removeprefix("file:")

    def add(table, name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/tmp/{name}")
        made = [f for f in os.listdir(f"{root}/tmp/{name}") if f.endswith(".parquet")][0]
        os.makedirs(f"{root}/data/{table}", exist_ok=True)
        shutil.copy(f"{root}/tmp/{name}/{made}", f"{root}/data/{table}/{name}.parquet")

    a, b = "k long, `odd.name` string, v array<double>", "x double, d decimal(9,2)"
    add("a", "one", [(i, f"s{i % 7}", [float(i % 3), -0.0]) for i in range(50)], a)
    add("a", "two", [(i, None if i % 5 == 0 else "s1", None) for i in range(30, 90)], a)
    add("b", "only", [(0.0, None), (-0.0, None), (float("nan"), None), (None, None)], b)

    def full():
        tables = {t: spark.read.parquet(f"{root}/data/{t}") for t in sorted(os.listdir(f"{root}/data"))}
        return {(r.dataset_id, r.column_name): (r.row_count, r.null_ratio, r.distinct_ratio)
                for r in cat.profile_columns(tables).collect()}

    exact, sketch = (ProfileStore(spark, scratch_path(spark, "kept"), e) for e in (True, False))
    assert exact.profile(f"{root}/data").count() == 0

    def check(read):
        for store in (exact, sketch):
            assert [os.path.basename(p) for p in store.sync(f"{root}/data")] == read
            got = {(r.dataset_id, r.column_name): (r.row_count, r.null_ratio, r.distinct_ratio)
                   for r in store.profile(f"{root}/data").collect()}
            want = full()
            if store is exact:
                assert got == want
            else:
                assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
                assert all(abs(got[k][2] - v[2]) <= 0.05 * v[2] + 1e-9 for k, v in want.items())

    check(["one.parquet", "two.parquet", "only.parquet"])
    check([])
    add("a", "three", [(i, "new", [1.0]) for i in range(1000, 1010)], a)
    check(["three.parquet"])
    os.unlink(f"{root}/data/a/one.parquet")
    check([])
    add("b", "more", [(1.5, None)], b)
    check(["more.parquet"])


def test_profile_store_counts_in_bounded_pieces(spark, monkeypatch):
    """A large file is counted by many tasks, with numbers for files, and merged by many."""
    import json

    from cataloom.operators import profile_store
    from cataloom.session import scratch_path
    monkeypatch.setattr(profile_store, "PIECE_BYTES", 20_000, raising=False)
    monkeypatch.setattr(profile_store, "MERGE_ROWS", 500, raising=False)
    root = scratch_path(spark, "pieces").removeprefix("file:")
    rows = spark.range(5000).select("id", (F.col("id") % 7).alias("few"), F.sha2(F.col("id").cast("string"), 512).alias("s"),
                                    F.array(F.col("id") * 0.5, F.lit(-0.0)).alias("v"), F.lit(None).cast("date").alias("d"))
    rows.coalesce(1).write.parquet(f"{root}/t")
    kept = profile_store.ProfileStore(spark, scratch_path(spark, "kept"))
    plans = []
    per = profile_store.ProfileStore._counts
    monkeypatch.setattr(profile_store.ProfileStore, "_counts", lambda *a: plans.append(per(*a)) or plans[-1])
    kept.sync(root)
    plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    keys = next(x for x in plan.splitlines() if "HashAggregate" in x)
    assert "REPARTITION_BY_NUM" in plan and "path" not in keys, json.dumps(keys)
    got = {(r.column_name, r.row_count, r.null_ratio, r.distinct_ratio) for r in kept.profile(root).collect()}
    assert got == {(r.column_name, r.row_count, r.null_ratio, r.distinct_ratio) for r in
                   cat.profile_columns({"t": spark.read.parquet(f"{root}/t")}).collect()}
    assert "REPARTITION_BY_NUM" in kept.profile(root)._jdf.queryExecution().executedPlan().toString()
