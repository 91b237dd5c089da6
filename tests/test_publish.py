"""Row -> chunk/key/vector, sinks and the publish plan."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from cataloom.functions.vector import sanitize_vector
from cataloom.operators import chunk
from cataloom.operators.embed import embed_text
from cataloom.plans import publish as pub
from cataloom.session import scratch_path
from cataloom.sources import store as sink


def test_row_to_chunk_format(spark):
    df = spark.createDataFrame(
        [(1, 2.0, 2.5, "", None, dt.datetime(2024, 1, 2, 3, 4, 5, 678000), ["a", "b"], True)],
        "id bigint, price double, rate double, empty string, missing string, ts timestamp_ntz, "
        "tags array<string>, flag boolean")
    txt = chunk.row_to_chunk(df).first().text_chunk
    assert txt == ("flag: true\nid: 1\nprice: 2\nrate: 2.5\ntags: [\"a\",\"b\"]\n"
                   "ts: 2024-01-02T03:04:05.678Z")


def test_pick_pk_and_hash(spark):
    df = spark.createDataFrame([(None, "", 7), ("A1", None, 8), (None, None, None)],
                               "acct_number string, id string, customer_id int")
    got = [r.pk for r in chunk.pick_pk(df).collect()]
    assert got == ["7", "A1", None]
    two = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x")], "a int, b string")
    h = [r.pk for r in chunk.hash_pk(two).collect()]
    assert h[0] == h[1] != h[2] and len(h[0]) == 64


def test_row_to_json_keeps_nulls(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert chunk.row_to_json(df).first().text_chunk == '{"a":1,"b":null}'


def test_chunk_frame_key_leak_and_hash_option(spark):
    df = spark.createDataFrame([("123-45", "x@y.z", "hello")], "acct_number string, email string, note string")
    r = chunk.chunk_frame(df, "ds").first()
    assert r.pk == "123-45" and r.text_chunk == "acct_number: 123-45\nnote: hello"
    r2 = chunk.chunk_frame(df, "ds", exclude=["ACCT_NUMBER"], hash_key=True).first()
    assert r2.text_chunk == "note: hello" and len(r2.pk) == 64


def test_embed_text_norm_and_dims(spark):
    df = spark.createDataFrame([(1, "Hello world, hello!"), (2, "?? !!"), (3, None)], "id int, t string")
    out = embed_text(df, "t", dims=16).orderBy("id").collect()
    v = np.asarray(out[0].embedding)
    assert len(v) == 16 and abs(np.linalg.norm(v) - 1) < 1e-6
    assert np.allclose(out[1].embedding, 0) and np.allclose(out[2].embedding, 0)
    same = embed_text(df, "t", dims=16).orderBy("id").first().embedding
    assert same == out[0].embedding                      # deterministic


def test_embed_text_plugin_and_size_check(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(250)], "id int, t string")
    fn = lambda texts: np.ones((len(texts), 4))          # noqa: E731
    assert embed_text(df, "t", dims=4, embedder=fn).where(F.size("embedding") == 4).count() == 250
    with pytest.raises(Exception):
        embed_text(df, "t", dims=5, embedder=fn).collect()


def test_sanitize_vector(spark):
    df = spark.createDataFrame([([1.23456789, float("nan"), float("inf"), None, -2.0],)],
                               "v array<double>")
    assert df.select(sanitize_vector("v")).first()[0] == [1.234568, 0.0, 0.0, 0.0, -2.0]


def test_replace_by_dataset_idempotent_and_empty_deletes(spark):
    name = sink.unique_name("t_store")
    sink.ensure_store(spark, name, scratch_path(spark, "t_store"))
    a = spark.createDataFrame([("a", "1", "x", [1.0]), ("a", "2", "y", [1.0]), ("b", "1", "z", [2.0])],
                              sink.STORE_SCHEMA)
    one = sorted(tuple(r) for r in sink.replace_by_dataset(spark, a, name, ["a", "b"]).collect())
    two = sorted(tuple(r) for r in sink.replace_by_dataset(spark, a, name, ["a", "b"]).collect())
    assert one == two and len(one) == 3
    after = sink.replace_by_dataset(spark, a.where("dataset_id = 'a'"), name, ["a", "b"])
    assert {r.dataset_id for r in after.collect()} == {"a"}
    dup = spark.createDataFrame([("c", "1", "x", [1.0]), ("c", "1", "y", [1.0])], sink.STORE_SCHEMA)
    with pytest.raises(ValueError):
        sink.replace_by_dataset(spark, dup, name, ["c"])
    kept = sink.replace_by_dataset(spark, dup, name, ["c"], on_duplicate="keep_first")
    assert kept.where("dataset_id = 'c'").first().text_chunk == "x"


def test_insert_if_absent_twice_adds_zero(spark):
    path = scratch_path(spark, "t_ins")
    b = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    after, n1 = sink.insert_if_absent(spark, b, path, ["k"])
    assert n1 == 2 and after.count() == 2
    after, n2 = sink.insert_if_absent(spark, b, path, ["k"])
    assert n2 == 0 and after.count() == 2


def test_upsert_update_delete(spark):
    d = spark.createDataFrame([("ds1", "orders", "x"), ("ds2", "users", "y"), ("ds3", "other", "z")],
                              "dataset_id string, name string, source string")
    u = spark.createDataFrame([("ds9", "users", "new"), ("ds1", "orders2", "new")],
                              "dataset_id string, name string, source string")
    got = sorted(tuple(r) for r in sink.upsert_dataset(d, u).collect())
    assert got == [("ds1", "orders2", "new"), ("ds3", "other", "z"), ("ds9", "users", "new")]
    upd = sink.update_attrs(d, spark.createDataFrame([("ds2", None, "w")], "dataset_id string, name string, source string"),
                            "dataset_id", ["name", "source"])
    assert sorted(tuple(r) for r in upd.collect())[1] == ("ds2", "users", "w")
    edges = spark.createDataFrame([("ds1", "ds2"), ("ds2", "ds3"), ("ds3", "ds1")],
                                  "src_dataset_id string, dst_dataset_id string")
    cols = spark.createDataFrame([("ds1", "c"), ("ds2", "c")], "dataset_id string, column_name string")
    dd, cc, ee = sink.delete_cascade(d, cols, edges, spark.createDataFrame([("ds1",)], "dataset_id string"))
    assert dd.count() == 2 and cc.count() == 1 and [tuple(r) for r in ee.collect()] == [("ds2", "ds3")]


def test_publish_summary_and_no_new_rows(spark):
    name = sink.unique_name("t_pub")
    sink.ensure_store(spark, name, scratch_path(spark, "t_pub"))
    tabs = {"t1": spark.createDataFrame([(i, f"n{i}", f"u{i}@x.y") for i in range(300)],
                                        "id bigint, name string, email string"),
            "t2": spark.createDataFrame([], "id bigint, name string")}
    s = {r.dataset_id: r for r in pub.publish(spark, tabs, name, limit=200, dims=8).collect()}
    assert s["t1"].status == "published" and s["t1"].inserted == 200
    assert s["t2"].status == "no-new-rows" and s["t2"].inserted == 0
    stored = spark.table(name).where("dataset_id = 't1'")
    assert stored.where(F.col("text_chunk").contains("email")).count() == 0   # PII guard
    assert stored.select("pk").distinct().count() == 200


def test_double_text_without_exponent(spark):
    from pyspark.sql import types as T

    from cataloom.functions.text import value_text
    vals = [12345678.9, 0.0001, -0.00012345, 2.0, 1e20, 711.56, -98765432.125]
    df = spark.createDataFrame([(v,) for v in vals], "d double")
    got = [r[0] for r in df.select(value_text(df.d, T.DoubleType())).collect()]
    assert got == ["12345678.9", "0.0001", "-0.00012345", "2", "100000000000000000000", "711.56",
                   "-98765432.125"]


def test_publish_whole_table_and_append_through_it(spark):
    name = sink.unique_name("store")
    path = scratch_path(spark, "store")
    sink.ensure_store(spark, name, path)
    rows = spark.range(1000).withColumn("v", F.lit("x"))
    got = [pub.publish(spark, {"d": df}, name, dims=4, truncate=False).first()[1:4]
           for df in (rows.limit(1), rows, rows)]
    assert got == [("published", 1, 1), ("published", 1000, 999), ("no-new-rows", 1000, 0)]
    assert spark.table(name).count() == 1000
    assert pub.publish(spark, {"d": rows}, name, dims=4).first()[1:4] == ("published", 1000, 1000)
    sink.replace_by_dataset(spark, spark.table(name).limit(0), name, ["d"])
    assert spark.table(name).count() == 0
    assert pub.publish(spark, {"d": rows}, name, dims=4, truncate=False).first()[3] == 1000
    assert spark.table(name).count() == 1000


def test_stored_vectors_are_finite(spark):
    name = sink.unique_name("store")
    sink.ensure_store(spark, name, scratch_path(spark, "store"))
    pub.publish(spark, {"d": spark.range(3)}, name, dims=2,
                embedder=lambda texts: [[float("nan"), 0.12345678]] * len(texts))
    assert {tuple(r.embedding) for r in spark.table(name).collect()} == {(0.0, float(np.float32(0.123457)))}


def test_repeated_updates_count_once(spark):
    t = spark.createDataFrame([("a", "n", 1)], "dataset_id string, name string, x int")
    u = spark.createDataFrame([("a", "m", 3), ("a", "l", 2)], "dataset_id string, name string, x int")
    assert sink.update_attrs(t, u, "dataset_id", ["name"]).collect() == [("a", "l", 1)]
    assert sink.upsert_dataset(t, u).collect() == [("a", "l", 2)]


def test_only_a_missing_path_is_no_table(spark, tmp_path):
    assert sink.read_or_none(spark, str(tmp_path / "none")) is None
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        sink.read_or_none(spark, str(tmp_path / "bad")).count()


def _store_rows(spark, name):
    return sorted((r.dataset_id, r.pk, r.text_chunk) for r in spark.table(name).select("dataset_id", "pk", "text_chunk").collect())


def test_replace_switches_in_one_step(spark, monkeypatch):
    """A run that fails between write and switch shows the old rows; names may hold any character."""
    import glob
    name, path = sink.unique_name("switch"), scratch_path(spark, "switch")
    sink.ensure_store(spark, name, path)

    def frame(rows):
        return spark.createDataFrame([(d, k, t, [1.0]) for d, k, t in rows], sink.STORE_SCHEMA)

    odd = "a b/c=d:'e%"
    first = [("x", "1", "old"), ("x", "2", "old"), (odd, "1", "old"), ("gone", "1", "old")]
    sink.replace_by_dataset(spark, frame(first), name)
    assert _store_rows(spark, name) == sorted(first)
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    real = sink._location
    monkeypatch.setattr(sink, "_location", lambda s, t, d=None: real(s, t, d) if d is None else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        sink.replace_by_dataset(spark, frame([("x", "1", "new")]), name, ["x", "gone"])
    monkeypatch.setattr(sink, "_location", real)
    assert _store_rows(spark, name) == sorted(first)
    second = [("x", "3", "new"), (odd, "1", "new"), ("more", "9", "new")]
    sink.replace_by_dataset(spark, frame(second), name, ["x", odd, "gone", "never"])
    assert _store_rows(spark, name) == sorted(second)
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == mode
    added = sink.append_absent(spark, frame([("x", "3", "again"), ("x", "4", "plus"), ("z", "1", "plus")]), name, ["dataset_id", "pk"])
    assert added.count() == 2
    assert _store_rows(spark, name) == sorted(second + [("x", "4", "plus"), ("z", "1", "plus")])
    files = [f for f in glob.glob(path.removeprefix("file:") + "/**/*.parquet", recursive=True) if "/_keys/" not in f]
    assert sum(spark.read.parquet(f).count() for f in files) == 5 + 1     # old rows are gone; one of the failed run
    with pytest.raises(ValueError):
        sink.replace_by_dataset(spark, frame([(None, "1", "x")]), name)
    spark.sql(f"DROP TABLE {name}")


def test_ledger_answers_without_the_store(spark, monkeypatch):
    """A second run without new rows reads no key and no stored row; few new rows read few shards."""
    from cataloom.sources import ledger as lg
    path, keys = scratch_path(spark, "ledgered"), ["dataset_id", "pk"]

    def batch(lo, hi, text="t"):
        return spark.range(lo, hi).select(F.concat(F.lit("d"), F.col("id") % 3).alias("dataset_id"),
                                          F.col("id").cast("string").alias("pk"), F.lit(text).alias("text_chunk"))

    assert sink.insert_if_absent(spark, batch(0, 3000), path, keys, ledger=True)[1] == 3000
    rebuilt = []
    real = lg.KeyLedger.recover
    monkeypatch.setattr(lg.KeyLedger, "recover", lambda self, s: rebuilt.append(real(self, s)) or rebuilt[-1])
    book = lg.KeyLedger(spark, f"{path}/_keys", keys)
    store = spark.read.parquet(path)
    again = book.absent(batch(0, 3000, "other"), store)
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert again.count() == 0 and "parquet" not in plan.lower()      # nothing is left to read
    generation, doubt = book._state()
    assert not doubt and book.changed(lg.digests(batch(0, 3000), keys), generation) == []
    assert len(book.changed(lg.digests(batch(0, 3002), keys), generation)) <= 2
    assert sink.insert_if_absent(spark, batch(0, 3002), path, keys, ledger=True)[1] == 2
    assert sink.insert_if_absent(spark, batch(2990, 3010, "x"), path, keys, ledger=True)[1] == 8
    assert sink.insert_if_absent(spark, batch(5, 9), path, keys, ledger=True)[1] == 0
    assert not any(rebuilt)
    # rows that came by other means, and a run that failed between its rows and its commit
    batch(4000, 4004).write.mode("append").parquet(path)
    assert sink.insert_if_absent(spark, batch(4000, 4005), path, keys, ledger=True)[1] == 1 and rebuilt[-1]
    monkeypatch.setattr(lg.KeyLedger, "commit", lambda self, noted: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        sink.insert_if_absent(spark, batch(5000, 5002), path, keys, ledger=True)
    monkeypatch.undo()
    assert sink.insert_if_absent(spark, batch(5000, 5003), path, keys, ledger=True)[1] == 1
    after = spark.read.parquet(path)
    assert after.count() == after.select(*keys).distinct().count() == 3000 + 10 + 5 + 3
    none = spark.createDataFrame([(None, "1", "t"), (None, "1", "t"), ("d", None, "t")], after.schema)
    assert [sink.insert_if_absent(spark, none, path, keys, ledger=True)[1] for _ in range(2)] == [2, 0]


def test_ledger_follows_a_replace(spark):
    name = sink.unique_name("book")
    sink.ensure_store(spark, name, scratch_path(spark, "book"))

    def frame(*keys):
        return spark.createDataFrame([(d, k, "t", [1.0]) for d, k in keys], sink.STORE_SCHEMA)

    def add(*keys):
        return sink.append_absent(spark, frame(*keys), name, ["dataset_id", "pk"]).count()

    assert add(("a", "1"), ("b", "1")) == 2 and add(("a", "1"), ("b", "1")) == 0
    sink.replace_by_dataset(spark, frame(("a", "2")), name, ["a"])
    assert add(("a", "1"), ("a", "2"), ("b", "1")) == 1
    sink.replace_by_dataset(spark, frame(("b", "1")).limit(0), name, ["a", "b"])
    assert add(("a", "1"), ("b", "1")) == 2
    assert spark.table(name).count() == 2
    spark.sql(f"DROP TABLE {name}")
