"""Streaming twins against their batch counterparts (file streams over the
driver tables, processed with availableNow)."""

from pyspark.sql import functions as F

from cataloom.operators import series
from cataloom.session import scratch_path
from cataloom.sources.tables import read_table
from cataloom.streaming import publish as spub
from cataloom.streaming import trend as strend
from tests.conftest import SF_SMALL


def test_trend_stream_equals_batch(spark):
    schema = read_table(spark, SF_SMALL, "events").schema
    ev = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF_SMALL)
    out, ck = scratch_path(spark, "t_trend"), scratch_path(spark, "t_trend_ck")
    strend.start_daily_counts(ev, "ts", "event_type", out, ck).awaitTermination()
    got = {(r.grp, r.days[-1], tuple(r.points)) for r in
           strend.trend_from_counts(strend.current_counts(spark, out)).collect()}
    batch = series.row_trend(read_table(spark, SF_SMALL, "events"), "ts", "event_type")
    want = {(r.grp, r.days[-1], tuple(r.points)) for r in batch.collect()}
    assert got == want and len(got) == 5


def test_publish_stream_replay_is_idempotent(spark):
    schema = read_table(spark, SF_SMALL, "region").schema
    store = scratch_path(spark, "t_sstore")
    for ck in (scratch_path(spark, "t_pub_a"), scratch_path(spark, "t_pub_b")):
        rows = spark.readStream.schema(schema).option("pathGlobFilter", "region.parquet").parquet(SF_SMALL)
        spub.start_publish_stream(rows, "region", store, ck, dims=8).awaitTermination()
    s = spark.read.parquet(store)
    assert s.count() == 5 and s.select("pk").distinct().count() == 5
    assert s.where(F.size("embedding") == 8).count() == 5


def _daily(rows):
    out = {}
    for ts, kind in rows:
        if ts is not None:
            out[kind, ts.date()] = out.get((kind, ts.date()), 0) + 1
    return out


def test_late_events_are_counted(spark):
    """Three files, one event two days and one a year late; replays and compaction change nothing."""
    import datetime as dt
    src, out, ck = (scratch_path(spark, n) for n in ("late_in", "late_out", "late_ck"))
    schema = "ts timestamp_ntz, kind string"
    day = dt.datetime(2024, 5, 10, 12)
    files = [[(day, "a"), (day, "b"), (day + dt.timedelta(days=3), "a"), (None, "a")],
             [(day - dt.timedelta(days=2), "a"), (day + dt.timedelta(days=5), None), (day, "a")],
             [(day - dt.timedelta(days=365), "b"), (day, "a"), (day + dt.timedelta(days=5, hours=11, minutes=59), "a")]]
    seen = []

    def counts():
        return {(r.grp, r.day.date()): r.n for r in strend.current_counts(spark, out).collect()}

    assert counts() == {} and strend.compact(spark, out) == -1
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        seen += rows
        stream = spark.readStream.schema(schema).parquet(src)
        strend.start_daily_counts(stream, "ts", "kind", out, ck).awaitTermination()
        assert counts() == _daily(seen)
        if i == 0:                                  # batch 0 again, after it was folded
            assert strend.compact(spark, out) == 0 and counts() == _daily(seen)
            strend.daily_deltas(spark.createDataFrame(rows, schema), "ts", "kind").write.mode("overwrite").parquet(f"{out}/log/batch_id=0")
            assert counts() == _daily(seen)
    assert strend.compact(spark, out) == 2 and counts() == _daily(seen)
    assert strend.compact(spark, out) == 2
    batch = series.row_trend(spark.createDataFrame(seen, schema).where("ts IS NOT NULL"), "ts", "kind")
    assert {(r.grp, tuple(r.points)) for r in strend.trend_from_counts(strend.current_counts(spark, out)).collect()} == {
        (r.grp, tuple(r.points)) for r in batch.collect()}


def test_streamed_vectors_are_finite(spark):
    import numpy as np
    rows, store, ck = (scratch_path(spark, n) for n in ("fin_in", "fin_store", "fin_ck"))
    spark.createDataFrame([("1", "x"), ("2", "y")], "id string, note string").write.parquet(rows)
    stream = spark.readStream.schema("id string, note string").parquet(rows)
    spub.start_publish_stream(stream, "d", store, ck, dims=3, embedder=lambda texts: np.array(
        [[np.nan, np.inf, 0.12345678]] * len(texts))).awaitTermination()
    assert [[round(x, 7) for x in r.embedding] for r in spark.read.parquet(store).collect()] == [[0.0, 0.0, 0.123457]] * 2
