"""Registered streaming twins (file-stream sources over the driver tables)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cataloom.queries import query, t
from cataloom.session import scratch_path
from cataloom.streaming import publish as spub
from cataloom.streaming import trend as strend


@query("row_trend_stream", """
SELECT event_type AS grp, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS n
FROM events GROUP BY 1, 2""")
def q_row_trend_stream(spark, sf):
    """Daily counts per event type maintained by a stream over the events table
    (processed to the end, then compacted and read)."""
    schema = t(spark, sf, "events").schema
    events = (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
              .parquet(sf))
    out, ckpt = scratch_path(spark, "trend_log"), scratch_path(spark, "trend_ckpt")
    q = strend.start_daily_counts(events, "ts", "event_type", out, ckpt)
    q.awaitTermination()
    strend.compact(spark, out)
    counts = strend.current_counts(spark, out)
    return counts.select("grp", F.date_format("day", "yyyy-MM-dd").alias("day"),
                         F.col("n").cast("bigint").alias("n"))


@query("publish_stream", """
SELECT 'customer' AS dataset_id, CAST(c_custkey AS VARCHAR) AS pk, true AS finite, 64 AS dims FROM customer""")
def q_publish_stream(spark, sf):
    """Customers streamed into the store by two streams with checkpoints of their own: every
    row is stored exactly once, with a finite vector rounded to 6 places."""
    schema = t(spark, sf, "customer").schema
    store = scratch_path(spark, "stream_store")
    for ck in (scratch_path(spark, "pub_ckpt"), scratch_path(spark, "pub_ckpt2")):
        rows = (spark.readStream.schema(schema).option("pathGlobFilter", "customer.parquet")
                .parquet(sf))
        spub.start_publish_stream(rows.withColumn("id", F.col("c_custkey")), "customer",
                                  store, ck).awaitTermination()
    s = spark.read.parquet(store)
    kept = F.forall("embedding", lambda x: x == F.round(x.cast("double"), 6).cast("float"))
    return s.select("dataset_id", "pk", kept.alias("finite"), F.size("embedding").alias("dims"))
