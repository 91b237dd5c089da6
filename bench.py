"""

Prints ONE JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
Each query is forced end to end with the ``noop`` sink (full computation, no
collect to the driver); one warm-up pass, then the median of
$BENCH_REPEAT timed runs per query.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "4")
REPEAT = int(os.environ.get("BENCH_REPEAT", "3"))
ONLY = [k for k in os.environ.get("BENCH_ONLY", "").split(",") if k]


def _sf_of(path: str):
    m = re.search(r"sf([0-9.]+)", path)
    return float(m.group(1)) if m else None


def build(spark, sf):
    from pyspark.sql import functions as F

    from cataloom.operators import catalog as cat
    from cataloom.operators import chunk, knn, lineage, search, series
    from cataloom.operators.gram_index import GramIndex
    from cataloom.plans import ask, sync
    from cataloom.queries import question_frame, store_frame, t
    from cataloom.session import scratch_path
    from cataloom.sources import store as sink
    from cataloom.sources.tables import load_tables
    from cataloom.registered.retrieval import _q0

    def knn_cosine():
        return knn.knn_cosine(store_frame(spark, sf), _q0(spark, sf), k=8)

    def knn_batch():
        # every benchmark passage is a question
        return knn.knn_batch(store_frame(spark, sf), question_frame(spark, sf), k=8)

    def exact_topk():
        return search.exact_topk(store_frame(spark, sf), question_frame(spark, sf), k=3, mode="raw")

    built = {}

    def exact_topk_indexed():
        # the index is built once, as a store would keep it next to its data; the timed
        # part is the query
        if "idx" not in built:
            built["idx"] = GramIndex(spark, scratch_path(spark, "gram-index"))
            built["idx"].append(store_frame(spark, sf))
        return built["idx"].topk(store_frame(spark, sf), question_frame(spark, sf), k=3, mode="raw")

    def hybrid_retrieve():
        return ask.hybrid_retrieve(store_frame(spark, sf), question_frame(spark, sf), **ask.ASK)

    def profile_exact():
        return cat.profile_columns(load_tables(spark, sf), approx=False)

    def profile_approx():
        return cat.profile_columns(load_tables(spark, sf), approx=True)

    def sync_catalog():
        d, c = sync.sync_catalog(spark, load_tables(spark, sf), approx=False)
        return c.join(d, "dataset_id")

    def row_to_chunk():
        o = t(spark, sf, "orders")
        return chunk.chunk_frame(o, "orders")

    def replace_by_dataset():
        d = t(spark, sf, "documents")
        name = sink.unique_name("bench_store")
        sink.ensure_store(spark, name, scratch_path(spark, "bench_store"))
        new = d.select(F.col("source").alias("dataset_id"), F.col("doc_id").cast("string").alias("pk"),
                       F.col("text").alias("text_chunk"), F.array().cast("array<float>").alias("embedding"))
        ids = [f"src{i}" for i in range(20)]
        return sink.replace_by_dataset(spark, new, name, ids)

    def lineage_closure():
        edges = lineage.edges_from_orders(t(spark, sf, "orders"), t(spark, sf, "lineitem"))
        roots = t(spark, sf, "customer").select(
            F.concat(F.lit("cust_"), F.col("c_custkey").cast("string")).alias("root"))
        return lineage.lineage_closure(edges, roots, "downstream", max_hops=10)

    def row_trend():
        return series.row_trend(t(spark, sf, "events"), "ts", "event_type", 14)

    return {
        "knn_cosine": knn_cosine, "knn_batch": knn_batch, "exact_topk": exact_topk,
        "exact_topk_indexed": exact_topk_indexed,
        "hybrid_retrieve": hybrid_retrieve, "profile_columns_exact": profile_exact,
        "profile_columns_approx": profile_approx, "sync_catalog": sync_catalog,
        "row_to_chunk": row_to_chunk, "replace_by_dataset": replace_by_dataset,
        "lineage_closure": lineage_closure, "row_trend": row_trend,
    }


def main():
    from cataloom.session import get_spark
    spark = get_spark(f"local[{CPUS}]", app="cataloom-bench", shuffle_partitions=int(CPUS) * 2,
                      extra={"spark.driver.memory": "8g"})
    qs = build(spark, SF_DIR)
    keys = ONLY or list(qs)

    def run(k):
        t0 = time.perf_counter()
        df = qs[k]()
        df.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    for k in keys:                       # warm-up: JIT, Python workers, file cache
        run(k)
    times = {}
    for k in keys:
        times[k] = round(statistics.median(run(k) for _ in range(REPEAT)), 3)
    out = {"metric": "total_sec_headline_queries", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": _sf_of(SF_DIR), "cpus": int(CPUS), "repeat": REPEAT}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
