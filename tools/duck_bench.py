"""

usage: python tools/duck_bench.py [sf_dir] [threads]
"""

from __future__ import annotations

import os
import statistics
import sys
import time

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    threads = int(sys.argv[2]) if len(sys.argv) > 2 else 4
    from cataloom.registered import catalog, lineage, publish, retrieval  # noqa: F401
    from cataloom.queries import ORACLE
    from cataloom.registered.publish import chunk_sql, json_sql
    from cataloom.registered.fixed import DRIVER_SCHEMAS
    con = duckdb.connect()
    con.execute(f"SET threads = {threads}")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    assert "orders" in DRIVER_SCHEMAS
    sqls = {k: ORACLE[k] for k in ("knn_cosine", "knn_batch", "exact_topk", "hybrid_retrieve",
                                   "profile_columns", "sync_catalog", "lineage_closure", "row_trend")}
    sqls["row_to_chunk"] = (f"SELECT coalesce(NULL, sha256({json_sql('orders', sort=True)})) AS pk, "
                            f"{chunk_sql('orders')} AS text_chunk FROM orders")
    out = {}
    for k, q in sqls.items():
        con.execute(f"CREATE OR REPLACE TEMP TABLE _w AS {q}")     # warm-up
        ts = []
        for _ in range(3):
            t0 = time.perf_counter()
            con.execute(f"CREATE OR REPLACE TEMP TABLE _w AS {q}")
            ts.append(time.perf_counter() - t0)
        out[k] = round(statistics.median(ts), 3)
        print(k, out[k], flush=True)
    print(out)


if __name__ == "__main__":
    main()
