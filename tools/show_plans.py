"""Print the physical plan tree of each headline query (bench.py) plus the
scan lines (ReadSchema / PushedFilters) of ``explain("formatted")``.

usage: python tools/show_plans.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    import bench
    from cataloom.session import get_spark
    spark = get_spark("local[4]", shuffle_partitions=8)
    qs = bench.build(spark, sf)
    print("# Physical plans of the headline queries\n")
    print(f"Generated by `tools/show_plans.py` on `{os.path.basename(sf)}` (local[4], AQE on; the")
    print("trees are the initial AQE plans, before run-time re-planning).\n")
    for k in ("knn_cosine", "knn_batch", "exact_topk", "exact_topk_indexed", "hybrid_retrieve",
              "profile_columns_approx",
              "row_to_chunk", "lineage_closure", "row_trend"):
        df = qs[k]()
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        text = buf.getvalue()
        tree = text.split("\n\n(1)")[0].strip()
        scans = sorted({ln.strip() for ln in text.splitlines()
                        if re.match(r"\s*(ReadSchema|PushedFilters|Location)", ln)
                        and "InMemoryFileIndex" not in ln})
        print(f"## {k}\n\n```\n{tree}\n```\n")
        if scans:
            print("Scan details:\n\n```\n" + "\n".join(scans) + "\n```\n")
    spark.stop()


if __name__ == "__main__":
    main()
