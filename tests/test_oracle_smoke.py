"""A few registered queries against their DuckDB oracle at sf0.001, compared
the way the driver does (columns, row count, order-insensitive value hash).
tools/check_oracle.py runs the same comparison for every key."""

import pytest

from tests.conftest import SF_SMALL

KEYS = ["knn_cosine", "knn_inner", "exact_topk", "hybrid_retrieve", "row_to_chunk", "hash_pk",
        "map_type", "flag_indexed", "profile_columns", "lineage_derive", "row_trend", "trend_scale",
        "significant_tokens", "rotate_source"]


@pytest.fixture(scope="module")
def duck():
    import duckdb
    from tools.check_oracle import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck, key):
    import __spark_entry__ as E
    from tools.check_oracle import digest
    df = E.queries()[key](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    cur = duck.execute(E.oracle_sql()[key])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(df.columns, srows)[0] == digest(dcols, drows)[0]
