"""Fixed knowledge used only to write the oracle SQL text: the driver tables'
column lists (the Spark side always reads ``df.schema``)."""

from __future__ import annotations

from cataloom.operators.catalog import default_source
from cataloom.sources.tables import TABLE_NAMES

# Driver table schemas (column, Spark-side type text), in table order.
DRIVER_SCHEMAS = {
    "region": [("r_regionkey", "integer"), ("r_name", "varchar")],
    "nation": [("n_nationkey", "integer"), ("n_name", "varchar"), ("n_regionkey", "integer")],
    "customer": [("c_custkey", "bigint"), ("c_name", "varchar"), ("c_nationkey", "integer"),
                 ("c_acctbal", "double"), ("c_mktsegment", "varchar")],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "varchar"), ("s_nationkey", "integer"),
                 ("s_acctbal", "double")],
    "part": [("p_partkey", "bigint"), ("p_name", "varchar"), ("p_brand", "varchar"),
             ("p_type", "varchar"), ("p_size", "integer"), ("p_retailprice", "double")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "varchar"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp(6)"),
               ("o_orderpriority", "varchar")],
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                 ("l_linenumber", "integer"), ("l_quantity", "double"),
                 ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
                 ("l_returnflag", "varchar"), ("l_linestatus", "varchar"),
                 ("l_shipdate", "timestamp(6)")],
    "events": [("event_id", "bigint"), ("ts", "timestamp(6)"), ("user_id", "bigint"),
               ("event_type", "varchar"), ("value", "double"), ("props", "varchar")],
    "documents": [("doc_id", "bigint"), ("text", "varchar"), ("lang", "varchar"),
                  ("source", "varchar"), ("n_chars", "bigint")],
    "embeddings": [("vec_id", "bigint"), ("embedding", "array(real)"), ("label", "integer")],
    "pages": [("page_id", "bigint"), ("url", "varchar"), ("html", "varchar")],
    "benchmark": [("item_id", "bigint"), ("text", "varchar")],
    "labels": [("doc_id", "bigint"), ("quality", "integer"), ("toxic", "integer")],
    "conversations": [("conv_id", "bigint"), ("turn", "bigint"), ("role", "varchar"),
                      ("text", "varchar")],
}
assert tuple(DRIVER_SCHEMAS) == TABLE_NAMES

# DuckDB type name -> our type text (for information_schema based oracles).
DUCK_TYPE_CASE = """CASE data_type WHEN 'INTEGER' THEN 'integer' WHEN 'BIGINT' THEN 'bigint'
  WHEN 'VARCHAR' THEN 'varchar' WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp(6)'
  WHEN 'FLOAT[]' THEN 'array(real)' ELSE lower(data_type) END"""

FIXED_NOW_SQL = "TIMESTAMP '2024-01-01 00:00:00'"


def tables_in_sql() -> str:
    return ", ".join(f"'{t}'" for t in TABLE_NAMES)


def datasets_sql() -> str:
    """catalog_datasets over the driver tables, as DuckDB SQL."""
    parts = [
        f"SELECT 'ds_{t}' AS dataset_id, '{t}' AS name, '{default_source(t)}' AS source, "
        f"{FIXED_NOW_SQL} AS created_at, CAST(count(*) AS BIGINT) AS row_count, "
        f"CAST(NULL AS BIGINT) AS size_bytes, {FIXED_NOW_SQL} AS last_profiled_at, "
        f"'{t}' AS table_name FROM {t}"
        for t in TABLE_NAMES]
    return "\n  UNION ALL ".join(parts)


def columns_sql() -> str:
    """(dataset_id, table_name, column_name, data_type, ordinal) from DuckDB's
    information schema."""
    return f"""SELECT 'ds_' || table_name AS dataset_id, table_name, column_name,
         {DUCK_TYPE_CASE} AS data_type, CAST(ordinal_position AS INTEGER) AS ordinal
  FROM information_schema.columns WHERE table_name IN ({tables_in_sql()})"""
