"""Registered publish-side queries (#11-#17, #19, #28-#35)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cataloom.functions.vector import sanitize_vector
from cataloom.operators import chunk
from cataloom.operators.embed import embed_text
from cataloom.operators.util import cut_lineage, union_all
from cataloom.plans import publish as pub
from cataloom.queries import query, t
from cataloom.registered.fixed import DRIVER_SCHEMAS
from cataloom.registered.retrieval import letter_counts, letters_sql
from cataloom.session import scratch_path
from cataloom.sources import store as sink
from cataloom.sources.tables import load_tables


def dbl_text_sql(x: str) -> str:
    return (f"CASE WHEN abs({x}) < 1e15 AND {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) "
            f"ELSE CAST({x} AS VARCHAR) END")


def value_text_sql(c: str, typ: str) -> str:
    if typ == "double":
        return dbl_text_sql(c)
    if typ.startswith("timestamp"):
        return f"strftime({c}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
    return f"CAST({c} AS VARCHAR)"


def chunk_sql(table: str) -> str:
    """The chunk text of a driver table in DuckDB SQL (names in binary order)."""
    cols = sorted(DRIVER_SCHEMAS[table], key=lambda x: x[0])
    parts = []
    for c, typ in cols:
        v = value_text_sql(c, typ)
        parts.append(f"CASE WHEN ({v}) <> '' THEN '{c}: ' || ({v}) END")
    return "concat_ws(chr(10), " + ", ".join(parts) + ")"


def json_sql(table: str, sort: bool = False) -> str:
    cols = DRIVER_SCHEMAS[table]
    if sort:
        cols = sorted(cols, key=lambda x: x[0])
    return "to_json(struct_pack(" + ", ".join(f"{c} := {c}" for c, _ in cols) + "))"


@query("row_to_chunk", f"SELECT c_custkey, {chunk_sql('customer')} AS text_chunk FROM customer")
def q_row_to_chunk(spark, sf):
    c = t(spark, sf, "customer")
    return chunk.row_to_chunk(c).select("c_custkey", "text_chunk")


@query("row_to_json", f"""
SELECT 'ds_region' AS dataset_id, CAST(r_regionkey AS BIGINT) AS k, CAST({json_sql('region')} AS VARCHAR) AS text_chunk FROM region
UNION ALL
SELECT 'ds_nation', CAST(n_nationkey AS BIGINT), CAST({json_sql('nation')} AS VARCHAR) FROM nation""")
def q_row_to_json(spark, sf):
    r = chunk.row_to_json(t(spark, sf, "region")).select(
        F.lit("ds_region").alias("dataset_id"), F.col("r_regionkey").cast("bigint").alias("k"), "text_chunk")
    n = chunk.row_to_json(t(spark, sf, "nation")).select(
        F.lit("ds_nation").alias("dataset_id"), F.col("n_nationkey").cast("bigint").alias("k"), "text_chunk")
    return r.unionByName(n)


@query("pick_pk", """
SELECT o_orderkey, coalesce(nullif(CAST(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END AS VARCHAR), ''),
                            nullif(CAST(o_custkey AS VARCHAR), '')) AS pk
FROM orders""")
def q_pick_pk(spark, sf):
    o = t(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey")).alias("id"),
        F.col("o_custkey").alias("customer_id"))
    return chunk.pick_pk(o).select("o_orderkey", "pk")


@query("hash_pk", f"SELECT r_regionkey, sha256({json_sql('region', sort=True)}) AS pk FROM region")
def q_hash_pk(spark, sf):
    r = t(spark, sf, "region")
    return chunk.hash_pk(r).select("r_regionkey", "pk")


@query("embed_text", """
SELECT doc_id, 64 AS dims,
       CAST(CASE WHEN regexp_matches(lower(text), '[\\p{L}\\p{N}]') THEN 1.0 ELSE 0.0 END AS DOUBLE) AS norm
FROM documents""")
def q_embed_text(spark, sf):
    d = embed_text(t(spark, sf, "documents"), "text", dims=64)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return d.select("doc_id", F.size("embedding").alias("dims"), F.round(norm, 4).alias("norm"))


@query("embed_text_values", f"""
SELECT doc_id, CAST(i AS INTEGER) AS i, CAST(coalesce(v[i], 0) AS DOUBLE) AS value
FROM (SELECT doc_id, {letters_sql('text')} AS v, unnest(range(1, 27)) AS i FROM documents)""")
def q_embed_text_values(spark, sf):
    """Every value of every vector, with an embedder that SQL can state."""
    d = embed_text(t(spark, sf, "documents").select("doc_id", "text"), "text", dims=26,
                   embedder=letter_counts)
    return d.select("doc_id", F.posexplode("embedding").alias("p", "value")).select(
        "doc_id", (F.col("p") + 1).alias("i"), F.col("value").cast("double").alias("value"))


@query("sanitize_vector", """
SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dims,
       round(list_sum(list_transform(embedding, lambda x: CASE WHEN isfinite(x) THEN round(CAST(x AS DOUBLE), 6) ELSE 0.0 END)), 6) AS s,
       round(list_max(list_transform(embedding, lambda x: CASE WHEN isfinite(x) THEN round(CAST(x AS DOUBLE), 6) ELSE 0.0 END)), 6) AS mx
FROM embeddings""")
def q_sanitize_vector(spark, sf):
    e = t(spark, sf, "embeddings").select("vec_id", sanitize_vector("embedding").alias("v"))
    return e.select("vec_id", F.size("v").alias("dims"),
                    F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("s"),
                    F.round(F.array_max("v"), 6).alias("mx"))


@query("pick_columns_lineitem", """
SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem""")
def q_pick_columns_lineitem(spark, sf):
    li = chunk.pick_columns(t(spark, sf, "lineitem"),
                            include=["L_ORDERKEY", "l_linenumber", "l_quantity", "l_discount", "l_tax"])
    return li


def _publish_sql() -> str:
    parts = []
    for tb in ("customer", "part", "supplier"):
        parts.append(f"SELECT '{tb}' AS dataset_id, sha256({json_sql(tb, sort=True)}) AS pk, "
                     f"{chunk_sql(tb)} AS text_chunk, 64 AS dims FROM {tb}")
    return "\nUNION ALL ".join(parts)


@query("publish", _publish_sql())
def q_publish(spark, sf):
    tables = {n: t(spark, sf, n) for n in ("customer", "part", "supplier")}
    name = sink.unique_name("store")
    sink.ensure_store(spark, name, scratch_path(spark, "store"))
    pub.publish(spark, tables, name, limit=None, dims=64)
    return spark.table(name).select("dataset_id", "pk", "text_chunk",
                                    F.size("embedding").alias("dims"))


@query("publish_summary", """
SELECT dataset_id, 'published' AS status, CAST(count(*) AS BIGINT) AS total_rows,
       CAST(count(*) AS BIGINT) AS inserted FROM (
  SELECT 'customer' AS dataset_id FROM customer UNION ALL SELECT 'part' FROM part
  UNION ALL SELECT 'supplier' FROM supplier) x GROUP BY dataset_id""")
def q_publish_summary(spark, sf):
    tables = {n: t(spark, sf, n) for n in ("customer", "part", "supplier")}
    name = sink.unique_name("store")
    sink.ensure_store(spark, name, scratch_path(spark, "store"))
    s = pub.publish(spark, tables, name, limit=None, dims=64)
    return s.select("dataset_id", "status", "total_rows", "inserted")


@query("replace_by_dataset", """
SELECT source AS dataset_id, CAST(doc_id AS VARCHAR) AS pk, text AS text_chunk FROM documents""")
def q_replace_by_dataset(spark, sf):
    """Publish all documents by source, replace with src0 empty (its rows and
    files go, the others are rewritten), then append all again: only src0's
    rows are absent and come back."""
    d = t(spark, sf, "documents")
    name = sink.unique_name("store")
    sink.ensure_store(spark, name, scratch_path(spark, "store"))
    first = d.select(F.col("source").alias("dataset_id"), F.col("doc_id").cast("string").alias("pk"),
                     F.col("text").alias("text_chunk"),
                     F.array().cast("array<float>").alias("embedding"))
    ids = [r[0] for r in d.select("source").distinct().collect()]
    sink.replace_by_dataset(spark, first, name, ids)
    sink.replace_by_dataset(spark, first.where(F.col("dataset_id") != "src0"), name, ids)
    sink.append_absent(spark, first, name, ["dataset_id", "pk"])
    return spark.table(name).select("dataset_id", "pk", "text_chunk")


@query("publish_incremental", """
WITH c AS (SELECT count(*) AS n, count(*) FILTER (c_mktsegment <> 'BUILDING') AS a FROM customer)
SELECT 1 AS run, 'customer' AS dataset_id, 'published' AS status, a AS total_rows, a AS inserted, a AS stored FROM c
UNION ALL SELECT 2, 'customer', 'published', n, n - a, n FROM c
UNION ALL SELECT 3, 'customer', 'no-new-rows', n, 0, n FROM c""")
def q_publish_incremental(spark, sf):
    """Appending publish of a growing table: new, added, nothing to add; the
    rows are counted through the table."""
    c = t(spark, sf, "customer")
    name = sink.unique_name("store")
    sink.ensure_store(spark, name, scratch_path(spark, "store"))
    runs = []
    for i, rows in enumerate((c.where(F.col("c_mktsegment") != "BUILDING"), c, c), 1):
        s = pub.publish(spark, {"customer": rows}, name, dims=16, truncate=False)
        runs.append(cut_lineage(s.select(
            F.lit(i).alias("run"), "dataset_id", "status", "total_rows", "inserted",
            F.lit(spark.table(name).count()).cast("bigint").alias("stored"))))
    return runs[0].unionByName(runs[1]).unionByName(runs[2])


@query("insert_if_absent", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
       CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END AS batch,
       (SELECT CAST(count(*) AS BIGINT) FROM orders WHERE o_orderstatus <> 'O') AS second_insert
FROM orders""")
def q_insert_if_absent(spark, sf):
    """Orders written in two overlapping batches (open orders, then all): rows of the first
    batch stay as they were, the second adds exactly the missing keys."""
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    path = scratch_path(spark, "orders_ins")
    first = o.where(F.col("o_orderstatus") == "O").withColumn("batch", F.lit(1))
    sink.insert_if_absent(spark, first, path, ["o_orderkey"])
    after, n = sink.insert_if_absent(spark, o.withColumn("batch", F.lit(2)), path, ["o_orderkey"])
    return after.withColumn("second_insert", F.lit(n).cast("bigint"))


@query("upsert_dataset", """
WITH d AS (SELECT CAST(c_custkey AS VARCHAR) AS dataset_id, c_name AS name, c_mktsegment AS source FROM customer),
u AS (SELECT CAST(c_custkey + 1000000 AS VARCHAR) AS dataset_id, c_name AS name, 'upd' AS source
      FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT * FROM d WHERE dataset_id NOT IN (SELECT dataset_id FROM u) AND name NOT IN (SELECT name FROM u)
UNION ALL SELECT * FROM u""")
def q_upsert_dataset(spark, sf):
    """Customers as datasets; BUILDING customers re-registered under a new id
    with the same name: the old row goes by name, the new one is added."""
    c = t(spark, sf, "customer")
    d = c.select(F.col("c_custkey").cast("string").alias("dataset_id"), F.col("c_name").alias("name"),
                 F.col("c_mktsegment").alias("source"))
    u = c.where(F.col("c_mktsegment") == "BUILDING").select(
        (F.col("c_custkey") + 1000000).cast("string").alias("dataset_id"),
        F.col("c_name").alias("name"), F.lit("upd").alias("source"))
    return sink.upsert_dataset(d, u)


@query("update_attrs", """
SELECT s.s_suppkey, coalesce(u.new_name, s.s_name) AS s_name, s.s_acctbal
FROM supplier s LEFT JOIN (SELECT n_nationkey, upper(n_name) AS new_name FROM nation) u
  ON u.n_nationkey = s.s_nationkey""")
def q_update_attrs(spark, sf):
    """Rename every supplier to its nation's name in upper case (UPDATE ... SET name)."""
    s = t(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal",
                                        F.col("s_nationkey").alias("k"))
    n = t(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.upper("n_name").alias("s_name"))
    return sink.update_attrs(s, n, "k", ["s_name"]).select("s_suppkey", "s_name", "s_acctbal")


@query("delete_cascade", """
WITH ids AS (SELECT 'cust_' || CAST(c_custkey AS VARCHAR) AS dataset_id FROM customer WHERE c_mktsegment = 'MACHINERY'
             UNION ALL SELECT 'ord_' || CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'P'),
d AS (SELECT 'cust_' || CAST(c_custkey AS VARCHAR) AS dataset_id, c_name AS name FROM customer),
e AS (SELECT 'cust_' || CAST(o_custkey AS VARCHAR) AS src, 'ord_' || CAST(o_orderkey AS VARCHAR) AS dst FROM orders)
SELECT 'datasets' AS frame, dataset_id AS a, name AS b FROM d WHERE dataset_id NOT IN (SELECT dataset_id FROM ids)
UNION ALL SELECT 'columns', dataset_id, c FROM d, (VALUES ('c_name'), ('c_acctbal')) x(c)
  WHERE dataset_id NOT IN (SELECT dataset_id FROM ids)
UNION ALL SELECT 'edges', src, dst FROM e
  WHERE src NOT IN (SELECT dataset_id FROM ids) AND dst NOT IN (SELECT dataset_id FROM ids)""")
def q_delete_cascade(spark, sf):
    """Some customers and some orders are removed: rows of all three frames that are left."""
    c, o = t(spark, sf, "customer"), t(spark, sf, "orders")
    cust, order = (lambda k: F.concat(F.lit("cust_"), F.col(k).cast("string")),
                   lambda k: F.concat(F.lit("ord_"), F.col(k).cast("string")))
    datasets = c.select(cust("c_custkey").alias("dataset_id"), F.col("c_name").alias("name"))
    columns = datasets.select("dataset_id", F.explode(F.array(F.lit("c_name"), F.lit("c_acctbal")))
                              .alias("column_name"))
    edges = o.select(cust("o_custkey").alias("src_dataset_id"), order("o_orderkey").alias("dst_dataset_id"))
    ids = (c.where(F.col("c_mktsegment") == "MACHINERY").select(cust("c_custkey").alias("dataset_id"))
           .unionByName(o.where(F.col("o_orderstatus") == "P").select(order("o_orderkey").alias("dataset_id"))))
    left = sink.delete_cascade(datasets, columns, edges, ids)
    return union_all([f.select(F.lit(n).alias("frame"), F.col(f.columns[0]).alias("a"),
                               F.col(f.columns[1]).alias("b"))
                      for n, f in zip(("datasets", "columns", "edges"), left)])


@query("publish_append", """
SELECT dataset_id, run, CAST(total_rows AS BIGINT) AS total_rows, CAST(inserted AS BIGINT) AS inserted FROM (
  SELECT 'ds_region' AS dataset_id, 1 AS run, (SELECT count(*) FROM region) AS total_rows,
         (SELECT count(*) FROM region) AS inserted
  UNION ALL SELECT 'ds_nation', 1, (SELECT count(*) FROM nation), (SELECT count(*) FROM nation)
  UNION ALL SELECT 'ds_region', 2, (SELECT count(*) FROM region), 0
  UNION ALL SELECT 'ds_nation', 2, (SELECT count(*) FROM nation), 0)""")
def q_publish_append(spark, sf):
    """Legacy publish of region and nation, twice: the second run inserts 0."""
    from cataloom.operators.catalog import build_datasets
    from cataloom.sources.tables import list_files, resolve_table_root
    ds = build_datasets(spark, {n: t(spark, sf, n) for n in ("region", "nation")})
    listing = list_files(spark, sf).select(F.col("rel_path").alias("root"))
    resolved = resolve_table_root(ds, listing)
    store = scratch_path(spark, "legacy_store")
    a = pub.publish_append(spark, resolved, sf, store).withColumn("run", F.lit(1))
    a = cut_lineage(a)          # run 1 is computed before run 2 writes
    b = pub.publish_append(spark, resolved, sf, store).withColumn("run", F.lit(2))
    return a.unionByName(b).select("dataset_id", "run", "total_rows", "inserted")
