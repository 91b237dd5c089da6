"""Registered retrieval queries (#42-#57) over documents/embeddings/benchmark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cataloom.operators import knn, search
from cataloom.operators.embed import embed_text
from cataloom.operators.gram_index import GramIndex
from cataloom.operators.vector_cells import CellStore
from cataloom.plans import ask
from cataloom.queries import (ASK_SQL, IN_SCOPE_SQL, NORM_SQL, ORACLE, PREVIEW_SQL, QUESTIONS_SQL, STORE_SQL,
                              ask_frame, cos_sql, dot_sql, query, question_frame, r6, store_frame, t)
from cataloom.session import scratch_path

# Query vector of the single-query searches: the vector of the first
# benchmark item (vec_id = min(item_id)), read as one row.
Q0_SQL = "(SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(item_id) FROM benchmark))"


def _q0(spark, sf):
    e = t(spark, sf, "embeddings")
    b = t(spark, sf, "benchmark").agg(F.min("item_id").alias("vec_id"))
    return e.join(b, "vec_id").select("embedding")


@query("knn_cosine", f"""
WITH s AS ({STORE_SQL}), q AS (SELECT embedding AS qv FROM {Q0_SQL} x)
SELECT dataset_id, pk, round(distance, 6) AS distance FROM (
  SELECT dataset_id, pk, {cos_sql('embedding', 'qv')} AS distance FROM s, q)
ORDER BY distance NULLS LAST, dataset_id, pk LIMIT 8""")
def q_knn_cosine(spark, sf):
    hits = knn.knn_cosine(store_frame(spark, sf), _q0(spark, sf), k=8)
    return hits.select("dataset_id", "pk", r6("distance").alias("distance"))


@query("knn_inner", f"""
WITH s AS (SELECT 'label_' || CAST(label AS VARCHAR) AS dataset_id, CAST(vec_id AS VARCHAR) AS pk,
                  list_transform(embedding, lambda x: x * (1 + label)) AS embedding
           FROM embeddings),
     q AS (SELECT embedding AS qv FROM {Q0_SQL} x)
SELECT dataset_id, pk, round(distance, 6) AS distance FROM (
  SELECT dataset_id, pk, -{dot_sql('embedding', 'qv')} AS distance FROM s, q)
ORDER BY distance NULLS LAST, dataset_id, pk LIMIT 5""")
def q_knn_inner(spark, sf):
    # vector-only store; each vector is scaled by (1 + its label) so that the
    # inner product ranks differently from cosine (raw vectors are unit length)
    e = t(spark, sf, "embeddings")
    s = e.select(F.concat(F.lit("label_"), F.col("label").cast("string")).alias("dataset_id"),
                 F.col("vec_id").cast("string").alias("pk"),
                 F.transform("embedding", lambda x: x * (1 + F.col("label"))).alias("embedding"))
    hits = knn.knn_inner(s, _q0(spark, sf), k=5)
    return hits.select("dataset_id", "pk", r6("distance").alias("distance"))


@query("knn_cosine_cells", ORACLE["knn_cosine"])
def q_knn_cosine_cells(spark, sf):
    """knn_cosine over a store laid out in cells: only cells that can matter are read."""
    cells = CellStore.build(store_frame(spark, sf), scratch_path(spark, "cells"))
    return cells.knn_cosine(_q0(spark, sf), k=8).select("dataset_id", "pk", r6("distance").alias("distance"))


@query("knn_inner_cells", ORACLE["knn_inner"])
def q_knn_inner_cells(spark, sf):
    e = t(spark, sf, "embeddings")
    s = e.select(F.concat(F.lit("label_"), F.col("label").cast("string")).alias("dataset_id"),
                 F.col("vec_id").cast("string").alias("pk"), F.lit("").alias("text_chunk"),
                 F.transform("embedding", lambda x: x * (1 + F.col("label"))).alias("embedding"))
    cells = CellStore.build(s, scratch_path(spark, "cells"))
    return cells.knn_inner(_q0(spark, sf), k=5).select("dataset_id", "pk", r6("distance").alias("distance"))


@query("cross_query", f"""
WITH s AS ({STORE_SQL}), q AS (SELECT embedding AS qv FROM {Q0_SQL} x)
SELECT dataset_id, pk, round({cos_sql('embedding', 'qv')}, 6) AS distance FROM s, q""")
def q_cross_query(spark, sf):
    from cataloom.functions.vector import cosine_distance
    s = knn.cross_query(store_frame(spark, sf), _q0(spark, sf))
    return s.select("dataset_id", "pk", r6(cosine_distance("embedding", "qvec")).alias("distance"))


@query("knn_batch", f"""
WITH s AS ({STORE_SQL}), q AS ({QUESTIONS_SQL}),
d AS (SELECT q.qid, s.dataset_id, s.pk, {cos_sql('s.embedding', 'q.qv')} AS distance FROM s, q),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance NULLS LAST, dataset_id, pk) AS rank FROM d)
SELECT qid, dataset_id, pk, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank
FROM r WHERE rank <= 8""")
def q_knn_batch(spark, sf):
    hits = knn.knn_batch(store_frame(spark, sf), question_frame(spark, sf), k=8)
    return hits.select("qid", "dataset_id", "pk", r6("distance").alias("distance"), "rank")


@query("exact_topk", f"""
WITH s AS ({STORE_SQL}), q AS ({QUESTIONS_SQL}),
m AS (SELECT q.qid, s.dataset_id, s.pk,
             row_number() OVER (PARTITION BY q.qid ORDER BY s.pk, s.dataset_id) AS rank
      FROM s JOIN q ON length(q.question) > 0 AND contains(lower(s.text_chunk), lower(q.question)))
SELECT qid, dataset_id, pk, CAST(0.0 AS DOUBLE) AS distance, CAST(rank AS INTEGER) AS rank FROM m WHERE rank <= 3""")
def q_exact_topk(spark, sf):
    hits = search.exact_topk(store_frame(spark, sf), question_frame(spark, sf), k=3, mode="raw")
    return hits.select("qid", "dataset_id", "pk", "distance", "rank")


@query("theta_ilike_join", f"""
WITH s AS ({STORE_SQL}), q AS ({ASK_SQL})
SELECT q.qid, s.dataset_id, s.pk FROM s JOIN q
  ON length({NORM_SQL.format(x='q.question')}) > 0 AND {IN_SCOPE_SQL}
 AND contains(lower(s.text_chunk), {NORM_SQL.format(x='q.question')})""")
def q_theta_ilike_join(spark, sf):
    j = search.theta_ilike_join(store_frame(spark, sf), ask_frame(spark, sf), mode="normalized")
    return j.select("qid", "dataset_id", "pk")


def _hybrid_sql(k, k_exact, cap, metric, order, exact_mode, wildcards, style,
                store_sql=STORE_SQL, ask_sql=ASK_SQL):
    dist = cos_sql("s.embedding", "q.qv") if metric == "cosine" else f"-{dot_sql('s.embedding', 'q.qv')}"
    phrase = NORM_SQL.format(x="q.question") if exact_mode == "normalized" else "q.question"
    if wildcards:
        match = f"s.text_chunk ILIKE '%' || {phrase} || '%' ESCAPE '\\'"
    else:
        match = f"contains(lower(s.text_chunk), lower({phrase}))"
    o_sem, o_ex = (0, 1) if order == "semantic_first" else (1, 0)
    bad = "NULL" if style == "ask" else "0.0"
    return f"""
WITH s AS ({store_sql}), q AS ({ask_sql}),
sd AS (SELECT q.qid, s.dataset_id, s.pk, s.text_chunk, {dist} AS distance FROM s, q
       WHERE q.qv IS NOT NULL AND {IN_SCOPE_SQL}),
sem AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance NULLS LAST, dataset_id, pk) AS rnk FROM sd),
ex AS (SELECT q.qid, s.dataset_id, s.pk, s.text_chunk, 0.0 AS distance,
              row_number() OVER (PARTITION BY q.qid ORDER BY s.pk, s.dataset_id) AS rnk
       FROM s JOIN q ON length({phrase}) > 0 AND {match} AND {IN_SCOPE_SQL}),
allh AS (SELECT *, 'semantic' AS origin, {o_sem} AS o FROM sem WHERE rnk <= {k}
         UNION ALL SELECT *, 'exact' AS origin, {o_ex} AS o FROM ex WHERE rnk <= {k_exact}),
dd AS (SELECT *, row_number() OVER (PARTITION BY qid, dataset_id, pk ORDER BY o, rnk) AS n FROM allh),
m AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY o, rnk) AS rank FROM dd WHERE n = 1)
SELECT qid, CAST(rank AS INTEGER) AS rank, origin, dataset_id, pk,
       round(CASE WHEN isfinite(distance) THEN distance ELSE {bad} END, 6) AS distance,
       {PREVIEW_SQL.format(x='text_chunk')} AS preview
FROM m WHERE rank <= {cap}"""


@query("hybrid_retrieve", _hybrid_sql(**ask.ASK))
def q_hybrid_retrieve(spark, sf):
    hits = ask.hybrid_retrieve(store_frame(spark, sf), ask_frame(spark, sf), **ask.ASK)
    return hits.select("qid", "rank", "origin", "dataset_id", "pk", r6("distance").alias("distance"),
                       "preview")


def letter_counts(texts: list[str]) -> np.ndarray:
    """An embedder that SQL can state too: how often each of the letters a-z occurs."""
    n = np.stack([np.bincount(np.frombuffer(x.encode(), np.uint8), minlength=256) for x in texts])
    return n[:, 97:123] + n[:, 65:91]


def letters_sql(x):
    counts = (f"list_transform(range(97, 123), lambda c: CAST(length({x}) - length("
              f"replace(replace({x}, chr(CAST(c AS INTEGER)), ''), chr(CAST(c - 32 AS INTEGER)), '')) AS FLOAT))")
    return f"CASE WHEN list_sum({counts}) > 0 THEN {counts} END"


@query("hybrid_retrieve_text", _hybrid_sql(
    **ask.ASK, store_sql=f"SELECT * REPLACE ({letters_sql('text_chunk')} AS embedding) FROM ({STORE_SQL})",
    ask_sql=f"SELECT * REPLACE ({letters_sql('question')} AS qv) FROM ({ASK_SQL})"))
def q_hybrid_retrieve_text(spark, sf):
    """Ask with question texts only: every document and every question is embedded."""
    store = embed_text(store_frame(spark, sf).drop("embedding"), dims=26, embedder=letter_counts)
    hits = ask.hybrid_retrieve(store, ask_frame(spark, sf).drop("embedding"), dims=26,
                               embedder=letter_counts, **ask.ASK)
    return hits.select("qid", "rank", "origin", "dataset_id", "pk", r6("distance").alias("distance"),
                       "preview")


@query("hybrid_answer", _hybrid_sql(**ask.answer_settings(5)))
def q_hybrid_answer(spark, sf):
    hits = ask.hybrid_answer(store_frame(spark, sf), ask_frame(spark, sf), k=5)
    return hits.select("qid", "rank", "origin", "dataset_id", "pk", r6("distance").alias("distance"),
                       "preview")


def _first_hits_sql(asked):
    return f"""
WITH s AS ({STORE_SQL}), q AS ({asked}),
m AS (SELECT q.qid, s.dataset_id, s.pk,
             row_number() OVER (PARTITION BY q.qid ORDER BY s.pk, s.dataset_id) AS rank
      FROM s JOIN q ON length(q.question) > 0 AND contains(lower(s.text_chunk), lower(q.question)) AND {IN_SCOPE_SQL})
SELECT qid, dataset_id, pk, CAST(0.0 AS DOUBLE) AS distance, CAST(rank AS INTEGER) AS rank FROM m WHERE rank <= 3"""


@query("exact_topk_indexed", _first_hits_sql(f"SELECT *, NULL AS scope FROM ({QUESTIONS_SQL})"))
def q_exact_topk_indexed(spark, sf):
    """exact_topk through the gram index (same oracle as exact_topk)."""
    store = store_frame(spark, sf)
    index = GramIndex(spark, scratch_path(spark, "gram-index"))
    index.append(store)
    hits = index.topk(store, question_frame(spark, sf), k=3, mode="raw")
    return hits.select("qid", "dataset_id", "pk", "distance", "rank")


_SHORT_SQL = f"""SELECT * FROM ({ASK_SQL})
  UNION ALL SELECT n_nationkey + 3000000, substr(n_name, 1, 1 + n_nationkey % 5), NULL, NULL FROM nation"""


@query("exact_topk_appended", _first_hits_sql(_SHORT_SQL))
def q_exact_topk_appended(spark, sf):
    """Questions of all lengths, one letter and up, and scopes, through an index that was loaded
    source by source in batches and merged."""
    store = store_frame(spark, sf)
    asked = ask_frame(spark, sf).select("qid", "question", "dataset_id")
    first = t(spark, sf, "nation").select(
        (F.col("n_nationkey").cast("bigint") + 3_000_000).alias("qid"),
        F.expr("substr(n_name, 1, 1 + n_nationkey % 5)").alias("question"),
        F.lit(None).cast("string").alias("dataset_id"))
    index = GramIndex(spark, scratch_path(spark, "gram-index"))
    for batch in range(5):
        index.append(store.where(F.pmod(F.xxhash64("dataset_id"), F.lit(5)) == batch))
    index.merge()
    hits = index.topk(store, asked.unionByName(first), k=3, mode="raw")
    return hits.select("qid", "dataset_id", "pk", "distance", "rank")
