"""Exact nearest neighbours over the embedding store.

* one query vector (``knn_cosine`` / ``knn_inner``): the vector is a literal
  column (the reference's CROSS JOIN with a one-row query), the distance a
  JVM expression, and ``orderBy().limit(k)`` becomes TakeOrderedAndProject -
  one pass, k rows per partition, no shuffle of the store.
* many query vectors (``knn_batch``): question tiles and store tiles meet in
  tasks (``blocks``); each task does a BLAS matmul per pair of tiles and keeps
  only its local top-k per question (ties kept exactly), so the shuffle before
  the final ``row_number() <= k`` carries at most k rows per (task, question) -
  never all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cataloom.functions.vector import cosine_distance, neg_inner_product
from cataloom.operators.blocks import Step, block_join
from cataloom.operators.search import scope_column
from cataloom.operators.util import spread

# Defaults of the reference (ask: cosine k=8 in 1..25; answer: inner k=5 in 1..50).
COSINE_K, COSINE_K_MAX = 8, 25
INNER_K, INNER_K_MAX = 5, 50
# Most bytes of questions that are broadcast at once.
QUESTION_BLOCK_BYTES = 32 * 1024 * 1024


def clamp_k(k, lo: int = 1, hi: int = COSINE_K_MAX) -> int:
    """ask-style clamp: non-finite -> lower bound, else truncate into [lo, hi]."""
    try:
        x = float(k)
    except (TypeError, ValueError):
        return lo
    if not math.isfinite(x):
        return lo
    return max(lo, min(hi, int(x)))


def answer_k(k, default: int = INNER_K, hi: int = INNER_K_MAX) -> int:
    """answer-style: a k outside (0, hi] falls back to the default."""
    try:
        x = float(k)
    except (TypeError, ValueError):
        return default
    return int(x) if math.isfinite(x) and 0 < x <= hi else default


def _vector_literal(qvec) -> F.Column:
    return F.array(*[F.lit(float(x)) for x in qvec])


def query_vector(qvec) -> list[float]:
    """A query vector given as a list or a one-row DataFrame with ``embedding``
    (one row of ``dims`` floats is the only thing read on the driver)."""
    if isinstance(qvec, DataFrame):
        rows = qvec.select("embedding").limit(2).collect()
        if len(rows) != 1:
            raise ValueError(f"query frame must have exactly one row, got {len(rows)}")
        return [float(x) for x in rows[0][0]]
    return [float(x) for x in qvec]


def cross_query(store: DataFrame, qvec, name: str = "qvec") -> DataFrame:
    """Attach the one-row query vector to every store row (as a literal)."""
    return store.withColumn(name, _vector_literal(query_vector(qvec)))


def _knn_one(store: DataFrame, qvec, k: int, metric: str, dataset_id: str | None,
             vec_col: str = "embedding") -> DataFrame:
    q = query_vector(qvec)
    qlit = _vector_literal(q)
    if metric == "cosine":
        qn = float(sum(x * x for x in q))
        dist = cosine_distance(vec_col, qlit, b_sq_norm=F.lit(qn))
    else:
        dist = neg_inner_product(vec_col, qlit)
    s = store if dataset_id is None else store.where(F.col("dataset_id") == F.lit(dataset_id))
    keep = [c for c in ("dataset_id", "pk", "text_chunk") if c in s.columns]
    return (s.select(*keep, dist.alias("distance"))
            .orderBy(F.col("distance").asc_nulls_last(), F.col("dataset_id").asc_nulls_last(),
                     F.col("pk").asc_nulls_last())
            .limit(k))


def knn_cosine(store: DataFrame, qvec, k: int = COSINE_K, dataset_id: str | None = None) -> DataFrame:
    """``embedding <=> q`` (1 - cosine) ascending, ties by (dataset_id, pk)."""
    return _knn_one(store, qvec, clamp_k(k, 1, COSINE_K_MAX), "cosine", dataset_id)


def knn_inner(store: DataFrame, qvec, k: int = INNER_K, dataset_id: str | None = None) -> DataFrame:
    """``embedding <#> q`` (negative inner product) ascending."""
    return _knn_one(store, qvec, answer_k(k), "inner", dataset_id)


# Cells of the distance matrix a task holds at once (8 bytes each), and rows of the store it
# compares at once (a tile of rows without vectors holds far more).
MATRIX_CELLS = 1_000_000
STORE_ROWS = 16_384
# Rows at a question's cut kept beyond k before the tie order is applied.
TIES_KEPT = 64

# --- batch --------------------------------------------------------------------

HIT_SCHEMA = T.StructType([
    T.StructField("qid", T.LongType()),
    T.StructField("dataset_id", T.StringType()),
    T.StructField("pk", T.StringType()),
    T.StructField("distance", T.DoubleType()),
    T.StructField("k", T.LongType()),
])
_HITS = pa.schema([("qid", pa.int64()), ("dataset_id", pa.string()), ("pk", pa.string()),
                   ("distance", pa.float64()), ("k", pa.int64())])


class _Questions:
    """The questions of a batch that have vectors of one length."""

    def __init__(self, batch: pa.RecordBatch, dim: int):
        own = batch.filter(pc.equal(pc.list_value_length(batch.column("embedding")), dim))
        self.Q = _matrix(own.column("embedding"), dim)
        self.norm = np.sqrt((self.Q * self.Q).sum(axis=1))
        self.qid = own.column("qid").to_numpy()
        self.scope = own.column("dataset_id").to_pylist()
        self.k = own.column("k").to_numpy()

    @staticmethod
    def of(batch: pa.RecordBatch) -> list["_Questions"]:
        dims = pc.unique(pc.list_value_length(batch.column("embedding"))).to_pylist()
        return [_Questions(batch, d) for d in dims]


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _local_topk(store: pa.RecordBatch, p: _Questions, metric: str) -> pd.DataFrame:
    """Candidates of one batch of the store: per question the rows up to the k-th distance
    (all ties at the cut), NULL distances only where fewer than k are left.
    Questions are taken in groups that keep the distance matrix bounded."""
    n, d = store.num_rows, p.Q.shape[1]
    vectors = store.column("embedding")
    ok = pc.fill_null(pc.equal(pc.list_value_length(vectors), d), False).to_numpy(
        zero_copy_only=False)
    E = _matrix(vectors.filter(pa.array(ok)), d)
    en = np.sqrt((E * E).sum(axis=1))
    ds = np.array(store.column("dataset_id").to_pylist(), object)
    pks = np.array(store.column("pk").to_pylist(), object)
    by_key = None
    found = []
    step = max(1, MATRIX_CELLS // n)
    for lo in range(0, len(p.Q), step):
        q = slice(lo, lo + step)
        dots = p.Q[q] @ E.T                               # questions x rows with vectors
        dist = np.full((len(dots), n), np.nan)
        if metric == "cosine":
            denom = p.norm[q, None] * en[None, :]
            dist[:, ok] = np.where(denom > 0, 1.0 - dots / np.where(denom > 0, denom, 1.0), np.nan)
        else:
            dist[:, ok] = -dots
        open_to = np.ones(dist.shape, bool)
        for j, scope in enumerate(p.scope[q]):
            if scope is not None:
                open_to[j] = ds == scope
        dist[~open_to] = np.nan
        k = np.clip(p.k[q], 1, n)
        kth = np.partition(dist, np.unique(k) - 1, axis=1)[np.arange(len(k)), k - 1]  # NaN last
        take = dist <= kth[:, None]
        for j in np.flatnonzero(np.isnan(kth)):           # fewer than k: then the first by key
            if by_key is None:
                by_key = pd.DataFrame({"d": ds, "p": pks}).sort_values(
                    ["d", "p"], na_position="last", kind="mergesort").index.to_numpy()
            take[j] = known = ~np.isnan(dist[j])
            rest = by_key[(open_to[j] & ~known)[by_key]]
            take[j, rest[:k[j] - known.sum()]] = True
        for j in np.flatnonzero(take.sum(axis=1) > k + TIES_KEPT):   # a crowd at the cut
            at = np.flatnonzero(take[j])
            order = pd.DataFrame({"x": dist[j, at], "d": ds[at], "p": pks[at]}).sort_values(
                ["x", "d", "p"], na_position="last", kind="mergesort").index[:k[j]]
            take[j] = False
            take[j, at[order]] = True
        j, i = np.nonzero(take)
        found.append((p.qid[q][j], ds[i], pks[i], dist[j, i], p.k[q][j]))
    return pd.DataFrame({c: np.concatenate([f[x] for f in found]) for x, c in
                         enumerate(HIT_SCHEMA.fieldNames())})


def _first_k(hits: pd.DataFrame) -> pd.DataFrame:
    """The k nearest hits of each question, NULL distances last."""
    hits = hits.sort_values(["qid", "distance", "dataset_id", "pk"], na_position="last",
                            kind="mergesort")
    return hits[hits.groupby("qid").cumcount() < hits["k"]]


class _TopK(Step):
    """The running top-k of each question in a task: at most k rows leave it."""

    def __init__(self, metric: str):
        self.metric, self.questions, self.held, self.most = metric, {}, {}, {}

    def add(self, key, left, right):
        if key not in self.questions:
            self.questions[key] = _Questions.of(right)
            self.held[key] = []
            self.most[key] = max(10_000, 4 * (pc.sum(right.column("k")).as_py() or 0))
        for lo in range(0, left.num_rows, STORE_ROWS):
            for p in self.questions[key]:
                self.held[key].append(_local_topk(left.slice(lo, STORE_ROWS), p, self.metric))
            if sum(map(len, self.held[key])) > self.most[key]:
                self.held[key] = [_first_k(pd.concat(self.held[key], ignore_index=True))]
        return iter(())

    def end(self):
        for held in self.held.values():
            if held:
                hits = _first_k(pd.concat(held, ignore_index=True))
                yield pa.RecordBatch.from_pandas(hits, schema=_HITS, preserve_index=False)


def knn_batch(store: DataFrame, questions: DataFrame, k: int = COSINE_K,
              metric: str = "cosine", block_bytes: int = QUESTION_BLOCK_BYTES) -> DataFrame:
    """Top-k store rows for every question.

    ``questions``: qid (long), embedding, optional dataset_id (NULL = all) and
    optional per-question k; 'all' and blank scopes mean all, questions without
    a vector have no hits.  Vectors of another length than the question's are
    as far as zero vectors (NULL distance).  Returns qid, dataset_id, pk, distance, rank.

    Question tiles meet the store block by block (``blocks``); the top-k of each task are
    merged by a ranked window, each question with its own k."""
    cols = set(questions.columns)
    q = questions.select(
        F.col("qid").cast("long").alias("qid"), F.col("embedding").cast("array<double>"),
        scope_column(F.col("dataset_id") if "dataset_id" in cols else F.lit(None)).alias("dataset_id"),
        (F.col("k") if "k" in cols else F.lit(k)).cast("long").alias("k"))
    q = q.where(F.col("embedding").isNotNull() & (F.col("k") > 0))
    local = block_join(spread(store.select("dataset_id", "pk", "embedding")), q,
                       lambda: _TopK(metric), HIT_SCHEMA, block_bytes=block_bytes)
    w = Window.partitionBy("qid").orderBy(F.col("distance").asc_nulls_last(),
                                          F.col("dataset_id").asc_nulls_last(),
                                          F.col("pk").asc_nulls_last())
    own = F.col("k") if "k" in cols else F.lit(k)      # a constant is planned as a WindowGroupLimit
    return (local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= own)
            .drop("k"))
