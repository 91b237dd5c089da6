"""text -> vector.

The default embedder is offline signed feature hashing: tokens are split and
hashed on the JVM (``split`` + ``xxhash64``), and only the scatter-add into
``dims`` buckets plus the L2 normalisation run in an Arrow-batched Pandas UDF
(numpy ``bincount`` per batch, no per-row Python loop).  A user embedder
(any ``list[str] -> array(n, dims)`` callable) plugs in through the same
Arrow path, called on batches of ``batch`` texts, with order and size checked.
"""

from __future__ import annotations

from typing import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cataloom.functions.vector import check_dims

# Fixed values of the reference's embedding calls.
REFERENCE_DIMS = 1536
EMBED_BATCH = 100
TOKEN_SPLIT = r"(?U)[^\p{L}\p{N}]+"

VECTOR_TYPE = T.ArrayType(T.FloatType(), containsNull=False)


def token_hashes(text) -> Column:
    """array<bigint> of xxhash64 of each lower-case token (JVM side)."""
    c = F.col(text) if isinstance(text, str) else text
    toks = F.filter(F.split(F.lower(c), TOKEN_SPLIT), lambda t: t != "")
    return F.transform(toks, lambda t: F.xxhash64(t))


def _scatter(hashes: pd.Series, dims: int, batch: int) -> pd.Series:
    out = []
    for start in range(0, len(hashes), batch):
        part = hashes.iloc[start:start + batch]
        arrs = [np.asarray(a, dtype=np.int64) if a is not None else np.empty(0, np.int64)
                for a in part]
        n = len(arrs)
        lens = np.fromiter((len(a) for a in arrs), dtype=np.int64, count=n)
        mat = np.zeros((n, dims), dtype=np.float64)
        if lens.sum():
            flat = np.concatenate(arrs)
            rows = np.repeat(np.arange(n, dtype=np.int64), lens)
            bucket = np.mod(flat, dims)
            sign = np.where((flat >> np.int64(40)) & 1, 1.0, -1.0)
            mat = np.bincount(rows * dims + bucket, weights=sign,
                              minlength=n * dims).reshape(n, dims)
        norms = np.linalg.norm(mat, axis=1, keepdims=True)
        mat = np.divide(mat, norms, out=np.zeros_like(mat), where=norms > 0)
        out.extend(mat.astype(np.float32))
    return pd.Series(out, index=hashes.index, dtype=object)


def hash_embedder_udf(dims: int, batch: int = EMBED_BATCH):
    @F.pandas_udf(VECTOR_TYPE)
    def _embed(hashes: pd.Series) -> pd.Series:
        return _scatter(hashes, dims, batch)
    return _embed


def callable_embedder_udf(fn: Callable, dims: int, batch: int = EMBED_BATCH):
    """Wrap ``fn(list[str]) -> (n, dims)`` so it runs on Arrow batches."""
    @F.pandas_udf(VECTOR_TYPE)
    def _embed(texts: pd.Series) -> pd.Series:
        out = []
        for start in range(0, len(texts), batch):
            chunk = texts.iloc[start:start + batch].fillna("").tolist()
            vecs = np.asarray(fn(chunk), dtype=np.float32)
            if vecs.ndim != 2 or vecs.shape[0] != len(chunk):
                raise ValueError(f"embedder returned {vecs.shape} for {len(chunk)} texts")
            if vecs.shape[1] != dims:
                raise ValueError(f"embedding size must be {dims}, got {vecs.shape[1]}")
            out.extend(vecs)
        return pd.Series(out, index=texts.index, dtype=object)
    return _embed


def embed_column(text, dims: int = 64, embedder: Callable | None = None,
                 batch: int = EMBED_BATCH, max_chars: int | None = None) -> Column:
    """Vector column for a text column.  ``max_chars`` (off by default) cuts
    the input like the reference's single-text path does."""
    c = F.col(text) if isinstance(text, str) else text
    if max_chars:
        c = F.substring(c, 1, max_chars)
    if embedder is None:
        v = hash_embedder_udf(dims, batch)(token_hashes(c))
    else:
        v = callable_embedder_udf(embedder, dims, batch)(c)
    return check_dims(v, dims)


def embed_text(df: DataFrame, col: str = "text_chunk", dims: int = 64,
               embedder: Callable | None = None, batch: int = EMBED_BATCH,
               max_chars: int | None = None, out: str = "embedding") -> DataFrame:
    return df.withColumn(out, embed_column(col, dims, embedder, batch, max_chars))
