"""Hybrid retrieval for a batch of questions: exact phrase hits plus vector
nearest neighbours, shaped, merged in order, de-duplicated and capped.

The two halves are independent plans over the same store that yield keys only;
they are merged and capped, and the texts of the few remaining hits are read at
the end in one join with the store (``search.with_text``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.operators import knn, search
from cataloom.operators.embed import embed_text
from cataloom.operators.util import cut_lineage

ASK = dict(k=knn.COSINE_K, k_exact=search.EXACT_K, cap=search.MERGE_CAP, metric="cosine",
           order="semantic_first", exact_mode="normalized", wildcards=False, style="ask")


def answer_settings(k: int = knn.INNER_K) -> dict:
    """The answer endpoint: raw phrase with live wildcards, inner product,
    exact first, one shared k, cap max(3, k), bad distance -> 0."""
    k = knn.answer_k(k)
    return dict(k=k, k_exact=k, cap=max(3, k), metric="inner", order="exact_first",
                exact_mode="raw", wildcards=True, style="answer")


def semantic_keys(store: DataFrame, questions: DataFrame, k: int, metric: str) -> DataFrame:
    """Hit keys of the questions that have a vector."""
    return knn.knn_batch(store, questions.where(F.col("embedding").isNotNull()), k=k, metric=metric)


def embed_questions(questions: DataFrame, dims: int = 64,
                    embedder: Callable | None = None) -> DataFrame:
    """Questions with the vector of their text, computed once; blank texts and
    texts without a word (zero vector) have none."""
    said = F.length(F.trim(F.coalesce("question", F.lit("")))) > 0
    q = embed_text(questions, "question", dims, embedder)
    return cut_lineage(q.withColumn("embedding", F.when(
        said & F.exists("embedding", lambda x: x != 0), F.col("embedding"))))


def hybrid_retrieve(store: DataFrame, questions: DataFrame, k: int = ASK["k"],
                    k_exact: int = ASK["k_exact"], cap: int = ASK["cap"],
                    metric: str = "cosine", order: str = "semantic_first",
                    exact_mode: str = "normalized", wildcards: bool = False,
                    style: str = "ask", index: DataFrame | None = None, dims: int = 64,
                    embedder: Callable | None = None) -> DataFrame:
    """Hits per question: qid, rank, origin, dataset_id, pk, distance,
    preview, text_chunk.  ``store``: dataset_id, pk, text_chunk, embedding.
    ``questions``: qid, question, optional embedding and dataset_id.  Questions
    without an ``embedding`` column are embedded here with ``embedder`` (the one the
    store was embedded with; default: the built-in one of ``dims``); a blank
    question has no vector.
    ``index``: a gram index of the store (``gram_index.GramIndex``); when given,
    literal exact search probes it instead of reading every text."""
    if "embedding" not in questions.columns:
        questions = embed_questions(questions, dims, embedder)
    k = knn.clamp_k(k, 1, knn.COSINE_K_MAX if style == "ask" else knn.INNER_K_MAX)
    k_exact = max(0, min(search.EXACT_K_MAX if style == "ask" else knn.INNER_K_MAX, int(k_exact)))
    parts = {"semantic": semantic_keys(store, questions, k, metric)}
    if k_exact > 0:
        if index is not None and not wildcards:
            parts["exact"] = index.topk_keys(store, questions, k_exact, exact_mode)
        else:
            parts["exact"] = search.exact_keys(store, questions, k_exact, exact_mode, wildcards)
    names = ["semantic", "exact"] if order == "semantic_first" else ["exact", "semantic"]
    keys = search.merge_dedupe([(n, parts[n].select("qid", "dataset_id", "pk", "distance", "rank"))
                                for n in names if n in parts], cap)
    return search.shape_hits(search.with_text(keys, store), style).select(
        "qid", "rank", "origin", "dataset_id", "pk", "distance", "preview", "text_chunk")


def hybrid_answer(store: DataFrame, questions: DataFrame, k: int = knn.INNER_K, **kw) -> DataFrame:
    return hybrid_retrieve(store, questions, **answer_settings(k), **kw)


def ask_batch(store: DataFrame, questions: DataFrame, **kw) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits, contexts, unanswered): the model input of every answered
    question and the fixed answer for the others."""
    hits = hybrid_retrieve(store, questions, **kw)
    ctx = search.context_string(hits, "full")
    return hits, ctx, search.unanswered(questions, hits)
