"""Exact phrase search, hit shaping, ordered merge and the per-hit reports.

Questions are a DataFrame (one row per question), so every operator answers a
whole batch in one plan.  All phrases of a bounded block of questions are searched
in one pass over each text (``phrases``).  Per-question top-k uses
``row_number() <= k``, which Spark plans as a WindowGroupLimit before the
shuffle, so a phrase that matches a third of the store still moves only k
rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cataloom.functions.text import normalize_question, preview, significant_tokens
from cataloom.operators.phrases import phrase_join
from cataloom.operators.util import rank_within, spread, union_all, written

# Defaults of the reference: exact k 3 in 0..10 (ask), merged cap 10 (ask),
# max(3, k) (answer); snippet half-width 60.
EXACT_K, EXACT_K_MAX = 3, 10
MERGE_CAP = 10
SNIPPET_SPAN = 60
NO_ANSWER = "I don't know."


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- #26 optional_filter -------------------------------------------------------

def scope_id(dataset_id: str | None) -> str | None:
    """'all', blank and NULL all mean: no dataset filter."""
    if dataset_id is None:
        return None
    d = str(dataset_id).strip()
    return None if (not d or d == "all") else d


def scope_column(c) -> Column:
    """The same rule for a column of scopes: NULL where there is no filter."""
    d = F.trim(_c(c).cast("string"))
    return F.when((d != "") & (d != "all"), d)


def optional_filter(store: DataFrame, dataset_id: str | None = None) -> DataFrame:
    """``$1 IS NULL OR dataset_id = $1`` decided at plan time, so a given id is
    an equality filter Parquet can push down (and partition pruning on a store
    partitioned by dataset_id), and no id means no filter at all.  In the batch
    operators the same rule is part of the join condition per question."""
    d = scope_id(dataset_id)
    return store if d is None else store.where(F.col("dataset_id") == F.lit(d))


# --- #43 / #48 exact phrase search ----------------------------------------------

def _phrase(q: Column, mode: str) -> Column:
    return normalize_question(q) if mode == "normalized" else q


def _questions(questions: DataFrame, mode: str, wildcards: bool) -> DataFrame:
    """qid, _phrase, _lphrase (lower case), _wild, _qds and k, if given, of the questions that
    have a phrase.  ILIKE is lower(a) LIKE lower(b): without a live wildcard it is exactly a
    substring test on lower-cased text."""
    cols = set(questions.columns)
    q = questions.select(
        "qid",
        _phrase(F.col("question"), mode).alias("_phrase"),
        scope_column(F.col("dataset_id") if "dataset_id" in cols else F.lit(None)).alias("_qds"),
        *([F.col("k")] if "k" in cols else []))
    q = q.where(F.col("_phrase").isNotNull() & (F.length("_phrase") > 0))
    q = q.withColumn("_lphrase", F.lower("_phrase"))
    if not wildcards:
        return q.withColumn("_wild", F.lit(False))
    q = q.withColumn("_wild", F.col("_phrase").rlike(r"[%_\\]"))
    # a backslash that escapes nothing stands for itself
    return q.withColumn("_lphrase", F.when(F.col("_wild"), F.regexp_replace(
        "_lphrase", r"(?<!\\)(?:\\\\)*\\(?![%_\\])", "$0\\\\")).otherwise(F.col("_lphrase")))


def theta_ilike_join(store: DataFrame, questions: DataFrame, mode: str = "normalized",
                     wildcards: bool = False) -> DataFrame:
    """(store columns..., qid, _phrase, k if given) for every store row that contains the phrase.

    mode ``normalized``: the question is normalised first (ask); ``raw``: used
    as typed (answer).  ``wildcards=True`` keeps ``%``, ``_`` and ``\\`` live
    as in ``ILIKE '%' || q || '%'``; the default matches the phrase literally.
    An empty phrase matches nothing.  All questions of a block are searched in one
    pass over each text (``phrases``)."""
    s = spread(store).withColumn("_ltext", F.lower("text_chunk"))
    return phrase_join(s, _questions(questions, mode, wildcards), "_ltext", "_lphrase", "_wild",
                       "dataset_id", "_qds", drop=("_ltext", "_lphrase", "_wild", "_qds"))


def exact_keys(store: DataFrame, questions: DataFrame, k: int = EXACT_K,
               mode: str = "normalized", wildcards: bool = False) -> DataFrame:
    """qid, dataset_id, pk, distance, rank of ``exact_topk``: texts are read, not carried."""
    s = spread(store.select("dataset_id", "pk", "text_chunk")).select(
        "dataset_id", "pk", F.lower("text_chunk").alias("_ltext"))
    hits = phrase_join(s, _questions(questions, mode, wildcards), "_ltext", "_lphrase", "_wild",
                       "dataset_id", "_qds", drop=("_ltext", "_phrase", "_lphrase", "_wild", "_qds"))
    return _first_by_key(hits, k)


def _first_by_key(hits: DataFrame, k: int) -> DataFrame:
    """The first k rows of each question by (pk, dataset_id), distance 0; a column k of the
    hits holds instead.  The limit is applied in each task before the shuffle."""
    w = Window.partitionBy("qid").orderBy(F.col("pk").asc_nulls_last(),
                                          F.col("dataset_id").asc_nulls_last())
    ranked = hits.withColumn("rank", F.row_number().over(w))
    ranked = ranked.where(F.col("rank") <= (F.col("k") if "k" in hits.columns else F.lit(k)))
    return ranked.withColumn("distance", F.lit(0.0)).drop("k")


def with_text(keys: DataFrame, store: DataFrame) -> DataFrame:
    """Hit keys with their ``text_chunk``.  The keys are written first, so the join is planned
    from their size: small ones are broadcast and the texts are read once in place, others are
    joined by shuffle."""
    keys = written(keys, "hit-keys")
    return (store.select("dataset_id", "pk", "text_chunk")
            .join(keys, ["dataset_id", "pk"])
            .select("qid", "dataset_id", "pk", "text_chunk",
                    *[c for c in keys.columns if c not in ("qid", "dataset_id", "pk")]))


def exact_topk(store: DataFrame, questions: DataFrame, k: int = EXACT_K,
               mode: str = "normalized", wildcards: bool = False) -> DataFrame:
    """First k matching rows per question ordered by pk (then dataset_id),
    distance 0.  ``k = 0`` returns nothing.  (dataset_id, pk) is the key of the store.
    Output: qid, dataset_id, pk, text_chunk, distance, rank."""
    keys = exact_keys(store, questions, max(0, k), mode, wildcards)
    return with_text(keys, store).select("qid", "dataset_id", "pk", "text_chunk", "distance", "rank")


# --- #52 shape_hits ---------------------------------------------------------------

def shape_hits(hits: DataFrame, style: str = "ask", n: int = 200) -> DataFrame:
    """preview = first n chars + '…'; a non-finite distance becomes NULL (ask)
    or 0 (answer)."""
    d = F.col("distance")
    bad = d.isNull() | F.isnan(d) | (F.abs(d) == F.lit(float("inf")))
    fixed = F.lit(None).cast("double") if style == "ask" else F.lit(0.0)
    return hits.withColumn("preview", preview("text_chunk", n)).withColumn(
        "distance", F.when(bad, fixed).otherwise(d))


# --- #53 merge_dedupe / #57 ranked_context ---------------------------------------------

def merge_dedupe(parts: list[tuple[str, DataFrame]], cap: int = MERGE_CAP) -> DataFrame:
    """Ordered union of hit lists: keep the first hit per (qid, dataset_id, pk)
    in (part order, rank) order, then the first ``cap`` per question.

    One shuffle on qid serves both windows (a hash partitioning on qid
    satisfies the clustering on (qid, dataset_id, pk))."""
    tagged = [df.withColumn("origin", F.lit(name)).withColumn("_o", F.lit(i))
              for i, (name, df) in enumerate(parts)]
    allh = union_all(tagged).repartition("qid")
    first = Window.partitionBy("qid", "dataset_id", "pk").orderBy("_o", "rank")
    kept = allh.withColumn("_n", F.row_number().over(first)).where(F.col("_n") == 1)
    order = Window.partitionBy("qid").orderBy("_o", "rank")
    return (kept.withColumn("merged_rank", F.row_number().over(order))
            .where(F.col("merged_rank") <= cap)
            .drop("_n", "_o", "rank").withColumnRenamed("merged_rank", "rank"))


def ranked_context(hits: DataFrame, order_cols=("rank",)) -> DataFrame:
    """1-based rank of each hit inside its question; a question's hits may be any number
    and are ranked by many tasks."""
    return rank_within(hits, ["qid"], list(order_cols))


# --- #40 context_string -------------------------------------------------------------------

def context_string(hits: DataFrame, style: str = "full") -> DataFrame:
    """One context text per question.

    full (ask): '#i [dataset=D pk=P]\\n<text>' blocks joined by a blank line.
    preview (answer): '#i [dataset=D pk=P] <preview>' joined by a blank line,
    '(none)' when a question has no hits (questions frame left-joined by caller).
    A question holds at most ``cap`` hits, so the per-question list is bounded."""
    body = F.col("text_chunk") if style == "full" else F.col("preview")
    sep = F.lit("\n") if style == "full" else F.lit(" ")
    line = F.concat(F.lit("#"), F.col("rank").cast("string"), F.lit(" [dataset="),
                    F.col("dataset_id"), F.lit(" pk="), F.col("pk"), F.lit("]"), sep, body)
    g = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("t"))))
                                .alias("_l"))
    return g.select("qid", F.array_join(F.transform("_l", lambda x: x["t"]), "\n\n").alias("context"))


def context_or_none(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    return (questions.select("qid").join(contexts, "qid", "left")
            .select("qid", F.coalesce("context", F.lit("(none)")).alias("context")))


# --- #55 / #56 tokens ---------------------------------------------------------------------

def question_tokens(questions: DataFrame) -> DataFrame:
    """(qid, pos, token) of the significant tokens of each question."""
    return questions.select("qid", F.posexplode(significant_tokens("question")).alias("pos", "token"))


def token_presence(hits: DataFrame, questions: DataFrame, span: int = SNIPPET_SPAN) -> DataFrame:
    """For each hit x question token: present, 0-based first index (-1 if
    absent) in the lower-cased text, and the lower-cased snippet of +-span
    characters around it (NULL if absent)."""
    toks = question_tokens(questions)
    h = hits.select("qid", "dataset_id", "pk", F.lower("text_chunk").alias("_low"))
    j = h.join(toks, "qid")
    idx = (F.instr(F.col("_low"), F.col("token")) - 1)
    a = F.greatest(F.lit(0), idx - span)
    b = F.least(F.length("_low"), idx + span)
    return j.select(
        "qid", "dataset_id", "pk", "pos", "token",
        (idx >= 0).alias("present"), idx.alias("idx"),
        F.when(idx >= 0, F.substring(F.col("_low"), a + 1, b - a)).alias("snippet"))


def unanswered(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Questions with no hit at all, with the fixed answer."""
    return (questions.select("qid").join(hits.select("qid").distinct(), "qid", "left_anti")
            .withColumn("answer", F.lit(NO_ANSWER)))
