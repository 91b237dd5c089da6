"""Registered text-rule, hit-report and seeding queries
(#9, #10, #26, #40, #47, #52-#57, #64-#67)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cataloom.functions import text as tx
from cataloom.operators import search
from cataloom.operators.util import union_all
from cataloom.plans import ask
from cataloom.queries import (ASK_SQL, NORM_SQL, PREVIEW_SQL, QUESTIONS_SQL, STORE_SQL, ask_frame,
                              query, question_frame, store_frame, t)
from cataloom.registered.retrieval import _hybrid_sql
from cataloom.sources import seed

STOP_SQL = "[" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + "]"
TOKENS_SQL = ("list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), "
              "'\\s+'), lambda w: length(w) >= 3 AND NOT list_contains(" + STOP_SQL + ", w))")


@query("normalize_question", f"""
SELECT conv_id, turn, {NORM_SQL.format(x='text')} AS phrase FROM conversations""")
def q_normalize_question(spark, sf):
    c = t(spark, sf, "conversations")
    return c.select("conv_id", "turn", tx.normalize_question("text").alias("phrase"))


@query("significant_tokens", f"""
SELECT conv_id, turn, CAST(len({TOKENS_SQL.format(x='text')}) AS INTEGER) AS n_tokens,
       array_to_string({TOKENS_SQL.format(x='text')}, ' ') AS tokens
FROM conversations""")
def q_significant_tokens(spark, sf):
    c = t(spark, sf, "conversations")
    toks = tx.significant_tokens("text")
    return c.select("conv_id", "turn", F.size(toks).alias("n_tokens"), F.array_join(toks, " ").alias("tokens"))


@query("shape_hits", f"SELECT doc_id, {PREVIEW_SQL.format(x='text')} AS preview FROM documents")
def q_shape_hits(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.col("text").alias("text_chunk"),
                                         F.lit(float("nan")).alias("distance"))
    return search.shape_hits(d, "ask").select("doc_id", "preview")


@query("optional_filter", f"SELECT dataset_id, pk FROM ({STORE_SQL}) s")
def q_optional_filter(spark, sf):
    """'all' means no dataset filter: the whole store."""
    return search.optional_filter(store_frame(spark, sf), "all").select("dataset_id", "pk")


@query("optional_filter_one", f"""
SELECT 'src3' AS asked, dataset_id, pk FROM ({STORE_SQL}) s WHERE dataset_id = 'src3'
UNION ALL SELECT 'blank', dataset_id, pk FROM ({STORE_SQL}) s
UNION ALL SELECT 'null', dataset_id, pk FROM ({STORE_SQL}) s""")
def q_optional_filter_one(spark, sf):
    """One id, a blank and no id: a filter, and twice none."""
    s = store_frame(spark, sf)
    parts = [search.optional_filter(s, v).select(F.lit(n).alias("asked"), "dataset_id", "pk")
             for n, v in (("src3", "src3"), ("blank", "  "), ("null", None))]
    return union_all(parts)


def _hits_sql() -> str:
    """The hybrid hits (ask settings) with their full text, as a CTE body."""
    base = _hybrid_sql(**ask.ASK)
    return base.replace(f"{PREVIEW_SQL.format(x='text_chunk')} AS preview", "text_chunk")


@query("merge_dedupe", f"""
SELECT qid, origin, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT dataset_id || '/' || pk) AS BIGINT) AS n_keys
FROM ({_hybrid_sql(**ask.ASK)}) h GROUP BY qid, origin""")
def q_merge_dedupe(spark, sf):
    h = ask.hybrid_retrieve(store_frame(spark, sf), ask_frame(spark, sf), **ask.ASK)
    return h.groupBy("qid", "origin").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct(F.concat("dataset_id", F.lit("/"), "pk")).alias("n_keys"))


@query("ranked_context", f"""
WITH s AS ({STORE_SQL}), q AS ({QUESTIONS_SQL}),
m AS (SELECT q.qid, s.dataset_id, s.pk,
             row_number() OVER (PARTITION BY q.qid ORDER BY s.pk, s.dataset_id) AS rank
      FROM s JOIN q ON length(q.question) > 0 AND contains(lower(s.text_chunk), lower(q.question)))
SELECT qid, CAST(rank AS INTEGER) AS rank, dataset_id, pk FROM m""")
def q_ranked_context(spark, sf):
    """1-based rank of every exact hit of every benchmark passage."""
    j = search.theta_ilike_join(store_frame(spark, sf), question_frame(spark, sf), mode="raw")
    r = search.ranked_context(j, order_cols=("pk", "dataset_id"))
    return r.select("qid", "rank", "dataset_id", "pk")


@query("context_string", f"""
SELECT qid, sha256(string_agg('#' || CAST(rank AS VARCHAR) || ' [dataset=' || dataset_id || ' pk=' || pk || ']'
                             || chr(10) || text_chunk, chr(10) || chr(10) ORDER BY rank)) AS context_sha,
       CAST(sum(length(text_chunk)) AS BIGINT) AS text_chars
FROM ({_hits_sql()}) h GROUP BY qid""")
def q_context_string(spark, sf):
    h = ask.hybrid_retrieve(store_frame(spark, sf), ask_frame(spark, sf), **ask.ASK)
    ctx = search.context_string(h, "full")
    chars = h.groupBy("qid").agg(F.sum(F.length("text_chunk")).cast("bigint").alias("text_chars"))
    return ctx.join(chars, "qid").select("qid", F.sha2("context", 256).alias("context_sha"), "text_chars")


@query("context_preview", f"""
WITH q AS ({ASK_SQL}), h AS ({_hybrid_sql(**ask.answer_settings(5))}),
c AS (SELECT qid, string_agg('#' || CAST(rank AS VARCHAR) || ' [dataset=' || dataset_id || ' pk=' || pk || '] '
                             || preview, chr(10) || chr(10) ORDER BY rank) AS context FROM h GROUP BY qid)
SELECT qid, coalesce(context, '(none)') AS context FROM q LEFT JOIN c USING (qid)""")
def q_context_preview(spark, sf):
    """Answer style: previews in one line each, '(none)' for questions without a hit."""
    qs = ask_frame(spark, sf)
    hits = ask.hybrid_answer(store_frame(spark, sf), qs, k=5)
    return search.context_or_none(qs, search.context_string(hits, "preview"))


@query("token_presence", f"""
WITH h AS ({_hits_sql()}), q AS ({ASK_SQL}),
tk AS (SELECT qid, unnest({TOKENS_SQL.format(x='question')}) AS token,
              generate_subscripts({TOKENS_SQL.format(x='question')}, 1) - 1 AS pos FROM q),
j AS (SELECT h.qid, h.dataset_id, h.pk, tk.pos, tk.token, lower(h.text_chunk) AS low,
             CAST(instr(lower(h.text_chunk), tk.token) AS BIGINT) - 1 AS idx FROM h JOIN tk USING (qid))
SELECT qid, dataset_id, pk, CAST(pos AS INTEGER) AS pos, token, idx >= 0 AS present, CAST(idx AS INTEGER) AS idx,
       CASE WHEN idx >= 0 THEN substr(low, greatest(0, idx - 60) + 1,
            CAST(least(length(low), idx + 60) - greatest(0, idx - 60) AS BIGINT)) END AS snippet
FROM j""")
def q_token_presence(spark, sf):
    qs = ask_frame(spark, sf)
    h = ask.hybrid_retrieve(store_frame(spark, sf), qs, **ask.ASK)
    tp = search.token_presence(h, qs)
    return tp.select("qid", "dataset_id", "pk", F.col("pos").cast("int").alias("pos"), "token", "present",
                     F.col("idx").cast("int").alias("idx"), "snippet")


@query("unanswered", f"""
WITH q AS ({ASK_SQL}), h AS ({_hybrid_sql(**ask.ASK)})
SELECT qid, 'I don''t know.' AS answer FROM q WHERE qid NOT IN (SELECT qid FROM h)""")
def q_unanswered(spark, sf):
    qs = ask_frame(spark, sf)
    h = ask.hybrid_retrieve(store_frame(spark, sf), qs, **ask.ASK)
    return search.unanswered(qs, h)


# --- naming / seeding rules --------------------------------------------------------

@query("table_name", """
SELECT p_partkey, lower(regexp_replace(p_name, '[^A-Za-z0-9]+', '_', 'g')) AS table_name,
       'ds_' || lower(regexp_replace(p_name, '[^A-Za-z0-9]+', '_', 'g')) AS dataset_id FROM part""")
def q_table_name(spark, sf):
    p = t(spark, sf, "part")
    return p.select("p_partkey", tx.table_name("p_name").alias("table_name"),
                    tx.dataset_id_for("p_name").alias("dataset_id"))


@query("id_to_entity", """
SELECT c_custkey, nullif(regexp_extract('ds_entity_' || CASE WHEN c_custkey < 1000 THEN lpad(CAST(c_custkey AS VARCHAR), 3, '0')
                                                     ELSE CAST(c_custkey AS VARCHAR) END,
                                        '^ds_(entity_\\d{3})$', 1), '') AS entity
FROM customer""")
def q_id_to_entity(spark, sf):
    c = t(spark, sf, "customer")
    digits = F.col("c_custkey").cast("string")
    ids = F.concat(F.lit("ds_entity_"),
                   F.lpad(digits, F.greatest(F.lit(3), F.length(digits)), F.lit("0")))
    return c.select("c_custkey", tx.id_to_entity(ids).alias("entity"))


@query("rotate_source", """
WITH s(si, source) AS (VALUES """ + ", ".join(
    f"({i}, '{s}')" for i, s in enumerate(seed.DEMO_SOURCES)) + """),
o(source, oi, opt) AS (VALUES """ + ", ".join(
    f"('{s}', {j}, '{o}')" for s in seed.DEMO_SOURCES for j, o in enumerate(seed.SOURCE_NAME_OPTIONS[s])) + """)
SELECT c.c_custkey AS i, s.source, o.opt || '_' || 
       lpad(CAST(c.c_custkey AS VARCHAR), (SELECT length(CAST(max(c_custkey) AS VARCHAR)) FROM customer)::INTEGER, '0') AS name
FROM customer c JOIN s ON s.si = ((c.c_custkey - 1) % 14 + 14) % 14
JOIN o ON o.source = s.source AND o.oi = ((c.c_custkey - 1) % 4 + 4) % 4""")
def q_rotate_source(spark, sf):
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("i"))
    return seed.rotate_source(c, "i").select("i", "source", "name")
