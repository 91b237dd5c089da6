"""The registered queries of this subpackage, with DuckDB SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.llm import (best_fit, block_search, divergence, embedding_dedup, exact_dedup,
                          hard_negatives, html_text, langid, line_dedup, ngram_join, quality,
                          sentencepiece_codec, url_filter)
from cataloom.llm.common import held_out, table

#: Rules of the URL query: verdict, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"),
             ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"),
             ("block", "net", "/fr/")]
COSINE = 0.93
GOOD = 0.3
LINE_DOCUMENTS = 10
AUDIT_DOCUMENTS = 10


def tokens() -> dict:
    """Arguments of the packing tokenizer; documents end with id 0."""
    return {"tokenizer_file": public_tokenizers.path("byte_bpe_50k.json"),
            "ranks_file": public_tokenizers.path("byte_bpe_50k.tiktoken"),
            "pattern": public_tokenizers.PATTERN, "end_id": 0}


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return sentencepiece_codec.encode_documents(
        docs, "doc_id", "text", public_tokenizers.path("piece_bpe_32k.model")
    ).withColumnRenamed("id", "doc_id")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    return url_filter.judge(pages, url_filter.rules_frame(spark, URL_RULES)).select(
        "page_id", "host", "path", "rule", "verdict")


def op3_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    pieces = best_fit.tokenize_pieces(docs, "doc_id", "text", tokens())
    return best_fit.pack(pieces).withColumnRenamed("id", "doc_id")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return html_text.extract(pages, "page_id", "url", "html").withColumnRenamed("id", "page_id")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    return embedding_dedup.near_dedup(vectors, "vec_id", "embedding", "label", COSINE
                                      ).withColumnRenamed("id", "vec_id")


def quality_model(spark: SparkSession, sf_dir: str):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    return quality.fit(docs, labels.filter(~held_out(F.col("doc_id"))), "doc_id", "text", "quality")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    scored = quality.score_documents(docs, "doc_id", "text", quality_model(spark, sf_dir))
    return scored.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"),
                         "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    index = line_dedup.LineIndex(spark, LINE_DOCUMENTS).insert(docs)
    return index.dedup(docs).select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return exact_dedup.exact_dedup(docs, "doc_id", "text", keep="max").withColumnRenamed(
        "id", "doc_id")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return ngram_join.ngram_join(docs, "doc_id", "text").select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id")


def language_model(spark: SparkSession, sf_dir: str) -> langid.Model:
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "text")
    return langid.fit(docs.filter(~held_out(F.col("doc_id"))), "lang", "text")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return langid.score_documents(docs, "doc_id", "text", language_model(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score",
        "rejected")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors, "vec_id", "embedding", label, F.col("vec_id") % 50 == 0
                               ).drop("label")


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return block_search.nearest(vectors, "vec_id", "embedding", F.col("vec_id") % 100 == 0)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "text", "lang", "source")
    return divergence.audit(docs, "text", "lang", "source", AUDIT_DOCUMENTS)


QUERIES = {f.__name__: f for f in (
    op1_sentencepiece, op2_url_filter, op3_best_fit, op4_html_text, op5_embedding_dedup,
    op6_quality, op7_line_dedup, op8_exact_dedup, op9_ngram_join, op10_langid,
    op11_hard_negatives, op12_nearest, op13_divergence)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RULES_SQL = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)

ORACLE = {
    "op2_url_filter": f"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0
                       THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT row_number() OVER () AS i, page_id,
         {_LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(v, h, p) AS (VALUES {_RULES_SQL}),
best AS (
  SELECT i, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY i)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM split LEFT JOIN best USING (i)""",
    "op7_line_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id,
                  string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT i, doc_id, pos, lines[pos] AS line,
             {_LOWER.format("trim(lines[pos], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k
      FROM (SELECT i, doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos FROM d)),
f AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT i) >= {LINE_DOCUMENTS})
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines,
       count(*) FILTER (f.k IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.k = f.k GROUP BY i""",
    "op8_exact_dedup": f"""
WITH d AS (SELECT doc_id, sha256({_LOWER.format("coalesce(text, '')")}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM d JOIN g USING (text_sha256)""",
    "op11_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
           FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
            AND list_count(embedding) = len(embedding)
            AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
a AS (SELECT * FROM v WHERE vec_id % 50 = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same,
             CAST(list_dot_product(a.x, v.x) AS BIGINT) AS score
      FROM a JOIN v ON a.vec_id <> v.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 3""",
    "op12_nearest": """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND list_count(embedding) = len(embedding)
             AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, v.vec_id, list_distance(q.x, v.x) AS score
      FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM d
WINDOW w AS (PARTITION BY query_id ORDER BY score, vec_id)
QUALIFY row_number() OVER w <= 10""",
    "op13_divergence": f"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang,
                  coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all({_LOWER.format('text')},
             '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY ALL
      HAVING count(DISTINCT i) >= {AUDIT_DOCUMENTS}),
l AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS total
      FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n,
        CAST(1 + (1000000000 * CAST(coalesce(n, 0) + 2 AS HUGEINT)) // (total + 2 * v) AS BIGINT) AS p,
        CAST(1 + (1000000000 * CAST(lang_n + 2 AS HUGEINT)) // (lang_total + 2 * v) AS BIGINT) AS q
      FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT a.lang, a.source, b.source AS item,
             CAST(sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS BIGINT) AS value
      FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p
      WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER w AS INTEGER) AS rank FROM r
WINDOW w AS (PARTITION BY lang, source, part ORDER BY value DESC, item)
QUALIFY part = 'pair' OR row_number() OVER w <= 10""",
}
