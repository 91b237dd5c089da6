"""Columns whose names operators might use inside come through as they are."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cataloom.llm import best_fit, langid, line_dedup, ngram_join, quality, url_filter
from cataloom.llm.common import own_names
from cataloom.llm.queries import URL_RULES, tokens

NAMES = "h p v w hit rh rp full short e n ls __h H_ row keys key __row __gone __key cls root keep a b c url_ item".split()
LOOKS = {c: f"{c}!" for c in NAMES}
LINES = "shared line of all\nown line "


@pytest.fixture(scope="module")
def docs(spark):
    texts = [LINES + str(i) for i in range(12)] + [None, "", "one two three four five six", "one two three four five six", "word " * 30_000]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").select(
        "*", *[F.lit(x).alias(c) for c, x in LOOKS.items()])


def unchanged(df, n):
    rows = df.select(*[F.col(c) for c in NAMES]).collect()
    assert len(rows) == n and all(r.asDict() == LOOKS for r in rows)


def test_own_names(spark):
    assert own_names(spark.createDataFrame([], "A int, a_ int"), "a", "b", "B") == ["a__", "b", "B_"]


def test_url_filter_keeps_columns(docs, spark):
    urls = docs.select("*", F.lit("http://www.example.com/en/x").alias("url"))
    got = url_filter.judge(urls, url_filter.rules_frame(spark, URL_RULES))
    unchanged(got, 17)
    assert {r.rule for r in got.collect()} == {"www.example.com/en/"}


def test_packing_keeps_columns(docs):
    pieces = docs.select("*", F.lit(7).cast("long").alias("length"))
    unchanged(best_fit.pack(pieces), 17)


def test_line_dedup_keeps_columns(docs, spark):
    given = docs.withColumn("_n_lines", F.lit("old"))
    got = line_dedup.LineIndex(spark, 10).insert(given).dedup(given)
    unchanged(got, 17)
    assert sorted(r._n_dropped for r in got.collect()) == [0] * 5 + [1] * 12
    assert [r._n_lines for r in got.filter("doc_id = 3").collect()] == [2]


def test_near_copies_keep_columns(docs):
    unchanged(ngram_join.drop_near_copies(docs, "doc_id", "text"), 16)


def test_models_keep_columns(docs, spark, monkeypatch):
    lang = docs.filter("doc_id < 12").select("*", F.lit("en").alias("lang"))
    model = langid.fit(lang, "lang", "text")
    n = langid.keep_identified(docs, "text", model).count()
    unchanged(langid.keep_identified(docs, "text", model), n)
    monkeypatch.setattr(langid, "MAX_CELLS", 1)
    table = langid.fit(lang, "lang", "text")
    assert isinstance(table, langid.TableModel)
    unchanged(langid.keep_identified(docs, "text", table), n)


def test_of_several_labels_the_smallest_counts(spark):
    docs = spark.createDataFrame([(i, "good fine text" if i % 2 else "bad poor words") for i in range(40)], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(40)] + [(i, 1) for i in range(0, 40, 2)]
    models = [quality.fit(docs, spark.createDataFrame(x, "doc_id long, quality int").repartition(n), "doc_id", "text", "quality")
              for n, x in ((1, labels), (5, labels[::-1]), (2, labels[:40]))]
    assert all((m[0] == models[0][0]).all() and m[1] == models[0][1] for m in models)
