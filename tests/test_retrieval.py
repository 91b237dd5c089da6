"""Vector search, exact phrase search, merge and hybrid retrieval, checked
against brute force on small fixtures."""

import math
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cataloom.functions.text import normalize_question, significant_tokens
from cataloom.operators import knn, search
from cataloom.operators.embed import embed_text
from cataloom.operators.gram_index import GramIndex
from cataloom.plans import ask
from cataloom.session import scratch_path

STORE = "dataset_id string, pk string, text_chunk string, embedding array<float>"


def _store(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(60):
        v = rng.normal(size=8).astype(np.float32)
        rows.append((f"ds{i % 3}", str(i), f"row {i} text of the thing {'blue gorilla' if i % 7 == 0 else ''}",
                     [float(x) for x in v]))
    rows.append(("ds0", "zero", "zero vector", [0.0] * 8))
    rows.append(("ds1", "dup_a", "same vector a", rows[5][3]))
    rows.append(("ds1", "dup_b", "same vector b", rows[5][3]))
    return spark.createDataFrame(rows, STORE), rows


def _brute(rows, q, k, metric="cosine", ds=None):
    out = []
    for d, pk, _, v in rows:
        if ds is not None and d != ds:
            continue
        a, b = np.asarray(v, dtype=np.float64), np.asarray(q, dtype=np.float64)
        if metric == "cosine":
            den = math.sqrt((a @ a) * (b @ b))
            dist = None if den == 0 else 1 - (a @ b) / den
        else:
            dist = -(a @ b)
        out.append((dist, d, pk))
    out.sort(key=lambda x: (x[0] is None, x[0] if x[0] is not None else 0, x[1], x[2]))
    return out[:k]


def test_knn_cosine_matches_brute_force(spark):
    store, rows = _store(spark)
    q = rows[5][3]
    got = [(r.distance, r.dataset_id, r.pk) for r in knn.knn_cosine(store, q, k=8).collect()]
    want = _brute(rows, q, 8)
    assert [(d, p) for _, d, p in got] == [(d, p) for _, d, p in want]
    assert abs(got[0][0]) < 1e-9          # self distance is 0
    # three identical vectors tie exactly; the tie is broken by (dataset_id, pk)
    assert got[0][0] == got[1][0] == got[2][0]
    assert [(d, p) for _, d, p in got[:3]] == [("ds1", "dup_a"), ("ds1", "dup_b"), ("ds2", "5")]


def test_zero_vector_sorts_last_with_null_distance(spark):
    store, rows = _store(spark)
    got = knn.knn_cosine(store, rows[0][3], k=25, dataset_id="ds0").collect()
    assert all(r.pk != "zero" for r in got[:-1])
    allz = knn.knn_cosine(store.where("pk = 'zero'"), rows[0][3], k=1).collect()
    assert allz[0].distance is None


def test_knn_inner_and_k_rules(spark):
    store, rows = _store(spark)
    q = rows[3][3]
    got = [r.pk for r in knn.knn_inner(store, q, k=5).collect()]
    assert got == [p for _, _, p in _brute(rows, q, 5, "inner")]
    assert knn.clamp_k(float("nan")) == 1 and knn.clamp_k(99) == 25 and knn.clamp_k(3.9) == 3
    assert knn.answer_k(0) == 5 and knn.answer_k(51) == 5 and knn.answer_k(50) == 50


def test_knn_batch_equals_single_queries(spark):
    store, rows = _store(spark)
    qs = spark.createDataFrame([(i, rows[i][3], None if i % 2 else "ds1") for i in range(6)],
                               "qid long, embedding array<float>, dataset_id string")
    got = knn.knn_batch(store, qs, k=4).collect()
    for i in range(6):
        mine = sorted((r.rank, r.pk) for r in got if r.qid == i)
        want = _brute(rows, rows[i][3], 4, ds=None if i % 2 else "ds1")
        assert [p for _, p in mine] == [p for _, _, p in want]


def test_knn_batch_blocks_give_same_result(spark):
    store, rows = _store(spark)
    qs = spark.createDataFrame([(i, rows[i][3]) for i in range(10)], "qid long, embedding array<float>")
    a = {(r.qid, r.pk, r.rank) for r in knn.knn_batch(store, qs, k=3).collect()}
    b = {(r.qid, r.pk, r.rank) for r in knn.knn_batch(store, qs, k=3, block_bytes=2000).collect()}
    assert a == b


def test_normalize_and_tokens(spark):
    df = spark.createDataFrame([("  Is THERE a blue-gorilla?  Yes!! ",), ("?!",),
                                ("blue\u00a0gorilla\u2003here",)], "q string")
    r = df.select(normalize_question("q").alias("n"), significant_tokens("q").alias("t")).collect()
    assert r[0].n == "is there a blue gorilla yes"
    assert r[0].t == ["blue", "gorilla"]
    assert r[1].n == "" and r[1].t == []
    assert r[2].n == "blue gorilla here"          # non-ASCII spaces count as spaces


def test_exact_topk_literal_and_wildcards(spark):
    store, _ = _store(spark)
    qs = spark.createDataFrame([(1, "Blue Gorilla!", None), (2, "?!", None), (3, "row 1_ text", None),
                                (4, "blue gorilla", "ds2")], "qid long, question string, dataset_id string")
    hits = search.exact_topk(store, qs, k=3, mode="normalized").collect()
    by = {}
    for h in hits:
        by.setdefault(h.qid, []).append((h.rank, h.pk, h.dataset_id))
    assert 2 not in by                                   # empty phrase: no hits
    assert [p for _, p, _ in sorted(by[1])] == ["0", "14", "21"]  # ordered by pk as text
    assert all(d == "ds2" for _, _, d in by[4])
    assert 3 not in {h.qid for h in search.exact_topk(store, qs, 3, "raw", wildcards=False).collect()}
    wild = search.exact_topk(store, qs.where("qid = 3"), 10, "raw", wildcards=True).collect()
    assert {h.pk for h in wild} == {"10", "11", "12", "13", "14", "15", "16", "17", "18", "19"}


def test_merge_dedupe_order_and_cap(spark):
    a = spark.createDataFrame([(1, "d", "x", 1), (1, "d", "y", 2), (2, "d", "x", 1)],
                              "qid long, dataset_id string, pk string, rank int")
    b = spark.createDataFrame([(1, "d", "y", 1), (1, "d", "z", 2), (1, "d", "w", 3)],
                              "qid long, dataset_id string, pk string, rank int")
    m = search.merge_dedupe([("semantic", a), ("exact", b)], cap=3).collect()
    q1 = sorted((r.rank, r.pk, r.origin) for r in m if r.qid == 1)
    assert q1 == [(1, "x", "semantic"), (2, "y", "semantic"), (3, "z", "exact")]


def test_shape_hits(spark):
    df = spark.createDataFrame([("a" * 250, float("nan")), ("short", 0.5), ("é" * 200, float("inf"))],
                               "text_chunk string, distance double")
    r = search.shape_hits(df, "ask").collect()
    assert r[0].preview == "a" * 200 + "…" and r[0].distance is None
    assert r[1].preview == "short" and r[1].distance == 0.5
    assert r[2].preview == "é" * 200
    assert search.shape_hits(df, "answer").collect()[0].distance == 0.0


def test_hybrid_retrieve_and_reports(spark):
    store, rows = _store(spark)
    qs = spark.createDataFrame([(1, "Blue Gorilla!", rows[7][3]),
                                (2, "nothing like this", rows[8][3])],
                               "qid long, question string, embedding array<float>")
    hits = ask.hybrid_retrieve(store, qs, k=8, k_exact=3, cap=10)
    h = hits.collect()
    q1 = sorted((r.rank, r.origin, r.pk) for r in h if r.qid == 1)
    assert q1[0][1] == "semantic" and q1[0][2] == "7"
    assert [o for _, o, _ in q1] == ["semantic"] * 8 + ["exact"] * (len(q1) - 8)
    assert 9 <= len(q1) <= 10
    keys = [(r.qid, r.dataset_id, r.pk) for r in h]
    assert len(keys) == len(set(keys))
    ctx = {r.qid: r.context for r in search.context_string(hits).collect()}
    assert ctx[1].startswith("#1 [dataset=ds1 pk=7]\nrow 7 text")
    tp = search.token_presence(hits, qs).where("qid = 1 and pk = '7'").orderBy("pos").collect()
    assert [(t.token, t.present) for t in tp] == [("blue", True), ("gorilla", True)]
    assert tp[0].snippet.startswith("row 7 text of the thing blue")
    none = search.unanswered(qs, hits.where("qid = 1"))
    assert [(r.qid, r.answer) for r in none.collect()] == [(2, "I don't know.")]


def _pairs(store, questions, k=4, mode="normalized", wild=False):
    """Plain search: (qid, dataset_id, pk, rank)."""
    from pyspark.sql import functions as F
    texts = store.select("dataset_id", "pk", F.lower("text_chunk").alias("t")).collect()
    out = set()
    cols = set(questions.columns)
    q = questions.withColumn("p", F.lower(normalize_question("question") if mode == "normalized" else F.col("question")))
    for r in q.collect():
        scope = r.dataset_id if "dataset_id" in cols else None
        if r.p:
            hits = sorted((x.pk, x.dataset_id) for x in texts if x.t is not None and r.p in x.t
                          and (scope is None or scope == x.dataset_id))
            out |= {(r.qid, d, p, i + 1) for i, (p, d) in enumerate(hits[:k])}
    return out


AWKWARD = ["Alpha  beta\tgamma, delta!", "alpha beta gamma", "", None, "a", "ab", "Straße İstanbul ΣΑΣ 日本語テキスト", "aaaaaaaaaaaaaaaaaaaaab",
           "x" * 40_000 + "needle in hay" + "y" * 9_000, "zero\x00byte zero\x00", "row 1 text of", "tail-abcdefgh", "🙂🙃", "100% _sure_ \\ path"]


def _awkward_store(spark):
    store, _ = _store(spark)
    return store.unionByName(spark.createDataFrame(
        [(f"ds{i % 3}", f"x{i}", text, [1.0] * 8) for i, text in enumerate(AWKWARD)], STORE))


ASKED = ["text of the thing", "blue gorilla", "beta gamma, delta", "row 1 text of", "no such words here", "?!", "a", "ab", "aab", "aaaab", "needle in hay",
         "xxxxxneedle", "straße", "ΣΑΣ", "日本", "本語テキスト", "🙃", "e", "zero\x00", "\x00", "abcdefgh", "tail-abcdefgh", "tail-abcdefghi", "_sure_", "%", "\\", "", None]


def _awkward_questions(spark):
    rows = [(i, p, None) for i, p in enumerate(ASKED)] + [(100 + i, p, "ds1") for i, p in enumerate(ASKED)]
    return spark.createDataFrame(rows, "qid long, question string, dataset_id string")


def test_phrases_in_one_pass(spark, monkeypatch):
    """Literal phrases of all lengths against plain search, also in many tiles and rounds."""
    from cataloom.operators import blocks
    store, qs = _awkward_store(spark), _awkward_questions(spark)
    for k, sizes in ((4, None), (1000, (3000, 1500, 2500))):
        if sizes:
            for name, v in zip(("TILE_BYTES", "QUESTION_TILE_BYTES", "BLOCK_BYTES"), sizes):
                monkeypatch.setattr(blocks, name, v)
        for mode in ("raw", "normalized"):
            got = {(r.qid, r.dataset_id, r.pk, r.rank) for r in search.exact_topk(store, qs, k, mode).collect()}
            assert got == _pairs(store, qs, k, mode) and len(got) > 30
    plan = search.theta_ilike_join(store, qs)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_wildcard_patterns(spark):
    """Live wildcards against Spark's own LIKE."""
    store = _awkward_store(spark)
    asked = ["%", "_", "a%b", "r_w 1_ t%t", "al%%ma", "a_pha%delta", "100\\%", "\\_sure\\_", "\\\\ path", "日_語", "____", "%x%needle%y", "a%z%q", "_%_", "zero_byte"]
    qs = spark.createDataFrame(list(enumerate(asked)), "qid long, question string")
    got = {(r.qid, r.pk) for r in search.theta_ilike_join(store, qs, "raw", wildcards=True).collect()}
    want = {(r.qid, r.pk) for r in store.crossJoin(qs).where(
        "lower(text_chunk) LIKE concat('%', lower(question), '%')").collect()}
    assert got == want and len(want) > 200


def test_longest_literal():
    from cataloom.operators.phrases import longest_literal, pattern_regex
    assert [longest_literal(p) for p in ("a%bcd_e", "%", "_", r"\%50\_", r"x\\y%", "")] == ["bcd", "", "", "%50_", "x\\y", ""]
    assert pattern_regex("a%b_c").match("zza\nbb\nc") and not pattern_regex("a%b_c").match("b_c a")


def test_gram_index_equals_search(spark, monkeypatch):
    """Batches in any cut, merged or not, give the result of the plain search."""
    from cataloom.operators import gram_index
    monkeypatch.setattr(gram_index, "FANOUT", 3)
    store, qs = _awkward_store(spark), _awkward_questions(spark)
    index = gram_index.GramIndex(spark, scratch_path(spark, "grams"))
    assert index.segments() == [] and index.topk(store, qs).count() == 0
    parts = [store.where(F.pmod(F.xxhash64("pk"), F.lit(4)) == i) for i in range(4)]
    for p in parts[:2]:
        index.append(p)
    half = parts[0].unionByName(parts[1])
    got = {(r.qid, r.dataset_id, r.pk, r.rank) for r in index.topk(half, qs, 5, "raw").collect()}
    assert got == _pairs(half, qs, 5, "raw")
    for p in parts[2:]:
        index.append(p)
    index.append(parts[0])                      # rows appended again change nothing
    before = sum(n for _, n in index.segments())
    assert index.merge() and len(index.segments()) < 5 and sum(n for _, n in index.segments()) == before
    for mode in ("raw", "normalized"):
        got = {(r.qid, r.dataset_id, r.pk, r.rank) for r in index.topk(store, qs, 5, mode).collect()}
        assert got == _pairs(store, qs, 5, mode)
    gone = store.where("pk <> '0'")             # postings of rows that are no longer stored
    got = {(r.qid, r.dataset_id, r.pk, r.rank) for r in index.topk(gone, qs, 5, "raw").collect()}
    assert got == _pairs(gone, qs, 5, "raw")


def test_postings_of_long_texts(monkeypatch):
    from cataloom.operators import gram_index as g
    texts = [b"abcabcab", b"", b"x", "日本語".encode() * 9]
    want = sorted({(int.from_bytes((t + b"\0\0\0")[i:i + 4], "big"), d) for d, t in enumerate(texts) for i in range(len(t))})
    for piece in (1 << 20, 5, 1):
        monkeypatch.setattr(g, "PIECE_BYTES", piece)
        gram, doc = g._postings(texts)
        assert list(zip(gram.tolist(), doc.tolist())) == want


def test_hybrid_with_index_equals_without(spark):
    store, rows = _store(spark)
    qs = spark.createDataFrame([(1, "text of the thing blue", rows[7][3]), (2, "gorilla", rows[8][3])],
                               "qid long, question string, embedding array<float>")
    index = GramIndex(spark, scratch_path(spark, "grams"))
    index.append(store)
    a = {tuple(r) for r in ask.hybrid_retrieve(store, qs).select("qid", "rank", "origin", "pk").collect()}
    b = {tuple(r) for r in ask.hybrid_retrieve(store, qs, index=index)
         .select("qid", "rank", "origin", "pk").collect()}
    assert a == b


def _texts(spark, n=30):
    return spark.createDataFrame(
        [("a" if i % 2 else "b", f"{i:03d}", f"row c:\\path {i} 100%", [1.0, float(i)]) for i in range(n)],
        "dataset_id string, pk string, text_chunk string, embedding array<float>")


def test_scope_words_backslash_and_own_k(spark):
    q = spark.createDataFrame(
        [(1, "C:\\PATH", "all", 20), (2, "c:\\path", " ", 30), (3, "path", "a", 12), (4, "100\\%", None, 2),
         (5, "path 7 \\", None, 5)], "qid long, question string, dataset_id string, k long")
    store = _texts(spark)
    hits = search.exact_topk(store, q, mode="raw", wildcards=True)
    got = {r.qid: r["count"] for r in hits.groupBy("qid").count().collect()}
    assert got == {1: 20, 2: 30, 3: 12, 4: 2}
    lit = q.where("qid < 4")
    want = {tuple(r) for r in search.exact_topk(store, lit, mode="raw").collect()}
    index = GramIndex(spark, scratch_path(spark, "grams"))
    index.append(store)
    assert {tuple(r) for r in index.topk(store, lit, mode="raw").collect()} == want
    assert len(want) == 62


def test_questions_without_a_vector_keep_their_exact_half(spark):
    q = spark.createDataFrame([(1, "path 3", None, "all"), (2, "path 4", [1.0, 2.0], "all"), (3, "none", None, "a")],
                              "qid long, question string, embedding array<float>, dataset_id string")
    hits = ask.hybrid_retrieve(_texts(spark), q, k=40, cap=100, exact_mode="raw", style="ask")
    got = {(r.qid, r.origin): r["count"] for r in hits.groupBy("qid", "origin").count().collect()}
    assert got[(1, "exact")] == 1 and got[(2, "semantic")] == 25 and (1, "semantic") not in got
    assert not any(k[0] == 3 for k in got)


def test_hybrid_retrieve_embeds_question_texts(spark):
    texts = ["red apple pie", "green apple tart", "blue whale song", "apple", "whale watching", ""]
    store = embed_text(spark.createDataFrame(
        [("d", str(i), x) for i, x in enumerate(texts)], "dataset_id string, pk string, text_chunk string"))
    questions = spark.createDataFrame(
        [(1, "apple pie"), (2, "whale"), (3, "  "), (4, "?!"), (5, None)], "qid long, question string")
    hits = ask.hybrid_retrieve(store, questions, k=2, k_exact=0).collect()
    vectors = {r.pk: np.asarray(r.embedding, dtype=np.float64) for r in store.collect()}
    asked = embed_text(questions, "question").where("qid < 3").collect()
    for q in asked:
        v = np.asarray(q.embedding, dtype=np.float64)
        sims = sorted((1 - v @ w / (np.linalg.norm(v) * np.linalg.norm(w)), pk)
                      for pk, w in vectors.items() if np.linalg.norm(w) > 0)
        got = sorted((r["rank"], r.distance, r.pk) for r in hits if r.qid == q.qid)
        assert [p for _, _, p in got] == [p for _, p in sims[:2]]
        assert np.allclose([d for _, d, _ in got], [d for d, _ in sims[:2]])
    assert {r.qid for r in hits} == {1, 2}          # blank, wordless and null questions


def test_local_topk_keeps_the_nearest_of_every_question(monkeypatch):
    import pandas as pd
    rng = np.random.default_rng(3)
    n, m = 200, 23
    pdf = pd.DataFrame({"dataset_id": [f"d{i % 3}" for i in range(n)], "pk": [str(i) for i in range(n)],
                        "embedding": [None if i % 17 == 0 else
                                      rng.integers(-1, 2, size=2).astype(np.float32) for i in range(n)]})
    Q = rng.integers(-1, 2, size=(m, 2)).astype(np.float64)
    p = {"Q": Q, "qn": np.sqrt((Q * Q).sum(axis=1)), "qids": np.arange(m),
         "qds": [None, "d1", "none"] * 7 + [None, "d2"], "qk": np.array([1, 5, 500] * 7 + [3, 60])}
    store = pa.RecordBatch.from_pandas(pdf, preserve_index=False)
    asked = SimpleNamespace(Q=Q, norm=p["qn"], qid=p["qids"], scope=p["qds"], k=p["qk"])
    for cells, ties in ((4_000_000, 64), (n * 4, 0)):           # several groups, crowds at the cut
        monkeypatch.setattr(knn, "MATRIX_CELLS", cells)
        monkeypatch.setattr(knn, "TIES_KEPT", ties)
        for metric in ("cosine", "inner"):
            got = knn._first_k(knn._local_topk(store, asked, metric))
            for j in range(m):
                rows = []
                for ds, pk, v in pdf.itertuples(index=False):
                    if p["qds"][j] in (None, ds):
                        bad = v is None or (metric == "cosine" and not (Q[j].any() and v.any()))
                        dot = 0 if v is None else float(v @ Q[j])
                        x = None if bad else (-dot if metric == "inner" else
                                              1 - dot / (np.linalg.norm(v.astype(float)) * np.linalg.norm(Q[j])))
                        rows.append((bad, 0 if bad else round(x, 9), ds, pk))
                want = [r[2:] for r in sorted(rows)[:p["qk"][j]]]
                mine = got[got["qid"] == j]
                if ties or metric == "inner":
                    mine = mine.assign(x=mine["distance"].round(9)).sort_values(
                        ["x", "dataset_id", "pk"], na_position="last")
                    assert list(zip(mine["dataset_id"], mine["pk"])) == want
                assert len(mine) == len(want)


def _clusters(spark, n=2400, d=16, centres=40):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(centres, d))
    rows = []
    for i in range(n):
        v = (base[i % centres] + rng.normal(size=d) * 0.05) * rng.choice([0.5, 1.0, 3.0])
        rows.append((f"ds{i % 3}", f"{i:05d}", f"t{i}", [float(x) for x in v.astype(np.float32)]))
    rows += [("ds0", "zero", "z", [0.0] * d), ("ds1", "none", "n", None), ("ds2", "short", "s", [1.0, 2.0]),
             ("ds2", "nan", "s", [float("nan")] * d), ("ds0", "twin", "w", rows[0][3]), ("ds0", "twin2", "w", rows[0][3])]
    return rows, spark.createDataFrame(rows, STORE)


def test_cells_give_the_full_scan(spark):
    from cataloom.operators.vector_cells import CellStore
    rows, store = _clusters(spark)
    cells = CellStore.build(store, scratch_path(spark, "cells"))
    total = {c["cell"]: c["n"] for c in cells.cells()}
    assert sum(total.values()) == len(rows)
    read = []
    asked = [rows[0][3], rows[777][3], [0.0] * 16, [1.0] + [0.0] * 15]
    for q in asked:
        for ds in (None, "ds1") if q is asked[0] else (None,):
            for ours, plain in ((cells.knn_cosine, knn.knn_cosine), (cells.knn_inner, knn.knn_inner)):
                a, b = ([(r.dataset_id, r.pk, r.distance) for r in f.collect()] for f in
                        (ours(q, dataset_id=ds), plain(store, q, dataset_id=ds)))
                assert a == b or (q == [0.0] * 16 and [x[:2] for x in a] == [x[:2] for x in b])
        read.append(sum(total[c] for c in cells.plan(q, 8, "cosine")))
    assert min(read[:2]) > 0 and max(read[:2]) < len(rows) / 5       # near vectors: few cells are read
    found = cells.knn_cosine(rows[0][3])
    assert "PartitionFilters: [cell" in found._jdf.queryExecution().executedPlan().toString()
    assert [r.pk for r in found.collect()][:3] == ["00000", "twin", "twin2"]
    tail = store.where("pk IN ('zero', 'none', 'short', '00001', '00002')")
    few = CellStore.build(tail, scratch_path(spark, "cells"))
    assert [(r.pk, r.distance) for r in few.knn_cosine(rows[1][3]).collect()] == [
        (r.pk, r.distance) for r in knn.knn_cosine(tail, rows[1][3]).collect()]
    empty = CellStore.build(store.limit(0), scratch_path(spark, "cells"))
    assert empty.knn_cosine(rows[0][3]).count() == 0


def test_crowded_cell_is_split(spark, tmp_path):
    """Most rows have no vector and share a cell: many tasks write it."""
    from cataloom.operators.vector_cells import CellStore
    rows, store = _clusters(spark, n=200)
    crowd = spark.range(0, 20000, 1, 8).select(
        F.lit("ds0").alias("dataset_id"), F.format_string("x%06d", "id").alias("pk"),
        F.concat(*[F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(i))), 512) for i in range(8)]).alias("text_chunk"),
        F.lit(None).cast("array<float>").alias("embedding"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1MB")
    try:
        both = store.select(crowd.columns).unionByName(crowd)
        cells = CellStore.build(both, str(tmp_path / "cells"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "cells" / "rows" / "cell=-1").glob("*.parquet"))) > 4
    assert cells._rows().count() == len(rows) + 20000
    assert [r.pk for r in cells.knn_cosine(rows[0][3]).collect()] == [
        r.pk for r in knn.knn_cosine(both, rows[0][3]).collect()]


def test_topk_step_takes_store_rows_in_slices(spark, monkeypatch):
    """A tile of many rows without vectors is compared in bounded pieces, with the same hits."""
    seen, one = [], knn._local_topk
    monkeypatch.setattr(knn, "_local_topk", lambda s, p, m: seen.append(s.num_rows) or one(s, p, m))
    monkeypatch.setattr(knn, "STORE_ROWS", 64)
    rng = np.random.default_rng(5)
    rows = [{"dataset_id": f"d{i % 3}" if i % 11 else None, "pk": f"{i:04d}",
             "embedding": rng.integers(-2, 3, size=4).astype(float).tolist() if i % 9 == 0 else None}
            for i in range(500)]
    store = pa.RecordBatch.from_pylist(rows, schema=pa.schema(
        [("dataset_id", pa.string()), ("pk", pa.string()), ("embedding", pa.list_(pa.float64()))]))
    asked = [{"qid": j, "dataset_id": [None, "d1"][j % 2], "k": [3, 40, 100][j % 3],
              "embedding": rng.normal(size=4).tolist()} for j in range(12)]
    questions = pa.RecordBatch.from_pylist(asked, schema=pa.schema(
        [("qid", pa.int64()), ("dataset_id", pa.string()), ("k", pa.int64()),
         ("embedding", pa.list_(pa.float64()))]))
    step = knn._TopK("cosine")
    list(step.add((0, 0), store, questions))
    got = [r for b in step.end() for r in b.to_pylist()]
    assert max(seen) == 64 and sum(seen) == 500
    for q in asked:
        def key(r):
            v = np.zeros(4) if r["embedding"] is None else np.array(r["embedding"])
            n = np.linalg.norm(v) * np.linalg.norm(q["embedding"])
            far = 1 - v @ np.array(q["embedding"]) / n if n else None
            return (far is None, round(far, 9) if n else 0, r["dataset_id"] is None, r["dataset_id"] or "", r["pk"])
        mine = [r for r in rows if q["dataset_id"] in (None, r["dataset_id"])]
        want = [r["pk"] for r in sorted(mine, key=key)[:q["k"]]]
        own = [r for r in got if r["qid"] == q["qid"]]
        assert sorted(r["pk"] for r in own) == sorted(want)
        assert sum(r["distance"] is not None for r in own) == min(q["k"], sum(not key(r)[0] for r in mine))


def test_index_verifies_few_candidates_of_a_common_phrase(spark, monkeypatch):
    """A phrase of all texts is looked for in the first of them only, unless these fail; the hits
    are those of the full search."""
    from cataloom.operators import gram_index
    monkeypatch.setattr(gram_index, "FIRST", 4)
    sizes = []
    monkeypatch.setattr(gram_index, "written", lambda df, name, w=gram_index.written: sizes.append(
        (name, w(df, name))) or sizes[-1][1])
    rows = [("ds1", f"p{i:03d}", f"alpha beta {'x' * (i % 3)} {i}", None) for i in range(300)]
    rows += [("ds1", f"a{i:03d}", "abcd ... bcde" if i < 20 else "zz abcde zz", None) for i in range(25)]
    store = spark.createDataFrame(rows, STORE)
    index = GramIndex(spark, scratch_path(spark, "grams"))
    index.append(store)
    asked = spark.createDataFrame([(1, "a", 3), (2, "abcde", 3), (3, "alpha", 2), (4, "nowhere", 3), (5, "alpha", 9),
                                   (6, "alpha", 1), (6, "beta", 6)], "qid long, question string, k int")
    order = ["qid", "rank", "pk"]
    for q in (asked.drop("k"), asked):
        sizes.clear()
        got = index.topk(store, q, 3, "raw").orderBy(*order).collect()
        assert [tuple(r) for r in got] == [tuple(r) for r in search._first_by_key(search.theta_ilike_join(
            store, q, "raw").drop("embedding", "_phrase"), 3).select(got[0].__fields__).orderBy(*order).collect()]
        left = {r.qid for n, df in sizes if n == "candidates-left" for r in df.collect()}
        assert 2 in left and not left & {1, 3, 4}


def test_rank_by_many_tasks(spark, monkeypatch):
    """One question holds nearly all hits; no task sorts it alone."""
    from cataloom.operators import util
    seen = []
    monkeypatch.setattr(util, "written", lambda df, name, w=util.written: seen.append(w(df, name)) or seen[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hits = spark.range(5000).select(F.when(F.col("id") % 50 == 0, F.col("id") % 7).otherwise(99).alias("qid"),
                                        F.xxhash64("id").alias("o"), F.col("id").alias("x"))
        got = search.ranked_context(hits, ("o",)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for r in sorted(hits.collect(), key=lambda r: r.o):
        want.setdefault(r.qid, []).append(r.x)
    assert {(r.qid, r["rank"], r.x) for r in got} == {(q, i + 1, x) for q, xs in want.items() for i, x in enumerate(xs)}
    assert seen[0].where("qid = 99").select("_pid").distinct().count() > 3
