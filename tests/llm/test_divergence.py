"""The divergence audit against plain loops over dense counts."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from data import LONG, none, small

from cataloom.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(rows, min_docs, top=10):
    """rows: (text, lang, source)."""
    groups, df = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        groups[lang or "", source or ""].update(words(text))
        df[lang or ""].update(set(words(text)))
    out = set()
    for lang in df:
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        own = {s: c for (x, s), c in groups.items() if x == lang}

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10 ** 9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in own.items()}, shares(sum(own.values(), Counter()))

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in own:
            pair = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in own if o != s]
            term = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if own[s][t] and p[s][t] > q[t]]
            out |= {(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(sorted(pair))}
            out |= {(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(sorted(term)[:top])}
    return out


def corpus(spark, seed=0, sources=9, docs=240):
    rng = np.random.default_rng(seed)
    vocab = ["Alpha", "beta", "naïve", "Éa", "日本", "x-y", "don't", "TIE", "tie2", "ﬀ"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows = []
    for i in range(docs):
        s = None if i % 17 == 0 else f"s{int(rng.integers(sources)) if i % 3 else 0}"
        lang = [None, "en", "de", "de", "xx"][i % 5]
        text = " ".join(vocab[int(j)] for j in rng.zipf(1.3, size=30) % len(vocab)) if i % 7 else None
        rows.append((text if lang != "xx" else "a1b2", lang, s))
    rows += [("", "en", "empty"), (None, "lonely", None), ("\x00 12_34 [] {}", "en", "signs")] + rows[:20]
    df = spark.createDataFrame([(*r, "q", 1) for r in rows], "text string, lang string, source string, term string, n int")
    return rows, df


@pytest.mark.parametrize("blocks", [(256, 200_000), (2, 40)])
def test_audit(spark, monkeypatch, blocks):
    monkeypatch.setattr(divergence, "BLOCK_SOURCES", blocks[0])
    monkeypatch.setattr(divergence, "SHARE_ROWS", blocks[1])
    rows, df = corpus(spark)
    for least in (10, 1, 1000):
        got = [tuple(r) for r in divergence.audit(df, "text", "lang", "source", least).collect()]
        want = plain(rows, least)
        assert len(got) == len(want) and set(got) == want


def test_audit_awkward(spark):
    df = small(spark).withColumnRenamed("key", "source")
    rows = [(r.text, r.lang, r.source) for r in df.collect()]
    got = divergence.audit(df, "text", "lang", "source", 1)
    assert {tuple(r) for r in got.collect()} == plain(rows, 1)
    by_lang = divergence.audit(df, "text", "kept", "lang", 1)      # the column names of its own rows
    assert {tuple(r) for r in by_lang.collect()} == plain([(t, "true", x) for (t, _, _), x in zip(rows, [r.lang for r in df.collect()])], 1)
    assert divergence.audit(none(spark).withColumnRenamed("key", "source"), "text", "lang", "source").count() == 0


def test_terms_in_pieces(monkeypatch):
    text = LONG + "X" * 500 + "é" * 300 + " end"
    want = [t.encode() for t in words(text)]
    for piece in (1 << 22, 97, 7, 1):
        monkeypatch.setattr(divergence, "PIECE", piece)
        short = text if piece > 50 else text[-1200:]
        want_short = want if piece > 50 else [t.encode() for t in words(short)]
        assert [t for part in divergence.terms_of(short.encode()) for t in part] == want_short
    assert list(divergence.terms_of(b"")) == []


def test_counting_in_small_lots(spark, monkeypatch):
    """Many hand-overs and chunks give the same sums."""
    import pyarrow as pa
    rows, _ = corpus(spark, 3)
    want = Counter()
    for text, lang, source in rows:
        for w in words(text):
            want[lang or "", source or "", w] += 1
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] or "" for r in rows]) for i in (1, 2, 0)], names=["lang", "source", "text"])
    monkeypatch.setattr(divergence, "HELD_TERMS", 20)
    got, lots = Counter(), 0
    for b in divergence._count(iter([batch.slice(i, 10) for i in range(0, len(rows), 10)])):
        lots += 1
        for r in b.to_pylist():
            got[r["lang"], r["source"], r["term"]] += r["n"]
    assert got == want and lots > 10
