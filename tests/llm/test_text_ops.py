import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from data import SMALL, none, small
from hypothesis import given, settings
from hypothesis import strategies as st

from cataloom.llm import best_fit, exact_dedup, line_dedup, ngram_join, sentencepiece_codec, url_filter
from cataloom.llm.queries import URL_RULES, tokens

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- 1 SentencePiece ------------------------------------------------------------

@pytest.fixture(scope="module")
def codec():
    return sentencepiece_codec.Codec(MODEL)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" ▁\n\tabé中🙂\u00a0\u200b"), st.characters(exclude_categories=["Cs"])),
               max_size=40))
def test_codec_equals_library(codec, text):
    assert codec.by_chunk
    ids = codec.sp.encode(text, add_eos=True)
    assert list(codec.encode([text])) == [ids]
    assert list(codec.rows([text])) == [(len(ids), " ".join(map(str, ids)), codec.sp.decode(ids))]


def test_codec_starts_a_full_table_anew(codec, monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "TABLE_WORDS", 5)
    texts = [f"w{i} x{i} y" for i in range(50)]
    assert list(codec.encode(texts)) == codec.sp.encode(texts, add_eos=True)


def test_encode_documents(spark, codec):
    rows = sentencepiece_codec.encode_documents(small(spark), "doc_id", "text", MODEL, ids=True).collect()
    assert Counter(r.id for r in rows) == Counter(r[0] for r in SMALL)
    want = Counter()
    for i, t, _ in SMALL:
        ids = codec.sp.encode(t or "", add_eos=True)
        want[i, len(ids), sha(" ".join(map(str, ids))), sha(codec.sp.decode(ids))] += 1
    assert Counter((r.id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    assert sentencepiece_codec.encode_documents(none(spark), "doc_id", "text", MODEL).count() == 0


# --- 2 URL rules ------------------------------------------------------------------

def brute_rule(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:n])
    path = rest[n:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), v == "block", v, h + p) for v, h, p in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[4], best[3] if best else "allow"


def test_url_rules(spark, monkeypatch):
    rules = [*URL_RULES, ("block", "example.com", "/a/b"), ("allow", "example.com", "/a/bc"),
             ("block", "b.example.com", ""), ("block", "tie.org", "/x"), ("allow", "tie.org", "/x")]
    urls = ["http://Example.COM/en/1", "https://www.example.com/en/", "http://x.net/es/?q=/fr/", "ftp://net/fr/a",
            "http://example.com", "http://example.com/a/bcd", "http://example.com/a/bx#y", "no scheme", None, "",
            "http://b.example.com", "http://b.example.com?x", "://", "http://a..com/", "http://tie.org/x",
            "http://notexample.com/en/", "http://example.com/en/1", "a://b://example.com/en/", "http://com/",
            "http://" + "s." * 300 + "com/" + "p/" * 500]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id int, url string, rule string")
    for limit in (url_filter.BROADCAST_RULES, 0):  # broadcast, and the join beyond the bound
        monkeypatch.setattr(url_filter, "BROADCAST_RULES", limit)
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict)
               for r in url_filter.judge(df, url_filter.rules_frame(spark, rules)).collect()}
        assert got == {i: brute_rule(u, rules) for i, u in enumerate(urls)}
    assert url_filter.judge(df.limit(0), url_filter.rules_frame(spark, rules)).count() == 0
    assert {r.verdict for r in url_filter.judge(df, url_filter.rules_frame(spark, [])).collect()} == {"allow"}


# --- 3 packing -----------------------------------------------------------------------

def test_fast_ids_equal_the_tokenizer():
    coder = best_fit.Tokens(**tokens())
    for t in [r[1] or "" for r in SMALL] + ["<|endoftext|> x <|endoftext|>", "a" * 5000, " " * 3000, "It's I'll\u00a0 \r\n z"]:
        want = coder.exact.encode(t, add_special_tokens=False).ids + [0]
        assert coder.ids(t).tolist() == want


def test_pack(spark):
    pieces = best_fit.tokenize_pieces(small(spark), "doc_id", "text", tokens(), ids=True)
    rows = best_fit.pack(pieces, task_pieces=20, open_bins=3).collect()
    seqs = defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
        assert r.piece == 0 or r.length == 2048
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert Counter(r.id for r in rows if r.piece == 0) == Counter(r[0] for r in SMALL)
    assert best_fit.pack(pieces.limit(0)).count() == 0
    for bad in (0, 2049, None):
        with pytest.raises(Exception):
            best_fit.pack(spark.createDataFrame([(bad,)], "length long")).collect()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200), st.integers(1, 6))
def test_packer_is_bounded_best_fit(lengths, open_bins):
    packer, free, is_open = best_fit.Packer(50, open_bins), {}, set()
    for n in lengths:
        here, offset = packer.put(n)
        fits = [free[b] for b in is_open if free[b] >= n]
        if fits:
            assert here in is_open and free[here] == min(fits) and offset == 50 - free[here]
        else:
            assert here not in free and offset == 0
        free[here] = (free.get(here, 50)) - n
        is_open.add(here)
        if not free[here]:
            is_open.discard(here)
        if len(is_open) > open_bins:
            low = min(free[b] for b in is_open)
            closed = [b for b in is_open if b not in sum(packer.by_free, [])]
            assert len(closed) == 1 and free[closed[0]] == low
            is_open.discard(closed[0])


# --- 7 lines ---------------------------------------------------------------------------

def brute_lines(texts, threshold):
    key = [[line_dedup.line_key(x) for x in (t or "").encode().split(b"\n")] for t in texts]
    seen = Counter(k for ks in key for k in set(ks) if k)
    return Counter("\n".join(x for x, k in zip((t or "").split("\n"), ks) if not k or seen[k] < threshold)
                   for t, ks in zip(texts, key))


def lines_frame(spark, texts):
    return spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, _n_kept int")


def test_lines_insert_delete_dedup(spark, monkeypatch):
    one = [f"own {i}\n Shared line \nfoot\n\n" for i in range(12)] + [None, "", "\n\n", "foot", "FOOT\t"]
    two = [f"more {i}\nshared LINE\nÉté" for i in range(6)] + ["foot\nfoot\nfoot"] * 3
    a, b = lines_frame(spark, one), lines_frame(spark, two)
    for limit in (line_dedup.BROADCAST_BYTES, 0):  # with the filters sent out, and without
        monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", limit)
        index = line_dedup.LineIndex(spark, 15).insert(a)
        assert Counter(r.text or "" for r in index.dedup(a).collect()) == brute_lines(one, 15)
        index.insert(b)
        both = Counter(r.text or "" for r in index.dedup(a.union(b)).collect())
        assert both == brute_lines(one + two, 15) and not any("hared" in t for t in both)
        index.delete(b)  # as before
        assert Counter(r.text or "" for r in index.dedup(a).collect()) == brute_lines(one, 15)
        assert {r.n for r in index.counts.collect()} == {1, 12, 14}
    with pytest.raises(ValueError):
        line_dedup.LineIndex(spark, 2).insert(a).delete(b)
    empty = line_dedup.LineIndex(spark, 2).insert(a.limit(0))
    assert empty.dedup(a.limit(0)).count() == 0 and empty.dedup(a).count() == len(one)


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(1, 1 << 63, (5000, 2)).astype(np.uint64)
    f = line_dedup.CuckooFilter(len(keys))
    assert f.add(keys[:3000]) and f.has(keys[:3000]).all() and f.has(keys[3000:]).sum() < 20
    assert f.remove(keys[:1500]) and f.has(keys[1500:3000]).all() and f.has(keys[:1500]).sum() < 20
    g = line_dedup.CuckooFilter.load(f.dump())
    assert (g.has(keys) == f.has(keys)).all()
    assert not line_dedup.CuckooFilter(4).add(keys)


# --- 8 exact copies --------------------------------------------------------------------

@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact(spark, keep):
    df = small(spark).repartition(5)
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = defaultdict(list)
    for i, t, _ in SMALL:
        groups[low(t)].append(i)
    want = Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = {"min": min, "max": max}[keep](known) if known else None
        for i in ids:
            want[i, best, len(ids), i is not None and i == best, sha(t)] += 1
    got = exact_dedup.exact_dedup(df, "doc_id", "text", keep, fan_in=2).collect()
    assert Counter(map(tuple, got)) == want
    assert exact_dedup.exact_dedup(none(spark), "doc_id", "text").count() == 0


# --- 9 n-gram join --------------------------------------------------------------------

def brute_join(rows, size, percent):
    sets = []
    for _, t, *_ in rows:
        w = [b.translate(ngram_join._LOWER) for b in (t or "").encode().split()]
        sets.append({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size
                    else {tuple(w)} if w else set())
    comp = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                comp = [comp[j] if c == comp[i] else c for c in comp] if comp[i] != comp[j] else comp
    low = defaultdict(list)
    for c, r in zip(comp, rows):
        if r[0] is not None:
            low[c].append(r[0])
    return Counter((r[0], len(s), min(low[c]) if s and low[c] else r[0]) for r, s, c in zip(rows, sets, comp))


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_join(spark, percent, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 8)
    rng = np.random.default_rng(percent)
    rows = [r[:2] for r in SMALL]
    for g in range(12):
        base = [f"w{x}" for x in rng.integers(0, 400, rng.integers(6, 160))]
        for _ in range(rng.integers(1, 22)):
            own = list(base)
            for _ in range(rng.integers(0, 4)):
                own[rng.integers(0, len(own))] = f"v{rng.integers(0, 50)}"
            rows.append((100 + len(rows), " ".join(own)))
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, cls int, root int")
    got = Counter((r.id, r.n_shingles, r.component_id)
                  for r in ngram_join.ngram_join(df, "doc_id", "text", percent=percent).collect())
    assert got == brute_join(rows, 5, percent)


def test_join_frames(spark, monkeypatch):
    """Texts of one long frame (similarity below 0.7) are no cluster; copies among them link."""
    rng = np.random.default_rng(3)
    frame = [f"f{x}" for x in range(200)]
    rows = [(i, " ".join(frame + [f"o{x}" for x in rng.integers(0, 10**6, 45)])) for i in range(600)]
    rows += [(1000 + i, rows[i][1] + " tail") for i in range(0, 600, 60)]
    compared = []
    links = ngram_join._cluster_links
    monkeypatch.setattr(ngram_join, "_cluster_links", lambda m, *a: compared.append(m.count()) or links(m, *a))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r.id: r.component_id for r in ngram_join.ngram_join(df, "doc_id", "text").collect()}
    assert got == {i: i - 1000 if i >= 1000 else i for i, _ in rows}
    assert 20 <= compared[0] <= 40  # the ten pairs, and a few frames that are short of own words


def test_join_clashing_digests(spark):
    """Sets whose first digests are equal stay apart: 400 sets in 256 values of one byte."""
    rows = [(i, " ".join(f"{i % 400}x{k}" for k in range(12))) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.component_id
           for r in ngram_join.ngram_join(df, "doc_id", "text", digest_bytes=1).collect()}
    assert got == {i: i % 400 for i, _ in rows}


def test_join_edges(spark):
    assert ngram_join.ngram_join(none(spark), "doc_id", "text").count() == 0
    kept = ngram_join.drop_near_copies(small(spark), "doc_id", "text").collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter(
        {(1, SMALL[0][1]): 1, (2, None): 1, (None, None): 1, (None, "lone text here"): 1, (3, ""): 1,
         (4, "other text of four"): 1, SMALL[6][:2]: 1, SMALL[7][:2]: 1, SMALL[10][:2]: 1, (9, "   "): 1, (10, "\n\n"): 1})
