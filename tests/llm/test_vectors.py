"""Block search and hard negatives against plain comparisons of all pairs."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cataloom.llm import block_search, hard_negatives, tiles

SCHEMA = "vec_id long, embedding array<double>, label int, `tile` int, x string, rank int, score double, dim string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "z", 2, 0.5, "d") for r in rows], SCHEMA)


def awkward(rng, n=300, d=16):
    """Random vectors, groups of copies, ties, repeated rows and ids, other dimensions, bad rows."""
    base = rng.normal(size=(n, d))
    base /= np.linalg.norm(base, axis=1)[:, None]
    rows = [(i, base[i].astype(np.float32).astype(float).tolist(), i % 4) for i in range(n)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(120)]            # copies of a query
    rows += [(2000 + i, rows[1][1], i % 3) for i in range(60)]
    rows += [rows[5], rows[5], rows[0]]                                # repeated rows
    rows += [(7, base[9].tolist(), 2), (100, base[11].tolist(), 3)]    # ids with two vectors
    rows += [(3000, None, 1), (3100, [], 1), (3200, [0.0] * d, 1), (3001, [0.0] * d, 2), (3002, [None] + [1.0] * (d - 1), 1),
             (3003, [float("nan")] * d, 1), (3004, [float("inf")] * d, 1), (None, rows[3][1], 1), (3300, rows[3][1], None)]
    rows += [(4000, [1.0, 2.0], 0), (4100, [1.5, 2.5], 0), (4001, [-3.0, 0.25], 1), (4002, [1.25, 2.0], 1)]
    return rows


def good(v):
    return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)


def nearest(rows, k):
    best = defaultdict(dict)
    keep = [r for r in rows if r[0] is not None and good(r[1]) and any(r[1])]
    for q, a, _ in keep:
        if q % 100 == 0:
            for c, b, _ in keep:
                if c != q and len(a) == len(b):
                    s = 0.0
                    for x, y in zip(a, b):
                        s += (x - y) * (x - y)
                    best[q][c] = min(best[q].get(c, math.inf), math.sqrt(s))
    return {(q, r + 1, c, s) for q, d in best.items()
            for r, (s, c) in enumerate(sorted((s, c) for c, s in d.items())[:k])}


def mined(rows, positives=5, negatives=3):
    keep = [(i, tuple(math.floor(256 * x) for x in v), lab) for i, v, lab in rows
            if i is not None and lab is not None and good(v) and len(v) * max(abs(math.floor(256 * x)) for x in v) ** 2 < 2 ** 62]
    out = set()
    for a in {(i, lab) for i, _, lab in keep if i % 50 == 0}:
        own = [v for i, v, lab in keep if (i, lab) == a]
        s = [(sum(x * y for x, y in zip(v, w)), i, lab) for v in own for i, w, lab in keep if i != a[0] and len(w) == len(v)]
        pos = {}
        for x, i, lab in s:
            if lab == a[1]:
                pos[i] = max(x, pos.get(i, x))
        for p, ps in sorted(pos.items(), key=lambda t: (-t[1], t[0]))[:positives]:
            neg = {}
            for x, i, lab in s:
                if lab != a[1] and 50 * ps <= 100 * x <= 95 * ps:
                    neg[i] = max(x, neg.get(i, x))
            out |= {(a[0], p, r + 1, i, ps, x) for r, (i, x) in
                    enumerate(sorted(neg.items(), key=lambda t: (-t[1], t[0]))[:negatives])}
    return out


@pytest.fixture(params=[(1024, 32 << 20), (37, 2000)])
def sizes(request, monkeypatch):
    """The given tiles, and small tiles with many blocks of queries."""
    monkeypatch.setattr(tiles, "TILE_ROWS", request.param[0])
    monkeypatch.setattr(tiles, "BLOCK_BYTES", request.param[1])
    if request.param[0] < 100:
        monkeypatch.setattr(tiles, "TILE_BYTES", 1000)


def test_nearest(spark, sizes):
    rows = awkward(np.random.default_rng(1))
    df = frame(spark, rows).repartition(3)
    got = block_search.nearest(df, "vec_id", "embedding", F.col("vec_id") % 100 == 0, 10)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert {tuple(r) for r in got.collect()} == nearest(rows, 10)
    assert block_search.nearest(df.limit(0), "vec_id", "embedding", F.col("vec_id") == 0).count() == 0
    assert block_search.nearest(df, "vec_id", "embedding", F.col("vec_id") == -5).count() == 0
    few = df.filter("vec_id between 4000 and 4100")
    assert {tuple(r) for r in block_search.nearest(few, "vec_id", "embedding", F.col("vec_id") == 4000).collect()} == {
        x for x in nearest([r for r in rows if r[0] is not None and 4000 <= r[0] <= 4100], 10) if x[0] == 4000}


def test_nearest_extreme_lengths(spark):
    rows = [(i, [10.0 ** e * (1 + i % 3), 10.0 ** -e], 0) for i, e in enumerate([0, 200, -200, 160, -170, 308, -308, 5, 5, 0] * 3)]
    rows = [(100 * i, *r[1:]) for i, r in enumerate(rows)]
    with np.errstate(all="ignore"):
        want = nearest(rows, 4)
    got = block_search.nearest(frame(spark, rows), "vec_id", "embedding", F.lit(True), 4)
    assert {tuple(r) for r in got.collect()} == want


def test_bounds_hold():
    rng = np.random.default_rng(5)
    for scale in (1.0, 1e-9, 1e9, rng.uniform(1e-3, 1e3, size=(200, 1))):
        x = rng.normal(size=(200, 48)) * scale
        x[100:] = x[:100] * (1 + 1e-6 * rng.normal(size=(100, 48)))
        q = block_search.Quantised(x)
        low, high = block_search.bounds(q, q)
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        assert (low <= d).all() and (d <= high).all()
        assert np.median(high - low) < 0.2 * np.median(d)


def test_hard_negatives(spark, sizes):
    rows = awkward(np.random.default_rng(2))
    df = frame(spark, rows).repartition(3)

    def mine(d):
        return hard_negatives.mine(d, "vec_id", "embedding", F.col("label"), F.col("vec_id") % 50 == 0)

    got = [tuple(r)[:6] for r in mine(df).collect()]
    want = mined(rows)
    assert len(got) == len(want) > 30 and set(got) == want
    assert mine(df.limit(0)).count() == 0
    assert mine(df.filter("label = 1")).count() == 0


def test_hard_negatives_of_large_components(spark):
    """Sums beyond 53 bits, and vectors whose scores might leave 64 bits."""
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=6) * 1e6 + 2e5).tolist(), i % 2) for i in range(80)]
    rows += [(200, [1e7] * 6, 0), (250, [1e300] * 6, 1), (300, [2.0 ** 23] + [0.0] * 5, 0)]
    got = hard_negatives.mine(frame(spark, rows), "vec_id", "embedding", F.col("label"), F.col("vec_id") % 50 == 0)
    assert {tuple(r)[:6] for r in got.collect()} == mined(rows) != set()


def test_packed_scores():
    rng = np.random.default_rng(4)
    for top, d in ((3, 5), (256, 64), (600, 1536), (2 ** 20, 33), (2 ** 27, 8), (2 ** 30, 3), (0, 4)):
        for sign in (-1, 0):
            a = rng.integers(sign * top, top + 1, size=(7, d)).astype(float)
            c = rng.integers(sign * top, top + 1, size=(23, d)).astype(float)
            want = a.astype(np.int64).astype(object) @ c.astype(np.int64).astype(object).T
            assert (hard_negatives.scores(a, c) == want).all()


def test_first_copies():
    x = np.array([[1.0, 0.0], [1.0, -0.0], [1.0, 0.0], [2.0, 0.0], [1.0, 0.0], [1.0, 0.0]])
    at = tiles.first_copies(np.array([5, 4, 3, 9, 3, 1]), np.array([0, 0, 0, 0, 0, 1]), x, 2)
    assert sorted((np.array([5, 4, 3, 9, 3, 1])[at]).tolist()) == [1, 3, 4, 9]
