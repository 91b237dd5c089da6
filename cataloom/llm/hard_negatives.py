"""Hard negatives by Kronecker-packed products.

Components become integers, floor(256 x).  Several candidates are packed into one wide integer
for each component: their components are biased to be no longer negative and put into separate
fields, wide enough that no sum runs over.  One product with an anchor's (biased) component then
serves all the candidates of a word; the sums are taken apart into fields and the biases are
subtracted, which gives exact scores.  Words of up to 53 bits are carried by doubles, whose
matrix products are exact there; wider sums take Python integers with a field for every
candidate of a tile.

Defined results: rows without an id or a label, null and empty vectors and vectors with null or
non-finite components take no part, nor do vectors so large (dimension times the largest squared
integer of 2**62 or more) that a score might not fit into a long.  Zero vectors take part;
vectors of different dimensions are not compared.  An id with several rows counts once for an
anchor, with its largest (allowed) score; rows of the anchor's own id are neither its positives
nor its negatives; an anchor id with several labels has positives for each.  Ties go to the
smaller id.  Anchors without positives, and pairs without negatives, give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cataloom.llm import tiles
from cataloom.llm.common import out

SCALE = 256
#: Integers a double adds exactly.
WORD_BITS = 53
#: Marks a place without a positive (no score is as small).
NONE = -(1 << 63)

_POSITIVES = pa.schema([("anchor_id", pa.int64()), ("label", pa.int64()),
                        ("positive_id", pa.int64()), ("positive_score", pa.int64())])
_NEGATIVES = pa.schema([("anchor_id", pa.int64()), ("label", pa.int64()), ("place", pa.int32()),
                        ("positive_id", pa.int64()), ("positive_score", pa.int64()),
                        ("negative_id", pa.int64()), ("negative_score", pa.int64())])
POSITIVES = "anchor_id long, label long, positive_id long, positive_score long"
NEGATIVES = ("anchor_id long, label long, place int, positive_id long, positive_score long, "
             "negative_id long, negative_score long")


def integers(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v = np.floor(SCALE * x)
    top = np.abs(v).max(axis=1)
    ok = np.isfinite(v).all(axis=1) & (top < 2.0 ** 31)
    return v, ok & (x.shape[1] * np.where(ok, top, 0) ** 2 < 2.0 ** 62)


def _wide(a: np.ndarray, c: np.ndarray, size: int) -> np.ndarray:
    """Sums of products modulo 2**64, a field of ``size`` bytes for each candidate."""
    n, words = len(c), []
    for column in c.T:
        field = np.zeros((n, size), np.uint8)
        field[:, :8] = column.astype(np.uint64).view(np.uint8).reshape(n, 8)
        words.append(int.from_bytes(field.tobytes(), "little"))
    found = np.empty((len(a), n), np.uint64)
    for i, anchor in enumerate(a):
        total = sum(int(v) * w for v, w in zip(anchor, words))
        field = np.frombuffer(total.to_bytes(n * size, "little"), np.uint8).reshape(n, size)
        found[i] = np.ascontiguousarray(field[:, :8]).view(np.uint64).ravel()
    return found


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products (int64) of integer-valued matrices."""
    d, n = anchors.shape[1], len(rows)
    low_a, low_c = max(0.0, -anchors.min()), max(0.0, -rows.min())
    a, c = anchors + low_a, rows + low_c
    bits = (d * int(a.max()) * int(c.max())).bit_length() or 1
    fields = WORD_BITS // bits
    # (a + la)(c + lc) summed, less lc sum(a) + la sum(c) + d la lc
    with np.errstate(over="ignore"):
        bias = (anchors.astype(np.int64).sum(axis=1)[:, None] * np.int64(low_c)
                + rows.astype(np.int64).sum(axis=1)[None, :] * np.int64(low_a)
                + np.int64(d) * np.int64(low_a) * np.int64(low_c))
        if not fields:
            return (_wide(a, c, (bits + 7) // 8 + 1) - bias.astype(np.uint64)).astype(np.int64)
    width = -(-n // fields)
    word = np.zeros((width, d))
    for f in range(fields):
        part = c[f * width:(f + 1) * width]
        word[:len(part)] += part * 2.0 ** (f * bits)
    total = (a @ word.T).astype(np.int64)
    found = np.empty((len(a), fields * width), np.int64)
    for f in range(fields):
        found[:, f * width:(f + 1) * width] = (total >> (f * bits)) & ((1 << bits) - 1)
    return found[:, :n] - bias


class _Positives:
    """The best rows of the same label so far, for each anchor of a tile."""

    def __init__(self, q: tiles.Tile, k: int):
        self.q, self.k = q, k
        self.slot, self.key, self.ids = (np.zeros(0, np.int64) for _ in range(3))
        self.limit = np.full(len(q.ids), np.iinfo(np.int64).max)

    def add(self, c: tiles.Tile) -> "_Positives":
        ok = (self.q.tags[:, None] == c.tags) & (self.q.ids[:, None] != c.ids)
        if ok.any():
            key = -scores(self.q.x, c.x)
            i, j = tiles.candidates_below(key, ok, self.limit, self.k * c.most)
            self.merge(i, key[i, j], c.ids[j])
        return self

    def merge(self, slot, key, ids):
        slot = np.concatenate([self.slot, slot])
        key, ids = np.concatenate([self.key, key]), np.concatenate([self.ids, ids])
        at = tiles.best_of(slot, key, ids, self.k)
        self.slot, self.key, self.ids = slot[at], key[at], ids[at]
        full = np.flatnonzero(np.bincount(self.slot, minlength=len(self.limit)) == self.k)
        last = np.searchsorted(self.slot, full, side="right") - 1   # slots stand in order
        self.limit[full] = self.key[last]

    def rows(self) -> pa.RecordBatch:
        return out(_POSITIVES, self.q.ids[self.slot], self.q.tags[self.slot], self.ids, -self.key)


class _Negatives(_Positives):
    """The best allowed rows of other labels so far, for each anchor and positive."""

    def __init__(self, q: tiles.Tile, k: int, low: int, high: int):
        super().__init__(q, k)
        n, width = q.extra.shape[0], q.extra.shape[1] // 2
        self.score, self.ids_of = q.extra[:, :width], q.extra[:, width:]
        self.limit = np.full(n * width, np.iinfo(np.int64).max)
        # whole numbers of any size: low * p <= 100 * n <= high * p
        self.least, self.most = np.zeros((2, n, width), np.int64)
        for (i, j), p in np.ndenumerate(self.score):
            if p == NONE:
                self.least[i, j], self.most[i, j] = 1, 0
            else:
                self.least[i, j], self.most[i, j] = -(-low * int(p) // 100), high * int(p) // 100

    def add(self, c: tiles.Tile) -> "_Negatives":
        other = (self.q.tags[:, None] != c.tags) & (self.q.ids[:, None] != c.ids)
        if not other.any():
            return self
        s = scores(self.q.x, c.x)
        n, width = self.score.shape
        found = []
        for p in range(width):
            ok = other & (s >= self.least[:, p, None]) & (s <= self.most[:, p, None])
            i, j = tiles.candidates_below(-s, ok, self.limit.reshape(n, width)[:, p],
                                          self.k * c.most)
            found.append((i * width + p, -s[i, j], c.ids[j]))
        self.merge(*(np.concatenate(f) for f in zip(*found)))
        return self

    def rows(self) -> pa.RecordBatch:
        i, p = np.divmod(self.slot, self.score.shape[1])
        return out(_NEGATIVES, self.q.ids[i], self.q.tags[i], p, self.ids_of[i, p],
                   self.score[i, p], self.ids, -self.key)


def mine(vectors: DataFrame, id_col: str, vec_col: str, label, is_anchor, positives: int = 5,
         negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, label).

    For each row with ``is_anchor`` and each of the first ``positives`` other ids of its label:
    the first ``negatives`` ids of other labels whose score is ``low`` to ``high`` per cent of
    the positive's.  ``label``: a column of whole numbers.  Two searches of the anchors against
    all rows, block by block; only the best of each task are shuffled."""
    if min(positives, negatives) < 1:
        raise ValueError("positives and negatives must be positive")
    every = tiles.rows(vectors, id_col, vec_col, label)
    anchors = tiles.rows(vectors.filter(is_anchor), id_col, vec_col, label)
    base = tiles.pack(every, integers, copies=max(positives, negatives) + 1)
    queries, blocks = tiles.query_tiles(anchors, integers, "anchors")

    near = tiles.search(base, queries, blocks,
                        lambda s, q, c: (s or _Positives(q, positives)).add(c),
                        POSITIVES, "positives")
    keys = ["anchor_id", "label"]
    near = (near.repartition(*keys).groupBy(*keys, "positive_id")
            .agg(F.max("positive_score").alias("positive_score")))
    w = Window.partitionBy(*keys).orderBy(F.desc("positive_score"), "positive_id")
    first = near.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= positives)
    # at most ``positives`` rows an anchor: scores, then ids, padded to the same length
    listed = first.groupBy(*keys).agg(F.array_sort(F.collect_list(
        F.struct("r", "positive_score", "positive_id"))).alias("l"))

    def padded(field):
        return F.concat(F.transform("l", lambda s: s[field]),
                        F.array_repeat(F.lit(NONE).cast("long"), F.lit(positives) - F.size("l")))

    listed = listed.select(F.col("anchor_id").alias("id"), F.col("label").alias("tag"),
                           F.concat(padded("positive_score"), padded("positive_id")).alias("extra"))
    queries, blocks = tiles.query_tiles(
        anchors.drop("extra").join(listed, ["id", "tag"]).select("id", "tag", "v", "extra"),
        integers, "anchors-positives")
    far = tiles.search(base, queries, blocks,
                       lambda s, q, c: (s or _Negatives(q, negatives, low, high)).add(c),
                       NEGATIVES, "negatives")
    keys += ["place", "positive_id", "positive_score"]
    far = (far.repartition("anchor_id", "label", "place").groupBy(*keys, "negative_id")
           .agg(F.max("negative_score").alias("negative_score")))
    w = Window.partitionBy("anchor_id", "label", "place").orderBy(
        F.desc("negative_score"), "negative_id")
    return (far.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                    "negative_score", "label"))
