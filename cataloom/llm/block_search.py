"""Nearest neighbours of a stated set of queries by a block matrix join.

Vectors are quantised to int8 with a scale of their own.  The product of a query tile and a
candidate tile (small integers, summed exactly) gives every distance up to the lengths of the
two rounding errors, which are known; only pairs whose lower bound does not exceed the query's
k-th distance so far are computed again in double precision on the original vectors, and kept in
a heap of k for each query.  Heaps of all tasks are merged by a ranked window.  Bounds are
strict, so the result is that of the full comparison.

Defined results: rows without an id, null, empty and zero vectors and vectors with null or
non-finite components take no part; vectors of different dimensions are not compared.  An id
with several rows is one candidate (or query) at its smallest distance; rows of the query's own
id are not its candidates; repeated rows change nothing.  Ties go to the smaller id; squares
beyond the range of a double give an infinite distance.  No queries or no candidates: no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cataloom.llm import tiles
from cataloom.llm.common import out

#: Pairs that are computed again at once.
PAIRS = 1 << 14

HITS = "query_id long, vec_id long, score double"
_HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def usable(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x, np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)


class Quantised:
    """int8 codes (as float32, which sums their products exactly), scale, squared length of
    the decoded vector, and an upper bound for the length of the rounding error."""

    def __init__(self, x: np.ndarray):
        with np.errstate(all="ignore"):
            self.scale = np.abs(x).max(axis=1, initial=0) / 127.0
            code = np.rint(x / self.scale[:, None])
            sure = np.isfinite(code).all(axis=1) & (np.abs(code) <= 127).all(axis=1)
            code = np.where(sure[:, None], code, 0).astype(np.int8)
            self.code = code.astype(np.float32 if 127 * 127 * x.shape[1] < 1 << 24 else np.float64)
            rest = x - self.scale[:, None] * code
            self.error = np.where(sure, np.sqrt((rest * rest).sum(axis=1)) * (1 + 1e-9), np.inf)
            self.square = (code.astype(np.float64) ** 2).sum(axis=1) * self.scale ** 2


def bounds(q: Quantised, c: Quantised) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of all distances; not a number where nothing is known."""
    with np.errstate(all="ignore"):
        total = q.square[:, None] + c.square[None, :]
        d = total - 2.0 * (q.scale[:, None] * c.scale[None, :]) * (q.code @ c.code.T)
        d = np.sqrt(np.maximum(d, 0.0))
        # rounding of the sums above, far below this
        slack = q.error[:, None] + c.error[None, :] + 1e-7 * np.sqrt(total)
        return d - slack, d + slack


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of row pairs, squares added from the first component on."""
    found = np.empty(len(a))
    for lo in range(0, len(a), PAIRS):
        diff = a[lo:lo + PAIRS] - b[lo:lo + PAIRS]
        found[lo:lo + PAIRS] = np.sqrt(np.cumsum(diff * diff, axis=1)[:, -1])
    return found


class _Heaps:
    """The k nearest so far of each query of a tile: heaps of (-distance, -id)."""

    def __init__(self, q: tiles.Tile, k: int):
        self.q, self.k = q, k
        self.heaps: list[list] = [[] for _ in q.ids]
        self.limit = np.full(len(q.ids), np.inf)

    def offer(self, query: int, distance: float, vec_id: int) -> None:
        heap, item = self.heaps[query], (-distance, -vec_id)
        for i, seen in enumerate(heap):
            if seen[1] == item[1]:             # another row of that id
                if item > seen:
                    heap[i] = item
                    heapq.heapify(heap)
                return
        if len(heap) < self.k:
            heapq.heappush(heap, item)
        elif item > heap[0]:
            heapq.heapreplace(heap, item)

    def add(self, c: tiles.Tile) -> "_Heaps":
        lower, upper = bounds(self.q.view, c.view)
        other = self.q.ids[:, None] != c.ids[None, :]
        i, j = tiles.candidates_below(lower, other, self.limit, self.k * c.most, upper)
        for lo in range(0, len(i), PAIRS):
            a, b = i[lo:lo + PAIRS], j[lo:lo + PAIRS]
            with np.errstate(over="ignore"):
                d = distances(self.q.x[a], c.x[b])
            near = d <= self.limit[a]
            for query, distance, vec_id in zip(a[near].tolist(), d[near].tolist(),
                                               c.ids[b[near]].tolist()):
                self.offer(query, distance, vec_id)
        for query in np.unique(i).tolist():
            if len(self.heaps[query]) == self.k:
                self.limit[query] = -self.heaps[query][0][0]
        return self

    def rows(self) -> pa.RecordBatch:
        flat = [(q, -i, -d) for q, heap in zip(self.q.ids.tolist(), self.heaps) for d, i in heap]
        return out(_HITS, *(list(c) for c in zip(*flat))) if flat else out(_HITS, [], [], [])


def nearest(vectors: DataFrame, id_col: str, vec_col: str, is_query, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest other ids of each row for which the
    condition ``is_query`` holds, among all rows."""
    if k < 1:
        raise ValueError("k must be positive")
    queries, blocks = tiles.query_tiles(
        tiles.rows(vectors.filter(is_query), id_col, vec_col), usable, "nearest-queries")
    base = tiles.pack(tiles.rows(vectors, id_col, vec_col), usable, copies=k + 1)

    def compare(state, q, c):
        return (state or _Heaps(q, k)).add(c)

    hits = tiles.search(base, queries, blocks, compare, HITS, "nearest-hits", Quantised)
    # at most k rows of each task for each query
    best = (hits.repartition("query_id").groupBy("query_id", "vec_id")
            .agg(F.min("score").alias("score")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
