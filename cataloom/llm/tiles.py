"""Tables whose rows are tiles of many vectors, so that searches join block with block.

A tile holds the ids, tags (a label, or 0) and vectors of rows of one dimension as plain bytes:
``tile, dim, n, ids, tags, x, extra``.  Queries become a small written table of tiles; every
candidate row is packed where it was read and meets all query tiles of its dimension through a
broadcast join of one bounded block of queries.  More queries than a block are searched round by
round, each written before the next one starts.  Nothing of it passes through driver code but
two sums.

Rows without an id or a vector, empty vectors and vectors with null or non-finite components
take no part.  Of equal vectors (with one tag) in a tile only the ``copies`` smallest ids are
kept; as they all score alike, no other can be among the first ``copies`` - 1 of a query.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm.common import written

#: Rows, and bytes of the vectors, of a tile.
TILE_ROWS = 1024
TILE_BYTES = 4 << 20
#: Bytes of the query tiles that are broadcast at once.
BLOCK_BYTES = 32 << 20

TILE = "tile long, dim int, n int, ids binary, tags binary, x binary, extra binary"


def rows(df: DataFrame, id_col: str, vec_col: str, tag=None) -> DataFrame:
    """(id, tag, v, extra) of a table; all its other columns are left behind."""
    return df.select(df[id_col].cast("long").alias("id"),
                     (F.lit(0) if tag is None else tag).cast("long").alias("tag"),
                     df[vec_col].cast("array<double>").alias("v"),
                     F.lit(None).cast("array<long>").alias("extra"))


def _valid(b: pa.RecordBatch, prepare: Callable) -> Iterator[tuple]:
    """(ids, tags, matrix, extra) of the rows that take part, by dimension."""
    size = pc.fill_null(pc.list_value_length(b.column(2)), 0).to_numpy(zero_copy_only=False)
    known = (pc.is_valid(b.column(0)).to_numpy(zero_copy_only=False)
             & pc.is_valid(b.column(1)).to_numpy(zero_copy_only=False) & (size > 0))
    for d in np.unique(size[known]):
        own = b.filter(pa.array(known & (size == d)))
        x = own.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, int(d))
        with np.errstate(all="ignore"):
            x, ok = prepare(x)
        extra = own.column(3)
        wide = (extra.flatten().to_numpy().reshape(len(x), -1) if not extra.null_count
                else np.zeros((len(x), 0), np.int64))
        yield (own.column(0).to_numpy()[ok], own.column(1).to_numpy()[ok], x[ok], wide[ok])


def first_copies(ids: np.ndarray, tags: np.ndarray, x: np.ndarray, copies: int) -> np.ndarray:
    """Positions of the ``copies`` smallest ids of each (tag, vector); repeated rows once."""
    key = np.ascontiguousarray(np.column_stack([tags.astype(np.float64), x + 0.0]))
    _, group = np.unique(key.view(np.dtype((np.void, key.shape[1] * 8))).ravel(),
                         return_inverse=True)
    order = np.lexsort((ids, group))
    g, i = group[order], ids[order]
    new = np.ones(len(i), bool)
    new[1:] = (g[1:] != g[:-1]) | (i[1:] != i[:-1])
    order, g = order[new], g[new]
    at = np.arange(len(g))
    start = np.maximum.accumulate(np.where(np.r_[True, g[1:] != g[:-1]], at, 0))
    return np.sort(order[at - start < copies])


def pack(frame: DataFrame, prepare: Callable, copies: int | None = None) -> DataFrame:
    """``rows`` packed where they are read.  ``prepare`` maps a matrix (null components are
    NaN) to its values and the rows that take part.  ``copies``: see above (None keeps all)."""
    most_rows, most_bytes = TILE_ROWS, TILE_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held = TaskContext.get().partitionId(), 0, {}

        def tile(d):
            nonlocal made
            ids, tags, x, extra = (np.concatenate(c) for c in zip(*held.pop(d)))
            if copies is not None and len(ids):
                at = first_copies(ids, tags, x, copies)
                ids, tags, x, extra = ids[at], tags[at], x[at], extra[at]
            made += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 24) + made], pa.int64()), pa.array([d], pa.int32()),
                 pa.array([len(ids)], pa.int32()),
                 *[pa.array([v.tobytes()], pa.binary()) for v in (ids, tags, x, extra)]],
                names=["tile", "dim", "n", "ids", "tags", "x", "extra"])

        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                for ids, tags, x, extra in _valid(b.slice(lo, 2048), prepare):
                    d = x.shape[1]
                    step = min(most_rows, max(1, most_bytes // (8 * d)))
                    for at in range(0, len(ids), step):
                        cut = slice(at, at + step)
                        piece = ids[cut], tags[cut], x[cut], extra[cut]
                        if sum(len(p[0]) for p in held.get(d, ())) + len(piece[0]) > step:
                            yield tile(d)
                        held.setdefault(d, []).append(piece)
        for d in list(held):
            yield tile(d)

    return frame.mapInArrow(run, TILE)


def query_tiles(queries: DataFrame, prepare: Callable, name: str) -> tuple[DataFrame, int]:
    """The tiles of the query ``rows``, as a written table with a column ``block``, and the
    number of blocks.  Only the number of rows and components reaches the driver."""
    q = written(queries, name)
    size = q.agg(F.sum(F.coalesce(F.size("v"), F.lit(0)).cast("long")
                       + F.coalesce(F.size("extra"), F.lit(0))).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(size * 8 / BLOCK_BYTES))
    tiles = pack(q.repartition(max(1, math.ceil(size * 8 / TILE_BYTES))), prepare)
    block = F.shiftright("tile", 24) % blocks
    return written(tiles.withColumn("block", block), f"{name}-tiles"), blocks


class Tile:
    """A tile as arrays; the joined row's columns start with ``prefix``."""

    def __init__(self, row: dict, prefix: str, views: Callable | None = None):
        n, d = row[f"{prefix}n"], row["dim"]
        self.ids = np.frombuffer(row[f"{prefix}ids"], np.int64)
        self.tags = np.frombuffer(row[f"{prefix}tags"], np.int64)
        self.x = np.frombuffer(row[f"{prefix}x"], np.float64).reshape(n, d)
        self.extra = np.frombuffer(row[f"{prefix}extra"], np.int64).reshape(n, -1)
        # how many rows of the tile one id has at most
        self.most = int(np.unique(self.ids, return_counts=True)[1].max(initial=1))
        self.view = views(self.x) if views else None


def search(candidates: DataFrame, tiles: DataFrame, blocks: int, compare: Callable,
           schema: str, name: str, views: Callable | None = None) -> DataFrame:
    """Every candidate tile against every query tile of its dimension.

    ``compare(state, q, c)`` updates the state of query tile ``q`` (None at first) with
    candidate tile ``c`` and returns it; ``state.rows()`` at the end gives the columns of
    ``schema``.  A task holds one block of queries and its running results, whatever the
    number of candidates."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, states, c, at = {}, {}, None, None
        for b in batches:
            for i in range(b.num_rows):
                row = {k: b.column(j)[i].as_py() for j, k in enumerate(b.schema.names)
                       if k in ("c_tile", "q_tile", "dim")}
                need = [p for p, seen in (("c_", row["c_tile"] == at),
                                          ("q_", row["q_tile"] in queries)) if not seen]
                row |= {k: b.column(j)[i].as_py() for j, k in enumerate(b.schema.names)
                        if k[:2] in need}
                if "c_" in need:
                    c, at = Tile(row, "c_", views), row["c_tile"]
                if "q_" in need:
                    queries[row["q_tile"]] = Tile(row, "q_", views)
                q = queries[row["q_tile"]]
                if len(q.ids) and len(c.ids):
                    states[row["q_tile"]] = compare(states.get(row["q_tile"]), q, c)
        for s in states.values():
            yield s.rows()

    def side(df, prefix):
        return df.select("dim", *[F.col(k).alias(prefix + k) for k in
                                  ("tile", "n", "ids", "tags", "x", "extra")])

    left, found = side(candidates, "c_"), []
    for k in range(blocks):
        # at most BLOCK_BYTES of vectors (measured in query_tiles)
        right = F.broadcast(side(tiles.filter(F.col("block") == k), "q_"))
        hits = left.join(right, "dim").mapInArrow(run, schema)
        found.append(hits if blocks == 1 else written(hits, name))
    all_hits = found[0]
    for f in found[1:]:
        all_hits = all_hits.unionByName(f)
    return all_hits


def candidates_below(key: np.ndarray, ok: np.ndarray, limit: np.ndarray, want: int,
                     upper: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the cells with ``ok`` and key <= limit of their row.  Where many are
    left, the limit falls to the ``want``-th smallest ``upper`` (default: key) of the row."""
    keep = ok & ~(key > limit[:, None])
    n = keep.sum(axis=1)
    crowded = np.flatnonzero(n > 4 * want)
    if len(crowded) and key.shape[1] > want:
        u = (key if upper is None else upper)[crowded]
        worst = np.iinfo(u.dtype).max if u.dtype.kind == "i" else np.inf
        u = np.where(ok[crowded], u, worst)
        u = np.where(u == u, u, worst) if u.dtype.kind == "f" else u
        kth = np.partition(u, want - 1, axis=1)[:, want - 1]
        keep[crowded] &= ~(key[crowded] > kth[:, None])
    return np.nonzero(keep)


def best_of(slot: np.ndarray, key: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` smallest (key, id) of each slot; an id counts once, at its
    smallest key."""
    order = np.lexsort((key, ids, slot))
    s, i = slot[order], ids[order]
    new = np.ones(len(order), bool)
    new[1:] = (s[1:] != s[:-1]) | (i[1:] != i[:-1])
    order = order[new]
    order = order[np.lexsort((ids[order], key[order], slot[order]))]
    s, at = slot[order], np.arange(len(order))
    start = np.maximum.accumulate(np.where(np.r_[True, s[1:] != s[:-1]], at, 0)) if len(s) else at
    return order[at - start < k]
