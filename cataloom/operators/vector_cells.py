"""Exact nearest neighbours that read only the cells that can matter.

A store of vectors is laid out in cells: each vector goes to the pivot nearest to its direction,
and a small table keeps for every cell its pivot, its number of vectors, the largest distance of
a member's direction from the pivot and the range of lengths.  For a query vector these give a
lower bound of the distance to anything in a cell; cells whose bound exceeds the k-th distance
already found are not read (they are partitions of the table), and the result is that of the
full scan.

Pivots are fitted on a bounded hash sample of the vectors (``SAMPLE_BYTES``); every vector is
laid out and the bounds come from all of them, so the sample changes only how much is read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.operators import knn

# Most cells, and bytes of the vectors the pivots are fitted on.
MOST_CELLS = 1024
SAMPLE_BYTES = 32 * 1024 * 1024
FIT_ROUNDS = 6
# Cell of vectors without a direction (null, zero, non-finite, another length).
NO_CELL = -1
# Far above the rounding of sums of squares of unit vectors.
SLACK = 1e-6

_CELLS = "cell int, n long, radius double, low double, high double, pivot array<double>"


def _usable(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows with a direction, their directions, their lengths)."""
    ok = pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False).to_numpy(
        zero_copy_only=False)
    x = vectors.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False)
    x = x.astype(np.float64).reshape(-1, dim)
    at = np.flatnonzero(ok)
    with np.errstate(all="ignore"):
        length = np.sqrt((x * x).sum(axis=1))
        good = np.isfinite(length) & (length > 1e-150)
        return at[good], x[good] / length[good, None], length[good]


def fit_pivots(sample: np.ndarray, cells: int) -> np.ndarray:
    """Directions that spread over the sample (a few rounds of spherical k-means)."""
    step = max(1, len(sample) // cells)
    pivots = sample[::step][:cells].copy()
    for _ in range(FIT_ROUNDS):
        near = np.argmax(sample @ pivots.T, axis=1)
        total = np.zeros_like(pivots)
        np.add.at(total, near, sample)
        length = np.sqrt((total * total).sum(axis=1))
        pivots[length > 1e-9] = (total / np.where(length > 1e-9, length, 1)[:, None])[length > 1e-9]
    return pivots


class CellStore:
    """A store (dataset_id, pk, text_chunk, embedding) in cells below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # --- layout --------------------------------------------------------------------------

    @classmethod
    def build(cls, store: DataFrame, path: str, cells: int | None = None,
              rows_per_file: int = 1_000_000) -> "CellStore":
        """Lay out all rows of ``store``.  ``cells``: default the square root of the rows, at
        most ``MOST_CELLS``.  Files hold at most ``rows_per_file`` rows."""
        self = cls(store.sparkSession, path)
        spark = self.spark
        known = store.where(F.col("embedding").isNotNull())
        size = known.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
        n, dim = size["n"], size["d"] or 1
        cells = max(1, min(cells or math.isqrt(n), MOST_CELLS))
        rows = max(cells, min(64 * cells, SAMPLE_BYTES // (8 * dim)))
        share = F.pmod(F.xxhash64("dataset_id", "pk"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, rows / max(1, n)))
        # bounded: about ``rows`` vectors, and never more than twice as many
        sample = known.where(share).select("embedding").limit(2 * rows).toArrow().column(0)
        found = [_usable(c, dim)[1] for c in sample.chunks]
        unit = np.concatenate(found) if found else np.zeros((0, dim))
        pivots = fit_pivots(unit, cells) if len(unit) else np.zeros((0, dim))
        schema = store.select("dataset_id", "pk", "text_chunk", "embedding").schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell = np.full(b.num_rows, NO_CELL, np.int32)
                gap, length = np.zeros((2, b.num_rows))
                at, x, lengths = _usable(b.column(3), dim)
                if len(pivots) and len(at):
                    near = np.argmax(x @ pivots.T, axis=1)
                    cell[at] = near
                    gap[at] = np.sqrt(((x - pivots[near]) ** 2).sum(axis=1))
                    length[at] = lengths
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(cell), pa.array(gap), pa.array(length)],
                    names=[*b.schema.names, "cell", "gap", "length"])

        laid = store.select(*schema.fieldNames()).mapInArrow(
            run, schema.add("cell", "integer").add("gap", "double").add("length", "double"))
        # a cell may hold most rows (those without a vector are one): a crowded cell is split by
        # its bytes over as many tasks as it needs, small ones share a task
        (laid.hint("rebalance", "cell").write.option("maxRecordsPerFile", rows_per_file)
         .partitionBy("cell").parquet(f"{self.path}/rows"))
        # an empty store has no cell to read the columns from
        spark.createDataFrame([], laid.schema).write.parquet(f"{self.path}/form")
        pivot_rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pivots)],
                                           "cell int, pivot array<double>")
        stats = self._rows().groupBy("cell").agg(
            F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius"), F.min("length").alias("low"),
            F.max("length").alias("high"))
        stats.join(pivot_rows, "cell", "left").select(
            "cell", "n", "radius", "low", "high", "pivot").coalesce(1).write.parquet(f"{self.path}/cells")
        return self

    def _rows(self) -> DataFrame:
        form = self.spark.read.parquet(f"{self.path}/form").schema
        return self.spark.read.schema(form).parquet(f"{self.path}/rows")

    def cells(self) -> list[dict]:
        """One entry for each cell (at most ``MOST_CELLS`` + 1)."""
        return [r.asDict() for r in self.spark.read.schema(_CELLS).parquet(f"{self.path}/cells").collect()]

    # --- search ----------------------------------------------------------------------------

    @staticmethod
    def bound(cell: dict, q: np.ndarray, metric: str) -> float:
        """No vector of the cell is nearer to ``q`` than this."""
        size = float(np.sqrt(q @ q))
        if cell["cell"] == NO_CELL or not size:
            # zero vectors have inner product 0; a distance to no direction is unknown, and last
            return 0.0 if metric == "inner" else math.inf if cell["cell"] == NO_CELL else -math.inf
        p = np.array(cell["pivot"])
        if metric == "cosine":
            gap = max(0.0, float(np.sqrt(((q / size - p) ** 2).sum())) - cell["radius"] - SLACK)
            return gap * gap / 2 - SLACK
        most = float(q @ p) + size * (cell["radius"] + SLACK)    # largest product with a direction
        most *= cell["high"] if most > 0 else cell["low"]
        return -most - SLACK * (1 + abs(most))

    def plan(self, qvec, k: int, metric: str, dataset_id: str | None = None) -> list[int]:
        """The cells a search has to read, nearest bound first."""
        q = np.array(knn.query_vector(qvec), np.float64)
        cells = sorted((self.bound(c, q, metric), c["cell"], c["n"]) for c in self.cells())
        if not np.isfinite(q).all():
            return [c for _, c, _ in cells]
        take, held = 0, 0
        while take < len(cells):
            # enough cells for k rows; twice as many when a scope leaves too few of them
            more = max(1, take)
            while take < len(cells) and (more > 0 or held < k):
                held += cells[take][2]
                take, more = take + 1, more - 1
            first = knn._knn_one(self._in([c for _, c, _ in cells[:take]]), q.tolist(), k, metric,
                                 dataset_id).select("distance").collect()      # k numbers
            found = sorted(r[0] for r in first if r[0] is not None and not math.isnan(r[0]))
            if len(found) == k:
                return [c for b, c, _ in cells if b <= found[-1]]
        return [c for _, c, _ in cells]

    def _in(self, cells: list[int]) -> DataFrame:
        return self._rows().where(F.col("cell").isin(cells)).select(
            "dataset_id", "pk", "text_chunk", "embedding")

    def _knn(self, qvec, k, metric, dataset_id) -> DataFrame:
        q = knn.query_vector(qvec)
        return knn._knn_one(self._in(self.plan(q, k, metric, dataset_id)), q, k, metric, dataset_id)

    def knn_cosine(self, qvec, k: int = knn.COSINE_K, dataset_id: str | None = None) -> DataFrame:
        """Same rows as ``knn.knn_cosine`` over the store."""
        return self._knn(qvec, knn.clamp_k(k, 1, knn.COSINE_K_MAX), "cosine", dataset_id)

    def knn_inner(self, qvec, k: int = knn.INNER_K, dataset_id: str | None = None) -> DataFrame:
        """Same rows as ``knn.knn_inner`` over the store."""
        return self._knn(qvec, knn.answer_k(k), "inner", dataset_id)
