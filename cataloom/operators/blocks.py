"""Every row of a large frame against a set of questions, block by block.

Both sides are packed into tiles: rows of one binary column that holds a bounded Arrow batch.
The question side becomes a written table of tiles; each tile of the large side meets all tiles
of one bounded block of questions through a broadcast equi join, and a step object compares
batch with batch in the task.  More questions than a block holds are answered round by round,
each round written before the next starts, so executors and driver hold one block at a time.
Only two sums over the question tiles reach driver code.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.operators.util import union_all, written

# Bytes of a tile of the large side and of the question side, and of the question
# tiles that are broadcast at once.
TILE_BYTES = 4 * 1024 * 1024
QUESTION_TILE_BYTES = 1024 * 1024
BLOCK_BYTES = 16 * 1024 * 1024

_TILE = "one int, part long, tile long, data binary"


def _ipc(batches: list[pa.RecordBatch]) -> bytes:
    whole = pa.Table.from_batches(batches).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, whole.schema) as w:
        w.write_table(whole)
    return sink.getvalue().to_pybytes()


def _batch(data: pa.Scalar) -> pa.RecordBatch:
    """The batch of a tile, in place where it is one piece."""
    t = pa.ipc.open_stream(data.as_buffer()).read_all()
    if t.num_rows and len(t.to_batches()) > 1:
        t = t.combine_chunks()
    return (t.to_batches() or [pa.RecordBatch.from_pylist([], schema=t.schema)])[0]


def pack(df: DataFrame, tile_bytes: int) -> DataFrame:
    """Rows packed into tiles of about ``tile_bytes`` where they are; a larger row has
    a tile of its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def tile():
            nonlocal made, held, size
            data, held, size = _ipc(held), [], 0
            made += 1
            return pa.RecordBatch.from_pylist(
                [{"one": 1, "part": part, "tile": made, "data": data}],
                schema=pa.schema([("one", pa.int32()), ("part", pa.int64()), ("tile", pa.int64()),
                                  ("data", pa.binary())]))

        for b in batches:
            rows = max(1, int(b.num_rows * tile_bytes / max(1, b.nbytes)))
            for lo in range(0, b.num_rows, rows):
                piece = b.slice(lo, rows)
                if held and size + piece.nbytes > tile_bytes:
                    yield tile()
                held.append(piece)
                size += piece.nbytes
        if held:
            yield tile()

    return df.mapInArrow(run, _TILE)


class Step:
    """What a task does with pairs of batches.  ``add`` may yield rows at once;
    ``end`` yields what the task has gathered.  ``key`` names the question batch."""

    def add(self, key: tuple, left: pa.RecordBatch, right: pa.RecordBatch
            ) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError

    def end(self) -> Iterator[pa.RecordBatch]:
        return iter(())


def block_join(large: DataFrame, questions: DataFrame, step: Callable[[], Step], schema,
               tile_bytes: int | None = None, question_bytes: int | None = None,
               block_bytes: int | None = None) -> DataFrame:
    """Rows that the steps of all tasks yield; ``schema`` is their type.  Sizes
    default to the constants above."""
    tile_bytes, block_bytes = tile_bytes or TILE_BYTES, block_bytes or BLOCK_BYTES
    question_bytes = min(question_bytes or QUESTION_TILE_BYTES, block_bytes)
    # the hint lets adaptive execution gather small partitions of questions
    tiles = written(pack(questions.hint("rebalance"), question_bytes), "questions")
    size = tiles.agg(F.sum(F.octet_length("data")).alias("b")).first()["b"] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    left = pack(large, tile_bytes).select("one", F.struct("part", "tile").alias("l"),
                                          F.col("data").alias("l_data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, seen, at, now = step(), {}, None, None
        for b in batches:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            for i in range(b.num_rows):
                l, q = (tuple(col[c][i].as_py().values()) for c in ("l", "q"))
                if l != at:
                    at, now = l, _batch(col["l_data"][i])
                if q not in seen:
                    seen[q] = _batch(pa.scalar(col["q_data"][i].as_py()))
                yield from work.add(q, now, seen[q])
        yield from work.end()

    found = []
    for k in range(blocks):
        own = tiles if blocks == 1 else tiles.where(F.pmod(F.col("part") + F.col("tile"),
                                                           F.lit(blocks)) == k)
        # about block_bytes, as measured above
        right = F.broadcast(own.select("one", F.struct("part", "tile").alias("q"),
                                       F.col("data").alias("q_data")))
        hits = left.join(right, "one").select("l", "l_data", "q", "q_data").mapInArrow(run, schema)
        found.append(hits if blocks == 1 else written(hits, "round"))
    return union_all(found)
