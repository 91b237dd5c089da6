"""Best-fit packing of token sequences.

Documents become pieces of at most ``capacity`` tokens; only their sizes are
shuffled.  Each task packs its share online: a fixed number of bins is open,
kept in lists by free space with one bit per free space that has a bin.  The
next piece goes to the bin with the least sufficient free space (lowest set bit
at or above its length); without one a bin is opened, and when more than
``open_bins`` are open the fullest closes first.  Pieces come in hash order, so
every task sees the same mix of lengths, and in small sorted lots, the longest
of a lot first; memory stays at ``open_bins`` bins and one lot of pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm.common import out, own_names, sub_batches, written

CAPACITY = 2048
OPEN_BINS = 4096
#: Pieces one task packs: many, as every task ends with some bins partly filled.
TASK_PIECES = 100_000
#: Pieces that are looked at together, the longest first.
LOT = 4096
#: A longer run without white space goes to the library whose merge loop is not
#: quadratic in the length of a word.
LONG_WORD = 1000


class Tokens:
    """Ids of a byte-level BPE: those of the tokenizer file, computed from the
    same vocabulary as ranks (several times faster; equal ids are tested)."""

    def __init__(self, tokenizer_file: str, ranks_file: str | None, pattern: str | None,
                 end_id: int):
        import os
        import re
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.exact, self.end = Tokenizer.from_file(tokenizer_file), np.uint32(end_id)
        self.fast, self.long = None, re.compile(r"\S{%d}|\s{%d}" % (LONG_WORD, LONG_WORD))
        if ranks_file:
            import base64

            import tiktoken
            with open(ranks_file, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            special = {t.content: i for i, t in self.exact.get_added_tokens_decoder().items()}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks,
                                          special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or self.long.search(text):
            found = np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        else:
            found = self.fast.encode_to_numpy(text, allowed_special="all").astype(np.uint32)
        return np.append(found, self.end)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: all but the first are full."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)] if n else []


def tokenize_pieces(df: DataFrame, id_col: str, text_col: str, tokens: dict,
                    capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) for every document; null text
    is empty and has the end id only."""
    src = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    id_type = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = schema = None
        for batch, texts in sub_batches(batches, "text"):
            coder = coder or Tokens(**tokens)
            schema = schema or pa.schema(
                [("id", batch.schema.field("id").type), ("piece", pa.int32()),
                 ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
                + [("ids", pa.list_(pa.int64()))] * ids)
            row, piece, start, length, crc, lists = [], [], [], [], [], []
            for i, t in enumerate(texts):
                found = coder.ids(t).astype("<u4")
                for k, (s, m) in enumerate(cut(len(found), capacity)):
                    part = found[s:s + m]
                    row.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(m)
                    crc.append(zlib.crc32(part.tobytes()))
                    if ids:
                        lists.append(part.astype(np.int64))
            yield out(schema, batch.column(0).take(pa.array(row, pa.int64())), piece, start,
                      length, crc, *([lists] if ids else []))

    return src.mapInArrow(run, f"id {id_type}, piece int, start long, length long, ids_crc32 long"
                          + ", ids array<long>" * ids)


class Packer:
    """Bounded-space online best-fit over bins of ``capacity``."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0  # bit f is set iff by_free[f] has a bin
        self.n_open = self.n_bins = 0

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) for the next piece."""
        fit = self.bits >> length
        if fit:
            free = length + (fit & -fit).bit_length() - 1
            here = self._take(free)
        else:
            free, here = self.capacity, self.n_bins
            self.n_bins += 1
        left = free - length
        if left:
            self.by_free[left].append(here)
            self.bits |= 1 << left
            self.n_open += 1
            if self.n_open > self.open_bins:  # the fullest closes first
                self._take((self.bits & -self.bits).bit_length() - 1)
        return here, self.capacity - free

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        here = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return here


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS,
         task_pieces: int = TASK_PIECES) -> DataFrame:
    """All columns of ``pieces`` plus sequence_id and offset.

    ``pieces`` has a long ``length`` from 1 to ``capacity`` (others raise an
    error).  Pieces are spread evenly over tasks of about ``task_pieces`` each,
    whatever their ids, so one id or source cannot fill a task; repeated rows are
    pieces of their own.  No rows give no rows.  Columns named sequence_id or
    offset are replaced."""
    pieces = written(pieces.drop("sequence_id", "offset"), "pieces")
    n = max(1, -(-pieces.count() // task_pieces))
    h, = own_names(pieces, "h")
    dealt = pieces.withColumn(h, F.xxhash64(*pieces.columns)).repartition(n)
    dealt = dealt.sortWithinPartitions(h).drop(h)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        base = TaskContext.get().partitionId() << 40
        packer = Packer(capacity, open_bins)
        for batch in batches:
            for lo in range(0, batch.num_rows, LOT):
                b = batch.slice(lo, LOT)
                lengths = b.column(b.schema.get_field_index("length")).to_pylist()
                if any(x is None or not 0 < x <= capacity for x in lengths):
                    raise ValueError(f"piece lengths must be from 1 to {capacity}")
                placed = [(0, 0)] * len(lengths)
                for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
                    placed[i] = packer.put(lengths[i])
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array([base + p[0] for p in placed], pa.int64()),
                     pa.array([p[1] for p in placed], pa.int64())],
                    names=[*b.schema.names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.mapInArrow(run, f"{schema}, sequence_id long, offset long")
