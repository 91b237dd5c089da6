"""Line de-duplication with sharded cuckoo filters over exact reference counts.

A line's key is the line stripped of ASCII white space with A-Z lower-cased;
it is stored as a 128-bit digest.  The index holds two written tables:

* counts (key, n): in how many documents the key occurs, exactly;
* filters (shard, blob): a cuckoo filter per shard over the keys at or above the
  threshold.  Cuckoo filters support deletion, so when documents are deleted
  and a key falls below the threshold its fingerprint goes again.

``insert`` and ``delete`` add and subtract document counts and pass only the
keys that cross the threshold to their filter shards; ``dedup`` probes the
filters, confirms every hit against the exact counts and drops those lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.llm.common import out, own_names, sub_batches, written

SPACE = b" \t\n\x0b\x0c\r"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
THRESHOLD = 10
#: Keys a filter shard is laid out for; the number of shards follows the keys.
SHARD_KEYS = 100_000
SLOTS = 4
MAX_KICKS = 500
#: Filters up to this size in all are broadcast (2-byte fingerprints); beyond it
#: every key meets the exact counts by a join instead, with the same result.
BROADCAST_BYTES = 64 * 1024 * 1024


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).translate(LOWER)


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


class CuckooFilter:
    """Four 16-bit fingerprints per bucket; partial-key cuckoo hashing."""

    def __init__(self, keys: int = 0, table: np.ndarray | None = None):
        if table is None:
            n = 1
            while n * SLOTS * 0.8 < max(keys, 1):
                n *= 2
            table = np.zeros((n, SLOTS), np.uint16)
        self.table, self.mask = table, len(table) - 1

    @classmethod
    def load(cls, blob: bytes) -> CuckooFilter:
        return cls(table=np.frombuffer(blob, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def places(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(fingerprint, bucket, other bucket) of 16-byte digests as (n, 2) uint64."""
        fp = (digests[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)
        fp[fp == 0] = 1
        one = (digests[:, 1] >> np.uint64(16)) & np.uint64(self.mask)
        return fp, one, one ^ self._hop(fp)

    def _hop(self, fp):
        with np.errstate(over="ignore"):
            h = np.asarray(fp).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(32)) & np.uint64(self.mask)

    def has(self, digests: np.ndarray) -> np.ndarray:
        fp, a, b = self.places(digests)
        return ((self.table[a] == fp[:, None]) | (self.table[b] == fp[:, None])).any(axis=1)

    def add(self, digests: np.ndarray) -> bool:
        """False if the filter is full (it must then be built larger)."""
        for fp, a, b in zip(*self.places(digests)):
            here = None
            for bucket in (int(a), int(b)):
                empty = np.flatnonzero(self.table[bucket] == 0)
                if len(empty):
                    here = (bucket, empty[0])
                    break
            if here:
                self.table[here] = fp
                continue
            bucket = int(a)
            for kick in range(MAX_KICKS):
                slot = kick % SLOTS
                fp, self.table[bucket, slot] = self.table[bucket, slot], fp
                bucket = int(np.uint64(bucket) ^ self._hop(fp))
                empty = np.flatnonzero(self.table[bucket] == 0)
                if len(empty):
                    self.table[bucket, empty[0]] = fp
                    break
            else:
                return False
        return True

    def remove(self, digests: np.ndarray) -> bool:
        """Remove keys that were added; False if one is missing."""
        whole = True
        for fp, a, b in zip(*self.places(digests)):
            for bucket in (int(a), int(b)):
                found = np.flatnonzero(self.table[bucket] == fp)
                if len(found):
                    self.table[bucket, found[0]] = 0
                    break
            else:
                whole = False
        return whole


def as_words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)


def document_keys(docs: DataFrame, text_col: str, min_chars: int) -> DataFrame:
    """(key): one row for each distinct key of each document, of at least
    ``min_chars`` code points."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.binary())])
        for _, texts in sub_batches(batches, "text"):
            keys = []
            for t in texts:
                keys += [digest(k) for k in {line_key(x) for x in t.encode().split(b"\n")}
                         if _long(k, min_chars)]
            yield out(schema, keys)

    return docs.select(docs[text_col].alias("text")).mapInArrow(run, "key binary")


def _long(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars)


def _shard(shards: int):
    return F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")


class LineIndex:
    """Reference counts and filters of the lines of a set of documents."""

    def __init__(self, spark: SparkSession, threshold: int = THRESHOLD, min_chars: int = 1):
        self.spark, self.threshold, self.min_chars = spark, threshold, min_chars
        self.counts = spark.createDataFrame([], "key binary, n long")
        self.filters = spark.createDataFrame([], "shard long, blob binary")
        self.shards = 0
        self.filter_bytes = 0

    def insert(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        """Count the documents' lines in (rows are documents; a repeated row counts again)."""
        return self._change(docs, text_col, 1)

    def delete(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        """Take documents out again that were inserted before."""
        return self._change(docs, text_col, -1)

    def _change(self, docs: DataFrame, text_col: str, sign: int) -> LineIndex:
        delta = (document_keys(docs, text_col, self.min_chars)
                 .groupBy("key").agg((F.count(F.lit(1)) * sign).alias("n")))
        first = self.shards == 0
        both = delta.withColumn("old", F.lit(0).cast("long")) if first else (
            self.counts.select("key", F.lit(0).cast("long").alias("n"), F.col("n").alias("old"))
            .unionByName(delta.withColumn("old", F.lit(0).cast("long")))
            .groupBy("key").agg(F.sum("n").alias("n"), F.sum("old").alias("old")))
        merged = written(both.select("key", (F.col("old") + F.col("n")).alias("n"), "old"),
                         "line-counts")
        if not merged.filter("n < 0").isEmpty():
            raise ValueError("deleted lines that were never inserted")
        before, now = F.col("old") >= self.threshold, F.col("n") >= self.threshold
        crossed = merged.filter(before != now).select("key", now.alias("add"))
        self.counts = merged.filter("n > 0").select("key", "n")
        frequent = self.counts.filter(F.col("n") >= self.threshold)
        total = frequent.count()
        need = 1 << max(0, -(-total // SHARD_KEYS) - 1).bit_length()
        if need > self.shards or not self._update(crossed):
            self.shards = max(need, self.shards)
            self._build(frequent)
        self.filter_bytes = self.filters.agg(F.sum(F.octet_length("blob"))).first()[0] or 0
        return self

    def _build(self, frequent: DataFrame) -> None:
        """Filters from the exact counts."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("shard", pa.int64()), ("blob", pa.binary())])
            for shard, keys in _by_shard(batches):
                words, room = as_words(keys), len(keys)
                while not (f := CuckooFilter(room)).add(words):
                    room *= 2
                yield out(schema, [shard], [f.dump()])

        keyed = frequent.select(_shard(self.shards), "key")
        self.filters = written(keyed.repartition("shard").sortWithinPartitions("shard")
                               .mapInArrow(run, "shard long, blob binary"), "line-filters")

    def _update(self, crossed: DataFrame) -> bool:
        """Add and remove the keys that crossed the threshold; False if a filter is full."""
        def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
            f = CuckooFilter.load(left["blob"][0].as_py()) if left.num_rows else CuckooFilter(
                right.num_rows)
            keys, add = right["key"].to_pylist(), right["add"].to_pylist()
            gone = [k for k, a in zip(keys, add) if not a]
            new = [k for k, a in zip(keys, add) if a]
            whole = (not gone or f.remove(as_words(gone))) and (not new or f.add(as_words(new)))
            return pa.table({"shard": [key[0].as_py()], "blob": [f.dump()], "whole": [whole]},
                            schema=pa.schema([("shard", pa.int64()), ("blob", pa.binary()),
                                              ("whole", pa.bool_())]))

        changed = (self.filters.groupBy("shard")
                   .cogroup(crossed.select(_shard(self.shards), "key", "add").groupBy("shard"))
                   .applyInArrow(run, "shard long, blob binary, whole boolean"))
        changed = written(changed, "line-filters")
        if not changed.filter("not whole").isEmpty():
            return False
        self.filters = changed.select("shard", "blob")
        return True

    def dropped(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """(row, keys): for documents with lines to drop, the row key (a hash of
        the text) and the digests of those lines."""
        hits = self._candidates(docs.select(F.xxhash64(text_col).alias("row"),
                                            F.col(text_col).alias("text")))
        frequent = self.counts.filter(F.col("n") >= self.threshold).select("key")
        return (hits.join(frequent, "key").groupBy("row")
                .agg(F.collect_set("key").alias("keys")))

    def _candidates(self, docs: DataFrame) -> DataFrame:
        min_chars, shards = self.min_chars, self.shards
        sent = None
        if 0 < self.filter_bytes <= BROADCAST_BYTES:
            sent = self.spark.sparkContext.broadcast(
                {r["shard"]: bytes(r["blob"]) for r in self.filters.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("row", pa.int64()), ("key", pa.binary())])
            probe = Probe(sent.value, shards) if sent else None
            seen: set[int] = set()  # copies of a text are probed once in a task
            for batch, texts in sub_batches(batches, "text"):
                rows, keys = [], []
                for row, t in zip(batch.column(0).to_pylist(), texts):
                    if row in seen:
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(row)
                    own = [digest(k) for k in {line_key(x) for x in t.encode().split(b"\n")}
                           if _long(k, min_chars)]
                    rows += [row] * len(own)
                    keys += own
                if probe and keys:
                    maybe = np.flatnonzero(probe.has(keys))
                    rows, keys = [rows[i] for i in maybe], [keys[i] for i in maybe]
                yield out(schema, rows, keys)

        return docs.mapInArrow(run, "row long, key binary")

    def dedup(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """All columns of ``docs`` with the frequent lines taken out of the text,
        plus _n_lines and _n_dropped (before and dropped).

        Null text stays null if nothing is dropped and counts as one empty line.
        Empty keys (below min_chars) are never dropped.  Texts of any length are read whole.
        Repeated rows, null ids and extra columns pass through (columns named _n_lines or
        _n_dropped are replaced); an empty table gives no rows."""
        docs = docs.drop("_n_lines", "_n_dropped")
        row, keys = own_names(docs, "row", "keys")
        # written first, and joined by shuffle at every size: both sides come straight from
        # an exchange, so adaptive execution can split the copies of a hot text
        gone = written(self.dropped(docs, text_col).select(F.col("row").alias(row),
                                                           F.col("keys").alias(keys)), "dropped").hint("merge")
        joined = (docs.withColumn(row, F.xxhash64(text_col)).join(gone, row, "left")
                  .select(*docs.columns, keys))
        names, types = docs.columns, [f.dataType.simpleString() for f in docs.schema]
        at, min_chars = names.index(text_col), self.min_chars

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, texts in sub_batches(batches, text_col):
                drops = b.column(len(names)).to_pylist()
                column, kept, n, m = b.column(at), [], [], []
                for t, drop in zip(texts, drops):
                    lines = t.encode().split(b"\n")
                    n.append(len(lines))
                    if drop:
                        drop = set(drop)
                        own = [x for x in lines if not (
                            _long(k := line_key(x), min_chars) and digest(k) in drop)]
                        t = b"\n".join(own).decode()
                        m.append(len(lines) - len(own))
                    else:
                        m.append(0)
                    kept.append(t)
                if any(m):
                    nulls = column.is_null().to_pylist()
                    kept = [None if x and not k else t for x, k, t in zip(nulls, m, kept)]
                    column = pa.array(kept, column.type)
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:at], column, *b.columns[at + 1:len(names)],
                     pa.array(n, pa.int64()), pa.array(m, pa.int64())],
                    names=[*names, "_n_lines", "_n_dropped"])

        schema = ", ".join(f"`{a}` {k}" for a, k in zip(names, types))
        return joined.mapInArrow(run, f"{schema}, _n_lines long, _n_dropped long")


class Probe:
    """Looks digests up in the filter of their shard."""

    def __init__(self, blobs: dict[int, bytes], shards: int):
        self.filters = {s: CuckooFilter.load(b) for s, b in blobs.items()}
        self.shards = shards

    def has(self, keys: list[bytes]) -> np.ndarray:
        import xxhash
        words = as_words(keys)
        # the same hash as the SQL function xxhash64, seed 42, signed
        shard = np.array([xxhash.xxh64_intdigest(k, 42) for k in keys], np.uint64).view(np.int64)
        shard = np.mod(shard, self.shards)
        found = np.zeros(len(keys), bool)
        for s in np.unique(shard):
            if (f := self.filters.get(int(s))) is not None:
                of = np.flatnonzero(shard == s)
                found[of] = f.has(words[of])
        return found


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """(shard, keys) from batches sorted by shard; a shard holds about SHARD_KEYS keys."""
    now, keys = None, []
    for b in batches:
        for s, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if s != now:
                if keys:
                    yield now, keys
                now, keys = s, []
            keys.append(k)
    if keys:
        yield now, keys
