"""A maintained index of byte grams for exact phrase search.

A segment is written for each loaded batch of the store and holds, per lot of documents of one
build task, the postings of every 4-byte gram of the lower-cased UTF-8 texts (each text ends
with zero bytes, so its last bytes start grams too) and the keys of the lot's documents.
Segments of a size tier are merged once there are ``FANOUT`` of them: postings are sorted
together by gram and lots stay as they are, so nothing is indexed again.  A segment counts from
the moment its ``meta`` row is written; a merged one names those it replaces, so readers see
either the old segments or the new one.

A phrase is probed with its rarest grams, a phrase of fewer than four bytes with all grams it
begins; candidates are verified on the live texts, so postings of replaced or deleted rows do
no harm and a result is always that of a full search.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cataloom.operators import search
from cataloom.operators.util import spread, written

GRAM = 4
# Documents and bytes of text of a lot, and bytes of text looked at in one go.
LOT_DOCS = 4096
LOT_BYTES = 8 << 20
PIECE_BYTES = 8 << 20
# Segments of one tier that are merged; a tier holds FANOUT times the documents of the one below.
FANOUT = 4
TIER_DOCS = 10_000
# Rarest grams a phrase is probed with.
PROBES = 3
# Candidates of a question that are verified first; the others only if these give too few hits.
FIRST = 32

_SEGMENT = ("gram long, lot long, n int, docs array<int>, "
            "ids array<struct<dataset_id:string,pk:string>>")
_ROWS = pa.schema([
    ("gram", pa.int64()), ("lot", pa.int64()), ("n", pa.int32()), ("docs", pa.list_(pa.int32())),
    ("ids", pa.list_(pa.struct([("dataset_id", pa.string()), ("pk", pa.string())])))])
_META = "segment string, docs long, replaces array<string>"


def _grams(text: bytes) -> np.ndarray:
    """The gram that starts at each byte, as a number in byte order."""
    padded = np.frombuffer(text + bytes(GRAM - 1), np.uint8)
    return np.ndarray((len(text),), ">u4", padded, strides=(1,)).astype(np.uint64)


def _different(keys: np.ndarray) -> np.ndarray:
    """Sorted, each once; ``np.unique`` hashes first, which takes ten times as long."""
    keys = np.sort(keys)
    return keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys


def _postings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(gram, document) pairs of a lot, once each, in that order."""
    keys, held, size = [], [], 0
    for doc, text in enumerate(texts):
        for lo in range(0, len(text), PIECE_BYTES):
            # a piece ends with the first bytes of the next, so no gram is lost
            grams = _grams(text[lo:lo + PIECE_BYTES + GRAM - 1])[:PIECE_BYTES]
            held.append(grams << np.uint64(32) | np.uint64(doc))
            size += len(grams)
            if size > PIECE_BYTES:
                keys.append(_different(np.concatenate(held)))
                held, size = [], 0
    every = _different(np.concatenate(keys + held)) if keys or held else np.zeros(0, np.uint64)
    return ((every >> np.uint64(32)).astype(np.int64),
            (every & np.uint64(0xFFFFFFFF)).astype(np.int32))


def _lots(first_lot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def lot():
            nonlocal made
            number = first_lot + (part << 24) + made
            made += 1
            gram, doc = _postings(texts)
            edges = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]) if len(gram) else np.zeros(0, int)
            ends = np.r_[edges, len(gram)].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(doc))
            n = len(edges)
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram[edges], pa.int64()), pa.array(np.full(n, number), pa.int64()),
                 pa.array(np.diff(ends), pa.int32()), lists, pa.nulls(n, _ROWS.field("ids").type)],
                schema=_ROWS)
            yield pa.RecordBatch.from_pylist(
                [{"gram": None, "lot": number, "n": len(ids), "docs": None, "ids": ids}],
                schema=_ROWS)

        for b in batches:
            for d, k, t in zip(*(b.column(i).to_pylist() for i in range(3))):
                if t is None:
                    continue
                if ids and (len(ids) >= LOT_DOCS or size + len(t) > LOT_BYTES):
                    yield from lot()
                    ids, texts, size = [], [], 0
                ids.append({"dataset_id": d, "pk": k})
                texts.append(t)
                size += len(t)
        if ids:
            yield from lot()

    return run


def _phrase_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(qid, gram, width): all grams of a phrase, or the whole of a shorter one."""
    schema = pa.schema([("qid", pa.int64()), ("gram", pa.int64()), ("width", pa.int32())])
    for b in batches:
        for qid, phrase in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            p = phrase.encode()
            if len(p) < GRAM:
                grams, width = np.array([int.from_bytes(p, "big")]), len(p)
            else:
                grams, width = np.unique(_grams(p)[:len(p) - GRAM + 1]).astype(np.int64), GRAM
            n = len(grams)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, qid), pa.int64()), pa.array(grams, pa.int64()),
                 pa.array(np.full(n, width), pa.int32())], schema=schema)


class GramIndex:
    """The index below ``path`` (shared storage)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # --- maintenance -----------------------------------------------------------------

    def segments(self) -> list[tuple[str, int]]:
        """(segment, documents) of those that count; one small row for each is read."""
        try:
            rows = self.spark.read.schema(_META).parquet(f"{self.path}/meta/*").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        gone = {s for r in rows for s in r["replaces"]}
        return sorted((r["segment"], r["docs"]) for r in rows if r["segment"] not in gone)

    def _commit(self, segment: str, docs: int, replaces: list[str]) -> None:
        self.spark.createDataFrame([(segment, docs, replaces)], _META).coalesce(1).write.parquet(
            f"{self.path}/meta/{segment}")

    def _data(self, segments: list[str]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], _SEGMENT)
        return self.spark.read.schema(_SEGMENT).parquet(*[f"{self.path}/data/{s}" for s in segments])

    def _counts(self, segments: list[str]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], "gram long, df long")
        return self.spark.read.schema("gram long, df long").parquet(
            *[f"{self.path}/grams/{s}" for s in segments])

    def append(self, batch: DataFrame) -> str:
        """Index the rows (dataset_id, pk, text_chunk) of a loaded batch as a new segment.
        No shuffle: postings are made and written where the rows are."""
        name = uuid.uuid4().hex[:12]
        first = int(name, 16) % (1 << 22) << 40
        rows = spread(batch.select("dataset_id", "pk", "text_chunk")).select(
            "dataset_id", "pk", F.lower("text_chunk").cast("binary").alias("t"))
        rows.mapInArrow(_lots(first), _SEGMENT).write.parquet(f"{self.path}/data/{name}")
        data = self._data([name])
        self._write_counts(data.where("gram IS NOT NULL").select("gram", F.col("n").alias("df")), name)
        docs = data.where("gram IS NULL").agg(F.sum("n").alias("n")).first()["n"] or 0
        self._commit(name, docs, [])
        return name

    def _write_counts(self, counts: DataFrame, name: str) -> None:
        (counts.groupBy("gram").agg(F.sum("df").cast("long").alias("df"))
         .write.parquet(f"{self.path}/grams/{name}"))

    def merge(self) -> list[str]:
        """Merge tiers that hold ``FANOUT`` segments or more; names of the new segments."""
        made = []
        while True:
            tiers: dict[int, list] = {}
            for s, n in self.segments():
                tiers.setdefault(int(math.log(max(1, n / TIER_DOCS), FANOUT)), []).append((s, n))
            full = [t for t in tiers.values() if len(t) >= FANOUT]
            if not full:
                return made
            old, docs = [s for s, _ in full[0]], sum(n for _, n in full[0])
            name = uuid.uuid4().hex[:12]
            (self._data(old).repartitionByRange("gram", "lot").sortWithinPartitions("gram", "lot")
             .write.parquet(f"{self.path}/data/{name}"))
            self._write_counts(self._counts(old), name)
            self._commit(name, docs, old)
            made.append(name)

    # --- search ------------------------------------------------------------------------

    def _probes(self, questions: DataFrame, live: list[str]) -> DataFrame:
        """(qid, gram, need): the grams to look up, and how many of them a document needs."""
        wanted = questions.select(F.col("qid").cast("long"), "_lphrase").mapInArrow(
            _phrase_grams, "qid long, gram long, width int")
        counts = self._counts(live)
        # a gram in no text ends the search for its phrase: it is the rarest
        found = wanted.where(F.col("width") == GRAM).join(counts, "gram", "left")
        df = found.groupBy("qid", "gram").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("df"))
        rare = F.row_number().over(Window.partitionBy("qid").orderBy("df", "gram"))
        first = df.withColumn("r", rare).where(F.col("r") <= PROBES)
        whole = (first.withColumn("need", F.count(F.lit(1)).over(Window.partitionBy("qid")))
                 .withColumn("low", F.min("df").over(Window.partitionBy("qid")))
                 .where(F.col("low") > 0).select("qid", "gram", "need"))
        begins = counts.select("gram").distinct().select("gram", F.explode(F.array(*[
            F.struct(F.shiftright("gram", 8 * (GRAM - w)).alias("p"), F.lit(w).alias("width"))
            for w in range(1, GRAM)])).alias("b"))
        short = (wanted.where(F.col("width") < GRAM).withColumnRenamed("gram", "p")
                 .join(begins.select("gram", "b.p", "b.width"), ["p", "width"])
                 .select("qid", "gram", F.lit(1).cast("long").alias("need")))
        return written(whole.unionByName(short), "probes")

    def candidates(self, questions: DataFrame) -> DataFrame:
        """(qid, dataset_id, pk) that may contain the lower-cased phrase ``_lphrase``."""
        live = [s for s, _ in self.segments()]
        probes = self._probes(questions, live)
        data = self._data(live)
        hits = (data.where("gram IS NOT NULL").select("gram", "lot", "docs")
                .join(probes, "gram")
                .select("qid", "need", "lot", F.explode("docs").alias("doc")))
        hits = (hits.groupBy("qid", "lot", "doc")
                .agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need"))
                .where(F.col("n") >= F.col("need")).select("qid", "lot", "doc"))
        ids = (data.where("gram IS NULL").select("lot", F.posexplode("ids").alias("doc", "id"))
               .select("lot", "doc", "id.*"))
        return ids.join(hits, ["lot", "doc"]).select("qid", "dataset_id", "pk")

    def _verified(self, store: DataFrame, questions: DataFrame, k: int, mode: str) -> DataFrame:
        """(qid, dataset_id, pk, text_chunk, k if given) of texts that hold their phrase, among
        them the first ``k`` (or the question's own k) of each question by (pk, dataset_id).

        The first candidates of a question in that order are verified; the others follow only
        where these hold fewer hits than wanted, so a phrase of most texts is not looked for in
        all of them.  Phrases and candidates are written, so joins are planned from their size:
        small ones are broadcast and the texts are read in place."""
        q = written(search._questions(questions, mode, False), "phrases")
        own = ["k"] if "k" in q.columns else []
        # only candidates in scope, each once (rows appended again have several postings)
        cand = written(self.candidates(q).join(q.select("qid", "_qds"), "qid")
                       .where(F.col("_qds").isNull() | (F.col("_qds") == F.col("dataset_id")))
                       .select("qid", "dataset_id", "pk").distinct(), "candidates")

        def verify(some: DataFrame) -> DataFrame:
            return (store.select("dataset_id", "pk", "text_chunk").join(some, ["dataset_id", "pk"])
                    .join(q.select("qid", "_lphrase", *own), "qid")
                    .where(F.lower("text_chunk").contains(F.col("_lphrase")))
                    .select("qid", "dataset_id", "pk", "text_chunk", *own))

        place = F.row_number().over(Window.partitionBy("qid").orderBy("pk", "dataset_id"))
        first = written(cand.withColumn("_n", place).where(F.col("_n") <= FIRST).drop("_n"), "first")
        found = written(verify(first), "found")              # at most FIRST keys a question
        wanted = q.groupBy("qid").agg(F.max("k" if own else F.lit(k)).alias("wanted"))
        few = (wanted.join(found.groupBy("qid").agg(F.count(F.lit(1)).alias("n")), "qid", "left")
               .where(F.coalesce("n", F.lit(0)) < F.col("wanted")).select("qid"))
        rest = written(cand.join(few, "qid").join(first, ["qid", "dataset_id", "pk"], "left_anti"),
                       "candidates-left")
        return found if rest.isEmpty() else found.unionByName(verify(rest))

    def topk_keys(self, store: DataFrame, questions: DataFrame, k: int = search.EXACT_K,
                  mode: str = "normalized") -> DataFrame:
        """Same keys as ``search.exact_keys`` (literal phrases) for a store whose rows have all
        been appended."""
        return search._first_by_key(self._verified(store, questions, k, mode).drop("text_chunk"), k)

    def topk(self, store: DataFrame, questions: DataFrame, k: int = search.EXACT_K,
             mode: str = "normalized") -> DataFrame:
        """Same rows as ``search.exact_topk`` (literal phrases)."""
        return search._first_by_key(self._verified(store, questions, k, mode), k).select(
            "qid", "dataset_id", "pk", "text_chunk", "distance", "rank")
