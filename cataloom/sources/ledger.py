"""The keys of a store, kept in shards with fingerprints, so that an append asks which of its
keys are new without reading the store.

Each key is a 128-bit digest in one of ``SHARDS`` folders.  A fingerprint (count and exclusive
or of the digests) of every dataset and shard is added up over the versions of the ledger; a
batch whose own fingerprint equals it holds the same keys, and nothing more is read.  Only the
shards that differ are compared key by key, on the narrow digests.

An append writes its keys first (``begin``), then the rows, then the fingerprints (``commit``).
A version without fingerprints is in doubt: the next append reads the keys of the store once and
starts a new generation.  The same happens when the store's row count (from file footers) is
not the ledger's, for example after it was changed by other means.  Null key parts count as
equal.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 64

_INTENTS = "version string, generation long"
_KEYS = "dataset_id string, a long, b long, generation long, version string, shard int"
_PRINTS = "dataset_id string, shard int, n long, a long, b long, generation long, version string"


def digests(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with ``_a``, ``_b`` (the digest of their key) and ``_shard``."""
    return (rows.withColumn("_a", F.xxhash64(*keys)).withColumn("_b", F.xxhash64(F.lit("key"), *keys))
            .withColumn("_shard", F.pmod("_a", F.lit(SHARDS)).cast("int")))


class KeyLedger:
    """The ledger below ``path`` of a store whose key is ``keys`` (``dataset_id`` first)."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys

    def _read(self, what: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{what}")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return self.spark.createDataFrame([], schema)

    def _state(self) -> tuple[int, bool]:
        """(newest generation with fingerprints or 0, whether a version is in doubt)."""
        done = {(r["generation"], r["version"]) for r in
                self._read("prints", _PRINTS).select("generation", "version").distinct().collect()}
        newest = max((g for g, _ in done), default=0)
        intents = self._read("intents", _INTENTS).collect()          # one row for each append
        doubt = any((r["generation"], r["version"]) not in done for r in intents
                    if r["generation"] >= newest)
        return newest, doubt

    # --- reading -----------------------------------------------------------------------

    def _prints(self, generation: int) -> DataFrame:
        return (self._read("prints", _PRINTS).where(F.col("generation") == generation)
                .where("n > 0").groupBy("dataset_id", "shard").agg(
                    F.sum("n").alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b")))

    def changed(self, batch: DataFrame, generation: int) -> list[int]:
        """Shards in which the batch has other keys than the ledger."""
        own = self._fingerprints(batch)
        o, p = own.alias("o"), self._prints(generation).alias("p")
        same = [F.col(f"o.{c}").eqNullSafe(F.col(f"p.{c}")) for c in ("dataset_id", "shard", "n", "a", "b")]
        other = o.join(p, same, "left_anti")
        return sorted(r[0] for r in other.select("shard").distinct().collect())

    @staticmethod
    def _fingerprints(rows: DataFrame) -> DataFrame:
        return rows.groupBy("dataset_id", F.col("_shard").alias("shard")).agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor("_a").alias("a"), F.bit_xor("_b").alias("b"))

    def absent(self, batch: DataFrame, store: DataFrame) -> DataFrame:
        """Rows of ``batch`` (one for each key) whose key the store doesn't have."""
        self.recover(store)
        generation, _ = self._state()
        rows = digests(batch, self.keys)
        shards = self.changed(rows, generation)
        held = (self._read("keys", _KEYS).where(F.col("generation") == generation)
                .where(F.col("shard").isin(shards)).select(F.col("a").alias("_a"), F.col("b").alias("_b"),
                                                           F.col("shard").alias("_shard")))
        return (rows.where(F.col("_shard").isin(shards)).join(held, ["_shard", "_a", "_b"], "left_anti")
                .select(*batch.columns))

    # --- writing -------------------------------------------------------------------------

    def begin(self, fresh: DataFrame, generation: int | None = None) -> tuple[int, str]:
        """Note the keys that are about to be stored."""
        generation = self._state()[0] if generation is None else generation
        version = uuid.uuid4().hex[:12]
        self.spark.createDataFrame([(version, generation)], _INTENTS).coalesce(1).write.mode(
            "append").parquet(f"{self.path}/intents")
        (digests(fresh.select(*self.keys), self.keys)
         .select(F.col(self.keys[0]).cast("string").alias("dataset_id"), F.col("_a").alias("a"),
                 F.col("_b").alias("b"), F.col("_shard").alias("shard"))
         .repartition("shard").write.partitionBy("shard")
         .parquet(f"{self.path}/keys/generation={generation}/version={version}"))
        return generation, version

    def commit(self, noted: tuple[int, str]) -> None:
        """The keys of ``begin`` are stored."""
        at = f"generation={noted[0]}/version={noted[1]}"
        keys = (self._read("keys", _KEYS).where(F.col("generation") == noted[0])
                .where(F.col("version") == noted[1])
                .select("dataset_id", F.col("shard").alias("_shard"), F.col("a").alias("_a"),
                        F.col("b").alias("_b")))
        prints = self._fingerprints(keys)
        none = self.spark.createDataFrame([(None, 0, 0, 0, 0)],      # an append of nothing, too
                                          "dataset_id string, shard int, n long, a long, b long")
        prints.unionByName(none).coalesce(1).write.parquet(f"{self.path}/prints/{at}")

    def forget(self) -> None:
        """The store changes by other means: the next append reads its keys again."""
        generation, _ = self._state()
        if generation:
            self.spark.createDataFrame([("changed-" + uuid.uuid4().hex[:12], generation)], _INTENTS
                                       ).coalesce(1).write.mode("append").parquet(f"{self.path}/intents")

    def recover(self, store: DataFrame) -> bool:
        """Start a new generation from the store's keys if the ledger may not match it."""
        generation, doubt = self._state()
        if generation and not doubt:
            known = self._prints(generation).agg(F.sum("n").alias("n")).first()["n"] or 0
            if known == store.count():                               # file footers only
                return False
        self.commit(self.begin(store.select(*self.keys).distinct(), generation + 1))
        return True
