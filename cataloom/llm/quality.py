"""Quality classifier: supervised subword embeddings.

Words, character 3- and 4-grams and the pattern of word bigrams (the same word
again or another) are hashed to buckets; every bucket has a
learned vector, a document is the average of its vectors, and a softmax layer
gives the class.  Training is numpy stochastic gradient descent in one task over a
bounded sample of labelled documents; features are made where the texts are.
Averaging and the layer are linear, so scoring needs one number per bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm.common import hash_sample, out, sub_batches

BUCKET_BITS = 16
DIM = 16
EPOCHS = 6
RATE = 0.5
#: Labelled documents the classifier is fitted on at most, chosen by a hash of the id.
TRAIN_ROWS = 6000
#: Buckets of the two word bigram patterns.
REPEATED, CHANGED = 0, 1
_K = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
_SPACES = np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x2028, 0x2029, 0x3000],
                   np.uint32)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features, and the text of each (both in blocks by kind)."""
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    shift = np.uint32(32 - BUCKET_BITS)
    buckets, owner = [], []
    with np.errstate(over="ignore"):
        for size in (3, 4):
            m = len(cp) - size + 1
            if m > 0:
                h = np.full(m, size, np.uint32)
                for k in range(size):
                    h = (h ^ cp[k:k + m]) * _K[k]
                    h ^= h >> np.uint32(15)
                inside = of[:m] == of[size - 1:]
                buckets.append((h[inside] * _K[0]) >> shift)
                owner.append(of[:m][inside])
        at = np.flatnonzero(~np.isin(cp, _SPACES))
        if len(at):
            first = np.flatnonzero((np.diff(at, prepend=-2) > 1) | (np.diff(of[at], prepend=-1) > 0))
            place = np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))
            power = np.cumprod(np.full(int(place.max()) + 1, _K[1], np.uint32), dtype=np.uint32)
            h = np.add.reduceat((cp[at] * _K[2] ^ cp[at]) * power[place], first, dtype=np.uint32)
            h ^= h >> np.uint32(15)
            word_of = of[at[first]]
            buckets.append((h * _K[0]) >> shift)
            owner.append(word_of)
            # word bigrams by their pattern: the same word again, or another
            pair = word_of[1:] == word_of[:-1]
            again = (h[1:] == h[:-1])[pair]
            buckets.append(np.where(again, REPEATED, CHANGED).astype(np.uint32))
            owner.append(word_of[1:][pair])
    if not buckets:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(owner)


def fit_vectors(docs: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS,
                rate: float = RATE, dim: int = DIM, seed: int = 5) -> tuple[np.ndarray, float]:
    """(label, distinct buckets, shares) of each document -> (value of each bucket, bias):
    the difference of the two softmax inputs, by stochastic gradient descent."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << BUCKET_BITS, dim)).astype(np.float32)
    layer, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    steps, step = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            label, bucket, share = docs[i]
            now = rate * (1 - step / steps)
            step += 1
            own = vectors[bucket]
            mean = share @ own
            z = layer @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1  # gradient of the cross-entropy
            back = p @ layer
            layer -= now * np.outer(p, mean)
            bias -= now * p * 0.1
            vectors[bucket] = own - now * len(bucket) ** 0.5 * share[:, None] * back
    way = layer[1] - layer[0]
    return vectors @ way, float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
        rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """Fit on at most about ``rows`` labelled documents.  Null labels and ids are
    ignored; of rows with one id one counts, that with the smallest text hash, and of its labels
    the smallest; texts are read whole; without
    both labels the model is a constant."""
    own = (labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
           .select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("label"))
           .groupBy("i").agg(F.min("label").alias("label")))
    # at most about ``rows`` rows of 12 bytes, by construction
    own = F.broadcast(hash_sample(own, ["i"], rows))
    src = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text")).join(own, "i")
    src = src.groupBy("i").agg(F.min_by(F.struct("text", "label"), F.xxhash64("text")).alias("d")
                               ).select("d.text", "d.label")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("label", pa.int32()), ("h", pa.int64()),
                            ("bucket", pa.list_(pa.int32())), ("share", pa.list_(pa.float32()))])
        for b, texts in sub_batches(batches, "text"):
            bucket, of = features(texts)
            found, share, ends = [], [], []
            by = np.argsort(of, kind="stable")
            cuts = np.searchsorted(of[by], np.arange(len(texts) + 1))
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                k, n = np.unique(bucket[by[lo:hi]], return_counts=True)
                found.append(k.astype(np.int32))
                share.append((n / max(1, hi - lo)).astype(np.float32))
                ends.append(int(k.sum()) * 31 + hi - lo)
            yield out(schema, b.column(b.schema.get_field_index("label")), ends, found, share)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = []
        for b in batches:
            for i in range(b.num_rows):
                seen.append((b.column(0)[i].as_py(), np.asarray(b.column(2)[i].values),
                             np.asarray(b.column(3)[i].values)))
        classes = {s[0] for s in seen}
        if len(classes) == 2:
            value, bias = fit_vectors(seen)
        else:
            value = np.zeros(1 << BUCKET_BITS, np.float32)
            bias = {0: -1.0, 1: 1.0}[classes.pop()] if classes else 0.0
        yield out(pa.schema([("value", pa.binary()), ("bias", pa.float64())]),
                  [value.astype("<f4").tobytes()], [bias])

    made = src.mapInArrow(make, "label int, h long, bucket array<int>, share array<float>")
    model = (made.repartition(1).sortWithinPartitions("label", "h")
             .mapInArrow(learn, "value binary, bias double").collect())  # one row of 256 KB
    if not model:
        return np.zeros(1 << BUCKET_BITS, np.float32), 0.0
    return np.frombuffer(bytes(model[0]["value"]), "<f4"), model[0]["bias"]


def scores(texts: list[str], model: tuple[np.ndarray, float]) -> np.ndarray:
    value, bias = model
    bucket, of = features(texts)
    total = np.bincount(of, value[bucket], len(texts))
    n = np.bincount(of, minlength=len(texts))
    return 1 / (1 + np.exp(-(total / np.maximum(n, 1) + bias)))


def score_documents(df: DataFrame, id_col: str, text_col: str,
                    model: tuple[np.ndarray, float]) -> DataFrame:
    """One row per input row: id, score (0 to 1).

    Null and empty texts have no features and get the score of the bias alone.
    Repeated rows and null ids pass through; other columns are ignored; an empty
    table gives no rows."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    src = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    id_type = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in sub_batches(batches, "text"):
            yield out(pa.schema([("id", b.schema.field("id").type), ("score", pa.float64())]),
                      b.column(0), scores(texts, sent.value))

    return src.mapInArrow(run, f"id {id_type}, score double")


def keep_good(df: DataFrame, text_col: str, model: tuple[np.ndarray, float],
              threshold: float) -> DataFrame:
    """The rows of ``df`` that score at least ``threshold``, all columns unchanged."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in sub_batches(batches, text_col):
            yield b.filter(pa.array(scores(texts, sent.value) >= threshold))

    return df.mapInArrow(run, df.schema)
