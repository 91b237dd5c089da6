"""Near-duplicate vectors by sorted projection passes.

Each pass draws random hyperplanes, gives every vector the concatenated bits of
the sides it lies on, sorts all vectors of a label by those bits and compares
each vector with the next ``window`` vectors of the order.  Pairs at or above
the threshold (cosine in double precision) are united over all passes into
components.  A bounded window cannot list every pair of a dense group, so links
are then counted exactly inside each component, block against block.

The hyperplanes go through the mean of the label, so vectors crowded around one
direction still fall on both sides.  Passes and window follow the label: a pair at
the threshold differs in a random bit with probability acos(r) / pi, where r is what
the threshold becomes once the mean cosine of the label is taken out, and meets in a
window when it agrees in the log2(n / window) bits that lead there.  Of the windows
that reach the wanted recall the one with the least work is taken; a label no larger
than the widest window is compared whole in one pass.

Equal vectors of a label are compared as one: copies take one place in the order
and count by their number.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cataloom.llm.common import out, positions, written
from cataloom.llm.components import components

#: Wanted share of the pairs at the threshold that meet in a window.
RECALL = 0.999
BITS = 48
#: The narrowest window, and how often it may be doubled.
WINDOW = 256
DOUBLINGS = 5
#: Comparisons that cost as much as sending one vector to a block.
COMPARE = 400
#: Least cosine that a pair at the threshold is taken to have around the label's mean.
LEAST = 0.3
#: Vectors in one block of the sorted order, and of the count inside a component.
BLOCK = 2048
#: Vectors of a block that are compared at once.
STEP = 256


def vectors(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(row, id, label, vec, same): vectors as they are (float or double); vec is null for rows
    that link with nothing (null, empty, zero or non-finite vectors, null labels).  ``same``
    is a 128-bit digest of label and unit vector, in two parts; that of a row without is its
    own."""
    kind = df.schema[vec_col].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    src = df.select(F.monotonically_increasing_id().alias("row"), df[id_col].alias("id"),
                    df[label_col].cast("string").alias("label"), df[vec_col].cast(kind).alias("vec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                yield _digests(b.slice(lo, BLOCK))

    return (src.mapInArrow(run, StructType([*src.schema.fields, StructField("h", LongType()),
                                            StructField("k", LongType())]))
            .select("row", "id", "label", "vec", F.struct("h", "k").alias("same")))


def _digests(b: pa.RecordBatch) -> pa.RecordBatch:
    """row, id, label, vec (null where it links with nothing), and the digest's two parts."""
    row, ids, label, vec = b.columns
    size = np.nan_to_num(vec.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    x = vec.flatten().to_numpy(zero_copy_only=False)
    end = np.cumsum(size)

    def count(marks: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(marks)])
        return total[end] - total[end - size]

    good = (count(~np.isfinite(x)) == 0) & (count(x != 0) > 0) & label.is_valid().to_numpy(
        zero_copy_only=False)
    same = np.stack([row.to_numpy(), np.zeros(b.num_rows, np.int64)], axis=1)
    for d in np.unique(size[good]):
        at = np.flatnonzero(good & (size == d))
        unit = _units(vec.take(pa.array(at))) + 0.0  # no negative zeros
        names = label.take(pa.array(at)).to_pylist()
        same[at] = np.frombuffer(b"".join(
            hashlib.blake2b(u.tobytes() + n.encode(), digest_size=16).digest()
            for u, n in zip(unit, names)), np.int64).reshape(-1, 2)
    kept = pc.if_else(pa.array(good), vec, pa.scalar(None, vec.type))
    return pa.RecordBatch.from_arrays(
        [row, ids, label, kept, pa.array(same[:, 0]), pa.array(same[:, 1])],
        names=["row", "id", "label", "vec", "h", "k"])


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of one size as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _units(column: pa.Array) -> np.ndarray:
    """Unit vectors in double precision of non-zero vectors of one size."""
    x = _matrix(column)
    x /= np.abs(x).max(axis=1, keepdims=True)  # first, so that no square overflows
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def passes_for(n, threshold, window: int, recall: float = RECALL):
    """Passes (a column) after which a pair at the threshold (a number or column) has met in
    a window with probability ``recall`` among ``n`` (a column) evenly spread vectors."""
    cos = F.least(F.greatest(F.lit(threshold) if isinstance(threshold, float) else threshold,
                             F.lit(-1.0)), F.lit(1.0))
    same = 1 - F.acos(cos) / math.pi
    meets = F.pow(same, F.greatest(F.log2(n / F.lit(float(window))), F.lit(0.0)))
    needed = F.ceil(F.lit(math.log(1 - recall)) / F.log1p(-F.least(meets, F.lit(0.9))))
    return F.when(n <= window + 1, 1).otherwise(needed).cast("int")


def _sums(single: DataFrame) -> DataFrame:
    """(label, dim, n, total): numbers and sums of the unit vectors, a few rows for each label
    and task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("n", pa.int64()),
                            ("total", pa.list_(pa.float64()))])
        held: dict[tuple[str, int], list] = {}

        def flush() -> pa.RecordBatch:
            rows = [(label, d, n, t) for (label, d), (n, t) in held.items()]
            held.clear()
            return out(schema, *map(list, zip(*rows)))

        for b in batches:
            sizes = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(sizes):
                part = b.filter(pa.array(sizes == d))
                label = part.column(0).dictionary_encode()
                at, x = label.indices.to_numpy(), _units(part.column(1))
                for i, name in enumerate(label.dictionary.to_pylist()):
                    own = x[at == i]
                    n, t = held.get((name, int(d)), (0, 0.0))
                    held[name, int(d)] = [n + len(own), t + own.sum(axis=0)]
            if len(held) >= BLOCK:
                yield flush()
        if held:
            yield flush()

    return single.select("label", "vec").mapInArrow(
        run, "label string, dim int, n long, total array<double>")


def _label_plans(single: DataFrame, threshold: float, window: int, recall: float) -> DataFrame:
    """(label, dim, centre, window, passes): a row for each label and vector size."""
    sums = written(_sums(single), "label-sums")
    n = sums.groupBy("label", "dim").agg(F.sum("n").alias("n"))
    centre = (sums.select("label", "dim", F.posexplode("total").alias("at", "x"))
              .groupBy("label", "dim", "at").agg(F.sum("x").alias("x"))
              .groupBy("label", "dim").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("s")))
    # the order of a sum must not move a vector to another side
    both = n.join(centre, ["label", "dim"]).select(
        "label", "dim", "n", F.transform("s", lambda e: F.round(e["x"] / F.col("n"), 9)).alias("centre"))
    square = F.aggregate("centre", F.lit(0.0), lambda a, x: a + x * x)
    # the mean cosine of two different vectors of the label
    both = both.withColumn("crowd", F.greatest(
        F.lit(0.0), (square * F.col("n") - 1) / F.greatest(F.col("n") - 1, F.lit(1))))
    left = F.when(F.col("crowd") < threshold, (F.lit(float(threshold)) - F.col("crowd"))
                  / (1 - F.col("crowd")))
    both = both.withColumn("cos", F.greatest(F.coalesce(left, F.lit(LEAST)), F.lit(LEAST)))
    ways = []
    for w in (window << k for k in range(DOUBLINGS + 1)):
        passes = passes_for(F.col("n"), F.col("cos"), w, recall)
        reach = F.least(F.lit(float(w)), F.col("n") / 2.0)
        ways.append(F.struct((passes * (1 + reach / BLOCK + reach / COMPARE)).alias("cost"),
                             F.lit(w).alias("window"), passes.alias("passes")))
    return both.withColumn("way", F.array_min(F.array(*ways))).select(
        "label", "dim", "centre", "way.window", "way.passes")


def _keys(vecs: DataFrame, bits: int, seed: int) -> DataFrame:
    """vecs (row, label, vec, centre, passes) -> (pass, label, dim, key, row): a row for each
    vector and each of its passes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                part = b.slice(lo, BLOCK)
                sizes = part.column(2).value_lengths().to_numpy()
                for d in np.unique(sizes):
                    every = part.filter(pa.array(sizes == d))
                    wanted = every.column(4).to_numpy()
                    x = _units(every.column(2)) - _matrix(every.column(3))
                    for k in range(wanted.max()):
                        own = np.flatnonzero(wanted > k)
                        if (k, d) not in planes:
                            planes[k, d] = np.random.default_rng([seed, k, d]).normal(
                                size=(d, bits))
                        side = np.packbits(x[own] @ planes[k, d] > 0, axis=1)
                        take = pa.array(own)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(own), k), pa.int32()),
                             every.column(1).take(take), pa.array(np.full(len(own), d), pa.int32()),
                             pa.array([r.tobytes() for r in side], pa.binary()),
                             every.column(0).take(take)],
                            names=["pass", "label", "dim", "key", "row"])

    return vecs.select("row", "label", "vec", "centre", "passes").mapInArrow(
        run, "pass int, label string, dim int, key binary, row long")


def _windows(order: DataFrame, single: DataFrame, plans: DataFrame, threshold: float) -> DataFrame:
    """order (pass, label, dim, row, idx) -> (a, b) links between neighbours.  A row goes to its
    own block and to those that its window reaches within its label and pass, so no border
    hides a pair; vectors travel only here.  A block gives the links that connect its rows, at
    most one for each row."""
    group = ["pass", "label", "dim"]
    ends = written(order.groupBy(*group).agg(F.max("idx").alias("end"))
                   .join(plans.select("label", "dim", "window"), ["label", "dim"]), "label-ends")
    block = F.col("idx") - F.col("idx") % BLOCK
    after = F.least(F.col("idx") + F.col("window"), F.col("end"))
    sent = (order.join(ends, group).join(single.select("row", "vec"), "row")
            .withColumn("block", F.explode(F.sequence(
                block, after - after % BLOCK, F.lit(BLOCK).cast("long"))))
            .select("block", "idx", "row", *group, "window", "vec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for t in _groups(batches, "block"):
            rows, idx, dim, window = (t[c].combine_chunks().to_numpy()
                                      for c in ("row", "idx", "dim", "window"))
            first = t["block"][0].as_py()
            same = [t[c].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
                    for c in ("pass", "label")]
            group = same[0] * (same[1].max() + 1) + same[1]
            vec = t["vec"].combine_chunks()
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                x, place, g, w = _units(vec.take(pa.array(at))), idx[at], group[at], window[at]
                # where the label and pass of each row begin
                new = np.concatenate([[True], g[1:] != g[:-1]])
                start = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
                a, b = [], []
                for lo in range(int(np.searchsorted(place, first)), len(at), STEP):
                    hi = min(lo + STEP, len(at))
                    low = int(np.maximum(start[lo:hi], np.searchsorted(
                        place, place[lo:hi] - w[lo:hi])).min())
                    i, j = np.nonzero(x[lo:hi] @ x[low:hi].T >= threshold)
                    i, j = i + lo, j + low
                    gap = place[i] - place[j]
                    hit = (gap > 0) & (gap <= w[i]) & (g[i] == g[j])
                    a.append(j[hit])
                    b.append(i[hit])
                if a:
                    root = _connect(len(at), np.concatenate(a), np.concatenate(b))
                    tied = np.flatnonzero(root != np.arange(len(at)))
                    if len(tied):
                        yield out(schema, rows[at[root[tied]]], rows[at[tied]])

    return (sent.repartition("block").sortWithinPartitions("block", "idx")
            .mapInArrow(run, "a long, b long"))


def _connect(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of 0..n-1 that each is connected with by the links a-b."""
    root = np.arange(n)
    while True:
        u, v = root[a], root[b]
        open_ = u != v
        if not open_.any():
            return root
        a, b, u, v = a[open_], b[open_], u[open_], v[open_]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (up := root[root]).tolist() != root.tolist():
            root = up


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of equal ``key`` from batches sorted by it; one group in memory."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(keys)]):
            if held and keys[lo] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = keys[lo]
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _links(members: DataFrame, threshold: float) -> DataFrame:
    """members (root, row, vec, n) -> (row, links): exact counts of the linked vectors inside
    each component, ``n`` copies each and without the own ones, as partial sums of block
    pairs; no pair is ever a row."""
    sizes = members.groupBy("root").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("nb"))
    # a block meets every block of its component; many small components share a task
    m = (members.join(sizes, "root")
         .withColumn("own", F.pmod(F.xxhash64("row"), F.col("nb")).cast("int"))
         .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
         .select("root", "row", "vec", "n", "own", F.least("own", "other").alias("i"),
                 F.greatest("own", "other").alias("j")))
    m = m.withColumn("pair", F.xxhash64("root", "i", "j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("row", pa.int64()), ("links", pa.int64())])
        for t in _groups(batches, "pair"):
            root, rows, n, own, i, j = (t[c].combine_chunks().to_numpy()
                                        for c in ("root", "row", "n", "own", "i", "j"))
            vec = t["vec"].combine_chunks()
            for key in sorted(set(zip(root.tolist(), i.tolist(), j.tolist()))):
                at = np.flatnonzero((root == key[0]) & (i == key[1]) & (j == key[2]))
                if key[1] == key[2]:
                    x = _units(vec.take(pa.array(at)))
                    yield out(schema, rows[at], _count(x, x, n[at], threshold, True))
                else:
                    a, b = at[own[at] == key[1]], at[own[at] == key[2]]
                    x, y = _units(vec.take(pa.array(a))), _units(vec.take(pa.array(b)))
                    if len(a) and len(b):
                        yield out(schema, rows[a], _count(x, y, n[b], threshold))
                        yield out(schema, rows[b], _count(y, x, n[a], threshold))

    return (m.repartition("pair").sortWithinPartitions("pair").mapInArrow(run, "row long, links long")
            .groupBy("row").agg(F.sum("links").alias("links")))


def _count(x: np.ndarray, y: np.ndarray, copies: np.ndarray, threshold: float,
           itself: bool = False) -> np.ndarray:
    """For each of x the copies of those of y that link; ``itself``: x is y, none with itself."""
    n = np.zeros(len(x), np.int64)
    for lo in range(0, len(x), 256):
        hit = x[lo:lo + 256] @ y.T >= threshold
        if itself:
            hit[np.arange(len(hit)), lo + np.arange(len(hit))] = False
        n[lo:lo + 256] = np.where(hit, copies, 0).sum(axis=1)
    return n


def near_dedup(df: DataFrame, id_col: str, vec_col: str, label_col: str,
               threshold: float = 0.93, recall: float = RECALL, bits: int = BITS,
               window: int = WINDOW, seed: int = 17) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    ``window`` is the narrowest neighbour window (see the module text).  Vectors are
    compared when labels are equal and not null and sizes are equal, over all their
    components however many.
    Null, empty, zero and non-finite vectors link with nothing.  Repeated rows
    (also of one id) are vectors of their own and link with each other.
    component_id is the smallest id reachable by links, kept whether it is the
    row's own; null ids are never the smallest unless all are null.  An empty
    table gives no rows; other columns are ignored."""
    vecs = written(vectors(df, id_col, vec_col, label_col), "vectors")
    usable = vecs.filter("vec is not null")
    copies = usable.groupBy("same").agg(F.min("row").alias("row"), F.min("id").alias("low"),
                                        F.count(F.lit(1)).alias("n"))
    # one vector for each group of equal ones, known by its first row
    single = written(usable.select("row", "label", "vec").join(copies, "row"), "distinct-vectors")
    plans = written(_label_plans(single, threshold, window, recall), "label-plans")
    sized = single.select("row", "label", "vec", F.size("vec").alias("dim")).join(plans, ["label", "dim"])
    order = positions(_keys(sized, bits, seed), ["pass", "label", "dim", "key", "row"]).drop("key")
    comp = components(_windows(order, single, plans, threshold).distinct())
    members = single.join(comp, single.row == comp.node).select("root", "row", "vec", "n", "low")
    low = members.groupBy("root").agg(F.min("low").alias("all_low"))
    links = _links(members.select("root", "row", "vec", "n"), threshold)
    found = comp.join(low, "root").join(links, F.col("node") == F.col("row")).select(
        "node", "all_low", "links")
    groups = (single.select("row", "same", "n", "low")
              .join(found, F.col("row") == F.col("node"), "left")
              .select("same", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
                      F.coalesce("all_low", "low").alias("low")))
    return (vecs.select("id", "same").join(groups, "same", "left")
            .select("id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("low", "id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))))
