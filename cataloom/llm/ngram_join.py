"""Jaccard join of documents on word n-grams by prefix-tree traversal.

1. ``signatures``: every document's set of n-gram hashes; equal sets form one
   class, so copies cost one row each from here on.
2. Candidates share *links of the order*: pairs of n-grams that are neighbours
   in a set ordered by hash.  Each n-gram that only one of two sets has breaks at
   most two links, so sets of similarity t share at least (2t - 1) |s| - 1 links,
   while texts that share a passage or a few chance n-grams share almost none.
   A global order puts frequent links last (counts of the whole corpus; any order
   gives the same result, this one makes short candidate lists).  The first
   links - needed + k links of both sets then share k, and those prefixes are all
   that is shuffled.  k grows with the size of the set.
3. Classes of compatible sizes that share k prefix links are connected into
   clusters; nothing outside a cluster can reach the threshold.  Links of few
   classes are counted by pair; one of many connects all of them by itself.
   Clusters of more than one block (texts of one long frame, say) are split once
   more, by n-grams in the order of their counts: the smaller set of a pair needs
   a much shorter prefix than the larger, and a list where no set has the n-gram
   in its short prefix connects nothing.  A frame that is not by itself similar
   enough lies behind the short prefixes.
4. Each cluster, cut by size band and into blocks, goes into tries over its
   globally ordered sets.  A set is compared with a whole trie at once: common
   beginnings are counted once for all sets below, and subtrees are pruned when
   the n-grams left cannot reach the threshold, or when all their sets are
   already connected with it.
5. Components of the links found are the result.  Every pair that could link is
   either compared or already connected; no pair is emitted but tree edges.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm.common import mix64, most_frequent, numbers, out, own_names, sub_batches, written
from cataloom.llm.components import components

WORDS = 5
PERCENT = 80
#: Links that are moved to the end of the order: those seen most, up to this
#: many (16 bytes each when broadcast; a bound on an ordering hint only).
FREQUENT = 1 << 20
#: Seen this often, a link is worth moving.
FREQUENT_FROM = 4
#: N-grams per required shared prefix link, the same where large clusters are split by
#: n-grams, and the longest list that is counted by pair.
SHARED_PER, SPLIT_PER, SHORT_LIST = 50, 100, 8
#: Prefix lists of links seen this often are dealt over SALTS tasks.
HOT_FROM, SALTS = 512, 16
#: Prefix links one task looks at together (20 bytes each).
TASK_LINKS = 2_000_000
#: Sets in one trie block, and n-grams in one on average.
BLOCK_SETS, BLOCK_NGRAMS = 256, 1 << 20
BAND_BITS = 7
#: Bytes of each of the two digests of a set.
DIGEST_BYTES = 7
#: Shared n-grams of an edge that needs no count.
SURE = 1 << 40

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BYTE = numbers(256, 101)
_ORDER = numbers(64, 202)
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and the number of words before each text."""
    parts = [t.encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    at = np.flatnonzero(~_WHITE[data])
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    length = np.diff(first, append=len(at))
    place = np.arange(len(at)) - np.repeat(first, length)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(length.max()), _STEP, np.uint64))
        words = mix64(np.add.reduceat(_BYTE[data[at]] * power[place], first)
                      + length.astype(np.uint64))
    borders = np.cumsum([0] + [len(p) + 1 for p in parts])
    return words, np.searchsorted(at[first], borders)


def shingle_sets(texts: list[str], size: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    words, border = word_hashes(texts)
    with np.errstate(over="ignore"):
        grams = np.zeros(max(0, len(words) - size + 1), np.uint64)
        for k in range(size):
            grams += words[k:k + len(grams)] * _ORDER[k]
        grams = mix64(grams)
        for lo, hi in zip(border[:-1], border[1:]):
            if hi - lo >= size:
                yield np.unique(grams[lo:hi - size + 1])
            elif hi > lo:
                own = words[lo:hi] * _ORDER[size:size + hi - lo]
                yield mix64(np.array([own.sum() + np.uint64(hi - lo)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def band(n: int, percent: int = PERCENT) -> int:
    """Sizes of linked sets are in the same or in neighbouring bands."""
    return int(math.log(n) / math.log(100 / percent) + 1e-9) if n else 0


def links_of(grams: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, int]:
    """What candidates must share, in order: hashes of neighbours in the ordered set (the
    n-grams themselves below 70 percent, where links are too few), and at least how many
    of them two sets at the threshold have in common."""
    if percent < 70:
        return grams, -(-percent * len(grams) // 100)
    with np.errstate(over="ignore"):
        links = mix64(grams[:-1] * _ORDER[20] + grams[1:] * _ORDER[21])
    return links, -(-(2 * percent - 100) * len(grams) // 100) - 1


def shared_needed(percent: int = PERCENT, per: int = SHARED_PER) -> list[int]:
    """By size band: how many prefix links a set must share with a partner."""
    return [max(1, int(min((100 / percent) ** b, 1e12) / per)) for b in range(1 << BAND_BITS)]


def class_of(grams: np.ndarray, percent: int = PERCENT, width: int = DIGEST_BYTES,
             clashes: frozenset[int] = frozenset()) -> tuple[int | None, int | None]:
    """The class of a set (its digest and size band) and a second digest that tells apart
    sets of one class; where classes are known to clash, the second digest is the class.
    Nulls for the empty set."""
    if not len(grams):
        return None, None
    digest = hashlib.blake2b(grams.tobytes(), digest_size=2 * DIGEST_BYTES).digest()
    first, second = (int.from_bytes(d, "big")
                     for d in (digest[:width], digest[DIGEST_BYTES:]))
    size = min(band(len(grams), percent), (1 << BAND_BITS) - 1)
    cls = first << BAND_BITS | size
    return (second << BAND_BITS | size if cls in clashes else cls), second


def signatures(docs: DataFrame, size: int, percent: int, width: int = DIGEST_BYTES) -> DataFrame:
    """docs (id, row, text) -> (kind, id, row, cls, n, second): kind 0 has one row per
    document; kind 1 (cls a link, n a count) the links a task saw in more than one class."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        held: list[np.ndarray] = []
        seen: set[int] = set()

        def repeated() -> Iterator[pa.RecordBatch]:
            grams, n = np.unique(np.concatenate(held), return_counts=True)
            grams, n = grams[n > 1].view(np.int64), n[n > 1]
            held.clear()
            zero = np.zeros(len(n), np.int64)
            yield out(schema, zero + 1, pa.nulls(len(n), schema.field("id").type), zero, grams, n,
                      zero)

        for batch, texts in sub_batches(batches, "text"):
            schema = schema or pa.schema(
                [("kind", pa.int32()), ("id", batch.schema.field("id").type),
                 ("row", pa.int64()), ("cls", pa.int64()), ("n", pa.int64()),
                 ("second", pa.int64())])
            cls, n, seconds = [], [], []
            for grams in shingle_sets(texts, size):
                c, second = class_of(grams, percent, width)
                cls.append(c)
                seconds.append(second)
                n.append(len(grams))
                if c is not None and c not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(c)
                    held.append(links_of(grams, percent)[0])
            yield out(schema, np.zeros(len(n), np.int64), batch.column(0), batch.column(1), cls, n,
                      seconds)
            if sum(map(len, held)) > 4_000_000:
                yield from repeated()
        if held:
            yield from repeated()

    return docs.mapInArrow(run, f"kind int, id {id_type}, row long, cls long, n long, second long")


def _clashes(rows: DataFrame) -> frozenset[int]:
    """Classes that hold different sets (of n sets about n * n / 2^57: none below 10^8)."""
    both = rows.filter("cls is not null").groupBy("cls").agg(
        F.min("second").alias("low"), F.max("second").alias("high"))
    return frozenset(r["cls"] for r in both.filter("low <> high").select("cls").collect())


def _ordered(grams: np.ndarray, known: np.ndarray, count: np.ndarray, n: int
             ) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` in the global order (rare ones first), and their counts if known."""
    weight = np.zeros(len(grams), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        weight = np.where(known[at] == grams, count[at], 0)
    first = np.argsort(weight, kind="stable")[:n]
    return grams[first], weight[first]


def _order_hint(counts: DataFrame, name: str):
    """(gram, n) -> broadcast arrays of the most frequent, at most FREQUENT of them."""
    counts = written(counts.groupBy("gram").agg(F.sum("n").alias("n"))
                     .filter(F.col("n") >= FREQUENT_FROM), name)
    top = most_frequent(counts, "n", FREQUENT).toArrow()
    known = top["gram"].to_numpy().view(np.uint64)
    by = np.argsort(known)
    return counts.sparkSession.sparkContext.broadcast((known[by], top["n"].to_numpy()[by]))


def _prefixes(docs: DataFrame, frequent, size: int, percent: int, width: int,
              clashes: frozenset[int]) -> DataFrame:
    """(gram, salt, cls) of the prefix links of every class a task meets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("gram", pa.int64()), ("salt", pa.int32()), ("cls", pa.int64())])
        known, count = frequent.value
        needed = shared_needed(percent)
        seen: set[int] = set()
        for _, texts in sub_batches(batches, "text"):
            grams, salts, classes = [], [], []
            for own in shingle_sets(texts, size):
                c, _ = class_of(own, percent, width, clashes)
                if c is None or c in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(c)
                own, shared = links_of(own, percent)
                n = len(own) - shared + needed[c & ((1 << BAND_BITS) - 1)]
                own, weight = _ordered(own, known, count, n)
                grams.append(own.view(np.int64))
                salts.append(np.where(weight >= HOT_FROM, 1 + (c >> BAND_BITS) % SALTS, 0))
                classes.append(np.full(len(own), c))
            if grams:
                yield out(schema, np.concatenate(grams), np.concatenate(salts),
                          np.concatenate(classes))

    return docs.select("text").mapInArrow(run, "gram long, salt int, cls long")


def _cluster_edges(prefixes: DataFrame, salted: bool, partitions: int) -> DataFrame:
    """(gram, a, b, n): pairs of size-compatible classes with the number of links of short
    lists they share here, and edges (n is SURE) that connect the classes of a long list;
    with ``salted`` also rows (gram, a, null): what each band of a salted list sends on.

    Where prefixes have a column ``low`` (1: also in the shorter prefix that the smaller
    set of a pair needs), only pairs whose smaller set has it count.  Bands of a salted
    list that have none here, but may have one elsewhere, give their edges with n = 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("gram", pa.int64()), ("a", pa.int64()), ("b", pa.int64()),
                            ("n", pa.int64())])
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        gram, cls = (t[c].combine_chunks().to_numpy() for c in ("gram", "cls"))
        one = np.ones(len(cls), np.int32)
        salt = t["salt"].combine_chunks().to_numpy() if salted else one
        low = (t["low"].combine_chunks().to_numpy() if "low" in t.column_names else one) > 0
        bands = cls & ((1 << BAND_BITS) - 1)
        order = np.lexsort((cls, bands, gram))
        gram, cls, bands, salt, low = (x[order] for x in (gram, cls, bands, salt, low))
        new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (cls[1:] != cls[:-1])])
        gram, cls, bands, salt, low = (x[new] for x in (gram, cls, bands, salt, low))
        start = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        size = np.diff(start, append=len(cls))
        long = np.repeat((size > SHORT_LIST) | (salt[start] > 0), size)
        yield from _pairs(schema, *_short_pairs(cls[~long], bands[~long], low[~long],
                                                size[~long[start]]))
        gram, cls, bands, salt, low = (x[long] for x in (gram, cls, bands, salt, low))
        if not len(cls):
            return
        head = np.flatnonzero(np.concatenate(
            [[True], (gram[1:] != gram[:-1]) | (bands[1:] != bands[:-1])]))
        has = np.logical_or.reduceat(low, head)
        # every class of a band with the band's first, and that with the next band's first
        a, b = head[:-1], head[1:]
        near = (gram[a] == gram[b]) & (bands[b] - bands[a] <= 1) & has[:-1]
        length = np.diff(head, append=len(cls))
        star = np.repeat(head, length)
        joined = np.repeat(has | np.concatenate([[False], near]), length)
        yield from _pairs(schema, np.concatenate([cls[star[joined]], cls[a[near]]]),
                          np.concatenate([cls[joined], cls[b[near]]]), SURE)
        if salted:  # dealt by salt: classes of this n-gram may be elsewhere too
            hot = salt[head] > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram[head[hot]]), pa.array(cls[head[hot]]),
                 pa.nulls(int(hot.sum()), pa.int64()), pa.array(has[hot].astype(np.int64))],
                schema=schema)
            wait = np.flatnonzero(~joined & (salt > 0) & (cls[star] != cls))
            yield out(schema, gram[wait], cls[star[wait]], cls[wait], np.zeros(len(wait), np.int64))

    keys = ["gram", "salt"] if salted else ["gram"]
    return prefixes.repartition(partitions, *keys).mapInArrow(
        run, "gram long, a long, b long, n long")


def _short_pairs(cls: np.ndarray, bands: np.ndarray, low: np.ndarray, size: np.ndarray
                 ) -> tuple[np.ndarray, np.ndarray]:
    """All size-compatible pairs of each of the lists laid one after another."""
    of = np.repeat(np.arange(len(size)), size)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at = np.flatnonzero(np.repeat(size > 1, size))
    for gap in range(1, SHORT_LIST):
        at = at[at + gap < len(cls)]
        at = at[of[at] == of[at + gap]]
        apart = bands[at + gap] - bands[at]
        near = at[(apart <= 1) & (low[at] | low[at + gap] & (apart == 0))]
        a.append(np.minimum(cls[near], cls[near + gap]))
        b.append(np.maximum(cls[near], cls[near + gap]))
    return np.concatenate(a), np.concatenate(b)


def _pairs(schema: pa.Schema, a: np.ndarray, b: np.ndarray, sure: int = 0
           ) -> Iterator[pa.RecordBatch]:
    """Distinct pairs without loops, counted unless ``sure``."""
    a, b = a[a != b], b[a != b]
    if not len(a):
        return
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    n = np.full(len(first), sure) if sure else np.diff(first, append=len(a))
    yield out(schema, np.zeros(len(first), np.int64), a[first], b[first], n)


def _band(col: str):
    return F.col(col).bitwiseAND((1 << BAND_BITS) - 1).cast("int")


def _clusters_of(prefixes: DataFrame, needed: list[int], partitions: int, name: str) -> DataFrame:
    """Components (node, root) of the classes that share as many prefix links as their
    sizes ask."""
    edges = written(_cluster_edges(prefixes, True, partitions), name)
    sent = edges.filter("b is null").select("gram", F.col("a").alias("cls"),
                                            F.col("n").alias("low"))
    pairs = edges.filter("b is not null and n > 0").unionByName(
        _cluster_edges(sent, False, partitions))
    if "low" in prefixes.columns:
        live = sent.filter("low > 0").select(
            "gram", F.explode(F.array(_band("cls"), _band("cls") + 1)).alias("band")).distinct()
        wait = edges.filter("b is not null and n = 0").withColumn("band", _band("a"))
        pairs = pairs.unionByName(wait.join(live, ["gram", "band"], "left_semi").select(
            "gram", "a", "b", F.lit(SURE).alias("n")))
    enough = F.element_at(F.array(*map(F.lit, needed)), F.least(_band("a"), _band("b")) + 1)
    return components(pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))
                      .filter(F.col("n") >= enough).select("a", "b"))


def _split(members: DataFrame, size: int, percent: int) -> DataFrame:
    """members (root, band, cls, n, text), clusters of more than a block split by prefixes
    of n-grams; classes that are left alone go."""
    large = written(members.groupBy("root").agg(F.count(F.lit(1)).alias("sets"))
                    .filter(F.col("sets") > BLOCK_SETS), "large-clusters")
    if large.isEmpty():
        return members
    inside = members.join(large, "root")
    # lots of a cluster count together, so a frame shows however many tasks there are
    lots = F.ceil(F.col("sets") / (8 * BLOCK_SETS))
    dealt = inside.repartition("root", F.pmod(F.xxhash64("cls"), lots)).select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("gram", pa.int64()), ("n", pa.int64())])
        held: list[np.ndarray] = []

        def repeated() -> pa.RecordBatch:
            grams, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return out(schema, grams[n > 1].view(np.int64), n[n > 1])

        for _, texts in sub_batches(batches, "text"):
            held.extend(shingle_sets(texts, size))
            if sum(map(len, held)) > 4_000_000:
                yield repeated()
        if held:
            yield repeated()

    frequent = _order_hint(dealt.mapInArrow(count, "gram long, n long"), "frequent-grams")
    needed = shared_needed(percent, SPLIT_PER)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("gram", pa.int64()), ("salt", pa.int32()), ("cls", pa.int64()),
                            ("low", pa.int32())])
        known, counts = frequent.value
        for batch, texts in sub_batches(batches, "text"):
            roots, classes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for root, c, own in zip(roots, classes, shingle_sets(texts, size)):
                k, m = needed[c & ((1 << BAND_BITS) - 1)], len(own)
                # what it shares with a set of its own size or more, and with any
                short = m - -(-2 * percent * m // (100 + percent)) + k
                own, weight = _ordered(own, known, counts, m - -(-percent * m // 100) + k)
                with np.errstate(over="ignore"):
                    own = mix64(own + np.uint64(root))
                rows.append((own.view(np.int64),
                             np.where(weight >= HOT_FROM, 1 + (c >> BAND_BITS) % SALTS, 0),
                             np.full(len(own), c), (np.arange(len(own)) < short).astype(np.int32)))
            yield out(schema, *map(np.concatenate, zip(*rows)))

    total = inside.agg(F.sum("n")).first()[0]
    parts = max(members.sparkSession.sparkContext.defaultParallelism,
                total * (100 - percent) // 100 // TASK_LINKS)
    again = _clusters_of(inside.select("root", "cls", "text").mapInArrow(
        prefixes, "gram long, salt int, cls long, low int"), needed, parts, "split-edges")
    parted = (inside.join(again.withColumnRenamed("root", "part"), F.col("cls") == F.col("node"))
              .select(F.col("part").alias("root"), "band", "cls", "n", "text"))
    return written(members.join(large, "root", "left_anti").unionByName(parted), "members")


class Trie:
    """A path-compressed trie over sorted rank sequences, as flat arrays by level."""

    def __init__(self, seqs: list[np.ndarray], sizes: np.ndarray):
        order = sorted(range(len(seqs)), key=lambda i: seqs[i].astype(">u4").tobytes())
        self.order = np.array(order)  # leaf position -> set
        seqs = [seqs[i] for i in order]
        self.size = sizes[self.order]
        m = len(seqs)
        lcp = [0] * m  # of a sequence with the one before
        for i in range(1, m):
            a, b = seqs[i - 1], seqs[i]
            k = min(len(a), len(b))
            differ = np.flatnonzero(a[:k] != b[:k])
            lcp[i] = int(differ[0]) if len(differ) else k
        # A node holds ranks [start, end) of the sequences first..last; children follow.
        start, end, first, last, child = [], [], [], [], []
        todo = [(0, m - 1, 0, -1)]
        parents = []
        while todo:
            lo, hi, depth, parent = todo.pop()
            stop = min(lcp[lo + 1:hi + 1], default=len(seqs[lo]))
            me = len(start)
            start.append(depth)
            end.append(stop)
            first.append(lo)
            last.append(hi)
            parents.append(parent)
            child.append([])
            if parent >= 0:
                child[parent].append(me)
            if hi > lo:
                cuts = [lo] + [i for i in range(lo + 1, hi + 1) if lcp[i] == stop] + [hi + 1]
                todo.extend((a, b - 1, stop, me) for a, b in zip(cuts, cuts[1:]))
        self.first, self.last = np.array(first), np.array(last)
        self.leaf = self.first == self.last
        length = np.array(end) - np.array(start)
        self.begin = np.concatenate([[0], np.cumsum(length)])
        self.ranks = np.concatenate([seqs[f][s:e] for f, s, e in zip(first, start, end)]
                                    ) if m else np.zeros(0, np.uint32)
        lens = np.array([len(s) for s in seqs])
        depth = np.array(end)
        self.left = np.array([lens[f:l + 1].max() for f, l in zip(first, last)]) - depth
        self.smallest = np.array([self.size[f:l + 1].min() for f, l in zip(first, last)])
        self.biggest = np.array([self.size[f:l + 1].max() for f, l in zip(first, last)])
        self.n_child = np.array([len(c) for c in child])
        self.kids = np.array([k for c in child for k in c], np.int64)
        self.kid_at = np.concatenate([[0], np.cumsum(self.n_child)])

    def matches(self, mask: np.ndarray, count: int, size: int, percent: int, after: int,
                uniform) -> np.ndarray:
        """Leaf positions > ``after`` whose sets reach ``percent`` with the probe.

        mask: the probe's ranks; count: how many it has; size: of its whole set;
        uniform: nodes whose sets are all connected with the probe already."""
        found = []
        nodes = np.zeros(1, np.int64)
        overlap = np.zeros(1, np.int64)
        low, high = -(-percent * size // 100), 100 * size // percent
        while len(nodes):
            keep = ((self.last[nodes] > after) & (self.biggest[nodes] >= low)
                    & (self.smallest[nodes] <= high) & ~uniform[nodes])
            nodes, overlap = nodes[keep], overlap[keep]
            if not len(nodes):
                break
            lo, n = self.begin[nodes], self.begin[nodes + 1] - self.begin[nodes]
            total = int(n.sum())
            if total:
                to = np.cumsum(n)
                at = np.arange(total) + np.repeat(lo - (to - n), n)
                hits = np.concatenate([[0], np.cumsum(mask[self.ranks[at]])])
                overlap = overlap + hits[to] - hits[to - n]
            # what a set below can still have: ranks left in it and in the probe
            most = overlap + np.minimum(self.left[nodes], count - overlap)
            least = np.maximum(self.smallest[nodes], low)
            keep = (100 + percent) * most >= percent * (size + least)
            nodes, overlap = nodes[keep], overlap[keep]
            leaf = self.leaf[nodes]
            ends = nodes[leaf]
            ok = ((100 + percent) * overlap[leaf] >= percent * (size + self.size[self.first[ends]]))
            found.append(self.first[ends[ok]])
            nodes, overlap = nodes[~leaf], overlap[~leaf]
            n = self.n_child[nodes]
            to = np.cumsum(n)
            at = np.arange(int(n.sum())) + np.repeat(self.kid_at[nodes] - (to - n), n)
            nodes, overlap = self.kids[at], np.repeat(overlap, n)
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def trie_links(sets: list[np.ndarray], probes: np.ndarray, targets: np.ndarray,
               percent: int = PERCENT) -> np.ndarray:
    """For sets of n-gram hashes: component labels (indices) from all pairs of a probe and
    a target (boolean masks over the sets) at or above ``percent``."""
    m = len(sets)
    label = np.arange(m)
    sizes = np.array([len(s) for s in sets])
    grams, inverse, count = np.unique(np.concatenate(sets), return_inverse=True,
                                      return_counts=True)
    # one order for all: shared n-grams first, those of one set only cannot overlap
    rank = np.empty(len(grams), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(grams))
    shared = int((count > 1).sum())
    ends = np.cumsum(sizes)
    seqs = []
    for lo, hi in zip(ends - sizes, ends):
        r = rank[inverse[lo:hi]]
        seqs.append(np.sort(r[r < shared]).astype(np.uint32))
    target = np.flatnonzero(targets)
    trie = Trie([seqs[i] for i in target], sizes[target])
    leaf_set = target[trie.order]
    both = probes & targets
    place = np.full(m, -1)
    place[leaf_set] = np.arange(len(leaf_set))
    mask = np.zeros(shared, np.int64)
    first, last = trie.first, trie.last
    for q in np.flatnonzero(probes):
        own = label[leaf_set] != label[q]
        different = np.concatenate([[0], np.cumsum(own)])
        uniform = different[last + 1] == different[first]
        if uniform[0]:
            continue
        mask[seqs[q]] = 1
        # a pair of two probes that are both targets is compared once
        after = -1 if not both.all() else place[q]
        for leaf in trie.matches(mask, len(seqs[q]), int(sizes[q]), percent, after, uniform):
            a, b = label[q], label[leaf_set[leaf]]
            if a != b:
                label[label == max(a, b)] = min(a, b)
        mask[seqs[q]] = 0
    return label


def _cluster_links(members: DataFrame, size: int, percent: int) -> DataFrame:
    """members (root, band, cls, n, text) -> (a, b): edges that connect linked classes."""
    low = F.greatest(F.col("band") - 1, F.lit(0))
    # a set is compared within its band and with the band below
    m = members.withColumn("zone", F.explode(F.array_distinct(F.array("band", low))))
    stats = m.groupBy("root", "zone").agg(
        F.count(F.lit(1)).alias("sets"), F.sum("n").alias("grams"),
        F.min("band").alias("lowest"))
    stats = stats.filter((F.col("sets") > 1) & (F.col("lowest") == F.col("zone"))).select(
        "root", "zone", F.greatest(F.ceil(F.col("sets") / BLOCK_SETS),
                                   F.ceil(F.col("grams") / BLOCK_NGRAMS)).cast("int").alias("nb"))
    # written: the join is planned from its size, and a large cluster is not one task's
    stats = written(stats, "zones")
    m = (m.join(stats, ["root", "zone"])
         .withColumn("own", F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int"))
         .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
         .select("root", "zone", F.least("own", "other").alias("i"),
                 F.greatest("own", "other").alias("j"), "own", "band", "cls", "text"))
    m = m.withColumn("task", F.xxhash64("root", "zone", "i", "j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for key, rows, sets in _clusters(batches, size):
            cls = np.array([r[2] for r in rows])
            own = np.array([r[0] for r in rows])
            in_zone = np.array([r[1] for r in rows]) == key[1]
            left, right = own == key[2], own == key[3]
            if key[2] == key[3]:
                passes = [(in_zone, np.ones(len(rows), bool))]
            else:
                passes = [(left & in_zone, right), (right & in_zone, left)]
            for probes, targets in passes:
                if probes.any() and targets.any():
                    label = trie_links(sets, probes, targets, percent)
                    moved = np.flatnonzero(label != np.arange(len(label)))
                    if len(moved):
                        yield out(schema, cls[label[moved]], cls[moved])

    dealt = m.repartition("task").sortWithinPartitions("task", "root", "zone", "i", "j", "cls")
    return dealt.mapInArrow(run, "a long, b long")


def _clusters(batches: Iterator[pa.RecordBatch], size: int):
    """(key, rows, sets) of each block pair; texts become sets at once, copies one set."""
    now, rows, sets = None, [], []
    for b, texts in sub_batches(batches, "text"):
        keys = list(zip(*(b.column(b.schema.get_field_index(c)).to_pylist()
                          for c in ("root", "zone", "i", "j"))))
        more = list(zip(*(b.column(b.schema.get_field_index(c)).to_pylist()
                          for c in ("own", "band", "cls"))))
        for key, row, grams in zip(keys, more, shingle_sets(texts, size)):
            if key != now:
                if len(rows) > 1:
                    yield now, rows, sets
                now, rows, sets = key, [], []
            if not rows or rows[-1][2] != row[2]:
                rows.append(row)
                sets.append(grams)
    if len(rows) > 1:
        yield now, rows, sets


def ngram_join(df: DataFrame, id_col: str, text_col: str, size: int = WORDS,
               percent: int = PERCENT, digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, cls, root, keep_row, row.

    Words are runs of other than ASCII white space, A-Z lower-cased; a text with
    fewer than ``size`` words is one n-gram; without words (or null) the set is
    empty and links with nothing (cls null, component_id its own id).  Sets link
    when 100 * |A and B| >= percent * |A or B|.  component_id is the smallest
    id reachable; null ids count only where all are null.  Repeated rows and
    ties are members like others; keep_row marks, by ``row`` (a hash of id and
    text), the row of the smallest (id, row) of each component.  Other columns are
    ignored; an empty table gives no rows.  Texts of any length are read whole.  Sets are
    the same where 112 bits of their digests are (``digest_bytes`` of the first narrow the
    class; classes with two second digests are told apart by them)."""
    spark = df.sparkSession
    docs = df.select(df[id_col].alias("id"), df[text_col].alias("text")).select(
        "id", F.xxhash64("id", "text").alias("row"), "text")
    sig = written(signatures(docs, size, percent, digest_bytes), "signatures")
    rows = sig.filter("kind = 0").drop("kind")
    clashes = _clashes(rows)
    if clashes:
        other = F.shiftleft("second", BAND_BITS).bitwiseOR(
            F.col("cls").bitwiseAND((1 << BAND_BITS) - 1))
        rows = rows.withColumn("cls", F.when(F.col("cls").isin(*clashes), other)
                               .otherwise(F.col("cls")))
    frequent = _order_hint(sig.filter("kind = 1").select(F.col("cls").alias("gram"), "n"),
                           "frequent")

    classes = rows.filter("cls is not null").groupBy("cls").agg(
        F.min(F.struct("id", "row")).alias("rep"), F.min("id").alias("low"),
        F.first("n").alias("n"))
    total = rows.agg(F.sum("n")).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism,
                total * 2 * (100 - percent) // 100 // TASK_LINKS)
    clusters = _clusters_of(_prefixes(docs, frequent, size, percent, digest_bytes, clashes),
                            shared_needed(percent), parts, "cluster-edges")

    reps = (clusters.join(classes, F.col("node") == F.col("cls"))
            .select("root", "cls", "n", F.col("rep.row").alias("rep_row")))
    members = (docs.join(reps, F.col("row") == F.col("rep_row")).select(
        "root", _band("cls").alias("band"), "cls", "n", "text"))
    members = _split(written(members, "members"), size, percent)
    links = components(written(_cluster_links(members, size, percent), "links"))
    every = (classes.join(links, F.col("cls") == F.col("node"), "left")
             .select("cls", "rep", "low", F.coalesce("root", "cls").alias("root")))
    lows = every.groupBy("root").agg(F.min("low").alias("component_id"),
                                     F.min("rep").alias("keep"))
    known_classes = written(every.join(lows, "root").select(
        F.col("cls").alias("c"), "root", "component_id", F.col("keep.row").alias("keep")), "classes")
    return (rows.join(known_classes, F.col("cls") == F.col("c"), "left")
            .select("id", F.col("n").alias("n_shingles"),
                    F.coalesce("component_id", "id").alias("component_id"), "cls", "root",
                    "row", F.coalesce(F.col("row") == F.col("keep"),
                                      F.col("cls").isNull()).alias("keep_row")))


def drop_near_copies(df: DataFrame, id_col: str, text_col: str, size: int = WORDS,
                     percent: int = PERCENT) -> DataFrame:
    """All columns of ``df``, one row of each component; rows without words stay.
    Of repeated rows (same id and text) of the kept document any one stays."""
    found = ngram_join(df, id_col, text_col, size, percent)
    gone = written(found.groupBy("row").agg(
        F.max("keep_row").alias("keep"), F.count(F.lit(1)).alias("n"),
        F.max(F.col("cls").isNull()).alias("empty")), "kept-rows")

    row, = own_names(df, "row")

    def rows(which: str) -> DataFrame:
        keys = gone.filter(f"keep and {which}").select(F.col("row").alias(row))
        return df.withColumn(row, F.xxhash64(id_col, text_col)).join(keys, row)

    once = rows("(n = 1 or empty)").select(df.columns)
    if gone.filter("keep and n > 1 and not empty").isEmpty():
        return once
    again = rows("n > 1 and not empty").dropDuplicates([row])
    return once.unionByName(again.select(df.columns))
