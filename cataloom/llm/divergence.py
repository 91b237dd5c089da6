"""Divergence of the sources of a language by Gustavson row accumulation.

Terms are counted once per task and added up per (language, source, term); a language keeps the
terms of at least ``min_docs`` of its documents.  For the comparison of all sources of a
language the kept counts are dealt over tiles (a block of sources against another, a share of
the terms).  In a tile, each source walks its terms through the term-major index of the other
block and scatters into one dense accumulator over its peers; no pair of postings is ever a row.
A term that one or both sides lack still has a smoothed share (its zero baseline): the
accumulator starts with the sums over baselines, and scattered terms are corrected by what was
assumed for them.  All arithmetic is on whole numbers.

With n occurrences, N in all, and V kept terms: share p = 1 + floor(UNIT (n + 2) / (N + 2 V));
divergence of two shares = floor((p - q)^2 / (p + q)).

Defined results: null texts, languages and sources are ''.  Every (language, source) of a
document is a group, also without text or terms.  Documents count row by row, so repeated rows
count again; other columns are ignored.  Texts of any length are read whole, in pieces cut
between terms.  In a language without kept terms all values are 0 and no term is reported; an
empty table gives no rows.  Equal values are ranked by the bytes of the item.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cataloom.llm.common import out, written

UNIT = 1_000_000_000
#: Different (group, term) entries a task counts before it hands them on.
HELD_TERMS = 400_000
#: Bytes of a text that are split at once.
PIECE = 4 << 20
#: About this many sources are a block, and this many counts a share of the terms.
BLOCK_SOURCES = 256
SHARE_ROWS = 200_000
#: Counts that are indexed at once in a tile.
CHUNK_ROWS = 65_536

#: Bytes of terms: letters a-z (A-Z become these) and all of non-ASCII characters.
_BYTES = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 0x20 if 0x41 <= b <= 0x5A else 0x20
               for b in range(256))

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()),
                     ("n", pa.int64()), ("docs", pa.int64())])
COUNTS = "lang string, source string, term string, n long, docs long"
_SUMS = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()),
                   ("v", pa.int64())])


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, in lists of about ``PIECE`` bytes."""
    lo = 0
    while lo < len(text):
        piece = text[lo:lo + PIECE].translate(_BYTES)
        lo += PIECE
        while lo < len(text) and not piece.endswith(b" "):      # up to the end of the term
            more = text[lo:lo + PIECE].translate(_BYTES)
            end = more.find(b" ")
            piece += more if end < 0 else more[:end + 1]
            lo += len(more) if end < 0 else end + 1
        yield piece.split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def rows():
        for (lang, source), (n, docs) in held.items():
            words = list(n)
            for lo in range(0, len(words), 50_000):
                part = words[lo:lo + 50_000]
                yield out(_COUNTS, [lang] * len(part), [source] * len(part),
                          pa.array(part, pa.binary()).cast(pa.string()),
                          [n[w] for w in part], [docs[w] for w in part])
        held.clear()

    for b in batches:
        langs, sources = b.column(0).to_pylist(), b.column(1).to_pylist()
        text = b.column(2).cast(pa.binary())
        for i, group in enumerate(zip(langs, sources)):
            n, docs = held.setdefault(group, (Counter(), Counter()))
            own: set = set()
            for words in terms_of(text[i].as_py()):
                n.update(words)
                own.update(words)
            docs.update(own)
            if i % 64 == 63 and sum(len(c) for c, _ in held.values()) > HELD_TERMS:
                yield from rows()
        if sum(len(c) for c, _ in held.values()) > HELD_TERMS:
            yield from rows()
    yield from rows()


def share(n, total, kept):
    """The smoothed share of ``n`` of ``total`` occurrences among ``kept`` terms (columns)."""
    top = F.lit(UNIT).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    low = (total + 2 * kept).cast("decimal(20,0)")
    return F.when(kept > 0, F.call_function("div", top, low) + 1).otherwise(F.lit(1)).cast("long")


def divergence(p, q):
    return F.call_function("div", (p - q) * (p - q), p + q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)              # at most (10**9)**2: fits


class _Tile:
    """Sums over the terms of one share for all pairs of two blocks of sources."""

    def __init__(self, key):
        self.lang, self.rows_block, self.cols_block, self.share = key
        self.names: list[str] = []
        self.block, self.zero, self.terms, self.kept = [], [], [], []
        self.acc = None

    def header(self, name, block, zero, terms, kept):
        for held, x in ((self.names, name), (self.block, block), (self.zero, zero),
                        (self.terms, terms), (self.kept, kept)):
            held.append(x)

    def start(self):
        if self.acc is None:
            self.code = {s: i for i, s in enumerate(self.names)}
            self.block, self.zero, self.terms = (np.array(x, np.int64) for x in (
                self.block, self.zero, self.terms))
            self.acc = np.zeros((len(self.names),) * 2, np.int64)
            self.seen: list[Counter] = [Counter() for _ in self.names]

    def add(self, terms: pa.Array, names: pa.Array, p: np.ndarray):
        """Whole terms, in order."""
        self.start()
        d = names.dictionary_encode()
        to = np.array([self.code[s] for s in d.dictionary.to_pylist()], np.int64)
        g = to[d.indices.to_numpy()]
        t = terms.dictionary_encode().indices.to_numpy().astype(np.int64)
        # the term-major index of the block of columns
        col = np.flatnonzero(self.block[g] == self.cols_block)
        col = col[np.argsort(t[col], kind="stable")]
        first = np.searchsorted(t[col], np.arange(t.max() + 2))
        at_g, at_p = g[col], p[col]
        order = np.argsort(g, kind="stable")
        ends = np.searchsorted(g[order], np.arange(len(self.names) + 1))
        for i in range(len(self.names)):
            own = order[ends[i]:ends[i + 1]]
            if not len(own):
                continue
            values, n = np.unique(p[own], return_counts=True)
            self.seen[i].update(dict(zip(values.tolist(), n.tolist())))
            if self.block[i] == self.rows_block:
                self.scatter(i, t[own], p[own], first, at_g, at_p)

    def scatter(self, i, t, p, first, at_g, at_p):
        """One row of Gustavson's product: the terms of source ``i`` through the index."""
        many = first[t + 1] - first[t]
        step = max(1, CHUNK_ROWS * 8 // max(1, int(many.max(initial=1))))
        for lo in range(0, len(t), step):
            m = many[lo:lo + step]
            start = first[t[lo:lo + step]]
            at = np.repeat(start - np.cumsum(m) + m, m) + np.arange(m.sum())
            own, peer, other = np.repeat(p[lo:lo + step], m), at_g[at], at_p[at]
            z, zero = self.zero[i], self.zero[peer]
            value = _f(own, other) - _f(own, zero) - _f(z, other) + _f(z, zero)
            # far below 2**53: added exactly
            self.acc[i] += np.bincount(peer, weights=value.astype(np.float64),
                                       minlength=len(self.names)).astype(np.int64)

    def rows(self) -> pa.RecordBatch:
        self.start()
        row = np.flatnonzero(self.block == self.rows_block)
        col = np.flatnonzero(self.block == self.cols_block)
        total = self.acc[np.ix_(row, col)]
        for k, i in enumerate(row):             # own terms against the baselines of peers
            total[k] += self.baseline(i, self.zero[col])
        for k, j in enumerate(col):
            total[:, k] += self.baseline(j, self.zero[row])
        if self.share == 0:                     # terms that both lack
            both = _f(self.zero[row][:, None], self.zero[col][None, :])
            total += both * (self.kept[0] - self.terms[row][:, None] - self.terms[col][None, :])
        a, b = np.meshgrid(row, col, indexing="ij")
        if self.rows_block == self.cols_block:
            a, b, total = a[a < b], b[a < b], total[a < b]
        a, b = a.ravel().tolist(), b.ravel().tolist()
        return out(_SUMS, [self.lang] * len(a), [self.names[i] for i in a],
                   [self.names[j] for j in b], total.ravel())

    def baseline(self, i: int, zeros: np.ndarray) -> np.ndarray:
        if not self.seen[i]:
            return np.zeros(len(zeros), np.int64)
        p, n = (np.array(x, np.int64) for x in zip(*self.seen[i].items()))
        return (_f(p[:, None], zeros[None, :]) * n[:, None]).sum(axis=0)


def _accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of tile and term, heads (no term) first."""
    tile, key, held = None, None, None

    def flush(table, end):
        """Hand the whole terms of ``table`` to the tile; return what may go on."""
        if table is None or not table.num_rows:
            return None
        cut = table.num_rows
        if not end:
            t = table["term"]
            last = t[cut - 1]
            whole = pa.compute.not_equal(t, last).to_numpy(zero_copy_only=False)
            cut = int(whole.sum())              # terms stand in order
        if cut:
            now = table.slice(0, cut).combine_chunks()
            tile.add(now["term"].combine_chunks(), now["source"].combine_chunks(),
                     now["p"].to_numpy())
        return table.slice(cut)

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        ids = [t[c].to_pylist() for c in ("lang", "t1", "t2", "share")]
        keys = list(zip(*ids))
        edges = [0] + [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)]
        for lo, hi in zip(edges, edges[1:]):
            if keys[lo] != key:
                if tile is not None:
                    flush(held, True)
                    yield tile.rows()
                key, held = keys[lo], None
                tile = _Tile(key)
            part = t.slice(lo, hi - lo)
            heads = part.filter(part["term"].is_null())
            for r in heads.select(["source", "block", "p", "terms", "kept"]).to_pylist():
                tile.header(*r.values())
            part = part.filter(part["term"].is_valid()).select(["term", "source", "p"])
            held = part if held is None else pa.concat_tables([held, part])
            if held.num_rows >= CHUNK_ROWS:
                held = flush(held, False)
    if tile is not None:
        flush(held, True)
        yield tile.rows()


def audit(docs: DataFrame, text_col: str, lang_col: str, source_col: str, min_docs: int = 10,
          top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank), see above.

    Part ``pair``: every other source of the language, value the divergence summed over all
    kept terms.  Part ``term``: the ``top`` terms that the source has with a larger share than
    its language, value their divergence from the language's share."""
    d = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(n) for c, n in
                      ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counts = (d.mapInArrow(_count, COUNTS).repartition("lang", "term")
              .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"),
                                                     F.sum("docs").alias("docs")))
    # the same partitioning serves the sums over a language's sources
    w = Window.partitionBy("lang", "term")
    kept = written(
        counts.withColumn("lang_docs", F.sum("docs").over(w))
        .withColumn("lang_n", F.sum("n").over(w))
        .withColumn("first", (F.col("source") == F.min("source").over(w)).cast("long"))
        .filter(F.col("lang_docs") >= min_docs)
        .select("lang", "source", "term", "n", "lang_n", "first"), "kept-terms")

    of_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"),
                                                   F.count(F.lit(1)).alias("terms"))
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("first").alias("kept"),
                                       F.count(F.lit(1)).alias("rows"))
    sources = d.select("lang", "source").distinct()
    sizes = (sources.groupBy("lang").agg(F.count(F.lit(1)).alias("peers"))
             .join(of_lang, "lang", "left").na.fill(0, ["lang_total", "kept", "rows"]))
    blocks = F.ceil(F.col("peers") / BLOCK_SOURCES)
    sizes = sizes.withColumn("blocks", blocks.cast("int")).withColumn("shares", F.greatest(
        F.lit(1), F.ceil(F.col("rows") * F.least(F.lit(2), F.col("blocks")) / F.col("blocks")
                         / SHARE_ROWS)).cast("int"))
    groups = written(
        sources.join(of_source, ["lang", "source"], "left").na.fill(0, ["total", "terms"])
        .join(sizes, "lang")
        .withColumn("zero", share(F.lit(0), F.col("total"), F.col("kept")))
        .withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")), "groups")
    shares = kept.join(groups, ["lang", "source"]).withColumn(
        "p", share(F.col("n"), F.col("total"), F.col("kept")))

    terms = shares.withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("kept")))
    terms = terms.filter("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        divergence(F.col("p"), F.col("q")).alias("value"))

    null = F.lit(None)
    heads = groups.select("lang", "blocks", "block", null.cast("string").alias("term"), "source",
                          F.col("zero").alias("p"), "terms", "kept",
                          F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    body = shares.select("lang", "blocks", "block", "term", "source", "p",
                         null.cast("long").alias("terms"), null.cast("long").alias("kept"),
                         F.pmod(F.xxhash64("term"), F.col("shares")).cast("int").alias("share"))
    tiles = heads.unionByName(body).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = ["lang", "t1", "t2", "share"]
    sums = (tiles.withColumn("t1", F.least("block", "other"))
            .withColumn("t2", F.greatest("block", "other"))
            .select(*key, "term", "source", "block", "p", "terms", "kept")
            .repartition(*key).sortWithinPartitions(*key, F.asc_nulls_first("term"), "source")
            .mapInArrow(_accumulate, "lang string, a string, b string, v long")
            .groupBy("lang", "a", "b").agg(F.sum("v").alias("value")))
    sums = written(sums, "divergences")          # read once for each direction
    pairs = [sums.select("lang", F.col(x).alias("source"), F.lit("pair").alias("part"),
                         F.col(y).alias("item"), "value") for x, y in ("ab", "ba")]

    def ranked(df):
        by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return df.withColumn("rank", F.row_number().over(by))

    return ranked(pairs[0].unionByName(pairs[1])).unionByName(
        ranked(terms).filter(F.col("rank") <= top))
