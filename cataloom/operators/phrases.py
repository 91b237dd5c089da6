"""Many phrases searched in one pass over each text.

The bytes of a tile of texts are looked at once for each width of head (8, 4, 2 and 1 bytes,
only those in use): the window at every position is hashed into a bit table of the phrases'
heads, the few windows that pass are looked up exactly, and the whole phrase is compared there.
The head of a phrase is its window with the rarest pair of bytes, so common beginnings cost
nothing.  The work follows the length of the texts and the number of hits, not texts times
phrases.  Patterns with live wildcards are found by their longest literal part and then matched.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cataloom.operators.blocks import Step, block_join

WIDTHS = (8, 4, 2, 1)
TABLE_BITS = 20
# Positions looked at in one go, and rows of hits handed on at once.
POSITIONS = 1 << 20
HIT_ROWS = 2048


def pattern_parts(pattern: str) -> list[list[str | None]]:
    """A LIKE pattern as runs between ``%``; None stands for ``_``."""
    parts, now, chars = [], [], iter(pattern)
    for c in chars:
        if c == "%":
            parts.append(now)
            now = []
        else:
            now.append(None if c == "_" else next(chars, c) if c == "\\" else c)
    return [p for p in parts + [now] if p]


def longest_literal(pattern: str) -> str:
    """The longest text every match of a LIKE pattern contains ('' if there is none)."""
    runs = [""]
    for part in pattern_parts(pattern):
        runs.append("")
        for c in part:
            if c is None:
                runs.append("")
            else:
                runs[-1] += c
    return max(runs, key=lambda r: len(r.encode()))


def pattern_regex(pattern: str) -> re.Pattern:
    """A LIKE pattern inside a text (any text around it).  The first place of each run
    is as good as any other, so no place is tried twice."""
    return re.compile("".join("(?>.*?" + "".join("." if c is None else re.escape(c) for c in part)
                              + ")" for part in pattern_parts(pattern)), re.S)


def _windows(data: np.ndarray, width: int) -> np.ndarray:
    return np.ndarray((max(0, len(data) - width + 1),), f"<u{width}", data, strides=(1,))


class Finder:
    """The phrases of a batch, ready to be searched.  ``sample`` gives the rarity of bytes."""

    def __init__(self, phrases: list[bytes], sample: np.ndarray):
        self.phrases = phrases
        pairs = np.bincount(_windows(sample, 2), minlength=1 << 16)
        by_width = defaultdict(lambda: defaultdict(list))
        self.empty = [i for i, p in enumerate(phrases) if not p]
        for i, p in enumerate(phrases):
            if p:
                w = next(w for w in WIDTHS if w <= len(p))
                b = np.frombuffer(p, np.uint8)
                rare = int(np.argmin(pairs[_windows(b, 2)])) if len(p) > w else 0
                off = min(max(0, rare - w // 2 + 1), len(p) - w)
                by_width[w][int(_windows(b, w)[off])].append((i, off))
        self.heads = {}
        for w, heads in by_width.items():
            values = np.array(sorted(heads), f"<u{w}")
            table = np.zeros(1 << TABLE_BITS, bool)
            table[self._hash(values)] = True
            self.heads[w] = values, table, [heads[int(v)] for v in values]

    @staticmethod
    def _hash(v: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (v.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)

    def find(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(phrase, rows that contain it) in texts ``data[offsets[i]:offsets[i + 1]]``."""
        found = defaultdict(list)
        raw = data.tobytes()
        for w, (values, table, phrases) in self.heads.items():
            view = _windows(data, w)
            for lo in range(0, len(view), POSITIONS):
                at = lo + np.flatnonzero(table[self._hash(view[lo:lo + POSITIONS])])
                seen = view[at]
                head = np.minimum(np.searchsorted(values, seen), len(values) - 1)
                sure = values[head] == seen
                at, head = at[sure], head[sure]
                order = np.argsort(head, kind="stable")
                at, head = at[order], head[order]
                edges = np.flatnonzero(np.r_[True, head[1:] != head[:-1], True]) if len(head) else []
                for a, b in zip(edges, edges[1:]):
                    for i, off in phrases[head[a]]:
                        rows = self._verify(raw, view, w, self.phrases[i], at[a:b] - off, offsets)
                        if len(rows):
                            found[i].append(rows)
        for i, rows in found.items():
            yield i, np.unique(np.concatenate(rows))

    @staticmethod
    def _verify(raw: bytes, view: np.ndarray, w: int, phrase: bytes, start: np.ndarray,
                offsets: np.ndarray) -> np.ndarray:
        """Rows in which the whole phrase stands at one of the places ``start``."""
        size = len(phrase)
        start = start[(start >= 0) & (start + size <= offsets[-1])]
        row = np.searchsorted(offsets, start, side="right") - 1
        inside = start + size <= offsets[row + 1]
        start, row = start[inside], row[inside]
        if len(start) > 32:
            own = _windows(np.frombuffer(phrase, np.uint8), w)
            for o in [*range(0, size - w, w), size - w]:
                same = view[start + o] == own[o]
                if not same.all():
                    start, row = start[same], row[same]
        else:
            same = [raw[s:s + size] == phrase for s in start.tolist()]
            row = row[np.array(same, bool)]
        return np.unique(row)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each row starts and ends; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[at[0]:at[-1]], at - at[0]


class _Match(Step):
    def __init__(self, text: str, phrase: str, wild: str, left_scope: str, scope: str,
                 left_out: list[str], right_out: list[str]):
        self.text, self.phrase, self.wild = text, phrase, wild
        self.left_scope, self.scope = left_scope, scope
        self.left_out, self.right_out = left_out, right_out
        self.finders = {}

    def add(self, key, left, right):
        texts = left.column(self.text)
        data, offsets = _bytes_of(texts)
        if key not in self.finders:
            said = right.column(self.phrase).to_pylist()
            wild = right.column(self.wild).to_pylist()
            literal = [longest_literal(p) if w else p for p, w in zip(said, wild)]
            self.finders[key] = (
                Finder([p.encode() for p in literal], data[:1 << 20]),
                {i: pattern_regex(p) for i, (p, w) in enumerate(zip(said, wild)) if w},
                right.column(self.scope).to_pylist())
        finder, patterns, scopes = self.finders[key]
        home = (np.array(left.column(self.left_scope).to_pylist(), object)
                if any(s is not None for s in scopes) else None)
        # a pattern without a literal may match any text
        every = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False))
        l, r, n = [], [], 0
        for i, rows in [*((i, every) for i in finder.empty if i in patterns),
                        *finder.find(data, offsets)]:
            if scopes[i] is not None:
                rows = rows[home[rows] == scopes[i]]
            if i in patterns:
                rows = np.array([x for x in rows.tolist()
                                 if patterns[i].match(texts[x].as_py())], np.int64)
            l.append(rows)
            r.append(np.full(len(rows), i))
            n += len(rows)
            if n >= HIT_ROWS:
                yield from self.hits(left, right, l, r)
                l, r, n = [], [], 0
        yield from self.hits(left, right, l, r)

    def hits(self, left, right, l, r):
        if not l:
            return
        l, r = np.concatenate(l).astype(np.int64), np.concatenate(r).astype(np.int64)
        for lo in range(0, len(l), HIT_ROWS):
            i, j = pa.array(l[lo:lo + HIT_ROWS]), pa.array(r[lo:lo + HIT_ROWS])
            yield pa.RecordBatch.from_arrays(
                [left.column(c).take(i) for c in self.left_out]
                + [right.column(c).take(j) for c in self.right_out],
                names=self.left_out + self.right_out)


def phrase_join(texts: DataFrame, questions: DataFrame, text: str, phrase: str, wild: str,
                left_scope: str, scope: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """Columns of both frames for each row of ``texts`` whose ``text`` contains the ``phrase``
    (matches it as a LIKE pattern inside, where ``wild``) of a question, byte by byte; a
    question with a ``scope`` looks at rows of that ``left_scope`` only.  An empty literal
    phrase matches nothing.  Columns in ``drop`` are left out."""
    out = [[f for f in df.schema.fields if f.name not in drop] for df in (texts, questions)]
    names = [[f.name for f in side] for side in out]
    return block_join(texts, questions,
                      lambda: _Match(text, phrase, wild, left_scope, scope, *names),
                      T.StructType([T.StructField(f.name, f.dataType) for side in out for f in side]))
