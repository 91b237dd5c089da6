"""SentencePiece encoding and decoding through tables of distinct chunks.

When no piece of the vocabulary runs from another character into a white-space
marker, a segmentation never crosses the start of a marked word.  A block of
documents is then cut into marked words, every distinct word is segmented once
into a chunk table, and the ids (and decoded words) are joined back by
position.  A vocabulary without that property is applied to whole texts.

The chunk table belongs to a task, not to the corpus: a corpus-wide table
would need one shuffled row per word occurrence, or a broadcast that grows with
the corpus.  It is emptied when it reaches TABLE_WORDS words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from cataloom.llm.common import out, sub_batches

#: Words a task's chunk table holds before it starts anew (about 250 bytes each).
TABLE_WORDS = 400_000
SPACE = "▁"
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*")


class Codec:
    """Encodes and decodes exactly as the library does with this model."""

    def __init__(self, model_file: str):
        import sentencepiece
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.eos = sp.eos_id()
        probe = "a  b " + SPACE + "c"
        kept = [sp.id_to_piece(i) for i in sp.encode(probe)]
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.lone = sp.piece_to_id(SPACE)
        #: White space is kept as it is and no piece crosses into a marker.
        self.by_chunk = (
            "".join(kept) == SPACE + probe.replace(" ", SPACE)
            and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
            and sp.id_to_piece(self.lone) == SPACE
            and _keeps_characters(sp))
        self.table: dict[str, tuple[list[int], str, str]] = {}

    def _learn(self, words: set[str]) -> None:
        if len(self.table) + len(words) > TABLE_WORDS:
            self.table.clear()
        new = [w for w in words if w not in self.table]
        # The library marks the start of its input, so one marker goes before.
        plain = [w[1:].replace(SPACE, " ") for w in new]
        for w, p, ids in zip(new, plain, self.sp.encode(plain, num_threads=1)):
            ids = ids if p else [self.lone]
            self.table[w] = (ids, " ".join(map(str, ids)), " " + (self.sp.decode(ids) if p else ""))

    def _words(self, text: str) -> list[str]:
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        if SPACE + SPACE in marked or marked.endswith(SPACE):
            return _CHUNK.findall(marked)
        return [SPACE + w for w in marked[1:].split(SPACE)]

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text, with the end id."""
        for words in self._split(texts):
            yield [i for w in words for i in self.table[w][0]] + [self.eos]

    def _split(self, texts: list[str]) -> list[list[str]]:
        split = [self._words(t) for t in texts]
        self._learn({w for words in split for w in words})
        return split

    def rows(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, ids joined by one space, decoded text) of each text."""
        if not self.by_chunk:
            for ids in self.sp.encode(texts, num_threads=1, add_eos=True):
                yield len(ids), " ".join(map(str, ids)), self.sp.decode(ids)
            return
        for words in self._split(texts):
            found = [self.table[w] for w in words]
            ids = [f[1] for f in found] + [str(self.eos)]
            # decode() drops the first marker of its input and no other
            yield (sum(len(f[0]) for f in found) + 1, " ".join(ids),
                   "".join([f[2] for f in found])[1:])


def _keeps_characters(sp) -> bool:
    """No normalisation of characters: control, compatibility and case forms survive."""
    return all(sp.decode(sp.encode(x)) == x
               for x in ("ﬁ", "Á", "　x", "a\tb\nc", "Ａ", "​z", "x\r\ny"))


def encode_documents(df: DataFrame, id_col: str, text_col: str, model_file: str,
                     ids: bool = False) -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256, and with
    ``ids`` also the id list and the decoded text.

    A null or empty text has the end id only and decodes to the empty text.
    White space runs, leading and trailing spaces and literal U+2581 are encoded
    as the library does.  Repeated rows and null ids pass through; other columns
    are ignored; an empty table gives no rows."""
    spark_cols = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    id_type = spark_cols.schema["id"].dataType.simpleString()
    more = ", ids array<int>, decoded string" if ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, schema = None, None
        for batch, texts in sub_batches(batches, "text"):
            codec = codec or Codec(model_file)
            n, a, b, lists, decoded = [], [], [], [], []
            for count, joined, text in codec.rows(texts):
                n.append(count)
                a.append(hashlib.sha256(joined.encode()).hexdigest())
                b.append(hashlib.sha256(text.encode()).hexdigest())
                if ids:
                    lists.append([int(x) for x in joined.split()])
                    decoded.append(text)
            schema = schema or pa.schema(
                [("id", batch.schema.field("id").type), ("n_tokens", pa.int64()),
                 ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
                + [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] * ids)
            yield out(schema, batch.column(0), n, a, b, *([lists, decoded] if ids else []))

    return spark_cols.mapInArrow(
        run, f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
