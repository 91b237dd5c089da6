"""Language identification with interpolated Kneser-Ney character models.

Spark counts the character n-grams of highest order per language over all
training documents; lower orders are continuation counts of those types, as
Kneser-Ney asks.  The probabilities of all languages are stored side by side in
one array sorted by n-gram per order, with the back-off weights of every
context, so one search serves all languages.  The language with the lowest
cross-entropy per character wins.  A model too large to send out stays in Spark:
the same probabilities are tables, joined with the distinct n-grams of the texts.

Rejection is calibrated on all training documents: a text is rejected when it has
no letter, or when its best cross-entropy lies far above what documents of that
language have, allowing for the spread of short texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm.common import out, own_names, range_sums, sub_batches, written

ORDER = 4
UNDETERMINED = "und"
#: Largest broadcast model, in n-grams of the highest order (about 50 bytes each with
#: four languages); beyond it the same model is kept in tables.
MAX_GRAMS = 4_000_000
#: Most n-grams times languages of such a model, which holds a number for each (64 MB; about
#: 200 MB while it is fitted).
MAX_CELLS = 8_000_000
#: Different training texts of each language whose cross-entropy sets its limit of rejection;
#: None: all of them.
CALIBRATION_ROWS: int | None = None
#: A text is rejected above this many standard deviations over the mean, if that is
#: also this many times the mean, with more bits per character over the root of the
#: length for short texts.
REJECT_SIGMA, REJECT_RATIO, REJECT_SHORT = 6.0, 1.5, 10.0
#: Characters that count as independent evidence for the score.
EVIDENCE = 64
PAD, BLANK = 0, 32

_LETTER = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000)
    return _LETTER


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """ORDER-grams (16 bits a character) of the letters and word gaps of the texts, one for
    each character, and the number of grams before each text."""
    pad = "\0" * (ORDER - 1)
    data = pad + pad.join(t.lower().replace("\0", " ") for t in texts)
    cp = np.frombuffer(data.encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(cp > 0xFFFF, 0x8000 | cp & 0x7FFF, cp)
    letter = _letters()[np.minimum(cp, 0xFFFF)]
    if (high := cp > 0xFFFF).any():
        letter[high] = [chr(c).isalpha() for c in cp[high]]
    code = np.where(letter, code, np.where(cp == PAD, PAD, BLANK)).astype(np.uint64)
    gap = code == BLANK  # one blank between words, none at the start
    keep = ~gap
    keep[1:] |= gap[1:] & (code[:-1] != BLANK) & (code[:-1] != PAD)
    code = code[keep]
    gram = code.copy()
    for k in range(1, ORDER):
        gram[k:] |= code[:-k] << np.uint64(16 * k)
    body = np.flatnonzero(code != PAD)
    starts = np.flatnonzero(code == PAD)[ORDER - 2::ORDER - 1]  # last pad of each text
    return gram[body], np.append(np.searchsorted(body, starts), len(body))


def count_grams(train: DataFrame) -> DataFrame:
    """train (lang, text) -> (lang, gram, n) over whole texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
        for b, texts in sub_batches(batches, "text"):
            langs = np.array(b.column(0).to_pylist(), object)
            grams, at = grams_of(texts)
            of = np.repeat(langs, np.diff(at))
            for lang in sorted(set(langs)):
                own, n = np.unique(grams[of == lang], return_counts=True)
                yield out(schema, [lang] * len(own), own.view(np.int64), n)

    return (train.mapInArrow(run, "lang string, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


class Model:
    """Log probabilities (base 2) of all languages in sorted n-gram arrays."""

    def __init__(self, langs: list[str]):
        self.langs = langs
        self.grams: dict[int, np.ndarray] = {}     # order -> sorted n-grams
        self.logp: dict[int, np.ndarray] = {}      # order -> (n-grams, languages)
        self.contexts: dict[int, np.ndarray] = {}  # order -> sorted contexts
        self.backoff: dict[int, np.ndarray] = {}   # order -> (contexts, languages)
        self.floor = 0.0
        self.limits: dict[str, tuple[float, float]] = {}

    @classmethod
    def fit(cls, lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Model:
        """From counts of ORDER-grams per language."""
        model = cls(sorted(set(lang.tolist())))
        of = np.searchsorted(model.langs, lang)
        gram, n = gram.astype(np.int64).view(np.uint64), n.astype(np.float64)
        counts = [(gram[of == k], n[of == k]) for k in range(len(model.langs))]
        levels = {ORDER: counts}
        for order in range(ORDER - 1, 0, -1):  # continuation counts: distinct left neighbours
            cut = np.uint64((1 << 16 * order) - 1)
            levels[order] = [np.unique(g & cut, return_counts=True) for g, _ in levels[order + 1]]
        chars = len(np.unique(np.concatenate([g for g, _ in levels[1]]))) if len(gram) else 0
        model.floor = -math.log2(chars + 1)
        for order in range(1, ORDER + 1):
            model._level(order, levels[order])
        return model

    def _level(self, order: int, counts: list) -> None:
        union = np.unique(np.concatenate([g for g, _ in counts])) if counts else np.zeros(
            0, np.uint64)
        ctx_of = union >> np.uint64(16)
        contexts = np.unique(ctx_of)
        at = np.searchsorted(contexts, ctx_of)
        lower = np.exp2(self.score(order - 1, union & np.uint64((1 << 16 * (order - 1)) - 1)))
        logp = np.zeros((len(union), len(counts)))
        backoff = np.zeros((len(contexts), len(counts)))
        for k, (g, n) in enumerate(counts):
            c = np.zeros(len(union))
            c[np.searchsorted(union, g)] = n
            one, two = (n == 1).sum(), (n == 2).sum()
            d = one / (one + 2 * two) if one and two else 0.5
            total = np.bincount(at, c, len(contexts))
            types = np.bincount(at, c > 0, len(contexts))
            known = total > 0
            gamma = np.where(known, d * types / np.where(known, total, 1), 1.0)
            own = np.maximum(c - d, 0) / np.where(known, total, 1)[at]
            logp[:, k] = np.log2(own + gamma[at] * lower[:, k])
            backoff[:, k] = np.log2(gamma)
        self.grams[order], self.contexts[order] = union, contexts
        self.logp[order], self.backoff[order] = logp.astype(np.float32), backoff.astype(np.float32)

    def score(self, order: int, grams: np.ndarray) -> np.ndarray:
        """(n-grams, languages) log2 probabilities of the last character."""
        if order == 0:
            return np.full((len(grams), len(self.langs)), self.floor, np.float32)
        result = np.zeros((len(grams), len(self.langs)), np.float32)
        at, known = _find(self.grams[order], grams)
        result[known] = self.logp[order][at[known]]
        if not known.all():
            rest = grams[~known]
            lower = self.score(order - 1, rest & np.uint64((1 << 16 * (order - 1)) - 1))
            at, seen = _find(self.contexts[order], rest >> np.uint64(16))
            lower[seen] += self.backoff[order][at[seen]]
            result[~known] = lower
        return result

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) bits per character, and the number of characters."""
        grams, at = grams_of(texts)
        distinct, inverse = np.unique(grams, return_inverse=True)
        scores = self.score(ORDER, distinct)
        n = np.diff(at)
        bits = np.stack([range_sums(scores[inverse, k], at[:-1], at[1:])
                         for k in range(len(self.langs))], axis=1)
        return -bits / np.maximum(n, 1)[:, None], n

    def predict(self, texts: list[str]) -> list[tuple[str, float, float, bool]]:
        """(language, score, bits per character, rejected) of each text."""
        if not self.langs:
            return [(UNDETERMINED, 0.0, 0.0, True)] * len(texts)
        return self.decide(*self.entropies(texts))

    def decide(self, bits: np.ndarray, n: np.ndarray) -> list[tuple[str, float, float, bool]]:
        """As ``predict``, from bits per character (texts, languages) and characters."""
        best = bits.argmin(axis=1)
        gap = (bits - bits.min(axis=1, keepdims=True)) * np.minimum(n, EVIDENCE)[:, None]
        score = 1 / np.exp2(-gap).sum(axis=1)
        rows = []
        for k, s, b, m in zip(best, score, bits.min(axis=1), n):
            if m == 0:
                rows.append((UNDETERMINED, 0.0, 0.0, True))
                continue
            mean, sd = self.limits.get(self.langs[k], (math.inf, 0.0))
            limit = (max(mean + REJECT_SIGMA * sd, mean * REJECT_RATIO)
                     + REJECT_SHORT / math.sqrt(m))
            rows.append((self.langs[k], float(s), float(b), bool(b > limit)))
        return rows


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _lower(gram, order: int):
    """The last ``order`` characters of n-grams."""
    return gram.bitwiseAND(F.lit((1 << 16 * order) - 1))


class TableModel(Model):
    """The model of any number of n-grams: probabilities and back-off weights as tables
    in the shared folder, a row for each n-gram or context with a map by language."""

    def __init__(self, counts: DataFrame):
        """From counts (lang, gram, n) of ORDER-grams."""
        # one row for each language
        super().__init__(sorted(r["lang"] for r in counts.select("lang").distinct().collect()))
        levels = {ORDER: counts}
        for order in range(ORDER - 1, 0, -1):  # continuation counts: distinct left neighbours
            levels[order] = written(
                levels[order + 1].groupBy("lang", _lower(F.col("gram"), order).alias("gram"))
                .agg(F.count(F.lit(1)).alias("n")), "char-grams")
        self.floor = -math.log2(levels[1].select("gram").distinct().count() + 1)
        self.known: dict[int, DataFrame] = {}  # order -> (gram, logp by language)
        self.weight: dict[int, DataFrame] = {}  # order -> (ctx, back-off by language)
        lower = None
        for order in range(1, ORDER + 1):
            lower = self._table(order, levels[order], lower)

    def _table(self, order: int, counts: DataFrame, lower: DataFrame | None) -> DataFrame:
        ctx = F.shiftrightunsigned("gram", 16).alias("ctx")
        one, two = (F.sum((F.col("n") == k).cast("long")) for k in (1, 2))
        d = counts.groupBy("lang").agg(one.alias("one"), two.alias("two")).select(
            "lang", F.when((F.col("one") > 0) & (F.col("two") > 0),
                           F.col("one") / (F.col("one") + 2 * F.col("two"))).otherwise(0.5)
            .alias("d"))  # one row for each language
        contexts = written(
            counts.groupBy("lang", ctx).agg(F.sum("n").alias("total"),
                                            F.count(F.lit(1)).alias("types"))
            .join(F.broadcast(d), "lang")
            .select("lang", "ctx", "total", "d",
                    (F.col("d") * F.col("types") / F.col("total")).alias("gamma")), "contexts")
        rows = counts.withColumn("ctx", ctx).join(contexts, ["lang", "ctx"])
        if lower is None:
            rows = rows.withColumn("below", F.lit(2.0 ** self.floor))
        else:  # what ends an n-gram of a language is an n-gram of it
            rows = rows.withColumn("end", _lower(F.col("gram"), order - 1)).join(
                lower.select("lang", F.col("gram").alias("end"), F.col("p").alias("below")),
                ["lang", "end"])
        own = F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total")
        probs = written(rows.select("lang", "gram", (own + F.col("gamma") * F.col("below"))
                                    .alias("p")), "probabilities")

        def by_lang(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
            return written(df.groupBy(key).agg(F.map_from_entries(F.collect_list(
                F.struct("lang", F.log2(value)))).alias(name)), name)

        self.known[order] = by_lang(probs, "gram", "p", f"known{order}")
        self.weight[order] = by_lang(contexts, "ctx", "gamma", f"weight{order}")
        return probs

    def judge(self, texts: DataFrame) -> DataFrame:
        """texts (key, text) -> (key, lang_pred, score, bits, rejected), one row for each
        key whose text has letters; texts of a key are equal."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("key", pa.int64()), ("gram", pa.int64()), ("n", pa.int64())])
            for b, own in sub_batches(batches, "text"):
                grams, at = grams_of(own)
                for i, key in enumerate(b.column(0).to_pylist()):
                    g, n = np.unique(grams[at[i]:at[i + 1]], return_counts=True)
                    if len(g):
                        yield out(schema, [key] * len(g), g.view(np.int64), n)

        grams = written(texts.select("key", "text").dropDuplicates(["key"]).mapInArrow(
            run, "key long, gram long, n long"), "text-grams")
        found = grams.select("gram").distinct()
        for order in range(1, ORDER + 1):
            end = F.col("gram") if order == ORDER else _lower(F.col("gram"), order)
            found = (found.withColumn("end", end)
                     .withColumn("ctx", F.shiftrightunsigned("end", 16))
                     .join(self.known[order].withColumnRenamed("gram", "end"), "end", "left")
                     .join(self.weight[order], "ctx", "left").drop("end", "ctx"))

        def score(lang: str):
            below = F.lit(self.floor)
            for order in range(1, ORDER + 1):
                own, gamma = (F.try_element_at(f"{c}{order}", F.lit(lang))
                              for c in ("known", "weight"))
                below = F.coalesce(own, below + F.coalesce(gamma, F.lit(0.0)))
            return below

        scored = written(found.select("gram", F.array(*[score(x) for x in self.langs])
                                      .alias("logp")), "gram-scores")
        sums = (grams.join(scored, "gram").groupBy("key").agg(
            F.sum("n").alias("m"), *[F.sum(F.col("n") * F.col("logp")[k]).alias(f"b{k}")
                                     for k in range(len(self.langs))]))
        sums = sums.select("key", "m", F.array(*[-F.col(f"b{k}") / F.col("m") for k in range(
            len(self.langs))]).alias("bits"))
        plain = Model(self.langs)
        plain.limits = dict(self.limits)

        def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("key", pa.int64()), ("lang_pred", pa.string()),
                                ("score", pa.float64()), ("bits", pa.float64()),
                                ("rejected", pa.bool_())])
            for b in batches:
                if b.num_rows:
                    bits = b.column(2).flatten().to_numpy().reshape(b.num_rows, -1)
                    rows = plain.decide(bits, b.column(1).to_numpy())
                    yield out(schema, b.column(0), *map(list, zip(*rows)))

        return sums.mapInArrow(decide, "key long, lang_pred string, score double, bits double, "
                                       "rejected boolean")


def calibration_sample(train: DataFrame, rows: int) -> DataFrame:
    """train (lang, text) -> about ``rows`` different texts with letters of each language
    (all if there are fewer), chosen by a hash of the text; copies count once."""
    train = (train.filter(F.col("text").rlike(r"\p{L}"))
             .select("lang", "text", F.xxhash64(F.lit("sample"), "text").alias("key")))
    sizes = train.select("lang", "key").distinct().groupBy("lang").agg(
        F.count(F.lit(1)).alias("texts"))  # one row for each language
    spread = 1 << 40
    return (train.join(F.broadcast(sizes), "lang")
            .filter(F.pmod("key", F.lit(spread)) < F.lit(spread) * (F.lit(rows) / F.col("texts")))
            .dropDuplicates(["lang", "key"]).select("lang", "text"))


def calibration(train: DataFrame, model: Model) -> DataFrame:
    """train (lang, text) -> (lang, mean, sd) of the bits per character of the different texts
    with letters of each language.  Every text is scored where it is; copies, which count once,
    are known by a hash, so no text is moved."""
    key = F.struct("lang", F.xxhash64("text").alias("key")).alias("id")
    scored = score_documents(train.select(key, "text"), "id", "text", model)
    own = F.when(F.col("id.lang") == F.col("lang_pred"), F.col("bits"))
    each = (scored.filter(F.col("lang_pred") != UNDETERMINED)
            .select("id.lang", "id.key", "bits", own.alias("own"))
            .groupBy("lang", "key").agg(F.min("bits").alias("bits"), F.min("own").alias("own")))
    # a language none of whose texts is recognised is limited by all of them
    return each.groupBy("lang").agg(
        F.coalesce(F.avg("own"), F.avg("bits")).alias("mean"),
        F.coalesce(F.stddev_pop("own"), F.stddev_pop("bits")).alias("sd"))


def fit(train: DataFrame, lang_col: str, text_col: str, max_grams: int = MAX_GRAMS) -> Model:
    """A model of every non-null language of ``train``; null or empty texts add nothing.
    Without training rows it knows no language and rejects everything.  It has all n-grams;
    with more than ``max_grams`` of them, or ``MAX_CELLS`` n-grams times languages, it is a
    TableModel."""
    train = (train.select(F.col(lang_col).cast("string").alias("lang"),
                          F.col(text_col).alias("text")).filter("lang is not null"))
    counts = written(count_grams(train), "char-grams")
    size = counts.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("gram").alias("grams"),
                      F.countDistinct("lang").alias("langs")).first()
    if size["rows"] > max_grams or size["grams"] * size["langs"] > MAX_CELLS:
        model = TableModel(counts)
    else:
        held = counts.toArrow()  # bounded by max_grams
        model = Model.fit(np.array(held["lang"].to_pylist(), object), held["gram"].to_numpy(),
                          held["n"].to_numpy())
    texts = calibration_sample(train, CALIBRATION_ROWS) if CALIBRATION_ROWS else train
    for r in calibration(texts, model).collect():  # one row for each language
        model.limits[r["lang"]] = (r["mean"], r["sd"])
    return model


def score_documents(df: DataFrame, id_col: str, text_col: str, model: Model) -> DataFrame:
    """One row per input row: id, lang_pred, score, bits, rejected.

    Null, empty and letterless texts are ``und`` with score 0 and rejected.
    Ties go to the alphabetically first language.  Repeated rows and null ids
    pass through; other columns are ignored; an empty table gives no rows."""
    src = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    if isinstance(model, TableModel):
        src = src.withColumn("key", F.xxhash64("text"))
        return src.select("id", "key").join(model.judge(src), "key", "left").select(
            "id", F.coalesce("lang_pred", F.lit(UNDETERMINED)).alias("lang_pred"),
            F.coalesce("score", F.lit(0.0)).alias("score"),
            F.coalesce("bits", F.lit(0.0)).alias("bits"),
            F.coalesce("rejected", F.lit(True)).alias("rejected"))
    sent = df.sparkSession.sparkContext.broadcast(model)
    id_type = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in sub_batches(batches, "text"):
            rows = list(zip(*sent.value.predict(texts)))
            yield out(pa.schema([("id", b.schema.field("id").type), ("lang_pred", pa.string()),
                                 ("score", pa.float64()), ("bits", pa.float64()),
                                 ("rejected", pa.bool_())]), b.column(0), *map(list, rows))

    return src.mapInArrow(
        run, f"id {id_type}, lang_pred string, score double, bits double, rejected boolean")


def keep_identified(df: DataFrame, text_col: str, model: Model) -> DataFrame:
    """The rows of ``df`` the model doesn't reject, all columns unchanged."""
    if isinstance(model, TableModel):
        key, (own,) = F.xxhash64(text_col), own_names(df, "key")
        kept = model.judge(df.select(key.alias("key"), F.col(text_col).alias("text"))).filter(
            "not rejected").select(F.col("key").alias(own))
        return df.withColumn(own, key).join(kept, own, "left_semi").select(*df.columns)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in sub_batches(batches, text_col):
            yield b.filter(pa.array([not r[3] for r in sent.value.predict(texts)]))

    return df.mapInArrow(run, df.schema)
