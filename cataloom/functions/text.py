"""Column expressions over text: question normalisation, tokens, previews,
names and the per-value text used in chunks.  All are built-in Spark
functions, so they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# Stop words dropped from questions before token presence checks, in the
# reference's order.
STOP_WORDS = (
    "a", "an", "the", "and", "or", "of", "for", "to", "is", "are", "any",
    "there", "be", "in", "on", "at", "with", "without", "do", "does",
    "have", "has", "had", "that", "this", "these", "those", "it", "its",
    "by", "from", "as", "about", "into", "over", "under", "than",
    "then", "so", "such", "if", "whether", "not", "no", "yes", "can",
    "could", "would", "should", "please", "find", "question", "ask",
)
# Minimum token length kept by significant_tokens, and preview length.
MIN_TOKEN_LEN = 3
PREVIEW_CHARS = 200
ELLIPSIS = "…"
# Id pattern of seeded entities: ds_entity_NNN -> entity_NNN.
ENTITY_ID_PATTERN = r"^ds_(entity_\d{3})$"
# ---------------------------------------------------------------------------

# Unicode-aware classes: (?U) makes \s, \w match what JavaScript's /u does.
_NOT_WORD = r"(?U)[^\p{L}\p{N}\s]"
_SPACES = r"(?U)\s+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_punct(c) -> Column:
    """lower-case and turn every char that is not a letter/digit/space into a space."""
    return F.regexp_replace(F.lower(_c(c)), _NOT_WORD, " ")


def normalize_question(c) -> Column:
    """lower; non letter/digit/space -> space; collapse runs of space; trim."""
    return F.trim(F.regexp_replace(strip_punct(c), _SPACES, " "))


def significant_tokens(c, stop=STOP_WORDS, min_len: int = MIN_TOKEN_LEN) -> Column:
    """Tokens of a question without stop words and short words (duplicates kept)."""
    stop_arr = F.array(*[F.lit(w) for w in stop])
    toks = F.split(strip_punct(c), _SPACES)
    return F.filter(toks, lambda x: (F.length(x) >= min_len) & ~F.array_contains(stop_arr, x))


def preview(c, n: int = PREVIEW_CHARS) -> Column:
    """First n characters plus an ellipsis when the text is longer."""
    c = _c(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(ELLIPSIS))).otherwise(c)


def table_name(c) -> Column:
    """Logical name -> physical table name: non-alphanumeric runs -> '_', lower."""
    return F.lower(F.regexp_replace(_c(c), r"[^A-Za-z0-9]+", "_"))


def dataset_id_for(c) -> Column:
    return F.concat(F.lit("ds_"), table_name(c))


def id_to_entity(c) -> Column:
    """ds_entity_NNN -> entity_NNN, anything else -> NULL."""
    return F.nullif(F.regexp_extract(_c(c), ENTITY_ID_PATTERN, 1), F.lit(""))


def iso_millis(c) -> Column:
    """Timestamp as ISO-8601 text with milliseconds and a Z (JavaScript's toISOString)."""
    return F.date_format(_c(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


# Pattern for plain decimal text of a double (enough places for 1e-6 scale).
PLAIN_DOUBLE_PATTERN = "0." + "#" * 24


def plain_double_text(d) -> Column:
    """Double as plain decimal text for exponents -6..20, as JavaScript prints
    numbers: Java's '1.23456789E7' becomes '12345678.9', '1.0E-4' becomes
    '0.0001' (one built-in ``format_number`` with a decimal pattern)."""
    in_range = (F.abs(d) >= F.lit(1e-6)) & (F.abs(d) < F.lit(1e21))
    return F.when(in_range, F.call_function("format_number", d, F.lit(PLAIN_DOUBLE_PATTERN))) \
        .otherwise(d.cast("string"))


def value_text(c, dt: T.DataType) -> Column:
    """Text of one value inside a chunk, chosen by type at plan time.

    Integral doubles below 1e15 print without a fraction (2.0 -> '2');
    decimals keep their scale; timestamps use ISO text; nested values JSON.
    """
    c = _c(c)
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        d = c.cast("double")
        integral = (F.abs(d) < F.lit(1e15)) & (d == F.floor(d))
        # Java switches to exponent text outside [1e-3, 1e7): only those
        # values take the (regex) rewrite, the rest is a plain cast
        sci = (F.abs(d) >= F.lit(1e7)) | (F.abs(d) < F.lit(1e-3))
        return (F.when(integral, d.cast("bigint").cast("string"))
                .when(sci, plain_double_text(d)).otherwise(d.cast("string")))
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return iso_millis(c)
    if isinstance(dt, T.DateType):
        return iso_millis(c.cast("timestamp_ntz"))
    if isinstance(dt, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    if isinstance(dt, T.BooleanType):
        return F.when(c, F.lit("true")).when(~c, F.lit("false"))
    if isinstance(dt, T.BinaryType):
        return F.base64(c)
    return c.cast("string")


def ntz_lit(value) -> Column:
    """A TIMESTAMP_NTZ literal from a Python datetime, built from its text so
    neither the Python process nor the session time zone can shift it."""
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")
