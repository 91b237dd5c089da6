"""Row -> text chunk and row keys (the publish half that runs before embedding).

Column choice happens at plan time from ``df.schema``: the kept columns are a
``select``, so Catalyst prunes the Parquet scan to exactly those columns plus
the key candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cataloom.functions import rules
from cataloom.functions.text import value_text

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's: primary-key candidates in
# probing order (exact lower-case names).
PK_NAMES = ("acct_number", "id", "pk", "uuid", "account_id", "customer_id")
# ---------------------------------------------------------------------------


def kept_columns(columns, include=None, exclude=None, guard: str | None = rules.PUBLISH_PII):
    """Names kept by include/exclude (case-insensitive) and the PII guard."""
    import re
    keep = list(columns)
    if include:
        want = {c.lower() for c in include}
        keep = [c for c in keep if c.lower() in want]
    if exclude:
        drop = {c.lower() for c in exclude}
        keep = [c for c in keep if c.lower() not in drop]
    if guard:
        rx = re.compile(guard, re.IGNORECASE)
        keep = [c for c in keep if not rx.search(c)]
    return keep


def pick_columns(df: DataFrame, include=None, exclude=None,
                 guard: str | None = rules.PUBLISH_PII) -> DataFrame:
    """Keep ``include`` (if given), drop ``exclude``, then drop PII-like names."""
    return df.select(*[F.col(f"`{c}`") for c in kept_columns(df.columns, include, exclude, guard)])


def chunk_text(df: DataFrame, cols=None) -> Column:
    """'name: value' lines joined by newlines, names in binary order, NULL and ''
    values skipped (concat_ws drops NULL parts)."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    names = sorted(cols if cols is not None else fields)
    parts = []
    for n in names:
        v = value_text(F.col(f"`{n}`"), fields[n])
        parts.append(F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"{n}: "), v)))
    if not parts:
        return F.lit("")
    return F.concat_ws("\n", *parts)


def row_to_chunk(df: DataFrame, cols=None, out: str = "text_chunk") -> DataFrame:
    return df.withColumn(out, chunk_text(df, cols))


def row_to_json(df: DataFrame, cols=None, out: str = "text_chunk") -> DataFrame:
    """Whole row as JSON text, NULL fields kept (legacy text form, no PII guard)."""
    names = cols if cols is not None else df.columns
    return df.withColumn(out, F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]),
                                        {"ignoreNullFields": "false"}))


def pk_expr(columns, candidates=PK_NAMES) -> Column:
    """First non-NULL, non-empty candidate key (exact names), as text."""
    present = [c for c in candidates if c in set(columns)]
    if not present:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")) for c in present])


def pick_pk(df: DataFrame, candidates=PK_NAMES, out: str = "pk") -> DataFrame:
    return df.withColumn(out, pk_expr(df.columns, candidates))


def canonical_json(df: DataFrame, cols=None) -> Column:
    names = sorted(cols if cols is not None else df.columns)
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false"})


def hash_pk(df: DataFrame, cols=None, out: str = "pk") -> DataFrame:
    """SHA-256 hex of the row as JSON with sorted keys; equal rows share a key."""
    return df.withColumn(out, F.sha2(canonical_json(df, cols), 256))


def chunk_frame(df: DataFrame, dataset_id: str, include=None, exclude=None,
                guard: str | None = rules.PUBLISH_PII, hash_key: bool = False) -> DataFrame:
    """(dataset_id, pk, text_chunk) of every row: text from the guarded
    columns; key from the unfiltered row's candidates, else the hash of the
    guarded row (``hash_key=True`` always hashes, so no raw key leaks)."""
    kept = kept_columns(df.columns, include, exclude, guard)
    text = chunk_text(df, kept)
    key = F.sha2(canonical_json(df, kept), 256)
    if not hash_key:
        key = F.coalesce(pk_expr(df.columns), key)
    return df.select(F.lit(dataset_id).alias("dataset_id"), key.alias("pk"), text.alias("text_chunk"))
