"""Classification rules as column expressions: PII policies, likely-indexed
columns, source-type -> target-type mapping, name-based schema templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
#
# Publish-time PII guard: column names matching this (case-insensitive,
# substring) are never turned into text.
PUBLISH_PII = r"(ssn|social|dob|birth|email|phone|mobile|address|tax|tin|ein|pan)"
# Catalog PII flag (a different, shorter list), applied to lower(column_name).
CATALOG_PII = r"(email|phone|ssn|dob|address)"
# Likely-indexed columns: LIKE '%_id' (underscore is a wildcard) or one of
# these names, or one of the date names below.
INDEXED_KEY_NAMES = ("id", "number")
INDEXED_DATE_NAMES = ("created", "created_at", "updated", "updated_at", "closed_at",
                      "resolved", "due_at", "tran_timestamp")
INDEXED_DATE_NAMES_SHORT = ("created", "created_at", "updated", "updated_at", "closed_at")
# Target type names (already lower case) produced by map_type.
UNKNOWN_TYPE = "i don't know"
STRING_BASES = ("char", "varchar", "clob", "dbclob", "graphic", "vargraphic", "xml")
BINARY_BASES = ("binary", "varbinary", "blob")
# Column templates chosen by a substring of the table name; first match wins.
# Each entry: (substrings, [(column_name, data_type, pii_flag), ...]).
SCHEMA_TEMPLATES = (
    (("orders",), (
        ("order_id", "INTEGER", False), ("customer_id", "INTEGER", False),
        ("order_date", "TIMESTAMP", False), ("total_amount", "DECIMAL(18,2)", False),
        ("notes", "VARCHAR", True))),
    (("customers", "accounts"), (
        ("customer_id", "INTEGER", False), ("email", "VARCHAR", True),
        ("full_name", "VARCHAR", True), ("created_at", "TIMESTAMP", False))),
    (("invoices", "payments", "payroll", "salaries"), (
        ("txn_id", "INTEGER", False), ("amount", "DECIMAL(18,2)", False),
        ("currency", "VARCHAR", False), ("posted_at", "TIMESTAMP", False))),
    (("tickets", "incidents", "issues"), (
        ("ticket_id", "INTEGER", False), ("status", "VARCHAR", False),
        ("priority", "VARCHAR", False), ("opened_at", "TIMESTAMP", False),
        ("requester_email", "VARCHAR", True))),
)
DEFAULT_TEMPLATE = (("id", "INTEGER", False), ("name", "VARCHAR", True),
                    ("updated_at", "TIMESTAMP", False))
# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def publish_pii(name_col) -> Column:
    """True when a column name is dropped by the publish guard."""
    return F.lower(_c(name_col)).rlike(PUBLISH_PII)


def catalog_pii(name_col, pattern: str = CATALOG_PII) -> Column:
    return F.coalesce(F.lower(_c(name_col)).rlike(pattern), F.lit(False))


def indexed(name_col, date_names=INDEXED_DATE_NAMES) -> Column:
    n = _c(name_col)
    hit = n.like("%_id") | n.isin(*INDEXED_KEY_NAMES) | n.isin(*date_names)
    return F.coalesce(hit, F.lit(False))


def map_type(type_col, extended: bool = False) -> Column:
    """Source type text -> target type (lower case); first rule wins."""
    raw = _c(type_col)
    s = F.trim(F.lower(raw))
    compact = F.regexp_replace(s, r"\s+", " ")
    base = F.regexp_replace(s, r"\s*\(.+\)", "")
    e = (F.when(raw.isNull() | (raw == F.lit("—")), F.lit(UNKNOWN_TYPE))
         .when(compact.contains("timestamp with time zone"), F.lit("timestamptz"))
         .when(compact.contains("timestamp"), F.lit("timestamp"))
         .when(compact.isin("date", "ansidate"), F.lit("date"))
         .when(compact.startswith("time2"), F.lit(UNKNOWN_TYPE))
         .when(base.isin("smallint", "integer"), F.lit("integer"))
         .when(base == "bigint", F.lit("long"))
         .when(s.startswith("decimal") & ~s.rlike(r"\d"), F.lit("double"))
         .when(s.startswith("decimal"), F.lit("decimal(38,10)"))
         .when(base == "decfloat", F.lit(UNKNOWN_TYPE))
         .when(base == "real", F.lit("float"))
         .when(base == "double", F.lit("double"))
         .when(base.isin(*STRING_BASES), F.lit("string"))
         .when(base.isin(*BINARY_BASES), F.lit("binary")))
    if extended:
        e = (e.when(base == "boolean", F.lit("boolean"))
              .when(s.startswith("array"), F.lit("array"))
              .when(s.startswith("map"), F.lit("map")))
    return e.otherwise(F.lit(UNKNOWN_TYPE))


def template_id(name_col) -> Column:
    """Index of the schema template chosen for a table name (len = default)."""
    n = _c(name_col)
    e = None
    for i, (subs, _) in enumerate(SCHEMA_TEMPLATES):
        cond = None
        for s in subs:
            cond = n.contains(s) if cond is None else (cond | n.contains(s))
        e = F.when(cond, F.lit(i)) if e is None else e.when(cond, F.lit(i))
    return e.otherwise(F.lit(len(SCHEMA_TEMPLATES)))
