"""Vector column expressions (Spark 4.1 has no built-in vector distance).

Higher-order functions keep the arithmetic in the JVM; everything is done in
double precision.  A zero vector gives a NULL cosine distance (``try_divide``)
instead of an ANSI division error, and NULLs sort last.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    prod = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0), lambda acc, x: acc + x)


def sq_norm(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def l2_norm(a) -> Column:
    return F.sqrt(sq_norm(a))


def cosine_distance(a, b, a_sq_norm=None, b_sq_norm=None) -> Column:
    """1 - cos(a, b); NULL when either vector has zero length."""
    na = sq_norm(a) if a_sq_norm is None else _c(a_sq_norm)
    nb = sq_norm(b) if b_sq_norm is None else _c(b_sq_norm)
    return F.lit(1.0) - F.try_divide(dot(a, b), F.sqrt(na * nb))


def neg_inner_product(a, b) -> Column:
    """pgvector's <#>: the negative inner product (smaller = closer)."""
    return -dot(a, b)


def distance(metric: str, a, b, **kw) -> Column:
    if metric == "cosine":
        return cosine_distance(a, b, **kw)
    if metric in ("inner", "neg_inner", "ip"):
        return neg_inner_product(a, b)
    raise ValueError(f"unknown metric {metric!r}")


def sanitize_vector(c, digits: int = 6) -> Column:
    """Round each element; NaN, NULL and infinities become 0."""
    def fix(x):
        bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
        return F.when(bad, F.lit(0.0)).otherwise(F.round(x.cast("double"), digits))
    return F.transform(_c(c), fix)


def check_dims(c, dims: int) -> Column:
    """Pass the vector through, or fail the task when its size is not ``dims``."""
    c = _c(c)
    return F.when(F.size(c) == dims, c).otherwise(
        F.raise_error(F.concat(F.lit(f"embedding size must be {dims}, got "),
                               F.size(c).cast("string"))))
