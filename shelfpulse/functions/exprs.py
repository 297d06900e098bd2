"""Column-expression helpers that pin down NULL / division / rounding rules.

The reference mixes warehouse SQL and pandas; the two disagree on NULL handling,
division by zero and rounding.  These helpers make each rule explicit so every
operator states which one it follows (SURVEY N1, N2, N8).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_greatest(*cols) -> Column:
    """Warehouse GREATEST: NULL when any argument is NULL (Spark's skips NULLs)."""
    cs = [col_of(c) for c in cols]
    any_null = cs[0].isNull()
    for c in cs[1:]:
        any_null = any_null | c.isNull()
    return F.when(any_null, F.lit(None)).otherwise(F.greatest(*cs))


def null_least(*cols) -> Column:
    """Warehouse LEAST: NULL when any argument is NULL."""
    cs = [col_of(c) for c in cols]
    any_null = cs[0].isNull()
    for c in cs[1:]:
        any_null = any_null | c.isNull()
    return F.when(any_null, F.lit(None)).otherwise(F.least(*cs))


def safe_div(num, den) -> Column:
    """``num / NULLIF(den, 0)``: NULL instead of an ANSI division error."""
    return F.try_divide(col_of(num), col_of(den))


def ratio_or_zero(num, den) -> Column:
    """``CASE WHEN den = 0 THEN 0 ELSE num / den END`` (NULL den stays NULL)."""
    d = col_of(den)
    return F.when(d == 0, F.lit(0.0)).otherwise(F.try_divide(col_of(num), d))


def as_double(c) -> Column:
    return col_of(c).cast("double")


def row_weight(*cols) -> Column:
    """Row weight ``GREATEST(COALESCE(c1, c2, ...), 1)`` with the warehouse NULL rule.

    When every input is NULL the weight is NULL, so the weighted value is NULL
    too (pandas or Spark's GREATEST would give 1).
    """
    c = F.coalesce(*[col_of(x) for x in cols]) if len(cols) > 1 else col_of(cols[0])
    return null_greatest(c, F.lit(1))


def norm_key(c) -> Column:
    """``lower(trim(x))`` key normalisation."""
    return F.lower(F.trim(col_of(c)))


def slug(c) -> Column:
    """``regexp_replace(lower(x), '[^a-z0-9 ]', '')``."""
    return F.regexp_replace(F.lower(col_of(c)), "[^a-z0-9 ]", "")


def coerce_number(c) -> Column:
    """pandas ``to_numeric(errors='coerce')``: unparsable text -> NULL."""
    return col_of(c).try_cast("double")


def sql_round(c, scale: int = 1) -> Column:
    """SQL ROUND: half away from zero."""
    return F.round(col_of(c), scale)


def pandas_round(c, scale: int = 1) -> Column:
    """pandas / numpy round: ``rint(x * 10**scale) / 10**scale``.

    numpy scales the binary double and rounds half to even, so 4.9/4.0
    (1.2250000000000001) gives 1.23; ``bround`` would round the shortest
    decimal text "1.225" to 1.22.  The same steps keep the result identical.
    """
    f = float(10 ** scale)
    return F.rint(col_of(c).cast("double") * f) / f


def is_blank(c) -> Column:
    """NULL or only whitespace."""
    x = col_of(c)
    return x.isNull() | (F.trim(x) == "")


def ceil_to(c, step: int = 5) -> Column:
    """Round up to a multiple of ``step`` (``ceil(x/step)*step``)."""
    return F.ceil(col_of(c) / F.lit(step)) * F.lit(step)


def clip(c, lo, hi) -> Column:
    """Winsorise ``x`` into ``[lo, hi]`` (pandas ``clip``)."""
    return F.greatest(col_of(lo), F.least(col_of(c), col_of(hi)))
