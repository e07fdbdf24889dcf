"""Null-safe numeric Column helpers, each with its SQL twin.

The SQL twins render the same arithmetic as text, so the oracle queries
(DuckDB) and the Spark plans compute identical doubles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_half_even(x, digits: int = 2) -> Column:
    """numpy-style rounding: rint(x * 10^d) / 10^d on the double value.

    ``F.round`` is half-up and ``F.bround`` rounds the decimal text, neither
    matches binary-float half-even rounding.
    """
    scale = float(10 ** digits)
    if digits == 0:
        return F.rint(_c(x))
    return F.rint(_c(x) * F.lit(scale)) / F.lit(scale)


def round_half_even_sql(expr: str, digits: int = 2) -> str:
    """SQL form of :func:`round_half_even` (half-integers go to even)."""
    scale = f"CAST({10 ** digits} AS DOUBLE)"
    y = f"(({expr}) * {scale})" if digits else f"({expr})"
    r = (f"(CASE WHEN abs({y} - trunc({y})) = 0.5 THEN 2 * round({y} / 2) "
         f"ELSE round({y}) END)")
    return f"({r} / {scale})" if digits else r


def dbl(v: float) -> str:
    """Exact double literal for SQL (string parse is correctly rounded)."""
    return f"CAST('{float(v)!r}' AS DOUBLE)"


def nan_to_null(x) -> Column:
    c = _c(x)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def inf_to_null(x) -> Column:
    c = _c(x)
    return F.when(F.abs(c) == F.lit(float("inf")), F.lit(None)).otherwise(c)


def clip(x, lo: float | None = None, hi: float | None = None) -> Column:
    """Clip that keeps null as null (``least``/``greatest`` skip nulls)."""
    c = _c(x)
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(c.isNull(), F.lit(None)).otherwise(out)


def clip_sql(expr: str, lo: float | None = None, hi: float | None = None) -> str:
    out = f"({expr})"
    if lo is not None:
        out = f"greatest({out}, {dbl(lo)})"
    if hi is not None:
        out = f"least({out}, {dbl(hi)})"
    return f"(CASE WHEN ({expr}) IS NULL THEN NULL ELSE {out} END)"


def money_sum(x) -> Column:
    """Exact sum of a 2-decimal amount, returned as DOUBLE.

    Float sums depend on the order of addition (partitioning); a sum of
    LONG cents does not, so every engine and every partitioning agrees
    (it equals the SQL twin's DECIMAL sum cast to DOUBLE).
    """
    return F.sum(F.round(_c(x) * 100).cast("long")) / 100.0


def money_sum_sql(expr: str) -> str:
    return f"CAST(sum(CAST({expr} AS DECIMAL(18,2))) AS DOUBLE)"


def safe_ratio(num, den) -> Column:
    """num / den, or 0 when the denominator is 0 or null (KPI convention)."""
    n, d = _c(num), _c(den)
    return F.when(d.isNull() | (d == 0), F.lit(0.0)).otherwise(n / d)
