"""Numeric column helpers whose results do not depend on row order.

Sums run over decimals, so a re-run after a lost executor adds the same numbers to the same total;
rounding is half-to-even on the double, as NumPy does it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_even(c: Column | str, digits: int) -> Column:
    scale = F.lit(10.0**digits)
    return F.rint(col(c).cast("double") * scale) / scale


def decimal(c: Column | str, scale: int = 2) -> Column:
    return col(c).cast(T.DecimalType(18, scale))


def money(c: Column | str) -> Column:
    """Two-digit amount, rounded half to even."""
    return decimal(half_even(c, 2), 2)


def exact(c: Column | str, digits: int = 6) -> Column:
    """Round to ``digits`` and hold as a decimal, so later sums are exact."""
    return decimal(half_even(c, digits), digits)


def total(c: Column | str, scale: int = 2) -> Column:
    return F.sum(decimal(c, scale)).cast("double")


def mean(c: Column | str, scale: int = 2) -> Column:
    """Mean over the non-null values; null for an empty group."""
    return ratio(total(c, scale), F.count(col(c)))


def rate(predicate: Column) -> Column:
    """Share of rows where the predicate is true; a null predicate counts as false."""
    return ratio(F.count_if(F.coalesce(predicate, F.lit(False))), F.count(F.lit(1)))


def ratio(n: Column, d: Column) -> Column:
    """n / d, null where d is zero or null."""
    return n.cast("double") / F.when(d != 0, d.cast("double"))


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return out


def value_map(c: Column | str, mapping: dict, default=None) -> Column:
    """Dictionary lookup as one searched CASE (null, or ``default``, when absent)."""
    out = None
    for key, value in mapping.items():
        test = col(c) == F.lit(key)
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    return out.otherwise(F.lit(default))
