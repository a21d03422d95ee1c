"""Scalar helpers.  Every missing or non-finite value is NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12
HUGE = 1.0e308  # within the doubles


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: Column | str) -> Column:
    """NaN and infinities become NULL."""
    x = col(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def div(a: Column | str, b: Column | str) -> Column:
    """Division that yields NULL on a zero denominator."""
    return F.try_divide(col(a), col(b))


def clip(x: Column | str, lo: float | None = None, hi: float | None = None) -> Column:
    """Clip that keeps NULL (``greatest``/``least`` skip NULLs)."""
    x = col(x)
    out = x
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(x.isNotNull(), out)


def rnd(x: Column | str, dp: int = 6) -> Column:
    """Round half away from zero for output, in plain double arithmetic.

    ``floor`` would hold the scaled value within a long; ``round`` to no places keeps any double.
    Where the scaled value leaves the doubles, x is whole already.  Adding 0.0 normalises a
    negative zero.
    """
    x = col(x).cast("double")
    scale = 10.0**dp
    return F.when(F.abs(x) > F.lit(HUGE / scale), x).otherwise(F.round(x * F.lit(scale), 0) / F.lit(scale)) + F.lit(0.0)


def positive(x: Column | str, eps: float = EPS) -> Column:
    """The value when it is above ``eps``, else NULL."""
    x = col(x)
    return F.when(x > F.lit(eps), x)


def null_mean(cols: list[Column]) -> Column:
    """Mean over columns that skips NULLs; NULL when all are NULL."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
    votes = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in cols), F.lit(0))
    return div(total, votes.cast("double"))


def as_ts(x: Column | str) -> Column:
    """A date-like column as a zone-free timestamp (the output convention)."""
    return col(x).cast("timestamp_ntz")


def day(x: Column | str) -> Column:
    return col(x).cast("date")
