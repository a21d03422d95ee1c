"""Aggregate and cross-section statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from .scalar import clip, col, div


def section(*keys: str) -> WindowSpec:
    """Cross-section frame: all rows sharing ``keys`` (default the bar date)."""
    return Window.partitionBy(*(keys or ("ts",)))


def xs_rank(x: Column | str, keys: Sequence[str] = ("ts",), pct: bool = False) -> Column:
    """Average-tie rank in the cross-section, 1 = smallest, NULL stays NULL."""
    x = col(x)
    present = x.isNotNull()
    w = Window.partitionBy(*keys, present).orderBy(x)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, present, x))
    r = F.rank().over(w) + (ties - 1) / F.lit(2.0)
    if pct:
        r = div(r, F.count(x).over(Window.partitionBy(*keys, present)))
    return F.when(present, r)


def xs_zscore(
    x: Column | str,
    keys: Sequence[str] = ("ts",),
    min_names: int = 3,
    winsor: float | None = 3.0,
    sample: bool = False,
) -> Column:
    """Cross-sectional z-score; zero spread or too few names gives NULL."""
    x = col(x)
    w = Window.partitionBy(*keys)
    spread = (F.stddev_samp if sample else F.stddev_pop)(x).over(w)
    z = div(x - F.avg(x).over(w), spread)
    z = F.when(F.count(x).over(w) >= min_names, z)
    return z if winsor is None else clip(z, -winsor, winsor)


def correlation(x: Column | str, y: Column | str) -> Column:
    """Aggregate: correlation over rows with both values; NULL without spread."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return div(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def compound_return(r: Column | str) -> Column:
    """Aggregate: compounded simple return, NULL inputs skipped."""
    return F.product(F.lit(1.0) + col(r)) - F.lit(1.0)


def sample_skew(x: Column | str) -> Column:
    """Bias-corrected skewness (needs three values)."""
    n = F.count(col(x)).cast("double")
    return F.when(n > 2, F.skewness(col(x)) * div(F.sqrt(n * (n - 1)), n - 2))


def sample_kurtosis(x: Column | str) -> Column:
    """Bias-corrected excess kurtosis (needs four values)."""
    n = F.count(col(x)).cast("double")
    return F.when(
        n > 3,
        div(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(col(x)) + 6),
    )


def sharpe(r: Column | str, ppy: float = 252.0, rf: float = 0.0) -> Column:
    """Aggregate: annualised mean over annualised deviation."""
    r = col(r)
    sd = F.stddev_samp(r)
    value = div((F.avg(r) - rf / ppy) * ppy, sd * F.sqrt(F.lit(ppy)))
    return F.when((F.count(r) >= 3) & (sd > 0), value)


def sortino(r: Column | str, ppy: float = 252.0) -> Column:
    r = col(r)
    sd = F.stddev_samp(F.when(r < 0, r))
    value = div(F.avg(r) * ppy, sd * F.sqrt(F.lit(ppy)))
    return F.when((F.count(r) >= 3) & (sd > 0), value)


def cagr(r: Column | str, ppy: float = 252.0) -> Column:
    r = col(r)
    total = F.product(F.lit(1.0) + r)
    return F.when(F.count(r) == 0, F.lit(None).cast("double")).otherwise(
        F.when(total <= 0, F.lit(-1.0)).otherwise(
            F.pow(total, div(F.lit(ppy), F.count(r).cast("double"))) - 1.0
        )
    )


def ols_log_slope(y: Column | str, x: Column | str) -> Column:
    """Aggregate: slope of ln(y) on ln(x) with the degenerate cases as NULL."""
    ok = (col(x) > 0) & (col(y) > 0)
    ly, lx = F.when(ok, F.ln(col(y))), F.when(ok, F.ln(col(x)))
    usable = (F.count(ly) >= 3) & (F.stddev_pop(lx) >= 1e-12)
    return F.when(usable, F.regr_slope(ly, lx))


def mean_ratio(y: Column | str, x: Column | str) -> Column:
    ok = (col(x) > 0) & (col(y) > 0)
    ratio = F.when(ok, div(col(y), col(x)))
    return F.when(F.count(ratio) >= 3, F.avg(ratio))


def half_life(slope: Column, n_obs: Column) -> Column:
    """AR(1) half-life in bars from the slope of the change on the level."""
    phi = F.lit(1.0) + slope
    return F.when(n_obs < 10, F.lit(None).cast("double")).otherwise(
        F.when(slope >= -1e-12, F.lit(float("inf")))
        .when(phi <= 0, F.lit(0.0))
        .when(slope.isNotNull(), -F.ln(F.lit(2.0)) / F.ln(phi))
    )
