"""Window-function builders over ``(symbol, ts)``.

``lag`` on a rolling statistic is folded into the frame (``[t-n, t-1]``)
instead of nesting a second window, so a lagged rolling statistic costs one
pass over one sort order.  No frame ends after the current row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from .scalar import col, div

KEYS = ("symbol",)


def ordered(keys: Sequence[str] = KEYS, order: str = "ts") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def trailing(n: int, lag: int = 0, keys: Sequence[str] = KEYS, order: str = "ts") -> WindowSpec:
    """The ``n`` rows ending ``lag`` rows before the current one."""
    return ordered(keys, order).rowsBetween(-(n - 1) - lag, -lag)


def cumulative(keys: Sequence[str] = KEYS, order: str = "ts", lag: int = 0) -> WindowSpec:
    return ordered(keys, order).rowsBetween(Window.unboundedPreceding, -lag)


def cumulative_logs(x: Column | str, keys: Sequence[str] = KEYS, order: str = "ts") -> Column:
    """Running sum of logarithms, whose rounding does not grow with the number of rows.

    Finite logarithms of doubles lie within 746 and are summed as decimals; a double sum of
    a few thousand would lose three digits of ``exp``.  Others (infinite, NaN) keep their effect.
    """
    x, w = col(x), cumulative(keys, order)
    finite = F.abs(x) < F.lit(math.inf)  # NaN is beyond all numbers
    exact = F.sum(F.when(finite, x).otherwise(0.0).cast("decimal(38,18)")).over(w).cast("double")
    return exact + F.sum(F.when(finite, 0.0).otherwise(x)).over(w)


def shift(x: Column | str, k: int = 1, keys: Sequence[str] = KEYS, order: str = "ts") -> Column:
    return F.lag(col(x), k).over(ordered(keys, order))


def roll(
    fn: Callable[[Column], Column],
    x: Column | str,
    n: int,
    min_periods: int | None = None,
    lag: int = 0,
    keys: Sequence[str] = KEYS,
    order: str = "ts",
) -> Column:
    """Rolling aggregate with a minimum number of non-NULL values."""
    x = col(x)
    w = trailing(n, lag, keys, order)
    mp = n if min_periods is None else min_periods
    return F.when(F.count(x).over(w) >= mp, fn(x).over(w))


def pct_change(x: Column | str, n: int = 1, keys: Sequence[str] = KEYS, order: str = "ts") -> Column:
    """Simple ``n``-bar return without filling gaps."""
    return div(x, shift(x, n, keys, order)) - F.lit(1.0)


def diff(x: Column | str, n: int = 1, keys: Sequence[str] = KEYS, order: str = "ts") -> Column:
    return col(x) - shift(x, n, keys, order)


def ffill(
    x: Column | str, limit: int | None = None, keys: Sequence[str] = KEYS, order: str = "ts"
) -> Column:
    """Forward fill, optionally over at most ``limit`` rows."""
    w = cumulative(keys, order) if limit is None else trailing(limit + 1, 0, keys, order)
    return F.last(col(x), ignorenulls=True).over(w)


def decay_of(halflife: float | None = None, span: float | None = None) -> float:
    if (halflife is None) == (span is None):
        raise ValueError("give exactly one of halflife and span")
    return 0.5 ** (1.0 / halflife) if halflife is not None else 1.0 - 2.0 / (span + 1.0)


def true_range(high, low, close, keys: Sequence[str] = KEYS, order: str = "ts") -> Column:
    """max(h-l, |h-prev close|, |l-prev close|); roll it in a later select."""
    prev = shift(close, 1, keys, order)
    return F.greatest(
        col(high) - col(low), F.abs(col(high) - prev), F.abs(col(low) - prev)
    )


def run_length(cond: Column, keys: Sequence[str] = KEYS, order: str = "pos") -> Column:
    """How many consecutive rows up to this one satisfy ``cond``."""
    w = cumulative(keys, order)
    hold = F.coalesce(cond, F.lit(False))
    last_break = F.max(F.when(~hold, F.col(order))).over(w)
    start = F.min(F.col(order)).over(w)
    return F.when(hold, F.col(order) - F.coalesce(last_break, start - 1)).otherwise(0)


def latch(enter: Column, leave: Column, keys: Sequence[str] = KEYS, order: str = "ts") -> Column:
    """1 from the last ``enter`` until the next ``leave`` (disjoint conditions)."""
    mark = F.when(enter, 1).when(leave, 0)
    return F.coalesce(F.last(mark, ignorenulls=True).over(cumulative(keys, order)), F.lit(0))


def rising_edge(cond: Column, keys: Sequence[str] = KEYS, order: str = "ts") -> Column:
    return F.coalesce(cond, F.lit(False)) & ~F.coalesce(shift(cond, 1, keys, order), F.lit(False))
