"""Time-series signals per instrument and their conversion to weights."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ewm import Ewm, ewm
from ..functions.rolling import Roll, rolling
from ..functions.scalar import EPS, clip, col, div, finite, null_mean, positive
from ..functions.window import cumulative, pct_change, shift

XOVER_SPANS = ((8, 24), (16, 48), (32, 96))


def trailing_vol(
    df: DataFrame,
    window: int = 63,
    min_periods: int | None = None,
    lag: int = 1,
    ann: float | None = None,
    ret: str = "ret",
    out: str = "vol",
) -> DataFrame:
    """Lagged rolling population deviation of returns."""
    mp = max(5, window // 3) if min_periods is None else min_periods
    df = rolling(df, [Roll(out, "pstd", ret, window, mp, lag)])
    return df if ann is None else df.withColumn(out, F.col(out) * F.lit(math.sqrt(ann)))


def price_from_returns(ret: Column | str = "ret") -> Column:
    return F.product(F.lit(1.0) + F.coalesce(col(ret), F.lit(0.0))).over(cumulative())


def skip_return(px: Column | str, formation: int, skip: int) -> Column:
    """Return from ``formation`` bars ago to ``skip`` bars ago."""
    if formation <= skip:
        raise ValueError("formation must exceed skip")
    near = shift(px, skip) if skip else col(px)
    return div(near, shift(px, formation)) - 1


def vote(df: DataFrame, parts: list[str], out: str, clamp: float) -> DataFrame:
    """Null-skipping mean of materialised columns, clipped.

    The parts are columns, not expressions: a window function written into an
    expression several times is evaluated as often.
    """
    df = df.withColumn("_vote", null_mean([F.col(p) for p in parts])).drop(*parts)
    return df.withColumn(out, clip("_vote", -clamp, clamp)).drop("_vote")


def sign_ensemble(
    df: DataFrame, px: str = "tr", lookbacks=(21, 63, 252), clamp: float = 1.0, out: str = "signal"
) -> DataFrame:
    """Mean sign of the lookback returns; unavailable lookbacks do not vote."""
    df = df.withColumns({f"_s{n}": F.signum(pct_change(px, n)) for n in lookbacks})
    return vote(df, [f"_s{n}" for n in lookbacks], out, clamp)


def channel_ensemble(
    df: DataFrame,
    px: str = "tr",
    lookbacks=(21, 63, 252),
    clamp: float = 1.0,
    frac: float = 0.5,
    out: str = "signal",
) -> DataFrame:
    """Mean position inside the lagged high-low channel, each clipped to ±1."""
    edges = []
    for n in lookbacks:
        mp = max(2, int(n * frac))
        edges += [Roll(f"_hi{n}", "max", px, n, mp, 1), Roll(f"_lo{n}", "min", px, n, mp, 1)]
    df = rolling(df, edges)
    place = {
        f"_c{n}": div(
            (F.col(px) - F.col(f"_lo{n}")) * 2.0, positive(F.col(f"_hi{n}") - F.col(f"_lo{n}"))
        )
        - 1.0
        for n in lookbacks
    }
    df = df.withColumns(place).drop(*[e.out for e in edges])
    df = df.withColumns({c: clip(c, -1.0, 1.0) for c in place})
    return vote(df, list(place), out, clamp)


def crossover_ensemble(
    df: DataFrame,
    px: str = "tr",
    out: str = "signal",
    spans=XOVER_SPANS,
    clamp: float = 1.0,
    vol_window: int = 63,
    norm_window: int = 252,
    frac: float = 0.5,
) -> DataFrame:
    """EWMA crossovers scaled by lagged price deviation, then by their own."""
    span_set = sorted({s for pair in spans for s in pair})
    df = ewm(df, [Ewm(f"_e{s}", "mean", px, span=s, min_periods=s) for s in span_set])
    k = range(len(spans))
    scale = Roll("_scale", "pstd", px, vol_window, max(3, int(vol_window * frac)), 1)
    df = rolling(df, [scale]).withColumns(
        {
            f"_y{i}": div(F.col(f"_e{f}") - F.col(f"_e{s}"), positive("_scale"))
            for i, (f, s) in enumerate(spans)
        }
    )
    mp = max(10, int(norm_window * frac))
    df = rolling(df, [Roll(f"_d{i}", "pstd", f"_y{i}", norm_window, mp, 1) for i in k])
    df = df.withColumns({f"_p{i}": div(F.col(f"_y{i}"), positive(f"_d{i}")) for i in k})
    df = df.drop("_scale", *[f"_e{s}" for s in span_set], *[f"_{c}{i}" for c in "yd" for i in k])
    return vote(df, [f"_p{i}" for i in k], out, clamp)


def to_weights(
    df: DataFrame,
    target: float = 0.10,
    vol: str | None = "vol",
    ann: float = 252.0,
    max_asset: float = 1.0,
    group: str | None = None,
    group_cap: float | None = None,
    max_gross: float | None = None,
    signal: str = "signal",
    mask: bool = True,
) -> DataFrame:
    """Signal → weight: vol target, clip, mask, group caps, gross cap.

    Cross-section sums share one hash partitioning on ``ts``.
    """
    w = F.col(signal)
    if vol is not None:
        w = w * div(F.lit(target), positive(F.col(vol) * F.lit(math.sqrt(ann))))
    w = clip(F.coalesce(finite(w), F.lit(0.0)), -max_asset, max_asset)
    if mask:
        w = F.when(F.col("in_universe"), w).otherwise(F.lit(0.0))
    df = df.withColumn("w", w)
    if group_cap is None and max_gross is None:
        return df
    df = df.repartition("ts")
    if group is not None and group_cap is not None:
        df = scale_to(df, group_cap, Window.partitionBy("ts", group))
    if max_gross is not None:
        df = scale_to(df, max_gross, Window.partitionBy("ts"))
    return df


def scale_to(df: DataFrame, cap: float, frame) -> DataFrame:
    """Scale weights down pro rata so that their gross in ``frame`` meets ``cap``."""
    gross = F.sum(F.abs("w")).over(frame)
    factor = F.when(gross > EPS, F.least(F.lit(1.0), F.lit(float(cap)) / gross)).otherwise(1.0)
    return df.withColumn("w", F.col("w") * factor)
