"""Volatility estimates, sizing, caps, lag, overlays."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ewm import Ewm, ewm
from ..functions.rolling import Roll, rolling
from ..functions.scalar import EPS, clip, col, div, finite, positive
from ..functions.window import cumulative, ordered, shift
from .machines import rebalance_band


def ex_ante_vol(
    df: DataFrame,
    ret: str = "ret",
    out: str = "vol",
    method: str = "ewma",
    halflife: float = 20,
    min_periods: int = 20,
    ann: float = 252.0,
    keys: tuple[str, ...] = ("symbol",),
    order: str = "pos",
) -> DataFrame:
    """Annualised volatility known before the bar (lagged one bar)."""
    if method == "ewma":
        squares = df.withColumn("_v", F.col(ret) * F.col(ret))
        df = ewm(squares, [Ewm("_v", "mean", "_v", halflife=halflife, min_periods=min_periods)], keys, order)
        v = F.sqrt("_v")
    elif method == "ewma_std":
        df, v = ewm(df, [Ewm("_v", "std", ret, halflife=halflife, min_periods=min_periods)], keys, order), F.col("_v")
    elif method == "rolling":
        df, v = rolling(df, [Roll("_v", "std", ret, max(2, round(halflife)), min_periods)], keys, order), F.col("_v")
    else:
        raise ValueError(f"unknown method {method!r}")
    df = df.withColumn("_v", v * F.lit(math.sqrt(ann)))
    return df.withColumn(out, F.lag("_v").over(ordered(keys, order))).drop("_v")


def inverse_vol(signal, vol, target: float) -> Column:
    return F.coalesce(finite(col(signal) * div(F.lit(float(target)), positive(vol))), F.lit(0.0))


def portfolio_vol(
    weights: DataFrame,
    mode: str = "returns",
    halflife: float = 20,
    min_periods: int = 20,
    ann: float = 252.0,
) -> DataFrame:
    """Ex-ante portfolio volatility per (run_id, ts).

    ``returns``: volatility of sum(w * r).  ``diagonal``: sqrt(sum (w * vol)^2).
    """
    by = weights.groupBy("run_id", "ts", "pos")
    if mode == "diagonal":
        contrib = F.pow(F.col("w") * F.col("vol"), 2)
        return by.agg(F.sqrt(F.sum(contrib)).alias("pvol"))
    book = by.agg(F.sum(F.col("w") * F.coalesce("ret", F.lit(0.0))).alias("pret"))
    return ex_ante_vol(
        book, "pret", "pvol", "ewma", halflife, min_periods, ann, keys=("run_id",)
    )


def vol_target(
    weights: DataFrame,
    mode: str = "returns",
    target: float = 0.10,
    cap: float = 2.0,
    floor: float = 0.3,
    band: float = 0.15,
    halflife: float = 20,
    min_periods: int = 20,
    ann: float = 252.0,
) -> DataFrame:
    """Scale a book to a volatility target; no estimate yet means no position.

    The scalar has one row per bar, so joining it back needs no shuffle of the
    book when it is small enough to broadcast at run time.
    """
    s = vol_target_scalar(weights, mode, target, cap, floor, band, halflife, min_periods, ann)
    return weights.join(s.select("run_id", "ts", "scalar"), ["run_id", "ts"], "left").withColumn(
        "w", F.col("w") * F.coalesce("scalar", F.lit(0.0))
    )


def vol_target_scalar(
    weights, mode="returns", target=0.10, cap=2.0, floor=0.3, band=0.15, halflife=20, min_periods=20, ann=252.0
) -> DataFrame:
    pv = portfolio_vol(weights, mode, halflife, min_periods, ann)
    raw = clip(div(F.lit(float(target)), positive("pvol")), floor, cap)
    return rebalance_band(pv.withColumn("raw", raw), band=band)


def apply_caps(
    df: DataFrame,
    instrument: float | None = 0.10,
    gross: float | None = 2.0,
    group: str | None = None,
    group_cap: float | None = 0.40,
    keys: tuple[str, ...] = ("ts",),
) -> DataFrame:
    """Clip per instrument, then scale groups, then the total."""
    w = F.coalesce(finite("w"), F.lit(0.0))
    if instrument is not None:
        w = clip(w, -abs(instrument), abs(instrument))
    df = df.withColumn("w", w).repartition(*keys)

    def squeeze(df: DataFrame, cap: float, by: tuple[str, ...], only: Column) -> DataFrame:
        total = F.sum(F.abs("w")).over(Window.partitionBy(*by))
        hot = only & (total > cap + EPS)
        return df.withColumn("w", F.when(hot, F.col("w") * cap / total).otherwise(F.col("w")))

    if group is not None and group_cap is not None:
        df = squeeze(df, abs(group_cap), (*keys, group), F.col(group).isNotNull())
    if gross is not None:
        df = squeeze(df, abs(gross), keys, F.lit(True))
    return df


def execution_lag(w: Column | str = "w", lag: int = 1, keys: tuple[str, ...] = ("symbol",)) -> Column:
    """Weight decided at t is held at t + lag; missing means flat."""
    if lag < 0:
        raise ValueError("lag must be >= 0")
    x = finite(w)
    return F.coalesce(shift(x, lag, keys) if lag else x, F.lit(0.0))


def overlay_scalar(
    weights: DataFrame,
    target=0.10,
    halflife=20,
    cap=2.0,
    floor=0.3,
    band=0.15,
    ann=252.0,
) -> DataFrame:
    """Overlay scalar from the book's own lagged returns, band starting at 1."""
    w1 = F.coalesce(shift("w", 1, ("run_id", "symbol")), F.lit(0.0))
    own = (
        weights.withColumn("_c", w1 * F.coalesce("ret", F.lit(0.0)))
        .groupBy("run_id", "ts", "pos")
        .agg(F.sum("_c").alias("pret"))
    )
    vol = ex_ante_vol(
        own, "pret", "pvol", "ewma", halflife, max(5, halflife // 2), ann, keys=("run_id",)
    )
    # A zero estimate means an unbounded ratio, which the cap then cuts.
    ratio = F.when(F.col("pvol") > 0, F.lit(float(target)) / F.col("pvol")).when(
        F.col("pvol") == 0, F.lit(float(cap))
    )
    return rebalance_band(vol.withColumn("raw", clip(ratio, floor, cap)), band=band, start=1.0)


def vol_overlay(weights: DataFrame, **params) -> DataFrame:
    s = overlay_scalar(weights, **params).select("run_id", "ts", "scalar")
    return weights.join(s, ["run_id", "ts"]).withColumn("w", F.col("w") * F.col("scalar"))


def compose(sleeves: list[DataFrame], k: list[float] | None = None, gross: float | None = None) -> DataFrame:
    """Weighted sum of sleeves ``(symbol, ts, w)``; optional mean-gross rescale."""
    if not sleeves:
        raise ValueError("no sleeves")
    k = k or [1.0 / len(sleeves)] * len(sleeves)
    if len(k) != len(sleeves):
        raise ValueError("one factor per sleeve")
    parts = [s.select("symbol", "ts", (F.col("w") * f).alias("w")) for s, f in zip(sleeves, k)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    out = union.groupBy("symbol", "ts").agg(F.sum("w").alias("w"))
    if gross:
        per_day = out.groupBy("ts").agg(F.sum(F.abs("w")).alias("g"))
        mean = per_day.agg(F.avg(F.when(F.col("g") != 0, F.col("g")))).scalar()
        out = out.withColumn("w", F.col("w") * F.coalesce(div(F.lit(float(gross)), mean), F.lit(1.0)))
    return out


def running_equity(net: Column | str, keys=("run_id",), order="ts") -> Column:
    return F.product(F.lit(1.0) + col(net)).over(cumulative(keys, order))
