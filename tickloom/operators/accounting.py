"""Weights → positions → costs → returns → equity.

Two shuffles: per-symbol windows (lag, change), then sums per bar.  The series
per run is short (one row per bar) and is windowed only after aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import div
from ..functions.window import cumulative, shift
from .costs import CostParams, borrow_bps, trade_cost_columns
from .risk import execution_lag

RUN = ("run_id",)
TRADE_TOL = 1e-6
POSITION_TOL = 1e-9


@dataclass
class Book:
    """Accounting tables, all lazy."""

    positions: DataFrame  # run, symbol, ts: w (held), dw, r
    daily: DataFrame  # run, ts: gross, net, costs, nav_prev, equity
    params: CostParams | None
    keys: tuple[str, ...]
    spread_bps: str | None = None

    def costed(self) -> DataFrame:
        """Positions with their costs in basis points."""
        nav = self.daily.select(*self.keys, "ts", "nav_prev", "equity")
        pos = self.positions.join(nav, [*self.keys, "ts"])
        adv = "adv" if "adv" in pos.columns else None
        traded = F.abs("dw") * F.col("nav_prev")
        parts = trade_cost_columns(traded, adv, self.spread_bps, self.params)
        pos = pos.withColumns({f"{k}_bps": v for k, v in parts.items()})
        return pos.withColumns(
            {
                "cost_bps": sum((F.col(f"{k}_bps") for k in parts), F.lit(0.0)),
                "borrow_bps": borrow_bps("w", self.params),
            }
        )


def held_positions(
    weights: DataFrame, lag: int | str = 1, keys: tuple[str, ...] = RUN
) -> DataFrame:
    """Mask, lag and difference the weights; attach the return in force.

    ``weights`` is the dense panel with ``w``, ``in_universe``, ``ret``.
    """
    by = (*keys, "symbol")
    masked = F.when(F.col("in_universe"), F.coalesce("w", F.lit(0.0))).otherwise(F.lit(0.0))
    df = weights.withColumn("w", masked)
    df = df.withColumn("w", execution_lag("w", lag, by))
    r = F.coalesce("delist_ret", "ret") if "delist_ret" in weights.columns else F.col("ret")
    return df.withColumns(
        {
            "dw": F.col("w") - F.coalesce(shift("w", 1, by), F.lit(0.0)),
            "r": F.coalesce(r, F.lit(0.0)),
        }
    )


def run_book(
    weights: DataFrame,
    params: CostParams | None,
    lag: int = 1,
    nav: float = 1.0,
    keys: tuple[str, ...] = RUN,
    spread_bps: str | None = None,
) -> Book:
    """Account a weight table.  ``params=None`` reads cost columns per row
    (constant within a run).

    Costs depend on the equity before each bar, but only through a power of it:
    impact is coef * (|dw| * nav / adv)^e, so nav^e leaves the sum over symbols,
    and the fixed fee is fixed / nav per trade.  One aggregate per bar therefore
    holds everything, and equity enters afterwards on the short run series; the
    positions are not joined back.
    """
    pos = held_positions(weights, lag, keys)

    def p(name: str) -> Column:
        return F.col(name) if params is None else F.lit(float(getattr(params, name)))

    size = F.abs("dw")
    spread = p("half_spread_bps")
    if spread_bps is not None:
        spread = F.coalesce(F.col(spread_bps), spread)
    impact = F.lit(0.0)
    if "adv" in weights.columns:
        impact = F.when(
            (F.col("adv") > 0) & (size > 0),
            size * p("impact_coef_bps") * F.pow(div(size, "adv"), p("impact_exponent")),
        ).otherwise(0.0)
    per_bar = pos.groupBy(*keys, "ts", "pos").agg(
        F.sum(F.col("w") * F.col("r")).alias("gross"),
        F.sum(size * (p("commission_bps") + p("exchange_fee_bps")) / 1e4).alias("_rate"),
        F.sum(F.when(size > 0, p("fixed_per_trade")).otherwise(0.0)).alias("_fixed"),
        F.sum(size * spread / 1e4).alias("spread"),
        F.sum(impact / 1e4).alias("_impact"),
        F.max(p("impact_exponent")).alias("_exponent"),
        F.sum(F.abs("w") * borrow_bps("w", params) / 1e4).alias("borrow"),
    )
    before = F.product(1 + F.col("gross")).over(cumulative(keys, lag=1))
    daily = per_bar.withColumn("nav_prev", F.coalesce(before, F.lit(1.0)) * float(nav)).withColumns(
        {
            "commission": F.col("_rate") + F.coalesce(div("_fixed", "nav_prev"), F.lit(0.0)),
            "impact": F.col("_impact") * F.pow(F.abs("nav_prev"), F.col("_exponent")),
        }
    )
    net = F.col("gross") - F.col("commission") - F.col("spread") - F.col("impact") - F.col("borrow")
    daily = daily.withColumn("net", net).drop("_rate", "_fixed", "_impact", "_exponent")
    equity = F.product(1 + F.col("net")).over(cumulative(keys)) * F.lit(float(nav))
    return Book(pos, daily.withColumn("equity", equity), params, tuple(keys), spread_bps)


def exposure(positions: DataFrame, keys: tuple[str, ...] = RUN) -> DataFrame:
    w = F.coalesce("w", F.lit(0.0))
    return positions.groupBy(*keys, "ts").agg(
        F.sum(F.abs(w)).alias("gross"),
        F.sum(w).alias("net"),
        F.sum(F.greatest(w, F.lit(0.0))).alias("long"),
        F.sum(F.least(w, F.lit(0.0))).alias("short"),
        F.sum(F.when(F.abs(w) > POSITION_TOL, 1).otherwise(0)).cast("double").alias("n_positions"),
    )


def turnover(positions: DataFrame, keys: tuple[str, ...] = RUN) -> DataFrame:
    return positions.groupBy(*keys, "ts").agg((F.sum(F.abs("dw")) * 0.5).alias("turnover"))


def ledger(book: Book) -> DataFrame:
    """One row per weight change, sized on the equity of its bar."""
    notional = F.abs("dw") * F.col("equity")
    return book.costed().filter(F.abs("dw") > TRADE_TOL).select(
        *book.keys,
        "ts",
        "symbol",
        F.signum("dw").cast("long").alias("side"),
        F.when(F.col("close") > 0, div(notional, "close")).alias("qty"),
        F.col("close").alias("price"),
        notional.alias("notional"),
        "cost_bps",
        F.lit("signal").alias("reason"),
        F.lit("").alias("tag"),
        F.lit(None).cast("double").alias("pnl"),
    )


def change_counts(book: Book) -> DataFrame:
    """Weight changes per run, symbol and bar: the ledger's keys without sizes."""
    return book.positions.filter(F.abs("dw") > TRADE_TOL).select(
        *book.keys, "ts", "symbol", F.lit(None).cast("double").alias("pnl")
    )


def benchmark_equity(calendar: DataFrame, bench: DataFrame, nav: float = 1.0) -> DataFrame:
    """Benchmark on the calendar, gaps filled, rebased to its first value.

    One row per bar, so the single ordered window is bounded by the calendar.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    close = F.last("close", ignorenulls=True).over(w)
    first = F.first("close", ignorenulls=True).over(w)
    return calendar.join(bench, "ts", "left").select(
        "ts", "pos", (div(close, first) * float(nav)).alias("bench")
    )


def with_run(df: DataFrame, run_id: str = "run") -> DataFrame:
    return df.withColumn("run_id", F.lit(run_id))
