"""Split adjustment, total-return index, delisting returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import as_ts, day, div
from ..functions.window import cumulative, cumulative_logs, shift
from .align import snap


def split_adjust(prices: DataFrame, splits: DataFrame, value: str = "close") -> DataFrame:
    """Scale rows strictly before each ex-date by 1/ratio.

    Ratios are first merged per (symbol, ex_date).  Then one union and one
    reverse running product replace the price x split comparison.
    """
    per_day = (
        splits.groupBy("symbol", day("ex_date").alias("_d"))
        .agg(F.product(div(F.lit(1.0), "value")).alias("_f"))
        .select("symbol", as_ts("_d").alias("ts"), "_f", F.lit(0).alias("_k"))
    )
    both = prices.withColumn("_k", F.lit(1)).unionByName(per_day, allowMissingColumns=True)
    # Newest first; at equal times the price row comes before the split row, so
    # a bar on the ex-date itself is not scaled.
    w = (
        Window.partitionBy("symbol")
        .orderBy(F.desc("ts"), F.desc("_k"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        both.withColumn("split_factor", F.coalesce(F.product("_f").over(w), F.lit(1.0)))
        .filter(F.col("_k") == 1)
        .withColumn("adj_" + value, F.col(value) * F.col("split_factor"))
        .drop("_k", "_f")
    )


def dividends_on_bars(dividends: DataFrame, calendar: DataFrame) -> DataFrame:
    """Dividends summed on the first bar on or after the ex-date."""
    daily = dividends.groupBy("symbol", "ex_date").agg(F.sum("value").alias("value"))
    return (
        snap(daily, calendar, "ex_date")
        .filter(F.col("pos_fwd") < F.col("n_bars"))
        .groupBy("symbol", F.col("pos_fwd").alias("pos"))
        .agg(F.sum("value").alias("div"))
    )


def total_return(
    prices: DataFrame, dividends: DataFrame, calendar: DataFrame, adj: str = "adj_close"
) -> DataFrame:
    """Index growing by (price + dividend) / previous price.

    Anchored at the first valid price; bars without a valid factor leave it
    unchanged, bars before the anchor are NULL.
    """
    paid = prices.join(dividends_on_bars(dividends, calendar), ["symbol", "pos"], "left")
    prev = shift(adj)
    factor = div(F.col(adj) + F.coalesce("div", F.lit(0.0)), prev)
    out = paid.withColumn("_lf", F.coalesce(F.ln(F.when(factor > 0, factor)), F.lit(0.0)))
    base = F.first(adj, ignorenulls=True).over(cumulative())
    return out.withColumn("tr", base * F.exp(cumulative_logs("_lf"))).drop("_lf")


def delisting_returns(panel: DataFrame, listings: DataFrame, pct: float = -0.30) -> DataFrame:
    """Override the return on the last bar not after ``listed_to``.

    ``listings`` is the instrument dimension (symbol, listed_to).
    """
    gone = listings.filter(F.col("listed_to").isNotNull()).select(
        "symbol", day("listed_to").alias("_to")
    )
    last = (
        panel.select("symbol", "ts")
        .join(gone, "symbol")
        .filter(day("ts") <= F.col("_to"))
        .groupBy("symbol")
        .agg(F.max("ts").alias("ts"))
        .withColumn("delist_ret", F.lit(float(pct)))
    )
    return panel.join(last, ["symbol", "ts"], "left").withColumn(
        "ret", F.coalesce("delist_ret", "ret")
    )
