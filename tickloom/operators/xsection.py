"""Cross-sectional fractile weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import EPS, div
from ..functions.stats import xs_zscore
from ..functions.window import cumulative
from .sessions import is_period_end


def fractile_weights(
    df: DataFrame,
    top: float = 0.1,
    bottom: float = 0.1,
    long_only: bool = True,
    sector_neutral: bool = False,
    weighting: str = "equal",
    freq: str = "ME",
    min_names: int = 5,
    gross: float = 1.0,
    drop_out: bool = True,
    signal: str = "signal",
    keys: tuple[str, ...] = (),
) -> DataFrame:
    """Rank → fractile → weights, held until the next rebalance.

    ``df``: dense panel with ``signal``, ``in_universe`` and, when used,
    ``sector`` and ``vol``.  ``keys`` are leading run or cell keys.
    Two shuffles: to the dates for the ranks, back to the symbols for holding.
    """
    if weighting not in ("equal", "inverse_vol", "signal"):
        raise ValueError(f"unknown weighting {weighting!r}")
    keys = tuple(keys)
    valid = F.col(signal).isNotNull() & F.col("in_universe")
    if weighting == "inverse_vol":
        valid = valid & F.coalesce(F.col("vol") > 0, F.lit(False))
    df = df.withColumn("_rb", is_period_end(freq, keys=(*keys, "symbol")))
    # One hash partitioning serves every cross-section window below.
    df = df.repartition(*keys, "ts").withColumn("_in", F.col("_rb") & valid)
    by_date = (*keys, "ts")
    pool = (*by_date, "_in") + (("_sec",) if sector_neutral else ())
    if sector_neutral:
        df = df.withColumn("_sec", F.coalesce("sector", F.lit("__none__")))
    size = F.count(F.lit(1)).over(Window.partitionBy(*pool))
    rank = F.row_number().over(Window.partitionBy(*pool).orderBy(F.desc(signal), "symbol"))
    df = df.withColumns({"_n": size, "_rk": rank})
    n_top = F.least(F.col("_n"), F.greatest(F.lit(1), F.bround(F.col("_n") * top)))
    n_bot = F.lit(0) if long_only else F.greatest(F.lit(1), F.bround(F.col("_n") * bottom))
    n_bot = F.least(n_bot, F.greatest(F.lit(0), F.col("_n") - n_top))
    traded = F.col("_in") & (F.col("_n") >= min_names)
    leg = (
        F.when(traded & (F.col("_rk") <= n_top), 1)
        .when(traded & (F.col("_rk") > F.col("_n") - n_bot), -1)
        .otherwise(0)
    )
    if weighting == "equal":
        raw = F.lit(1.0)
    elif weighting == "inverse_vol":
        raw = div(F.lit(1.0), "vol")
    else:
        member = F.when(F.col("in_universe"), F.col(signal))
        raw = F.greatest(
            F.abs(F.coalesce(xs_zscore(member, by_date, 1, 3.0), F.lit(0.0))), F.lit(1e-6)
        )
    df = df.withColumns({"_leg": leg, "_raw": raw})
    side = Window.partitionBy(*by_date, "_leg")
    total = F.sum("_raw").over(side)
    share = F.when(total > EPS, F.col("_raw") / total).otherwise(
        F.lit(1.0) / F.count(F.lit(1)).over(side)
    )
    two_sided = F.min("_leg").over(Window.partitionBy(*by_date)) < 0
    budget = F.when(F.col("_leg") < 0, -gross / 2).when(two_sided, gross / 2).otherwise(gross)
    chosen = F.when(F.col("_leg") != 0, share * budget).otherwise(F.lit(0.0))
    df = df.withColumn("_w", F.when(F.col("_rb"), chosen))
    return hold(df, "_w", keys, drop_out).drop("_rb", "_in", "_n", "_rk", "_leg", "_raw", "_w", "_sec")


def hold(df: DataFrame, decided: str, keys: tuple[str, ...] = (), drop_out: bool = True) -> DataFrame:
    """Carry the decided weight (0 included) to the next decision; 0 before the
    first one, and 0 while out of the universe."""
    kept = F.last(decided, ignorenulls=True).over(cumulative((*keys, "symbol")))
    w = F.coalesce(kept, F.lit(0.0))
    if drop_out:
        w = F.when(F.col("in_universe"), w).otherwise(F.lit(0.0))
    return df.withColumn("w", w)
