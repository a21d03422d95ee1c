"""Carry and term-structure signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import Roll, rolling
from ..functions.scalar import clip, col, day, div
from ..functions.stats import xs_zscore


def annualized_basis(near, far, days) -> Column:
    """(near / far - 1) * 365 / days; positive = backwardation."""
    return (div(near, far) - 1) * div(F.lit(365.0), col(days).cast("double"))


def slope_zscore(
    df: DataFrame, basis: str = "basis", window: int = 252, min_periods: int = 63, out: str = "z"
) -> DataFrame:
    """Basis against its own lagged mean and deviation."""
    stats = [
        Roll("_mu", "avg", basis, window, min_periods, 1),
        Roll("_sd", "std", basis, window, min_periods, 1),
    ]
    z = div(F.col(basis) - F.col("_mu"), "_sd")
    return rolling(df, stats).withColumn(out, z).drop("_mu", "_sd")


def carry_xs(basis, clamp: float = 2.0) -> Column:
    """Cross-sectional z-score (sample deviation), clipped."""
    return xs_zscore(basis, min_names=2, winsor=clamp, sample=True)


def carry_ts(basis, hurdle: float = 0.0, clamp: float = 1.0) -> Column:
    """Sign of carry over the hurdle, full size from 10 % on."""
    edge = col(basis) - F.lit(float(hurdle))
    size = F.least(F.lit(1.0), F.abs(edge) / 0.10)
    return clip(F.when(edge.isNotNull(), F.signum(edge) * size), -clamp, clamp)


def deseasonalized(basis, rows: int = 3) -> Column:
    """Minus the mean of the previous ``rows`` rows in the same calendar month.

    NULL until the month has one earlier value among those rows.
    """
    w = Window.partitionBy("symbol", F.month(day("ts"))).orderBy("ts").rowsBetween(-rows, -1)
    return col(basis) - F.avg(col(basis)).over(w)


def front_pair(curve: DataFrame, keys: tuple[str, ...] = ("date",)) -> DataFrame:
    """First two unexpired expiries per date with slope (and basis to spot).

    Two ordered slots picked with aggregates: the nearest expiry, then the
    nearest after it.
    """
    live = curve.filter(day("expiry") > day("date"))
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy("expiry", "settle"))
    top = live.withColumn("_rn", rn).filter(F.col("_rn") <= 2)

    def slot(i: int, c: str) -> Column:
        return F.max(F.when(F.col("_rn") == i, F.col(c)))

    spot = F.max("spot_index") if "spot_index" in curve.columns else F.lit(None).cast("double")
    out = top.groupBy(*keys).agg(
        slot(1, "settle").alias("vx1"),
        slot(2, "settle").alias("vx2"),
        slot(1, "expiry").alias("_e1"),
        slot(2, "expiry").alias("_e2"),
        spot.alias("_spot"),
        F.count(F.lit(1)).alias("_n"),
    )
    return out.filter(F.col("_n") == 2).select(
        *keys,
        "vx1",
        "vx2",
        F.datediff(day("_e1"), day("date")).alias("days1"),
        F.datediff(day("_e2"), day("date")).alias("days2"),
        F.when(F.col("vx1") > 0, div("vx2", "vx1") - 1).alias("slope12"),
        (div("vx1", "_spot") - 1).alias("basis1"),
    )
