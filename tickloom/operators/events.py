"""Event studies without expanding events.

Events are first merged per (symbol, bar), which bounds every later step by
the panel.  Overlapping holding windows are then a rolling sum over the panel,
and an event-time curve is a difference of running sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import Roll, rolling
from ..functions.window import cumulative
from .align import event_window, snap

DATE_COLUMNS = (
    "announce_date", "event_date", "report_ts", "release_ts", "effective_date",
    "lockup_expiry", "ex_date", "ts", "date",
)


def date_column(events: DataFrame) -> str:
    """First known date column (a planning-time choice)."""
    for name in DATE_COLUMNS:
        if name in events.columns:
            return name
    raise ValueError(f"no date column among {events.columns}")


def event_weights(
    panel: DataFrame,
    events: DataFrame,
    calendar: DataFrame,
    lag: int = 2,
    hold: int = 60,
    weight: float = 0.02,
    max_gross: float = 1.0,
    date: str | None = None,
    side: Column | str | None = None,
) -> DataFrame:
    """Overlapping cohorts: each event holds weight * side for ``hold`` bars.

    Cohorts add up; a date whose gross exceeds ``max_gross`` is scaled down.  ``side`` is -1, 0 or 1:
    what is live is counted in whole cohorts, so sums are exact.  Returns the panel with column ``w``.
    """
    date = date or date_column(events)
    sign = F.lit(1) if side is None else (F.col(side) if isinstance(side, str) else side)
    per_day = events.groupBy("symbol", date).agg(F.sum(sign.cast("long")).alias("_s"))
    starts = (
        snap(per_day, calendar, date)
        .withColumn("pos", F.col("pos_back") + lag)
        .filter((F.col("pos") >= 0) & (F.col("pos") < F.col("n_bars")))
        .groupBy("symbol", "pos")
        .agg(F.sum("_s").alias("_start"))
    )
    out = panel.join(starts, ["symbol", "pos"], "left")
    start = F.coalesce("_start", F.lit(0).cast("long"))
    counted = Roll("_live", "sum", "_start", hold, 0)  # sums of whole numbers, exact in doubles
    out = rolling(out.withColumn("_start", start), [counted]).withColumn("_live", F.col("_live").cast("long"))
    gross = F.sum(F.abs("_live")).over(Window.partitionBy("ts"))
    capped = F.col("_live") * F.lit(float(max_gross)) / gross
    plain = F.col("_live") * F.lit(float(weight))
    return out.withColumn("w", F.when(gross * F.lit(float(weight)) > max_gross, capped).otherwise(plain)).drop("_start", "_live")


def abnormal_return(panel: DataFrame, out: str = "ar") -> DataFrame:
    """Return minus the equal-weight mean of the date."""
    return panel.withColumn(out, F.col("ret") - F.avg("ret").over(Window.partitionBy("ts")))


def car_curve(
    panel: DataFrame,
    events: DataFrame,
    calendar: DataFrame,
    window: tuple[int, int] = (-5, 60),
    date: str | None = None,
) -> DataFrame:
    """Mean cumulative abnormal return by event-relative bar.

    With C the running sum of abnormal returns (missing = 0), the CAR of an
    event at p is C[p+k] - C[p+lo-1]; only events' distinct (symbol, bar) pairs
    are expanded, weighted by how many events share them.
    """
    lo, hi = window
    date = date or date_column(events)
    per_day = events.groupBy("symbol", date).agg(F.count(F.lit(1)).alias("_n"))
    at = (
        snap(per_day, calendar, date)
        .groupBy("symbol", F.col("pos_back").alias("p"), "n_bars")
        .agg(F.sum("_n").alias("_n"))
    )
    run = abnormal_return(panel).select(
        "symbol", "pos", F.sum(F.coalesce("ar", F.lit(0.0))).over(cumulative()).alias("c")
    )
    cells = at.withColumn("k", F.explode(F.sequence(F.lit(lo), F.lit(hi)))).withColumn(
        "pos", F.col("p") + F.col("k")
    )
    cells = cells.filter((F.col("pos") >= 0) & (F.col("pos") < F.col("n_bars")))
    base = run.select("symbol", F.col("pos").alias("_bp"), F.col("c").alias("_base"))
    cells = cells.withColumn("_bp", F.col("p") + lo - 1)
    cars = cells.join(run, ["symbol", "pos"]).join(base, ["symbol", "_bp"], "left")
    car = F.col("c") - F.coalesce("_base", F.lit(0.0))
    return cars.groupBy(F.col("k").cast("long").alias("event_bar")).agg(
        (F.sum(car * F.col("_n")) / F.sum("_n")).alias("mean_car"), F.sum("_n").alias("n")
    )


def surprise_side(
    panel: DataFrame, events: DataFrame, calendar: DataFrame, date: str = "report_ts"
) -> DataFrame:
    """Side of an earnings event: the sign of actual - consensus, else the sign
    of the two-bar abnormal return starting on the event bar (0 when it has no
    following bar).  A surprise of exactly zero counts as negative.
    """
    ar2 = abnormal_return(panel).select("symbol", "pos", "ar")
    w = Window.partitionBy("symbol").orderBy("pos").rowsBetween(0, 1)
    # Two bars forward of the event bar: realised before the entry lag of two.
    react = ar2.select(
        "symbol",
        F.col("pos").alias("pos_back"),
        F.coalesce(F.sum("ar").over(w), F.lit(0.0)).alias("_car"),
    )
    s = F.col("eps_actual") - F.col("eps_consensus")
    usable = (F.col("pos_back") >= 0) & (F.col("pos_back") < F.col("n_bars") - 1)
    side = F.when(s.isNotNull(), F.when(s > 0, 1).otherwise(-1)).otherwise(
        F.when(usable & F.col("_car").isNotNull(), F.when(F.col("_car") > 0, 1).otherwise(-1))
        .otherwise(0)
    )
    return (
        snap(events, calendar, date)
        .join(react, ["symbol", "pos_back"], "left")
        .withColumn("side", side)
        .drop("_car", "pos_fwd")
    )


def set_exposure(
    panel: DataFrame, spans: DataFrame, first: Column, last: Column, exposure: float
) -> DataFrame:
    """Weight ``exposure`` where any span covers the bar (set, not added).

    ``spans`` holds symbol and bar bounds, already clipped to the calendar and
    distinct per day, so its expansion is bounded by the panel times the span.
    """
    covered = event_window(spans, first, last).select("symbol", "pos").distinct()
    on = covered.withColumn("_on", F.lit(float(exposure)))
    return (
        panel.join(on, ["symbol", "pos"], "left")
        .withColumn("w", F.coalesce("_on", F.lit(0.0)))
        .drop("_on")
    )
