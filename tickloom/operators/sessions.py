"""Trading calendars, period ends, densify, gaps and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import as_ts, day
from ..functions.window import ordered

# Yearly exchange holidays as (month, day).
FIXED_HOLIDAYS = (
    (1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (1, 6), (1, 7), (1, 8),
    (2, 23), (3, 8), (5, 1), (5, 9), (6, 12), (11, 4),
)
# The 2022 trading halt per market, both ends inclusive.
HALTS = {
    "stock": ("2022-02-28", "2022-03-24"),
    "forts": ("2022-02-28", "2022-03-21"),
}


def is_trading_day(d: Column | str, market: str = "stock") -> Column:
    """Weekday, not a holiday (nor the Monday after a weekend one), not halted."""
    if market not in HALTS:
        raise ValueError(f"market must be one of {sorted(HALTS)}")
    d = day(d)
    dow = F.weekday(d)  # Monday = 0

    def on_holiday(x: Column) -> Column:
        md = F.month(x) * 100 + F.dayofmonth(x)
        return md.isin([m * 100 + n for m, n in FIXED_HOLIDAYS])

    shifted = (dow == 0) & (on_holiday(F.date_sub(d, 1)) | on_holiday(F.date_sub(d, 2)))
    start, end = HALTS[market]
    halted = d.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return (dow < 5) & ~on_holiday(d) & ~shifted & ~halted


def trading_days(bounds: DataFrame, market: str = "stock") -> DataFrame:
    """Trading days of each ``[start, end]`` row of ``bounds``."""
    days = bounds.select(
        F.explode(F.sequence(day("start"), day("end"), F.expr("interval 1 day"))).alias("day")
    )
    return days.filter(is_trading_day("day", market)).select(as_ts("day").alias("ts"))


def day_array(bars: DataFrame, ts: str = "ts") -> DataFrame:
    """All distinct bar dates as one sorted array.

    The set is bounded by the number of days in the data (about 366 a year
    whatever the row count), so one row may hold it.  De-duplication runs as a
    hash aggregate before the shuffle.
    """
    return bars.select(ts).distinct().agg(F.array_sort(F.collect_list(ts)).alias("days"))


def calendar_of(bars: DataFrame, ts: str = "ts") -> DataFrame:
    """Distinct bar dates with their position."""
    return day_array(bars, ts).select(F.posexplode("days").alias("pos", ts))


def next_business_day(d: Column) -> Column:
    dow = F.weekday(d)
    return F.date_add(d, F.when(dow == 4, 3).when(dow == 5, 2).otherwise(1))


def period_start(d: Column | str, freq: str) -> Column:
    d = day(d)
    if freq == "D":
        return d
    unit = {"W": "week", "ME": "month", "QE": "quarter"}[freq]
    return F.trunc(d, unit)


def is_period_end(freq: str = "ME", ts: str = "ts", keys=("symbol",)) -> Column:
    """Flag the last bar of each period on a dense panel.

    The next bar date decides; for the last bar of the data the next business
    day does, so a period cut off mid-way is not flagged.
    """
    if freq == "D":
        return F.lit(True)
    here = period_start(ts, freq)
    nxt = F.lead(day(ts)).over(ordered(keys, ts))
    return period_start(F.coalesce(nxt, next_business_day(day(ts))), freq) != here


def rebalance_dates(calendar: DataFrame, freq: str = "ME") -> DataFrame:
    """Last bar date per period without the trailing incomplete period."""
    if freq == "D":
        return calendar.select("ts")
    last = calendar.groupBy(period_start("ts", freq).alias("period")).agg(F.max("ts").alias("ts"))
    end = calendar.agg(F.max("ts").alias("end")).select(day("end").alias("end")).scalar()
    return last.filter(
        (F.col("period") != period_start(end, freq))
        | (period_start(next_business_day(end), freq) != F.col("period"))
    ).select("ts")


def densify(bars: DataFrame, days: DataFrame, keys: DataFrame) -> DataFrame:
    """Every key of ``keys`` on every calendar bar; missing bars stay NULL."""
    return grid_of(days, keys).join(bars, ["symbol", "ts"], "left")


def grid_of(days: DataFrame, keys: DataFrame) -> DataFrame:
    """Key table times calendar, as a generator over the key table.

    ``days`` is the one-row result of :func:`day_array`; it reaches the rows as
    an uncorrelated scalar subquery, so no two tables are crossed.
    """
    return keys.select("*", F.posexplode(days.scalar()).alias("pos", "ts"))


def coverage(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol", "freq").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("rows")
    )


def missing_ranges(expected: DataFrame, bars: DataFrame) -> DataFrame:
    """Runs of expected bars (``symbol, ts, pos``) with no stored bar."""
    missing = expected.join(bars.select("symbol", "ts"), ["symbol", "ts"], "left_anti")
    w = Window.partitionBy("symbol").orderBy("pos")
    return (
        missing.withColumn("island", F.col("pos") - F.row_number().over(w))
        .groupBy("symbol", "island")
        .agg(
            F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n_days")
        )
        .drop("island")
    )


def chunk_ranges(ranges: DataFrame, max_days: int) -> DataFrame:
    """Cut each ``[start, end]`` into pieces of at most ``max_days`` days.

    A piece spans ``max_days`` days; the next starts one day after its end.
    """
    step = F.make_dt_interval(F.lit(max_days + 1))
    starts = F.explode(F.sequence(day("start"), day("end"), step))
    return ranges.withColumn("chunk_start", starts).withColumn(
        "chunk_end", F.least(F.date_add("chunk_start", max_days), day("end"))
    )


def resample_daily(
    ticks: DataFrame, value: str, how: str = "last", order: Column | str = "ts"
) -> DataFrame:
    """One value per (symbol, day): the last in ``order``, or the mean."""
    agg = F.max_by(value, order) if how == "last" else F.avg(value)
    return ticks.groupBy("symbol", as_ts(day("ts")).alias("day")).agg(agg.alias(value))


def downsample(series: DataFrame, keys: list[str], n_points: int, order: str = "ts") -> DataFrame:
    """Keep rows at ``floor(i * (N - 1) / (n - 1))`` for i in 0..n-1.

    Row k stays when the smallest i with ``i * (N-1) >= k * (n-1)`` still
    floors to k; integer arithmetic keeps the choice exact.
    """
    w = Window.partitionBy(*keys)
    series = series.withColumn(
        "_k", (F.row_number().over(w.orderBy(order)) - 1).cast("long")
    ).withColumn("_n", F.count(F.lit(1)).over(w))
    i = F.expr(f"(_k * {n_points - 1} + _n - 2) div (_n - 1)")
    keep = (i * (F.col("_n") - 1) < (F.col("_k") + 1) * (n_points - 1)) & (i <= n_points - 1)
    return series.filter((F.col("_n") <= n_points) | keep).drop("_k", "_n")


def turn_of_month(calendar: DataFrame, before: int = 1, after: int = 3) -> DataFrame:
    """Calendar rows whose position lies in [i-before+1, i+after] of a month end."""
    ends = calendar.join(rebalance_dates(calendar, "ME"), "ts", "left_semi")
    near = ends.select(
        F.explode(F.sequence(F.col("pos") - before + 1, F.col("pos") + after)).alias("pos")
    ).distinct()
    return calendar.join(near, "pos", "left_semi")
