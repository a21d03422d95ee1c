"""Joins that line tables up in time: as-of, event snapping, windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import day


def keep_last(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """One row per key, the one with the highest ``seq``.

    An aggregate rather than a ranked window: rows merge before the shuffle, so
    a key repeated any number of times never gathers in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), seq).alias("_r"))
        .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
    )


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    value: Column | str,
    out: str,
    left_on: str = "ts",
    right_on: str = "ts",
    bucket: str = "month",
) -> DataFrame:
    """Latest right value at or before each left row.

    Union of both sides, then "last value" inside (key, time bucket); earlier
    buckets arrive as one carried value per bucket.  Splitting on the bucket
    keeps a key with very many rows from becoming a single task.
    """
    value = F.col(value) if isinstance(value, str) else value
    cols = left.columns
    lhs = left.select(
        *keys, F.col(left_on).alias("_t"), F.lit(1).alias("_side"),
        F.struct(*cols).alias("_row"), F.lit(None).alias("_v"),
    )
    rhs = right.select(
        *keys, F.col(right_on).alias("_t"), F.lit(0).alias("_side"), value.alias("_v")
    ).filter(F.col("_v").isNotNull())
    both = rhs.unionByName(lhs, allowMissingColumns=True).withColumn(
        "_b", F.trunc(day("_t"), bucket)
    )
    w = Window.partitionBy(*keys, "_b").orderBy("_t", "_side")
    both = both.withColumn("_in", F.last("_v", ignorenulls=True).over(w))
    carried = both.groupBy(*keys, "_b").agg(
        F.max_by(F.when(F.col("_side") == 0, F.col("_v")), F.when(F.col("_side") == 0, F.col("_t"))).alias("_c")
    )
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select(
        *keys, "_b", F.last("_c", ignorenulls=True).over(before).alias("_c")
    )
    return (
        both.filter(F.col("_side") == 1)
        .join(carried, [*keys, "_b"], "left")
        .select("_row.*", F.coalesce("_in", "_c").alias(out))
    )


def positions(calendar: DataFrame) -> DataFrame:
    """Map every day in the calendar's span to bar positions.

    ``pos_back``: last bar on or before the day; ``pos_fwd``: first bar on or
    after it.  One row per calendar day, so always small enough to broadcast.
    """
    days = calendar.agg(F.array_sort(F.collect_set(day("ts"))).alias("days"))
    bars = days.select(F.posexplode("days").alias("i", "bar"), "days").select(
        "i", "bar", F.coalesce(F.get("days", F.col("i") + 1), F.date_add("bar", 1)).alias("next")
    )
    return bars.select(
        "i",
        "bar",
        F.explode(
            F.sequence("bar", F.date_sub("next", 1), F.expr("interval 1 day"))
        ).alias("day"),
    ).select(
        "day",
        F.col("i").alias("pos_back"),
        F.when(F.col("day") == F.col("bar"), F.col("i")).otherwise(F.col("i") + 1).alias("pos_fwd"),
    )


def snap(events: DataFrame, calendar: DataFrame, date: str) -> DataFrame:
    """Add ``pos_back``/``pos_fwd`` to events, including days outside the span.

    Before the first bar: pos_back = -1, pos_fwd = 0.  After the last:
    pos_back = n - 1, pos_fwd = n (``n_bars``).
    """
    edge = calendar.agg(
        F.struct(
            day(F.min("ts")).alias("lo"), day(F.max("ts")).alias("hi"), F.count("*").alias("n")
        ).alias("e")
    ).scalar()
    lookup = F.broadcast(positions(calendar).withColumnRenamed("day", "_d"))
    d = day(date)
    return (
        events.withColumn("_e", edge)
        .join(lookup, d == F.col("_d"), "left")
        .withColumns(
            {
                "pos_back": F.when(d < F.col("_e.lo"), -1)
                .when(d > F.col("_e.hi"), F.col("_e.n") - 1)
                .otherwise(F.col("pos_back"))
                .cast("long"),
                "pos_fwd": F.when(d < F.col("_e.lo"), 0)
                .when(d > F.col("_e.hi"), F.col("_e.n"))
                .otherwise(F.col("pos_fwd"))
                .cast("long"),
                "n_bars": F.col("_e.n"),
            }
        )
        .drop("_d", "_e")
    )


def asof_snapshot(calendar: DataFrame, dates: DataFrame, on: str = "date") -> DataFrame:
    """For each bar the latest snapshot date on or before it.

    Both sides are sets of days, hence bounded; the snapshot days travel as one
    array.
    """
    days = dates.agg(F.array_sort(F.collect_set(day(on))).alias("d")).scalar()
    return calendar.withColumn("_ds", days).select(
        *calendar.columns,
        F.array_max(F.filter("_ds", lambda d: d <= day(F.col("ts")))).alias("asof"),
    )


def event_window(events: DataFrame, first: Column, last: Column) -> DataFrame:
    """One row per event and bar position in [first, last]; empty when reversed.

    Expanding positions turns the interval join into an equi-join on ``pos``.
    """
    return (
        events.withColumn("_a", first)
        .withColumn("_z", last)
        .filter(F.col("_a") <= F.col("_z"))
        .withColumn("pos", F.explode(F.sequence("_a", "_z")))
        .drop("_a", "_z")
    )


def legs(pairs: DataFrame, prices: DataFrame, value: str = "tr") -> DataFrame:
    """Prices of both legs of each pair per bar.

    The pair list may be derived from data, so the size at run time decides how it is joined.
    """
    px = prices.select("symbol", "ts", "pos", value)
    a = px.select(
        F.col("symbol").alias("symbol_a"), "ts", "pos", F.col(value).alias("a")
    ).join(pairs, "symbol_a")
    b = px.select(F.col("symbol").alias("symbol_b"), "ts", F.col(value).alias("b"))
    return a.join(b, ["symbol_b", "ts"]).select(
        "pair_id", "symbol_a", "symbol_b", "ts", "pos", "a", "b"
    )
