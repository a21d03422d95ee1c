"""Universe masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .align import asof_snapshot


def static_mask(panel: DataFrame, members: DataFrame) -> DataFrame:
    """``in_universe`` true for listed symbols (a short dimension list)."""
    listed = members.select("symbol").distinct().withColumn("_m", F.lit(True))
    return (
        panel.drop("in_universe")
        .join(listed, "symbol", "left")
        .withColumn("in_universe", F.coalesce("_m", F.lit(False)))
        .drop("_m")
    )


def point_in_time_mask(panel: DataFrame, calendar: DataFrame, membership: DataFrame) -> DataFrame:
    """Membership of the latest snapshot on or before each bar.

    The as-of date is resolved once per bar of the (bounded) calendar; the
    membership test is then an equi-join on (symbol, snapshot date).
    """
    asof = F.broadcast(asof_snapshot(calendar.select("ts"), membership))
    snaps = membership.select(
        "symbol", F.col("date").cast("date").alias("asof"), F.lit(True).alias("_m")
    ).distinct()
    return (
        panel.drop("in_universe")
        .join(asof, "ts")
        .join(snaps, ["symbol", "asof"], "left")
        .withColumn("in_universe", F.coalesce("_m", F.lit(False)))
        .drop("_m")
    )


def members_asof(membership: DataFrame, on: str) -> DataFrame:
    """Members on one date: rows of the latest snapshot not after it."""
    cut = membership.filter(F.col("date").cast("date") <= F.lit(on).cast("date"))
    latest = cut.agg(F.max("date")).scalar()
    return cut.filter(F.col("date") == latest).select("symbol").distinct()


def exclude(panel: DataFrame, symbol: str) -> DataFrame:
    """Keep a benchmark's prices but make it untradable."""
    return panel.withColumn("in_universe", F.col("in_universe") & (F.col("symbol") != symbol))
