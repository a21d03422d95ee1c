"""Continuous futures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import day, div
from ..functions.window import ordered
from ..session import scratch


def held_by_expiry(days: DataFrame, contracts: DataFrame, offset_days: int = 3) -> DataFrame:
    """Held contract per (asset_code, bar) when rolling ``offset_days`` before expiry.

    At most one roll per bar: with contract k due from bar d_k on, the roll out
    of k happens at r_k = max(r_{k-1} + 1, d_k), which unrolls to the running
    maximum of (d_k - k) plus k.  The last contract never rolls.  ``days`` is
    the one-row calendar array.
    """
    chain = contracts.withColumn(
        "k", F.row_number().over(Window.partitionBy("asset_code").orderBy("expiry", "symbol")) - 1
    )
    due = F.date_sub(day("expiry"), offset_days)
    chain = chain.withColumn("_days", days.scalar()).withColumn(
        "_due", F.size(F.filter("_days", lambda d: day(d) < due))
    )
    w = Window.partitionBy("asset_code").orderBy("k")
    roll_pos = (
        F.max(F.col("_due") - F.col("k")).over(w.rowsBetween(Window.unboundedPreceding, 0))
        + F.col("k")
    )
    chain = chain.withColumn("_roll", roll_pos)
    chain = chain.withColumn("_from", F.coalesce(F.lag("_roll", 1).over(w), F.lit(0))).withColumn(
        "_to", F.when(F.lead("k", 1).over(w).isNull(), F.size("_days")).otherwise(F.col("_roll"))
    )
    return (
        chain.withColumn("_to", F.least(F.col("_to"), F.size("_days")))
        .filter(F.col("_from") < F.col("_to"))
        .select(
            "asset_code",
            F.col("symbol").alias("held"),
            F.explode(F.sequence(F.col("_from"), F.col("_to") - 1)).alias("pos"),
        )
    )


def held_by_activity(
    bars: DataFrame, contracts: DataFrame, measure: str = "oi", offset_days: int = 3
) -> DataFrame:
    """Held contract when the next one leads on two consecutive bars, or the expiry is near.

    The count of leads restarts at each roll, so a roll depends on the one before.  For every
    contract and every bar it could be entered on, the bar of the next roll is found at once, as
    the nearest later bar with two leads since the entry or on the due day.  These pointers are
    followed from the first contract in doubling steps, each one a join, so a chain of n contracts
    takes log n steps and no series is held by one task.
    """
    by_expiry = Window.partitionBy("asset_code").orderBy("expiry", "symbol")
    chain = contracts.withColumn("k", F.row_number().over(by_expiry) - 1).select(
        "asset_code", "symbol", "k", F.date_sub(day("expiry"), offset_days).alias("due")
    )
    rows = bars.join(chain, "symbol").select("asset_code", "k", "pos", day("ts").alias("d"), F.col(measure).alias("m"))
    bar_of = rows.groupBy("asset_code", "pos").agg(F.min("d").alias("d"))
    # A contract without a row on a bar of its asset leads nobody and is led by nobody there.
    grid = bar_of.join(chain, "asset_code").join(rows.select("asset_code", "k", "pos", "m"), ["asset_code", "k", "pos"], "left")
    after = rows.select("asset_code", (F.col("k") - 1).alias("k"), "pos", F.col("m").alias("m_next"))
    grid = grid.join(after, ["asset_code", "k", "pos"], "left")
    line = Window.partitionBy("asset_code", "k").orderBy("pos")
    lead = F.coalesce(F.col("m_next") > F.col("m"), F.lit(False))
    grid = grid.withColumns({"_i": F.row_number().over(line) - 1, "_lead": lead})
    twice = F.col("_lead") & F.lag("_lead", 1, False).over(line)
    grid = grid.withColumns({"_twice": F.when(twice, F.col("_i")), "_due": F.when(F.col("d") >= F.col("due"), F.col("_i"))})
    later = Window.partitionBy("asset_code", "k").orderBy(F.desc("_i"))
    led = F.min("_twice").over(later.rowsBetween(Window.unboundedPreceding, -2))
    expired = F.min("_due").over(later.rowsBetween(Window.unboundedPreceding, -1))
    last = chain.groupBy("asset_code").agg(F.max("k").alias("_last"))
    pointers = grid.select("asset_code", "k", F.col("_i").alias("s"), F.least(led, expired).alias("t"))
    # The first contract is held from the start, as if entered one bar before it.
    first = grid.filter("k = 0").groupBy("asset_code", "k").agg(F.least(F.min(F.when(F.col("_i") >= 1, F.col("_twice"))), F.min("_due")).alias("t"))
    pointers = pointers.unionByName(first.select("asset_code", "k", F.lit(-1).alias("s"), "t"))
    pointers = pointers.join(last, "asset_code").filter((F.col("k") < F.col("_last")) & F.col("t").isNotNull())
    jumps = _written(pointers.select("asset_code", "k", "s", (F.col("k") + 1).alias("k_to"), F.col("t").alias("s_to")), "roll-jumps")
    entries = _written(chain.filter("k = 0").select("asset_code", "k", F.lit(-1).alias("s")), "roll-entries")
    longest, step = chain.agg(F.max("k")).first()[0] or 0, 1
    node = ["asset_code", "k", "s"]
    while step <= longest:
        reached = entries.join(jumps, node).select("asset_code", F.col("k_to").alias("k"), F.col("s_to").alias("s"))
        entries = _written(entries.unionByName(reached), "roll-entries")
        on = jumps.select("asset_code", F.col("k").alias("k_to"), F.col("s").alias("s_to"), F.col("k_to").alias("k_2"), F.col("s_to").alias("s_2"))
        step *= 2
        if step <= longest:
            jumps = _written(jumps.join(on, ["asset_code", "k_to", "s_to"]).select(*node, F.col("k_2").alias("k_to"), F.col("s_2").alias("s_to")), "roll-jumps")
    ends = F.lead("s").over(Window.partitionBy("asset_code").orderBy("k"))
    index = bar_of.withColumn("_i", F.row_number().over(Window.partitionBy("asset_code").orderBy("pos")) - 1)
    n_bars = bar_of.groupBy("asset_code").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    spans = entries.withColumn("_to", ends).join(n_bars, "asset_code").join(chain.select("asset_code", "k", "symbol"), ["asset_code", "k"])
    spans = spans.select("asset_code", F.col("symbol").alias("held"), F.greatest("s", F.lit(0)).alias("_from"), F.coalesce("_to", "_n").alias("_to"))
    cells = spans.filter("_from < _to").select("asset_code", "held", F.explode(F.sequence(F.col("_from"), F.col("_to") - 1)).alias("_i"))
    return cells.join(index.select("asset_code", "_i", "pos"), ["asset_code", "_i"]).select("asset_code", "held", F.col("pos").cast("long").alias("pos"))


def _written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder, so that doubling does not double the plan."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stitch(held: DataFrame, bars: DataFrame, adjustment: str = "none") -> DataFrame:
    """Stitched level and return of the held contracts.

    Off a roll the held contract's own return; on a roll its own return when
    the series is adjusted, else the naive jump from the previous level.
    """
    own = bars.select(
        F.col("symbol").alias("held"),
        "pos",
        "ts",
        F.col("close").alias("price"),
        F.lag("close").over(ordered()).alias("own_prev"),
    )
    w = Window.partitionBy("asset_code").orderBy("pos")
    out = held.join(own, ["held", "pos"])
    out = out.withColumn("_ph", F.lag("held").over(w)).withColumn("_pp", F.lag("price").over(w))
    is_roll = F.col("_ph").isNotNull() & (F.col("_ph") != F.col("held"))
    prev = F.when(is_roll & F.lit(adjustment == "none"), F.col("_pp")).otherwise(F.col("own_prev"))
    return out.select(
        "asset_code",
        "ts",
        "pos",
        "held",
        "price",
        F.when(F.col("_ph").isNotNull(), div("price", prev) - 1).alias("ret"),
        is_roll.alias("is_roll"),
    )
