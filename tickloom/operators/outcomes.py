"""What happened after a signal: entry, exit, return, size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import div
from ..functions.window import cumulative
from .machines import first_free

PRICES = ("open", "high", "low", "close")
INTENT = ("symbol", "ts", "pos", "side", "stop", "take", "time_stop", "size", "tag")


def label(intents: DataFrame, panel: DataFrame, default_hold: int | None = None) -> DataFrame:
    """Entry at the next bar's open, then the first exit rule that fires.

    Per later bar, in order: stop at the open, stop at its level, take at the
    open, take at its level, time stop at the close, leaving the universe at
    the close.  Bars without a close do not count.  ``intents`` has the columns
    ``INTENT`` with at most one row per (symbol, bar, tag).

    Bars are numbered per symbol and the holding period expanded to those
    numbers, so finding the exit is an equi-join and a minimum.
    """
    valid = F.col("close").isNotNull()
    n = F.count("close").over(cumulative())
    total = F.count("close").over(Window.partitionBy("symbol"))
    bars = panel.select(
        "symbol", "ts", "pos", *PRICES, "in_universe", n.alias("rn"), total.alias("n_valid")
    )
    entry = intents.withColumn("entry_pos", F.col("pos") + 1).join(
        bars.select(
            "symbol",
            F.col("pos").alias("entry_pos"),
            F.col("ts").alias("entry_ts"),
            F.col("open").alias("entry_px"),
            F.col("rn").alias("rn0"),
            F.col("n_valid"),
        ),
        ["symbol", "entry_pos"],
    )
    entry = entry.filter(F.col("entry_px").isNotNull())
    left = F.greatest(F.lit(0), F.col("n_valid") - F.col("rn0"))
    steps = F.least(F.coalesce("time_stop", F.lit(default_hold).cast("long"), left), left)
    path = entry.select(
        "symbol", "pos", "tag", "side", "stop", "take", "time_stop", "entry_pos", "rn0",
        F.explode(F.sequence(F.lit(0).cast("long"), steps.cast("long"))).alias("j"),
    ).withColumn("rn", F.col("rn0") + F.col("j"))
    walk = path.join(
        bars.filter(valid).select(
            "symbol", "rn", F.col("pos").alias("exit_pos"), F.col("ts").alias("exit_ts"),
            *PRICES, "in_universe",
        ),
        ["symbol", "rn"],
    ).filter(F.col("exit_pos") >= F.col("entry_pos"))
    s = F.col("side")
    # Mirrored for shorts: times side, "at or beyond the stop" reads the same.
    worst = F.when(s > 0, F.col("low")).otherwise(F.col("high"))
    best = F.when(s > 0, F.col("high")).otherwise(F.col("low"))

    def exit_row(px, why: str):
        return F.struct(px.alias("px"), F.lit(why).alias("reason"))

    later = F.col("j") >= 1
    hit = (
        F.when(later & (s * F.col("open") <= s * F.col("stop")), exit_row(F.col("open"), "stop"))
        .when(later & (s * worst <= s * F.col("stop")), exit_row(F.col("stop"), "stop"))
        .when(later & (s * F.col("open") >= s * F.col("take")), exit_row(F.col("open"), "take"))
        .when(later & (s * best >= s * F.col("take")), exit_row(F.col("take"), "take"))
        .when(later & (F.col("j") >= F.col("time_stop")), exit_row(F.col("close"), "time"))
        .when(~F.col("in_universe"), exit_row(F.col("close"), "delist"))
    )
    exits = (
        walk.withColumn("hit", hit)
        .filter(F.col("hit").isNotNull())
        .groupBy("symbol", "pos", "tag")
        .agg(F.min_by(F.struct("hit", "exit_pos", "exit_ts", "j"), "j").alias("x"))
    )
    out = entry.join(exits, ["symbol", "pos", "tag"], "left")
    px = F.col("x.hit.px")
    return out.select(
        *[c for c in INTENT],
        "entry_pos",
        "entry_ts",
        "entry_px",
        F.col("x.exit_pos").alias("exit_pos"),
        F.col("x.exit_ts").alias("exit_ts"),
        px.alias("exit_px"),
        F.coalesce("x.hit.reason", F.lit("open")).alias("reason"),
        F.col("x.j").alias("bars_held"),
        (s * (div(px, "entry_px") - 1)).alias("ret"),
    )


def one_at_a_time(labelled: DataFrame) -> DataFrame:
    """Keep signals that find no open trade in their symbol."""
    w = Window.partitionBy("symbol").orderBy("entry_pos", "tag")
    ranked = labelled.withColumn("seq", F.row_number().over(w))
    kept = first_free(ranked).filter("kept").select("symbol", "seq")
    return ranked.join(kept, ["symbol", "seq"], "left_semi").drop("seq")


def sized(labelled: DataFrame, mode: str, nav: float = 1.0) -> DataFrame:
    """Units bought on a fixed base NAV."""
    risk = F.abs(F.col("entry_px") - F.col("stop"))
    qty = {
        "risk_frac": F.when(risk > 0, nav * F.col("size") / risk),
        "nav_frac": nav * div("size", "entry_px"),
        "target_weight": nav * div(F.abs("size"), "entry_px"),
        "qty": F.col("size"),
    }
    if mode not in qty:
        raise ValueError(f"unknown size mode {mode!r}")
    return labelled.withColumn("qty", qty[mode]).filter(F.col("qty") > 0)


def trade_ledger(trades: DataFrame, cost_bps: float = 7.6) -> DataFrame:
    """Entry and exit rows with realised pnl on the exit row."""
    common = ["symbol", "qty", "tag"]
    entry = trades.select(
        *common, F.col("entry_ts").alias("ts"), F.col("side").cast("long").alias("side"),
        F.col("entry_px").alias("price"), F.lit("entry").alias("reason"),
        F.lit(None).cast("double").alias("pnl"),
    )
    notional = F.col("qty") * F.col("exit_px")
    leave = trades.filter(F.col("exit_ts").isNotNull()).select(
        *common, F.col("exit_ts").alias("ts"), (-F.col("side")).cast("long").alias("side"),
        F.col("exit_px").alias("price"), "reason",
        (F.col("side") * F.col("qty") * (F.col("exit_px") - F.col("entry_px")) - notional * cost_bps / 1e4).alias("pnl"),
    )
    return entry.unionByName(leave).select(
        "ts", "symbol", "side", "qty", "price",
        (F.col("qty") * F.col("price")).alias("notional"),
        F.lit(float(cost_bps)).alias("cost_bps"), "reason", "tag", "pnl",
    )
