"""Pair spreads: hedge ratio, half-life, z-score, book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import Roll, rolling
from ..functions.scalar import div
from ..functions.stats import half_life, mean_ratio, ols_log_slope
from ..functions.window import cumulative

PAIR = ("pair_id",)


def neighbours(panel: DataFrame, formation: int = 504, group: str = "sector") -> DataFrame:
    """Pairs (pair_id, symbol_a, symbol_b): each symbol with the next one of its sector by beta.

    The beta to the sector's mean return over the first ``formation`` bars places symbols on one
    line, so near ones are found by one sort of a sector's symbols, never by comparing all of them.
    """
    early = panel.filter((F.col("pos") < formation) & F.col("ret").isNotNull())
    early = early.withColumn("_m", F.avg("ret").over(Window.partitionBy(group, "ts")))
    beta = div(F.covar_pop("ret", "_m"), F.var_pop("_m"))
    placed = early.groupBy(group, "symbol").agg(F.round(beta, 9).alias("_b")).filter(F.col("_b").isNotNull())
    other = F.lead("symbol").over(Window.partitionBy(group).orderBy("_b", "symbol"))
    pairs = placed.select(F.col("symbol").alias("symbol_a"), other.alias("symbol_b")).filter(F.col("symbol_b").isNotNull())
    return pairs.select(F.concat_ws("/", "symbol_a", "symbol_b").alias("pair_id"), "symbol_a", "symbol_b")


def is_refit(formation: int = 252, every: int = 21):
    return (F.col("pos") >= formation) & ((F.col("pos") - formation) % every == 0)


def hedge_ratios(
    pairs: DataFrame, formation: int = 252, every: int = 21, method: str = "ols_log"
) -> DataFrame:
    """Hedge ratio in force per bar: refit on the bars strictly before a refit
    bar, constant in between.

    Refit bars (one in ``every``) pull their formation window by an equi-join on
    the formation rows' positions, so the regression runs once per refit rather
    than once per bar.
    """
    cohorts = formation_rows(pairs, formation, every)
    slope = ols_log_slope("a", "b") if method == "ols_log" else mean_ratio("a", "b")
    fits = cohorts.groupBy(*PAIR, "refit").agg(slope.alias("beta_fit"))
    return in_force(pairs, fits, ["beta_fit"], ["beta"])


def formation_rows(pairs: DataFrame, formation: int, every: int) -> DataFrame:
    """Each row once per refit whose window contains it.

    Row at position p belongs to refits formation + every * j with
    p < refit <= p + formation, at most formation / every + 1 of them.
    """
    span = pairs.select(
        *PAIR, "pos", "a", "b",
        F.greatest(F.lit(0), F.floor((F.col("pos") - formation) / every) + 1).alias("_j0"),
        F.floor(F.col("pos") / every).alias("_j1"),
    )
    return (
        span.filter(F.col("_j0") <= F.col("_j1"))
        .select(*PAIR, "pos", "a", "b", F.explode(F.sequence("_j0", "_j1")).alias("_j"))
        .withColumn("refit", F.col("_j") * every + formation)
        .drop("_j")
    )


def in_force(pairs: DataFrame, fits: DataFrame, src: list[str], out: list[str]) -> DataFrame:
    """Attach refit results to refit bars and carry them forward.

    A refit that failed is carried as a failure (NULL), not skipped.
    """
    packed = fits.select(
        *PAIR, F.col("refit").alias("pos"), F.struct(*src).alias("_fit")
    )
    joined = pairs.join(packed, [*PAIR, "pos"], "left")
    last = F.last("_fit", ignorenulls=True).over(cumulative(PAIR, "pos"))
    return joined.withColumn("_fit", last).select(
        *pairs.columns, *[F.col(f"_fit.{s}").alias(o) for s, o in zip(src, out)]
    )


def refits(
    pairs: DataFrame,
    formation: int = 252,
    every: int = 21,
    min_hl: float = 5.0,
    max_hl: float = 40.0,
    method: str = "ols_log",
    on_bars: bool = True,
) -> DataFrame:
    """One row per (pair, refit): hedge ratio, half-life, tradable flag.

    Hedge ratio, spread, its lag and the AR(1) regression all partition by
    (pair, refit), so one shuffle of the formation rows serves the whole fit.
    ``on_bars=False`` skips the check that a refit falls on an existing bar,
    for callers that join the fits to bars anyway.
    """
    rows = formation_rows(pairs, formation, every)
    cohort = Window.partitionBy(*PAIR, "refit")
    if method == "ols_log":
        ok = (F.col("a") > 0) & (F.col("b") > 0)
        rows = rows.withColumns({"x": F.when(ok, F.ln("a")), "y": F.when(ok, F.ln("b"))})
        beta = F.when(
            (F.count("y").over(cohort) >= 3) & (F.stddev_pop("y").over(cohort) >= 1e-12),
            F.regr_slope("x", "y").over(cohort),
        )
    else:
        ok = F.col("a").isNotNull() & F.col("b").isNotNull()
        rows = rows.withColumns({"x": F.when(ok, F.col("a")), "y": F.when(ok, F.col("b"))})
        ratio = F.when((F.col("a") > 0) & (F.col("b") > 0), div("a", "b"))
        beta = F.when(F.count(ratio).over(cohort) >= 3, F.avg(ratio).over(cohort))
    s = rows.withColumn("beta_fit", beta).withColumn("s", F.col("x") - F.col("beta_fit") * F.col("y"))
    seen = Window.partitionBy(*PAIR, "refit").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("s_lag", F.last("s", ignorenulls=True).over(seen))
    out = s.groupBy(*PAIR, "refit").agg(
        F.max("beta_fit").alias("beta_fit"),
        F.regr_slope(F.col("s") - F.col("s_lag"), F.col("s_lag")).alias("_b"),
        F.count("s").alias("_n"),
    )
    out = out.withColumn("hl_fit", half_life(F.col("_b"), F.col("_n")))
    ok = F.col("hl_fit").between(min_hl, max_hl) & (F.col("hl_fit") != float("inf"))
    out = out.select(*PAIR, "refit", "beta_fit", "hl_fit", F.coalesce(ok, F.lit(False)).alias("ok_fit"))
    if not on_bars:
        return out
    return out.join(pairs.select(*PAIR, F.col("pos").alias("refit")), [*PAIR, "refit"], "left_semi")


def spread_z(df: DataFrame, z_window: int = 63, frac: float = 0.75, method: str = "ols_log") -> DataFrame:
    """z of the spread against the previous ``z_window`` bars, all priced with
    the hedge ratio in force now.

    mean(s) = mean(x) - beta * mean(y) and var(s) = var(x) + beta^2 var(y) -
    2 beta cov(x, y), so one pass of window moments serves every beta.
    """
    if method == "ols_log":
        ok = (F.col("a") > 0) & (F.col("b") > 0)
        df = df.withColumns({"_x": F.when(ok, F.ln("a")), "_y": F.when(ok, F.ln("b"))})
    else:
        both = F.col("a").isNotNull() & F.col("b").isNotNull()
        df = df.withColumns({"_x": F.when(both, F.col("a")), "_y": F.when(both, F.col("b"))})
    beta = F.col("beta")
    few = {"n": z_window, "min_periods": max(5, int(z_window * frac)), "lag": 1}
    df = rolling(
        df,
        [
            Roll("_mx", "avg", "_x", **few),
            Roll("_my", "avg", "_y", **few),
            Roll("_vx", "pvar", "_x", **few),
            Roll("_vy", "pvar", "_y", **few),
            Roll("_cxy", "pcov", "_x", y="_y", **few),
        ],
        PAIR,
        "pos",
    ).withColumns(
        {
            "spread": F.col("_x") - beta * F.col("_y"),
            "_m": F.col("_mx") - beta * F.col("_my"),
            "_v": F.col("_vx") + beta * beta * F.col("_vy") - 2 * beta * F.col("_cxy"),
        }
    )
    sd = F.sqrt(F.greatest(F.col("_v"), F.lit(0.0)))
    z = F.when(sd >= 1e-12, div(F.col("spread") - F.col("_m"), sd))
    return df.withColumn("z", z).drop("_x", "_y", "_mx", "_my", "_vx", "_vy", "_cxy", "_m", "_v")


def pair_signals(pairs: DataFrame, formation=252, every=21, z_window=63, min_hl=5.0, max_hl=40.0, method="ols_log") -> DataFrame:
    fits = refits(pairs, formation, every, min_hl, max_hl, method, on_bars=False)
    df = in_force(pairs, fits, ["beta_fit", "hl_fit", "ok_fit"], ["beta", "half_life", "tradable"])
    return spread_z(df.withColumn("tradable", F.coalesce("tradable", F.lit(False))), z_window, method=method)


def pair_book(states: DataFrame, n_pairs: Column | int, gross: float = 1.0) -> DataFrame:
    """Legs of each pair's position, beta-weighted, summed per symbol."""
    n = n_pairs if isinstance(n_pairs, Column) else F.lit(n_pairs)
    unit = F.lit(float(gross)) / F.greatest(n, F.lit(1)) / (1 + F.coalesce(F.abs("beta"), F.lit(0.0)))
    side = F.col("position").cast("double")
    a = states.select(F.col("symbol_a").alias("symbol"), "ts", (side * unit).alias("w"))
    b = states.select(
        F.col("symbol_b").alias("symbol"),
        "ts",
        (-side * F.coalesce("beta", F.lit(0.0)) * unit).alias("w"),
    )
    return a.unionByName(b).groupBy("symbol", "ts").agg(F.sum("w").alias("w"))
