"""Run statistics, drawdowns and report tables, keyed by ``run_id``."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import day, div
from ..functions.stats import cagr, compound_return, correlation, sample_kurtosis, sample_skew, sharpe, sortino
from ..functions.rolling import Roll, rolling
from ..functions.window import cumulative, ordered
from .sessions import downsample

RUN = ("run_id",)
PPY = 252.0


# --- drawdowns -------------------------------------------------------------


def drawdown(equity: DataFrame, value: str = "equity", keys=RUN) -> DataFrame:
    peak = F.max(value).over(cumulative(keys))
    return equity.withColumn("dd", div(value, peak) - 1)


def drawdown_episodes(equity: DataFrame, value: str = "equity", top_n: int | None = 10, keys=RUN) -> DataFrame:
    """Episodes between two bars at a high; the ``top_n`` deepest first, or all of them.

    Each bar at a high opens an island that holds the under-water bars after
    it; the next island's first bar is the recovery.
    """
    w = Window.partitionBy(*keys).orderBy("ts")
    s = drawdown(equity.filter(F.col(value).isNotNull()), value, keys)
    s = s.withColumns(
        {
            "i": F.row_number().over(w) - 1,
            "island": F.sum(F.when(F.col("dd") >= 0, 1).otherwise(0)).over(cumulative(keys)),
        }
    )
    last = s.groupBy(*keys, "island").agg(
        F.min("ts").alias("start"),
        F.min("i").alias("i0"),
        F.max("ts").alias("last_ts"),
        F.max("i").alias("i_last"),
        F.min("dd").alias("depth"),
        F.min_by(F.struct("ts", "i"), F.struct("dd", "i")).alias("low"),
    )
    by = Window.partitionBy(*keys).orderBy("island")
    last = last.withColumns(
        {"next_ts": F.lead("start").over(by), "next_i": F.lead("i0").over(by)}
    ).filter(F.col("depth") < 0)
    out = last.select(
        *keys,
        "start",
        F.col("low.ts").alias("trough"),
        F.coalesce("next_ts", "last_ts").alias("end"),
        "depth",
        (F.coalesce("next_i", "i_last") - F.col("i0")).cast("long").alias("duration"),
        (F.col("next_i") - F.col("low.i")).cast("long").alias("recovery"),
        F.col("next_ts").isNotNull().alias("recovered"),
    )
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("depth", "start"))
    out = out.withColumn("rank", rank.cast("long"))
    return out if top_n is None else out.filter(F.col("rank") <= top_n)


# --- summary ---------------------------------------------------------------


def return_stats(daily: DataFrame, ppy: float = PPY, keys=RUN, net: str = "net", gross: str = "gross") -> DataFrame:
    r = F.col(net)
    n = F.count(r)
    sd = F.stddev_samp(r)
    return daily.groupBy(*keys).agg(
        sharpe(r, ppy).alias("sharpe"),
        sortino(r, ppy).alias("sortino"),
        cagr(r, ppy).alias("cagr"),
        F.when(n > 2, sd * math.sqrt(ppy)).alias("ann_vol"),
        F.when(n > 3, sample_skew(r)).alias("skew"),
        F.when(n > 3, sample_kurtosis(r)).alias("kurtosis"),
        F.avg(F.when(r > 0, 1.0).when(r.isNotNull(), 0.0)).alias("hit_rate"),
        F.when((n > 2) & (sd > 0), div(F.avg(r), sd / F.sqrt(n.cast("double")))).alias("t_stat"),
        n.cast("double").alias("n_obs"),
        cagr(gross, ppy).alias("cagr_gross"),
        ((F.avg(gross) - F.avg(r)) * ppy * 1e4).alias("cost_drag_bps_ann"),
    )


def summary(book, trades: DataFrame | None = None, ppy: float = PPY, keys=RUN) -> DataFrame:
    """All run metrics in one row per run."""
    daily = book.daily
    base = return_stats(daily, ppy, keys)
    episodes = drawdown_episodes(daily, top_n=None, keys=keys).groupBy(*keys).agg(
        F.min("depth").alias("max_dd"), F.max("duration").cast("double").alias("dd_duration_days")
    )
    book_stats = (
        book.positions.groupBy(*keys, "ts")
        .agg(
            F.sum(F.abs("w")).alias("g"), F.sum("w").alias("n"), (0.5 * F.sum(F.abs("dw"))).alias("t")
        )
        .groupBy(*keys)
        .agg(
            F.avg("g").alias("avg_gross"),
            F.avg("n").alias("avg_net"),
            (F.avg("t") * ppy).alias("turnover_ann"),
        )
    )
    yearly = (
        daily.groupBy(*keys, F.year(day("ts")).alias("y"))
        .agg(compound_return("net").alias("r"))
        .groupBy(*keys)
        .agg(F.max("r").alias("best_year"), F.min("r").alias("worst_year"))
    )
    out = base.join(episodes, [*keys], "left").join(book_stats, [*keys]).join(yearly, [*keys])
    if trades is not None:
        t = trades.groupBy(*keys).agg(
            F.count(F.lit(1)).cast("double").alias("n_trades"),
            F.nullif(F.count("pnl"), F.lit(0)).cast("double").alias("n_closed_trades"),
            F.avg(F.when(F.col("pnl") > 0, 1.0).when(F.col("pnl").isNotNull(), 0.0)).alias("trade_hit_rate"),
        )
        out = out.join(t, [*keys], "left")
    return out.withColumns(
        {
            "max_dd": F.coalesce("max_dd", F.lit(0.0)),
            "dd_duration_days": F.coalesce("dd_duration_days", F.lit(0.0)),
            "calmar": F.when(F.col("max_dd") < 0, div("cagr", F.abs("max_dd"))),
        }
    )


# --- period tables ---------------------------------------------------------


def monthly_table(daily: DataFrame, r: str = "net", keys=RUN) -> DataFrame:
    """Twelve month cells per year and the year total; NULL where no data."""
    d = daily.filter(F.col(r).isNotNull()).select(
        *keys, F.year(day("ts")).alias("year"), F.month(day("ts")).alias("m"), r
    )

    def cell(i: int) -> Column:
        x = F.when(F.col("m") == i, 1 + F.col(r))
        return F.when(F.count(x) > 0, F.product(x) - 1).alias(f"m{i:02d}")

    return d.groupBy(*keys, "year").agg(
        *[cell(i) for i in range(1, 13)], compound_return(r).alias("total")
    )


def period_labels(ts: str, split_from: str, split_to: str) -> Column:
    """Labels of a bar: its year and, around a regime split, its side."""
    d = day(ts)
    side = F.when(d < F.lit(split_from).cast("date"), F.lit(f"pre-{split_from}")).when(
        d > F.lit(split_to).cast("date"), F.lit(f"post-{split_to}")
    )
    return F.array_compact(F.array(F.year(d).cast("string"), side))


def per_year_table(
    daily: DataFrame,
    trades: DataFrame | None = None,
    split: tuple[str, str] = ("2022-02-24", "2022-03-24"),
    ppy: float = PPY,
    keys=RUN,
) -> DataFrame:
    """Year rows plus the two regime rows when the run spans the split.

    Each bar is copied at most twice, once per label it belongs to.
    """
    span = Window.partitionBy(*keys)
    lo, hi = day(F.min("ts").over(span)), day(F.max("ts").over(span))
    crosses = (lo < F.lit(split[0]).cast("date")) & (hi > F.lit(split[1]).cast("date"))
    labels = F.when(crosses, period_labels("ts", *split)).otherwise(
        F.array(F.year(day("ts")).cast("string"))
    )
    d = daily.withColumn("_labels", labels).withColumn("period", F.explode("_labels")).drop("_labels")
    eq = F.product(1 + F.coalesce("net", F.lit(0.0))).over(cumulative((*keys, "period")))
    d = d.withColumn("_eq", eq)
    d = d.withColumn("_dd", F.col("_eq") / F.max("_eq").over(cumulative((*keys, "period"))) - 1)
    if trades is not None:
        counts = trades.groupBy(*keys, "ts").agg(F.count(F.lit(1)).alias("_nt"))
        d = d.join(counts, [*keys, "ts"], "left")
    else:
        d = d.withColumn("_nt", F.lit(0))
    out = d.groupBy(*keys, "period").agg(
        compound_return("gross").alias("gross"),
        compound_return("net").alias("net"),
        sharpe("net", ppy).alias("sharpe_net"),
        F.min("_dd").alias("max_dd"),
        F.count("net").alias("n_obs"),
        F.coalesce(F.sum("_nt"), F.lit(0)).alias("n_trades"),
    )
    return out.withColumn("cost_drag", F.col("gross") - F.col("net")).filter(F.col("n_obs") > 0)


def cost_attribution(daily: DataFrame, ppy: float = PPY, keys=RUN) -> DataFrame:
    parts = ["commission", "spread", "impact", "borrow"]
    return (
        daily.unpivot([*keys, "ts"], parts, "component", "v")
        .groupBy(*keys, "component")
        .agg(F.sum("v").alias("total"), (F.avg("v") * ppy).alias("ann_drag"))
    )


def episode_table(trades: DataFrame) -> DataFrame:
    tag = F.when(F.col("tag") == "", "untagged").otherwise(F.col("tag")).alias("tag")
    return trades.groupBy(tag).agg(
        F.min("ts").alias("start"),
        F.max("ts").alias("end"),
        F.count(F.lit(1)).alias("n_trades"),
        F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("pnl"),
        F.datediff(day(F.max("ts")), day(F.min("ts"))).cast("double").alias("duration_days"),
    )


# --- report blocks ---------------------------------------------------------


def rolling_stats(
    daily: DataFrame, bench: str | None = None, window: int = 252, points: int = 1500, ppy: float = PPY, keys=RUN
) -> DataFrame:
    """Rolling Sharpe, volatility and beta; warm-up rows dropped."""
    d = daily.filter(F.col("net").isNotNull())
    rolls = [Roll("_avg", "avg", "net", window), Roll("_sd", "std", "net", window)]
    if bench:
        # Covariance over the pairs, variance over the benchmark's own values.
        rolls += [Roll("_cov", "cov", "net", window, y=bench), Roll("_var", "var", bench, window)]
    d = rolling(d.withColumn("_rn", F.row_number().over(ordered(keys))), rolls, keys)
    cols = {"sharpe": div("_avg", "_sd") * math.sqrt(ppy), "vol": F.col("_sd") * math.sqrt(ppy)}
    if bench:
        cols["beta"] = div("_cov", F.when(F.col("_var") > 0, F.col("_var")))
    out = d.withColumns(cols).filter(F.col("_rn") >= window).drop("_rn", *[r.out for r in rolls])
    return downsample(out, list(keys), points)


def benchmark_stats(daily: DataFrame, ppy: float = PPY, keys=RUN, r="net", b="bench_ret", be="bench") -> DataFrame:
    """The benchmark's own statistics and the pair statistics against it."""
    both = F.col(r).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(r)), F.when(both, F.col(b))
    n = F.count(y)
    var = F.var_samp(y)
    beta = div(F.covar_samp(x, y), F.when(var > 0, var))
    d = x - y
    peak = F.max(be).over(cumulative(keys))
    return (
        daily.withColumn("_bdd", div(be, peak) - 1)
        .groupBy(*keys)
        .agg(
            sharpe(b, ppy).alias("bench_sharpe"),
            cagr(b, ppy).alias("bench_cagr"),
            F.when(F.count(b) > 2, F.stddev_samp(b) * math.sqrt(ppy)).alias("bench_vol"),
            F.min("_bdd").alias("bench_max_dd"),
            F.when(n > 2, beta).alias("beta"),
            F.when(n > 2, (F.avg(x) - beta * F.avg(y)) * ppy).alias("alpha_ann"),
            F.when(n > 2, correlation(x, y)).alias("corr"),
            F.when(n > 2, F.stddev_samp(d) * math.sqrt(ppy)).alias("te_ann"),
            F.when(n > 2, div(F.avg(d) * ppy, F.stddev_samp(d) * math.sqrt(ppy))).alias("ir"),
        )
    )


def trade_stats(trades: DataFrame, nav: float = 1.0, keys=RUN) -> DataFrame:
    p = F.col("pnl") / nav
    win, loss = F.when(p > 0, p), F.when(p < 0, p)
    return trades.filter(F.col("pnl").isNotNull()).groupBy(*keys).agg(
        F.count(p).alias("n"),
        F.avg(F.when(p > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        div(F.coalesce(F.sum(win), F.lit(0.0)), F.when(-F.sum(loss) > 0, -F.sum(loss))).alias("profit_factor"),
        F.avg(win).alias("avg_win"),
        F.avg(loss).alias("avg_loss"),
        F.avg(p).alias("expectancy"),
        F.max(p).alias("best"),
        F.min(p).alias("worst"),
    )


def average_hold(trades: DataFrame, keys=RUN) -> DataFrame:
    """Mean holding days, the k-th exit of a symbol closing its k-th entry.

    An exit that finds no open entry is ignored, as in a queue.  With e entries
    and x exits seen so far, the number of ignored exits is the running maximum
    of x - e, so the pairing stays a window and a join.
    """
    by = (*keys, "symbol")
    is_entry = F.col("reason") == "entry"
    is_exit = ~is_entry & F.col("pnl").isNotNull()
    t = trades.withColumns(
        {"_e": F.when(is_entry, 1).otherwise(0), "_x": F.when(is_exit, 1).otherwise(0)}
    ).filter((F.col("_e") + F.col("_x")) > 0)
    # Within a bar: rule exits, then entries, then universe exits at the close.
    turn = F.when(is_entry, 1).when(F.col("reason") == "delist", 2).otherwise(0)
    line = Window.partitionBy(*by).orderBy("ts", turn)
    w = line.rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumns({"_ne": F.sum("_e").over(w), "_nx": F.sum("_x").over(w)})
    t = t.withColumn(
        "_lost", F.greatest(F.lit(0), F.max(F.col("_nx") - F.col("_ne")).over(w))
    )
    prev_lost = F.coalesce(F.lag("_lost").over(line), F.lit(0))
    t = t.withColumn("_prev", prev_lost)
    entries = t.filter("_e = 1").select(*by, F.col("_ne").alias("k"), F.col("ts").alias("t0"))
    exits = t.filter("_x = 1 and _lost = _prev").select(
        *by, (F.col("_nx") - F.col("_lost")).alias("k"), F.col("ts").alias("t1")
    )
    held = F.datediff(day("t1"), day("t0")).cast("double")
    return entries.join(exits, [*by, "k"]).groupBy(*keys).agg(F.avg(held).alias("avg_hold_days"))


def attribution(
    positions: DataFrame,
    trades: DataFrame | None = None,
    daily: DataFrame | None = None,
    mode: str = "exact",
    top_n: int | None = None,
    keys=RUN,
) -> DataFrame:
    """Per-symbol contribution: exact, realised, or share of gross.

    All symbols, or the ``top_n`` best.  ``exact`` sums w * r; ``realised`` sums trade pnl; ``proxy`` splits each
    day's return by share of gross exposure.
    """
    by = [*keys, "symbol"]
    used = positions.groupBy(*by).agg(
        F.avg(F.abs("w")).alias("avg_weight"), F.sum(F.col("w") * F.col("r")).alias("_exact")
    )
    counts = (
        trades.groupBy(*by).agg(F.count(F.lit(1)).alias("n_trades"), F.sum("pnl").alias("_real"))
        if trades is not None
        else None
    )
    if mode == "proxy":
        gross = F.sum(F.abs("w")).over(Window.partitionBy(*keys, "ts"))
        share = positions.withColumn("_share", F.coalesce(div(F.abs("w"), gross), F.lit(0.0)))
        pnl = (
            share.select(*by, "ts", "_share")
            .join(daily.select(*keys, "ts", "net"), [*keys, "ts"])
            .groupBy(*by)
            .agg(F.sum(F.col("_share") * F.col("net")).alias("pnl"))
        )
        out = used.join(pnl, by, "left")
    else:
        out = used.withColumn("pnl", F.col("_exact"))
    if counts is not None:
        out = out.join(counts, by, "full")
        if mode == "realised":
            out = out.withColumn("pnl", F.col("_real"))
    else:
        out = out.withColumn("n_trades", F.lit(0).cast("long"))
    out = out.withColumn("n_trades", F.coalesce("n_trades", F.lit(0).cast("long")))
    seen = (
        (F.coalesce("avg_weight", F.lit(0.0)) != 0)
        | (F.coalesce("pnl", F.lit(0.0)) != 0)
        | (F.col("n_trades") > 0)
    )
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("pnl"), "symbol"))
    out = out.filter(seen).withColumn("rank", rank.cast("long")).select(*by, "pnl", "avg_weight", "n_trades", "rank")
    return out if top_n is None else out.filter(F.col("rank") <= top_n)


def is_oos(daily: DataFrame, r: str = "net", fraction: float = 0.7, ppy: float = PPY, keys=RUN) -> DataFrame:
    """Sharpe of the first part of the sample against the rest."""
    d = daily.filter(F.col(r).isNotNull())
    w = Window.partitionBy(*keys)
    d = d.withColumns(
        {"_i": F.row_number().over(w.orderBy("ts")), "_n": F.count(F.lit(1)).over(w)}
    ).withColumn("_k", F.floor(F.col("_n") * fraction))
    first = F.col("_i") <= F.col("_k")
    ok = (F.max("_n") >= 6) & (F.max("_k") >= 3) & (F.max("_n") - F.max("_k") >= 3)
    return d.groupBy(*keys).agg(
        F.when(ok, sharpe(F.when(first, F.col(r)), ppy)).alias("sharpe_is"),
        F.when(ok, sharpe(F.when(~first, F.col(r)), ppy)).alias("sharpe_oos"),
    )


def rebased(equity: DataFrame, value: str = "equity", keys=RUN) -> DataFrame:
    """Curves divided by their first non-zero value."""
    w = Window.partitionBy(*keys).orderBy("ts").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    first = F.first(F.when(F.col(value) != 0, F.col(value)), ignorenulls=True).over(w)
    return equity.withColumn("rebased", div(value, first))
