"""The strategy plans: panel (and event tables) → weights or trade intents.

Each function is a thin composition of operators.  Weights are the target
before the execution lag, as columns ``symbol, ts, w``.  A strategy on a single
proxy instrument returns that instrument's rows only; all others are flat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import window as W
from ..functions.ewm import Ewm, ewm
from ..functions.rolling import Roll, rolling
from ..functions.scalar import clip, day, div
from ..functions.stats import xs_zscore
from ..operators import carry, events, machines, risk, spread
from ..operators import tsignal as T
from ..operators.align import snap
from ..operators.sessions import is_period_end, turn_of_month
from ..operators.xsection import fractile_weights, hold

def by_date() -> WindowSpec:
    return Window.partitionBy("ts")


def masked(df: DataFrame, w: Column | str = "w") -> DataFrame:
    w = F.col(w) if isinstance(w, str) else w
    return df.withColumn("w", F.when(F.col("in_universe"), F.coalesce(w, F.lit(0.0))).otherwise(0.0))


def flag(cond: Column, size: float) -> Column:
    return F.when(cond, F.lit(float(size))).otherwise(0.0)


# --- cross-sectional -------------------------------------------------------


def equity_momentum(p, formation=252, skip=21, top=0.1, **kw):
    return fractile_weights(p.withColumn("signal", T.skip_return("tr", formation, skip)), top, top, **kw)


def residual_momentum(p, beta_window=504, formation=231, skip=21, top=0.1):
    """Information ratio of returns net of lagged market beta."""
    p = p.withColumn("mkt", F.avg(F.when(F.col("in_universe"), F.col("ret"))).over(by_date()))
    half = beta_window // 2
    p = rolling(p, [Roll("c", "cov", "ret", beta_window, half, 1, y="mkt"), Roll("v", "var", "mkt", beta_window, half, 1)])
    p = p.withColumn("resid", F.col("ret") - div("c", "v") * F.col("mkt"))
    few = {"n": formation, "min_periods": formation // 2, "lag": skip}
    p = rolling(p, [Roll("m", "avg", "resid", **few), Roll("s", "std", "resid", **few)])
    return fractile_weights(p.withColumn("signal", div("m", "s")), top, top)


def sector_momentum(p, formation=126, top_n=3):
    """Best sectors by compound basket return, equal weight inside each."""
    basket = p.groupBy("sector", "ts").agg(F.avg("ret").alias("r"))
    growth = Roll("g", "product", "g", formation, formation // 2)
    basket = rolling(basket.withColumn("g", 1 + F.col("r")), [growth], ("sector",))
    basket = basket.select("sector", "ts", (F.col("g") - 1).alias("mom")).filter(F.col("mom").isNotNull())
    rank = F.row_number().over(by_date().orderBy(F.desc("mom"), "sector"))
    n = F.count(F.lit(1)).over(by_date())
    basket = basket.select("sector", "ts", rank.alias("rk"), n.alias("n_sec"))
    p = p.withColumn("rb", is_period_end("ME")).join(basket, ["sector", "ts"], "left")
    names = F.count(F.when(F.col("in_universe"), 1)).over(Window.partitionBy("ts", "sector"))
    valid = F.max("n_sec").over(by_date()) >= max(2, top_n)
    p = p.withColumns({"names": names, "valid": valid})
    pick = F.when((F.col("rk") <= top_n) & F.col("in_universe"), div(F.lit(1.0), F.col("names") * top_n))
    decided = F.when(F.col("rb") & F.col("valid"), F.coalesce(pick, F.lit(0.0)))
    return hold(p.withColumn("decided", decided), "decided")


def high_52_week(p, window=252, top=0.1):
    p = rolling(p, [Roll("hi", "max", "tr", window, window // 2)])
    return fractile_weights(p.withColumn("signal", div("tr", "hi")), top, top)


def dual_momentum(p, lookbacks=(63, 126, 252)):
    """The best risk asset when its momentum is positive, else the last symbol."""
    mom = sum((W.pct_change("tr", n) for n in lookbacks), F.lit(0.0)) / len(lookbacks)
    p = p.withColumns({"rb": is_period_end("ME"), "mom": mom}).repartition("ts")
    last = F.max("symbol").over(by_date())
    p = p.withColumn("defensive", last)
    risky = F.when((F.col("symbol") != F.col("defensive")) & F.col("mom").isNotNull(), F.col("mom"))
    p = p.withColumn("risky", risky)
    best = F.min(F.when(F.col("risky").isNotNull(), F.struct((-F.col("risky")).alias("m"), "symbol"))).over(by_date())
    p = p.withColumn("best", best)
    holding = F.when(F.col("best.m") < 0, F.col("best.symbol")).otherwise(F.col("defensive"))
    decided = F.when(F.col("rb") & F.col("best").isNotNull(), flag(F.col("symbol") == holding, 1.0))
    return hold(p.withColumn("decided", decided), "decided", drop_out=False)


def long_return(p, n, sign, top=0.33):
    """Thirds by ``sign`` times the n-bar return, inverse-volatility legs."""
    p = T.trailing_vol(p.withColumn("signal", sign * W.pct_change("tr", n)))
    return fractile_weights(p, top, top, False, weighting="inverse_vol", min_names=3)


def short_term_reversal(p, formation=5, top=0.2):
    p = p.withColumn("rf", W.pct_change("tr", formation))
    sec = F.avg("rf").over(Window.partitionBy("ts", "sector"))
    return fractile_weights(p.withColumn("signal", sec - F.col("rf")), top, top, False, freq="W")


def value_quality(p, eps, book, gross_profit, value_weight=0.6, top=0.2):
    """Blend of earnings and book yield with profitability, ranked in sectors.

    ``eps`` etc. are ``(symbol, ts, value)`` facts already aligned to bars.
    """
    for name, facts in (("eps", eps), ("book", book), ("gp", gross_profit)):
        p = p.join(facts.select("symbol", "ts", F.col("value").alias(name)), ["symbol", "ts"], "left")
    p = p.withColumns({"ep": div("eps", "close"), "bp": div("book", "close"), "gb": div("gp", "book")})
    p = p.repartition("ts").withColumns({f"z_{c}": xs_zscore(c, min_names=2) for c in ("ep", "bp", "gb")})
    z = {c: F.coalesce(f"z_{c}", F.lit(0.0)) for c in ("ep", "bp", "gb")}
    p = p.withColumn("value_z", z["ep"] * 0.5 + z["bp"] * 0.5)
    blend = value_weight * F.col("value_z") + (1 - value_weight) * z["gb"]
    p = p.withColumn("signal", F.when(F.col("value_z") != 0, blend))
    return fractile_weights(p, top, top, True, sector_neutral=True, min_names=2)


def low_volatility(p, window=252, top=0.2):
    p = T.trailing_vol(p, window).withColumn("signal", -F.col("vol"))
    return fractile_weights(p, top, top, True, sector_neutral=True, min_names=2)


def seasonality(p, years=5, top=0.2):
    """On the last bar of a month, rank by earlier years' mean return of the
    next calendar month."""
    month = F.trunc(day("ts"), "month")
    last = F.max_by("tr", F.when(F.col("tr").isNotNull(), F.col("ts")))
    m = p.groupBy("symbol", month.alias("m")).agg(last.alias("px"))
    m = m.withColumn("r", div("px", F.lag("px").over(W.ordered(order="m"))) - 1)
    m = m.withColumn("moy", F.month("m"))
    mean = W.roll(F.avg, "r", years, 2, keys=("symbol", "moy"), order="m")
    # A month's history predicts the same month a year on, used one month before it.
    used = m.select("symbol", F.add_months("m", 11).alias("m"), mean.alias("signal"))
    return fractile_weights(p.withColumn("m", month).join(used, ["symbol", "m"], "left"), top, top)


# --- time series -----------------------------------------------------------


def ts_momentum(p, target=0.15):
    p = T.trailing_vol(T.sign_ensemble(p))
    return T.to_weights(p, target, group="sector", group_cap=0.4, max_gross=4.0)


def managed_futures(p, target=0.15):
    p = T.trailing_vol(T.crossover_ensemble(p))
    return T.to_weights(p, target, group="sector", group_cap=0.4, max_gross=4.0)


def trend_plus_carry(p, w_trend=0.6, target=0.15):
    p = T.sign_ensemble(p, out="trend").withColumn("carry", carry.carry_ts("basis"))
    blend = w_trend * F.coalesce("trend", F.lit(0.0)) + (1 - w_trend) * F.coalesce("carry", F.lit(0.0))
    p = T.trailing_vol(p.withColumn("_blend", blend).withColumn("signal", clip("_blend", -1, 1)))
    return T.to_weights(p, target, group="sector", group_cap=0.4)


def carry_book(p, target, hurdle=0.0, throttle=False):
    """Time-series carry, optionally halved when short-term volatility jumps."""
    p = p.withColumn("signal", F.coalesce(carry.carry_ts("basis", hurdle), F.lit(0.0)))
    if throttle:
        p = rolling(p, [Roll("v5", "std", "ret", 5), Roll("v60", "std", "ret", 60)])
        jumpy = F.coalesce(F.col("v5") > 1.5 * F.col("v60"), F.lit(False))
        p = p.withColumn("signal", F.when(jumpy, F.col("signal") * 0.5).otherwise(F.col("signal")))
    return T.to_weights(T.trailing_vol(p), target)


def commodity_carry(p, target=0.10, clamp=2.0):
    p = p.withColumn("ds", carry.deseasonalized("basis"))
    p = p.withColumn("z", carry.carry_xs("ds", clamp))
    p = p.withColumn("signal", F.coalesce(F.col("z") / clamp, F.lit(0.0)))
    return T.to_weights(T.trailing_vol(p), target)


def cross_asset_carry(p, target=0.05):
    """Equal blend of one carry sleeve per class: each symbol sits in one sleeve."""
    w = carry_book(p, target)
    n = p.agg(F.count_distinct("sector")).scalar()
    return w.withColumn("w", F.col("w") / n)


def calendar_spread(p, window=42, size=0.05, hold_weeks=6):
    mom = W.diff("basis", window)
    p = p.withColumns({"rb": is_period_end("W"), "mom": mom})
    p = p.withColumn("sig", F.when(F.col("rb"), F.signum("mom")))
    held = W.ffill("sig", hold_weeks * 5)
    return p.withColumn("w", F.coalesce(held, F.lit(0.0)) * size)


def cash_and_carry(p, hedges, hurdle=0.05, leave=0.01, size=0.10):
    """Long spot while the basis latch is on, short its future where mapped."""
    live = W.latch(F.col("basis") > hurdle, F.col("basis") < leave)
    spot = p.withColumn("w", flag(live == 1, size / 2)).select("symbol", "ts", "w")
    short = spot.join(hedges, "symbol").select(
        F.col("hedge").alias("symbol"), "ts", (-F.col("w")).alias("w")
    )
    both = spot.unionByName(short).groupBy("symbol", "ts").agg(F.sum("w").alias("w"))
    return masked(p.select("symbol", "ts", "in_universe").join(both, ["symbol", "ts"], "left"))


def convertibles(p, terms, cheap=0.02, delta=0.6, size=0.03, floor=90.0):
    """Long bond, short part of the equity while the bond lags its proxy value.

    ``terms`` (bond_symbol, equity_symbol, conversion_ratio) is a dimension.
    """
    px = p.select("symbol", "ts", "close")
    t = terms.filter(F.col("conversion_ratio") > 0)
    b = px.join(t, F.col("symbol") == F.col("bond_symbol")).withColumnRenamed("close", "bond")
    e = px.select(F.col("symbol").alias("equity_symbol"), "ts", F.col("close").alias("eq"))
    j = b.join(e, ["equity_symbol", "ts"])
    proxy = F.greatest(F.col("eq") * F.col("conversion_ratio"), F.lit(float(floor)))
    gap = F.when(F.col("eq").isNotNull(), div(proxy, "bond") - 1)
    j = j.withColumn("gap", gap)
    j = j.withColumn("on", F.lag("gap").over(W.ordered(("bond_symbol", "equity_symbol"))) > cheap)
    long = j.select(F.col("bond_symbol").alias("symbol"), "ts", flag(F.col("on"), size).alias("w"))
    short = j.select(F.col("equity_symbol").alias("symbol"), "ts", flag(F.col("on"), -size * delta).alias("w"))
    both = long.unionByName(short).groupBy("symbol", "ts").agg(F.sum("w").alias("w"))
    return masked(p.select("symbol", "ts", "in_universe").join(both, ["symbol", "ts"], "left"))


def overnight(p, threshold=0.0, mult=1.2, exposure=1.0):
    p = rolling(p, [Roll("v5", "std", "ret", 5), Roll("v60", "std", "ret", 60)])
    down = div("close", "open") - 1 < threshold
    return p.withColumn("w", flag(down & (F.col("v5") > mult * F.col("v60")), exposure))


def constant_overlay(p):
    """Full weight on the proxy, scaled by the volatility overlay."""
    base = p.withColumns({"w": F.lit(1.0), "run_id": F.lit("run")})
    return risk.vol_overlay(base, cap=1.5)


# --- options and term structure --------------------------------------------


def variance_premium(p, atm, min_gap=0.02, window=21, size=0.08):
    """Short while implied exceeds lagged realised volatility.

    ``atm`` is one row per date: bounded by the calendar.
    """
    p = ewm(p.withColumn("rv", F.col("ret") * F.col("ret")), [Ewm("rv", "mean", "rv", halflife=window)])
    p = p.withColumn("rv", F.sqrt(F.col("rv") * 252.0)).join(F.broadcast(atm), "ts", "left")
    gap = W.ffill("atm", 5) - W.shift("rv")
    return p.withColumn("gap", gap).withColumn("w", flag(F.col("gap") > min_gap, -size))


def dispersion(p, surface, first: Column, q=0.7, window=252, size=0.05):
    """Short the index proxy, long the others, when relative volatility is high."""
    is_index = F.col("underlying_symbol") == first
    iv = surface.groupBy("date").agg(
        F.median(F.when(is_index, F.col("iv"))).alias("a"), F.median(F.when(~is_index, F.col("iv"))).alias("b")
    )
    days = p.groupBy("ts").agg(F.count_distinct("symbol").alias("n")).withColumn("k", F.lit("market"))
    d = days.join(iv.withColumnRenamed("date", "d"), day("ts") == F.col("d"), "left")
    d = d.withColumns({"a": W.ffill("a", 5, ("k",)), "b": W.ffill("b", 5, ("k",))})
    d = d.withColumn("x", div("a", "b")).withColumn("rho", clip("x", 0, 2))
    bar = W.roll(lambda x: F.percentile(x, q), "rho", window, 63, 1, ("k",))
    d = d.select("ts", "n", F.coalesce(F.col("rho") > bar, F.lit(False)).alias("on"))
    w = F.when(F.col("symbol") == first, -size).otherwise(F.lit(size) / (F.col("n") - 1))
    return p.select("symbol", "ts").join(F.broadcast(d), "ts").withColumn("w", F.when(F.col("on"), w).otherwise(0.0))


# --- events ----------------------------------------------------------------


def earnings_drift(p, earnings, cal_, lag=2, hold_bars=60, weight=0.02):
    s = events.surprise_side(p, earnings, cal_).filter(F.col("side") > 0).drop("pos_back", "n_bars")
    return events.event_weights(p, s, cal_, lag, hold_bars, weight, date="report_ts", side="side")


def index_deletions(p, ev, cal_, hold_bars=40, weight=0.03):
    gone = ev.filter(F.col("action") == "delete")
    return events.event_weights(p, gone, cal_, 0, hold_bars, weight, date="effective_date")


def buybacks(p, ev, cal_, min_pct=0.0, lag=2, hold_bars=126, weight=0.03):
    if min_pct > 0:
        ev = ev.filter((F.col("kind") != "buyback") | (F.coalesce("pct_of_shares", F.lit(0.0)) >= min_pct))
    return events.event_weights(p, ev, cal_, lag, hold_bars, weight, date="event_date")


def macro_days(p, releases, cal_, kinds=("cbr_rate", "cpi"), before=1, after=0, exposure=1.0):
    """Full exposure around selected releases (set, not added)."""
    hits = releases.filter(F.col("kind").isin(*kinds)).select("release_ts").distinct()
    at = snap(hits, cal_, "release_ts").filter(F.col("pos_fwd") < F.col("n_bars"))
    first = F.greatest(F.lit(0).cast("long"), F.col("pos_fwd") - before)
    last = F.least(F.col("n_bars") - 1, F.col("pos_fwd") + after)
    from ..operators.align import event_window

    covered = event_window(at, first, last).select("pos").distinct().withColumn("on", F.lit(True))
    out = p.join(F.broadcast(covered), "pos", "left")
    return out.withColumn("w", flag(F.col("on"), exposure))


def month_turn(p, cal_, before=1, after=3, exposure=1.0):
    near = turn_of_month(cal_, before, after).select("ts", F.lit(True).alias("on"))
    return p.join(F.broadcast(near), "ts", "left").withColumn("w", flag(F.col("on"), exposure))


def roll_pressure(p, rolls, cal_, before=5, size=0.03):
    """Short from a few bars before a roll starts until it ends (set, not added).

    ``rolls``: symbol, roll_start, roll_end.
    """
    spans = rolls.select("symbol", "roll_start", "roll_end").distinct()
    a = snap(spans, cal_, "roll_start").withColumnRenamed("pos_fwd", "a").drop("pos_back", "n_bars")
    z = snap(a, cal_, "roll_end").filter(F.col("a") < F.col("n_bars"))
    first = F.greatest(F.lit(0).cast("long"), F.col("a") - before)
    return events.set_exposure(p, z, first, F.col("pos_back"), -size)


def cross_venue(grid, quotes, min_bps=50.0, size=0.10, max_hold=5):
    """Hold while venues disagreed on any of the last bars.

    ``quotes``: symbol, venue, ts, mid; ``grid``: every symbol, venue and bar.
    """
    q = grid.join(quotes, ["symbol", "venue", "ts"], "left")
    q = q.withColumn("mid", W.ffill("mid", 2, ("symbol", "venue")))
    d = q.groupBy("symbol", "ts").agg(F.max("mid").alias("hi"), F.min("mid").alias("lo"))
    d = d.withColumn("gap", div("hi", "lo") - 1)
    d = d.withColumn("hit", F.coalesce(W.shift("gap") > min_bps / 1e4, F.lit(False)).cast("double"))
    return d.withColumn("w", F.max("hit").over(W.trailing(max_hold)) * size)


# --- intents ---------------------------------------------------------------


def intents(df, side, stop, take, time_stop, size, tag) -> DataFrame:
    none = F.lit(None).cast("double")
    return df.select(
        "symbol", "ts", "pos", F.lit(side).cast("long").alias("side"), stop.alias("stop"),
        (none if take is None else take).alias("take"), F.lit(time_stop).cast("long").alias("time_stop")
        if isinstance(time_stop, int) else time_stop.cast("long").alias("time_stop"),
        F.lit(float(size)).alias("size"),
        F.concat_ws(":", F.lit(tag), "symbol", day("ts").cast("string")).alias("tag"),
    )


def merger_deals(p, deals, cal_, hurdle=0.06, tail=0.30, days=120, downside=0.20):
    """Cash deals whose annualised spread lies in the band."""
    at = snap(deals, cal_, "announce_date").withColumn("pos", F.col("pos_back") + 1)
    at = at.filter((F.col("pos") + 1 < F.col("n_bars")) & (F.col("offer_price") > 0))
    j = at.withColumnRenamed("target_symbol", "symbol").join(p.select("symbol", "pos", "ts", "close"), ["symbol", "pos"])
    ann = (F.col("offer_price") / F.col("close") - 1) * 365.0 / days
    j = j.filter((F.col("close") > 0) & (F.col("close") < F.col("offer_price"))).filter(ann.between(hurdle, tail))
    keep = F.least(F.lit(int(days * 252 / 365) + 10), F.col("n_bars") - F.col("pos") - 1)
    return intents(j, 1, F.col("close") * (1 - downside), F.col("offer_price"), keep, 0.008, "deal")


def panic(p, win=5, sigma=1.5, mult=1.5, stop_sigma=2.0, time_stop=12, cool=5):
    """Buy a volatile sell-off, at most once per cooldown."""
    p = rolling(p, [Roll("s60", "std", "ret", 60, 30), Roll("v5", "std", "ret", 5)])
    p = p.withColumns({"rw": W.pct_change("close", win), "sd": F.col("s60") * F.sqrt(F.lit(float(win)))})
    hit = (F.col("rw") < -sigma * F.col("sd")) & (F.col("v5") > mult * F.col("s60"))
    p = p.withColumn("trigger", F.coalesce(hit, F.lit(False)))
    kept = machines.cooldown(p, bars=cool).filter("kept").select("symbol", "pos")
    j = p.join(kept, ["symbol", "pos"], "left_semi")
    return intents(j, 1, F.col("close") * (1 - stop_sigma * F.col("sd")), None, time_stop, 0.02, "panic")


def pullback(p, ma=200, mom=126, depth=1.5, stop_atr=1.25, target_r=2.0, time_stop=18):
    """Buy a pull-back inside an uptrend on its first bar."""
    p = p.withColumns(
        {"trange": W.true_range("high", "low", "close"), "swing": W.roll(F.max, "close", 10, 5), "mom": W.pct_change("close", mom)}
    )
    p = rolling(p, [Roll("atr", "avg", "trange", 20, 10), Roll("ma", "avg", "close", ma, ma // 2)])
    p = p.withColumn("pull", div(F.col("swing") - F.col("close"), "atr"))
    p = p.withColumn("prev_pull", W.shift("pull"))
    up = (F.col("close") > F.col("ma")) & (F.col("mom") > 0)
    j = p.filter(up & (F.col("pull") >= depth) & (F.col("prev_pull") < depth) & (F.col("atr") != 0))
    stop = F.col("close") - stop_atr * F.col("atr")
    take = F.col("close") + target_r * (F.col("close") - stop)
    return intents(j, 1, stop, take, time_stop, 0.005, "pb")


def lockups(p, ev, cal_, before=7, after=3, stop_pct=0.10):
    """Short ahead of a lock-up expiry."""
    at = snap(ev, cal_, "lockup_expiry").filter(
        (F.col("pos_fwd") - before >= 1) & (F.col("pos_fwd") < F.col("n_bars"))
    )
    at = at.withColumn("pos", F.col("pos_fwd") - before - 1).select("symbol", "pos").distinct()
    j = at.join(p.select("symbol", "pos", "ts", "close"), ["symbol", "pos"]).filter(F.col("close") > 0)
    return intents(j, -1, F.col("close") * (1 + stop_pct), None, before + after, 0.004, "lockup")


def pairs(p, legs, n_pairs, **kw):
    states = machines.pair_states(spread.pair_signals(legs, **kw))
    book = spread.pair_book(states, n_pairs)
    return masked(p.select("symbol", "ts", "in_universe").join(book, ["symbol", "ts"], "left"))
