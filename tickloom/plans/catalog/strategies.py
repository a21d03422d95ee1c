"""Strategy queries (Q-*): weights or trade intents over the derived panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.scalar import day
from ...functions.scalar import rnd as R
from ...operators.align import snap
from ...operators.sessions import grid_of
from .. import adapters as A
from .. import strategies as X
from . import sqlbase as S
from .aggregates import atm
from .common import first_symbol_panel, others_flat
from .events import EARN_SQL, earnings, event_weights_sql
from .joins import stale_asof
from .machines import (
    BOOK_LEGS, DISC_STEP, FUND_M, FUND_SQL, NAV_SQL, PAIRS_BASE, SCORE_M, SCORE_SQL, SLOPE_M, SLOPE_SQL,
    curve_slope, discount_weights, funding_inputs, legs, n_pairs, score_weights, symbol_machine,
)
from .portfolio import ATR_SQL, BREAK_SQL, breakout_intents, overlay_sql
from .registry import query
from .signals import MOM, SIGN_SQL, VOL63, to_weights_sql, xover_sql

r = S.rnd
MASKED = "CASE WHEN in_universe THEN coalesce(w, 0) ELSE 0 END"
FIRST = "(SELECT min(symbol) FROM syms)"


def out(df, dp=6):
    return df.select("symbol", "ts", R("w", dp).alias("w"))


def sel(name, expr="w", dp=6):
    return f" SELECT symbol, ts, {r(expr, dp)} AS w FROM {name}"


def out_flat(spark, sf, w, dp=6):
    """Weights of the proxy instrument on the full grid, every other instrument flat."""
    return others_flat(spark, sf, out(w, dp))


def flat(query_):
    """Oracle of the same: ``query_`` has the proxy's symbol, ts and w."""
    head, body = query_.rsplit(" SELECT symbol, ts, ", 1) if " SELECT symbol, ts, " in query_ else query_.rsplit(f" SELECT {CURVE_MAP}, ts, ", 1)
    first = "symbol" if " SELECT symbol, ts, " in query_ else CURVE_MAP
    return f"{head} SELECT g.symbol, g.ts, coalesce(x.w, 0) AS w FROM grid g LEFT JOIN (SELECT {first}, ts, {body}) x ON x.symbol = g.symbol AND x.ts = g.ts"


CURVE_MAP = f"{FIRST} AS symbol"


def xs(key, signal, top, bottom=None, long_only=True, freq="ME", pre=(), src="panel", vol=None, **kw):
    """Oracle of a fractile strategy whose signal is one expression."""
    v = f", {vol} AS vol" if vol else ""
    return S.with_(
        S.PANEL, *pre, S.rebalance("rebal", freq), f"sg AS (SELECT *, {signal} AS signal{v} FROM {src})",
        S.xs_weights("x", "sg", top, top if bottom is None else bottom, long_only, **kw),
    ) + sel("x")


@query("Q-01", S.with_(*PAIRS_BASE, BOOK_LEGS) + sel("panel LEFT JOIN pw USING (symbol, pos)", MASKED))
def pairs(spark, sf):
    return out(X.pairs(A.panel(spark, sf), legs(spark, sf), n_pairs(spark, sf)))


@query("Q-02", S.with_(S.PANEL, SCORE_SQL, SCORE_M) + sel("score JOIN m USING (symbol, pos)", MASKED))
def residual_stat_arb(spark, sf):
    return out(score_weights(A.panel(spark, sf)))


@query(
    "Q-03",
    S.with_(
        S.PANEL, S.BASIS, S.HEDGES,
        f"""lt AS (SELECT symbol, ts, 0.05 * coalesce(last_value(CASE WHEN basis > 0.05 THEN 1 WHEN basis < 0.01 THEN 0 END IGNORE NULLS) {S.over()}, 0) AS w FROM basis),
lg AS (SELECT * FROM lt UNION ALL SELECT hedge, ts, -w FROM lt JOIN hedges USING (symbol)),
ls AS (SELECT symbol, ts, sum(w) AS w FROM lg GROUP BY 1, 2)""",
    )
    + sel("panel JOIN ls USING (symbol, ts)", MASKED),
)
def cash_and_carry(spark, sf):
    return out(X.cash_and_carry(A.basis(spark, sf), A.hedges(spark, sf)))


DISC_Q4 = symbol_machine(
    "disc", "w, held", "0.0::DOUBLE AS w, 0 AS held", DISC_STEP.replace("-1.5", "-2.5").replace("-0.001", "-0.01")
)


@query("Q-04", S.with_(S.PANEL, NAV_SQL, DISC_Q4) + sel("disc JOIN m USING (symbol, pos)", MASKED))
def nav_arbitrage(spark, sf):
    return out(discount_weights(A.panel(spark, sf)))


DEALS_SQL = """
dl AS (SELECT symbol, event_date, max(event_id) AS k FROM cev GROUP BY 1, 2),
dp AS (SELECT d.symbol, k, (SELECT count(*) FROM cal WHERE ts <= event_date) - 1 AS pb FROM dl d),
dj AS (SELECT p.symbol, a.pb + 1 AS pos, p.ts, p.close, b.close * (1 + (2 + k % 10) / 100.0::DOUBLE) AS offer
  FROM dp a JOIN panel b ON b.symbol = a.symbol AND b.pos = a.pb JOIN panel p ON p.symbol = a.symbol AND p.pos = a.pb + 1)"""


def deals(spark, sf):
    """Orders as cash offers 2-11 % above the last price at the announcement."""
    ev = A.corp_events(spark, sf).groupBy("symbol", "event_date").agg(F.max("event_id").alias("k"))
    ev = snap(ev, A.calendar(spark, sf), "event_date").drop("pos_fwd", "n_bars")
    px = A.panel(spark, sf).select("symbol", F.col("pos").alias("pos_back"), "close")
    offer = F.col("close") * (1 + (2 + F.col("k") % 10) / F.lit(100.0))
    return ev.join(px, ["symbol", "pos_back"]).select(
        F.col("symbol").alias("target_symbol"), F.col("event_date").alias("announce_date"), offer.alias("offer_price")
    )


def intent_out(df):
    cols = ["symbol", "ts", "side", R("stop").alias("stop"), R("take").alias("take"), "time_stop"]
    return df.select(*cols)


@query(
    "Q-05",
    S.with_(S.PANEL + S.EVENTS, DEALS_SQL)
    + f"""
SELECT symbol, ts, CAST(1 AS BIGINT) AS side, {r("close * 0.8")} AS stop, {r("offer")} AS take,
  least(92, (SELECT max(pos) FROM cal) - pos) AS time_stop
FROM dj WHERE pos + 1 < (SELECT count(*) FROM cal) AND offer > 0 AND close > 0 AND close < offer AND (offer / close - 1) * 365.0::DOUBLE / 120 BETWEEN 0.06 AND 0.30""",
)
def merger_arbitrage(spark, sf):
    return intent_out(X.merger_deals(A.panel(spark, sf), deals(spark, sf), A.calendar(spark, sf)))


@query(
    "Q-06",
    S.with_(
        S.PANEL, S.BASIS, S.rebalance("rebal", "W"),
        "cm AS (SELECT *, basis - lag(basis, 42) OVER (PARTITION BY symbol ORDER BY ts) AS mom FROM basis)",
        "cs AS (SELECT *, CASE WHEN ts IN (SELECT ts FROM rebal) THEN sign(mom) END AS sig FROM cm)",
    )
    + sel("cs", f"coalesce({S.ffill('sig', 30)}, 0) * 0.05"),
)
def calendar_spread(spark, sf):
    return out(X.calendar_spread(A.basis(spark, sf)))


@query(
    "Q-07",
    S.with_(
        S.PANEL, S.HEDGES,
        """tm AS (SELECT symbol AS b, hedge AS e, 1.0::DOUBLE AS ratio FROM hedges),
cj AS (SELECT b, e, p.ts, CASE WHEN q.close IS NOT NULL THEN greatest(q.close * ratio, 90) / nullif(p.close, 0) - 1 END AS gap
  FROM tm JOIN panel p ON p.symbol = b JOIN panel q ON q.symbol = e AND q.ts = p.ts),
cg AS (SELECT *, lag(gap) OVER (PARTITION BY b, e ORDER BY ts) > 0.02 AS live FROM cj),
cl AS (SELECT b AS symbol, ts, CASE WHEN live THEN 0.03::DOUBLE ELSE 0 END AS w FROM cg UNION ALL SELECT e, ts, CASE WHEN live THEN -0.018::DOUBLE ELSE 0 END FROM cg),
cw AS (SELECT symbol, ts, sum(w) AS w FROM cl GROUP BY 1, 2)""",
    )
    + sel("panel LEFT JOIN cw USING (symbol, ts)", MASKED),
)
def convertible_arbitrage(spark, sf):
    terms = A.hedges(spark, sf).select(F.col("symbol").alias("bond_symbol"), F.col("hedge").alias("equity_symbol"), F.lit(1.0).alias("conversion_ratio"))
    return out(X.convertibles(A.panel(spark, sf), terms))


@query("Q-08", S.with_(S.PANEL, S.rebalance(), MOM, S.xs_weights("x", "ms", 0.1, 0.1, True)) + sel("x"))
def equity_momentum(spark, sf):
    return out(X.equity_momentum(A.panel(spark, sf)))


def with_vol_sql(src):
    return f"sv AS (SELECT *, {VOL63} AS vol FROM {src})"


@query("Q-09", S.with_(S.PANEL, SIGN_SQL, with_vol_sql("sign_sig"), to_weights_sql("tw", "sv", 0.15, 0.4, 4.0)) + sel("tw"))
def ts_momentum(spark, sf):
    return out(X.ts_momentum(A.panel(spark, sf)))


PAIRED = "CASE WHEN ret IS NOT NULL AND mkt IS NOT NULL THEN {} END"
RESID_SQL = f"""
rm0 AS (SELECT *, avg(CASE WHEN in_universe THEN ret END) OVER (PARTITION BY ts) AS mkt FROM panel),
rm1 AS (SELECT *, CASE WHEN count({PAIRED.format("ret")}) {S.over(504, 1)} >= 252 THEN covar_samp({PAIRED.format("ret")}, {PAIRED.format("mkt")}) {S.over(504, 1)} END AS c,
  {S.roll("var_samp", "mkt", 504, 252, 1)} AS v FROM rm0),
rm2 AS (SELECT *, ret - c / nullif(v, 0) * mkt AS resid FROM rm1),
rm3 AS (SELECT *, ({S.roll("avg", "resid", 231, 115, 21)}) / nullif({S.roll("stddev_samp", "resid", 231, 115, 21)}, 0) AS signal FROM rm2)"""


@query("Q-10", S.with_(S.PANEL, S.rebalance(), RESID_SQL, S.xs_weights("x", "rm3", 0.1, 0.1, True)) + sel("x"))
def residual_momentum(spark, sf):
    return out(X.residual_momentum(A.panel(spark, sf)))


@query(
    "Q-11",
    S.with_(
        S.PANEL, S.rebalance(),
        f"""bk AS (SELECT sector, ts, avg(ret) AS r FROM panel GROUP BY 1, 2),
bm AS (SELECT sector, ts, ({S.roll("product", "(1 + r)", 126, 63, 0, "sector")}) - 1 AS mom FROM bk),
br AS (SELECT sector, ts, row_number() OVER (PARTITION BY ts ORDER BY mom DESC, sector) AS rk, count(*) OVER (PARTITION BY ts) AS n FROM bm WHERE mom IS NOT NULL),
bw AS (SELECT p.symbol, p.ts, p.in_universe, CASE WHEN p.ts IN (SELECT ts FROM rebal) AND max(b.n) OVER (PARTITION BY p.ts) >= 3 THEN
  CASE WHEN b.rk <= 3 AND p.in_universe THEN 1.0::DOUBLE / (3 * count(*) FILTER (WHERE p.in_universe) OVER (PARTITION BY p.ts, p.sector)) ELSE 0 END END AS dec
  FROM panel p LEFT JOIN br b USING (sector, ts)),
bh AS (SELECT symbol, ts, in_universe, {S.ffill("dec")} AS w FROM bw)""",
    )
    + sel("bh", MASKED),
)
def sector_momentum(spark, sf):
    return out(X.sector_momentum(A.panel(spark, sf)))


@query("Q-12", xs("Q-12", f"tr / nullif({S.roll('max', 'tr', 252, 126)}, 0)", 0.1))
def high_52_week(spark, sf):
    return out(X.high_52_week(A.panel(spark, sf)))


@query(
    "Q-13",
    S.with_(
        S.PANEL, S.rebalance(),
        f"""dm AS (SELECT symbol, ts, (0 + {S.pct("tr", 63)} + {S.pct("tr", 126)} + {S.pct("tr", 252)}) / 3 AS mom FROM panel),
dt AS (SELECT ts, arg_min(symbol, (-mom, symbol)) AS best, max(mom) AS top FROM dm WHERE mom IS NOT NULL AND symbol <> (SELECT max(symbol) FROM syms) GROUP BY ts),
dd AS (SELECT g.symbol, g.ts, CASE WHEN g.ts IN (SELECT ts FROM rebal) AND t.best IS NOT NULL THEN
  CASE WHEN g.symbol = CASE WHEN t.top > 0 THEN t.best ELSE (SELECT max(symbol) FROM syms) END THEN 1.0 ELSE 0 END END AS dec FROM grid g LEFT JOIN dt t USING (ts))""",
    )
    + sel("dd", f"coalesce({S.ffill('dec')}, 0)"),
)
def dual_momentum(spark, sf):
    return out(X.dual_momentum(A.panel(spark, sf)))


THIRDS = {"long_only": False, "weighting": "inverse_vol", "min_names": 3, "vol": VOL63}


@query("Q-14", xs("Q-14", S.pct("tr", 252), 0.33, **THIRDS))
def commodity_momentum(spark, sf):
    return out(X.long_return(A.panel(spark, sf), 252, 1.0))


@query("Q-15", S.with_(S.PANEL, xover_sql(), with_vol_sql("xover"), to_weights_sql("tw", "sv", 0.15, 0.4, 4.0)) + sel("tw", dp=5))
def managed_futures(spark, sf):
    return out(X.managed_futures(A.panel(spark, sf)), 5)


@query(
    "Q-16",
    S.with_(S.PANEL, ATR_SQL, BREAK_SQL)
    + f" SELECT symbol, ts, CAST(side AS BIGINT) AS side, {r('stop', 5)} AS stop, CAST(time_stop AS BIGINT) AS time_stop FROM intents",
)
def breakout(spark, sf):
    return breakout_intents(A.panel(spark, sf)).select("symbol", "ts", "side", R("stop", 5).alias("stop"), "time_stop")


CARRY = "sign({b}) * least(1, abs({b}) / 0.10)"


@query(
    "Q-17",
    S.with_(
        S.PANEL, SIGN_SQL, S.BASIS,
        f"""bl AS (SELECT s.symbol, s.sector, s.ts, s.in_universe, s.ret,
  least(greatest(0.6 * coalesce(signal, 0) + 0.4 * coalesce({CARRY.format(b="basis")}, 0), -1), 1) AS signal FROM sign_sig s JOIN basis b USING (symbol, ts))""",
        with_vol_sql("bl"), to_weights_sql("tw", "sv", 0.15, 0.4),
    )
    + sel("tw"),
)
def trend_plus_carry(spark, sf):
    return out(X.trend_plus_carry(A.basis(spark, sf)))


@query(
    "Q-18",
    xs(
        "Q-18", "avg(rf) OVER (PARTITION BY ts, sector) - rf", 0.2, long_only=False, freq="W",
        pre=(f"p5 AS (SELECT *, {S.pct('tr', 5)} AS rf FROM panel)",), src="p5",
    ),
)
def short_term_reversal(spark, sf):
    return out(X.short_term_reversal(A.panel(spark, sf)))


PANIC_SQL = f"""
pp AS (SELECT *, {S.roll("stddev_samp", "ret", 60, 30)} AS s60, {S.roll("stddev_samp", "ret", 5)} AS v5, {S.pct("close", 5)} AS rw FROM panel WHERE symbol = {FIRST}),
ct AS (SELECT *, coalesce(rw < -1.5 * s60 * sqrt(5) AND v5 > 1.5 * s60, FALSE) AS hit FROM pp)"""
PANIC_M = symbol_machine(
    "ct", "last, kept", "CAST(-1000000000 AS BIGINT) AS last, FALSE AS kept",
    "CASE WHEN x.hit AND x.pos - m.last > 5 THEN x.pos ELSE m.last END AS last, x.hit AND x.pos - m.last > 5 AS kept",
)


@query(
    "Q-19",
    S.with_(S.PANEL, PANIC_SQL, PANIC_M)
    + f" SELECT symbol, ts, {r('close * (1 - 2 * s60 * sqrt(5))')} AS stop, CAST(12 AS BIGINT) AS time_stop FROM ct JOIN m USING (symbol, pos) WHERE kept",
)
def panic_reversion(spark, sf):
    t = X.panic(first_symbol_panel(spark, sf))
    return t.select("symbol", "ts", R("stop").alias("stop"), "time_stop")


@query(
    "Q-20",
    S.with_(
        S.PANEL, ATR_SQL,
        f"""sw AS (SELECT *, {S.roll("avg", "close", 200, 100)} AS ma, {S.pct("close", 126)} AS mom, {S.roll("avg", "trange", 20, 10)} AS atr, {S.roll("max", "close", 10, 5)} AS swing FROM trs),
sp AS (SELECT *, (swing - close) / nullif(atr, 0) AS pull FROM sw), sq AS (SELECT *, lag(pull) OVER (PARTITION BY symbol ORDER BY ts) AS pp FROM sp)""",
    )
    + f""" SELECT symbol, ts, {r("close - 1.25 * atr", 5)} AS stop, {r("close + 2 * (close - (close - 1.25 * atr))", 5)} AS take FROM sq
WHERE close > ma AND mom > 0 AND pull >= 1.5 AND pp < 1.5""",
)
def swing_pullback(spark, sf):
    t = X.pullback(A.panel(spark, sf))
    return t.select("symbol", "ts", R("stop", 5).alias("stop"), R("take", 5).alias("take"))


V5_60 = f"v AS (SELECT *, {S.roll('stddev_samp', 'ret', 5)} AS v5, {S.roll('stddev_samp', 'ret', 60)} AS v60 FROM {{}})"


@query(
    "Q-21",
    flat(S.with_(S.PANEL, V5_60.format(f"panel WHERE symbol = {FIRST}"))
    + sel("v", "CASE WHEN close / nullif(open, 0) - 1 < 0 AND v5 > 1.2 * v60 THEN 1 ELSE 0 END")),
)
def overnight(spark, sf):
    return out_flat(spark, sf, X.overnight(first_symbol_panel(spark, sf)))


def carry_sql(target, signal=f"coalesce({CARRY.format(b='basis')}, 0)", extra="", src="basis"):
    return (S.PANEL, S.BASIS, *([extra] if extra else []), f"cb AS (SELECT * , {signal} AS signal FROM {src})", with_vol_sql("cb"), to_weights_sql("tw", "sv", target))


@query(
    "Q-22",
    S.with_(*carry_sql(0.08, f"coalesce({CARRY.format(b='basis')}, 0) * CASE WHEN v5 > 1.5 * v60 THEN 0.5 ELSE 1 END", V5_60.format("basis"), "v"))
    + sel("tw"),
)
def fx_carry(spark, sf):
    return out(X.carry_book(A.basis(spark, sf), 0.08, throttle=True))


DS = "basis - avg(basis) OVER (PARTITION BY symbol, month(ts) ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"
XZ = "(ds - avg(ds) OVER (PARTITION BY ts)) / nullif(stddev_samp(ds) OVER (PARTITION BY ts), 0)"


@query(
    "Q-23",
    S.with_(*carry_sql(0.10, f"coalesce(({S.clip(XZ, -2, 2)}) / 2, 0)", f"dsx AS (SELECT *, {DS} AS ds FROM basis)", "dsx")) + sel("tw"),
)
def commodity_carry(spark, sf):
    return out(X.commodity_carry(A.basis(spark, sf)))


@query("Q-24", S.with_(*carry_sql(0.06)) + sel("tw"))
def bond_carry(spark, sf):
    return out(X.carry_book(A.basis(spark, sf), 0.06))


def curve_out(spark, sf, **kw):
    """Machine on the curve's slope, as weights of the first symbol."""
    from ...operators import machines

    first = A.symbols(spark, sf).agg(F.min("symbol")).scalar()
    w = machines.slope_states(curve_slope(spark, sf), "symbol", **kw)
    return out_flat(spark, sf, w.select(first.alias("symbol"), "ts", "w"))


VC_STEP = """CASE WHEN x.s IS NULL THEN m.w WHEN m.w < 0 AND x.s >= 0.01 THEN m.w
  WHEN x.s > 0.03 THEN -0.1 ELSE 0 END AS w"""


@query(
    "Q-25",
    flat(S.with_(S.PANEL, S.CURVE, SLOPE_SQL, symbol_machine("slope", "w", "0.0::DOUBLE AS w", VC_STEP))
    + f" SELECT {CURVE_MAP}, ts, {r('w')} AS w FROM m JOIN cal USING (pos)"),
)
def vol_carry(spark, sf):
    return curve_out(spark, sf, size_short=0.10, size_long=0.10, use_long=False, long_max_age=None, reenter=False)


@query("Q-26", S.with_(*carry_sql(0.05)) + sel("tw", "w / (SELECT count(DISTINCT sector) FROM syms)"))
def cross_asset_carry(spark, sf):
    return out(X.cross_asset_carry(A.basis(spark, sf)))


@query(
    "Q-27",
    flat(S.with_(
        S.PANEL, S.SURFACE,
        f"""atv AS (SELECT ts, median(iv) AS atm FROM (SELECT *, min(expiry) OVER (PARTITION BY ts) AS e FROM surface) WHERE expiry = e GROUP BY ts),
vp AS (SELECT p.*, atm, sqrt({S.ewm("ret * ret", "pow(0.5::DOUBLE, 1.0::DOUBLE / 21)", 1)} * 1.0) * sqrt(252) AS rv FROM panel p LEFT JOIN atv USING (ts) WHERE symbol = {FIRST}),
vg AS (SELECT symbol, ts, {S.ffill("atm", 5)} - {S.shift("rv")} AS gap FROM vp)""",
    )
    + sel("vg", "CASE WHEN gap > 0.02 THEN -0.08 ELSE 0 END")),
)
def variance_premium(spark, sf):
    levels = atm(A.option_surface(spark, sf)).select(F.col("date").cast("timestamp_ntz").alias("ts"), "atm")
    return out_flat(spark, sf, X.variance_premium(first_symbol_panel(spark, sf), levels))


@query(
    "Q-28",
    flat(S.with_(S.PANEL, S.CURVE, SLOPE_SQL, SLOPE_M) + f" SELECT {CURVE_MAP}, ts, {r('w')} AS w FROM m JOIN cal USING (pos)"),
)
def term_structure(spark, sf):
    return curve_out(spark, sf)


@query(
    "Q-29",
    S.with_(
        S.PANEL, S.SURFACE,
        f"""dv AS (SELECT ts, median(iv) FILTER (WHERE symbol = {FIRST}) AS a, median(iv) FILTER (WHERE symbol <> {FIRST}) AS b FROM surface GROUP BY ts),
df AS (SELECT ts, {S.ffill("a", 5, "1")} AS a, {S.ffill("b", 5, "1")} AS b FROM cal LEFT JOIN dv USING (ts)),
dr AS (SELECT ts, least(greatest(a / nullif(b, 0), 0), 2) AS rho FROM df),
dq AS (SELECT ts, coalesce(rho > CASE WHEN count(rho) {S.over(252, 1, "1")} >= 63 THEN quantile_cont(rho, 0.7) {S.over(252, 1, "1")} END, FALSE) AS live FROM dr)""",
    )
    + sel("grid JOIN dq USING (ts)", f"CASE WHEN NOT live THEN 0 WHEN symbol = {FIRST} THEN -0.05 ELSE 0.05 / ((SELECT count(*) FROM syms) - 1) END"),
)
def dispersion(spark, sf):
    first = A.symbols(spark, sf).agg(F.min("symbol")).scalar()
    return out(X.dispersion(A.panel(spark, sf), A.option_surface(spark, sf), first))


@query(
    "Q-30",
    flat(S.with_(S.PANEL, f"one AS (SELECT *, 1.0::DOUBLE AS w FROM panel WHERE symbol = {FIRST})", overlay_sql("one", 1.5))
    + sel("one JOIN ov USING (pos)", "w * cur")),
)
def vol_overlay(spark, sf):
    return out_flat(spark, sf, X.constant_overlay(first_symbol_panel(spark, sf)))


@query(
    "Q-31",
    S.with_(S.PANEL + S.EVENTS, EARN_SQL, "pos_side AS (SELECT * FROM sided WHERE side > 0)",
            event_weights_sql("x", "pos_side", 2, 60, 0.02, "report_ts", "side")) + sel("x"),
)
def earnings_drift(spark, sf):
    return out(X.earnings_drift(A.panel(spark, sf), earnings(spark, sf), A.calendar(spark, sf)))


@query(
    "Q-32",
    S.with_(S.PANEL + S.EVENTS, "dl AS (SELECT * FROM cev WHERE status = 'O')",
            event_weights_sql("x", "dl", 0, 40, 0.03)) + sel("x"),
)
def index_deletions(spark, sf):
    ev = A.corp_events(spark, sf).select(
        "symbol", F.when(F.col("status") == "O", "delete").otherwise("add").alias("action"),
        F.col("event_date").alias("effective_date"),
    )
    return out(X.index_deletions(A.panel(spark, sf), ev, A.calendar(spark, sf)))


@query("Q-33", S.with_(S.PANEL + S.EVENTS, event_weights_sql("x", "cev", 2, 126, 0.03)) + sel("x"))
def buybacks(spark, sf):
    return out(X.buybacks(A.panel(spark, sf), A.corp_events(spark, sf), A.calendar(spark, sf)))


@query(
    "Q-34",
    S.with_(
        S.PANEL + S.EVENTS,
        "lp AS (SELECT DISTINCT symbol, (SELECT count(*) FROM cal WHERE ts < event_date) AS pf FROM cev)",
    )
    + f""" SELECT p.symbol, p.ts, CAST(-1 AS BIGINT) AS side, {r("close * 1.1")} AS stop, CAST(10 AS BIGINT) AS time_stop
FROM lp JOIN panel p ON p.symbol = lp.symbol AND p.pos = pf - 8 WHERE pf - 7 >= 1 AND pf < (SELECT count(*) FROM cal) AND close > 0""",
)
def lockup_expiry(spark, sf):
    ev = A.corp_events(spark, sf).select("symbol", F.col("event_date").alias("lockup_expiry"))
    t = X.lockups(A.panel(spark, sf), ev, A.calendar(spark, sf))
    return t.select("symbol", "ts", "side", R("stop").alias("stop"), "time_stop")


def releases(spark, sf):
    """Orders as macro releases: the largest of a month one kind, the smallest another."""
    ev = A.corp_events(spark, sf).withColumn("month", F.trunc(day("event_date"), "month"))
    ends = ev.groupBy("month").agg(F.max("magnitude").alias("top"), F.min("magnitude").alias("bottom"))
    m = F.col("magnitude")
    kind = F.when(m == F.col("top"), "cpi").when(m == F.col("bottom"), "cbr_rate").otherwise("other")
    return ev.join(ends, "month").select(F.col("event_date").alias("release_ts"), kind.alias("kind"))


@query(
    "Q-35",
    flat(S.with_(
        S.PANEL + S.EVENTS,
        """mm AS (SELECT event_date, magnitude, max(magnitude) OVER m AS top, min(magnitude) OVER m AS bottom FROM cev
  WINDOW m AS (PARTITION BY date_trunc('month', event_date))),
mr AS (SELECT DISTINCT (SELECT count(*) FROM cal WHERE ts < event_date) AS pf FROM mm WHERE magnitude = top OR magnitude = bottom)""",
    )
    + sel(f"panel WHERE symbol = {FIRST}", "CASE WHEN EXISTS (SELECT 1 FROM mr WHERE pf < (SELECT count(*) FROM cal) AND panel.pos BETWEEN pf - 1 AND pf) THEN 1 ELSE 0 END")),
)
def macro_days(spark, sf):
    return out_flat(spark, sf, X.macro_days(first_symbol_panel(spark, sf), releases(spark, sf), A.calendar(spark, sf)))


METRICS = {"eps": 0, "book": 1, "gross_profit": 2}


def facts(spark, sf, metric):
    ev = A.corp_events(spark, sf).filter(F.col("event_id") % 3 == METRICS[metric])
    return ev.groupBy("symbol", F.col("event_date").alias("ts")).agg(
        (F.avg(F.round(F.col("magnitude") * 100).cast("long")) / 100).alias("value")
    )


def facts_sql(name, k):
    return f"""
{name}f AS (SELECT symbol, event_date AS ts, avg(CAST(round(magnitude * 100) AS BIGINT)) / 100 AS value FROM cev
  WHERE event_id % 3 = {k} GROUP BY 1, 2),
{name}u AS (SELECT symbol, ts, max(bar) AS bar, max(value) AS value FROM (
    SELECT symbol, ts, 1 AS bar, NULL::DOUBLE AS value FROM grid UNION ALL SELECT symbol, ts, 0, value FROM {name}f)
  WHERE symbol IN (SELECT symbol FROM syms) GROUP BY 1, 2),
{name}n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM {name}u),
{name}a AS (SELECT *, {S.ffill("value")} AS v, {S.ffill("CASE WHEN value IS NOT NULL THEN rn END")} AS vn FROM {name}n),
{name} AS (SELECT symbol, ts, CASE WHEN rn - vn <= 252 THEN v END AS {name} FROM {name}a WHERE bar = 1)"""


def z_sql(x):
    w = "OVER (PARTITION BY ts)"
    return f"coalesce(CASE WHEN count({x}) {w} >= 2 THEN {S.clip(f'({x} - avg({x}) {w}) / nullif(stddev_pop({x}) {w}, 0)', -3, 3)} END, 0)"


@query(
    "Q-36",
    S.with_(
        S.PANEL + S.EVENTS, S.rebalance(), facts_sql("eps", 0), facts_sql("book", 1), facts_sql("gp", 2),
        f"""vq AS (SELECT p.*, eps / nullif(close, 0) AS ep, book / nullif(close, 0) AS bp, gp / nullif(book, 0) AS gb
  FROM panel p JOIN eps USING (symbol, ts) JOIN book USING (symbol, ts) JOIN gp USING (symbol, ts)),
vz AS (SELECT *, {z_sql("ep")} * 0.5 + {z_sql("bp")} * 0.5 AS val, {z_sql("gb")} AS q FROM vq),
vs AS (SELECT *, CASE WHEN val <> 0 THEN 0.6 * val + 0.4 * q END AS signal FROM vz)""",
        S.xs_weights("x", "vs", 0.2, 0.2, True, sector_neutral=True, min_names=2),
    )
    + sel("x"),
)
def value_quality(spark, sf):
    p = A.panel(spark, sf)
    bars = p.select("symbol", "ts")
    aligned = [stale_asof(bars, facts(spark, sf, m), 252) for m in METRICS]
    return out(X.value_quality(p, *aligned))


@query("Q-37", xs("Q-37", f"-{S.pct('tr', 1260)}", 0.33, **THIRDS))
def cross_asset_value(spark, sf):
    return out(X.long_return(A.panel(spark, sf), 1260, -1.0))


@query("Q-38", xs("Q-38", f"-({S.roll('stddev_pop', 'ret', 252, 84, 1)})", 0.2, sector_neutral=True, min_names=2))
def low_volatility(spark, sf):
    return out(X.low_volatility(A.panel(spark, sf)))


@query(
    "Q-39",
    flat(S.with_(S.PANEL, S.rebalance())
    + sel(f"panel WHERE symbol = {FIRST}", "CASE WHEN EXISTS (SELECT 1 FROM cal e JOIN rebal USING (ts) WHERE panel.pos BETWEEN e.pos AND e.pos + 3) THEN 1 ELSE 0 END")),
)
def month_turn(spark, sf):
    return out_flat(spark, sf, X.month_turn(first_symbol_panel(spark, sf), A.calendar(spark, sf)))


ROLLS_SQL = """
rl AS (SELECT DISTINCT 'N_' || (event_id % 30) AS code, event_date AS a, event_date + INTERVAL 4 DAY AS z FROM cev),
rs AS (SELECT code, min(symbol) AS symbol FROM (SELECT DISTINCT code FROM rl) JOIN syms ON contains(symbol, code) GROUP BY code),
rp AS (SELECT DISTINCT symbol, (SELECT count(*) FROM cal WHERE ts < a) AS pa, (SELECT count(*) FROM cal WHERE ts <= z) - 1 AS pz FROM rl JOIN rs USING (code))"""


def rolls(spark, sf):
    """Orders as roll windows of asset codes, mapped to symbols."""
    ev = A.corp_events(spark, sf)
    r0 = ev.select(
        F.concat(F.lit("N_"), (F.col("event_id") % 30).cast("string")).alias("code"),
        day("event_date").alias("roll_start"), F.date_add(day("event_date"), 4).alias("roll_end"),
    ).distinct()
    length = F.length("symbol")
    s = A.symbols(spark, sf).select("symbol").withColumn("i", F.explode(F.sequence(F.lit(1), length)))
    s = s.withColumn("n", F.explode(F.sequence(F.lit(1), length - F.col("i") + 1)))
    keys = s.groupBy(F.substr("symbol", F.col("i"), F.col("n")).alias("code")).agg(F.min("symbol").alias("symbol"))
    return r0.join(keys, "code").select("symbol", "roll_start", "roll_end")


@query(
    "Q-40",
    S.with_(S.PANEL + S.EVENTS, ROLLS_SQL)
    + sel("panel", "CASE WHEN EXISTS (SELECT 1 FROM rp WHERE rp.symbol = panel.symbol AND pa < (SELECT count(*) FROM cal) AND panel.pos BETWEEN pa - 5 AND pz) THEN -0.03 ELSE 0 END"),
)
def roll_pressure(spark, sf):
    return out(X.roll_pressure(A.panel(spark, sf), rolls(spark, sf), A.calendar(spark, sf)))


@query(
    "Q-41",
    S.with_(
        S.PANEL, S.rebalance(),
        """mm AS (SELECT symbol, date_trunc('month', ts) AS m, arg_max(tr, ts) AS px FROM panel GROUP BY 1, 2),
mr AS (SELECT *, px / nullif(lag(px) OVER (PARTITION BY symbol ORDER BY m), 0) - 1 AS ret FROM mm),
mh AS (SELECT symbol, m, CASE WHEN count(ret) OVER w >= 2 THEN avg(ret) OVER w END AS h FROM mr
  WINDOW w AS (PARTITION BY symbol, month(m) ORDER BY m ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
sg AS (SELECT p.*, h AS signal FROM panel p LEFT JOIN mh ON mh.symbol = p.symbol AND CAST(mh.m + INTERVAL 11 MONTH AS DATE) = CAST(date_trunc('month', p.ts) AS DATE))""",
        S.xs_weights("x", "sg", 0.2, 0.2, True),
    )
    + sel("x"),
)
def seasonality(spark, sf):
    return out(X.seasonality(A.panel(spark, sf)))


@query(
    "Q-42",
    S.with_(S.PANEL, FUND_SQL.replace("ret * 100", "ret * 109.5"), FUND_M) + sel("m JOIN cal USING (pos)", "CASE WHEN on_ THEN 0.3 ELSE 0 END"),
)
def funding_arbitrage(spark, sf):
    """Funding rates of ret / 10 per eight hours: 1095 intervals a year."""
    from ...operators import machines

    return out(machines.funding_states(funding_inputs(A.panel(spark, sf), 24.0 / 8.0 * 365.0 / 10.0)))


@query(
    "Q-43",
    S.with_(
        S.PANEL,
        f"""vq AS (SELECT symbol, CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS ts, l_linestatus AS venue,
    (min(l_extendedprice / l_quantity) + max(l_extendedprice / l_quantity)) / 2 AS mid
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nations ON s_nationkey = n_nationkey GROUP BY 1, 2, 3),
vf AS (SELECT g.symbol, g.ts, v.venue, {S.ffill("q.mid", 2, "g.symbol, v.venue").replace("ORDER BY ts", "ORDER BY g.ts")} AS mid
  FROM grid g CROSS JOIN (SELECT DISTINCT l_linestatus AS venue FROM lineitem) v LEFT JOIN vq q ON q.symbol = g.symbol AND q.ts = g.ts AND q.venue = v.venue),
vd AS (SELECT symbol, ts, max(mid) / nullif(min(mid), 0) - 1 AS gap FROM vf GROUP BY 1, 2),
vh AS (SELECT symbol, ts, CASE WHEN lag(gap) OVER (PARTITION BY symbol ORDER BY ts) > 1.5 THEN 1.0 ELSE 0 END AS hit FROM vd)""",
    )
    + sel("vh", f"max(hit) {S.over(5)} * 0.1"),
)
def cross_venue(spark, sf):
    quotes = venue_quotes(spark, sf)
    venues = A.table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("venue")).distinct()
    lists = venues.agg(F.collect_set("venue")).scalar()  # two line statuses
    grid = grid_of(A.days(spark, sf), A.symbols(spark, sf).select("symbol", F.explode(lists).alias("venue")))
    return out(X.cross_venue(grid.select("symbol", "venue", "ts"), quotes, min_bps=15000))


def venue_quotes(spark, sf):
    """Daily mid per nation and line status (the venue), merged before the shuffle."""
    lines = A.table(spark, sf, "lineitem").select(
        "l_suppkey", day("l_shipdate").alias("d"), F.col("l_linestatus").alias("venue"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
    )
    q = lines.join(A.sellers(spark, sf), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_nationkey", "d", "venue")
    q = q.agg(((F.min("px") + F.max("px")) / 2).alias("mid"))
    names = F.broadcast(A.nations(spark, sf).select("n_nationkey", "symbol"))
    return q.join(names, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "symbol", "venue", F.col("d").cast("timestamp_ntz").alias("ts"), "mid"
    )
