"""Pair-spread and state-machine queries (SPR-*, SM-*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ...functions import window as W
from ...functions.rolling import Roll, rolling
from ...functions.scalar import clip, day, div, positive
from ...functions.scalar import rnd as R
from ...operators import align, carry, machines, spread
from ...operators.tsignal import trailing_vol
from .. import adapters as A
from . import sqlbase as S
from .aggregates import LEGS_SQL
from .joins import pair_list
from .registry import query

r = S.rnd

REFIT_SQL = """
rf AS (SELECT pair_id, pos AS refit FROM legs WHERE pos >= 252 AND (pos - 252) % 21 = 0),
fw AS (SELECT r.pair_id, r.refit, l.pos, l.a, l.b FROM rf r JOIN legs l ON l.pair_id = r.pair_id AND l.pos < r.refit AND l.pos >= r.refit - 252),
fit AS (SELECT pair_id, refit, CASE WHEN count(*) FILTER (WHERE a > 0 AND b > 0) >= 3
  THEN regr_slope(ln(CASE WHEN a > 0 AND b > 0 THEN a END), ln(CASE WHEN a > 0 AND b > 0 THEN b END)) END AS beta FROM fw GROUP BY 1, 2),
fs AS (SELECT pair_id, refit, pos, ln(a) - beta * ln(b) AS s FROM fw JOIN fit USING (pair_id, refit) WHERE a > 0 AND b > 0 AND beta IS NOT NULL),
fl AS (SELECT *, lag(s) OVER (PARTITION BY pair_id, refit ORDER BY pos) AS p FROM fs),
fh0 AS (SELECT pair_id, refit, regr_slope(s - p, p) AS b, count(s) AS n FROM fl GROUP BY 1, 2),
fh AS (SELECT pair_id, refit, CASE WHEN n < 10 THEN NULL WHEN b >= -1e-12 THEN 'inf'::DOUBLE WHEN 1 + b <= 0 THEN 0 ELSE -ln(2) / ln(1 + b) END AS hl FROM fh0),
fits AS (SELECT fit.pair_id, fit.refit, beta, hl, coalesce(isfinite(hl) AND hl BETWEEN 5 AND 40, FALSE) AS ok FROM fit LEFT JOIN fh USING (pair_id, refit)),
inf AS (SELECT l.*, f.beta, f.hl, coalesce(f.ok, FALSE) AS ok FROM legs l LEFT JOIN fits f ON f.pair_id = l.pair_id
  AND f.refit = CASE WHEN l.pos >= 252 THEN l.pos - (l.pos - 252) % 21 END)"""

Z_SQL = """
zr AS (SELECT i.pair_id, i.pos, count(*) FILTER (WHERE h.a > 0 AND h.b > 0) AS n,
    avg(ln(h.a) - i.beta * ln(h.b)) FILTER (WHERE h.a > 0 AND h.b > 0) AS mu,
    stddev_pop(ln(h.a) - i.beta * ln(h.b)) FILTER (WHERE h.a > 0 AND h.b > 0) AS sd
  FROM inf i JOIN legs h ON h.pair_id = i.pair_id AND h.pos >= i.pos - 63 AND h.pos < i.pos WHERE i.beta IS NOT NULL GROUP BY 1, 2),
zs AS MATERIALIZED (SELECT i.*, CASE WHEN n >= 47 AND sd >= 1e-12 AND a > 0 AND b > 0 THEN (ln(a) - beta * ln(b) - mu) / sd END AS z
  FROM inf i LEFT JOIN zr USING (pair_id, pos))"""


def legs(spark, sf):
    return align.legs(pair_list(spark, sf), A.panel(spark, sf))


def n_pairs(spark, sf):
    return pair_list(spark, sf).agg(F.count("*")).scalar()


@query("SPR-01", S.with_(S.PANEL, LEGS_SQL, REFIT_SQL) + f" SELECT pair_id, ts, {r('beta')} AS beta FROM inf")
def hedge_in_force(spark, sf):
    return spread.hedge_ratios(legs(spark, sf)).select("pair_id", "ts", R("beta").alias("beta"))


@query(
    "SPR-02",
    S.with_(S.PANEL, LEGS_SQL, REFIT_SQL)
    + f" SELECT pair_id, refit, {r('CASE WHEN isfinite(hl) THEN hl END', 4)} AS half_life, ok AS tradable FROM fits",
)
def half_life_filter(spark, sf):
    f = spread.refits(legs(spark, sf))
    hl = F.when(F.col("hl_fit") != float("inf"), F.col("hl_fit"))
    return f.select("pair_id", F.col("refit").cast("long").alias("refit"), R(hl, 4).alias("half_life"), F.col("ok_fit").alias("tradable"))


@query("SPR-03", S.with_(S.PANEL, LEGS_SQL, REFIT_SQL, Z_SQL) + f" SELECT pair_id, ts, {r('z', 5)} AS z FROM zs")
def spread_z(spark, sf):
    return spread.pair_signals(legs(spark, sf)).select("pair_id", "ts", R("z", 5).alias("z"))


# One step per bar: state = (side, entry position, z and beta at entry, blocked).
PAIR_STEP = """
CASE WHEN z IS NULL THEN 'skip'
  WHEN side <> 0 THEN CASE WHEN NOT ok THEN 'filter' WHEN abs(z) > 4 THEN 'stop' WHEN abs(z) < 0.5 THEN 'target'
    WHEN m.pos + 1 - entry >= 126 THEN 'time' ELSE 'hold' END
  WHEN ok AND NOT (blocked AND NOT abs(z) < 0.5) AND abs(z) > 2 AND abs(z) <= 4 THEN 'enter' ELSE 'flat' END"""

MACHINE_SQL = f"""
m AS (
  SELECT DISTINCT pair_id, CAST(-1 AS BIGINT) AS pos, 0 AS side, CAST(-1 AS BIGINT) AS entry, FALSE AS blocked,
    NULL::DOUBLE AS ze, NULL::DOUBLE AS be, 'flat' AS act, 0 AS position FROM zs
  UNION ALL
  SELECT pair_id, pos, CASE WHEN act = 'enter' THEN CASE WHEN z > 0 THEN -1 ELSE 1 END WHEN act IN ('hold', 'skip') THEN side ELSE 0 END,
    CASE WHEN act = 'enter' THEN pos ELSE entry END,
    CASE WHEN act IN ('filter', 'stop', 'target', 'time') THEN TRUE WHEN z IS NOT NULL AND abs(z) < 0.5 THEN FALSE ELSE blocked END,
    CASE WHEN act = 'enter' THEN z ELSE ze END, CASE WHEN act = 'enter' THEN beta ELSE be END, act,
    CASE WHEN act = 'enter' THEN CASE WHEN z > 0 THEN -1 ELSE 1 END WHEN act = 'hold' THEN side ELSE 0 END
  FROM (SELECT m.pair_id, m.pos + 1 AS pos, m.side, m.entry, m.blocked, m.ze, m.be, z.z, z.beta, {PAIR_STEP} AS act
    FROM m JOIN zs z ON z.pair_id = m.pair_id AND z.pos = m.pos + 1))"""

PAIRS_BASE = (S.PANEL, LEGS_SQL, REFIT_SQL, Z_SQL, MACHINE_SQL)


def states(spark, sf):
    return machines.pair_states(spread.pair_signals(legs(spark, sf)))


@query(
    "SM-01",
    S.with_(*PAIRS_BASE)
    + """ SELECT pair_id, ts, CAST(position AS BIGINT) AS position,
CASE WHEN act IN ('filter', 'stop', 'target', 'time') THEN act END AS reason FROM m JOIN cal USING (pos)""",
)
def pair_machine(spark, sf):
    return states(spark, sf).select("pair_id", "ts", "position", "reason")


BOOK_LEGS = """
pb AS (SELECT sa, sb, m.pos, position, z.beta, (1.0::DOUBLE / (SELECT count(*) FROM pairs)) / (1 + coalesce(abs(z.beta), 0)) AS unit
  FROM m JOIN zs z ON z.pair_id = m.pair_id AND z.pos = m.pos),
pl AS (SELECT sa AS symbol, pos, position * unit AS w FROM pb
  UNION ALL SELECT sb, pos, -position * coalesce(beta, 0) * unit FROM pb),
pw AS (SELECT symbol, pos, sum(w) AS w FROM pl GROUP BY 1, 2)"""


@query(
    "SPR-04",
    S.with_(*PAIRS_BASE, BOOK_LEGS)
    + f" SELECT symbol, p.ts, {r('CASE WHEN in_universe THEN coalesce(w, 0) ELSE 0 END')} AS w FROM panel p LEFT JOIN pw USING (symbol, pos)",
)
def pair_book(spark, sf):
    book = spread.pair_book(states(spark, sf), n_pairs(spark, sf))
    p = A.panel(spark, sf).select("symbol", "ts", "in_universe")
    w = F.when(F.col("in_universe"), F.coalesce("w", F.lit(0.0))).otherwise(0.0)
    return p.join(book, ["symbol", "ts"], "left").select("symbol", "ts", R(w).alias("w"))


@query(
    "SPR-05",
    S.with_(*PAIRS_BASE)
    + f"""
SELECT m.pair_id, m.entry AS entry_pos, m.pos AS exit_pos, CAST(-sign(ze) AS BIGINT) AS side, {r("be")} AS beta, {r("ze", 5)} AS z_entry,
  {r("z", 5)} AS z_exit, m.pos - m.entry AS bars_held, act AS reason
FROM m JOIN zs z ON z.pair_id = m.pair_id AND z.pos = m.pos WHERE act IN ('filter', 'stop', 'target', 'time')
UNION ALL SELECT pair_id, entry, NULL, side, {r("be")}, {r("ze", 5)}, NULL, pos - entry, 'open' FROM m
WHERE pos = (SELECT max(pos) FROM cal) AND side <> 0""",
)
def pair_ledger(spark, sf):
    t = machines.pair_ledger(states(spark, sf))
    return t.select(
        "pair_id", "entry_pos", "exit_pos", "side", R("beta").alias("beta"), R("z_entry", 5).alias("z_entry"),
        R("z_exit", 5).alias("z_exit"), "bars_held", "reason",
    )


# --- machines over symbols -------------------------------------------------


def symbol_machine(src: str, state: str, init: str, step: str, where: str = "") -> str:
    """Recursive walk over bars, one row per symbol and bar.

    ``step`` selects the new state columns from ``m`` (previous) and ``x`` (the
    bar's inputs from ``src``).
    """
    return f"""
m AS (
  SELECT DISTINCT symbol, CAST(-1 AS BIGINT) AS pos, {init} FROM {src}
  UNION ALL
  SELECT x.symbol, x.pos, {step} FROM m JOIN {src} x ON x.symbol = m.symbol AND x.pos = m.pos + 1)"""


def residual_scores(panel, win: int = 60, max_half_life: float = 15.0):
    """Score and tradable flag of cumulated sector residuals."""
    sec = F.avg("ret").over(Window.partitionBy("ts", "sector"))
    p = panel.withColumn("resid", F.coalesce(F.col("ret") - sec, F.lit(0.0)))
    p = rolling(p, [Roll("x", "sum", "resid", win)]).withColumn("xp", W.shift("x"))
    p = rolling(
        p,
        [
            Roll("mu", "avg", "x", win, win // 2),
            Roll("sd", "std", "x", win, win // 2),
            Roll("phi", "corr", "x", win, y="xp"),
        ],
    )
    p = p.withColumn("s", div(F.col("x") - F.col("mu"), "sd"))
    phi = F.col("phi")
    hl = -F.ln(F.lit(2.0)) / F.ln(clip(phi, 0.01, 0.999))
    return p.withColumn("tradable", F.coalesce(hl <= max_half_life, F.lit(False)))


SCORE_SQL = f"""
sr AS (SELECT *, coalesce(ret - avg(ret) OVER (PARTITION BY ts, sector), 0) AS resid FROM panel),
sx AS (SELECT *, {S.roll("sum", "resid", 60)} AS x FROM sr),
sy AS (SELECT *, (x - ({S.roll("avg", "x", 60, 30)})) / nullif({S.roll("stddev_samp", "x", 60, 30)}, 0) AS s, lag(x) OVER (PARTITION BY symbol ORDER BY ts) AS xp FROM sx),
sc AS (SELECT *, CASE WHEN count(CASE WHEN x IS NOT NULL THEN xp END) {S.over(60)} >= 60 THEN corr(x, xp) {S.over(60)} END AS phi FROM sy),
score AS (SELECT symbol, ts, pos, in_universe, CASE WHEN isfinite(s) THEN s END AS s,
  coalesce(-ln(2) / ln(least(greatest(CASE WHEN isfinite(phi) THEN phi END, 0.01), 0.999)) <= 15 AND isfinite(phi), FALSE) AS ok FROM sc)"""

SCORE_STEP = """CASE WHEN x.s IS NULL OR x.pos = 0 THEN 0.0::DOUBLE
  WHEN m.w = 0 THEN CASE WHEN x.ok AND x.s < -1.25 THEN 0.02 WHEN x.ok AND x.s > 1.25 THEN -0.02 ELSE 0 END
  WHEN m.w > 0 THEN CASE WHEN x.s > -0.5 THEN 0 ELSE m.w END
  ELSE CASE WHEN x.s < 0.75 THEN 0 ELSE m.w END END"""
SCORE_M = symbol_machine("score", "w", "0.0::DOUBLE AS w", SCORE_STEP)


@query(
    "SM-02",
    S.with_(S.PANEL, SCORE_SQL, SCORE_M)
    + f" SELECT s.symbol, s.ts, {r('CASE WHEN in_universe THEN w ELSE 0 END')} AS w FROM score s JOIN m USING (symbol, pos)",
)
def score_machine(spark, sf):
    return score_weights(A.panel(spark, sf)).select("symbol", "ts", R("w").alias("w"))


def score_weights(panel, **kw):
    p = residual_scores(panel)
    w = machines.score_states(p, **kw).select("symbol", "ts", "w")
    m = panel.select("symbol", "ts", "in_universe").join(w, ["symbol", "ts"])
    return m.withColumn("w", F.when(F.col("in_universe"), F.col("w")).otherwise(0.0))


NAV_SQL = f"""
nv AS (SELECT symbol, ts, CASE WHEN isodow(CAST(ts AS DATE)) = 5 THEN avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 41 PRECEDING AND CURRENT ROW) END AS nav FROM panel),
nd AS (SELECT p.symbol, p.ts, p.pos, p.in_universe, p.close / nullif({S.ffill("n.nav", None, "p.symbol").replace("ORDER BY ts", "ORDER BY p.ts")}, 0) - 1 AS d FROM panel p JOIN nv n ON n.symbol = p.symbol AND n.ts = p.ts),
disc AS (SELECT *, (d - ({S.roll("avg", "d", 252, 63, 1)})) / nullif({S.roll("stddev_samp", "d", 252, 63, 1)}, 0) AS z FROM nd)"""
DISC_STEP = """
  CASE WHEN x.pos = 0 THEN 0.0::DOUBLE WHEN m.w = 0 THEN CASE WHEN x.z < -1.5 AND x.d < -0.001 THEN 0.04 ELSE 0 END
    WHEN coalesce(x.z >= 0, FALSE) OR m.held + 1 >= 63 THEN 0 ELSE m.w END AS w,
  CASE WHEN m.w = 0 THEN 0 ELSE m.held + 1 END AS held"""
DISC_M = symbol_machine("disc", "w, held", "0.0::DOUBLE AS w, 0 AS held", DISC_STEP)


def nav_discounts(panel, window: int = 252):
    """Discount to a net asset value published on Fridays, and its z-score."""
    nav = F.when(F.weekday(day("ts")) == 4, F.avg("close").over(W.trailing(42)))
    p = panel.withColumn("nav", nav)
    p = p.withColumn("d", div("close", W.ffill("nav")) - 1)
    mp = window // 4
    p = rolling(p, [Roll("mu", "avg", "d", window, mp, 1), Roll("sd", "std", "d", window, mp, 1)])
    return p.withColumn("z", div(F.col("d") - F.col("mu"), "sd"))


@query(
    "SM-03",
    S.with_(S.PANEL, NAV_SQL, DISC_M)
    + f" SELECT d.symbol, d.ts, {r('CASE WHEN in_universe THEN w ELSE 0 END')} AS w FROM disc d JOIN m USING (symbol, pos)",
)
def discount_machine(spark, sf):
    return discount_weights(A.panel(spark, sf), z_entry=-1.5, abs_discount=-0.001).select("symbol", "ts", R("w").alias("w"))


def discount_weights(panel, **kw):
    w = machines.discount_states(nav_discounts(panel), **kw).select("symbol", "ts", "w")
    m = panel.select("symbol", "ts", "in_universe").join(w, ["symbol", "ts"])
    return m.withColumn("w", F.when(F.col("in_universe"), F.col("w")).otherwise(0.0))


SLOPE_SQL = f"""
kk AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY expiry) AS rn FROM curve WHERE expiry > CAST(ts AS DATE)),
ff AS (SELECT ts, max(settle) FILTER (WHERE rn = 2) / nullif(max(settle) FILTER (WHERE rn = 1), 0) - 1 AS s FROM kk WHERE rn <= 2 GROUP BY ts HAVING count(*) = 2),
slope AS (SELECT 'curve' AS symbol, ts, pos, {S.ffill("s", 3, "1")} AS s FROM cal LEFT JOIN ff USING (ts))"""
SLOPE_AGE = "CASE WHEN x.s < 0 THEN m.age + 1 ELSE 0 END"
SLOPE_MID = "CASE WHEN m.w < 0 AND x.s < 0.01 THEN 0 WHEN m.w > 0 AND x.s > 0 THEN 0 ELSE m.w END"
SLOPE_STEP = f"""
  CASE WHEN x.s IS NULL THEN m.w WHEN {SLOPE_MID} = 0 THEN CASE WHEN x.s > 0.03 THEN -0.08
    WHEN x.s < -0.02 AND {SLOPE_AGE} <= 10 THEN 0.12 ELSE 0 END ELSE m.w END AS w,
  CASE WHEN x.s IS NULL THEN m.age ELSE {SLOPE_AGE} END AS age"""
SLOPE_M = symbol_machine("slope", "w, age", "0.0::DOUBLE AS w, 0 AS age", SLOPE_STEP)


def curve_slope(spark, sf):
    """Front slope on the calendar, filled for three bars."""
    f = carry.front_pair(A.vol_curve(spark, sf)).select(F.col("date").cast("timestamp_ntz").alias("ts"), "slope12")
    c = A.calendar(spark, sf).join(f, "ts", "left").withColumn("symbol", F.lit("curve"))
    return c.withColumn("slope", W.ffill("slope12", 3))


@query("SM-04", S.with_(S.BARS, S.CURVE, SLOPE_SQL, SLOPE_M) + f" SELECT ts, {r('w')} AS w FROM m JOIN cal USING (pos)")
def slope_machine(spark, sf):
    return machines.slope_states(curve_slope(spark, sf), "symbol").select("ts", R("w").alias("w"))


FUND_SQL = f"""
fd AS (SELECT symbol, ts, pos, {S.ffill("CASE WHEN volume IS NOT NULL THEN ret * 100 END", 3)} AS daily FROM panel),
fund AS (SELECT symbol, ts, pos, {S.roll("avg", "daily", 7, 3, 1)} AS trail,
  CASE WHEN count(*) {S.over(3, 1)} >= 3 THEN sum(CAST(coalesce(daily < 0, FALSE) AS INTEGER)) {S.over(3, 1)} END AS neg FROM fd)"""
FUND_STEP = """CASE WHEN m.on_ THEN NOT (coalesce(x.trail < 0.05, FALSE) OR coalesce(x.neg >= 3, FALSE)) ELSE coalesce(x.trail > 0.10, FALSE) END AS on_"""
FUND_M = symbol_machine("fund", "on_", "FALSE AS on_", FUND_STEP)


def funding_inputs(panel, scale: float = 100.0):
    """Annual funding rate per bar (scaled return on trading bars), its trail
    and the count of negative days."""
    daily = W.ffill(F.when(F.col("volume").isNotNull(), F.col("ret") * scale), 3)
    p = panel.withColumn("daily", daily)
    neg = F.coalesce(F.col("daily") < 0, F.lit(False)).cast("int")
    return p.withColumns(
        {"trail": W.roll(F.avg, "daily", 7, 3, 1), "neg_run": W.roll(F.sum, neg, 3, None, 1).cast("double")}
    )


@query(
    "SM-05",
    S.with_(S.PANEL, FUND_SQL, FUND_M) + f" SELECT m.symbol, ts, {r('CASE WHEN on_ THEN 0.3 ELSE 0 END')} AS w FROM m JOIN cal USING (pos)",
)
def funding_machine(spark, sf):
    return machines.funding_states(funding_inputs(A.panel(spark, sf))).select("symbol", "ts", R("w").alias("w"))


BAND_SQL = f"""
bv AS (SELECT symbol, ts, pos, CASE WHEN isfinite(v) AND v > 1e-12 THEN least(greatest(0.1 / v, 0.3), 2) END AS raw FROM (
  SELECT *, ({S.roll("stddev_pop", "ret", 20, 10, 1)}) * sqrt(252) AS v FROM panel))"""
BAND_STEP = "CASE WHEN x.raw IS NOT NULL AND (m.cur IS NULL OR abs(x.raw - m.cur) > 0.15 * abs(m.cur)) THEN x.raw ELSE m.cur END AS cur"
BAND_M = symbol_machine("bv", "cur", "NULL::DOUBLE AS cur", BAND_STEP)


@query("SM-06", S.with_(S.PANEL, BAND_SQL, BAND_M) + f" SELECT m.symbol, ts, {r('cur')} AS scalar FROM m JOIN cal USING (pos)")
def band(spark, sf):
    p = trailing_vol(A.panel(spark, sf), 20, 10, ann=252.0, out="v")
    p = p.withColumn("raw", clip(div(F.lit(0.1), positive("v")), 0.3, 2.0))
    return machines.rebalance_band(p, "symbol").select("symbol", "ts", R("scalar").alias("scalar"))


COOL_SQL = """
ct AS (SELECT symbol, ts, pos, coalesce(ret > 0.01, FALSE) AS hit FROM panel)"""
COOL_STEP = """CASE WHEN x.hit AND x.pos - m.last > 5 THEN x.pos ELSE m.last END AS last, x.hit AND x.pos - m.last > 5 AS kept"""
COOL_M = symbol_machine("ct", "last, kept", "CAST(-1000000000 AS BIGINT) AS last, FALSE AS kept", COOL_STEP)


@query("SM-07", S.with_(S.PANEL, COOL_SQL, COOL_M) + " SELECT m.symbol, ts, kept FROM m JOIN cal USING (pos)")
def cooldown(spark, sf):
    p = A.panel(spark, sf).withColumn("trigger", F.coalesce(F.col("ret") > 0.01, F.lit(False)))
    return machines.cooldown(p).select("symbol", "ts", "kept")
