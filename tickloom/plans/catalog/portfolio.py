"""Risk, cost, accounting and outcome queries (RSK-*, CST-*, PNL-*, TRD-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import window as W
from ...functions.rolling import Roll, rolling
from ...functions.scalar import rnd as R
from ...operators import accounting, costs, outcomes, risk
from .. import adapters as A
from . import sqlbase as S
from .common import sample_book, sample_weights, with_adv
from .registry import query
from .windows import ATR_SQL

r = S.rnd
PANEL = S.with_(S.PANEL)
BOOK = S.with_(S.PANEL, S.book(), S.accounts())
HL20 = "pow(0.5::DOUBLE, 1.0::DOUBLE / 20)"


# --- risk ------------------------------------------------------------------


@query(
    "RSK-01",
    PANEL
    + f"""
, e AS (SELECT symbol, ts, sqrt({S.ewm("ret * ret", HL20, 20)}) * sqrt(252) AS v, ({S.roll("stddev_samp", "ret", 20)}) * sqrt(252) AS q FROM panel)
,
k AS (SELECT *, pow({HL20}, -CAST(pos AS DOUBLE)) AS wt FROM panel WHERE ret IS NOT NULL),
m AS (SELECT symbol, ts, count(*) {S.over()} AS n, sum(wt) {S.over()} AS sw, sum(wt * ret) {S.over()} AS sx,
  sum(wt * ret * ret) {S.over()} AS sxx, sum(wt * wt) {S.over()} AS sww FROM k),
d AS (SELECT p.symbol, p.ts, last_value(CASE WHEN n >= 20 THEN sqrt(greatest((sxx / sw - (sx / sw) ** 2) * sw * sw / nullif(sw * sw - sww, 0), 0)) END IGNORE NULLS) {S.over().replace("symbol", "p.symbol").replace("ts", "p.ts")} * sqrt(252) AS s
  FROM panel p LEFT JOIN m USING (symbol, ts))
SELECT symbol, ts, {r(S.shift("v"))} AS ewma, {r(S.shift("q"))} AS rolling, {r(S.shift("s"))} AS ewma_std FROM e JOIN d USING (symbol, ts)""",
)
def ex_ante_vol(spark, sf):
    p = risk.ex_ante_vol(A.panel(spark, sf), "ret", "ewma")
    p = risk.ex_ante_vol(p, "ret", "rolling", "rolling")
    p = risk.ex_ante_vol(p, "ret", "ewma_std", "ewma_std")
    return p.select("symbol", "ts", *[R(c).alias(c) for c in ("ewma", "rolling", "ewma_std")])


EX_SQL = f"""
ev AS (SELECT *, sqrt({S.ewm("ret * ret", HL20, 20)}) * sqrt(252) AS v0 FROM panel),
exv AS (SELECT *, {S.shift("v0")} AS vol, sign(ret) AS signal FROM ev)"""


@query(
    "RSK-02",
    S.with_(S.PANEL, EX_SQL)
    + f" SELECT symbol, ts, {r('coalesce(signal * 0.1 / CASE WHEN vol > 1e-12 THEN vol END, 0)')} AS w FROM exv",
)
def inverse_vol(spark, sf):
    p = risk.ex_ante_vol(A.panel(spark, sf))
    return p.select("symbol", "ts", R(risk.inverse_vol(F.signum("ret"), "vol", 0.1)).alias("w"))


PV_SQL = f"""
pr AS (SELECT ts, pos, sum(w * coalesce(ret, 0)) AS pret FROM book GROUP BY 1, 2),
pe AS (SELECT *, sqrt({S.ewm("pret * pret", HL20, 20, "1")}) * sqrt(252) AS v FROM pr),
pv AS (SELECT ts, pos, lag(v) OVER (ORDER BY pos) AS pvol FROM pe)"""


@query(
    "RSK-03",
    S.with_(S.PANEL, S.book(), PV_SQL, EX_SQL)
    + f"""
, d AS (SELECT b.ts, sqrt(sum((b.w * e.vol) ** 2)) AS diag FROM book b JOIN exv e USING (symbol, ts) GROUP BY 1)
SELECT ts, {r("pvol")} AS by_returns, {r("diag")} AS diagonal FROM pv JOIN d USING (ts)""",
)
def portfolio_vol(spark, sf):
    b = accounting.with_run(risk.ex_ante_vol(sample_weights(spark, sf)))
    exact = risk.portfolio_vol(b, "returns").select("run_id", "ts", R("pvol").alias("by_returns"))
    diag = risk.portfolio_vol(b, "diagonal").select("run_id", "ts", R("pvol").alias("diagonal"))
    return exact.join(diag, ["run_id", "ts"]).drop("run_id")


VT_SQL = """
rw AS MATERIALIZED (SELECT ts, pos, CASE WHEN pvol > 1e-12 THEN least(greatest(0.1 / pvol, 0.3), 2) END AS raw FROM pv),
vt AS (
  SELECT CAST(-1 AS BIGINT) AS pos, NULL::DOUBLE AS cur
  UNION ALL SELECT x.pos, CASE WHEN x.raw IS NOT NULL AND (v.cur IS NULL OR abs(x.raw - v.cur) > 0.15 * abs(v.cur)) THEN x.raw ELSE v.cur END
  FROM vt v JOIN rw x ON x.pos = v.pos + 1)"""


@query(
    "RSK-04",
    S.with_(S.PANEL, S.book(), PV_SQL, VT_SQL)
    + f" SELECT symbol, b.ts, {r('w * coalesce(cur, 0)')} AS w FROM book b JOIN vt USING (pos)",
)
def vol_target(spark, sf):
    b = accounting.with_run(sample_weights(spark, sf))
    return risk.vol_target(b).select("symbol", "ts", R("w").alias("w"))


@query(
    "RSK-05",
    S.with_(S.PANEL, S.book())
    + f"""
, a AS (SELECT *, least(greatest(w * 3, -0.25), 0.25) AS x FROM book),
b AS (SELECT *, CASE WHEN sum(abs(x)) OVER (PARTITION BY ts, sector) > 0.4 + 1e-12 THEN x * 0.4 / sum(abs(x)) OVER (PARTITION BY ts, sector) ELSE x END AS y FROM a)
SELECT symbol, ts, {r("CASE WHEN sum(abs(y)) OVER (PARTITION BY ts) > 1.2 + 1e-12 THEN y * 1.2 / sum(abs(y)) OVER (PARTITION BY ts) ELSE y END")} AS w FROM b""",
)
def caps(spark, sf):
    b = sample_weights(spark, sf).withColumn("w", F.col("w") * 3)
    return risk.apply_caps(b, 0.25, 1.2, "sector", 0.4).select("symbol", "ts", R("w").alias("w"))


@query("RSK-06", S.with_(S.PANEL, S.book()) + f" SELECT symbol, ts, {r('coalesce(' + S.shift('w', 2) + ', 0)', 8)} AS w FROM book")
def execution_lag(spark, sf):
    return sample_weights(spark, sf).select("symbol", "ts", R(risk.execution_lag("w", 2), 8).alias("w"))


def overlay_sql(src: str, cap: float = 2.0, floor: float = 0.3) -> str:
    """CTE ``ov(pos, cur)``: overlay scalar per bar for weights ``src``."""
    return f"""
ol AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY symbol ORDER BY ts), 0) * coalesce(ret, 0) AS c FROM {src}),
op AS (SELECT ts, pos, sum(c) AS pret FROM ol GROUP BY 1, 2),
oe AS (SELECT *, sqrt({S.ewm("pret * pret", HL20, 10, "1")} * 1.0) * sqrt(252) AS v FROM op),
og AS (SELECT pos, lag(v) OVER (ORDER BY pos) AS v FROM oe),
orw AS MATERIALIZED (SELECT pos, CASE WHEN v > 0 THEN least(greatest(0.1 / v, {floor}), {cap}) WHEN v = 0 THEN {cap} END AS raw FROM og),
ov AS (
  SELECT CAST(-1 AS BIGINT) AS pos, 1.0::DOUBLE AS cur
  UNION ALL SELECT x.pos, CASE WHEN x.raw IS NOT NULL AND abs(x.raw - o.cur) > 0.15 * greatest(abs(o.cur), 1e-12) THEN x.raw ELSE o.cur END
  FROM ov o JOIN orw x ON x.pos = o.pos + 1)"""


@query(
    "RSK-07",
    S.with_(S.PANEL, S.book(), overlay_sql("book"))
    + f" SELECT symbol, b.ts, {r('w * cur')} AS w FROM book b JOIN ov USING (pos)",
)
def overlay(spark, sf):
    b = accounting.with_run(sample_weights(spark, sf))
    return risk.vol_overlay(b).select("symbol", "ts", R("w").alias("w"))


@query(
    "RSK-08",
    S.with_(S.PANEL, S.book())
    + f"""
, c AS (SELECT symbol, ts, 0.7 * w + 0.3 * CASE WHEN in_universe THEN 0.04 ELSE 0 END AS w FROM book),
g AS (SELECT ts, sum(abs(w)) AS g FROM c GROUP BY ts), k AS (SELECT avg(g) FILTER (WHERE g <> 0) AS m FROM g)
SELECT symbol, ts, {r("w * 1.0 / m", 8)} AS w FROM c, k""",
)
def composed(spark, sf):
    p = A.panel(spark, sf)
    flat = p.withColumn("w", F.when(F.col("in_universe"), 0.04).otherwise(0.0))
    return risk.compose([sample_weights(spark, sf), flat], [0.7, 0.3], 1.0).withColumn("w", R("w", 8))


# --- costs -----------------------------------------------------------------

COST_COLS = ("commission", "spread", "impact")


def cost_rows(book, dp=6):
    return book.costed().select(
        "symbol", "ts", *[R(f"{c}_bps", dp).alias(c) for c in COST_COLS], R("borrow_bps", dp).alias("borrow")
    )


@query(
    "CST-01",
    BOOK + f" SELECT symbol, ts, {r('commission_bps')} AS commission, {r('spread_bps')} AS spread FROM positions",
)
def flat_costs(spark, sf):
    return cost_rows(sample_book(spark, sf)).select("symbol", "ts", "commission", "spread")


@query(
    "CST-02",
    S.with_(S.PANEL, S.book(), S.accounts())
    + f"""
, o AS (SELECT p.symbol, p.ts, CASE WHEN b.volume IS NOT NULL THEN 1e4 * (b.high - b.low) / nullif(b.high + b.low, 0) / 100 END AS bps
  FROM panel p LEFT JOIN bars b USING (symbol, ts))
SELECT symbol, p.ts, {r("CASE WHEN abs(dw) > 0 THEN coalesce(bps, 3.0) ELSE 0 END", 5)} AS spread FROM positions p JOIN o USING (symbol, ts)""",
)
def spread_override(spark, sf):
    b = A.bars(spark, sf)
    own = F.try_divide((F.col("high") - F.col("low")) * 1e4, F.col("high") + F.col("low")) / 100
    w = sample_weights(spark, sf).join(b.select("symbol", "ts", own.alias("own_spread")), ["symbol", "ts"], "left")
    book = accounting.run_book(with_adv(accounting.with_run(w)), costs.PRESETS["equity"], spread_bps="own_spread")
    return cost_rows(book, 5).select("symbol", "ts", "spread")


@query("CST-03", BOOK + f" SELECT symbol, ts, {r('impact_bps', 8)} AS impact FROM positions")
def impact(spark, sf):
    return cost_rows(sample_book(spark, sf), 8).select("symbol", "ts", "impact")


@query("CST-04", BOOK + f" SELECT symbol, ts, {r('borrow_bps')} AS borrow FROM positions")
def borrow(spark, sf):
    return cost_rows(sample_book(spark, sf)).select("symbol", "ts", "borrow")


SCEN = {
    "equity": costs.PRESETS["equity"],
    "double": costs.PRESETS["equity"].scaled(2.0),
    "futures": costs.PRESETS["futures"],
}


def params_sql(p: costs.CostParams) -> tuple:
    return (
        p.commission_bps, p.exchange_fee_bps, p.half_spread_bps, p.impact_coef_bps, p.impact_exponent, p.borrow_bps_yr,
    )


def scenario_book(spark, sf, scenarios=None, lag=1):
    """The sample book under every cost scenario, as one plan.

    Scenarios are a short driver-side list: each row carries all of them as an
    array that is exploded before the per-symbol windows.
    """
    scenarios = SCEN if scenarios is None else scenarios
    names = list(costs.CostParams.__dataclass_fields__)
    cells = F.array(
        *[
            F.struct(F.lit(k).alias("run_id"), *[F.lit(float(getattr(p, n))).alias(n) for n in names])
            for k, p in scenarios.items()
        ]
    )
    w = with_adv(sample_weights(spark, sf)).withColumn("c", F.explode(cells)).select("*", "c.*").drop("c")
    return accounting.run_book(w, None, lag)


@query(
    "CST-05",
    S.with_(S.PANEL, S.book(), *[S.accounts(c=params_sql(p), prefix=f"{k}_") for k, p in SCEN.items()])
    + " "
    + " UNION ALL ".join(
        f"""SELECT '{k}' AS scenario, {r("sum(commission)", 8)} AS commission, {r("sum(spread)", 8)} AS spread,
{r("sum(impact)", 8)} AS impact, {r("sum(borrow)", 8)} AS borrow, {r("sum(net)", 8)} AS net FROM {k}_daily"""
        for k in SCEN
    ),
)
def cost_scenarios(spark, sf):
    d = scenario_book(spark, sf).daily
    cols = ("commission", "spread", "impact", "borrow", "net")
    return d.groupBy(F.col("run_id").alias("scenario")).agg(*[R(F.sum(c), 8).alias(c) for c in cols])


# --- accounting ------------------------------------------------------------


@query(
    "PNL-01",
    BOOK + f" SELECT ts, {r('gross', 8)} AS gross, {r('net', 8)} AS net, {r('equity')} AS equity FROM daily",
)
def account(spark, sf):
    d = sample_book(spark, sf).daily
    return d.select("ts", R("gross", 8).alias("gross"), R("net", 8).alias("net"), R("equity").alias("equity"))


@query(
    "PNL-02",
    BOOK + f" SELECT ts, {', '.join(r(c, 9) + ' AS ' + c for c in (*COST_COLS, 'borrow'))} FROM daily",
)
def daily_costs(spark, sf):
    d = sample_book(spark, sf).daily
    return d.select("ts", *[R(c, 9).alias(c) for c in (*COST_COLS, "borrow")])


@query(
    "PNL-03",
    S.with_(S.PANEL, S.book(), S.accounts(nav=1e6))
    + f"""
SELECT p.ts, symbol, CAST(sign(dw) AS BIGINT) AS side, {r("abs(dw) * equity / nullif(close, 0)", 4)} AS qty, {r("close")} AS price,
  {r("abs(dw) * equity", 3)} AS notional, {r("commission_bps + spread_bps + impact_bps", 5)} AS cost_bps
FROM positions p JOIN daily d USING (ts) WHERE abs(dw) > 1e-6""",
)
def change_ledger(spark, sf):
    t = accounting.ledger(sample_book(spark, sf, nav=1e6))
    return t.select(
        "ts", "symbol", "side", R("qty", 4).alias("qty"), R("price").alias("price"), R("notional", 3).alias("notional"),
        R("cost_bps", 5).alias("cost_bps"),
    )


@query(
    "PNL-04",
    S.with_(
        S.PANEL, S.book(), overlay_sql("book"),
        "o1 AS (SELECT b.* EXCLUDE (w), w * cur AS w FROM book b JOIN ov USING (pos))",
        "o2 AS (SELECT * EXCLUDE (w), least(greatest(w, -0.1), 0.1) AS w FROM o1)",
        """o3 AS (SELECT * EXCLUDE (w), CASE WHEN sum(abs(w)) OVER (PARTITION BY ts) > 0.8 + 1e-12
  THEN w * 0.8 / sum(abs(w)) OVER (PARTITION BY ts) ELSE w END AS w FROM o2)""",
        S.accounts("o3"),
    )
    + f" SELECT ts, {r('gross')} AS gross, {r('net')} AS net, {r('equity', 5)} AS equity FROM daily",
)
def pipeline(spark, sf):
    """Signal → overlay → caps → accounting as one chain of transforms."""
    w = (
        sample_weights(spark, sf)
        .transform(accounting.with_run)
        .transform(risk.vol_overlay)
        .transform(risk.apply_caps, 0.1, 0.8)
        .transform(with_adv)
    )
    d = accounting.run_book(w, costs.PRESETS["equity"]).daily
    return d.select("ts", R("gross").alias("gross"), R("net").alias("net"), R("equity", 5).alias("equity"))


# --- outcomes --------------------------------------------------------------


def breakout_intents(panel, channel=55, atr_mult=2.0, risk_frac=0.0075, max_hold=120, both_sides=True):
    """Close beyond the lagged channel, first bar only; stop at a multiple of the range."""
    p = panel.withColumn("trange", W.true_range("high", "low", "close"))
    channels = [Roll("hi", "max", "close", channel, None, 1), Roll("lo", "min", "close", channel, None, 1)]
    p = rolling(p, [Roll("atr", "avg", "trange", 20, 10), *channels])
    p = p.withColumns({"pc": W.shift("close"), "ph": W.shift("hi"), "pl": W.shift("lo")})
    up = (F.col("close") > F.col("hi")) & (F.col("pc") <= F.col("ph"))
    down = (F.col("close") < F.col("lo")) & (F.col("pc") >= F.col("pl")) & F.lit(both_sides)
    side = F.when(up, 1).when(down, -1)
    return (
        p.withColumn("side", side)
        .filter(F.col("side").isNotNull() & F.col("atr").isNotNull() & (F.col("atr") != 0))
        .select(
            "symbol", "ts", "pos", F.col("side").cast("long").alias("side"),
            (F.col("close") - F.col("side") * atr_mult * F.col("atr")).alias("stop"),
            F.lit(None).cast("double").alias("take"), F.lit(max_hold).cast("long").alias("time_stop"),
            F.lit(float(risk_frac)).alias("size"),
            F.concat_ws(":", F.when(F.col("side") > 0, "bo").otherwise("bd"), "symbol", F.col("ts").cast("date").cast("string")).alias("tag"),
        )
    )


BREAK_SQL = f"""
ba AS (SELECT *, {S.roll("avg", "trange", 20, 10)} AS atr, {S.roll("max", "close", 55, None, 1)} AS hi, {S.roll("min", "close", 55, None, 1)} AS lo FROM trs),
bb AS (SELECT *, {S.shift("close")} AS pc, {S.shift("hi")} AS ph, {S.shift("lo")} AS pl FROM ba),
bc AS (SELECT *, CASE WHEN close > hi AND pc <= ph THEN 1 WHEN close < lo AND pc >= pl THEN -1 END AS side FROM bb),
intents AS (SELECT symbol, ts, pos, side, close - side * 2 * atr AS stop, NULL::DOUBLE AS take, 120 AS time_stop, 0.0075 AS size FROM bc
  WHERE side IS NOT NULL AND atr IS NOT NULL AND atr <> 0)"""

OUT_SQL = f"""
ob AS (SELECT symbol, ts, pos, open, high, low, close, in_universe, count(close) {S.over(None, 0, "symbol", "pos")} AS rn FROM panel),
oen AS (SELECT i.*, b.pos AS entry_pos, b.ts AS entry_ts, b.open AS entry_px, b.rn AS rn0 FROM intents i JOIN ob b ON b.symbol = i.symbol AND b.pos = i.pos + 1 WHERE b.open IS NOT NULL),
owk AS (
  SELECT e.symbol, e.pos, e.side, b.pos AS xp, b.ts AS xt, b.rn - e.rn0 AS j,
    CASE WHEN b.rn - e.rn0 >= 1 THEN CASE
        WHEN e.side * b.open <= e.side * e.stop THEN struct_pack(px := b.open, why := 'stop')
        WHEN e.side > 0 AND b.low <= e.stop OR e.side < 0 AND b.high >= e.stop THEN struct_pack(px := e.stop, why := 'stop')
        WHEN e.side * b.open >= e.side * e.take THEN struct_pack(px := b.open, why := 'take')
        WHEN e.side > 0 AND b.high >= e.take OR e.side < 0 AND b.low <= e.take THEN struct_pack(px := e.take, why := 'take')
        WHEN b.rn - e.rn0 >= e.time_stop THEN struct_pack(px := b.close, why := 'time')
        WHEN NOT b.in_universe THEN struct_pack(px := b.close, why := 'delist') END
      WHEN NOT b.in_universe THEN struct_pack(px := b.close, why := 'delist') END AS hit
  FROM oen e JOIN ob b ON b.symbol = e.symbol AND b.close IS NOT NULL AND b.pos >= e.entry_pos AND b.rn >= e.rn0 AND b.rn <= e.rn0 + coalesce(e.time_stop, 100000)),
oxt AS (SELECT symbol, pos, side, arg_min(struct_pack(h := hit, xp := xp, xt := xt, j := j), j) AS x FROM owk WHERE hit IS NOT NULL GROUP BY 1, 2, 3),
labelled AS (SELECT e.*, x.xp AS exit_pos, x.xt AS exit_ts, x.h.px AS exit_px, coalesce(x.h.why, 'open') AS reason,
    e.side * (x.h.px / entry_px - 1) AS tret FROM oen e LEFT JOIN oxt USING (symbol, pos, side))"""


@query(
    "TRD-01",
    S.with_(S.PANEL, ATR_SQL, BREAK_SQL, OUT_SQL)
    + f""" SELECT symbol, ts, CAST(side AS BIGINT) AS side, entry_ts, {r("entry_px")} AS entry_px, exit_ts, {r("exit_px")} AS exit_px, reason, {r("tret")} AS ret FROM labelled""",
)
def signal_outcomes(spark, sf):
    p = A.panel(spark, sf)
    t = outcomes.label(breakout_intents(p), p)
    return t.select(
        "symbol", "ts", "side", "entry_ts", R("entry_px").alias("entry_px"), "exit_ts", R("exit_px").alias("exit_px"),
        "reason", R("ret").alias("ret"),
    )


# Walk over a symbol's labelled signals in order, remembering when it is free.
FREE_SQL = """
lq AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY entry_pos) AS seq,
  coalesce(exit_pos + CASE WHEN reason = 'delist' THEN 1 ELSE 0 END, 1000000000) AS free_at FROM labelled),
fm AS (
  SELECT DISTINCT symbol, CAST(0 AS BIGINT) AS seq, CAST(-1 AS BIGINT) AS free, FALSE AS kept FROM lq
  UNION ALL SELECT q.symbol, q.seq, CASE WHEN q.entry_pos >= f.free THEN q.free_at ELSE f.free END, q.entry_pos >= f.free
  FROM fm f JOIN lq q ON q.symbol = f.symbol AND q.seq = f.seq + 1),
kept AS (SELECT lq.* FROM lq JOIN fm USING (symbol, seq) WHERE kept)"""


@query(
    "TRD-02",
    S.with_(S.PANEL, ATR_SQL, BREAK_SQL, OUT_SQL, FREE_SQL) + " SELECT symbol, ts, entry_ts, exit_ts, reason FROM kept",
)
def one_open_trade(spark, sf):
    p = A.panel(spark, sf)
    t = outcomes.one_at_a_time(outcomes.label(breakout_intents(p), p))
    return t.select("symbol", "ts", "entry_ts", "exit_ts", "reason")


@query(
    "TRD-03",
    S.with_(S.PANEL, ATR_SQL, BREAK_SQL, OUT_SQL)
    + f""" SELECT symbol, ts, {r("1e6 * 0.0075 / abs(entry_px - stop)", 4)} AS risk_frac, {r("1e6 * 0.0075 / entry_px", 4)} AS nav_frac,
  {r("1e6 * 0.0075 / entry_px", 4)} AS target_weight, {r("0.0075", 4)} AS qty FROM labelled WHERE abs(entry_px - stop) > 0""",
)
def unit_sizes(spark, sf):
    p = A.panel(spark, sf)
    t = outcomes.label(breakout_intents(p), p)
    modes = ("risk_frac", "nav_frac", "target_weight")
    for mode in modes:
        t = outcomes.sized(t, mode, 1e6).withColumnRenamed("qty", mode)
    return outcomes.sized(t, "qty").select("symbol", "ts", *[R(c, 4).alias(c) for c in (*modes, "qty")])
