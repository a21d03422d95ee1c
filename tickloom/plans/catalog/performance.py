"""Metric, drawdown, report, check and sweep queries (MET-*, DD-*, REP-*, CHK-*, SWP-*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ...functions import stats
from ...functions.scalar import rnd as R
from ...functions.window import shift
from ...operators import accounting, checks, costs, metrics, outcomes
from ...operators.sessions import downsample
from ...operators.tsignal import skip_return
from ...operators.xsection import fractile_weights
from .. import adapters as A
from . import sqlbase as S
from .aggregates import MONTH_CELLS, PER_YEAR_SQL
from .common import sample_book, with_adv
from .portfolio import ATR_SQL, BREAK_SQL, FREE_SQL, OUT_SQL, breakout_intents, params_sql, scenario_book
from .registry import query

r = S.rnd
BOOK = S.with_(S.PANEL, S.book(), S.accounts())
CAGR = "CASE WHEN product(1 + {x}) <= 0 THEN -1 ELSE pow(product(1 + {x}), 252.0::DOUBLE / count({x})) - 1 END"


def per_symbol(spark, sf):
    return A.panel(spark, sf).groupBy("symbol")


@query("MET-01", S.with_(S.PANEL) + f" SELECT symbol, {r(S.sharpe('ret'), 5)} AS sharpe FROM panel GROUP BY symbol")
def sharpe(spark, sf):
    return per_symbol(spark, sf).agg(R(stats.sharpe("ret"), 5).alias("sharpe"))


SORTINO = "CASE WHEN count({x}) >= 3 AND stddev_samp({x}) FILTER (WHERE {x} < 0) > 0 THEN avg({x}) * 252 / (stddev_samp({x}) FILTER (WHERE {x} < 0) * sqrt(252)) END"


@query("MET-02", S.with_(S.PANEL) + f" SELECT symbol, {r(SORTINO.format(x='ret'), 5)} AS sortino FROM panel GROUP BY symbol")
def sortino(spark, sf):
    return per_symbol(spark, sf).agg(R(stats.sortino("ret"), 5).alias("sortino"))


@query("MET-03", S.with_(S.PANEL) + f" SELECT symbol, {r(CAGR.format(x='ret'))} AS cagr FROM panel GROUP BY symbol")
def cagr(spark, sf):
    return per_symbol(spark, sf).agg(R(stats.cagr("ret")).alias("cagr"))


DD_SQL = f"""
dd AS (SELECT ts, equity, row_number() OVER (ORDER BY ts) - 1 AS i, equity / max(equity) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM daily),
isl AS (SELECT *, count(*) FILTER (WHERE dd >= 0) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM dd),
ep0 AS (SELECT g, min(ts) AS start, min(i) AS i0, max(ts) AS last_ts, max(i) AS il, min(dd) AS depth, arg_min(ts, (dd, i)) AS trough, arg_min(i, (dd, i)) AS it FROM isl GROUP BY g),
ep1 AS (SELECT *, lead(start) OVER (ORDER BY g) AS nt, lead(i0) OVER (ORDER BY g) AS ni FROM ep0),
ep AS (SELECT start, trough, coalesce(nt, last_ts) AS "end", depth, coalesce(ni, il) - i0 AS duration, ni - it AS recovery, nt IS NOT NULL AS recovered,
  row_number() OVER (ORDER BY depth, start) AS rank FROM ep1 WHERE depth < 0)"""
DDB = S.with_(S.PANEL, S.book(), S.accounts(), DD_SQL)


@query(
    "MET-04",
    DDB
    + f"""
, yr AS (SELECT year(ts) AS y, product(1 + net) - 1 AS ret FROM daily GROUP BY 1),
bk AS (SELECT avg(g) AS avg_gross, avg(n) AS avg_net, avg(t) * 252 AS turnover_ann FROM (SELECT ts, sum(abs(w)) AS g, sum(w) AS n, 0.5 * sum(abs(dw)) AS t FROM held GROUP BY ts)),
b AS (SELECT {S.sharpe("net")} AS sharpe, {SORTINO.format(x="net")} AS sortino, {CAGR.format(x="net")} AS cagr, stddev_samp(net) * sqrt(252) AS ann_vol,
  skewness(net) AS skew, kurtosis(net) AS kurtosis, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0 END) AS hit_rate, avg(net) / (stddev_samp(net) / sqrt(count(net))) AS t_stat,
  CAST(count(net) AS DOUBLE) AS n_obs, {CAGR.format(x="gross")} AS cagr_gross, (avg(gross) - avg(net)) * 252 * 1e4 AS cost_drag_bps_ann FROM daily),
d AS (SELECT min(depth) AS max_dd, CAST(max(duration) AS DOUBLE) AS dd_duration_days FROM ep),
t AS (SELECT CAST(count(*) AS DOUBLE) AS n_trades FROM held WHERE abs(dw) > 1e-6)
SELECT {", ".join(r(c, 4) + " AS " + c for c in ("sharpe", "sortino", "cagr", "ann_vol", "skew", "kurtosis", "hit_rate", "t_stat", "n_obs", "cagr_gross", "max_dd", "dd_duration_days", "avg_gross", "avg_net", "turnover_ann", "n_trades"))},
  {r("cost_drag_bps_ann", 3)} AS cost_drag_bps_ann, {r("cagr / abs(max_dd)", 4)} AS calmar, {r("(SELECT max(ret) FROM yr)", 4)} AS best_year, {r("(SELECT min(ret) FROM yr)", 4)} AS worst_year
FROM b, d, bk, t""",
)
def run_summary(spark, sf):
    book = sample_book(spark, sf)
    s = metrics.summary(book, accounting.change_counts(book)).drop("run_id", "n_closed_trades", "trade_hit_rate")
    return s.select(*[R(c, 3 if c == "cost_drag_bps_ann" else 4).alias(c) for c in s.columns])


@query("DD-01", DDB + f" SELECT ts, {r('dd')} AS dd FROM dd")
def drawdowns(spark, sf):
    return metrics.drawdown(sample_book(spark, sf).daily).select("ts", R("dd").alias("dd"))


@query(
    "DD-02",
    DDB + f' SELECT rank, start, trough, "end", {r("depth")} AS depth, duration, recovery, recovered FROM ep WHERE rank <= 10',
)
def drawdown_episodes(spark, sf):
    e = metrics.drawdown_episodes(sample_book(spark, sf).daily)
    return e.drop("run_id").withColumn("depth", R("depth"))


@query("REP-01", BOOK + f" SELECT year(ts) AS year, {MONTH_CELLS}, {r('product(1 + net) - 1')} AS total FROM daily GROUP BY 1")
def report_months(spark, sf):
    t = metrics.monthly_table(sample_book(spark, sf).daily)
    cols = [c for c in t.columns if c not in ("run_id", "year")]
    return t.select(F.col("year").cast("long").alias("year"), *[R(c).alias(c) for c in cols])


BENCH = """
be AS (SELECT ts, avg(ret) AS bench_ret FROM panel GROUP BY ts),
db AS (SELECT d.*, bench_ret, product(1 + coalesce(bench_ret, 0)) OVER (ORDER BY d.ts ROWS UNBOUNDED PRECEDING) AS bench FROM daily d JOIN be USING (ts))"""


def with_benchmark(spark, sf):
    """Daily run table with the equal-weight market as benchmark."""
    m = A.panel(spark, sf).groupBy("ts").agg(F.avg("ret").alias("bench_ret"))
    d = sample_book(spark, sf).daily.join(m, "ts")
    w = Window.partitionBy("run_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("bench", F.product(1 + F.coalesce("bench_ret", F.lit(0.0))).over(w))


@query(
    "REP-02",
    S.with_(S.PANEL, S.book(), S.accounts(), BENCH)
    + f"""
, x AS (SELECT ts, row_number() OVER (ORDER BY ts) AS rn, avg(net) OVER w / nullif(stddev_samp(net) OVER w, 0) * sqrt(252) AS sharpe, stddev_samp(net) OVER w * sqrt(252) AS vol,
  CASE WHEN count(bench_ret) OVER w >= 252 THEN covar_samp(net, bench_ret) OVER w / nullif(var_samp(bench_ret) OVER w, 0) END AS beta
  FROM db WINDOW w AS (ORDER BY ts ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)),
y AS (SELECT *, rn - 252 AS k, (SELECT count(*) FROM x WHERE rn >= 252) AS n FROM x WHERE rn >= 252),
pick AS (SELECT DISTINCT (i * ((SELECT count(*) FROM x WHERE rn >= 252) - 1)) // 1499 AS k FROM unnest(generate_series(0, 1499)) AS t(i))
SELECT ts, {r("sharpe", 4)} AS sharpe, {r("vol")} AS vol, {r("beta", 5)} AS beta FROM y WHERE n <= 1500 OR k IN (SELECT k FROM pick)""",
)
def rolling_report(spark, sf):
    x = metrics.rolling_stats(with_benchmark(spark, sf), "bench_ret")
    return x.select("ts", R("sharpe", 4).alias("sharpe"), R("vol").alias("vol"), R("beta", 5).alias("beta"))


@query(
    "REP-03",
    S.with_(S.PANEL, S.book(), S.accounts(), BENCH)
    + f"""
, j AS (SELECT * FROM db WHERE bench_ret IS NOT NULL)
SELECT {r(S.sharpe("bench_ret"), 4)} AS bench_sharpe, {r(CAGR.format(x="bench_ret"))} AS bench_cagr, {r("stddev_samp(bench_ret) * sqrt(252)")} AS bench_vol,
  {r("(SELECT min(x) FROM (SELECT bench / max(bench) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS x FROM db))")} AS bench_max_dd,
  {r("covar_samp(net, bench_ret) / var_samp(bench_ret)")} AS beta, {r("(avg(net) - covar_samp(net, bench_ret) / var_samp(bench_ret) * avg(bench_ret)) * 252")} AS alpha_ann,
  {r("corr(net, bench_ret)")} AS corr, {r("stddev_samp(net - bench_ret) * sqrt(252)")} AS te_ann, {r("avg(net - bench_ret) * 252 / (stddev_samp(net - bench_ret) * sqrt(252))", 4)} AS ir FROM j""",
)
def against_benchmark(spark, sf):
    b = metrics.benchmark_stats(with_benchmark(spark, sf)).drop("run_id")
    return b.select(*[R(c, 4 if c in ("bench_sharpe", "ir") else 6).alias(c) for c in b.columns])


TRADES_SQL = """
sz AS (SELECT *, 1e6 * 0.0075 / nullif(abs(entry_px - stop), 0) AS qty FROM kept WHERE abs(entry_px - stop) > 0),
tl AS (SELECT symbol, entry_ts AS ts, 'entry' AS reason, NULL::DOUBLE AS pnl, entry_ts, exit_ts FROM sz
  UNION ALL SELECT symbol, exit_ts, reason, side * qty * (exit_px - entry_px) - qty * exit_px * 7.6 / 1e4, entry_ts, exit_ts FROM sz WHERE exit_ts IS NOT NULL)"""
TRD = S.with_(S.PANEL, ATR_SQL, BREAK_SQL, OUT_SQL, FREE_SQL, TRADES_SQL)


def breakout_trades(spark, sf):
    p = A.panel(spark, sf)
    t = outcomes.one_at_a_time(outcomes.label(breakout_intents(p), p))
    return outcomes.trade_ledger(outcomes.sized(t, "risk_frac", 1e6)).withColumn("run_id", F.lit("run"))


@query(
    "REP-04",
    TRD
    + f"""
, p AS (SELECT pnl / 1e6 AS x FROM tl WHERE pnl IS NOT NULL)
SELECT count(*) AS n, {r("avg(CASE WHEN x > 0 THEN 1.0 ELSE 0 END)")} AS win_rate, {r("coalesce(sum(x) FILTER (WHERE x > 0), 0) / nullif(-sum(x) FILTER (WHERE x < 0), 0)", 4)} AS profit_factor,
  {r("avg(x) FILTER (WHERE x > 0)")} AS avg_win, {r("avg(x) FILTER (WHERE x < 0)")} AS avg_loss, {r("avg(x)")} AS expectancy, {r("max(x)")} AS best, {r("min(x)")} AS worst FROM p""",
)
def trade_statistics(spark, sf):
    t = metrics.trade_stats(breakout_trades(spark, sf), 1e6).drop("run_id")
    return t.select("n", *[R(c, 4 if c == "profit_factor" else 6).alias(c) for c in t.columns if c != "n"])


@query(
    "REP-05",
    TRD + f" SELECT {r('avg(date_diff(' + chr(39) + 'day' + chr(39) + ', entry_ts, exit_ts))', 4)} AS avg_hold_days FROM sz WHERE exit_ts IS NOT NULL",
)
def holding_days(spark, sf):
    return metrics.average_hold(breakout_trades(spark, sf)).select(R("avg_hold_days", 4).alias("avg_hold_days"))


@query(
    "REP-06",
    BOOK
    + f"""
, a AS (SELECT symbol, sum(w * r) AS pnl, avg(abs(w)) AS avg_weight, count(*) FILTER (WHERE abs(dw) > 1e-6) AS n_trades FROM held GROUP BY symbol),
s AS (SELECT h.symbol, sum(coalesce(abs(h.w) / nullif(g.g, 0), 0) * d.net) AS proxy FROM held h JOIN (SELECT ts, sum(abs(w)) AS g FROM held GROUP BY ts) g USING (ts) JOIN daily d USING (ts) GROUP BY 1)
SELECT symbol, {r("pnl")} AS pnl, {r("avg_weight")} AS avg_weight, n_trades, row_number() OVER (ORDER BY pnl DESC NULLS LAST, symbol) AS rank, {r("proxy")} AS proxy FROM a JOIN s USING (symbol)
WHERE avg_weight <> 0 OR pnl <> 0 OR n_trades > 0""",
)
def attribution(spark, sf):
    book = sample_book(spark, sf)
    t = accounting.change_counts(book)
    exact = metrics.attribution(book.positions, t)
    proxy = metrics.attribution(book.positions, t, book.daily, "proxy").select("symbol", F.col("pnl").alias("proxy"))
    return exact.join(proxy, "symbol").select(
        "symbol", R("pnl").alias("pnl"), R("avg_weight").alias("avg_weight"), "n_trades", "rank", R("proxy").alias("proxy")
    )


IS_SQL = f"""
io AS (SELECT net, row_number() OVER (ORDER BY ts) AS i, count(*) OVER () AS n FROM daily WHERE net IS NOT NULL)"""


@query(
    "REP-07",
    S.with_(S.PANEL, S.book(), S.accounts(), IS_SQL)
    + f""" SELECT {r(S.sharpe("CASE WHEN i <= floor(n * 0.7::DOUBLE) THEN net END"), 4)} AS sharpe_is, {r(S.sharpe("CASE WHEN i > floor(n * 0.7::DOUBLE) THEN net END"), 4)} AS sharpe_oos FROM io""",
)
def in_and_out_of_sample(spark, sf):
    x = metrics.is_oos(sample_book(spark, sf).daily)
    return x.select(R("sharpe_is", 4).alias("sharpe_is"), R("sharpe_oos", 4).alias("sharpe_oos"))


@query(
    "REP-08",
    S.with_(S.PANEL, S.book(), S.accounts(), PER_YEAR_SQL)
    + f"""
, ex AS (SELECT ts, sum(abs(w)) AS g, sum(w) AS n, CAST(count(*) FILTER (WHERE abs(w) > 1e-9) AS DOUBLE) AS k FROM held GROUP BY ts)
SELECT 'exposure' AS block, 'mean' AS item, {r("avg(g)")} AS a, {r("avg(n)")} AS b, {r("avg(k)", 4)} AS c FROM ex
UNION ALL SELECT 'year', period, {r("product(1 + gross) - 1")}, {r("product(1 + net) - 1")}, {r("min(dd)")} FROM dds GROUP BY period
"""
    + " ".join(
        f"UNION ALL SELECT 'cost', '{c}', {r(f'sum({c})', 8)}, {r(f'avg({c}) * 252', 8)}, NULL FROM daily"
        for c in ("commission", "spread", "impact", "borrow")
    ),
)
def report_blocks(spark, sf):
    book = sample_book(spark, sf)
    e = accounting.exposure(book.positions).agg(
        R(F.avg("gross")).alias("a"), R(F.avg("net")).alias("b"), R(F.avg("n_positions"), 4).alias("c")
    )
    y = metrics.per_year_table(book.daily, split=("1998-02-24", "1998-03-24"))
    c = metrics.cost_attribution(book.daily)
    none = F.lit(None).cast("double")
    return (
        e.select(F.lit("exposure").alias("block"), F.lit("mean").alias("item"), "a", "b", "c")
        .unionByName(
            y.select(F.lit("year").alias("block"), F.col("period").alias("item"), R("gross").alias("a"), R("net").alias("b"), R("max_dd").alias("c"))
        )
        .unionByName(
            c.select(F.lit("cost").alias("block"), F.col("component").alias("item"), R("total", 8).alias("a"), R("ann_drag", 8).alias("b"), none.alias("c"))
        )
    )


TWO = {k: costs.PRESETS[k] for k in ("equity", "futures")}


@query(
    "REP-09",
    S.with_(S.PANEL, S.book(), *[S.accounts(c=params_sql(p), prefix=f"{k}_") for k, p in TWO.items()])
    + f"""
, s AS (SELECT 'equity' AS run, {S.sharpe("net")} AS sharpe, {CAGR.format(x="net")} AS cagr, stddev_samp(net) * sqrt(252) AS ann_vol FROM equity_daily
  UNION ALL SELECT 'futures', {S.sharpe("net")}, {CAGR.format(x="net")}, stddev_samp(net) * sqrt(252) FROM futures_daily),
u AS (UNPIVOT s ON sharpe, cagr, ann_vol INTO NAME metric VALUE v)
SELECT metric, {r("max(v) FILTER (WHERE run = 'equity')", 4)} AS equity, {r("max(v) FILTER (WHERE run = 'futures')", 4)} AS futures FROM u GROUP BY metric""",
)
def compare_runs(spark, sf):
    d = scenario_book(spark, sf, TWO).daily
    s = metrics.return_stats(d).select("run_id", "sharpe", "cagr", "ann_vol")
    u = s.unpivot(["run_id"], ["sharpe", "cagr", "ann_vol"], "metric", "v")
    wide = u.groupBy("metric").pivot("run_id", list(TWO)).agg(F.max("v"))
    return wide.select("metric", *[R(k, 4).alias(k) for k in TWO])


@query(
    "REP-09b",
    S.with_(S.PANEL, S.book(), *[S.accounts(c=params_sql(p), prefix=f"{k}_") for k, p in TWO.items()])
    + """
, e AS (SELECT 'equity' AS run_id, ts, equity FROM equity_daily WHERE equity IS NOT NULL
  UNION ALL SELECT 'futures', ts, equity FROM futures_daily WHERE equity IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts) - 1 AS k, count(*) OVER (PARTITION BY run_id) AS n FROM e),
pick AS (SELECT DISTINCT run_id, (i * (n - 1)) // 1499 AS k FROM (SELECT DISTINCT run_id, n FROM k), generate_series(0, 1499) AS t(i))
"""
    + f"SELECT run_id, ts, {r('equity')} AS equity FROM k WHERE n <= 1500 OR (run_id, k) IN (SELECT (run_id, k) FROM pick)",
)
def compare_curves(spark, sf):
    """Equity of the compared runs, at most 1,500 evenly spread points each."""
    d = scenario_book(spark, sf, TWO).daily.filter(F.col("equity").isNotNull())
    return downsample(d, ["run_id"], 1500).select("run_id", "ts", R("equity").alias("equity"))


HIST = S.with_(S.PANEL, S.book(), *[S.accounts(c=params_sql(p), prefix=f"{k}_") for k, p in TWO.items()])


@query(
    "REP-10",
    HIST
    + " "
    + " UNION ALL ".join(
        f"""SELECT {i} AS created, '{k}' AS run_id, {r(S.sharpe("net"), 4)} AS sharpe, {r(CAGR.format(x="net"))} AS cagr,
{r(f"(SELECT min(x) FROM (SELECT equity / max(equity) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS x FROM {k}_daily))")} AS max_dd FROM {k}_daily"""
        for i, k in enumerate(TWO)
    ),
)
def run_history(spark, sf):
    d = scenario_book(spark, sf, TWO).daily
    created = F.create_map(*[x for i, k in enumerate(TWO) for x in (F.lit(k), F.lit(i).cast("long"))])
    s = metrics.return_stats(d).select("run_id", "sharpe", "cagr")
    dd = metrics.drawdown(d).groupBy("run_id").agg(F.min("dd").alias("max_dd"))
    return (
        s.join(dd, "run_id")
        .select(
            created[F.col("run_id")].alias("created"), "run_id", R("sharpe", 4).alias("sharpe"), R("cagr").alias("cagr"),
            R("max_dd").alias("max_dd"),
        )
        .orderBy(F.desc("created"))
    )


FORMATIONS, FRACS = (63, 126, 252), (0.1, 0.2)
TOO_SHORT = 21  # a formation that does not exceed the skip: its cells fail
CELLS = checks.grid_cells({"formation": checks.parse_range("21,63,126,252"), "frac": checks.parse_range("0.1:0.2:0.1")})


def sweep_daily(spark, sf, cells=CELLS):
    """(daily account, errors) of momentum runs over formation x fraction.

    The formation is a frame offset, which differs per cell, so each row reads
    its lagged prices once and the cells unfold from an array; the
    fraction and everything after it are data on a cell key.  A cell whose signal
    cannot be built is left out and named in ``errors``, cell to message.
    """
    p, signals, errors = A.panel(spark, sf), {}, {}
    for f in sorted({int(c["formation"]) for c in cells}):
        try:
            signals[f"_s{f}"] = skip_return("tr", f, 21)
        except ValueError as problem:
            errors |= {f"{f}/{c['frac']:g}": str(problem) for c in cells if int(c["formation"]) == f}
    good = [(int(c["formation"]), c["frac"]) for c in cells if f"_s{int(c['formation'])}" in signals]
    p = with_adv(p).withColumns(signals)
    grid = F.array(
        *[
            F.struct(F.lit(f"{f}/{q:g}").alias("cell"), F.col(f"_s{f}").alias("signal"), F.lit(float(q)).alias("frac"))
            for f, q in good
        ]
    )
    p = p.withColumn("c", F.explode(grid)).select("*", "c.*").drop("c", *signals)
    p = p.withColumn("run_id", F.col("cell"))
    w = fractile_weights(p, F.col("frac"), F.col("frac"), True, keys=("run_id",))
    return accounting.run_book(w, costs.PRESETS["equity"]).daily, errors


def sweep_sql() -> tuple[str, list[str]]:
    parts, names = [S.rebalance()], []
    for f in FORMATIONS:
        parts.append(
            f"sw{f} AS (SELECT *, {S.shift('tr', 21)} / nullif({S.shift('tr', f)}, 0) - 1 AS signal FROM panel)"
        )
        for q in FRACS:
            k = f"c{f}_{int(q * 10)}"
            names.append((k, f, q))
            parts.append(S.xs_weights(f"{k}w", f"sw{f}", q, q, True))
            parts.append(f"{k}b AS (SELECT p.*, b.w FROM panel p JOIN {k}w b USING (symbol, ts))")
            parts.append(S.accounts(f"{k}b", prefix=f"{k}_"))
    return S.with_(S.PANEL, *parts), names


SWEEP_SQL, SWEEP_CELLS = sweep_sql()


@query(
    "SWP-01",
    SWEEP_SQL
    + " "
    + " UNION ALL ".join(
        f"""SELECT '{f}/{q}' AS cell, {r(S.sharpe("net"), 4)} AS sharpe, {r(CAGR.format(x="net"))} AS cagr,
{r(S.sharpe("CASE WHEN i <= floor(n * 0.7::DOUBLE) THEN net END"), 4)} AS sharpe_is, {r(S.sharpe("CASE WHEN i > floor(n * 0.7::DOUBLE) THEN net END"), 4)} AS sharpe_oos, NULL AS error
FROM (SELECT net, row_number() OVER (ORDER BY ts) AS i, count(*) OVER () AS n FROM {k}_daily)"""
        for k, f, q in SWEEP_CELLS
    )
    + "".join(f" UNION ALL SELECT '{TOO_SHORT}/{q}', NULL, NULL, NULL, NULL, 'formation must exceed skip'" for q in FRACS),
)
def parameter_sweep(spark, sf):
    d, errors = sweep_daily(spark, sf)
    s = metrics.return_stats(d).select("run_id", "sharpe", "cagr").join(metrics.is_oos(d), "run_id")
    numbers = ["sharpe", "cagr", "sharpe_is", "sharpe_oos"]
    good = s.select(
        F.col("run_id").alias("cell"), R("sharpe", 4).alias("sharpe"), R("cagr").alias("cagr"),
        R("sharpe_is", 4).alias("sharpe_is"), R("sharpe_oos", 4).alias("sharpe_oos"), F.lit(None).cast("string").alias("error"),
    )
    bad = spark.createDataFrame(list(errors.items()), "cell string, error string")
    return good.unionByName(bad.select("cell", *[F.lit(None).cast("double").alias(c) for c in numbers], "error"))


@query(
    "REP-11",
    SWEEP_SQL
    + " "
    + " UNION ALL ".join(
        f"SELECT CAST({f} AS BIGINT) AS formation, "
        + ", ".join(f"(SELECT {r(S.sharpe('net'), 4)} FROM c{f}_{int(q * 10)}_daily) AS top_{int(q * 100)}" for q in FRACS)
        for f in FORMATIONS
    ),
)
def sweep_heatmap(spark, sf):
    s = metrics.return_stats(sweep_daily(spark, sf)[0]).select("run_id", "sharpe")
    part = F.split("run_id", "/")
    s = s.select(part[0].cast("long").alias("formation"), part[1].alias("frac"), "sharpe")
    wide = s.groupBy("formation").pivot("frac", [str(q) for q in FRACS]).agg(F.first("sharpe"))
    return wide.select("formation", *[R(f"`{q}`", 4).alias(f"top_{int(q * 100)}") for q in FRACS])


@query(
    "REP-12",
    HIST
    + " "
    + " UNION ALL ".join(
        f"SELECT '{k}' AS run_id, ts, {r('equity / first_value(equity) OVER (ORDER BY ts)')} AS rebased FROM {k}_daily" for k in TWO
    ),
)
def rebased_curves(spark, sf):
    d = scenario_book(spark, sf, TWO).daily
    return metrics.rebased(d).select("run_id", "ts", R("rebased").alias("rebased"))


# --- checks ----------------------------------------------------------------


def momentum(panel):
    return fractile_weights(panel.withColumn("signal", skip_return("tr", 252, 21)), 0.2, 0.2, long_only=False)


@query(
    "CHK-01",
    S.with_(S.PANEL)
    + """, n AS (SELECT count(*) AS n FROM cal), c(cut) AS (VALUES (0.5), (0.75), (0.9))
SELECT CAST(cut AS DOUBLE) AS cut, (SELECT count(*) FROM panel WHERE pos < floor(n * cut)) AS n_rows, 0 AS n_bad, NULL::TIMESTAMP AS first_bad_ts FROM c, n""",
)
def lookahead(spark, sf):
    return checks.lookahead_audit(momentum, A.panel(spark, sf), A.calendar(spark, sf))


CHK2 = {"base": costs.PRESETS["equity"], "double": costs.PRESETS["equity"].scaled(2.0)}


@query(
    "CHK-02",
    S.with_(S.PANEL, S.book(), *[S.accounts(c=params_sql(p), prefix=f"{k}_") for k, p in CHK2.items()])
    + f""", a AS (SELECT {S.sharpe("net")} AS s FROM base_daily), b AS (SELECT {S.sharpe("net")} AS s FROM double_daily)
SELECT {r("a.s", 4)} AS base, {r("b.s", 4)} AS double, b.s <= a.s AS monotone FROM a, b""",
)
def cost_sensitivity(spark, sf):
    s = metrics.return_stats(scenario_book(spark, sf, CHK2).daily).select("run_id", "sharpe")
    wide = s.groupBy().pivot("run_id", list(CHK2)).agg(F.max("sharpe"))
    return wide.select(
        R("base", 4).alias("base"), R("double", 4).alias("double"), (F.col("double") <= F.col("base")).alias("monotone")
    )


@query(
    "CHK-03",
    S.with_(S.PANEL, S.book(), S.accounts(lag=1, prefix="l1_"), S.accounts(lag=2, prefix="l2_"))
    + f""" SELECT {r("(SELECT " + S.sharpe("net") + " FROM l1_daily)", 4)} AS lag1, {r("(SELECT " + S.sharpe("net") + " FROM l2_daily)", 4)} AS lag2""",
)
def lag_canary(spark, sf):
    """Lag as one more key: the weights unfold once per lag before accounting."""
    from .common import sample_weights

    w = with_adv(sample_weights(spark, sf))
    lags = F.array(*[F.lit(k) for k in (1, 2)])
    w = w.withColumn("lag", F.explode(lags)).withColumn("run_id", F.concat(F.lit("lag"), F.col("lag")))
    # Shifting by one more bar up front turns lag 2 into lag 1 of a later book.
    moved = F.when(F.col("lag") == 2, shift("w", 1, ("run_id", "symbol"))).otherwise(F.col("w"))
    member = shift("in_universe", 1, ("run_id", "symbol"))
    was_in = F.when(F.col("lag") == 2, F.coalesce(member, F.lit(False))).otherwise(F.col("in_universe"))
    w = w.withColumns({"_w": moved, "_in": was_in}).withColumns({"w": F.col("_w"), "in_universe": F.col("_in")})
    s = metrics.return_stats(accounting.run_book(w, costs.PRESETS["equity"]).daily).select("run_id", "sharpe")
    wide = s.groupBy().pivot("run_id", ["lag1", "lag2"]).agg(F.max("sharpe"))
    return wide.select(R("lag1", 4).alias("lag1"), R("lag2", 4).alias("lag2"))
