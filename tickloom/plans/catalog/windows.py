"""Window-function queries (WIN-*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ...functions import stats
from ...functions import window as W
from ...functions.ewm import Ewm, ewm
from ...functions.rolling import Roll
from ...functions.rolling import rolling as with_rolls
from ...functions.scalar import day, div
from ...functions.scalar import rnd as R
from .. import adapters as A
from . import sqlbase as S
from .registry import query

PANEL = S.with_(S.PANEL)
r = S.rnd


def out(df, **cols):
    dp = cols.pop("dp", 6)
    return df.select("symbol", "ts", *[R(c, dp).alias(n) for n, c in cols.items()])


@query("WIN-01", PANEL + f" SELECT symbol, ts, {r(S.pct('tr'), 8)} AS r1, {r(S.pct('tr', 21), 8)} AS r21 FROM panel")
def returns(spark, sf):
    return out(A.panel(spark, sf), r1=W.pct_change("tr"), r21=W.pct_change("tr", 21), dp=8)


@query(
    "WIN-02",
    PANEL + f" SELECT symbol, ts, {r('tr - ' + S.shift('tr', 42))} AS d42, {r(S.shift('tr', 5))} AS lag5 FROM panel",
)
def differences(spark, sf):
    return out(A.panel(spark, sf), d42=W.diff("tr", 42), lag5=W.shift("tr", 5))


ROLLS = {
    "mean20": ("avg", 20, 10, 0),
    "sum60": ("sum", 60, None, 0),
    "std5": ("stddev_samp", 5, None, 0),
    "pstd63": ("stddev_pop", 63, 21, 1),
    "var60": ("var_samp", 60, 30, 0),
}


@query(
    "WIN-03",
    PANEL
    + " SELECT symbol, ts, "
    + ", ".join(f"{r(S.roll(f, 'ret', n, mp, lag), 8)} AS {k}" for k, (f, n, mp, lag) in ROLLS.items())
    + f", {r(S.roll('min', 'tr', 55, None, 1))} AS lo55, {r(S.roll('max', 'tr', 55, None, 1))} AS hi55 FROM panel",
)
def rolling(spark, sf):
    names = {"avg": "avg", "sum": "sum", "stddev_samp": "std", "stddev_pop": "pstd", "var_samp": "var"}
    rolls = [Roll(k, names[f], "ret", n, mp, lag) for k, (f, n, mp, lag) in ROLLS.items()]
    rolls += [Roll("lo55", "min", "tr", 55, None, 1), Roll("hi55", "max", "tr", 55, None, 1)]
    p = with_rolls(A.panel(spark, sf), rolls)
    return p.select("symbol", "ts", *[R(k, 8).alias(k) for k in ROLLS], R("lo55").alias("lo55"), R("hi55").alias("hi55"))


def pair_roll(f, n, mp):
    w = S.over(n)
    c = "CASE WHEN ret IS NOT NULL AND mkt IS NOT NULL THEN {} END"
    x, y = c.format("ret"), c.format("mkt")
    return f"CASE WHEN count({x}) {w} >= {mp} THEN {f}({x}, {y}) {w} END"


@query(
    "WIN-04",
    PANEL
    + f"""
, m AS (SELECT ts, avg(ret) AS mkt FROM panel GROUP BY ts), j AS (SELECT * FROM panel JOIN m USING (ts))
SELECT symbol, ts, {r(pair_roll("covar_samp", 60, 30), 8)} AS cov60, {r(pair_roll("corr", 60, 30))} AS corr60,
  {r(pair_roll("covar_samp", 60, 30) + " / nullif(" + S.roll("var_samp", "mkt", 60, 30) + ", 0)")} AS beta60 FROM j""",
)
def rolling_pairs(spark, sf):
    p = A.panel(spark, sf).withColumn("mkt", F.avg("ret").over(Window.partitionBy("ts")))
    pair = {"x": "ret", "y": "mkt", "n": 60, "min_periods": 30}
    p = with_rolls(p, [Roll("cov60", "cov", **pair), Roll("corr60", "corr", **pair), Roll("v", "var", "mkt", 60, 30)])
    return p.select(
        "symbol", "ts", R("cov60", 8).alias("cov60"), R("corr60").alias("corr60"), R(div("cov60", "v")).alias("beta60")
    )


@query(
    "WIN-05",
    PANEL
    + f""" SELECT symbol, ts, CASE WHEN count(ret) {S.over(63, 1)} >= 30 THEN
{r(f"quantile_cont(ret, 0.7) {S.over(63, 1)}", 8)} END AS q70 FROM panel""",
)
def rolling_quantile(spark, sf):
    q = W.roll(lambda x: F.percentile(x, 0.7), "ret", 63, 30, 1)
    return out(A.panel(spark, sf), q70=q, dp=8)


@query(
    "WIN-06",
    PANEL + f" SELECT symbol, ts, {r('(' + S.roll('product', '(1 + ret)', 126, 63) + ') - 1')} AS c126 FROM panel",
)
def rolling_compound(spark, sf):
    p = A.panel(spark, sf).withColumn("growth", 1 + F.col("ret"))
    return out(with_rolls(p, [Roll("g", "product", "growth", 126, 63)]), c126=F.col("g") - 1)


D_HL, D_SPAN = "pow(0.5::DOUBLE, 1.0::DOUBLE / 20)", "(1 - 2.0::DOUBLE / 33)"


@query(
    "WIN-07",
    PANEL + f" SELECT symbol, ts, {r(S.ewm('ret', D_HL, 20), 8)} AS hl20, {r(S.ewm('tr', D_SPAN, 32), 5)} AS span32 FROM panel",
)
def ewm_means(spark, sf):
    stats_ = [Ewm("hl20", "mean", "ret", halflife=20, min_periods=20), Ewm("span32", "mean", "tr", span=32, min_periods=32)]
    p = ewm(A.panel(spark, sf), stats_)
    return p.select("symbol", "ts", R("hl20", 8).alias("hl20"), R("span32", 5).alias("span32"))


@query(
    "WIN-08",
    PANEL
    + f"""
, k AS (SELECT *, pow({D_HL}, -CAST(pos AS DOUBLE)) AS wt FROM panel WHERE ret IS NOT NULL),
s AS (SELECT symbol, ts, count(*) {S.over()} AS n, sum(wt) {S.over()} AS sw, sum(wt * ret) {S.over()} AS sx,
  sum(wt * ret * ret) {S.over()} AS sxx, sum(wt * wt) {S.over()} AS sww FROM k)
SELECT p.symbol, p.ts, {r("CASE WHEN n >= 20 THEN sqrt(greatest((sxx / sw - (sx / sw) ** 2) * sw * sw / nullif(sw * sw - sww, 0), 0)) END", 8)} AS std20
FROM panel p LEFT JOIN s USING (symbol, ts)""",
)
def ewm_deviation(spark, sf):
    p = ewm(A.panel(spark, sf), [Ewm("s", "std", "ret", halflife=20, min_periods=20)])
    return out(p, std20=F.col("s"), dp=8)


@query(
    "WIN-09",
    PANEL
    + f""" SELECT symbol, ts, {r(f"product(1 + coalesce(ret, 0)) {S.over()}")} AS growth, {r(f"sum(coalesce(ret, 0)) {S.over()}", 8)} AS total,
{r(f"max(tr) {S.over()}")} AS peak FROM panel""",
)
def cumulative(spark, sf):
    w = W.cumulative()
    x = F.coalesce("ret", F.lit(0.0))
    return A.panel(spark, sf).select(
        "symbol", "ts", R(F.product(1 + x).over(w)).alias("growth"), R(F.sum(x).over(w), 8).alias("total"),
        R(F.max("tr").over(w)).alias("peak"),
    )


RANK_SQL = (
    "CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY ts, {x} IS NULL ORDER BY {x})"
    " + (count(*) OVER (PARTITION BY ts, {x}) - 1) / 2.0::DOUBLE END"
)


@query(
    "WIN-10",
    PANEL
    + f""", x AS (SELECT *, round(ret, 3) AS q FROM panel)
SELECT symbol, ts, {r(RANK_SQL.format(x="q"), 2)} AS rank, {r(RANK_SQL.format(x="q") + " / nullif(count(q) OVER (PARTITION BY ts), 0)")} AS pct FROM x""",
)
def section_rank(spark, sf):
    p = A.panel(spark, sf).withColumn("q", R("ret", 3)).repartition("ts")
    return p.select(
        "symbol", "ts", R(stats.xs_rank("q"), 2).alias("rank"), R(stats.xs_rank("q", pct=True)).alias("pct")
    )


@query(
    "WIN-11",
    PANEL
    + """, x AS (SELECT *, round(ret, 3) AS q FROM panel WHERE ret IS NOT NULL)
SELECT symbol, ts, row_number() OVER (PARTITION BY ts ORDER BY q DESC, symbol) AS rn,
  row_number() OVER (PARTITION BY ts, sector ORDER BY q DESC, symbol) AS rn_sector FROM x""",
)
def row_numbers(spark, sf):
    p = A.panel(spark, sf).filter(F.col("ret").isNotNull()).withColumn("q", R("ret", 3)).repartition("ts")
    rn = F.row_number()
    return p.select(
        "symbol",
        "ts",
        rn.over(Window.partitionBy("ts").orderBy(F.desc("q"), "symbol")).cast("long").alias("rn"),
        rn.over(Window.partitionBy("ts", "sector").orderBy(F.desc("q"), "symbol")).cast("long").alias("rn_sector"),
    )


@query(
    "WIN-12",
    PANEL
    + f""" SELECT symbol, ts, {r(f"first_value(close IGNORE NULLS) {S.over()}", 4)} AS first_close,
{r(f"last_value(close IGNORE NULLS) {S.over()}", 4)} AS last_close FROM dense""",
)
def first_and_last(spark, sf):
    w = W.cumulative()
    return A.dense_bars(spark, sf).select(
        "symbol",
        "ts",
        R(F.first("close", ignorenulls=True).over(w), 4).alias("first_close"),
        R(F.last("close", ignorenulls=True).over(w), 4).alias("last_close"),
    )


@query(
    "WIN-13",
    PANEL
    + f""", m AS (SELECT symbol, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month, product(1 + ret) - 1 AS mret FROM panel GROUP BY 1, 2)
SELECT symbol, month, {r("CASE WHEN count(mret) OVER w >= 2 THEN avg(mret) OVER w END")} AS seasonal FROM m
WINDOW w AS (PARTITION BY symbol, month(month) ORDER BY month ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""",
)
def seasonal_mean(spark, sf):
    from ...functions.scalar import as_ts

    m = A.panel(spark, sf).groupBy("symbol", F.trunc(day("ts"), "month").alias("m")).agg(
        stats.compound_return("ret").alias("mret")
    )
    m = m.withColumn("moy", F.month("m"))
    avg = W.roll(F.avg, "mret", 5, 2, 1, ("symbol", "moy"), "m")
    return m.select("symbol", as_ts("m").alias("month"), R(avg).alias("seasonal"))


ATR_SQL = """
trs AS (SELECT *, CASE WHEN close IS NOT NULL THEN greatest(high - low,
    coalesce(abs(high - lag(close) OVER (PARTITION BY symbol ORDER BY ts)), high - low),
    coalesce(abs(low - lag(close) OVER (PARTITION BY symbol ORDER BY ts)), high - low)) END AS trange FROM panel)"""


@query("WIN-14", S.with_(S.PANEL, ATR_SQL) + f" SELECT symbol, ts, {r(S.roll('avg', 'trange', 20, 10), 5)} AS atr FROM trs")
def atr(spark, sf):
    p = A.panel(spark, sf).withColumn("trange", W.true_range("high", "low", "close"))
    return out(with_rolls(p, [Roll("a", "avg", "trange", 20, 10)]), atr=F.col("a"), dp=5)


@query(
    "WIN-15",
    PANEL
    + f""", c AS (SELECT symbol, ts, coalesce(ret > 0, FALSE) AS up FROM panel)
SELECT symbol, ts, up AND NOT coalesce({S.shift("up")}, FALSE) AS edge FROM c""",
)
def edges(spark, sf):
    p = A.panel(spark, sf).select("symbol", "ts", (F.col("ret") > 0).alias("up"))
    return p.select("symbol", "ts", W.rising_edge(F.col("up")).alias("edge"))


@query(
    "WIN-16",
    PANEL
    + f""", c AS (SELECT symbol, ts, pos, coalesce(ret < 0, FALSE) AS dn FROM panel)
SELECT symbol, ts, CASE WHEN dn THEN pos - coalesce(max(CASE WHEN NOT dn THEN pos END) {S.over()}, -1) ELSE 0 END AS run,
  CAST(sum(CAST(dn AS INTEGER)) {S.over(5)} AS BIGINT) AS in5 FROM c""",
)
def run_lengths(spark, sf):
    p = A.panel(spark, sf).select("symbol", "ts", "pos", F.coalesce(F.col("ret") < 0, F.lit(False)).alias("dn"))
    return p.select(
        "symbol",
        "ts",
        W.run_length(F.col("dn")).cast("long").alias("run"),
        F.sum(F.col("dn").cast("long")).over(W.trailing(5)).alias("in5"),
    )


@query(
    "WIN-17",
    S.with_(S.PANEL, S.BASIS)
    + f""" SELECT symbol, ts, CAST(coalesce(last_value(CASE WHEN basis > 0.3 THEN 1 WHEN basis < 0.05 THEN 0 END IGNORE NULLS)
{S.over()}, 0) AS BIGINT) AS live FROM basis""",
)
def latch(spark, sf):
    b = A.basis(spark, sf)
    return b.select(
        "symbol", "ts", W.latch(F.col("basis") > 0.3, F.col("basis") < 0.05).cast("long").alias("live")
    )
