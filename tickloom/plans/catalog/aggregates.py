"""Aggregation queries (AGG-*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ...functions import stats
from ...functions.scalar import as_ts, day, div
from ...functions.scalar import rnd as R
from ...functions.window import shift
from ...operators import accounting, align, metrics
from .. import adapters as A
from . import sqlbase as S
from .common import sample_book
from .joins import PAIRS_SQL, pair_list
from .registry import query

BARS, PANEL = S.with_(S.BARS), S.with_(S.PANEL)
EV = S.with_(S.NATIONS + S.EVENTS)
BOOK = S.with_(S.PANEL, S.book(), S.accounts())
r = S.rnd


@query(
    "AGG-01",
    BOOK
    + f""" SELECT ts, {r("sum(abs(w))", 8)} AS gross, {r("sum(w)", 8)} AS net, {r("sum(greatest(w, 0))", 8)} AS long,
{r("sum(least(w, 0))", 8)} AS short, CAST(count(*) FILTER (WHERE abs(w) > 1e-9) AS DOUBLE) AS n_positions FROM held GROUP BY ts""",
)
def exposure(spark, sf):
    e = accounting.exposure(sample_book(spark, sf).positions)
    return e.select("ts", *[R(c, 8).alias(c) for c in ("gross", "net", "long", "short")], "n_positions")


@query("AGG-02", BOOK + f" SELECT ts, {r('0.5 * sum(abs(dw))', 8)} AS turnover FROM held GROUP BY ts")
def turnover(spark, sf):
    return accounting.turnover(sample_book(spark, sf).positions).select("ts", R("turnover", 8).alias("turnover"))


@query(
    "AGG-03",
    PANEL
    + f""" SELECT DISTINCT ts, sector, {r("avg(ret) OVER (PARTITION BY ts)", 8)} AS market, {r("stddev_samp(ret) OVER (PARTITION BY ts)", 8)} AS spread,
{r("avg(ret) OVER (PARTITION BY ts, sector)", 8)} AS sector_mean FROM panel""",
)
def section_means(spark, sf):
    """Date and sector moments from one aggregate: sector sums roll up to dates."""
    by_sector = A.panel(spark, sf).groupBy("ts", "sector").agg(
        F.avg("ret").alias("sector_mean"),
        F.count("ret").alias("n"),
        F.coalesce(F.sum("ret"), F.lit(0.0)).alias("s"),
        F.coalesce(F.var_pop("ret") * F.count("ret"), F.lit(0.0)).alias("m2"),
    )
    w = Window.partitionBy("ts")
    n, mean = F.sum("n").over(w), div(F.sum("s").over(w), F.sum("n").over(w))
    d = by_sector.withColumns({"nn": n, "market": mean})
    between = F.col("n") * F.pow(F.coalesce(F.col("sector_mean") - F.col("market"), F.lit(0.0)), 2)
    var = div(F.sum(F.col("m2") + between).over(w), F.col("nn") - 1)
    return d.select(
        "ts", "sector", R("market", 8).alias("market"),
        R(F.when(F.col("nn") > 1, F.sqrt(var)), 8).alias("spread"), R("sector_mean", 8).alias("sector_mean"),
    )


@query(
    "AGG-04",
    PANEL
    + f""" SELECT symbol, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month, {r("product(1 + ret) - 1")} AS ret,
count(ret) AS n FROM panel GROUP BY 1, 2""",
)
def compounded(spark, sf):
    return A.panel(spark, sf).groupBy("symbol", as_ts(F.trunc(day("ts"), "month")).alias("month")).agg(
        R(stats.compound_return("ret")).alias("ret"), F.count("ret").alias("n")
    )


MONTH_CELLS = ", ".join(
    f"{r(f'product(1 + net) FILTER (WHERE month(ts) = {i}) - 1')} AS m{i:02d}" for i in range(1, 13)
)


@query(
    "AGG-05",
    BOOK + f" SELECT year(ts) AS year, {MONTH_CELLS}, {r('product(1 + net) - 1')} AS total FROM daily GROUP BY 1",
)
def month_table(spark, sf):
    t = metrics.monthly_table(sample_book(spark, sf).daily)
    cols = [c for c in t.columns if c not in ("run_id", "year")]
    return t.select(F.col("year").cast("long").alias("year"), *[R(c).alias(c) for c in cols])


PER_YEAR_SQL = f"""
lab AS (
  SELECT *, CAST(year(ts) AS VARCHAR) AS period FROM daily
  UNION ALL SELECT *, 'pre-1998-02-24' FROM daily WHERE ts < TIMESTAMP '1998-02-24'
  UNION ALL SELECT *, 'post-1998-03-24' FROM daily WHERE ts > TIMESTAMP '1998-03-24'),
eqs AS (SELECT *, product(1 + net) OVER (PARTITION BY period ORDER BY ts ROWS UNBOUNDED PRECEDING) AS eq FROM lab),
dds AS (SELECT *, eq / max(eq) OVER (PARTITION BY period ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM eqs)"""


@query(
    "AGG-06",
    S.with_(S.PANEL, S.book(), S.accounts(), PER_YEAR_SQL)
    + f""" SELECT period, {r("product(1 + gross) - 1")} AS gross, {r("product(1 + net) - 1")} AS net,
{r(S.sharpe("net"), 4)} AS sharpe_net, {r("min(dd)")} AS max_dd, count(net) AS n_obs,
{r("product(1 + gross) - product(1 + net)")} AS cost_drag FROM dds GROUP BY period""",
)
def per_year(spark, sf):
    t = metrics.per_year_table(sample_book(spark, sf).daily, split=("1998-02-24", "1998-03-24"))
    return t.select(
        "period",
        *[R(c).alias(c) for c in ("gross", "net", "max_dd", "cost_drag")],
        R("sharpe_net", 4).alias("sharpe_net"),
        "n_obs",
    )


@query(
    "AGG-07",
    BOOK
    + " "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS component, {r(f'sum({c})', 8)} AS total, {r(f'avg({c}) * 252', 8)} AS ann_drag FROM daily"
        for c in ("commission", "spread", "impact", "borrow")
    ),
)
def cost_attribution(spark, sf):
    t = metrics.cost_attribution(sample_book(spark, sf).daily)
    return t.select("component", R("total", 8).alias("total"), R("ann_drag", 8).alias("ann_drag"))


@query(
    "AGG-08",
    EV
    + f"""
, t AS (SELECT CASE status WHEN 'P' THEN '' ELSE symbol || ':' || status END AS tag, event_date AS ts,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE (CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) * magnitude END AS pnl FROM cev)
SELECT CASE WHEN tag = '' THEN 'untagged' ELSE tag END AS tag, min(ts) AS start, max(ts) AS "end", count(*) AS n_trades,
  {r("coalesce(sum(CAST(round(pnl * 100) AS BIGINT)), 0) / 100.0::DOUBLE", 2)} AS pnl,
  CAST(date_diff('day', min(ts), max(ts)) AS DOUBLE) AS duration_days FROM t GROUP BY 1""",
)
def episodes(spark, sf):
    ev = A.orders_by_symbol(spark, sf)
    k = F.col("event_id")
    pnl = F.when(k % 4 == 0, F.lit(None)).otherwise(
        F.when(k % 2 == 0, 1).otherwise(-1) * F.round(F.col("magnitude") * 100).cast("long")
    )
    t = ev.select(
        F.when(F.col("status") == "P", "").otherwise(F.concat_ws(":", "symbol", "status")).alias("tag"),
        F.col("event_date").alias("ts"),
        pnl.cast("long").alias("pnl"),
    )
    out = metrics.episode_table(t)
    return out.withColumn("pnl", R(F.col("pnl") / 100, 2))


@query(
    "AGG-09",
    S.with_(S.BARS, S.SURFACE)
    + f""" SELECT ts, {r("median(iv)")} AS atm FROM (SELECT *, min(expiry) OVER (PARTITION BY ts) AS e FROM surface)
WHERE expiry = e GROUP BY ts""",
)
def atm_median(spark, sf):
    return atm(A.option_surface(spark, sf)).select(as_ts("date").alias("ts"), R("atm").alias("atm"))


def atm(surface):
    """Median volatility of each date's nearest expiry.

    Medians per (date, expiry) first, with map-side merging; the nearest expiry
    of a date is then picked among those few rows.
    """
    per = surface.groupBy("date", "expiry").agg(F.median("iv").alias("iv"))
    return per.groupBy("date").agg(F.min_by("iv", "expiry").alias("atm"))


@query(
    "AGG-10",
    PANEL
    + f" SELECT symbol, {r('skewness(ret)')} AS skew, {r('kurtosis(ret)', 5)} AS kurtosis, count(ret) AS n FROM panel GROUP BY symbol",
)
def higher_moments(spark, sf):
    return A.panel(spark, sf).groupBy("symbol").agg(
        R(stats.sample_skew("ret")).alias("skew"),
        R(stats.sample_kurtosis("ret"), 5).alias("kurtosis"),
        F.count("ret").alias("n"),
    )


@query(
    "AGG-11",
    PANEL
    + f"""
, m AS (SELECT ts, avg(ret) AS b FROM panel GROUP BY ts),
j AS (SELECT symbol, ret AS x, b FROM panel JOIN m USING (ts) WHERE ret IS NOT NULL AND b IS NOT NULL)
SELECT symbol, {r("covar_samp(x, b) / var_samp(b)")} AS beta, {r("corr(x, b)")} AS corr,
  {r("(avg(x) - covar_samp(x, b) / var_samp(b) * avg(b)) * 252")} AS alpha_ann,
  {r("stddev_samp(x - b) * sqrt(252)")} AS te_ann, {r("avg(x - b) * 252 / (stddev_samp(x - b) * sqrt(252))", 4)} AS ir
FROM j GROUP BY symbol""",
)
def against_market(spark, sf):
    p = A.panel(spark, sf).select("symbol", "ts", "ret")
    m = p.groupBy("ts").agg(F.avg("ret").alias("b"))
    j = p.join(m, "ts").filter(F.col("ret").isNotNull() & F.col("b").isNotNull())
    beta = div(F.covar_samp("ret", "b"), F.var_samp("b"))
    d = F.col("ret") - F.col("b")
    te = F.stddev_samp(d) * F.sqrt(F.lit(252.0))
    return j.groupBy("symbol").agg(
        R(beta).alias("beta"),
        R(stats.correlation("ret", "b")).alias("corr"),
        R((F.avg("ret") - beta * F.avg("b")) * 252).alias("alpha_ann"),
        R(te).alias("te_ann"),
        R(div(F.avg(d) * 252, te), 4).alias("ir"),
    )


LEGS_SQL = f"""{PAIRS_SQL},
legs AS MATERIALIZED (SELECT pair_id, sa, sb, a.ts, a.pos, a.tr AS a, b.tr AS b FROM pairs JOIN panel a ON a.symbol = sa
  JOIN panel b ON b.symbol = sb AND a.ts = b.ts)"""


@query(
    "AGG-12",
    S.with_(S.PANEL, LEGS_SQL)
    + f""" SELECT pair_id, {r("regr_slope(ln(a), ln(b))")} AS beta, {r("avg(a / b)")} AS ratio FROM legs
WHERE a > 0 AND b > 0 GROUP BY pair_id""",
)
def hedge_ratio(spark, sf):
    legs = align.legs(pair_list(spark, sf), A.panel(spark, sf))
    return legs.groupBy("pair_id").agg(
        R(stats.ols_log_slope("a", "b")).alias("beta"), R(stats.mean_ratio("a", "b")).alias("ratio")
    )


@query(
    "AGG-13",
    S.with_(S.PANEL, LEGS_SQL)
    + f"""
, s AS (SELECT pair_id, pos, ln(a) - ln(b) AS s FROM legs WHERE a > 0 AND b > 0),
l AS (SELECT pair_id, s, lag(s) OVER (PARTITION BY pair_id ORDER BY pos) AS p FROM s),
f AS (SELECT pair_id, regr_slope(s - p, p) AS b, count(*) AS n FROM l GROUP BY pair_id)
SELECT pair_id, n, {r("CASE WHEN n < 10 THEN NULL WHEN b >= -1e-12 THEN 1e9 WHEN 1 + b <= 0 THEN 0 ELSE -ln(2) / ln(1 + b) END", 4)} AS half_life FROM f""",
)
def ar1_half_life(spark, sf):
    legs = align.legs(pair_list(spark, sf), A.panel(spark, sf)).filter((F.col("a") > 0) & (F.col("b") > 0))
    s = legs.withColumn("s", F.ln("a") - F.ln("b"))
    s = s.withColumn("p", shift("s", 1, ("pair_id",), "pos"))
    f = s.groupBy("pair_id").agg(
        F.regr_slope(F.col("s") - F.col("p"), F.col("p")).alias("b"), F.count("*").alias("n")
    )
    hl = stats.half_life(F.col("b"), F.col("n"))
    return f.select("pair_id", "n", R(F.least(hl, F.lit(1e9)), 4).alias("half_life"))


@query(
    "AGG-14",
    S.with_(S.BARS, S.MEMBERS)
    + """ SELECT 'dates' AS what, count(DISTINCT date) AS n FROM membership
UNION ALL SELECT 'symbols', count(DISTINCT symbol) FROM membership
UNION ALL SELECT 'members', count(*) FROM (SELECT DISTINCT date, symbol FROM membership)""",
)
def distinct_members(spark, sf):
    m = A.membership(spark, sf)
    counts = m.agg(
        F.count_distinct("date").alias("dates"),
        F.count_distinct("symbol").alias("symbols"),
        F.count_distinct("date", "symbol").alias("members"),
    )
    return counts.unpivot([], ["dates", "symbols", "members"], "what", "n")


@query(
    "AGG-15",
    BOOK
    + """ SELECT symbol, year(ts) AS year, count(*) AS n_trades, count(*) FILTER (WHERE dw > 0) AS n_buys
FROM held WHERE abs(dw) > 1e-6 GROUP BY 1, 2""",
)
def trade_counts(spark, sf):
    t = sample_book(spark, sf).positions.filter(F.abs("dw") > accounting.TRADE_TOL)
    return t.groupBy("symbol", F.year(day("ts")).cast("long").alias("year")).agg(
        F.count("*").alias("n_trades"), F.count(F.when(F.col("dw") > 0, 1)).alias("n_buys")
    )
