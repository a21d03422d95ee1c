"""Join queries (JN-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.scalar import as_ts, day, div
from ...functions.scalar import rnd as R
from ...functions.window import cumulative
from ...operators import align, spread
from ...operators.universe import point_in_time_mask
from .. import adapters as A
from . import sqlbase as S
from .registry import query

BARS, PANEL = S.with_(S.BARS), S.with_(S.PANEL)
r = S.rnd
PE = S.with_(S.PANEL + S.EVENTS)


@query(
    "JN-01",
    BARS
    + """ SELECT symbol, ts, a.fast, b.slow, a.fast * 1000 + b.slow AS cell FROM bars,
(VALUES (5), (10), (20)) a(fast), (VALUES (50), (100)) b(slow)""",
)
def parameter_grid(spark, sf):
    """Every bar under every cell of a parameter grid, as a generator.

    The grid is a driver-side list, so the cells travel as one array.
    """
    cells = F.array(
        *[F.struct(F.lit(f).alias("fast"), F.lit(s).alias("slow")) for f in (5, 10, 20) for s in (50, 100)]
    )
    return (
        A.bars(spark, sf)
        .select("symbol", "ts", F.explode(cells).alias("c"))
        .select(
            "symbol",
            "ts",
            F.col("c.fast").cast("long").alias("fast"),
            F.col("c.slow").cast("long").alias("slow"),
            (F.col("c.fast") * 1000 + F.col("c.slow")).cast("long").alias("cell"),
        )
    )


@query(
    "JN-02",
    PANEL
    + f""" SELECT p.symbol, p.ts, {r("p.close")} AS px, {r("b.close")} AS last_trade
FROM panel p LEFT JOIN bars b ON p.symbol = b.symbol AND p.ts = b.ts""",
)
def align_left(spark, sf):
    b = A.bars(spark, sf).select("symbol", "ts", F.col("close").alias("last_trade"))
    return (
        A.panel(spark, sf)
        .select("symbol", "ts", "close")
        .join(b, ["symbol", "ts"], "left")
        .select("symbol", "ts", R("close").alias("px"), R("last_trade").alias("last_trade"))
    )


@query(
    "JN-03",
    S.with_(S.PANEL, S.MEMBERS)
    + """
SELECT g.symbol, g.ts, EXISTS (SELECT 1 FROM membership m WHERE m.symbol = g.symbol
  AND m.date = (SELECT max(date) FROM membership x WHERE x.date <= g.ts)) AS in_universe FROM grid g""",
)
def membership_asof(spark, sf):
    p = A.panel(spark, sf).select("symbol", "ts", "in_universe")
    return point_in_time_mask(p, A.calendar(spark, sf), A.membership(spark, sf)).select(
        "symbol", "ts", "in_universe"
    )


FUND_SQL = """
fund AS (
  SELECT symbol, event_date AS ts, avg(CAST(round(magnitude * 100) AS BIGINT)) / 100 AS value
  FROM cev GROUP BY 1, 2)"""


def fundamentals(spark, sf):
    """Mean order value per symbol and day, as a published metric."""
    return A.corp_events(spark, sf).groupBy("symbol", F.col("event_date").alias("ts")).agg(
        (F.avg(F.round(F.col("magnitude") * 100).cast("long")) / 100).alias("value")
    )


def stale_asof(panel, facts, limit, out="value"):
    """Latest fact at or before each bar, at most ``limit`` rows old.

    Rows are those of the union of bar dates and fact dates, per symbol.
    """
    union = (
        panel.select("symbol", "ts", F.lit(True).alias("_bar"))
        .unionByName(facts.select("symbol", "ts", F.col("value").alias("_v")), allowMissingColumns=True)
        .groupBy("symbol", "ts")
        .agg(F.max("_bar").alias("_bar"), F.max("_v").alias("_v"))
    )
    w = cumulative()
    n = F.count(F.lit(1)).over(w)
    got = F.last(F.when(F.col("_v").isNotNull(), F.struct("_v", "_n")), ignorenulls=True).over(w)
    return (
        union.withColumn("_n", n)
        .withColumn("_f", got)
        .filter("_bar")
        .select("symbol", "ts", F.when(F.col("_n") - F.col("_f._n") <= limit, F.col("_f._v")).alias(out))
    )


@query(
    "JN-04",
    S.with_(S.PANEL + S.EVENTS, FUND_SQL)
    + f"""
, u AS (SELECT symbol, ts, max(bar) AS bar, max(value) AS value FROM (
    SELECT symbol, ts, 1 AS bar, NULL::DOUBLE AS value FROM grid UNION ALL SELECT symbol, ts, 0, value FROM fund)
  WHERE symbol IN (SELECT symbol FROM syms) GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM u),
f AS (SELECT *, {S.ffill("value")} AS v, {S.ffill("CASE WHEN value IS NOT NULL THEN rn END")} AS vn FROM n)
SELECT symbol, ts, {r("CASE WHEN rn - vn <= 60 THEN v END", 4)} AS value FROM f WHERE bar = 1""",
)
def fundamentals_asof(spark, sf):
    p = A.panel(spark, sf).select("symbol", "ts")
    return stale_asof(p, fundamentals(spark, sf), 60).withColumn("value", R("value", 4))


@query(
    "JN-05",
    S.with_(S.PANEL + S.EVENTS, S.DIVS)
    + f"""
, d AS (SELECT symbol, ex_date, sum(value) AS v FROM divs GROUP BY 1, 2),
t AS (SELECT symbol, v, (SELECT min(ts) FROM cal WHERE cal.ts >= d.ex_date) AS ts FROM d)
SELECT symbol, ts, {r("sum(v)")} AS div FROM t WHERE ts IS NOT NULL GROUP BY 1, 2""",
)
def dividends_forward(spark, sf):
    from ...operators.adjust import dividends_on_bars

    c = A.calendar(spark, sf)
    return (
        dividends_on_bars(A.dividends(spark, sf), c)
        .join(F.broadcast(c), "pos")
        .select("symbol", "ts", R("div").alias("div"))
    )


@query(
    "JN-06",
    PE
    + """
, e AS (SELECT symbol, event_date, count(*) AS n FROM cev GROUP BY 1, 2)
SELECT symbol, event_date, n, (SELECT count(*) FROM cal WHERE ts <= event_date) - 1 AS pos_back,
  (SELECT count(*) FROM cal WHERE ts < event_date) AS pos_fwd FROM e""",
)
def event_positions(spark, sf):
    e = A.corp_events(spark, sf).groupBy("symbol", "event_date").agg(F.count("*").alias("n"))
    return align.snap(e, A.calendar(spark, sf), "event_date").select(
        "symbol", "event_date", "n", "pos_back", "pos_fwd"
    )


@query(
    "JN-07",
    PE
    + f"""
, e AS (SELECT symbol, event_date, count(*) AS n FROM cev GROUP BY 1, 2),
s AS (SELECT symbol, n, (SELECT count(*) FROM cal WHERE ts <= event_date) - 1 AS pos FROM e)
SELECT p.symbol, p.ts, sum(n) AS n_live, {r("max(p.close)")} AS close FROM s JOIN panel p
ON p.symbol = s.symbol AND p.pos BETWEEN s.pos AND s.pos + 4 WHERE s.pos >= 0 GROUP BY 1, 2""",
)
def event_windows(spark, sf):
    e = A.corp_events(spark, sf).groupBy("symbol", "event_date").agg(F.count("*").alias("n"))
    snapped = align.snap(e, A.calendar(spark, sf), "event_date").filter(F.col("pos_back") >= 0)
    cells = align.event_window(
        snapped.select("symbol", "n", "pos_back"), F.col("pos_back"), F.col("pos_back") + 4
    )
    return (
        cells.groupBy("symbol", "pos")
        .agg(F.sum("n").alias("n_live"))
        .join(A.panel(spark, sf).select("symbol", "pos", "ts", "close"), ["symbol", "pos"])
        .select("symbol", "ts", "n_live", R("close").alias("close"))
    )


PAIRS_SQL = """
pf AS (SELECT sector, symbol, ret, avg(ret) OVER (PARTITION BY sector, ts) AS m FROM panel WHERE pos < 504 AND ret IS NOT NULL),
pn AS (SELECT sector, symbol, round(covar_pop(ret, m) / nullif(var_pop(m), 0), 9) AS b FROM pf GROUP BY 1, 2),
pl0 AS (SELECT symbol AS sa, lead(symbol) OVER (PARTITION BY sector ORDER BY b, symbol) AS sb FROM pn WHERE b IS NOT NULL),
pairs AS MATERIALIZED (SELECT sa || '/' || sb AS pair_id, sa, sb FROM pl0 WHERE sb IS NOT NULL)"""


def pair_list(spark, sf):
    """Neighbours by beta inside each sector."""
    return spread.neighbours(A.panel(spark, sf))


@query(
    "JN-08",
    S.with_(S.PANEL, PAIRS_SQL)
    + f"""
SELECT pair_id, a.ts, {r("a.tr")} AS a, {r("b.tr")} AS b FROM pairs JOIN panel a ON a.symbol = sa
JOIN panel b ON b.symbol = sb AND a.ts = b.ts""",
)
def pair_legs(spark, sf):
    return align.legs(pair_list(spark, sf), A.panel(spark, sf)).select(
        "pair_id", "ts", R("a").alias("a"), R("b").alias("b")
    )


@query(
    "JN-09",
    S.with_(S.BARS, S.CURVE)
    + f"""
, k AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY expiry) AS rn FROM curve WHERE expiry > CAST(ts AS DATE))
SELECT ts, {r("max(settle) FILTER (WHERE rn = 1)")} AS near, {r("max(settle) FILTER (WHERE rn = 2)")} AS far
FROM k GROUP BY ts HAVING count(*) FILTER (WHERE rn <= 2) = 2""",
)
def near_far(spark, sf):
    from ...operators.carry import front_pair

    return front_pair(A.vol_curve(spark, sf)).select(
        as_ts("date").alias("ts"), R("vx1").alias("near"), R("vx2").alias("far")
    )


@query(
    "JN-10",
    S.with_(S.BARS)
    + """
, codes AS (SELECT DISTINCT 'N_' || (p_size % 30) AS code FROM part)
SELECT code, min(symbol) AS symbol FROM codes JOIN syms ON contains(symbol, code) GROUP BY code""",
)
def symbol_by_code(spark, sf):
    """First symbol containing each code.

    Codes are matched against all substrings a symbol offers, so the "contains"
    test is an equi-join on the code rather than a comparison of every pair.
    """
    codes = A.table(spark, sf, "part").select(
        F.concat(F.lit("N_"), (F.col("p_size") % 30).cast("string")).alias("code")
    ).distinct()
    s = A.symbols(spark, sf).select("symbol")
    length = F.length("symbol")
    parts = s.withColumn("_i", F.explode(F.sequence(F.lit(1), length))).withColumn(
        "_l", F.explode(F.sequence(F.lit(1), length - F.col("_i") + 1))
    )
    keys = parts.select("symbol", F.substr("symbol", F.col("_i"), F.col("_l")).alias("code")).distinct()
    return keys.join(codes, "code").groupBy("code").agg(F.min("symbol").alias("symbol"))


@query(
    "JN-11",
    PANEL
    + f"""
, a AS (SELECT symbol, ts, ret AS w FROM panel WHERE pos % 2 = 0 OR sector < 'B'),
b AS (SELECT symbol, ts, -0.5 * ret AS w FROM panel WHERE pos % 3 = 0)
SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.ts, b.ts) AS ts,
  {r("0.5 * coalesce(a.w, 0) + 0.5 * coalesce(b.w, 0)", 8)} AS w FROM a FULL JOIN b ON a.symbol = b.symbol AND a.ts = b.ts""",
)
def sleeve_alignment(spark, sf):
    from ...operators.risk import compose

    p = A.panel(spark, sf).select("symbol", "sector", "ts", "pos", F.coalesce("ret", F.lit(0.0)).alias("ret"))
    a = p.filter((F.col("pos") % 2 == 0) | (F.col("sector") < "B")).withColumn("w", F.col("ret"))
    b = p.filter(F.col("pos") % 3 == 0).withColumn("w", F.col("ret") * -0.5)
    return compose([a, b]).withColumn("w", R("w", 8))


@query(
    "JN-12",
    BARS
    + f""" SELECT sector, count(*) AS n, {r("sum(value)", 2)} AS value FROM bars GROUP BY sector""",
)
def sector_dimension(spark, sf):
    return (
        A.bars(spark, sf)
        .join(F.broadcast(A.symbols(spark, sf)), "symbol")
        .groupBy("sector")
        .agg(F.count("*").alias("n"), R(F.sum("value"), 2).alias("value"))
    )


@query(
    "JN-13",
    PE
    + """
SELECT 'known' AS side, count(*) AS n FROM cev WHERE symbol IN (SELECT symbol FROM syms WHERE symbol < 'NATION_2')
UNION ALL SELECT 'unknown', count(*) FROM cev WHERE symbol NOT IN (SELECT symbol FROM syms WHERE symbol < 'NATION_2')""",
)
def semi_and_anti(spark, sf):
    e = A.orders_by_symbol(spark, sf)
    s = F.broadcast(A.symbols(spark, sf).filter(F.col("symbol") < "NATION_2"))
    known = e.join(s, "symbol", "left_semi").agg(F.count("*").alias("n"))
    unknown = e.join(s, "symbol", "left_anti").agg(F.count("*").alias("n"))
    return known.select(F.lit("known").alias("side"), "n").unionByName(
        unknown.select(F.lit("unknown").alias("side"), "n")
    )


BENCH_SQL = """
bench AS (SELECT ts, sum(CAST(round(value * 100) AS BIGINT)) / 100.0::DOUBLE / sum(volume) AS close
  FROM bars WHERE isodow(CAST(ts AS DATE)) <= 5 GROUP BY ts),
benchmark_eq AS (SELECT ts, pos, last_value(close IGNORE NULLS) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING)
    / first_value(close IGNORE NULLS) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS bench
  FROM cal LEFT JOIN bench USING (ts))"""


def benchmark(spark, sf):
    """Weekday value per unit over all symbols."""
    return (
        A.bars(spark, sf)
        .filter(F.weekday(day("ts")) < 5)
        .groupBy("ts")
        .agg(
            (
                F.sum(F.round(F.col("value") * 100).cast("long")) / 100 / F.sum("volume")
            ).alias("close")
        )
    )


@query("JN-14", S.with_(S.BARS, BENCH_SQL) + f" SELECT ts, {r('bench')} AS bench FROM benchmark_eq")
def benchmark_curve(spark, sf):
    from ...operators.accounting import benchmark_equity

    return benchmark_equity(A.calendar(spark, sf), benchmark(spark, sf)).select(
        "ts", R("bench").alias("bench")
    )


@query(
    "JN-15",
    S.with_(S.PANEL, S.HEDGES)
    + f"""
, m AS (SELECT symbol AS spot, hedge AS fut FROM hedges),
s AS (SELECT symbol, ts, CASE WHEN ret > 0 THEN 0.05 ELSE 0 END AS w FROM panel JOIN m ON symbol = spot),
l AS (SELECT symbol, ts, w FROM s UNION ALL SELECT fut, ts, -w FROM s JOIN m ON symbol = spot)
SELECT symbol, ts, {r("sum(w)")} AS w FROM l GROUP BY 1, 2""",
)
def opposite_legs(spark, sf):
    spot = A.panel(spark, sf).select(
        "symbol", "ts", F.when(F.col("ret") > 0, 0.05).otherwise(0.0).alias("w")
    )
    return hedged(spot, A.hedges(spark, sf)).withColumn("w", R("w"))


def hedged(spot, pairs):
    """Each spot weight with the opposite weight in its mapped symbol.

    The mapping has one row for a symbol; its size at run time decides how it is joined.
    """
    both = spot.join(pairs, "symbol")
    return (
        both.select("symbol", "ts", "w")
        .unionByName(both.select(F.col("hedge").alias("symbol"), "ts", (-F.col("w")).alias("w")))
        .groupBy("symbol", "ts")
        .agg(F.sum("w").alias("w"))
    )


def asof_ticks(spark, sf):
    """Daily bars of ticks with the last print before each hour (as-of demo)."""
    t = A.ticks(spark, sf)
    hours = t.select("symbol", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).distinct()
    return align.asof_backward(hours, t, ["symbol"], "price", "price", bucket="day").select(
        "symbol", "ts", R(div("price", F.lit(1.0))).alias("price")
    )


query(
    "JN-03b",
    S.with_(S.TICKS)
    + f"""
, h AS (SELECT DISTINCT symbol, date_trunc('hour', ts) AS ts FROM ticks)
SELECT h.symbol, h.ts, {r("t.price")} AS price FROM h ASOF LEFT JOIN ticks t ON h.symbol = t.symbol AND h.ts >= t.ts""",
)(asof_ticks)
