"""Ordering, top-k and set queries (TOP-*, SET-*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ...functions.scalar import as_ts, day
from ...functions.scalar import rnd as R
from ...operators import risk, sessions
from ...sources.store import merge_bars
from .. import adapters as A
from . import sqlbase as S
from .common import sample_book
from .registry import query

BARS, PANEL = S.with_(S.BARS), S.with_(S.PANEL)
BOOK = S.with_(S.PANEL, S.book(), S.accounts())
r = S.rnd


@query("TOP-01", BARS + f" SELECT symbol, ts, {r('value', 2)} AS value FROM bars ORDER BY ts DESC, symbol")
def ordered_bars(spark, sf):
    """Range-partitioned total order."""
    return A.bars(spark, sf).select("symbol", "ts", R("value", 2).alias("value")).orderBy(
        F.desc("ts"), "symbol"
    )


@query(
    "TOP-02",
    PANEL
    + """
, x AS (SELECT ts, symbol, ret, count(*) OVER w AS n, row_number() OVER (PARTITION BY ts ORDER BY ret DESC, symbol) AS rk
  FROM panel WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY ts)),
y AS (SELECT *, least(n, greatest(1, round_even(n * 0.1, 0))) AS nt FROM x)
SELECT ts, symbol, rk <= nt AS is_top FROM y
WHERE rk <= nt OR rk > n - least(greatest(1, round_even(n * 0.1, 0)), greatest(0, n - nt))""",
)
def extremes(spark, sf):
    p = A.panel(spark, sf).filter(F.col("ret").isNotNull())
    w = Window.partitionBy("ts")
    p = p.select(
        "ts",
        "symbol",
        F.count(F.lit(1)).over(w).alias("n"),
        F.row_number().over(w.orderBy(F.desc("ret"), "symbol")).alias("rk"),
    )
    k = F.greatest(F.lit(1), F.bround(F.col("n") * 0.1))
    top = F.least(F.col("n"), k)
    bottom = F.least(k, F.greatest(F.lit(0), F.col("n") - top))
    return p.filter((F.col("rk") <= top) | (F.col("rk") > F.col("n") - bottom)).select(
        "ts", "symbol", (F.col("rk") <= top).alias("is_top")
    )


@query(
    "TOP-03",
    PANEL
    + f"""
, g AS (SELECT ts, sector, avg(ret) AS m FROM panel WHERE ret IS NOT NULL GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY m DESC, sector) AS hi,
  row_number() OVER (PARTITION BY ts ORDER BY m, sector) AS lo FROM g)
SELECT ts, sector, hi, {r("m", 8)} AS m FROM k WHERE hi <= 2 OR lo <= 1""",
)
def best_groups(spark, sf):
    g = A.panel(spark, sf).filter(F.col("ret").isNotNull()).groupBy("ts", "sector").agg(F.avg("ret").alias("m"))
    w = Window.partitionBy("ts")
    k = g.withColumns(
        {
            "hi": F.row_number().over(w.orderBy(F.desc("m"), "sector")).cast("long"),
            "lo": F.row_number().over(w.orderBy("m", "sector")),
        }
    )
    return k.filter((F.col("hi") <= 2) | (F.col("lo") <= 1)).select("ts", "sector", "hi", R("m", 8).alias("m"))


@query(
    "TOP-04",
    PANEL
    + f""" SELECT ts, arg_min(symbol, (-ret, symbol)) AS symbol, {r("max(ret)", 8)} AS ret
FROM panel WHERE ret IS NOT NULL GROUP BY ts""",
)
def best_symbol(spark, sf):
    return (
        A.panel(spark, sf)
        .filter(F.col("ret").isNotNull())
        .groupBy("ts")
        .agg(F.min_by("symbol", F.struct(-F.col("ret"), "symbol")).alias("symbol"), R(F.max("ret"), 8).alias("ret"))
    )


@query(
    "TOP-05",
    S.with_(S.BARS, S.CURVE)
    + f""" SELECT ts, rn, CAST(expiry AS TIMESTAMP) AS expiry, {r("settle")} AS settle FROM (
  SELECT *, row_number() OVER (PARTITION BY ts ORDER BY expiry) AS rn FROM curve WHERE expiry > CAST(ts AS DATE)) WHERE rn <= 2""",
)
def first_expiries(spark, sf):
    live = A.vol_curve(spark, sf).filter(F.col("expiry") > F.col("date"))
    rn = F.row_number().over(Window.partitionBy("date").orderBy("expiry")).cast("long")
    return live.withColumn("rn", rn).filter(F.col("rn") <= 2).select(
        as_ts("date").alias("ts"), "rn", as_ts("expiry").alias("expiry"), R("settle").alias("settle")
    )


@query(
    "TOP-06",
    BOOK
    + f"""
, c AS (SELECT symbol, sum(w * r) AS contribution FROM held GROUP BY symbol),
k AS (SELECT *, row_number() OVER (ORDER BY contribution DESC, symbol) AS hi, row_number() OVER (ORDER BY contribution, symbol DESC) AS lo FROM c)
SELECT symbol, {r("contribution", 8)} AS contribution, hi <= 5 AS is_head FROM k WHERE hi <= 5 OR lo <= 5""",
)
def head_and_tail(spark, sf):
    """Best and worst contributors: two distributed top-k, not a global sort."""
    c = sample_book(spark, sf).positions.groupBy("symbol").agg(
        F.sum(F.col("w") * F.col("r")).alias("contribution")
    )
    head = c.orderBy(F.desc("contribution"), "symbol").limit(5)
    tail = c.orderBy("contribution", F.desc("symbol")).limit(5)
    both = head.withColumn("is_head", F.lit(True)).unionByName(tail.withColumn("is_head", F.lit(False)))
    return both.groupBy("symbol").agg(
        R(F.max("contribution"), 8).alias("contribution"), F.max("is_head").alias("is_head")
    )


@query(
    "TOP-07",
    PANEL
    + f"""
, cells AS (SELECT symbol, 252 * avg(r) / (stddev_samp(r) * sqrt(252)) AS sharpe FROM (
  SELECT symbol, CASE WHEN symbol > 'NATION_2' THEN ret END AS r FROM panel) GROUP BY symbol)
SELECT symbol, {r("sharpe", 4)} AS sharpe FROM cells ORDER BY sharpe DESC NULLS LAST, symbol LIMIT 15""",
)
def best_cells(spark, sf):
    from ...functions.stats import sharpe

    p = A.panel(spark, sf).withColumn("r", F.when(F.col("symbol") > "NATION_2", F.col("ret")))
    cells = p.groupBy("symbol").agg(sharpe("r").alias("sharpe"))
    return (
        cells.orderBy(F.desc_nulls_last("sharpe"), "symbol").limit(15).withColumn("sharpe", R("sharpe", 4))
    )


@query(
    "TOP-08",
    PANEL + f" SELECT symbol, ts, {r('ret', 8)} AS ret FROM panel ORDER BY ret DESC NULLS LAST, symbol, ts",
)
def sorted_nulls_last(spark, sf):
    p = A.panel(spark, sf).select("symbol", "ts", "ret")
    return p.orderBy(F.desc_nulls_last("ret"), "symbol", "ts").withColumn("ret", R("ret", 8))


# --- sets ------------------------------------------------------------------


@query(
    "SET-01",
    BARS
    + f"""
, a AS (SELECT symbol, ts, close, 0 AS g FROM bars WHERE ts < TIMESTAMP '1999-01-01'),
b AS (SELECT symbol, ts, close * 2 AS close, 1 AS g FROM bars WHERE ts >= TIMESTAMP '1998-01-01')
SELECT symbol, ts, {r("arg_max(close, g)", 4)} AS close FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2""",
)
def union_keep_last(spark, sf):
    b = A.bars(spark, sf).select("symbol", "ts", "close")
    old = b.filter(day("ts") < F.lit("1999-01-01").cast("date"))
    new = b.filter(day("ts") >= F.lit("1998-01-01").cast("date")).withColumn("close", F.col("close") * 2)
    return merge_bars(old, new, ("symbol", "ts")).withColumn("close", R("close", 4))


@query(
    "SET-02",
    S.with_(S.BARS, S.rebalance())
    + " SELECT ts FROM rebal INTERSECT SELECT ts FROM bars",
)
def traded_rebalances(spark, sf):
    traded = A.bars(spark, sf).select("ts")
    return sessions.rebalance_dates(A.calendar(spark, sf), "ME").intersect(traded)


@query(
    "SET-03",
    S.with_(S.NATIONS + S.EVENTS)
    + " SELECT symbol, event_date AS ts FROM cev WHERE status = 'O' UNION SELECT symbol, event_date FROM cev WHERE priority = '1-URGENT'",
)
def union_of_indexes(spark, sf):
    a = A.orders_by_symbol(spark, sf).filter(F.col("status") == "O")
    b = A.orders_by_symbol(spark, sf, "1-URGENT")
    cols = ["symbol", F.col("event_date").alias("ts")]
    return a.select(*cols).union(b.select(*cols)).distinct()


@query(
    "SET-04",
    BARS
    + """ SELECT symbol, ts FROM (SELECT symbol, ts FROM syms CROSS JOIN cal) EXCEPT SELECT symbol, ts FROM bars""",
)
def missing_keys(spark, sf):
    grid = sessions.grid_of(A.days(spark, sf), A.symbols(spark, sf).select("symbol"))
    return grid.select("symbol", "ts").join(A.bars(spark, sf).select("symbol", "ts"), ["symbol", "ts"], "left_anti")


@query(
    "SET-05",
    PANEL
    + f"""
, l AS (SELECT symbol, ts, 0.5 AS w FROM panel WHERE ret > 0), s AS (SELECT symbol, ts, -0.3 AS w FROM panel WHERE abs(ret) > 0.002)
SELECT symbol, ts, {r("sum(w)")} AS w FROM (SELECT * FROM l UNION ALL SELECT * FROM s) GROUP BY 1, 2""",
)
def union_of_legs(spark, sf):
    p = A.panel(spark, sf).select("symbol", "ts", "ret")
    longs = p.filter(F.col("ret") > 0).withColumn("w", F.lit(0.5))
    shorts = p.filter(F.abs("ret") > 0.002).withColumn("w", F.lit(-0.3))
    return risk.compose([longs, shorts], [1.0, 1.0]).withColumn("w", R("w"))
