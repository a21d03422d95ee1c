"""Event-study queries (EVT-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.scalar import rnd as R
from ...operators import events as E
from .. import adapters as A
from . import sqlbase as S
from .registry import query

BASE = S.PANEL + S.EVENTS
r = S.rnd


def event_weights_sql(name, src, lag, hold, weight, date="event_date", side="1", max_gross=1.0, back=True):
    """CTEs for overlapping cohorts from ``src`` to ``name(symbol, ts, w)``."""
    return f"""
{name}_d AS (SELECT symbol, {date} AS d, sum({side}) AS s FROM {src} GROUP BY 1, 2),
{name}_p AS (SELECT symbol, s, (SELECT count(*) FROM cal WHERE ts <= d) - 1 + {lag} AS pos FROM {name}_d),
{name}_q AS (SELECT symbol, pos, sum(s) AS s FROM {name}_p WHERE pos >= 0 AND pos <= (SELECT max(pos) FROM cal) GROUP BY 1, 2),
{name}_w AS (SELECT g.symbol, g.ts, CAST(sum(coalesce(q.s, 0)) OVER (PARTITION BY g.symbol ORDER BY g.pos
  ROWS BETWEEN {hold - 1} PRECEDING AND CURRENT ROW) AS BIGINT) AS n FROM grid g LEFT JOIN {name}_q q ON g.symbol = q.symbol AND g.pos = q.pos),
{name}_g AS (SELECT symbol, ts, n, CAST(sum(abs(n)) OVER (PARTITION BY ts) AS DOUBLE) AS gross FROM {name}_w),
{name} AS (SELECT symbol, ts, CASE WHEN gross * {weight}::DOUBLE > {max_gross}::DOUBLE
  THEN n * {max_gross}::DOUBLE / gross ELSE n * {weight}::DOUBLE END AS w FROM {name}_g)"""


@query(
    "EVT-01",
    S.with_(
        BASE,
        "ev AS (SELECT *, CASE WHEN status = 'O' THEN -1 ELSE 1 END AS side FROM cev)",
        event_weights_sql("x", "ev", 2, 60, 0.02, side="side"),
    )
    + f" SELECT symbol, ts, {r('w', 8)} AS w FROM x",
)
def cohorts(spark, sf):
    ev = A.corp_events(spark, sf).withColumn("side", F.when(F.col("status") == "O", -1).otherwise(1))
    w = E.event_weights(A.panel(spark, sf), ev, A.calendar(spark, sf), 2, 60, 0.02, side="side")
    return w.select("symbol", "ts", R("w", 8).alias("w"))


@query(
    "EVT-02",
    S.with_(
        BASE,
        f"""
ar AS (SELECT symbol, pos, sum(coalesce(ret - m, 0)) {S.over(None, 0, "symbol", "pos")} AS c FROM (
  SELECT *, avg(ret) OVER (PARTITION BY ts) AS m FROM panel)),
e AS (SELECT symbol, (SELECT count(*) FROM cal WHERE ts <= event_date) - 1 AS p, count(*) AS n FROM cev GROUP BY 1, event_date),
k AS (SELECT symbol, p, n, unnest(generate_series(-5, 60)) AS k FROM e)
""",
    )
    + f"""
SELECT k AS event_bar, {r("sum((a.c - coalesce(b.c, 0)) * n) / sum(n)")} AS mean_car, CAST(sum(n) AS BIGINT) AS n
FROM k JOIN ar a ON a.symbol = k.symbol AND a.pos = p + k LEFT JOIN ar b ON b.symbol = k.symbol AND b.pos = p - 6 GROUP BY k""",
)
def car_curve(spark, sf):
    c = E.car_curve(A.panel(spark, sf), A.corp_events(spark, sf), A.calendar(spark, sf))
    return c.select("event_bar", R("mean_car").alias("mean_car"), "n")


EARN_SQL = f"""
earn AS (SELECT symbol, event_date AS report_ts, magnitude / 1e5 AS actual,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE 2 + event_id % 2 END AS consensus, event_id FROM cev),
ar2 AS (SELECT symbol, pos, coalesce(sum(x) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING), 0) AS car FROM (
  SELECT symbol, pos, ret - avg(ret) OVER (PARTITION BY ts) AS x FROM panel)),
es AS (SELECT *, (SELECT count(*) FROM cal WHERE ts <= report_ts) - 1 AS pb FROM earn),
sided AS (SELECT es.symbol, report_ts, event_id, CASE
    WHEN consensus IS NOT NULL THEN CASE WHEN actual - consensus > 0 THEN 1 ELSE -1 END
    WHEN pb >= 0 AND pb < (SELECT max(pos) FROM cal) AND car IS NOT NULL THEN CASE WHEN car > 0 THEN 1 ELSE -1 END
    ELSE 0 END AS side FROM es LEFT JOIN ar2 ON ar2.symbol = es.symbol AND ar2.pos = pb)"""


def earnings(spark, sf):
    """Urgent orders as earnings reports, a third without consensus."""
    k = F.col("event_id")
    return A.corp_events(spark, sf).select(
        "symbol",
        F.col("event_date").alias("report_ts"),
        (F.col("magnitude") / 1e5).alias("eps_actual"),
        F.when(k % 3 != 0, (2 + k % 2).cast("double")).alias("eps_consensus"),
        "event_id",
    )


@query(
    "EVT-03",
    S.with_(BASE, EARN_SQL) + " SELECT symbol, report_ts, event_id, CAST(side AS BIGINT) AS side FROM sided",
)
def surprise(spark, sf):
    s = E.surprise_side(A.panel(spark, sf), earnings(spark, sf), A.calendar(spark, sf))
    return s.select("symbol", "report_ts", "event_id", F.col("side").cast("long").alias("side"))
