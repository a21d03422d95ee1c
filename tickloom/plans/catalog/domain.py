"""Adjustment, universe, panel and carry queries (ADJ-*, UNI-*, PAN-*, CAR-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.scalar import as_ts, day
from ...functions.scalar import rnd as R
from ...functions.window import pct_change
from ...operators import adjust, carry, futures, universe
from ...operators.costs import trailing_adv
from .. import adapters as A
from . import sqlbase as S
from .registry import query

PANEL = S.with_(S.PANEL)
r = S.rnd

ADJ_SQL = """
adjp AS (
  SELECT p.symbol, p.ts, p.pos, p.close,
    coalesce((SELECT product(1 / s.value) FROM splits s WHERE s.symbol = p.symbol AND s.ex_date > CAST(p.ts AS DATE)), 1) AS f
  FROM panel p)"""


@query(
    "ADJ-01",
    S.with_(S.PANEL + S.EVENTS, S.SPLITS, ADJ_SQL) + f" SELECT symbol, ts, {r('close * f')} AS adj_close FROM adjp",
)
def split_adjusted(spark, sf):
    p = A.panel(spark, sf).select("symbol", "ts", "pos", "close")
    return adjust.split_adjust(p, A.splits(spark, sf)).select("symbol", "ts", R("adj_close").alias("adj_close"))


TR_SQL = f"""
dv AS (SELECT symbol, (SELECT min(pos) FROM cal WHERE cal.ts >= d.ex_date) AS pos, sum(value) AS div
  FROM divs d GROUP BY 1, 2),
tr0 AS (SELECT a.symbol, a.ts, a.pos, a.close * a.f AS adj, coalesce(div, 0) AS div FROM adjp a LEFT JOIN dv USING (symbol, pos)),
tr1 AS (SELECT *, lag(adj) OVER (PARTITION BY symbol ORDER BY ts) AS prev FROM tr0),
tr2 AS (SELECT *, CASE WHEN (adj + div) / nullif(prev, 0) > 0 THEN ln((adj + div) / prev) ELSE 0 END AS lf FROM tr1),
trx AS (SELECT symbol, ts, pos, adj, div, first_value(adj IGNORE NULLS) {S.over()} * exp(sum(coalesce(lf, 0)) {S.over()}) AS tr FROM tr2)"""


@query(
    "ADJ-02",
    S.with_(S.PANEL + S.EVENTS, S.SPLITS, S.DIVS, ADJ_SQL, TR_SQL) + f" SELECT symbol, ts, {r('tr', 5)} AS tr FROM trx",
)
def total_return_index(spark, sf):
    return total_return_panel(spark, sf).select("symbol", "ts", R("tr", 5).alias("tr"))


def total_return_panel(spark, sf):
    p = A.panel(spark, sf).drop("tr", "ret")
    adj = adjust.split_adjust(p, A.splits(spark, sf))
    return adjust.total_return(adj, A.dividends(spark, sf), A.calendar(spark, sf))


# Contracts: each sector's symbols form a chain, expiring every 100 days.
CHAIN_SQL = """
k AS (SELECT symbol, sector, row_number() OVER (PARTITION BY sector ORDER BY symbol) - 1 AS k FROM syms),
chain AS (SELECT symbol, sector AS asset_code, k,
  CAST((SELECT min(ts) FROM cal) AS DATE) + CAST(300 * (k + 1) AS INTEGER) AS expiry FROM k)"""


def contracts(spark, sf):
    """Each sector's symbols as a futures chain expiring every 300 days."""
    from pyspark.sql import Window

    start = A.days(spark, sf).select(F.element_at("days", 1)).scalar()
    k = F.row_number().over(Window.partitionBy("sector").orderBy("symbol"))
    return A.symbols(spark, sf).select(
        "symbol", F.col("sector").alias("asset_code"), F.date_add(day(start), 300 * k).alias("expiry")
    )


def futures_bars(spark, sf):
    """Panel bars with open interest (the day's volume)."""
    return A.panel(spark, sf).select(
        "symbol", "ts", "pos", "close", F.col("volume").alias("oi"), "volume"
    )


HELD_SQL = """
held AS (
  SELECT sector AS asset_code, 0 AS pos, 0 AS k FROM (SELECT DISTINCT sector FROM syms)
  UNION ALL
  SELECT h.asset_code, h.pos + 1,
    h.k + CASE WHEN h.k < (SELECT max(k) FROM chain c WHERE c.asset_code = h.asset_code)
      AND (SELECT CAST(ts AS DATE) FROM cal WHERE cal.pos = h.pos + 1)
        >= (SELECT expiry FROM chain c WHERE c.asset_code = h.asset_code AND c.k = h.k) - 3 THEN 1 ELSE 0 END
  FROM held h WHERE h.pos < (SELECT max(pos) FROM cal))"""
# The first bar can roll too, but no chain here expires within its first days.


@query(
    "ADJ-03",
    S.with_(S.PANEL, CHAIN_SQL, HELD_SQL)
    + " SELECT h.asset_code, ts, symbol AS held FROM held h JOIN chain c ON c.asset_code = h.asset_code AND c.k = h.k JOIN cal ON cal.pos = h.pos",
)
def roll_by_expiry(spark, sf):
    c = A.calendar(spark, sf)
    held = futures.held_by_expiry(A.days(spark, sf), contracts(spark, sf))
    return held.join(F.broadcast(c), "pos").select("asset_code", "ts", "held")


def activity_sql(measure):
    """Walk over bars: the held contract's number and the count of consecutive leads of the next one."""
    return f"""
lead AS MATERIALIZED (
  SELECT c.asset_code, c.k, p.pos, CAST(p.ts AS DATE) >= c.expiry - 3 AS due,
    coalesce(q.{measure} > p.{measure}, FALSE) AS ahead, n.k IS NOT NULL AS more
  FROM chain c JOIN panel p ON p.symbol = c.symbol
  LEFT JOIN chain n ON n.asset_code = c.asset_code AND n.k = c.k + 1
  LEFT JOIN panel q ON q.symbol = n.symbol AND q.pos = p.pos),
walk AS (
  SELECT DISTINCT asset_code, CAST(-1 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS k, 0 AS run FROM chain
  UNION ALL
  SELECT asset_code, pos, k + CAST(goes AS BIGINT), CASE WHEN goes THEN 0 ELSE run END
  FROM (SELECT w.asset_code, w.pos + 1 AS pos, w.k, CASE WHEN l.more AND l.ahead THEN w.run + 1 ELSE 0 END AS run,
      l.more AND (l.due OR (l.ahead AND w.run >= 1)) AS goes
    FROM walk w JOIN lead l ON l.asset_code = w.asset_code AND l.k = w.k AND l.pos = w.pos + 1))"""


def activity_query(measure):
    return S.with_(S.PANEL, CHAIN_SQL, activity_sql(measure)) + (
        " SELECT w.asset_code, symbol AS held, pos FROM walk w JOIN chain c ON c.asset_code = w.asset_code AND c.k = w.k WHERE pos >= 0"
    )


@query("ADJ-03b", activity_query("volume"))
def roll_by_open_interest(spark, sf):
    bars = futures_bars(spark, sf)
    return futures.held_by_activity(bars, contracts(spark, sf), "oi")


@query("ADJ-03c", activity_query("value"))
def roll_by_traded_value(spark, sf):
    bars = A.panel(spark, sf).select("symbol", "ts", "pos", "value")
    return futures.held_by_activity(bars, contracts(spark, sf), "value")


@query(
    "ADJ-04",
    S.with_(S.PANEL, CHAIN_SQL, HELD_SQL)
    + f"""
, s AS (SELECT h.asset_code, h.pos, c.symbol AS held FROM held h JOIN chain c ON c.asset_code = h.asset_code AND c.k = h.k),
o AS (SELECT symbol AS held, pos, ts, close, lag(close) OVER (PARTITION BY symbol ORDER BY pos) AS own FROM panel),
j AS (SELECT asset_code, pos, ts, held, close, own, lag(held) OVER w AS ph, lag(close) OVER w AS pp
  FROM s JOIN o USING (held, pos) WINDOW w AS (PARTITION BY asset_code ORDER BY pos))
SELECT asset_code, ts, coalesce(held <> ph, FALSE) AS is_roll, {r("close")} AS price,
  {r("CASE WHEN ph IS NOT NULL THEN close / nullif(own, 0) - 1 END", 8)} AS ret_adjusted,
  {r("CASE WHEN ph IS NOT NULL THEN close / nullif(CASE WHEN held <> ph THEN pp ELSE own END, 0) - 1 END", 8)} AS ret_naive FROM j""",
)
def stitched(spark, sf):
    held = futures.held_by_expiry(A.days(spark, sf), contracts(spark, sf))
    bars = futures_bars(spark, sf)
    both = futures.stitch(held, bars, "ratio").withColumnRenamed("ret", "ret_adjusted")
    naive = futures.stitch(held, bars, "none").select("asset_code", "ts", F.col("ret").alias("ret_naive"))
    return both.join(naive, ["asset_code", "ts"]).select(
        "asset_code",
        "ts",
        F.coalesce("is_roll", F.lit(False)).alias("is_roll"),
        R("price").alias("price"),
        R("ret_adjusted", 8).alias("ret_adjusted"),
        R("ret_naive", 8).alias("ret_naive"),
    )


@query(
    "ADJ-05",
    PANEL
    + f"""
, gone AS (SELECT symbol, TIMESTAMP '2000-03-15' AS listed_to FROM syms WHERE symbol LIKE '%5'),
last AS (SELECT p.symbol, max(p.ts) AS ts FROM panel p JOIN gone g USING (symbol) WHERE p.ts <= listed_to GROUP BY p.symbol)
SELECT p.symbol, p.ts, {r("CASE WHEN l.ts IS NOT NULL THEN -0.3 ELSE ret END", 8)} AS ret
FROM panel p LEFT JOIN last l ON l.symbol = p.symbol AND l.ts = p.ts""",
)
def delisting(spark, sf):
    p = A.panel(spark, sf).select("symbol", "ts", "ret")
    return adjust.delisting_returns(p, listings(spark, sf)).select("symbol", "ts", R("ret", 8).alias("ret"))


@query(
    "ADJ-06",
    PANEL
    + f" SELECT symbol, ts, {r(S.pct('tr'), 8)} AS ret, {r('ln(' + S.roll('avg', 'value', 20, 6, 1) + ')', 8)} AS log_adv FROM panel",
)
def returns_and_adv(spark, sf):
    return A.panel(spark, sf).select(
        "symbol", "ts", R(pct_change("tr"), 8).alias("ret"), R(F.ln(trailing_adv()), 8).alias("log_adv")
    )


@query("UNI-01", PANEL + " SELECT symbol, ts, symbol LIKE '%_1%' AS in_universe FROM panel")
def static_universe(spark, sf):
    listed = A.symbols(spark, sf).filter(F.col("symbol").like("%_1%"))
    return universe.static_mask(A.panel(spark, sf).select("symbol", "ts", "in_universe"), listed)


@query(
    "UNI-02",
    S.with_(S.BARS, S.MEMBERS)
    + """, q(d) AS (VALUES (TIMESTAMP '1995-01-15'), (TIMESTAMP '1998-05-20'), (TIMESTAMP '2001-06-30'))
SELECT d AS ts, symbol FROM q JOIN membership m ON m.date = (SELECT max(date) FROM membership x WHERE x.date <= d)""",
)
def members_on(spark, sf):
    m = A.membership(spark, sf)
    out = None
    for d in ("1995-01-15", "1998-05-20", "2001-06-30"):
        part = universe.members_asof(m, d).select(as_ts(F.lit(d).cast("date")).alias("ts"), "symbol")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "UNI-03",
    PANEL + f" SELECT symbol, ts, in_universe AND symbol <> 'NATION_0' AS in_universe, {r('close')} AS close FROM panel",
)
def benchmark_excluded(spark, sf):
    p = universe.exclude(A.panel(spark, sf), "NATION_0")
    return p.select("symbol", "ts", "in_universe", R("close").alias("close"))


@query(
    "PAN-01",
    S.with_(S.PANEL + S.EVENTS, S.SPLITS, S.DIVS, ADJ_SQL, TR_SQL, S.MEMBERS)
    + f"""
, snap AS (SELECT c.ts, (SELECT max(date) FROM membership m WHERE m.date <= c.ts) AS d FROM cal c),
bench AS (SELECT ts, close / first_value(close IGNORE NULLS) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS bench FROM panel WHERE symbol = 'NATION_0'),
gone AS (SELECT symbol, max(ts) AS ts FROM trx WHERE symbol LIKE '%5' AND ts <= TIMESTAMP '2000-03-15' GROUP BY symbol)
SELECT t.symbol, t.ts, t.pos, {r("t.adj")} AS close, {r("t.tr", 5)} AS tr,
  {r("CASE WHEN (t.symbol, t.ts) IN (SELECT (symbol, ts) FROM gone) THEN -0.3 ELSE t.tr / nullif(lag(t.tr) OVER (PARTITION BY t.symbol ORDER BY t.ts), 0) - 1 END")} AS ret,
  m.symbol IS NOT NULL AND t.symbol <> 'NATION_0' AS in_universe, {r("bench")} AS bench
FROM trx t JOIN snap s USING (ts) LEFT JOIN (SELECT DISTINCT symbol, date FROM membership) m ON m.symbol = t.symbol AND m.date = s.d
JOIN bench b USING (ts)""",
)
def assembled_panel(spark, sf):
    return full_panel(spark, sf).select(
        "symbol", "ts", "pos", R("adj_close").alias("close"), R("tr", 5).alias("tr"), R("ret").alias("ret"),
        "in_universe", R("bench").alias("bench"),
    )


def listings(spark, sf):
    """Instrument dimension: where a symbol's listing has ended, its last day."""
    return A.symbols(spark, sf).select("symbol", F.when(F.col("symbol").like("%5"), F.lit("2000-03-15")).alias("listed_to"))


def full_panel(spark, sf, benchmark: str = "NATION_0"):
    """Grid, adjusted prices, total return, delisting return, point-in-time universe, benchmark."""
    from ...operators.accounting import benchmark_equity

    c = A.calendar(spark, sf)
    p = total_return_panel(spark, sf)
    p = p.withColumn("ret", pct_change("tr"))
    p = adjust.delisting_returns(p, listings(spark, sf)).drop("delist_ret")
    p = universe.point_in_time_mask(p, c, A.membership(spark, sf))
    p = universe.exclude(p, benchmark)
    own = A.panel(spark, sf).filter(F.col("symbol") == benchmark).select("ts", "close")
    bench = benchmark_equity(c, own).select("ts", "bench")
    # One row per calendar bar.
    return p.join(F.broadcast(bench), "ts")


# --- carry -----------------------------------------------------------------

BASIS = S.with_(S.PANEL, S.BASIS)


@query("CAR-01", BASIS + f" SELECT symbol, ts, {r('basis', 8)} AS basis FROM basis")
def annual_basis(spark, sf):
    return A.basis(spark, sf).select("symbol", "ts", R("basis", 8).alias("basis"))


@query(
    "CAR-02",
    BASIS
    + f" SELECT symbol, ts, {r('(basis - (' + S.roll('avg', 'basis', 252, 63, 1) + ')) / nullif(' + S.roll('stddev_samp', 'basis', 252, 63, 1) + ', 0)', 5)} AS z FROM basis",
)
def basis_zscore(spark, sf):
    return carry.slope_zscore(A.basis(spark, sf)).select("symbol", "ts", R("z", 5).alias("z"))


@query(
    "CAR-03",
    BASIS + f" SELECT symbol, ts, {r('sign(basis - 0.02) * least(1, abs(basis - 0.02) / 0.10)')} AS s FROM basis",
)
def carry_signal(spark, sf):
    return A.basis(spark, sf).select("symbol", "ts", R(carry.carry_ts("basis", 0.02)).alias("s"))


DESEASON = (
    "basis - avg(basis) OVER (PARTITION BY symbol, month(ts) ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"
)


@query("CAR-04", BASIS + f" SELECT symbol, ts, {r(DESEASON, 8)} AS x FROM basis")
def deseasonalised(spark, sf):
    return A.basis(spark, sf).select("symbol", "ts", R(carry.deseasonalized("basis"), 8).alias("x"))


@query(
    "CAR-05",
    S.with_(S.BARS, S.CURVE)
    + f"""
, k AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY expiry) AS rn FROM curve WHERE expiry > CAST(ts AS DATE)),
f AS (SELECT ts, max(settle) FILTER (WHERE rn = 1) AS a, max(settle) FILTER (WHERE rn = 2) AS b,
  max(expiry) FILTER (WHERE rn = 1) AS e1, max(expiry) FILTER (WHERE rn = 2) AS e2 FROM k WHERE rn <= 2 GROUP BY ts HAVING count(*) = 2)
SELECT ts, {r("a")} AS vx1, {r("b")} AS vx2, CAST(e1 - CAST(ts AS DATE) AS BIGINT) AS days1, CAST(e2 - CAST(ts AS DATE) AS BIGINT) AS days2,
  {r("b / nullif(a, 0) - 1")} AS slope12 FROM f""",
)
def front_curve(spark, sf):
    f = carry.front_pair(A.vol_curve(spark, sf))
    return f.select(
        as_ts("date").alias("ts"), R("vx1").alias("vx1"), R("vx2").alias("vx2"),
        F.col("days1").cast("long").alias("days1"), F.col("days2").cast("long").alias("days2"), R("slope12").alias("slope12"),
    )
