"""Validation and calendar queries (VAL-*, CAL-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.scalar import as_ts, day
from ...functions.scalar import rnd as R
from ...functions.window import ffill, ordered
from ...operators import sessions as cal
from ...operators.checks import truncated
from ...sources import files, landed, reference
from .. import adapters as A
from . import sqlbase as S
from .registry import query

BARS, PANEL = S.with_(S.BARS), S.with_(S.PANEL)
EV = S.with_(S.NATIONS + S.EVENTS)
r = S.rnd


# --- validation ------------------------------------------------------------


@query(
    "VAL-01",
    S.with_(S.NATIONS)
    + f"""
SELECT symbol, ts, {r("c.p")} AS close, {r("c.q", 2)} AS volume FROM (
  SELECT symbol, CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS ts,
    max(struct_pack(o := l_orderkey, n := l_linenumber, x := l_extendedprice / l_quantity,
      p := CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice / l_quantity END, q := l_quantity)) AS c
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nations ON s_nationkey = n_nationkey
  GROUP BY ALL)""",
)
def bar_validation(spark, sf):
    t = A.trades(spark, sf)
    names = A.nations(spark, sf).select(F.col("n_nationkey").alias("nationkey"), "symbol")
    bad_line = F.col("seq.l_linenumber") == 7
    raw = t.join(F.broadcast(names), "nationkey").select(
        "symbol",
        F.col("day").alias("ts"),
        *[F.when(bad_line, "n/a").otherwise(F.col("price").cast("string")).alias(c) for c in ("open", "high", "low", "close")],
        F.col("qty").cast("string").alias("volume"),
        F.lit(None).cast("string").alias("value"),
        F.lit(None).cast("string").alias("oi"),
        "seq",
    )
    return files.validate_bars(raw, seq="seq").select(
        "symbol", "ts", R("close").alias("close"), R("volume", 2).alias("volume")
    )


def raw_events(spark, sf):
    """Orders as untyped event rows, some of them malformed."""
    ev = A.orders_by_symbol(spark, sf)
    k = F.col("event_id")
    return ev.select(
        "symbol",
        F.when(k % 97 == 0, "soon").otherwise(day("event_date").cast("string")).alias("event_date"),
        F.when(F.col("status") == "P", "buyback").otherwise("insider").alias("kind"),
        F.when(k % 89 == 0, "?").otherwise((F.col("magnitude") / 1e5).cast("string")).alias("pct_of_shares"),
        F.when(k % 83 == 0, "x").otherwise((k % 5).cast("string")).alias("n_insiders"),
        F.lit("z").alias("comment"),
    )


@query(
    "VAL-02",
    EV
    + """
SELECT 'event_date' AS column, count(*) FILTER (WHERE event_id % 97 = 0) AS n_bad FROM cev
UNION ALL SELECT 'pct_of_shares', count(*) FILTER (WHERE event_id % 89 = 0) FROM cev
UNION ALL SELECT 'n_insiders', count(*) FILTER (WHERE event_id % 83 = 0) FROM cev
UNION ALL SELECT 'symbol', 0 UNION ALL SELECT 'kind', 0""",
)
def event_validation(spark, sf):
    return files.event_problems(raw_events(spark, sf), "insider_buyback_events")


@query(
    "VAL-03",
    EV
    + f"""
SELECT symbol, count(*) AS n, max(event_date) AS last_event, {r("sum(magnitude)", 2)} AS total
FROM cev WHERE event_date <= TIMESTAMP '1998-12-31' GROUP BY symbol""",
)
def event_cut(spark, sf):
    ev = truncated(A.orders_by_symbol(spark, sf), F.lit("1998-12-31").cast("date"))
    return ev.groupBy("symbol").agg(
        F.count("*").alias("n"),
        F.max("event_date").alias("last_event"),
        R(F.sum("magnitude"), 2).alias("total"),
    )


@query(
    "VAL-05",
    S.with_(S.PANEL + S.EVENTS)
    + """
SELECT 'panel' AS name, count(*) AS n, max(ts) AS last_ts FROM panel WHERE ts <= TIMESTAMP '1999-06-30'
UNION ALL SELECT 'bars', count(*), max(ts) FROM bars WHERE ts <= TIMESTAMP '1999-06-30'
UNION ALL SELECT 'events', count(*), max(event_date) FROM cev WHERE event_date <= TIMESTAMP '1999-06-30'""",
)
def context_slice(spark, sf):
    end = F.lit("1999-06-30").cast("date")
    parts = {
        "panel": A.panel(spark, sf).select("symbol", "ts"),
        "bars": A.bars(spark, sf).select("symbol", "ts"),
        "events": A.orders_by_symbol(spark, sf).select("symbol", "event_date"),
    }
    out = None
    for name, df in parts.items():
        cut = truncated(df, end)
        row = cut.agg(F.count("*").alias("n"), F.max(cut.columns[1]).alias("last_ts")).select(
            F.lit(name).alias("name"), "n", "last_ts"
        )
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "VAL-06",
    BARS
    + f"""
SELECT CASE symbol WHEN 'NATION_3' THEN 'NATION_4' ELSE symbol END AS symbol, symbol = 'NATION_7' AS terminated,
  count(*) AS n, {r("sum(value)", 2)} AS value FROM bars GROUP BY 1, 2""",
)
def alias_resolution(spark, sf):
    aliases = reference.alias_table(
        spark, {"NATION_3": "NATION_4", "NATION_7": None, "NATION_9": "NATION_9"}
    )
    return (
        reference.canonicalise(A.bars(spark, sf), aliases)
        .groupBy("symbol", "terminated")
        .agg(F.count("*").alias("n"), R(F.sum("value"), 2).alias("value"))
    )


@query(
    "VAL-07",
    """
WITH ids AS (SELECT CASE p_size % 3 WHEN 0 THEN 'RTSI'
    WHEN 1 THEN 'RI' || substr('FGHJKMNQUVXZ', p_size % 12 + 1, 1) || (p_size % 10)
    ELSE 'EQ' || p_size END AS id FROM part)
SELECT id, CASE WHEN id = 'RTSI' THEN 'index' WHEN regexp_matches(id, '^[A-Z]{2}[FGHJKMNQUVXZ][0-9]$')
  THEN 'future' ELSE 'equity' END AS kind, count(*) AS n FROM ids GROUP BY ALL""",
)
def id_classes(spark, sf):
    size = F.col("p_size")
    ident = (
        F.when(size % 3 == 0, "RTSI")
        .when(
            size % 3 == 1,
            F.concat(F.lit("RI"), F.substr(F.lit("FGHJKMNQUVXZ"), size % 12 + 1, F.lit(1)), (size % 10).cast("string")),
        )
        .otherwise(F.concat(F.lit("EQ"), size.cast("string")))
    )
    ids = A.table(spark, sf, "part").select(ident.alias("id"))
    return ids.groupBy("id", landed.classify("id").alias("kind")).agg(F.count("*").alias("n"))


@query(
    "VAL-08",
    BARS + """ SELECT symbol AS bare, 'X:' || symbol AS full_id, symbol AS back, count(*) AS n FROM bars GROUP BY symbol""",
)
def prefixes(spark, sf):
    b = A.bars(spark, sf).withColumn("full_id", landed.add_prefix("symbol", "X"))
    return b.groupBy(
        landed.strip_prefix("symbol").alias("bare"), "full_id", landed.strip_prefix("full_id").alias("back")
    ).agg(F.count("*").alias("n"))


@query(
    "VAL-09",
    PANEL + f" SELECT symbol, ts, {r('CASE WHEN in_universe THEN coalesce(ret, 0) ELSE 0 END', 8)} AS w FROM panel",
)
def masked_weights(spark, sf):
    w = F.when(F.col("in_universe"), F.coalesce("ret", F.lit(0.0))).otherwise(0.0)
    return A.panel(spark, sf).select("symbol", "ts", R(w, 8).alias("w"))


@query(
    "VAL-10",
    EV
    + """
SELECT symbol, count(*) FILTER (WHERE status = 'O') AS deletions,
  count(*) FILTER (WHERE status IN ('O', 'F')) AS index_changes,
  count(*) FILTER (WHERE status <> 'P' OR magnitude / 1e5 >= 2) AS kept_buybacks
FROM cev GROUP BY symbol""",
)
def event_predicates(spark, sf):
    action = F.when(F.col("status") == "O", "delete").when(F.col("status") == "F", "add").otherwise("buyback")
    ev = A.orders_by_symbol(spark, sf).withColumns({"action": action, "pct": F.col("magnitude") / 1e5})

    def n(cond):
        return F.count(F.when(cond, 1))

    return ev.groupBy("symbol").agg(
        n(F.col("action") == "delete").alias("deletions"),
        n(F.col("action").isin("delete", "add")).alias("index_changes"),
        n((F.col("action") != "buyback") | (F.col("pct") >= 2)).alias("kept_buybacks"),
    )


# --- calendar --------------------------------------------------------------

HOLIDAYS_SQL = ", ".join(str(m * 100 + d) for m, d in cal.FIXED_HOLIDAYS)


def trading_sql(d: str, market: str) -> str:
    a, z = cal.HALTS[market]

    def h(x):
        return f"month({x}) * 100 + day({x}) IN ({HOLIDAYS_SQL})"

    return f"""(isodow({d}) <= 5 AND NOT ({h(d)})
      AND NOT (isodow({d}) = 1 AND ({h(d + " - 1")} OR {h(d + " - 2")}))
      AND NOT ({d} BETWEEN DATE '{a}' AND DATE '{z}'))"""


@query(
    "CAL-01",
    f"""
WITH days AS (SELECT CAST(unnest(generate_series((SELECT CAST(min(l_shipdate) AS DATE) FROM lineitem),
    DATE '2022-12-31', INTERVAL 1 DAY)) AS DATE) AS d)
SELECT 'stock' AS market, CAST(d AS TIMESTAMP) AS ts FROM days WHERE {trading_sql("d", "stock")}
UNION ALL SELECT 'forts', CAST(d AS TIMESTAMP) FROM days WHERE {trading_sql("d", "forts")}""",
)
def trading_calendar(spark, sf):
    bounds = A.table(spark, sf, "lineitem").agg(F.min("l_shipdate").alias("start")).withColumn(
        "end", F.lit("2022-12-31")
    )
    out = None
    for market in ("stock", "forts"):
        days = cal.trading_days(bounds, market).select(F.lit(market).alias("market"), "ts")
        out = days if out is None else out.unionByName(days)
    return out


@query(
    "CAL-02",
    BARS
    + f"""
SELECT {trading_sql("CAST(ts AS DATE)", "stock")} AS trading, count(*) AS n_bars, count(DISTINCT ts) AS n_days
FROM bars GROUP BY 1""",
)
def trading_day_flags(spark, sf):
    return (
        A.bars(spark, sf)
        .groupBy(cal.is_trading_day("ts").alias("trading"), "ts")
        .agg(F.count("*").alias("n"))
        .groupBy("trading")
        .agg(F.sum("n").alias("n_bars"), F.count("*").alias("n_days"))
    )


@query(
    "CAL-03",
    S.with_(S.BARS, S.rebalance("rw", "W"), S.rebalance("rm", "ME"), S.rebalance("rq", "QE"))
    + """ SELECT 'D' AS freq, ts FROM cal UNION ALL SELECT 'W', ts FROM rw
UNION ALL SELECT 'ME', ts FROM rm UNION ALL SELECT 'QE', ts FROM rq""",
)
def rebalance_calendar(spark, sf):
    c = A.calendar(spark, sf)
    out = None
    for f in ("D", "W", "ME", "QE"):
        d = cal.rebalance_dates(c, f).select(F.lit(f).alias("freq"), "ts")
        out = d if out is None else out.unionByName(d)
    return out


@query(
    "CAL-04",
    PANEL + f" SELECT symbol, ts, pos, {r('close')} AS close, {r('volume', 2)} AS volume FROM dense",
)
def dense_grid(spark, sf):
    return A.dense_bars(spark, sf).select(
        "symbol", "ts", F.col("pos").cast("long").alias("pos"), R("close").alias("close"), R("volume", 2).alias("volume")
    )


@query(
    "CAL-05",
    BARS
    + f"""
SELECT c.ts, s.sector, {r("avg(b.close)", 4)} AS close FROM cal c CROSS JOIN (SELECT DISTINCT sector FROM syms) s
LEFT JOIN bars b ON b.ts = c.ts AND b.sector = s.sector GROUP BY ALL""",
)
def pivot_and_back(spark, sf):
    b = A.bars(spark, sf).join(F.broadcast(A.symbols(spark, sf)), "symbol")
    # Sectors are the region names: five, whatever the data size.
    sectors = sorted(x[0] for x in A.symbols(spark, sf).select("sector").distinct().collect())
    wide = b.groupBy("ts").pivot("sector", sectors).agg(F.avg("close"))
    return wide.unpivot(["ts"], sectors, "sector", "close").withColumn("close", R("close", 4))


@query(
    "CAL-06",
    PANEL
    + f"""
SELECT symbol, ts, {r(S.ffill("close", 3))} AS fill3, {r(S.ffill("close"))} AS fill_all FROM dense""",
)
def forward_fills(spark, sf):
    return A.dense_bars(spark, sf).select(
        "symbol", "ts", R(ffill("close", 3)).alias("fill3"), R(ffill("close")).alias("fill_all")
    )


@query(
    "CAL-07",
    BARS + """ SELECT symbol, '1d' AS freq, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS rows FROM bars GROUP BY symbol""",
)
def bar_coverage(spark, sf):
    return cal.coverage(A.bars(spark, sf).withColumn("freq", F.lit(A.FREQ)))


@query(
    "CAL-08",
    PANEL
    + """
SELECT symbol, min(ts) AS start, max(ts) AS "end", count(*) AS n_days FROM (
  SELECT symbol, ts, pos - row_number() OVER (PARTITION BY symbol ORDER BY pos) AS g FROM dense WHERE volume IS NULL)
GROUP BY symbol, g""",
)
def missing_bars(spark, sf):
    grid = cal.grid_of(A.days(spark, sf), A.symbols(spark, sf).select("symbol"))
    return cal.missing_ranges(grid, A.bars(spark, sf))


@query(
    "CAL-09",
    BARS
    + """
, cov AS (SELECT symbol, min(ts) AS a, max(ts) AS z FROM bars GROUP BY symbol)
SELECT symbol, c AS chunk_start, least(c + INTERVAL 100 DAY, z) AS chunk_end
FROM (SELECT symbol, z, unnest(generate_series(a, z, INTERVAL 101 DAY)) AS c FROM cov)""",
)
def range_chunks(spark, sf):
    cov = A.bars(spark, sf).groupBy("symbol").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    return cal.chunk_ranges(cov, 100).select(
        "symbol", as_ts("chunk_start").alias("chunk_start"), as_ts("chunk_end").alias("chunk_end")
    )


@query(
    "CAL-10",
    S.with_(S.TICKS)
    + f"""
SELECT symbol, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day, {r("arg_max(price, (ts, event_id))")} AS last_price,
  {r("avg(price)")} AS mean_price FROM ticks GROUP BY 1, 2""",
)
def tick_resample(spark, sf):
    t = A.ticks(spark, sf)
    last = cal.resample_daily(t, "price", "last", F.struct("ts", "event_id"))
    mean = cal.resample_daily(t, "price", "mean").withColumnRenamed("price", "mean_price")
    return last.join(mean, ["symbol", "day"]).select(
        "symbol", "day", R("price").alias("last_price"), R("mean_price").alias("mean_price")
    )


@query(
    "CAL-11",
    PANEL
    + f"""
, m AS (SELECT symbol, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month, arg_max(tr, ts) AS px FROM panel GROUP BY 1, 2)
SELECT symbol, month, {r("px / nullif(lag(px) OVER (PARTITION BY symbol ORDER BY month), 0) - 1")} AS ret FROM m""",
)
def monthly_returns(spark, sf):
    m = A.panel(spark, sf).groupBy("symbol", F.trunc(day("ts"), "month").alias("m")).agg(
        F.max_by("tr", F.when(F.col("tr").isNotNull(), F.col("ts"))).alias("px")
    )
    prev = F.lag("px").over(ordered(order="m"))
    return m.select("symbol", as_ts("m").alias("month"), R(F.try_divide("px", prev) - 1).alias("ret"))


@query(
    "CAL-12",
    S.with_(S.BARS, S.rebalance())
    + """ SELECT DISTINCT c.ts FROM cal c JOIN cal e ON c.pos BETWEEN e.pos - 1 + 1 AND e.pos + 3
WHERE e.ts IN (SELECT ts FROM rebal)""",
)
def turn_of_month_days(spark, sf):
    return cal.turn_of_month(A.calendar(spark, sf), 1, 3).select("ts")


@query(
    "CAL-13",
    PANEL
    + f"""
, n AS (SELECT count(*) AS n FROM cal),
pick AS (SELECT DISTINCT (i * (n - 1)) // 1499 AS k FROM n, unnest(generate_series(0, 1499)) AS t(i))
SELECT symbol, ts, {r("close")} AS close FROM panel WHERE pos IN (SELECT k FROM pick)""",
)
def even_downsample(spark, sf):
    out = cal.downsample(A.panel(spark, sf).select("symbol", "ts", "close"), ["symbol"], 1500)
    return out.withColumn("close", R("close"))
