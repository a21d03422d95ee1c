"""Source, sink and streaming queries (SRC-*, STR-*).

Landed payloads are built from the driver tables in the wire formats, then
parsed back; files and stores go to a fresh folder under the shared one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.scalar import as_ts, day
from ...functions.scalar import rnd as R
from ...operators import accounting, costs
from ...session import scratch
from ...sources import files, landed, store
from ...streaming import jobs
from .. import adapters as A
from . import sqlbase as S
from .common import sample_book
from .registry import query

r = S.rnd
BARS = S.with_(S.BARS)
OHLC = ("open", "high", "low", "close")


def bars_out(df, cols=OHLC, dp=4):
    return df.select("symbol", "ts", *[R(c, dp).alias(c) for c in cols])


def price_sql(cols=OHLC, dp=4):
    return ", ".join(f"{r(c, dp)} AS {c}" for c in cols)


@query("SRC-01", BARS + f" SELECT symbol, ts, {price_sql()}, {r('volume', 2)} AS volume FROM bars")
def bar_files(spark, sf):
    path = scratch(spark, "bars-csv")
    b = A.bars(spark, sf)
    names = {"symbol": "Ticker", "ts": "Date", "open": "O", "high": "H", "low": "L", "close": "C", "volume": "Vol"}
    b.select(*[F.col(k).alias(v) for k, v in names.items()]).write.option("header", True).csv(path)
    return files.load_bars(spark, path, fmt="csv").select(
        "symbol", "ts", *[R(c, 4).alias(c) for c in OHLC], R("volume", 2).alias("volume")
    )


EV = S.with_(S.NATIONS + S.EVENTS)


@query(
    "SRC-02",
    EV
    + f""" SELECT symbol, CASE status WHEN 'P' THEN 'buyback' ELSE 'insider' END AS kind, count(*) AS n, max(event_date) AS last,
{r("sum(CAST(round(magnitude * 100) AS BIGINT)) / 100.0::DOUBLE", 2)} AS value FROM cev GROUP BY 1, 2""",
)
def event_files(spark, sf):
    folder = scratch(spark, "events")
    ev = A.corp_events(spark, sf).select(
        "symbol", day("event_date").alias("event_date"),
        F.when(F.col("status") == "P", "buyback").otherwise("insider").alias("kind"), F.col("magnitude").alias("value_rub"),
        F.lit("x").alias("comment"),
    )
    ev.write.option("header", True).csv(f"{folder}/insider_buyback_events.csv")
    loaded = files.load_all_events(spark, folder, ["insider_buyback_events", "ipo_lockups"])
    cents = F.sum(F.round(F.col("value_rub") * 100).cast("long"))
    return loaded["insider_buyback_events"].groupBy("symbol", "kind").agg(
        F.count("*").alias("n"), as_ts(F.max("event_date")).alias("last"), R(cents / 100, 2).alias("value")
    )


def month_pages(df, block, columns, *keys):
    """Pages of one symbol and month, so that a page stays small."""
    df = df.withColumn("page", F.date_format("ts", "yyyy-MM"))
    return landed.as_blocks(df, block, columns, ["symbol", "page", *keys])


def history_pages(spark, sf):
    b = A.bars(spark, sf)
    even = F.col("volume") % 2 == 0
    return month_pages(
        b, "history",
        {
            "TRADEDATE": day("ts"), "SECID": F.col("symbol"), "OPEN": F.col("open"), "HIGH": F.col("high"), "LOW": F.col("low"),
            "CLOSE": F.when(~even, F.col("close")), "SETTLEPRICE": F.col("close") + 1, "VOLUME": F.col("volume"),
            "VALUE": F.col("value"), "OPENPOSITION": F.col("volume") * 2, "CURRENCYID": F.when(even, F.lit("RUB")).otherwise(F.lit("SUR")),
        },
    )


EVEN = "CAST(volume AS BIGINT) % 2 = 0"


@query(
    "SRC-03",
    BARS
    + f"""
SELECT 'future' AS kind, symbol, ts, {r("open", 4)} AS open, {r(f"CASE WHEN {EVEN} THEN close + 1 ELSE close END", 4)} AS close, {r("volume * 2", 2)} AS oi FROM bars
UNION ALL SELECT 'equity', symbol, ts, {r("open", 4)}, {r(f"CASE WHEN {EVEN} THEN NULL ELSE close END", 4)}, NULL FROM bars
UNION ALL SELECT 'index', symbol, ts, {r("open", 4)}, {r(f"CASE WHEN {EVEN} THEN NULL ELSE close END", 4)}, NULL FROM bars""",
)
def exchange_history(spark, sf):
    pages = history_pages(spark, sf)
    out = None
    for kind in ("future", "equity", "index"):
        b = landed.daily_history(pages, kind).select(
            F.lit(kind).alias("kind"), "symbol", "ts", R("open", 4).alias("open"), R("close", 4).alias("close"), R("oi", 2).alias("oi")
        )
        out = b if out is None else out.unionByName(b)
    return out


def tick_bars_sql(unit: str) -> str:
    trunc = {"hour": "date_trunc('hour', ts)", "5m": "time_bucket(INTERVAL 5 MINUTE, ts)", "10m": "time_bucket(INTERVAL 10 MINUTE, ts)"}[unit]
    return f"""
tb AS (SELECT symbol, {trunc} AS ts, arg_min(price, (ts, event_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, event_id)) AS close,
  count(*)::DOUBLE AS volume, sum(CAST(round(price * 100) AS BIGINT)) / 100.0::DOUBLE AS value FROM ticks GROUP BY 1, 2)"""


def tick_bars(spark, sf, width: str):
    t = A.ticks(spark, sf)
    order = F.struct("ts", "event_id")
    return t.groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.count("*").cast("double").alias("volume"),
        (F.sum(F.round(F.col("price") * 100).cast("long")) / 100).alias("value"),
    ).select("symbol", F.col("w.start").cast("timestamp").alias("ts"), *OHLC, "volume", "value")


def local_time(fmt: str):
    return F.date_format(F.from_utc_timestamp("ts", landed.EXCHANGE_ZONE), fmt)


TB = S.with_(S.TICKS, tick_bars_sql("hour"))
TICK_OUT = f" SELECT symbol, ts, {price_sql()}, {r('value', 2)} AS value FROM tb"


def tick_out(df):
    return df.select("symbol", "ts", *[R(c, 4).alias(c) for c in OHLC], R("value", 2).alias("value"))


@query("SRC-04", TB + TICK_OUT)
def exchange_candles(spark, sf):
    cols = {c: F.col(c) for c in (*OHLC, "value", "volume")} | {"begin": local_time("yyyy-MM-dd HH:mm:ss")}
    return tick_out(landed.candles(month_pages(tick_bars(spark, sf, "1 hour"), "candles", cols)))


@query("SRC-05", S.with_(S.TICKS, tick_bars_sql("5m")) + TICK_OUT)
def exchange_trade_stats(spark, sf):
    src = tick_bars(spark, sf, "5 minutes")
    cols = {f"pr_{c}": F.col(c) for c in OHLC} | {"vol": F.col("volume"), "val": F.col("value")}
    cols |= {"tradedate": local_time("yyyy-MM-dd"), "tradetime": local_time("HH:mm:ss")}
    return tick_out(landed.trade_stats(month_pages(src, "data", cols)))


@query(
    "SRC-06",
    TB + f" SELECT symbol, ts, {r('(high - low) / nullif(high + low, 0) * 10000', 4)} AS spread_bps FROM tb",
)
def exchange_book_stats(spark, sf):
    src = tick_bars(spark, sf, "1 hour")
    bbo = F.try_divide(F.col("high") - F.col("low"), F.col("high") + F.col("low"))
    cols = {"tradedate": local_time("yyyy-MM-dd"), "tradetime": local_time("HH:mm:ss"), "spread_bbo": bbo, "levels_b": F.col("volume")}
    return landed.book_stats(month_pages(src, "data", cols)).select("symbol", "ts", R("spread_bps", 4).alias("spread_bps"))


@query("SRC-07", TB + f" SELECT symbol, ts, {price_sql()} FROM tb")
def broker_bars(spark, sf):
    src = tick_bars(spark, sf, "1 hour")
    bar = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), *[F.col(c).cast("string").alias(c) for c in (*OHLC, "volume")]
    )
    pages = src.groupBy("symbol", F.to_date("ts").alias("page")).agg(F.to_json(F.struct(F.collect_list(bar).alias("bars"))).alias("body"))
    return bars_out(landed.broker_bars(pages))


@query(
    "SRC-08",
    EV
    + f""" SELECT symbol, event_date AS ex_date, 'div' AS kind, count(*) AS n, {r("sum(CAST(round(magnitude * 100) AS BIGINT)) / 100.0::DOUBLE", 2)} AS value
FROM cev GROUP BY 1, 2""",
)
def exchange_dividends(spark, sf):
    # A page holds at most a thousand order keys, however many orders a symbol has.
    ev = A.corp_events(spark, sf).withColumn("page", F.floor(F.col("event_id") / 1000))
    cols = {"registryclosedate": day("event_date"), "value": F.col("magnitude")}
    pages = landed.as_blocks(ev, "dividends", cols, ["symbol", "page"])
    d = landed.dividends(pages)
    cents = F.sum(F.round(F.col("value") * 100).cast("long"))
    return d.groupBy("symbol", as_ts("ex_date").alias("ex_date"), "kind").agg(F.count("*").alias("n"), R(cents / 100, 2).alias("value"))


ROOT = "'RI' || substr('FGHJKMNQUVXZ', p_size % 12 + 1, 1) || (p_size % 10)"


@query(
    "SRC-09",
    f"""SELECT 'MOEX:' || {ROOT} AS symbol, p_brand AS asset_code, count(*) AS n, count(*) FILTER (WHERE p_partkey % 3 = 0) AS n_traded
FROM part WHERE p_partkey % 4 <> 0 GROUP BY 1, 2""",
)
def exchange_chain(spark, sf):
    part = A.table(spark, sf, "part")
    size, key = F.col("p_size"), F.col("p_partkey")
    root = F.concat(F.lit("RI"), F.substr(F.lit("FGHJKMNQUVXZ"), size % 12 + 1, F.lit(1)), (size % 10).cast("string"))
    rows = part.withColumn("page", F.floor(key / 1000))
    pages = landed.as_blocks(
        rows, "series",
        {
            "secid": F.when(key % 4 == 0, F.concat(root, root)).otherwise(root), "asset_code": F.col("p_brand"),
            "start_date": F.lit("2024-01-01"), "expiration_date": F.lit("2024-06-20"), "is_traded": F.when(key % 3 == 0, 1).otherwise(0),
        },
        ["page"],
    )
    every = landed.futures_chain(pages).groupBy("symbol", "asset_code").agg(F.count("*").alias("n"))
    live = landed.futures_chain(pages, only_traded=True).groupBy("symbol", "asset_code").agg(F.count("*").alias("k"))
    return every.join(live, ["symbol", "asset_code"], "left").select(
        "symbol", "asset_code", "n", F.coalesce("k", F.lit(0).cast("long")).alias("n_traded")
    )


@query("SRC-10", S.with_(S.BARS, S.MEMBERS) + " SELECT date, 'MOEX:' || symbol AS symbol, 2.5::DOUBLE AS weight FROM membership")
def exchange_constituents(spark, sf):
    pages = landed.as_blocks(
        A.membership(spark, sf).withColumn("page", F.col("date")), "analytics",
        {"tradedate": F.col("date"), "secids": F.col("symbol"), "weight": F.lit(2.5)}, ["page"],
    )
    return landed.constituents(pages).select(as_ts("date").alias("date"), "symbol", "weight")


@query("SRC-11", BARS + " SELECT DISTINCT 'MOEX:' || symbol AS symbol, 'MOEX' AS exchange, 'equity' AS asset_class, 'TQBR' AS board FROM bars")
def exchange_instruments(spark, sf):
    return landed.instruments(history_pages(spark, sf)).select("symbol", "exchange", "asset_class", "board")


@query(
    "SRC-12",
    BARS
    + f""" SELECT symbol, ts, {r("CASE WHEN ts >= TIMESTAMP '1999-07-01' THEN close * 2 ELSE close END", 4)} AS close FROM bars""",
)
def store_upsert(spark, sf):
    path = scratch(spark, "store")
    b = A.bars(spark, sf)
    store.write_bars(spark, b.filter(day("ts") < F.lit("2000-01-01").cast("date")), path, A.FREQ)
    late = b.filter(day("ts") >= F.lit("1999-07-01").cast("date")).withColumn("close", F.col("close") * 2)
    store.write_bars(spark, late, path, A.FREQ)
    store.compact(spark, path, A.FREQ, end="1999-09-30")  # later months stay merged on read
    return store.read_bars(spark, path).select("symbol", "ts", R("close", 4).alias("close"))


RANGE = "symbol IN ('NATION_1', 'NATION_7', 'NOWHERE') AND ts BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31'"


@query("SRC-13", BARS + f" SELECT symbol, ts, {price_sql()} FROM bars WHERE {RANGE}")
def store_scan(spark, sf):
    path = scratch(spark, "store")
    store.write_bars(spark, A.bars(spark, sf), path, A.FREQ)
    return bars_out(store.read_bars(spark, path, ["NATION_1", "NATION_7", "NOWHERE"], "1997-01-01", "1997-12-31"))


@query(
    "SRC-14",
    BARS
    + f""" SELECT sector, CASE WHEN sector < 'B' THEN 'futures' ELSE 'equity' END AS preset, CASE WHEN sector < 'B' THEN 0.8 ELSE 4.0 END::DOUBLE AS commission_bps,
count(*) AS n, {r("sum(volume)", 2)} AS volume FROM bars GROUP BY ALL""",
)
def dimensions(spark, sf):
    presets = costs.scenario_table(spark, {k: costs.PRESETS[k] for k in ("equity", "futures")})
    dim = A.symbols(spark, sf).withColumn("scenario", F.when(F.col("sector") < "B", "futures").otherwise("equity"))
    dim = dim.join(F.broadcast(presets.select("scenario", "commission_bps")), "scenario")
    return (
        A.bars(spark, sf).join(F.broadcast(dim), "symbol")
        .groupBy("sector", F.col("scenario").alias("preset"), "commission_bps")
        .agg(F.count("*").alias("n"), R(F.sum("volume"), 2).alias("volume"))
    )


BOOK = S.with_(S.PANEL, S.book(), S.accounts())


@query("SRC-15", BOOK + f" SELECT ts, {r('net', 8)} AS net, {r('equity')} AS equity FROM daily")
def result_store(spark, sf):
    path = scratch(spark, "results")
    book = sample_book(spark, sf)
    store.save_result({"daily": book.daily, "exposure": accounting.exposure(book.positions)}, path)
    return store.load_result(spark, path, "daily", "run").select("ts", R("net", 8).alias("net"), R("equity").alias("equity"))


@query(
    "SRC-16",
    BARS + """ SELECT symbol, '1d' AS freq, min(ts) AS start, max(ts) AS "end", count(*) AS rows, 'ok' AS status FROM bars GROUP BY symbol""",
)
def audit_log(spark, sf):
    path = scratch(spark, "audit")
    for _ in range(2):  # the second one is a replay
        store.write_bars(spark, A.bars(spark, sf), path, A.FREQ, "first")
    return store.read_audit(spark, path).select("symbol", "freq", "start", "end", "rows", "status")


@query("SRC-17", BARS + f" SELECT CAST(epoch(ts) AS BIGINT) AS t, {price_sql()} FROM bars WHERE symbol = 'NATION_3' AND ts >= TIMESTAMP '2000-01-01'")
def bar_lookup(spark, sf):
    b = A.bars(spark, sf).filter((F.col("symbol") == "NATION_3") & (day("ts") >= F.lit("2000-01-01").cast("date")))
    return b.select(F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), *[R(c, 4).alias(c) for c in OHLC])


@query(
    "SRC-18",
    BOOK + f" SELECT symbol, count(*) AS n, {r('sum(abs(dw))', 4)} AS moved FROM held WHERE abs(dw) > 1e-6 GROUP BY symbol",
)
def ledger_export(spark, sf):
    path = scratch(spark, "ledger")
    book = sample_book(spark, sf)
    store.export_ledger(accounting.ledger(book), path)
    back = spark.read.option("header", True).csv(path)
    moved = book.positions.groupBy("symbol").agg(R(F.sum(F.when(F.abs("dw") > 1e-6, F.abs("dw"))), 4).alias("moved"))
    return back.groupBy("symbol").agg(F.count("*").alias("n")).join(moved, "symbol")


# --- streaming -------------------------------------------------------------


@query(
    "STR-01",
    BARS
    + f""" SELECT symbol, ts, {r("CASE WHEN ts >= TIMESTAMP '2000-01-01' THEN close + 5 ELSE close END", 4)} AS close FROM bars""",
)
def incremental_landing(spark, sf):
    """Two landings through the stream, the second correcting part of the first."""
    root = scratch(spark, "landing")
    b = A.bars(spark, sf).withColumn("oi", F.lit(None).cast("double"))
    first = b.withColumn("seq", F.lit(0))
    fix = b.filter(day("ts") >= F.lit("2000-01-01").cast("date")).withColumns({"close": F.col("close") + 5, "seq": F.lit(1)})
    for part in (first, fix, fix):
        part.write.mode("append").parquet(f"{root}/in")
        jobs.land_increment(
            spark, f"{root}/in", part.schema, f"{root}/store", f"{root}/checkpoint", A.FREQ
        ).awaitTermination()
    return store.read_bars(spark, f"{root}/store").select("symbol", "ts", R("close", 4).alias("close"))


@query(
    "STR-02",
    S.with_(S.TICKS, tick_bars_sql("10m"))
    + f" SELECT symbol, ts, {price_sql()}, {r('volume', 2)} AS volume FROM tb WHERE ts + INTERVAL 10 MINUTE <= (SELECT max(ts) FROM ticks) - INTERVAL 10 MINUTE",
)
def tick_stream(spark, sf):
    """Finished 10-minute bars of the event stream."""
    root = scratch(spark, "stream")
    t = A.ticks(spark, sf)
    src = f"{root}/in"
    t.select("symbol", F.col("ts").cast("timestamp").alias("ts"), "event_id", "price", F.lit(1.0).alias("size")).write.parquet(src)
    stream = spark.readStream.schema("symbol string, ts timestamp, event_id long, price double, size double").parquet(src)
    jobs.stream_bars(stream, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    b = spark.read.parquet(f"{root}/out").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return b.select("symbol", "ts", *[R(c, 4).alias(c) for c in OHLC], R("volume", 2).alias("volume"))
