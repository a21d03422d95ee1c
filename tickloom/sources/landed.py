"""Landed exchange and broker payloads → typed tables.

Inputs are frames with a ``body`` column (one JSON text per landed file, e.g.
from ``spark.read.text(path, wholetext=True)``) plus whatever key columns the
landing job kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import BAR_NUMERIC
from .files import to_double

EXCHANGE_ZONE = "Europe/Moscow"
FUTURE_ID = "^[A-Z]{2}[FGHJKMNQUVXZ][0-9]$"

# Ids served by the index feed.
INDEX_IDS = (
    "IMOEX", "IMOEX2", "RTSI", "MOEXBC", "MOEXBMI", "MOEXOG", "MOEXEU", "MOEXTL", "MOEXCN",
    "MOEXFN", "MOEXMM", "MOEXCH", "MOEXTN", "MOEXRE", "MOEX10", "RGBITR", "MCFTR", "MCFTRR",
    "RTSTR", "RTSTRR", "RGBI",
)

# Broker time frames per bar frequency.
TIMEFRAMES = {
    "1m": "TIME_FRAME_M1",
    "5m": "TIME_FRAME_M5",
    "1h": "TIME_FRAME_H1",
    "1d": "TIME_FRAME_D",
}


def read_landed(spark: SparkSession, path: str, envelope: bool = False) -> DataFrame:
    """Landed JSON files; ``envelope``: the payload is a string inside ``body``."""
    raw = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("file"), F.col("value").alias("body")
    )
    if envelope:
        raw = raw.withColumn("body", F.get_json_object("body", "$.body"))
    return raw


def block_rows(landed: DataFrame, block: str) -> DataFrame:
    """Rows of ``{"block": {"columns": [...], "data": [[...]]}}`` as maps of text."""
    shape = f"struct<`{block}`: struct<columns: array<string>, data: array<array<string>>>>"
    keys = [c for c in landed.columns if c != "body"]
    parsed = landed.select(*keys, F.from_json("body", shape).getField(block).alias("b"))
    return parsed.select(*keys, "b.columns", F.posexplode("b.data").alias("row_no", "cells")).select(
        *keys, "row_no", F.map_from_arrays("columns", "cells").alias("r")
    )


def text(name: str) -> Column:
    return F.try_element_at("r", F.lit(name))


def number(name: str) -> Column:
    return to_double(text(name))


def local_to_utc(x: Column, zone: str = EXCHANGE_ZONE) -> Column:
    return F.to_utc_timestamp(x.try_cast("timestamp"), zone).cast("timestamp_ntz")


def classify(symbol: Column | str) -> Column:
    s = F.col(symbol) if isinstance(symbol, str) else symbol
    return (
        F.when(s.isin(*INDEX_IDS), "index").when(s.rlike(FUTURE_ID), "future").otherwise("equity")
    )


def strip_prefix(symbol: Column | str) -> Column:
    """``X:ABC`` → ``ABC``; a bare id stays."""
    s = F.col(symbol) if isinstance(symbol, str) else symbol
    return F.when(F.instr(s, ":") > 0, F.substr(s, F.instr(s, ":") + F.lit(1))).otherwise(s)


def add_prefix(symbol: Column | str, prefix: str) -> Column:
    return F.concat(F.lit(prefix + ":"), F.col(symbol) if isinstance(symbol, str) else symbol)


def daily_history(landed: DataFrame, kind: str, symbol: str = "symbol") -> DataFrame:
    """Daily bars.  Futures close at the settlement price when CLOSE is missing
    and carry open interest; equities and indices have none."""
    if kind not in ("equity", "index", "future"):
        raise ValueError(f"unknown kind {kind!r}")
    future = kind == "future"
    close = F.coalesce(number("CLOSE"), number("SETTLEPRICE")) if future else number("CLOSE")
    return block_rows(landed, "history").select(
        F.col(symbol).alias("symbol"),
        text("TRADEDATE").try_cast("date").cast("timestamp_ntz").alias("ts"),
        number("OPEN").alias("open"),
        number("HIGH").alias("high"),
        number("LOW").alias("low"),
        close.alias("close"),
        number("VOLUME").alias("volume"),
        number("VALUE").alias("value"),
        (number("OPENPOSITION") if future else F.lit(None).cast("double")).alias("oi"),
    )


def candles(landed: DataFrame, symbol: str = "symbol", zone: str = EXCHANGE_ZONE) -> DataFrame:
    """Intraday candles; the naive exchange-local start becomes UTC."""
    return block_rows(landed, "candles").select(
        F.col(symbol).alias("symbol"),
        local_to_utc(text("begin"), zone).alias("ts"),
        *[number(c).alias(c) for c in ("open", "high", "low", "close", "volume", "value")],
        F.lit(None).cast("double").alias("oi"),
    )


def date_time() -> Column:
    return F.concat_ws(" ", text("tradedate"), text("tradetime"))


def trade_stats(landed: DataFrame, symbol: str = "symbol", zone: str = EXCHANGE_ZONE) -> DataFrame:
    names = {
        "open": "pr_open", "high": "pr_high", "low": "pr_low", "close": "pr_close",
        "volume": "vol", "value": "val",
    }
    return block_rows(landed, "data").select(
        F.col(symbol).alias("symbol"),
        local_to_utc(date_time(), zone).alias("ts"),
        *[number(src).alias(dst) for dst, src in names.items()],
        F.lit(None).cast("double").alias("oi"),
    )


def book_stats(landed: DataFrame, symbol: str = "symbol", zone: str = EXCHANGE_ZONE) -> DataFrame:
    """Order-book statistics; the fractional spread becomes basis points."""
    return block_rows(landed, "data").select(
        F.col(symbol).alias("symbol"),
        local_to_utc(date_time(), zone).alias("ts"),
        *[number(c).alias(c) for c in ("spread_bbo", "spread_lv10", "levels_b", "levels_s")],
        (number("spread_bbo") * 10_000).alias("spread_bps"),
    )


def broker_bars(landed: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Broker bars: an array of objects whose numbers are strings."""
    fields = ("timestamp", "open", "high", "low", "close", "volume")
    shape = "struct<bars: array<struct<" + ", ".join(f"{f}: string" for f in fields) + ">>>"
    rows = landed.select(
        F.col(symbol).alias("symbol"), F.explode(F.from_json("body", shape).bars).alias("b")
    )
    return rows.select(
        "symbol",
        F.col("b.timestamp").try_cast("timestamp").cast("timestamp_ntz").alias("ts"),
        *[
            to_double(F.col(f"b.{c}")).alias(c) if c in fields else F.lit(None).cast("double").alias(c)
            for c in BAR_NUMERIC
        ],
    )


def dividends(landed: DataFrame, symbol: str = "symbol") -> DataFrame:
    return block_rows(landed, "dividends").select(
        F.col(symbol).alias("symbol"),
        text("registryclosedate").try_cast("date").alias("ex_date"),
        F.lit("div").alias("kind"),
        number("value").alias("value"),
    )


def futures_chain(landed: DataFrame, only_traded: bool = False, prefix: str = "MOEX") -> DataFrame:
    """Single-contract ids only: calendar spreads do not match the pattern."""
    rows = block_rows(landed, "series").filter(text("secid").rlike(FUTURE_ID))
    if only_traded:
        rows = rows.filter(text("is_traded").try_cast("int") == 1)
    return rows.select(
        add_prefix(text("secid"), prefix).alias("symbol"),
        text("asset_code").alias("asset_code"),
        text("start_date").try_cast("date").alias("start"),
        text("expiration_date").try_cast("date").alias("expiry"),
        F.lit(1.0).alias("point_value"),
    )


def constituents(landed: DataFrame, prefix: str = "MOEX") -> DataFrame:
    return block_rows(landed, "analytics").select(
        text("tradedate").try_cast("date").alias("date"),
        add_prefix(text("secids"), prefix).alias("symbol"),
        number("weight").alias("weight"),
    )


def instruments(landed: DataFrame, exchange: str = "MOEX", board: str = "TQBR") -> DataFrame:
    """Distinct ids on the board, first listing kept."""
    rows = block_rows(landed, "history").select(
        text("SECID").alias("id"), text("CURRENCYID").alias("cur"), "row_no"
    )
    return (
        rows.filter(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.min_by("cur", "row_no").alias("cur"))
        .select(
            add_prefix("id", exchange).alias("symbol"),
            F.lit(exchange).alias("exchange"),
            F.lit("equity").alias("asset_class"),
            F.coalesce(F.nullif("cur", F.lit("")), F.lit("RUB")).alias("currency"),
            F.lit(board).alias("board"),
            F.create_map(F.lit("landed"), F.col("id")).alias("provider_symbols"),
        )
    )


def as_blocks(rows: DataFrame, block: str, columns: dict[str, Column], keys: list[str]) -> DataFrame:
    """The inverse of :func:`block_rows`: one JSON page per ``keys`` group.

    Used to land derived tables in the exchange's wire format.  Callers keep a
    page bounded (for instance one symbol and month).
    """
    names = F.array(*[F.lit(c) for c in columns])
    cells = F.array(*[v.cast("string") for v in columns.values()])
    page = F.struct(names.alias("columns"), F.collect_list(cells).alias("data"))
    return rows.groupBy(*keys).agg(F.to_json(F.struct(page.alias(block))).alias("body"))
