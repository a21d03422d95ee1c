"""Market-data tables derived from the driver's tables.

``bars``  : one row per (nation, ship date) with OHLC of the unit price.
``panel`` : bars on the dense calendar with a smooth price ``px`` (trailing
63-row traded value over volume), returns and a liquidity-based universe flag.

Prices are formed from whole cents and whole units, so they do not depend on
the order in which partial sums are merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalar import as_ts, day, div
from ..functions.window import cumulative, ffill, ordered, shift
from ..operators import sessions as cal
from ..operators.carry import annualized_basis
from ..session import configure

PX_WINDOW = 63
LIQUID_WINDOW = 20
LIQUID_MIN = 8
FREQ = "1d"


_SCHEMAS: dict[str, StructType] = {}
_CONFIGURED: set[str] = set()


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table.  Its schema is inferred once per path: inference is a
    Spark job of its own, and a plan reads the small tables several times."""
    if spark.sparkContext.applicationId not in _CONFIGURED:
        configure(spark)
        _CONFIGURED.add(spark.sparkContext.applicationId)
    path = f"{sf.rstrip('/')}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def nations(spark: SparkSession, sf: str) -> DataFrame:
    """nationkey → symbol, sector.  Both tables have a fixed size (25 and 5 rows)."""
    region = table(spark, sf, "region").select("r_regionkey", F.col("r_name").alias("sector"))
    return (
        table(spark, sf, "nation")
        .join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", F.col("n_name").alias("symbol"), "sector")
    )


def sellers(spark: SparkSession, sf: str) -> DataFrame:
    """suppkey → nationkey, broadcast only while the two columns stay small."""
    cols = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    return broadcast_within(cols)


def symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Nations that have a supplier (at most 25 rows)."""
    used = table(spark, sf, "supplier").select("s_nationkey").distinct()
    return (
        nations(spark, sf)
        .join(used, F.col("n_nationkey") == F.col("s_nationkey"), "left_semi")
        .select("symbol", "sector")
    )


def hedges(spark: SparkSession, sf: str) -> DataFrame:
    """(symbol, hedge): each symbol's next one in its sector, the last of a sector has none."""
    follower = F.lead("symbol").over(Window.partitionBy("sector").orderBy("symbol"))
    return symbols(spark, sf).select("symbol", follower.alias("hedge")).filter(F.col("hedge").isNotNull())


BROADCAST_LIMIT = 64 << 20


def broadcast_within(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Hint a broadcast when the plan's estimated size is within ``limit`` bytes.

    Meant for a scan with a projection, whose estimate comes from file sizes.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(size)) <= limit else df


def cents(x: str) -> Column:
    return F.round(F.col(x) * 100).cast("long")


def trades(spark: SparkSession, sf: str) -> DataFrame:
    """Trade prints by nation key; ``seq`` orders them (order, line, then price
    to settle repeated pairs)."""
    lines = table(spark, sf, "lineitem").select(
        "l_suppkey",
        "l_orderkey",
        "l_linenumber",
        day("l_shipdate").alias("day"),
        F.col("l_quantity").cast("long").alias("qty"),
        cents("l_extendedprice").alias("cents"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
    )
    return lines.join(sellers(spark, sf), F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("s_nationkey").alias("nationkey"),
        "day",
        "qty",
        "cents",
        "price",
        F.struct("l_orderkey", "l_linenumber", "price").alias("seq"),
    )


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """Daily OHLCV.

    Rows merge before the shuffle, so a nation with a third of all rows sends
    one partial per input task and day.  The group key is two integers; names
    are attached to the finished bars.
    """
    daily = (
        trades(spark, sf)
        .groupBy("nationkey", "day")
        .agg(
            F.min("seq").alias("first"),
            F.max("seq").alias("last"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.sum("qty").alias("qty"),
            F.sum("cents").alias("cents"),
        )
    )
    names = nations(spark, sf).select("n_nationkey", "symbol")
    return daily.join(F.broadcast(names), F.col("nationkey") == F.col("n_nationkey")).select(
        "symbol",
        as_ts("day").alias("ts"),
        F.col("first.price").alias("open"),
        "high",
        "low",
        F.col("last.price").alias("close"),
        F.col("qty").cast("double").alias("volume"),
        (F.col("cents") / 100).alias("value"),
    )


def days(spark: SparkSession, sf: str) -> DataFrame:
    """The ship dates as one array; reads one column of the line items."""
    d = table(spark, sf, "lineitem").select(day("l_shipdate").alias("d")).distinct()
    return cal.day_array(d.select(as_ts("d").alias("ts")))


def calendar(spark: SparkSession, sf: str) -> DataFrame:
    """(pos, ts) of the distinct ship dates."""
    return days(spark, sf).select(F.posexplode("days").alias("pos", "ts"))


def dense_bars(spark: SparkSession, sf: str) -> DataFrame:
    return cal.densify(bars(spark, sf), days(spark, sf), symbols(spark, sf))


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """The research panel: symbol, sector, ts, pos, OHLC around ``px``, tr, ret,
    volume, value, in_universe.

    All window steps share one partitioning (symbol) and one order (ts).  The
    rolling sums are of whole numbers, so differences of running sums give them
    exactly and at a constant cost per row.
    """
    run = cumulative()
    base = dense_bars(spark, sf).select(
        "symbol",
        "sector",
        "ts",
        "pos",
        "volume",
        "value",
        F.coalesce(
            div(F.col("high") - F.col("low"), F.col("high") + F.col("low")), F.lit(0.0)
        ).alias("_rng"),
        F.sum(F.round(F.col("value") * 100).cast("long")).over(run).alias("_c"),
        F.sum(F.col("volume").cast("long")).over(run).alias("_v"),
        F.count("volume").over(run).alias("_n"),
    )

    def last_rows(x: str, n: int) -> Column:
        total = F.coalesce(x, F.lit(0).cast("long"))
        before = F.lag(total, n, 0).over(ordered())
        return total - before

    traded = last_rows("_n", LIQUID_WINDOW)
    px = div(last_rows("_c", PX_WINDOW), last_rows("_v", PX_WINDOW) * 100)
    out = base.select(
        "symbol", "sector", "ts", "pos", "volume", "value", "_rng", traded.alias("_traded"),
        F.when(F.col("pos") >= PX_WINDOW - 1, px).alias("close"),
    )
    prev = F.lag("close").over(ordered())
    out = out.select("*", prev.alias("open"), (div("close", prev) - 1).alias("ret"))
    return out.select(
        "symbol",
        "sector",
        "ts",
        F.col("pos").cast("long").alias("pos"),
        "open",
        (F.greatest("open", "close") * (1 + F.lit(0.01) * F.col("_rng"))).alias("high"),
        (F.least("open", "close") * (1 - F.lit(0.01) * F.col("_rng"))).alias("low"),
        "close",
        F.col("close").alias("tr"),
        "ret",
        "volume",
        "value",
        ((F.col("_traded") >= LIQUID_MIN) & F.col("close").isNotNull()).alias("in_universe"),
    )


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    """Intraday prints: symbol = event type, price = value."""
    return table(spark, sf, "events").select(
        F.col("event_type").alias("symbol"), "ts", "event_id", F.col("value").alias("price")
    )


def orders_by_symbol(spark: SparkSession, sf: str, priority: str | None = None) -> DataFrame:
    """Orders with the customer's nation as symbol.

    The customer table grows with the data: it is broadcast only while its two
    columns are small, and joined by sort-merge (with skewed partitions split at
    run time) beyond that.
    """
    orders = table(spark, sf, "orders")
    if priority:
        orders = orders.filter(F.col("o_orderpriority") == priority)
    cust = broadcast_within(table(spark, sf, "customer").select("c_custkey", "c_nationkey"))
    return (
        orders.join(cust, F.col("o_custkey") == F.col("c_custkey"))
        .join(F.broadcast(nations(spark, sf)), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "symbol",
            "sector",
            as_ts(day("o_orderdate")).alias("event_date"),
            F.col("o_totalprice").alias("magnitude"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_orderkey").alias("event_id"),
        )
    )


def corp_events(spark: SparkSession, sf: str) -> DataFrame:
    """Corporate events: every order of the table."""
    return orders_by_symbol(spark, sf)


# --- derived event tables --------------------------------------------------


def membership(spark: SparkSession, sf: str, top: int = 15) -> DataFrame:
    """Quarterly snapshots (date = last bar of the quarter) of the symbols with
    the highest traded value in the quarter."""
    q = bars(spark, sf).groupBy("symbol", F.trunc(day("ts"), "quarter").alias("q")).agg(
        F.sum(F.round(F.col("value") * 100).cast("long")).alias("v"), F.max("ts").alias("ts")
    )
    w = Window.partitionBy("q")
    ranked = q.withColumns(
        {
            "date": F.max("ts").over(w),
            "rk": F.row_number().over(w.orderBy(F.desc("v"), "symbol")),
        }
    )
    return ranked.filter(F.col("rk") <= top).select(day("date").alias("date"), "symbol")


def dividends(spark: SparkSession, sf: str) -> DataFrame:
    """Urgent orders as small cash dividends."""
    return corp_events(spark, sf).select(
        "symbol", day("event_date").alias("ex_date"), (F.col("magnitude") / 1e6).alias("value")
    )


def splits(spark: SparkSession, sf: str) -> DataFrame:
    """One 2-for-1 or 3-for-1 split per symbol, on a day its orders decide."""
    first = orders_by_symbol(spark, sf).groupBy("symbol").agg(
        F.max("event_date").alias("hi"), F.min("event_id").alias("k")
    )
    return first.select(
        "symbol",
        F.date_sub(day("hi"), (F.col("k") % 900 + 200).cast("int")).alias("ex_date"),
        (2 + F.col("k") % 2).cast("double").alias("value"),
    )


def basis(spark: SparkSession, sf: str) -> DataFrame:
    """The panel with an annualised basis: near = price, far = price 21 bars ago,
    30 days apart; missing on bars without a trade, then filled 5 bars."""
    near_far = annualized_basis("close", shift("close", 21), F.lit(30.0))
    p = panel(spark, sf).withColumn("_b", F.when(F.col("volume").isNotNull(), near_far))
    return p.withColumn("basis", ffill("_b", 5)).drop("_b")


def vol_curve(spark: SparkSession, sf: str) -> DataFrame:
    """A volatility futures curve: per bar three monthly expiries whose levels
    come from three sectors' traded value per unit."""
    b = bars(spark, sf).join(F.broadcast(symbols(spark, sf)), "symbol")
    per_day = b.groupBy("ts", "sector").agg(
        F.sum(F.round(F.col("value") * 100).cast("long")).alias("c"),
        F.sum(F.col("volume").cast("long")).alias("v"),
    )
    w = Window.partitionBy("sector").orderBy("ts").rowsBetween(-20, 0)
    level = div(F.sum("c").over(w), F.sum("v").over(w) * 100) / 100
    slot = F.dense_rank().over(Window.partitionBy("ts").orderBy("sector"))
    month = F.trunc(day("ts"), "month")
    return (
        per_day.withColumns({"settle": level, "slot": slot})
        .select(
            day("ts").alias("date"),
            F.date_add(F.add_months(month, F.col("slot") - 1), 14).alias("expiry"),
            "settle",
        )
    )


def option_surface(spark: SparkSession, sf: str) -> DataFrame:
    """Implied volatilities per bar and underlying: range-based levels at two
    expiries."""
    b = bars(spark, sf)
    spread = div(F.col("high") - F.col("low"), F.col("high") + F.col("low"))
    month = F.trunc(day("ts"), "month")
    return b.select(
        day("ts").alias("date"),
        F.explode(F.array(F.date_add(F.add_months(month, 1), 14), F.date_add(F.add_months(month, 2), 14))).alias("expiry"),
        F.col("symbol").alias("underlying_symbol"),
        F.col("close").alias("strike"),
        (F.lit(0.05) + spread * 0.4).alias("iv0"),
    ).select(
        "date", "expiry", "underlying_symbol", "strike",
        F.when(F.month("expiry") % 2 == 0, F.col("iv0")).otherwise(F.col("iv0") * 1.1).alias("iv"),
    )


def first_symbol(panel_df: DataFrame) -> Column:
    """The alphabetically first symbol, as a scalar subquery."""
    return panel_df.agg(F.min("symbol")).scalar()
