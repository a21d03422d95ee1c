"""Reference dimensions: aliases, sectors, universe lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Old ticker → current ticker; None = delisted without successor.
TICKER_ALIASES = {
    "YNDX": "YDEX",
    "TCSG": "T",
    "FIVE": "X5",
    "POLY": None,
    "GAZP": "GAZP",
    "SBER": "SBER",
}


def alias_table(spark: SparkSession, aliases: dict[str, str | None]) -> DataFrame:
    return spark.createDataFrame(list(aliases.items()), "old string, new string")


def canonicalise(df: DataFrame, aliases: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Current ticker per row; ``terminated`` when there is no successor.

    The alias table is a hand-kept list, so it is broadcast.
    """
    a = F.broadcast(aliases.withColumn("_hit", F.lit(True)))
    joined = df.join(a, df[symbol] == a["old"], "left")
    return joined.withColumns(
        {
            "terminated": F.coalesce(F.col("_hit"), F.lit(False)) & F.col("new").isNull(),
            symbol: F.coalesce("new", symbol),
        }
    ).drop("old", "new", "_hit")


def dimension(spark: SparkSession, rows: dict[str, str], key: str, value: str) -> DataFrame:
    return spark.createDataFrame(list(rows.items()), f"{key} string, {value} string")
