"""Inputs shared by several catalog modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...operators.accounting import Book, run_book, with_run
from ...operators.costs import PRESETS, CostParams, trailing_adv
from ...operators.tsignal import skip_return
from ...operators.xsection import fractile_weights
from .. import adapters as A


def sample_weights(spark, sf) -> DataFrame:
    """Panel with the sample book: 252-21 momentum, monthly, top and bottom fifth."""
    src = A.panel(spark, sf).withColumn("signal", skip_return("tr", 252, 21))
    return fractile_weights(src, 0.2, 0.2, long_only=False)


def sample_book(
    spark, sf, params: CostParams | None = PRESETS["equity"], lag: int = 1, nav: float = 1.0
) -> Book:
    return run_book(with_adv(with_run(sample_weights(spark, sf))), params, lag, nav)


def with_adv(df: DataFrame) -> DataFrame:
    return df.withColumn("adv", trailing_adv())


def first_symbol_panel(spark, sf) -> DataFrame:
    """Rows of the alphabetically first symbol (the single-instrument proxy)."""
    p = A.panel(spark, sf)
    first = A.symbols(spark, sf).agg(F.min("symbol")).scalar()
    return p.filter(F.col("symbol") == first)


def others_flat(spark, sf, w: DataFrame) -> DataFrame:
    """Weights of one instrument spread to the full grid, 0 elsewhere."""
    from ...operators.sessions import grid_of

    grid = grid_of(A.days(spark, sf), A.symbols(spark, sf).select("symbol")).select("symbol", "ts")
    return grid.join(w.select("symbol", "ts", "w"), ["symbol", "ts"], "left").withColumn(
        "w", F.coalesce("w", F.lit(0.0))
    )
