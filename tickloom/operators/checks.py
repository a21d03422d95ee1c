"""Quality checks over plans, and parameter sweeps."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import day


def truncated(df: DataFrame, end, columns: Sequence[str] = ("announce_date", "event_date", "report_ts", "release_ts", "asof_date", "ts", "date")) -> DataFrame:
    """Rows known at ``end``: cut on the first date column present."""
    for name in columns:
        if name in df.columns:
            return df.filter(day(name) <= end)
    return df


def cut_date(calendar: DataFrame, fraction: float):
    """The calendar date at a fraction of the bars, as a scalar subquery."""
    days = calendar.agg(F.array_sort(F.collect_set(day("ts"))).alias("d"))
    return days.select(
        F.element_at("d", F.greatest(F.lit(1), F.floor(F.size("d") * fraction).cast("int")))
    ).scalar()


def lookahead_audit(
    build: Callable[[DataFrame], DataFrame],
    panel: DataFrame,
    calendar: DataFrame,
    cuts: Sequence[float] = (0.5, 0.75, 0.9),
    tol: float = 1e-10,
) -> DataFrame:
    """Per cut: rows compared, rows that differ, and the first offender.

    ``build`` runs once on the full panel and once per cut on the panel ending
    at the cut; outputs ``(symbol, ts, w)`` must agree up to the cut.
    """
    full = build(panel).select("symbol", "ts", F.col("w").alias("w_full"))
    parts = []
    for c in cuts:
        end = cut_date(calendar, c)
        known = build(panel.filter(day("ts") <= end)).select("symbol", "ts", F.col("w").alias("w_cut"))
        both = full.filter(day("ts") <= end).join(known, ["symbol", "ts"], "full")
        gap = F.abs(F.coalesce("w_full", F.lit(0.0)) - F.coalesce("w_cut", F.lit(0.0)))
        bad = (gap > tol) | F.col("w_full").isNull() | F.col("w_cut").isNull()
        parts.append(
            both.agg(
                F.count(F.lit(1)).alias("n_rows"),
                F.sum(F.when(bad, 1).otherwise(0)).alias("n_bad"),
                F.min(F.when(bad, F.col("ts"))).alias("first_bad_ts"),
            ).select(F.lit(float(c)).alias("cut"), "n_rows", "n_bad", "first_bad_ts")
        )
    return reduce(DataFrame.unionByName, parts)


def parse_range(text: str) -> list[float]:
    """``lo:hi:step`` (inclusive) or a comma list."""
    if ":" in text:
        lo, hi, step = (float(x) for x in text.split(":"))
        n = int((hi - lo) / step + 1e-9)
        return [lo + i * step for i in range(n + 1)]
    return [float(x) for x in text.split(",")]


def grid_cells(grid: dict[str, Iterable]) -> list[dict]:
    """Cartesian product as a list of cells with ids (planning-time list)."""
    names = list(grid)
    return [
        {"cell_id": i, **dict(zip(names, values))}
        for i, values in enumerate(product(*[list(v) for v in grid.values()]))
    ]
