"""Rolling statistics as mergeable sliding windows.

A series is cut into blocks of the frame's length.  Every frame then is the end of one block
and the start of the next: an aggregate running backwards through the one merged with an
aggregate running forwards through the other.  Aggregates are counts, sums, centred moments,
extremes and products, all of which merge without a subtraction, so a wild value is gone with
the last frame that holds it, and a row costs the same for every frame length.  (Spark
evaluates a plain sliding frame anew at each row.)

All frames of a call share the shuffle on the keys.  A frame length adds two sorts inside the
partition; frames of up to ``DIRECT`` rows are evaluated directly.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scalar import div, finite
from .window import KEYS, ordered, trailing

MOMENTS = {
    "sum": F.sum,
    "avg": F.avg,
    "std": F.stddev_samp,
    "pstd": F.stddev_pop,
    "var": F.var_samp,
    "pvar": F.var_pop,
    "cov": F.covar_samp,
    "pcov": F.covar_pop,
}
EXTREMES = {"min": F.min, "max": F.max, "product": F.product}
KINDS = {*MOMENTS, *EXTREMES, "corr", "slope"}
DIRECT = 12


@dataclass(frozen=True)
class Roll:
    """One rolling statistic: ``fn`` of column ``x`` (and ``y``) over ``n`` rows
    ending ``lag`` rows back, NULL below ``min_periods`` values.

    ``fn`` is one of ``KINDS``; ``slope`` is the least-squares slope of x on y.
    """

    out: str
    fn: str
    x: str
    n: int
    min_periods: int | None = None
    lag: int = 0
    y: str | None = None

    def __post_init__(self):
        if self.fn not in KINDS:
            raise ValueError(f"unknown rolling function {self.fn!r}")

    @property
    def least(self) -> int:
        return self.n if self.min_periods is None else self.min_periods

    @property
    def family(self) -> tuple:
        """Statistics of one family come from the same aggregates."""
        kind = self.fn if self.fn in EXTREMES else "moments"
        return kind, self.x, self.y, self.n

    def series(self) -> list[Column]:
        """The values that count: with two series, rows where both have one."""
        found = [F.col(c).cast("double") for c in (self.x, self.y) if c]
        if self.y:
            whole = found[0].isNotNull() & found[1].isNotNull()
            found = [F.when(whole, c) for c in found]
        return found


def direct(spec: Roll, keys: Sequence[str], order: str) -> Column:
    """The statistic over its own frame, evaluated row by row."""
    frame, series = trailing(spec.n, spec.lag, keys, order), spec.series()
    if spec.fn == "corr":  # NULL, not an error, where a series does not move
        scale = F.stddev_pop(series[0]).over(frame) * F.stddev_pop(series[1]).over(frame)
        value = div(F.covar_pop(*series).over(frame), scale)
    elif spec.fn == "slope":
        value = div(F.covar_pop(*series).over(frame), F.var_pop(series[1]).over(frame))
    else:
        value = (MOMENTS | EXTREMES)[spec.fn](*series).over(frame)
    return F.when(F.count(series[0]).over(frame) >= spec.least, finite(value))


def aggregates(spec: Roll, frame) -> Column:
    """The mergeable aggregates of a family over ``frame``: n, then sums and centred moments, or the extreme."""
    series = spec.series()
    n = F.count(series[0]).over(frame)
    fields = [n.alias("n")]
    if spec.fn in EXTREMES:
        return F.struct(*fields, EXTREMES[spec.fn](series[0]).over(frame).alias("value"))
    for name, c in zip("xy", series, strict=False):
        fields += [F.sum(c).over(frame).alias(f"s{name}"), (F.var_pop(c).over(frame) * n).alias(f"m{name}")]
        fields += [F.min(c).over(frame).alias(f"l{name}"), F.max(c).over(frame).alias(f"h{name}")]
    if spec.y:
        fields.append((F.covar_pop(*series).over(frame) * n).alias("c"))
    return F.struct(*fields)


def merged(a: Column, b: Column, spec: Roll) -> Column:
    """The aggregates of two neighbouring stretches taken together; either may be missing or empty."""
    na, nb = (F.coalesce(s["n"], F.lit(0)).cast("double") for s in (a, b))
    n = na + nb
    fields = [n.alias("n")]
    if spec.fn in EXTREMES:
        x, y = a["value"], b["value"]
        both = {"min": F.least(x, y), "max": F.greatest(x, y), "product": F.coalesce(x, F.lit(1.0)) * F.coalesce(y, F.lit(1.0))}
        return F.struct(*fields, both[spec.fn].alias("value"))
    weight = F.when((na > 0) & (nb > 0), na * nb / n).otherwise(F.lit(0.0))

    def total(name: str) -> Column:
        return F.coalesce(a[name], F.lit(0.0)) + F.coalesce(b[name], F.lit(0.0))

    def gap(name: str) -> Column:
        return F.when(weight > 0, b[name] / nb - a[name] / na).otherwise(F.lit(0.0))

    low, high, gaps = {}, {}, {}
    for name in "xy"[: 2 if spec.y else 1]:
        low[name], high[name] = F.least(a[f"l{name}"], b[f"l{name}"]), F.greatest(a[f"h{name}"], b[f"h{name}"])
        # Means of equal values may differ in their last digit; a series that does not move has no gap.
        gaps[name] = F.when(low[name] < high[name], gap(f"s{name}")).otherwise(F.lit(0.0))
    for name, d in gaps.items():
        fields += [total(f"s{name}").alias(f"s{name}"), (total(f"m{name}") + d * d * weight).alias(f"m{name}")]
        fields += [low[name].alias(f"l{name}"), high[name].alias(f"h{name}")]
    if spec.y:
        fields.append((total("c") + gaps["x"] * gaps["y"] * weight).alias("c"))
    return F.struct(*fields)


def statistic(fn: str, s: Column) -> Column:
    """``fn`` from the aggregates of a frame with values."""
    n = s["n"]
    if fn in EXTREMES:
        return s["value"]
    values = {
        "sum": lambda: s["sx"],
        "avg": lambda: div(s["sx"], n),
        "pvar": lambda: div(s["mx"], n),
        "pstd": lambda: F.sqrt(div(s["mx"], n)),
        "var": lambda: div(s["mx"], n - 1),
        "std": lambda: F.sqrt(div(s["mx"], n - 1)),
        "pcov": lambda: div(s["c"], n),
        "cov": lambda: div(s["c"], n - 1),
        "corr": lambda: div(s["c"], F.sqrt(s["mx"]) * F.sqrt(s["my"])),
        "slope": lambda: div(s["c"], s["my"]),
    }
    return values[fn]()


def rolling(df: DataFrame, rolls: Sequence[Roll], keys: Sequence[str] = KEYS, order: str = "ts") -> DataFrame:
    """Add all ``rolls`` as columns; a pair of series counts the rows where both have a value."""
    outs = {r.out for r in rolls}
    kept = [F.col(f"`{c}`") for c in df.columns if c not in outs]
    small = [r for r in rolls if r.n <= DIRECT]
    long = [r for r in rolls if r.n > DIRECT]
    if not long:
        return df.select(*kept, *[direct(r, keys, order).alias(r.out) for r in small])
    families = {r.family: r for r in long}
    name = {family: f"_roll{k}" for k, family in enumerate(families)}
    work = df.withColumn("_roll_rn", F.row_number().over(ordered(keys, order)) - 1)
    for n in sorted({r.n for r in long}):
        own = {f: r for f, r in families.items() if r.n == n}
        block = F.floor(F.col("_roll_rn") / n).cast("int")
        work = work.withColumn("_roll_block", block)
        inside = Window.partitionBy(*keys, "_roll_block")
        back = inside.orderBy(F.desc("_roll_rn")).rowsBetween(Window.unboundedPreceding, 0)
        ahead = inside.orderBy("_roll_rn").rowsBetween(Window.unboundedPreceding, 0)
        work = work.withColumns({name[f] + "t": aggregates(r, back) for f, r in own.items()})
        work = work.withColumns({name[f] + "h": aggregates(r, ahead) for f, r in own.items()})
        # The end of the block before, from n - 1 rows back; a row that ends its block has the frame already.
        line = Window.partitionBy(*keys).orderBy("_roll_block", "_roll_rn")
        ends = F.pmod("_roll_rn", F.lit(n)) == n - 1
        work = work.withColumns({name[f] + "t": F.when(~ends, F.lag(name[f] + "t", n - 1).over(line)) for f in own})
        work = work.withColumns({name[f]: merged(F.col(name[f] + "t"), F.col(name[f] + "h"), r) for f, r in own.items()})
        work = work.drop("_roll_block", *[name[f] + half for f in own for half in "th"])
    lags = sorted({r.lag for r in long} - {0})
    line = Window.partitionBy(*keys).orderBy("_roll_rn")
    shifted = {(f, k): f"{name[f]}_{k}" for k in lags for f in families if any(r.family == f and r.lag == k for r in long)}
    work = work.withColumns({c: F.lag(name[f], k).over(line) for (f, k), c in shifted.items()})

    def value(r: Roll) -> Column:
        s = F.col(shifted[r.family, r.lag] if r.lag else name[r.family])
        return F.when(s["n"] >= r.least, finite(statistic(r.fn, s))).alias(r.out)

    return work.select(*kept, *[value(r) for r in long], *[direct(r, keys, order).alias(r.out) for r in small])
