"""Exponentially weighted moments as a segmented scan with carried state.

Weights fall by ``decay`` with every position.  A series is cut into blocks of positions, one
block size for all statistics of a call, short enough that ``decay ** -place`` stays in double
range inside a block.  Running sums inside a block give its own moments; the state at the end of
a block (mean, variance, sum of weights and of squared weights) is carried over any number of
empty blocks to the next one and merged with the block's own moments.

The carried mean, variance and ratio of squared weights are free of scale, so a stretch without
values changes nothing but the weight they have against later values, whatever its length.  A
block with values outweighs what lies two blocks back by ``exp(DEPTH)``, more than a double can
tell, so a state is made of a block and the one before.

All windows order a series by (block, position), so a call sorts each partition once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scalar import div
from .window import KEYS, decay_of

DEPTH = 170.0  # four times this is still inside double range, as squared weights need


@dataclass(frozen=True)
class Ewm:
    """One statistic of column ``x``, ``mean`` or ``std`` (debiased), NULL below ``min_periods`` values."""

    out: str
    fn: str
    x: str
    halflife: float | None = None
    span: float | None = None
    min_periods: int = 1

    def __post_init__(self):
        if self.fn not in ("mean", "std"):
            raise ValueError(f"unknown exponential statistic {self.fn!r}")

    @property
    def decay(self) -> float:
        return decay_of(self.halflife, self.span)

    @property
    def least(self) -> int:
        return max(2, self.min_periods) if self.fn == "std" else self.min_periods


def own_moments(spec: Ewm, place: Column, frame) -> Column:
    """Moments of the rows of a block so far, about the block's first value; NULL before it.

    A mean needs ``mean`` and ``w`` alone; a deviation the variance and the ratio ``sq`` of squared weights, too.
    """
    x, first = F.col(f"_ewm_{spec.out}_x"), F.col(f"_ewm_{spec.out}_f")
    weight = F.when(x.isNotNull(), F.pow(F.lit(spec.decay), -place))
    d = x - first
    fields = [F.sum(weight).over(frame).alias("w"), F.sum(weight * d).over(frame).alias("s")]
    if spec.fn == "std":
        fields += [F.sum(weight * weight).over(frame).alias("ww"), F.sum(weight * d * d).over(frame).alias("ss")]
    return F.struct(*fields)


def as_state(spec: Ewm, sums: Column, first: Column, place: Column) -> Column:
    """State of a block's own rows, with weights as seen from the row itself."""
    w, off = sums["w"], sums["s"] / sums["w"]
    fields = [(first + off).alias("mean"), (w * F.pow(F.lit(spec.decay), place)).alias("w")]
    if spec.fn == "std":
        variance = F.greatest(sums["ss"] / w - off * off, F.lit(0.0))
        fields += [variance.alias("var"), (sums["ww"] / w / w).alias("sq")]
    return F.when(w.isNotNull(), F.struct(*fields))


def shares(spec: Ewm, before: Column, own: Column, positions: Column) -> Column:
    """What the carried state and the row's own state weigh at the row: ``w`` together, ``p`` and ``q`` as shares."""
    a = F.coalesce(before["state"]["w"] * F.pow(F.lit(spec.decay), positions), F.lit(0.0))
    b = F.coalesce(own["w"], F.lit(0.0))
    return F.struct((a + b).alias("w"), div(a, a + b).alias("p"), div(b, a + b).alias("q"))


def merged(spec: Ewm, before: Column, own: Column, share: Column) -> Column:
    """The two states taken together; without values of its own a row keeps what was carried, whatever its weight."""
    a, p, q = before["state"], share["p"], share["q"]
    d = own["mean"] - a["mean"]
    fields = [(a["mean"] + d * q).alias("mean"), share["w"].alias("w")]
    if spec.fn == "std":
        fields += [(p * a["var"] + q * own["var"] + p * q * d * d).alias("var"), (p * p * a["sq"] + q * q * own["sq"]).alias("sq")]
    carried = F.struct(a["mean"].alias("mean"), share["w"].alias("w"), *[a[c].alias(c) for c in ("var", "sq") if spec.fn == "std"])
    return F.when(own.isNull(), F.when(a.isNotNull(), carried)).when(a.isNull(), own).otherwise(F.struct(*fields))


def value(spec: Ewm, state: Column) -> Column:
    if spec.fn == "mean":
        return state["mean"]
    return F.sqrt(state["var"] * div(F.lit(1.0), 1.0 - state["sq"]))


def ewm(df: DataFrame, stats: Sequence[Ewm], keys: Sequence[str] = KEYS, pos: str = "pos") -> DataFrame:
    """Add all ``stats`` as columns; ``pos`` is an integer position, unique inside a key."""
    outs = {s.out for s in stats}
    kept = [F.col(f"`{c}`") for c in df.columns if c not in outs]
    size = min(max(1, int(DEPTH / math.log(1.0 / s.decay))) for s in stats)
    at = F.col(pos).cast("long")
    line = Window.partitionBy(*keys).orderBy("_ewm_block", pos)
    inside = Window.partitionBy(*keys, "_ewm_block").orderBy(pos)
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    place = F.col("_ewm_place")
    work = df.withColumns({"_ewm_block": F.floor(at / size), "_ewm_place": F.pmod(at, F.lit(size)).cast("double"), "_ewm_at": at})
    work = work.withColumns({f"_ewm_{s.out}_x": F.col(s.x).cast("double") for s in stats})
    last = F.coalesce(F.lead("_ewm_block").over(line) != F.col("_ewm_block"), F.lit(True))
    seen = {f"_ewm_{s.out}_n": F.count(f"_ewm_{s.out}_x").over(line.rowsBetween(Window.unboundedPreceding, 0)) for s in stats}
    work = work.withColumns({"_ewm_last": last, **seen})
    work = work.withColumns({f"_ewm_{s.out}_f": F.first(f"_ewm_{s.out}_x", ignorenulls=True).over(so_far) for s in stats})
    work = work.withColumns({f"_ewm_{s.out}_s": own_moments(s, place, so_far) for s in stats})
    work = work.withColumns({f"_ewm_{s.out}_o": as_state(s, F.col(f"_ewm_{s.out}_s"), F.col(f"_ewm_{s.out}_f"), place) for s in stats})

    def carry(frame: DataFrame, source: str, target: str) -> DataFrame:
        """``target``: the last of the states ``source`` at the end of a block with values before this row, merged with the row's own."""
        ends = {f"_ewm_{s.out}_t": F.when(F.col("_ewm_last") & F.col(f"_ewm_{s.out}_o").isNotNull(), F.struct(F.col("_ewm_at").alias("at"), F.col(f"_ewm_{s.out}_{source}").alias("state"))) for s in stats}
        frame = frame.withColumns(ends)
        frame = frame.withColumns({f"_ewm_{s.out}_b": F.last(f"_ewm_{s.out}_t", ignorenulls=True).over(before) for s in stats})
        col = {s.out: (F.col(f"_ewm_{s.out}_b"), F.col(f"_ewm_{s.out}_o")) for s in stats}
        frame = frame.withColumns({f"_ewm_{s.out}_w": shares(s, *col[s.out], F.col("_ewm_at") - F.col(f"_ewm_{s.out}_b.at")) for s in stats})
        return frame.withColumns({f"_ewm_{s.out}_{target}": merged(s, *col[s.out], F.col(f"_ewm_{s.out}_w")) for s in stats})

    # The state at the end of a block is made of the block and, decayed, the one with values before it.
    work = carry(carry(work, "o", "e"), "e", "r")
    return work.select(*kept, *[F.when(F.col(f"_ewm_{s.out}_n") >= s.least, value(s, F.col(f"_ewm_{s.out}_r"))).alias(s.out) for s in stats])
