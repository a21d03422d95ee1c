"""Time-series and cross-section signal queries (TSS-*, XS-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import stats
from ...functions.scalar import rnd as R
from ...operators import carry
from ...operators import tsignal as T
from ...operators.xsection import fractile_weights
from .. import adapters as A
from . import sqlbase as S
from .registry import query

PANEL = S.with_(S.PANEL)
r = S.rnd
VOL63 = S.roll("stddev_pop", "ret", 63, 21, 1)


def with_vol(df, window: int = 63):
    return T.trailing_vol(df, window)


@query("TSS-01", PANEL + f" SELECT symbol, ts, {r('(' + VOL63 + ') * sqrt(252)')} AS vol FROM panel")
def trailing_vol(spark, sf):
    return T.trailing_vol(A.panel(spark, sf), 63, ann=252.0).select("symbol", "ts", R("vol").alias("vol"))


def null_mean_sql(parts):
    total = " + ".join(f"coalesce({p}, 0)" for p in parts)
    votes = " + ".join(f"CAST(({p}) IS NOT NULL AS INTEGER)" for p in parts)
    return f"({total}) / nullif(CAST({votes} AS DOUBLE), 0)"


SIGN_SQL = f"""
sg AS (SELECT *, {", ".join(f"sign({S.pct('tr', n)}) AS s{n}" for n in (21, 63, 252))} FROM panel),
sign_sig AS (SELECT *, {S.clip(null_mean_sql(["s21", "s63", "s252"]), -1, 1)} AS signal FROM sg)"""


@query("TSS-02", S.with_(S.PANEL, SIGN_SQL) + f" SELECT symbol, ts, {r('signal')} AS signal FROM sign_sig")
def sign_ensemble(spark, sf):
    return T.sign_ensemble(A.panel(spark, sf)).select("symbol", "ts", R("signal").alias("signal"))


def xover_sql() -> str:
    spans = sorted({s for p in T.XOVER_SPANS for s in p})
    e = ", ".join(f"{S.ewm('tr', f'(1 - 2.0::DOUBLE / {s + 1})', s)} AS e{s}" for s in spans)
    sc = S.roll("stddev_pop", "tr", 63, 31, 1)
    y = ", ".join(
        f"(e{f} - e{s}) / nullif(CASE WHEN scale > 1e-12 THEN scale END, 0) AS y{i}"
        for i, (f, s) in enumerate(T.XOVER_SPANS)
    )
    p = ", ".join(f"y{i} / nullif({S.roll('stddev_pop', f'y{i}', 252, 126, 1)}, 0) AS p{i}" for i in range(3))
    return f"""
xo0 AS (SELECT *, {e}, {sc} AS scale FROM panel),
xo1 AS (SELECT *, {y} FROM xo0),
xo2 AS (SELECT *, {p} FROM xo1),
xover AS (SELECT symbol, sector, ts, in_universe, ret, {S.clip(null_mean_sql(["p0", "p1", "p2"]), -1, 1)} AS signal FROM xo2)"""


@query("TSS-03", S.with_(S.PANEL, xover_sql()) + f" SELECT symbol, ts, {r('signal', 5)} AS signal FROM xover")
def crossover(spark, sf):
    return T.crossover_ensemble(A.panel(spark, sf)).select("symbol", "ts", R("signal", 5).alias("signal"))


def channel_part(n):
    hi, lo = S.roll("max", "tr", n, n // 2, 1), S.roll("min", "tr", n, n // 2, 1)
    return S.clip(f"2 * (tr - ({lo})) / nullif(({hi}) - ({lo}), 0) - 1", -1, 1)


@query(
    "TSS-04",
    PANEL
    + f""", c AS (SELECT *, {", ".join(f"{channel_part(n)} AS c{n}" for n in (21, 63, 252))} FROM panel)
SELECT symbol, ts, {r(null_mean_sql(["c21", "c63", "c252"]))} AS signal FROM c""",
)
def channel(spark, sf):
    return T.channel_ensemble(A.panel(spark, sf)).select("symbol", "ts", R("signal").alias("signal"))


@query(
    "TSS-05", PANEL + f" SELECT symbol, ts, {r('product(1 + coalesce(ret, 0)) ' + S.over())} AS px FROM panel"
)
def rebuilt_price(spark, sf):
    return A.panel(spark, sf).select("symbol", "ts", R(T.price_from_returns()).alias("px"))


def to_weights_sql(
    name, src, target, group_cap=None, max_gross=None, group="sector", vol="vol", max_asset=1.0, ann=252
):
    """CTEs from ``src(symbol, sector, ts, in_universe, signal, vol)`` to ``name(.., w)``."""
    x = f"signal * ({target} / CASE WHEN {vol} * sqrt({ann}) > 1e-12 THEN {vol} * sqrt({ann}) END)"
    sql = f"""
{name}0 AS (SELECT *, CASE WHEN in_universe THEN {S.clip(f"coalesce({x}, 0)", -max_asset, max_asset)} ELSE 0 END AS w FROM {src})"""
    last = f"{name}0"
    for i, (cap, keys) in enumerate(((group_cap, f"ts, {group}"), (max_gross, "ts")), 1):
        if cap is None:
            continue
        sql += f""",
{name}{i} AS (SELECT * EXCLUDE (w), w * CASE WHEN sum(abs(w)) OVER (PARTITION BY {keys}) > 1e-12
  THEN least(1, {cap} / sum(abs(w)) OVER (PARTITION BY {keys})) ELSE 1 END AS w FROM {last})"""
        last = f"{name}{i}"
    return sql + f",\n{name} AS (SELECT * FROM {last})"


@query(
    "TSS-06",
    S.with_(S.PANEL, SIGN_SQL, f"sv AS (SELECT *, {VOL63} AS vol FROM sign_sig)", to_weights_sql("tw", "sv", 0.15, 0.4, 1.5))
    + f" SELECT symbol, ts, {r('w')} AS w FROM tw",
)
def signal_to_weights(spark, sf):
    p = with_vol(T.sign_ensemble(A.panel(spark, sf)))
    w = T.to_weights(p, 0.15, group="sector", group_cap=0.4, max_gross=1.5)
    return w.select("symbol", "ts", R("w").alias("w"))


@query(
    "TSS-07",
    PANEL + f" SELECT symbol, ts, {r(S.shift('tr', 21) + ' / nullif(' + S.shift('tr', 252) + ', 0) - 1', 8)} AS mom FROM panel",
)
def skip_month(spark, sf):
    return A.panel(spark, sf).select("symbol", "ts", R(T.skip_return("tr", 252, 21), 8).alias("mom"))


@query(
    "XS-01",
    PANEL
    + f""", x AS (SELECT *, CASE WHEN in_universe THEN ret END AS m FROM panel)
SELECT symbol, ts, {r("CASE WHEN count(m) OVER w >= 3 THEN " + S.clip("(m - avg(m) OVER w) / nullif(stddev_pop(m) OVER w, 0)", -3, 3) + " END")} AS z
FROM x WINDOW w AS (PARTITION BY ts)""",
)
def section_zscore(spark, sf):
    m = F.when(F.col("in_universe"), F.col("ret"))
    return A.panel(spark, sf).withColumn("m", m).select("symbol", "ts", R(stats.xs_zscore("m")).alias("z"))


@query(
    "XS-02",
    PANEL
    + f""", x AS (SELECT *, CASE WHEN in_universe THEN round(ret, 4) END AS m FROM panel)
SELECT symbol, ts, {r("CASE WHEN m IS NOT NULL THEN (rank() OVER (PARTITION BY ts, m IS NULL ORDER BY m) + (count(*) OVER (PARTITION BY ts, m) - 1) / 2.0::DOUBLE) / count(m) OVER (PARTITION BY ts) END")} AS pct FROM x""",
)
def masked_rank(spark, sf):
    p = A.panel(spark, sf).withColumn("m", F.when(F.col("in_universe"), R("ret", 4))).repartition("ts")
    return p.select("symbol", "ts", R(stats.xs_rank("m", pct=True)).alias("pct"))


MOM = """
ms AS (SELECT *, lag(tr, 21) OVER (PARTITION BY symbol ORDER BY ts) / nullif(lag(tr, 252) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS signal FROM panel)"""


@query(
    "XS-03",
    S.with_(S.PANEL, S.rebalance(), MOM, S.xs_weights("x", "ms", 0.34, 0.34, False, sector_neutral=True, min_names=3))
    + f" SELECT symbol, ts, {r('w', 8)} AS w FROM x",
)
def fractiles_in_sectors(spark, sf):
    p = A.panel(spark, sf).withColumn("signal", T.skip_return("tr", 252, 21))
    w = fractile_weights(p, 0.34, 0.34, False, sector_neutral=True, min_names=3)
    return w.select("symbol", "ts", R("w", 8).alias("w"))


@query(
    "XS-04",
    S.with_(
        S.PANEL, S.rebalance(), MOM, f"mv AS (SELECT *, {VOL63} AS vol FROM ms)",
        S.xs_weights("a", "mv", 0.3, 0.3, False, weighting="inverse_vol"),
        S.xs_weights("b", "mv", 0.3, 0.3, True, weighting="signal"),
    )
    + f" SELECT symbol, ts, {r('a.w', 8)} AS w_inverse_vol, {r('b.w', 8)} AS w_signal FROM a JOIN b USING (symbol, ts)",
)
def leg_weighting(spark, sf):
    p = with_vol(A.panel(spark, sf).withColumn("signal", T.skip_return("tr", 252, 21)))
    a = fractile_weights(p, 0.3, 0.3, False, weighting="inverse_vol").select("symbol", "ts", R("w", 8).alias("w_inverse_vol"))
    b = fractile_weights(p, 0.3, 0.3, True, weighting="signal").select("symbol", "ts", R("w", 8).alias("w_signal"))
    return a.join(b, ["symbol", "ts"])


@query(
    "XS-05",
    S.with_(S.PANEL, S.rebalance("rebal", "QE"), MOM, S.xs_weights("x", "ms", 0.2, 0.2, True))
    + f" SELECT symbol, ts, {r('w', 8)} AS w FROM x",
)
def held_between_rebalances(spark, sf):
    p = A.panel(spark, sf).withColumn("signal", T.skip_return("tr", 252, 21))
    w = fractile_weights(p, 0.2, 0.2, True, freq="QE")
    return w.select("symbol", "ts", R("w", 8).alias("w"))


XS_CARRY = S.clip(
    "(basis - avg(basis) OVER (PARTITION BY ts)) / nullif(stddev_samp(basis) OVER (PARTITION BY ts), 0)", -2, 2
)


@query("XS-06", S.with_(S.PANEL, S.BASIS) + f" SELECT symbol, ts, {r(XS_CARRY)} AS z FROM basis")
def carry_section(spark, sf):
    return A.basis(spark, sf).select("symbol", "ts", R(carry.carry_xs("basis")).alias("z"))
