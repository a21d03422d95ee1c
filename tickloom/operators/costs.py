"""Trading and holding costs as column expressions."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import col, div

BARS_PER_YEAR = 252.0


@dataclass(frozen=True)
class CostParams:
    """Cost parameters in basis points (borrow per year, fixed in currency)."""

    commission_bps: float = 4.0
    exchange_fee_bps: float = 0.6
    half_spread_bps: float = 3.0
    impact_coef_bps: float = 10.0
    impact_exponent: float = 0.5
    borrow_bps_yr: float = 300.0
    fixed_per_trade: float = 0.0

    def scaled(self, m: float) -> CostParams:
        """All cost levels times ``m``; the exponent is a shape, so it stays."""
        values = {k: v * m for k, v in asdict(self).items() if k != "impact_exponent"}
        return replace(self, **values)


# The cost presets per market.
PRESETS = {
    "equity": CostParams(4.0, 0.6, 3.0, 10.0, 0.5, 300.0, 0.0),
    "futures": CostParams(0.8, 0.5, 1.5, 5.0, 0.5, 0.0, 0.0),
    "zero": CostParams(0.0, 0.0, 0.0, 0.0, 0.5, 0.0, 0.0),
}


def scenario_table(spark: SparkSession, scenarios: dict[str, CostParams]) -> DataFrame:
    """Scenarios as a dimension: one row per scenario, a driver-side list."""
    rows = [(name, *asdict(p).values()) for name, p in scenarios.items()]
    return spark.createDataFrame(rows, ["scenario", *asdict(CostParams())])


def trade_cost_columns(
    traded: Column | str,
    adv: Column | str | None = None,
    spread_bps: Column | str | None = None,
    params: CostParams | None = None,
) -> dict[str, Column]:
    """Commission, spread and impact in bps of the traded notional.

    Without ``params`` the parameters are read from columns of the same names
    (a joined scenario table), so scenarios are just another key.
    """

    def p(name: str) -> Column:
        return F.col(name) if params is None else F.lit(float(getattr(params, name)))

    t = F.abs(col(traded))
    moved = t > 0
    fixed = div(p("fixed_per_trade") * 1e4, t)
    commission = p("commission_bps") + p("exchange_fee_bps") + F.coalesce(fixed, F.lit(0.0))
    spread = p("half_spread_bps")
    if spread_bps is not None:
        spread = F.coalesce(col(spread_bps), spread)
    impact = F.lit(0.0)
    if adv is not None:
        a = col(adv)
        impact = F.when(
            a > 0, p("impact_coef_bps") * F.pow(div(t, a), p("impact_exponent"))
        ).otherwise(0.0)

    def only(x: Column) -> Column:
        return F.when(moved, x).otherwise(F.lit(0.0))

    return {"commission": only(commission), "spread": only(spread), "impact": only(impact)}


def borrow_bps(position: Column | str, params: CostParams | None = None) -> Column:
    yearly = F.col("borrow_bps_yr") if params is None else F.lit(float(params.borrow_bps_yr))
    return F.when(col(position) < 0, yearly / BARS_PER_YEAR).otherwise(F.lit(0.0))


def trailing_adv(value: Column | str = "value", n: int = 20) -> Column:
    """Lagged rolling mean of traded value."""
    from ..functions.window import roll

    return roll(F.avg, value, n, max(3, n // 3), 1)
