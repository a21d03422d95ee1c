"""Small series whose answers are known in closed form."""

import datetime as dt
import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from helpers import daily, days, panel
from tickloom.functions.scalar import rnd
from tickloom.operators import accounting, adjust, costs, futures, metrics, outcomes, risk, sessions
from tickloom.operators.align import asof_backward, keep_last

ZERO = costs.PRESETS["zero"]


def test_constant_drift_compounds(spark):
    p = panel(spark, {"A": [100 * 1.001**t for t in range(300)]}).withColumn("w", F.lit(1.0))
    book = accounting.run_book(p, ZERO)
    last = book.daily.orderBy(F.desc("ts")).first()
    assert last["equity"] == pytest.approx(1.001**299, rel=1e-12)


def test_known_drawdown(spark):
    moves = [0.0] + [0.001] * 100 + [-0.004] * 50 + [0.002] * 400
    px = [100.0]
    for r in moves[1:]:
        px.append(px[-1] * (1 + r))
    p = panel(spark, {"A": px}).withColumn("w", F.lit(1.0))
    d = accounting.run_book(p, ZERO, lag=0).daily
    worst = metrics.drawdown_episodes(d).orderBy("depth").first()
    assert worst["depth"] == pytest.approx(0.996**50 - 1, rel=1e-9)
    assert worst["start"] == days(551)[100]


def test_bounce_needs_the_right_lag(spark):
    px = [100 * (1 + (0.005 if t % 2 else -0.005)) for t in range(300)]
    p = panel(spark, {"A": px}).withColumn("w", -F.signum(F.coalesce("ret", F.lit(0.0))))
    s = {lag: metrics.return_stats(accounting.run_book(p, ZERO, lag).daily).first()["sharpe"] for lag in (1, 2)}
    assert s[1] > 3 and s[2] < 0.5


def test_double_commission_doubles_the_line(spark):
    p = panel(spark, {"A": [100 + t % 7 for t in range(60)]}).withColumn("w", F.when(F.col("pos") % 5 < 3, 0.5).otherwise(0.0))
    one = costs.CostParams(4, 0, 0, 0, 0.5, 0, 0)
    two = costs.CostParams(8, 0, 0, 0, 0.5, 0, 0)
    a, b = (accounting.run_book(p, c).daily.agg(F.sum("commission"), F.sum("net")).first() for c in (one, two))
    assert b[0] == pytest.approx(2 * a[0]) and b[1] < a[1]


def test_costed_positions_add_up_to_the_daily_costs(spark):
    p = panel(spark, {"A": [100 + t % 7 for t in range(60)], "B": [50 + t % 5 for t in range(60)]})
    p = p.withColumn("w", F.when(F.col("pos") % 5 < 3, 0.5).otherwise(-0.2)).withColumn("adv", F.lit(3.0))
    book = accounting.run_book(p, costs.CostParams(fixed_per_trade=0.001), nav=10.0)
    rows = book.costed().agg(F.sum(F.abs("dw") * F.col("cost_bps") / 1e4)).first()[0]
    day = book.daily.agg(F.sum(F.col("commission") + F.col("spread") + F.col("impact"))).first()[0]
    assert rows == pytest.approx(day, rel=1e-12)


def bars(spark, rows):
    data = [("A", t, i, *r, True) for i, (t, r) in enumerate(zip(days(len(rows)), rows))]
    return spark.createDataFrame(
        data, "symbol string, ts timestamp_ntz, pos long, open double, high double, low double, close double, in_universe boolean"
    )


def intent(spark, **kw):
    row = {"symbol": "A", "ts": days(1)[0], "pos": 0, "side": 1, "stop": 95.0, "take": 105.0, "time_stop": 10, "size": 0.01, "tag": "t"} | kw
    return spark.createDataFrame(
        [tuple(row.values())],
        "symbol string, ts timestamp_ntz, pos long, side long, stop double, take double, time_stop long, size double, tag string",
    )


def test_stop_comes_before_take(spark):
    b = bars(spark, [(100.0, 110.0, 90.0, 100.0)] * 5)
    t = outcomes.label(intent(spark), b).first()
    assert (t["reason"], t["exit_px"], t["exit_pos"]) == ("stop", 95.0, 2)


def test_gap_time_short_and_missing_bars(spark):
    flat = (100.0, 101.0, 99.0, 100.0)
    gap = bars(spark, [flat, flat, (90.0, 91.0, 89.0, 90.0), flat])
    assert outcomes.label(intent(spark), gap).first()["exit_px"] == 90.0
    none = (None, None, None, None)
    slow = bars(spark, [flat, flat, none, flat, flat, flat])
    t = outcomes.label(intent(spark, time_stop=2), slow).first()
    assert (t["reason"], t["exit_pos"], t["bars_held"]) == ("time", 4, 2)
    short = bars(spark, [flat, flat, (100.0, 106.0, 99.0, 104.0), flat])
    t = outcomes.label(intent(spark, side=-1, stop=105.0, take=90.0), short).first()
    assert (t["reason"], t["exit_px"]) == ("stop", 105.0) and t["ret"] == pytest.approx(-0.05)
    still = outcomes.label(intent(spark, time_stop=None, stop=None, take=None), bars(spark, [flat] * 4)).first()
    assert still["reason"] == "open" and still["exit_pos"] is None


def test_risk_sizing(spark):
    t = outcomes.label(intent(spark, stop=90.0), bars(spark, [(100.0, 101.0, 99.0, 100.0)] * 5))
    assert outcomes.sized(t, "risk_frac").first()["qty"] == pytest.approx(0.001)


def test_one_trade_at_a_time(spark):
    flat = (100.0, 101.0, 99.0, 100.0)
    signals = intent(spark, time_stop=3)
    for pos in (1, 3, 4):
        signals = signals.unionByName(intent(spark, ts=days(9)[pos], pos=pos, time_stop=3, tag=f"t{pos}"))
    kept = outcomes.one_at_a_time(outcomes.label(signals, bars(spark, [flat] * 9)))
    # Entered at bar 1, out at bar 4: the signal of bar 3 enters at bar 4.
    assert sorted(r["pos"] for r in kept.collect()) == [0, 3]


def test_month_table(spark):
    r = [((2020, 1, 2), 0.10), ((2020, 1, 3), -0.05), ((2020, 2, 4), None), ((2020, 3, 2), 0.02), ((2021, 5, 4), 0.03)]
    t = metrics.monthly_table(daily(spark, [(dt.datetime(*d), x) for d, x in r]))
    rows = {x["year"]: x for x in t.collect()}
    assert rows[2020]["m01"] == pytest.approx(0.045) and rows[2020]["m02"] is None
    assert rows[2020]["total"] == pytest.approx(1.10 * 0.95 * 1.02 - 1) and rows[2021]["m05"] == pytest.approx(0.03)


def test_drawdown_rows(spark):
    when = [dt.datetime(2020, 1, d) for d in (1, 2, 3, 6, 7)]
    e = daily(spark, list(zip(when, [1.0, 1.2, 0.9, 1.3, 1.1])), "equity")
    a, b = metrics.drawdown_episodes(e).orderBy("depth").collect()
    assert a["depth"] == pytest.approx(-0.25) and (a["start"], a["trough"], a["end"]) == (when[1], when[2], when[3])
    assert (a["duration"], a["recovery"], a["recovered"]) == (2, 1, True)
    assert b["depth"] == pytest.approx(1.1 / 1.3 - 1) and (b["start"], b["duration"], b["recovered"]) == (when[3], 1, False)


def test_trade_statistics_and_holding(spark):
    rows, t = [], days(20)
    for i, p in enumerate((0.10, -0.04, 0.02, -0.01)):
        rows += [("run", "A", t[2 * i], "entry", None), ("run", "A", t[2 * i + 4], "time", p)]
    trades = spark.createDataFrame(rows, "run_id string, symbol string, ts timestamp_ntz, reason string, pnl double")
    s = metrics.trade_stats(trades).first()
    assert s["n"] == 4 and s["win_rate"] == 0.5 and s["profit_factor"] == pytest.approx(2.4)
    assert (s["avg_win"], s["avg_loss"], s["expectancy"]) == pytest.approx((0.06, -0.025, 0.0175))
    assert metrics.average_hold(trades).first()["avg_hold_days"] == pytest.approx(4.0)


def test_in_and_out_of_sample_guards(spark):
    r = [0.001 * ((i * 7) % 11 - 4) for i in range(100)]
    x = metrics.is_oos(daily(spark, list(zip(days(100), r)))).first()

    def sh(v):
        m = sum(v) / len(v)
        return m / math.sqrt(sum((a - m) ** 2 for a in v) / (len(v) - 1)) * math.sqrt(252)

    assert x["sharpe_is"] == pytest.approx(sh(r[:70])) and x["sharpe_oos"] == pytest.approx(sh(r[70:]))
    few = metrics.is_oos(daily(spark, list(zip(days(5), r[:5])))).first()
    assert few["sharpe_is"] is None and few["sharpe_oos"] is None


def test_rolling_report_size(spark):
    r = [(t, 0.001 * ((i * 7) % 11 - 5)) for i, t in enumerate(days(300))]
    assert metrics.rolling_stats(daily(spark, r)).count() == 49
    assert metrics.rolling_stats(daily(spark, [(t, 0.001 * (i % 5)) for i, t in enumerate(days(5000))])).count() == 1500


def test_attribution_modes(spark):
    rows = [("run", "A", t, 0.5, 0.01, 0.5 if i == 0 else 0.0) for i, t in enumerate(days(4))]
    rows += [("run", "B", t, -0.25 if i < 2 else 0.0, 0.02, 0.0) for i, t in enumerate(days(4))]
    pos = spark.createDataFrame(rows, "run_id string, symbol string, ts timestamp_ntz, w double, r double, dw double")
    a = {x["symbol"]: x["pnl"] for x in metrics.attribution(pos).collect()}
    assert a["A"] == pytest.approx(0.02) and a["B"] == pytest.approx(-0.01)
    net = daily(spark, [(t, 0.001) for t in days(4)])
    b = {x["symbol"]: x["pnl"] for x in metrics.attribution(pos, None, net, "proxy").collect()}
    assert b["A"] == pytest.approx(0.001 * 2 / 3 * 2 + 0.002) and b["B"] == pytest.approx(0.001 / 3 * 2)


def test_piecewise_volatility(spark):
    px, v = [100.0], 0.005
    for t in range(120):
        px.append(px[-1] * (1 + (v if t % 2 else -v)))
    p = risk.ex_ante_vol(panel(spark, {"A": px}))
    assert p.orderBy(F.desc("ts")).first()["vol"] == pytest.approx(v * math.sqrt(252))


def test_split_scales_only_earlier_bars(spark):
    p = panel(spark, {"A": [100.0, 100.0, 50.0, 50.0]})
    s = spark.createDataFrame([("A", days(3)[2], 2.0)], "symbol string, ex_date timestamp_ntz, value double")
    out = [r["adj_close"] for r in adjust.split_adjust(p, s).orderBy("ts").collect()]
    assert out == [50.0, 50.0, 50.0, 50.0]


def test_open_interest_roll_needs_two_bars(spark):
    t = days(8)
    oi = {"F1": [9, 9, 5, 9, 5, 5, 5, 5], "F2": [1, 1, 8, 1, 8, 8, 8, 8]}
    rows = [(s, t[i], i, 10.0, float(x)) for s, v in oi.items() for i, x in enumerate(v)]
    b = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, pos long, close double, oi double")
    far = dt.date(2021, 1, 1)
    c = spark.createDataFrame([("F1", "F", far), ("F2", "F", dt.date(2021, 6, 1))], "symbol string, asset_code string, expiry date")
    held = [r["held"] for r in futures.held_by_activity(b, c).orderBy("pos").collect()]
    assert held == ["F1"] * 5 + ["F2"] * 3


def test_holiday_shift(spark):
    d = spark.createDataFrame([("2022-01-03",), ("2021-05-03",), ("2021-05-10",), ("2022-03-01",), ("2022-06-14",)], "d string")
    got = [r[0] for r in d.select(sessions.is_trading_day(F.col("d"))).collect()]
    # May 1st 2021 is a Saturday and May 9th a Sunday: both Mondays are off.
    assert got == [False, False, False, False, True]


def test_asof_crosses_buckets(spark):
    left = spark.createDataFrame([("k", dt.datetime(2020, 1, 5)), ("k", dt.datetime(2020, 4, 1))], "symbol string, ts timestamp_ntz")
    right = spark.createDataFrame(
        [("k", dt.datetime(2020, 1, 5), 1.0), ("k", dt.datetime(2020, 2, 9), 2.0)], "symbol string, ts timestamp_ntz, v double"
    )
    out = asof_backward(left, right, ["symbol"], "v", "v").orderBy("ts").collect()
    assert [r["v"] for r in out] == [1.0, 2.0]


def test_keep_last(spark):
    d = spark.createDataFrame([("a", 1, 1.0), ("a", 2, None), ("b", 1, 3.0)], "k string, seq int, v double")
    assert {r["k"]: r["v"] for r in keep_last(d, ["k"], "seq").collect()} == {"a": None, "b": 3.0}


def test_rounding_keeps_values_beyond_a_long(spark):
    cases = [(2.6146441874062735e57, 2.6146441874062735e57), (-1.0e40, -1.0e40), (1.2e14, 1.2e14), (1.0e306, 1.0e306), (2.0**52 + 1, 2.0**52 + 1), (0.125, 0.13), (-0.125, -0.13), (0.49, 0.49)]
    got = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, x double").select("i", rnd("x", 2).alias("y")).orderBy("i").collect()
    assert [r["y"] for r in got] == [pytest.approx(want, rel=1e-15) for _, want in cases]
    assert rnd_of(spark, float("inf")) == float("inf") and rnd_of(spark, None) is None and math.copysign(1, rnd_of(spark, -0.0001)) == 1


def rnd_of(spark, x):
    return spark.createDataFrame([(x,)], "x double").select(rnd("x", 2).alias("y")).first()["y"]


def test_total_return_index_of_heavy_dividends(spark):
    """ADJ-02: an index that multiplies past 2**63 / 10**5 is reported as it is."""
    p = panel(spark, {"A": [100.0] * 120}).withColumn("adj_close", F.col("close"))
    paid = spark.createDataFrame([("A", d.date(), 100.0) for d in days(120)[1:]], "symbol string, ex_date date, value double")
    out = adjust.total_return(p.drop("tr"), paid, p.select("pos", "ts")).select("pos", rnd("tr", 5).alias("tr"))
    tr = {r["pos"]: r["tr"] for r in out.collect()}
    assert all(tr[i] == pytest.approx(100 * 2.0**i, rel=1e-9) for i in range(120))


def test_total_return_index_of_many_bars(spark):
    """PAN-01, ADJ-02: the index of 2,500 heavy dividends is exact to a few units in the 14th digit."""
    n = 2500
    paid = [0.0] + [2.0 + 9.0 * (i * 7919 % 1000) / 1000 for i in range(1, n)]
    p = panel(spark, {"A": [100.0] * n}).withColumn("adj_close", F.col("close"))
    divs = spark.createDataFrame([("A", d.date(), paid[i]) for i, d in enumerate(days(n)) if i], "symbol string, ex_date date, value double")
    out = adjust.total_return(p.drop("tr"), divs, p.select("pos", "ts")).select("pos", "tr")
    want, product = [], Fraction(100)
    for x in paid:
        product *= (100 + Fraction(x)) / 100
        want.append(float(product))
    assert want[-1] > 1e60
    tr = {r["pos"]: r["tr"] for r in out.collect()}
    assert max(abs(tr[i] / want[i] - 1) for i in range(n)) < 3e-14


def test_total_return_index_keeps_bad_ticks(spark):
    p = spark.createDataFrame([("A", i, float(x)) for i, x in enumerate([10, 20, "inf", 20])] + [("B", i, float(x)) for i, x in enumerate([10, 20, "nan", 20])], "symbol string, pos long, adj_close double")
    p = p.withColumn("ts", F.timestamp_seconds(F.col("pos") * 86400))
    none = spark.createDataFrame([], "symbol string, ex_date date, value double")
    out = adjust.total_return(p, none, p.where("symbol = 'A'").select("pos", "ts")).collect()
    tr = {(r["symbol"], r["pos"]): r["tr"] for r in out}
    assert [tr["A", i] for i in range(2)] == pytest.approx([10.0, 20.0]) and tr["A", 2] == math.inf
    assert tr["B", 1] == pytest.approx(20.0) and math.isnan(tr["B", 2]) and math.isnan(tr["B", 3])
