"""Mergeable sliding windows and the carried exponential scan, against plain frames and pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions.ewm import Ewm, ewm
from tickloom.functions.rolling import Roll, direct, rolling

SCHEMA = "symbol string, ts long, pos long, x double, y double"


def series(spark, x, y=None, symbol="A"):
    rows = [(symbol, i, i, None if np.isnan(v) else float(v), None if y is None or np.isnan(y[i]) else float(y[i])) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, SCHEMA)


def values(df, *names):
    got = df.orderBy("symbol", "ts").toPandas()
    return [got[n].astype(float).to_numpy() for n in names]


@pytest.mark.parametrize("n,lag", [(13, 0), (50, 1), (64, 7), (300, 21)])
def test_merged_frames_equal_direct_frames(spark, n, lag):
    rng = np.random.default_rng(n)
    x, y = (np.where(rng.random(700) < 0.15, np.nan, rng.normal(size=700) * 0.02 + 5) for _ in range(2))
    df = series(spark, x, y).union(series(spark, x[:90], y[:90], "B"))
    specs = [Roll(f"{fn}_{n}", fn, "x", n, 5, lag, "y" if fn in ("cov", "pcov", "corr", "slope") else None)
             for fn in ("sum", "avg", "std", "pstd", "var", "pvar", "min", "max", "product", "cov", "pcov", "corr", "slope")]
    names = [s.out for s in specs]
    fast = values(rolling(df, specs), *names)
    slow = values(df.select("symbol", "ts", *[direct(s, ("symbol",), "ts").alias(s.out) for s in specs]), *names)
    for name, a, b in zip(names, fast, slow, strict=True):
        np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-14, err_msg=name)


def test_a_wild_value_is_gone_with_its_last_frame(spark):
    rng = np.random.default_rng(4)
    x = 100 + rng.normal(0, 0.01, 1500)
    x[310] = 1e9
    y = rng.normal(size=1500)
    got = values(rolling(series(spark, x, y), [Roll("s", "std", "x", 252, 252), Roll("c", "cov", "x", 252, 252, y="y")]), "s", "c")
    want = pd.Series(x).rolling(252).apply(lambda w: np.std(w, ddof=1))
    np.testing.assert_allclose(got[0][570:], want[570:], rtol=1e-9)
    direct_cov = [np.cov(x[i - 251 : i + 1], y[i - 251 : i + 1])[0, 1] for i in range(570, 1500)]
    np.testing.assert_allclose(got[1][570:], direct_cov, rtol=1e-7, atol=1e-12)


def test_a_series_that_does_not_move_has_no_deviation(spark):
    x = np.full(400, 0.1)
    got = values(rolling(series(spark, x, x), [Roll("s", "pstd", "x", 63, 5), Roll("k", "corr", "x", 63, 5, y="y")]), "s", "k")
    assert (got[0][4:] == 0.0).all() and np.isnan(got[1]).all()


def test_the_plan_has_one_shuffle_and_two_sorts_for_a_frame_length(spark, capsys):
    df = series(spark, np.arange(50.0), np.arange(50.0))
    rolling(df, [Roll("a", "avg", "x", 20), Roll("b", "cov", "x", 20, y="y", lag=1), Roll("c", "max", "x", 30)]).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") <= 6


def test_ewm_carries_over_any_gap(spark):
    rng = np.random.default_rng(3)
    x = pd.Series(np.cumsum(rng.normal(size=50_000)) + 100)
    x[20_000:25_000] = np.nan
    x[:7] = np.nan
    stats = [Ewm("m8", "mean", "x", span=8, min_periods=3), Ewm("m96", "mean", "x", span=96, min_periods=96), Ewm("s20", "std", "x", halflife=20, min_periods=20)]
    m8, m96, s20 = values(ewm(series(spark, x), stats), "m8", "m96", "s20")
    np.testing.assert_allclose(m8, x.ewm(span=8, min_periods=3).mean(), rtol=1e-9)
    np.testing.assert_allclose(m96, x.ewm(span=96, min_periods=96).mean(), rtol=1e-9)
    want = x.ewm(halflife=20, min_periods=20).std()
    known = want.notna()
    np.testing.assert_allclose(s20[known], want[known], rtol=1e-7)


def test_ewm_std_of_values_far_from_zero(spark):
    rng = np.random.default_rng(9)
    x = pd.Series(1e6 + rng.normal(size=3000) * 1e-3)
    got = values(ewm(series(spark, x), [Ewm("s", "std", "x", halflife=10, min_periods=5)]), "s")[0]
    np.testing.assert_allclose(got[4:], x.ewm(halflife=10, min_periods=5).std()[4:], rtol=1e-4)


def test_ewm_of_many_spans_sorts_once(spark, capsys):
    df = series(spark, np.arange(50.0))
    ewm(df, [Ewm(f"e{s}", "mean", "x", span=s) for s in (8, 16, 24, 32, 48, 96)]).explain()
    plan = capsys.readouterr().out
    assert plan.count("Sort [") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_unknown_statistics_are_refused():
    with pytest.raises(ValueError):
        Roll("a", "mode", "x", 5)
    with pytest.raises(ValueError):
        Ewm("a", "skew", "x", span=3)


def test_other_columns_are_kept(spark):
    df = series(spark, np.arange(40.0)).withColumns({"a.b": F.lit(1), "_rn": F.lit(7), "_block": F.lit(8), "_last": F.lit(9), "_at": F.lit(10)})
    out = ewm(rolling(df, [Roll("x2", "avg", "x", 20)]), [Ewm("e", "mean", "x", span=4)])
    assert out.columns == [*df.columns, "x2", "e"] and out.count() == 40
    assert [tuple(r) for r in out.select("_rn", "_block", "_last", "_at").distinct().collect()] == [(7, 8, 9, 10)]
