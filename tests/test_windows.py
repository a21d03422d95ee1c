"""Window builders against pandas."""

import numpy as np
import pandas as pd
import pytest

from helpers import panel
from tickloom.functions.ewm import Ewm, ewm
from tickloom.functions.rolling import Roll, rolling

RNG = np.random.default_rng(5)
X = np.where(RNG.random(400) < 0.1, np.nan, RNG.normal(size=400) * 0.01 + 50)
X[150:200] = 42.0


@pytest.fixture(scope="module")
def frame(spark):
    y = np.cumsum(RNG.normal(size=400))
    vals = [None if np.isnan(v) else float(v) for v in X]
    return panel(spark, {"A": [100.0] * 400}, x={"A": vals}, y={"A": [float(v) for v in y]}), pd.Series(y)


def series(df, col):
    return df.orderBy("ts").select(col).toPandas()[col].astype(float).reset_index(drop=True)


def close(a, b, tol=1e-9):
    np.testing.assert_array_equal(a.isna(), b.isna())
    np.testing.assert_allclose(a.dropna(), b.dropna(), rtol=tol, atol=1e-10)


def test_rolling_moments(frame):
    df, y = frame
    x = pd.Series(X)
    specs = {
        "a": (Roll("a", "avg", "x", 30, 10), x.rolling(30, min_periods=10).mean()),
        "s": (Roll("s", "std", "x", 30, 10, 1), x.rolling(30, min_periods=10).std().shift(1)),
        "p": (Roll("p", "pstd", "x", 20), x.rolling(20).std(ddof=0)),
        "t": (Roll("t", "sum", "x", 25, 5), x.rolling(25, min_periods=5).sum()),
        "c": (Roll("c", "cov", "x", 60, 30, y="y"), x.rolling(60, min_periods=30).cov(y)),
    }
    out = rolling(df, [s for s, _ in specs.values()])
    for name, (_, want) in specs.items():
        close(series(out, name), want, 1e-7)


def test_constant_frame_has_exactly_zero_deviation(frame):
    out = series(rolling(frame[0], [Roll("s", "std", "x", 20, 20)]), "s")
    assert (out[170:200] == 0.0).all()


def test_ewm(frame):
    df, _ = frame
    x = pd.Series(X)
    out = ewm(df, [Ewm("m", "mean", "x", halflife=20, min_periods=20), Ewm("s", "std", "x", halflife=20, min_periods=20)])
    close(series(out, "m"), x.ewm(halflife=20, min_periods=20).mean())
    close(series(out, "s"), x.ewm(halflife=20, min_periods=20).std(), 1e-4)


def test_ewm_of_a_long_series_with_a_gap(spark):
    rng = np.random.default_rng(3)
    x = pd.Series(np.cumsum(rng.normal(size=50_000)) + 100)
    x[20_000:20_600] = np.nan
    df = spark.createDataFrame([("A", i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)], "symbol string, pos long, x double")
    out = ewm(df, [Ewm("m", "mean", "x", span=8, min_periods=3), Ewm("s", "std", "x", halflife=20, min_periods=20)])
    got = out.orderBy("pos").toPandas()
    np.testing.assert_allclose(got["s"], x.ewm(halflife=20, min_periods=20).std(), rtol=1e-6)
    filled = got["m"].notna()
    np.testing.assert_allclose(got["m"][filled], x.ewm(span=8, min_periods=3).mean()[filled], rtol=1e-9)
    assert filled[2:20_300].all() and filled[20_600:].all()


def test_one_wild_value_does_not_spoil_later_frames(spark):
    rng = np.random.default_rng(4)
    x = 100 + rng.normal(0, 0.01, 1000) + np.arange(1000) * 0.001
    x[10] = 1e9
    df = spark.createDataFrame([("A", i, float(v)) for i, v in enumerate(x)], "symbol string, ts long, x double")
    got = series(rolling(df, [Roll("s", "std", "x", 63, 63)]), "s")
    np.testing.assert_allclose(got[100:], pd.Series(x).rolling(63).apply(lambda w: np.std(w, ddof=1))[100:], rtol=1e-9)
