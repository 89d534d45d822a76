"""Operators against pandas definitions written from scratch, on small panels with gaps, ties and constants."""

import math

import numpy as np
import pandas as pd
import pytest

from panelforge.functions.dag import compute, plan
from panelforge.functions.features import FEATURES
from panelforge.functions.ops import (
    col, correlation, covariance, cs_mean, decay_linear, delay, fwd_sum, indneutralize, maxn, minn, parity, product, rank, scale, signedpower, stddev, ts_argmax,
    ts_argmin, ts_max, ts_min, ts_rank, ts_sum,
)
from panelforge.plans.formulas import FORMULAS, PAPER, SINGLE_LEG

DAYS, NAMES = 30, 6


@pytest.fixture(scope="module")
def wide():
    rng = np.random.default_rng(3)
    out = {}
    for c in "xy":
        m = np.round(rng.normal(10, 2, (DAYS, NAMES)), 1)
        m[rng.random((DAYS, NAMES)) < 0.1] = np.nan
        out[c] = m
    out["x"][:, 4] = 7.0
    out["x"][12, :] = np.nan
    out["x"][5, :3] = 8.0
    return {k: pd.DataFrame(v) for k, v in out.items()}


@pytest.fixture(scope="module")
def panel(spark, wide):
    rows = [(d, t, *[None if math.isnan(v) else float(v) for v in (wide["x"].iat[d, t], wide["y"].iat[d, t])], float(t % 2) if t < 5 else None) for d in range(DAYS) for t in range(NAMES)]
    return spark.createDataFrame(rows, "date int, ticker int, x double, y double, g double").cache()


def got(panel, node):
    rows = compute(panel, {"v": node}).collect()
    out = np.full((DAYS, NAMES), np.nan)
    for r in rows:
        out[r.date, r.ticker] = np.nan if r.v is None else r.v
    return out


X, Y, G = col("x"), col("y"), col("g")


def roll(df, w, f):
    return df.rolling(w).apply(f, raw=True).to_numpy()


CASES = {
    "sum": (ts_sum(X, 5), lambda x, y: x.rolling(5).sum().to_numpy()),
    "std": (stddev(X, 4), lambda x, y: x.rolling(4).std().to_numpy()),
    "min": (ts_min(X, 4), lambda x, y: x.rolling(4).min().to_numpy()),
    "max": (ts_max(X, 4), lambda x, y: x.rolling(4).max().to_numpy()),
    "argmax": (ts_argmax(X, 5), lambda x, y: roll(x, 5, np.argmax)),
    "argmin": (ts_argmin(X, 5), lambda x, y: roll(x, 5, np.argmin)),
    "ts_rank": (ts_rank(X, 5), lambda x, y: roll(x, 5, lambda a: (a <= a[-1]).mean())),
    "product": (product(X, 3), lambda x, y: roll(x, 3, np.prod)),
    "decay": (decay_linear(X, 4), lambda x, y: roll(x, 4, lambda a: (a * np.arange(4, 0, -1)).sum() / 10)),
    "cov": (covariance(X, Y, 5), lambda x, y: x.rolling(5).cov(y).to_numpy()),
    "rank": (rank(X), lambda x, y: x.rank(axis=1, pct=True).to_numpy()),
    "scale": (scale(X), lambda x, y: x.div(x.abs().sum(axis=1).replace(0, np.nan), axis=0).to_numpy()),
    "delay": (delay(X, 2), lambda x, y: x.shift(2).to_numpy()),
    "forward": (fwd_sum(X, 3), lambda x, y: x[::-1].rolling(3).sum()[::-1].shift(-1).to_numpy()),
    "neutral": (indneutralize(X, G), lambda x, y: pd.DataFrame(x.T.groupby([0, 1, 0, 1, 0, np.nan]).transform(lambda s: s - s.mean()).T, columns=range(NAMES)).to_numpy()),
}


@pytest.mark.parametrize("name", CASES)
def test_against_pandas(panel, wide, name):
    node, want = CASES[name]
    np.testing.assert_allclose(got(panel, node), want(wide["x"], wide["y"]), atol=1e-9)


def test_correlation_of_constant_window_is_null(panel, wide):
    with np.errstate(all="ignore"):
        want = wide["x"].rolling(5).corr(wide["y"]).to_numpy()
    want[:, 4] = np.nan
    want[~np.isfinite(want)] = np.nan
    np.testing.assert_allclose(got(panel, correlation(X, Y, 5)), want, atol=1e-7)


def test_missing_values_in_comparisons_and_powers(panel, wide):
    x, y = wide["x"].to_numpy(), wide["y"].to_numpy()
    np.testing.assert_allclose(got(panel, maxn(X, Y)), np.maximum(x, y))
    np.testing.assert_allclose(got(panel, minn(X, Y)), np.minimum(x, y))
    np.testing.assert_allclose(got(panel, (X * 0 + 1) ** (Y / 0)), np.where(np.isnan(x), np.nan, 1.0))
    np.testing.assert_allclose(got(panel, signedpower(X, 0.5)), np.sign(x) * np.abs(x) ** 0.5)
    assert set(np.unique(got(panel, parity(X))[~np.isnan(got(panel, parity(X)))])) <= {-1.0, 1.0}


def test_equal_expressions_are_one_node():
    assert ts_sum(rank(X), 5) is ts_sum(rank(X), 5)
    assert sum(len(s.windows) for s in plan([rank(ts_sum(X, 5)), rank(ts_sum(X, 5)) + 1])) == 2


def test_library_needs_few_waves():
    waves = {s.wave for s in plan(list(FORMULAS.values()))}
    assert len(FORMULAS) == 101 and max(waves) <= 12 and len(SINGLE_LEG) == 96 and 47 in PAPER


def test_look_ahead(spark, panel, wide):
    """Rows after t do not change a formula at t."""
    from pyspark.sql import functions as F

    node = rank(correlation(X, Y, 4)) + decay_linear(X, 3) + cs_mean(Y)
    cut = 20
    bumped = panel.withColumn("x", F.when(F.col("date") > cut, F.col("x") * 3 + 1).otherwise(F.col("x")))
    np.testing.assert_allclose(got(panel, node)[: cut + 1], got(bumped, node)[: cut + 1])


def test_feature_count():
    assert len(FEATURES) == 24
