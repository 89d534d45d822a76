"""Rank matrices, distributions as expressions, regime legs, holdout backtests and clock chunks against plain definitions."""

import datetime as dt
import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from panelforge.functions.dag import DUCK, SPARK
from panelforge.functions.distributions import partial_autocorrelations, t_quantile95, t_tail
from panelforge.operators import statistics
from panelforge.operators.grams import correlations
from panelforge.operators.models import partial_correlations, t_cdf
from panelforge.operators.statistics import Legs, as_of, holdout_returns, regime_legs, spearman_pairs, split_by_clock

DAY = dt.date(2021, 1, 4)


def table(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"a": rng.integers(0, 9, n).astype(float), "b": rng.normal(size=n), "c": rng.normal(size=n), "d": np.zeros(n)})
    pdf["b"] += 0.3 * pdf["a"]
    for c in "abc":
        pdf.loc[rng.random(n) < 0.2, c] = np.nan
    rows = [tuple(None if math.isnan(x) else float(x) for x in r) for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, "a double, b double, c double, d double"), pdf


@pytest.mark.parametrize("parts", [4, 256])
def test_rank_correlations_of_pairs(spark, monkeypatch, parts):
    monkeypatch.setattr(statistics, "PARTS", parts)
    df, pdf = table(spark)
    found = {(r.a, r.b): (r.n, r.rho) for r in spearman_pairs(df, ("a", "b", "c", "d")).collect()}
    assert set(found) == {("a", "b"), ("a", "c"), ("b", "c"), ("a", "d"), ("b", "d"), ("c", "d")}
    for (x, y), (n, rho) in found.items():
        both = pdf[[x, y]].dropna()
        assert n == len(both)
        if y == "d":
            assert rho is None
        else:
            assert rho == pytest.approx(both[x].rank().corr(both[y].rank()), abs=1e-12)
    assert spearman_pairs(df.limit(0), ("a", "b")).collect() == []


def test_correlations_by_groups(spark):
    from pyspark.sql import functions as F

    df, pdf = table(spark)
    by = df.withColumn("g", (F.coalesce("c", F.lit(0.0)) > 0).cast("int"))
    group = (pdf["c"].fillna(0) > 0).astype(int)
    found = {(r.g, r.a, r.b): (r.n, r["corr"]) for r in correlations(by, "g", ("a", "b", "d")).collect()}
    assert len(found) == 6
    for (g, x, y), (n, rho) in found.items():
        both = pdf.loc[group == g, [x, y]].dropna()
        assert n == len(both) and (rho is None if y == "d" else rho == pytest.approx(both[x].corr(both[y]), abs=1e-12))


@pytest.mark.parametrize("df", [1, 2, 5, 30, 356, 5000])
def test_student_t_as_expression(spark, df):
    ts = [0.0, 0.01, 0.5, -0.5, 1.6449, 2.5, -3.0, 8.0, 40.0]
    rows = spark.createDataFrame([(t, float(df)) for t in ts], "t double, df double")
    mine = [r[0] for r in rows.selectExpr(t_tail(SPARK, "t", "df")).collect()]
    theirs = [duckdb.sql(f"SELECT {t_tail(DUCK, 't', 'df')} FROM (SELECT CAST({t} AS DOUBLE) AS t, CAST({df} AS DOUBLE) AS df)").fetchall()[0][0] for t in ts]
    want = [1 - t_cdf(t, df) for t in ts]
    np.testing.assert_allclose(mine, want, atol=1e-9)
    np.testing.assert_allclose(theirs, want, atol=1e-9)
    if df >= 20:
        q = rows.selectExpr(t_quantile95("df")).first()[0]
        assert 1 - t_cdf(q, df) == pytest.approx(0.05, abs=1e-6)


def test_partial_autocorrelations_as_fold(spark):
    rng = np.random.default_rng(2)
    r = [float(x) for x in 0.7 ** np.arange(1, 13) + rng.normal(0, 0.02, 12)]
    rows = spark.createDataFrame([(r,), ([0.5],), ([],)], "r array<double>")
    got = [x[0] for x in rows.selectExpr(partial_autocorrelations("r")).collect()]

    def yule_walker(k):
        m = np.array([[1.0 if i == j else r[abs(i - j) - 1] for j in range(k)] for i in range(k)])
        return np.linalg.solve(m, r[:k])[-1]

    np.testing.assert_allclose(got[0], [yule_walker(k) for k in range(1, 13)], atol=1e-10)
    np.testing.assert_allclose(got[0], partial_correlations(r), atol=1e-10)
    assert got[1] == [0.5]


def test_regimes_come_as_of_their_date(spark):
    rows = spark.createDataFrame([(DAY + dt.timedelta(d),) for d in (0, 1, 2, 5)], "date date")
    dated = spark.createDataFrame([(DAY + dt.timedelta(1), 0.25), (DAY + dt.timedelta(3), 0.5)], "date date, p double")
    assert [r.p for r in as_of(rows, dated, ("p",)).orderBy("date").collect()] == [0.0, 0.25, 0.25, 0.5]


def test_legs_share_by_regime_and_flag_exits(spark):
    day = DAY
    data = [(day, t, s, v) for t, (s, v) in enumerate([(0.5, 1.0), (2.0, 2.0), (-1.0, 3.0), (2.5, 6.0), (2.0, 7.0), (-0.5, 8.0), (0.0, 9.0)])] + [(day, 9, None, 1.0), (day + dt.timedelta(1), 1, 1.0, 1.0)]
    rows = spark.createDataFrame(data, "date date, ticker long, s double, v double")
    regimes = spark.createDataFrame([(day, 0.0, 0.5, 0.5)], "date date, prob_low double, prob_mid double, prob_high double")
    got = {(r.date, r.ticker): r for r in regime_legs(rows, regimes, Legs()).collect()}
    share = 0.5 * 0.3 + 0.5 * 0.5
    calm = [t for t in range(7) if got[day, t].leg == 1]
    assert calm == [0, 1, 2, 3] and got[day, 3].weight == pytest.approx(share) and got[day, 0].weight == got[day, 1].weight == 0
    assert got[day, 4].weight == pytest.approx(1 - share) and [got[day, t].exit for t in (4, 5, 6)] == [False, True, False]
    assert (day, 9) not in got and got[day + dt.timedelta(1), 1].weight == pytest.approx(share)


def test_overlapping_holdouts_average_and_gate(spark):
    rng = np.random.default_rng(6)
    data = [(DAY + dt.timedelta(d), t, float(a), float(a * 0.1 + rng.normal() * 0.05)) for d in range(40) for t, a in enumerate(rng.normal(size=12))]
    signals = spark.createDataFrame(data, "date date, ticker long, a double, y double").selectExpr("*", "-a AS b")
    plan = spark.createDataFrame([(0, 10, 26), (1, 18, 34)], "slice int, hold_from int, hold_to int")
    kept = spark.createDataFrame([(0, "a"), (1, "b")], "slice int, factor string")
    report, pooled = holdout_returns(signals, kept, plan, "y")
    found = {r.slice: r for r in report.collect()}
    assert found[0].passed and found[0].mean > 0 and not found[1].passed and found[1].mean < 0 and found[0].n == 16
    days = {r.date: r for r in pooled.collect()}
    assert sorted(days) == [DAY + dt.timedelta(d) for d in range(10, 26)] and {r.slices for r in days.values()} == {1}
    pdf = signals.toPandas()
    one = pdf[pdf["date"] == DAY + dt.timedelta(12)]
    z = (one["a"] - one["a"].mean()) / one["a"].std()
    assert days[DAY + dt.timedelta(12)].ret == pytest.approx((z * one["y"]).sum() / z.abs().sum())
    both, averaged = holdout_returns(signals, spark.createDataFrame([(0, "a"), (1, "a")], "slice int, factor string"), plan, "y")
    assert {r.slices for r in averaged.where(f"date >= DATE'{DAY + dt.timedelta(18)}' AND date < DATE'{DAY + dt.timedelta(26)}'").collect()} == {2}


def test_clock_chunks_over_ranges(spark):
    rng = np.random.default_rng(8)
    clock, rows, chunk = 0, [], 0
    want = {}
    for i in range(3000):
        step = -int(rng.integers(1, 50)) if rng.random() < 0.01 and i else int(rng.integers(0, 5))
        chunk += step < 0
        clock += step
        rows.append((i, clock))
        want[i] = chunk
    df = spark.createDataFrame(rows, "i long, ts long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = split_by_clock(df, ["i"], "ts")
        assert {r.i: r.chunk for r in found.collect()} == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert split_by_clock(df.limit(0), ["i"], "ts").collect() == []
