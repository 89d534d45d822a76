"""Models, simulators, searches, sources and streams against plain definitions."""

import dataclasses
import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

from panelforge.functions.ops import col, fwd_sum
from panelforge.operators.engines import NAV_SCHEMA, DualLeg, Lots, SingleLeg, dual_leg, dual_leg_run, lot_engine, simulate, simulate_trades, single_leg, single_leg_run
from panelforge.operators.models import (
    RollingVolatility, egarch_filter, egarch_forecast, fama_macbeth, fit_hmm, greedy_prune, hmm_probabilities, lasso_path, market_volatility, normal_sf, partial_correlations, rolling_sigma, t_cdf,
)
from panelforge.operators.search import Candidate, Score, SearchSpec, Tree, evolve, purged_split
from panelforge.operators.walkforward import ScreenSpec, neutralize, screen, signal_bank, slices
from panelforge.operators.statistics import split_by_clock
from panelforge.sources.tables import append, read_aggregates, read_bars, upsert
from panelforge.streaming.bars import daily_bars, read_events, run_available

from .conftest import SMALL

DAY = dt.date(2024, 1, 1)


def frame(spark, days=60, names=12, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(days):
        x = rng.normal(size=(names, 3))
        y = 0.5 * x[:, 0] - 0.2 * x[:, 1] + rng.normal(scale=0.3, size=names)
        rows += [(DAY + dt.timedelta(d), t, *map(float, x[t]), float(y[t])) for t in range(names)]
    return spark.createDataFrame(rows, "date date, ticker int, a double, b double, c double, y double"), pd.DataFrame(rows, columns=["date", "ticker", "a", "b", "c", "y"])


def test_distributions():
    assert t_cdf(2.228138852, 10) == pytest.approx(0.975, abs=1e-8)
    assert t_cdf(-1.0, 1) == pytest.approx(0.25, abs=1e-10)
    assert normal_sf(1.959963985) == pytest.approx(0.025, abs=1e-9)


def test_partial_correlations_of_a_first_order_process():
    assert partial_correlations([0.5, 0.25, 0.125]) == pytest.approx([0.5, 0.0, 0.0])


def test_grams_and_lasso(spark):
    from pyspark.sql import functions as F

    from panelforge.operators.grams import as_gram, fold_sums, folded

    df, pdf = frame(spark)
    placed = folded(df.withColumn("slice", F.lit(0)), {0: ("a", "b", "c")}, "y", 5)
    sums = fold_sums(placed, {0: ("a", "b", "c")}, "y", 5, 3).toPandas()
    grams = {k: as_gram(g) for k, g in sums.groupby("fold")}
    m = pdf[["a", "b", "c", "y"]].to_numpy()
    np.testing.assert_allclose(grams[5]["gram"], m.T @ m, rtol=1e-9)
    i = pdf["date"].map({d: k for k, d in enumerate(sorted(set(pdf["date"])))})
    keep = m[((i < 12 - 3) | (i >= 24 + 3)).to_numpy()]
    np.testing.assert_allclose(grams[1]["gram"], keep.T @ keep, rtol=1e-9)
    coef, mean, sd = lasso_path(grams[5], np.array([1e-9, 0.05, 10.0]))
    x = (m[:, :3] - mean[:3]) / sd
    want = np.linalg.lstsq(x, m[:, 3] - mean[3], rcond=None)[0]
    np.testing.assert_allclose(coef[0], want, atol=1e-6)
    grad = x.T @ (m[:, 3] - mean[3] - x @ coef[1]) / len(x)
    assert np.all(np.abs(grad) <= 0.05 + 1e-8) and np.all(coef[2] == 0)


def test_fama_macbeth(spark):
    df, pdf = frame(spark)
    out = {r.factor: r for r in fama_macbeth(df, ("a", "b", "c"), "y").collect()}
    slopes = [np.linalg.lstsq(np.column_stack([np.ones(len(g)), g[["a", "b", "c"]]]), g["y"], rcond=None)[0] for _, g in pdf.groupby("date")]
    np.testing.assert_allclose([out[k]["mean"] for k in ("const", "a", "b", "c")], np.mean(slopes, axis=0), atol=1e-9)
    assert out["a"].p < 1e-6 and out["a"].n == 60


def test_pruning():
    assert greedy_prune(["x", "y", "z"], {("x", "y"): 0.9, ("z", "x"): 0.1}) == ["x", "z"]


def test_lasso_query_searches_the_whole_grid(spark):
    from panelforge.plans import catalog

    found = sorted(r.alpha for r in catalog.queries()["lasso_path"](spark, "/root/testdata/sf0.001").select("alpha").collect())
    np.testing.assert_allclose(found, np.logspace(-7, -2, 80))


def test_volatility_and_regimes(spark):
    rng = np.random.default_rng(2)
    rows = [(t, DAY + dt.timedelta(d), float(rng.normal(scale=0.01 * (t + 1)))) for t in range(2) for d in range(150)] + [(7, DAY, 0.01), (8, DAY, None)]
    out = {r.ticker: r for r in egarch_forecast(spark.createDataFrame(rows, "ticker long, date date, logret double")).collect()}
    assert out[0].sigma < out[1].sigma < 0.2 and out[0].sigma == pytest.approx(0.01 * math.sqrt(5), rel=0.5)
    assert out[7].method == "ewma" and out[8].sigma is None
    assert np.isfinite(egarch_filter(rng.normal(size=50), 0.0, 0.1, 0.0, 0.9, 8.0)).all()
    x = np.concatenate([rng.normal(m, 0.1, 60) for m in (-2, 0, 2)])
    mean, p = fit_hmm(x)
    np.testing.assert_allclose(mean, [-2, 0, 2], atol=0.2)
    assert p.argmax() == 2 and p.sum() == pytest.approx(1)
    series = spark.createDataFrame([(DAY + dt.timedelta(i), float(v)) for i, v in enumerate(x[:40])], "date date, value double")
    found = hmm_probabilities(series, 30).toPandas()
    assert len(found) == 10 and np.allclose(found[["p0", "p1", "p2"]].sum(axis=1), 1)


def test_regimes_have_every_date(spark):
    from panelforge.operators.models import EgarchSpec

    series = spark.createDataFrame([(DAY + dt.timedelta(i), float(v)) for i, v in enumerate(np.random.default_rng(4).normal(size=40))], "date date, value double")
    full, all_dates = (hmm_probabilities(series, 30, partial=p).toPandas().set_index("date").sort_index() for p in (False, True))
    assert len(all_dates) == 40 and np.allclose(all_dates.sum(axis=1), 1) and np.allclose(all_dates.iloc[:3], 1 / 3)
    assert not np.allclose(all_dates.iloc[3:30], 1 / 3) and np.allclose(all_dates.loc[full.index], full)
    assert EgarchSpec().paths == 4000


def orders(seed=3, days=25, names=4, gaps=True):
    rng = np.random.default_rng(seed)
    price = np.exp(np.cumsum(rng.normal(0, 0.02, (days, names)), axis=0)) * 50
    if gaps:
        price[rng.random(price.shape) < 0.1] = np.nan
    weight = rng.dirichlet(np.ones(names), days)
    return pd.DataFrame([(DAY + dt.timedelta(d), t, price[d, t], weight[d, t], 1.0 + t % 2) for d in range(days) for t in range(names)], columns=["date", "ticker", "price", "weight", "leg"])


@pytest.mark.parametrize("run,p", [(single_leg, SingleLeg(hold=2)), (dual_leg, DualLeg(lot=1)), (lot_engine, Lots())])
def test_simulators_keep_their_books(run, p):
    out = run(orders(), p)
    assert (out["cash"] >= -1e-6).all() and (out["nav"] >= out["cash"] - 1e-6).all()
    assert out["n_bought"].sum() > 0 and out["n_sold"].sum() > 0
    flat = orders(gaps=False)
    flat["price"] = 10.0
    assert run(flat, p)["nav"].is_monotonic_decreasing
    flat["weight"] = 0.0
    assert (run(flat, p)["nav"] == p.cash).all()
    assert out["n_held"].iloc[-1] >= 0


def test_a_missing_price_fails_the_sale():
    pdf = orders(gaps=False)
    first = sorted(set(pdf["date"]))
    pdf.loc[pdf["date"] == first[2], "price"] = np.nan
    out = single_leg(pdf, SingleLeg(hold=1))
    assert out["n_failed"].iloc[2] == out["n_held"].iloc[1] > 0


def test_scenarios_run_side_by_side(spark):
    df = spark.createDataFrame(orders(gaps=False))
    out = simulate(df, [SingleLeg("one"), Lots("two")])
    assert {r.scenario: r["count"] for r in out.groupBy("scenario").count().collect()} == {"one": 25, "two": 25}
    assert out.columns == [c.split()[0] for c in NAV_SCHEMA.split(", ")]


def test_trees():
    t = Tree("+", (Tree("ts_mean", (Tree("a"),), window=5), Tree("const", value=0.5)))
    assert (t.size(), t.depth(), t.complexity(), t.key()) == (4, 3, 6, "(ts_mean5(a) + 0.5000)")
    assert t.put((0,), Tree("b")).key() == "(b + 0.5000)" and len(t.paths()) == 4
    with pytest.raises(ValueError):
        SearchSpec(cross=0.8, mutate=0.4)


def test_search_is_repeatable_and_finds_the_factor(spark):
    df, _ = frame(spark, days=50, names=15)
    spec = SearchSpec(population=8, generations=2, least_names=5, least_days=20, least_validation_days=3, purge=2)
    df = df.withColumn("z", col_lead("a")).cache()
    one, two = (evolve(df, ("a", "b"), fwd_sum(col("z"), 1), spec) for _ in range(2))
    assert one == two and one
    assert one[0].t > 5 and one[0].validation_t > 2 and "a" in one[0].formula
    assert [f.adjusted for f in one] == sorted((f.adjusted for f in one), reverse=True)


def test_whole_search_and_neutral_fitness(spark):
    from panelforge.operators.search import WINDOWS, fitness
    from panelforge.plans.modelling import SEARCH

    assert (SEARCH.population, SEARCH.generations, SEARCH.pool, WINDOWS) == (384, 180, 300, (5, 10, 20, 60)) and SEARCH.regressors and SEARCH.group
    rng = np.random.default_rng(5)
    rows = [(DAY + dt.timedelta(d), t, float(t % 3), float(b), float(b + e), float(b), float(e)) for d in range(40) for t in range(20) for b, e in [rng.normal(size=2)]]
    df = spark.createDataFrame(rows, "date date, ticker long, sector double, risk double, a double, y double, own double").cache()
    spec = SearchSpec(least_days=10, least_validation_days=3, purge=1)
    ends = purged_split(df, spec)
    of = lambda target, **more: fitness(df, [Tree("a")], fwd_sum(col(target), 1), dataclasses.replace(spec, **more), ends)["a"]
    shifted = df.withColumn("y", col_lead("y")).withColumn("own", col_lead("own")).cache()
    df = shifted
    neutral = {"regressors": ("risk",), "group": "sector"}
    assert of("y").train.mean_ic > 0.5 and abs(of("y", **neutral).train.mean_ic) < 0.15
    assert of("own", **neutral).train.mean_ic > 0.9


def test_validation_dates_follow_a_purged_gap(spark):
    df, _ = frame(spark, days=50, names=2)
    last, first = purged_split(df, SearchSpec(train_share=0.8, purge=3))
    assert (last, first) == (DAY + dt.timedelta(36), DAY + dt.timedelta(43))
    assert purged_split(df.limit(0), SearchSpec()) == (None, None)


def test_penalties_of_validation():
    spec = SearchSpec(penalty=0.0)
    of = lambda t, v: Candidate(Tree("a"), Score(t, 0.1, 50), Score(v, 0.1, 20)).adjusted(spec)
    assert of(2.0, 3.0) == 3.0 and of(4.0, 2.0) == pytest.approx(1.7) and of(2.0, -1.0) == pytest.approx(-1 - 0.45 - 1)
    assert Candidate(Tree("a"), Score(2.0, 0.1, 50), None).adjusted(spec) == float("-inf")


def test_search_stops_without_gain(spark):
    df, _ = frame(spark, days=50, names=6)
    spec = SearchSpec(population=4, generations=50, depth=1, constants=0.0, patience=2, least_names=5, least_days=20, least_validation_days=3, purge=2)
    found = evolve(df.cache(), ("a",), fwd_sum(col("y"), 1), spec)
    assert [f.formula for f in found] == ["a"] and found[0].generations == 3


def col_lead(name):
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    return F.lag(name).over(Window.partitionBy("ticker").orderBy("date"))


def test_sources(spark, tmp_path):
    (tmp_path / "bars.csv").write_text("date,ticker,open,high,low,close,volume,vwap,n_trades\n2024-01-02,A,1,2,0.5,1.5,100,1.2,7\n2024-01-03,A,x,2,0.5,1.5,100,1.2,7\n")
    rows = read_bars(spark, str(tmp_path / "bars.csv")).orderBy("date").collect()
    assert rows[0].close == 1.5 and rows[1].open is None
    (tmp_path / "agg.json").write_text('{"ticker":"A","timestamp":1704254400000,"close":1.0}\n{"ticker":"A","timestamp":1704250800000,"close":2.0}\n')
    assert [(str(r.date), r.close) for r in read_aggregates(spark, str(tmp_path / "agg.json")).collect()] == [("2024-01-02", 1.0)]
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, t int, v string")
    new = spark.createDataFrame([(2, 1, "c"), (2, 3, "d"), (5, 1, "e")], "k int, t int, v string")
    assert sorted((r.k, r.v) for r in upsert(old, new, ["k"], "t").collect()) == [(1, "a"), (2, "d"), (5, "e")]
    append(old, str(tmp_path / "t"), "k")
    append(new, str(tmp_path / "t"), "k")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 5
    feed = spark.createDataFrame([(0, 1), (1, 2), (2, 1), (3, 5), (4, 4)], "i int, ts int")
    assert [r.chunk for r in split_by_clock(feed, ["i"], "ts").orderBy("i").collect()] == [0, 0, 1, 1, 2]


def test_stream_equals_batch(spark, duck):
    from panelforge.plans.modelling import STREAM_ORACLE

    from .conftest import same_rows

    mine, theirs = same_rows(run_available(daily_bars(read_events(spark, SMALL))), duck.sql(STREAM_ORACLE))
    assert mine == theirs and mine


def test_neutral_on_regressors_and_groups(spark):
    df, pdf = frame(spark, days=4)
    pdf["g"] = (pdf["ticker"] % 3).astype(float)
    pdf.loc[pdf["date"] == pdf["date"].max(), "a"] = np.nan
    out = neutralize(spark.createDataFrame(pdf), "y", ("a", "b"), "g", ridge=0.0).toPandas()
    assert len(out) == 36
    whole = out.merge(pdf, on=["date", "ticker"])
    for _, g in whole.groupby("date"):
        design = np.column_stack([np.ones(len(g)), g[["a", "b"]], *[(g["g"] == k).astype(float) for k in (1.0, 2.0)]])
        np.testing.assert_allclose(g["residual"], g["y"] - design @ np.linalg.lstsq(design, g["y"], rcond=None)[0], atol=1e-6)


def test_screening_keeps_the_factor_and_not_its_copy(spark):
    from pyspark.sql import functions as F

    df, _ = frame(spark, days=80)
    df = df.withColumn("copy", F.col("a") * 2 + 0.001 * F.col("b")).persist()
    spec = ScreenSpec(train=50, least_train=40, every=15, holdout=10, least_days=30, least_oos=5)
    found = screen(df, ("a", "b", "copy"), "y", spec)
    rows = found.collect()
    assert rows and all((r.passed and sum(x.kept for x in rows if x.slice == r.slice and x.factor in ("a", "copy")) == 1) for r in rows if r.factor == "a")
    bank = signal_bank(df.drop("y"), found, slices(df, spec)).toPandas()
    assert len(bank) and abs(bank.groupby(["slice", "date"])["z"].mean()).max() < 1e-9
    plan = slices(df, spec).collect()
    assert all(p.train_to <= p.hold_from - spec.purge for p in plan)


def book(prices, weights, legs=None, **flags):
    """Rows of a panel from lists by ticker."""
    names = sorted(prices)
    days = len(prices[names[0]])
    rows = [
        {"date": DAY + dt.timedelta(d), "ticker": t, "price": prices[t][d], "weight": weights[t][d], "leg": (legs or {}).get(t, 2.0), **{k: v[t][d] for k, v in flags.items()}}
        for d in range(days) for t in names
    ]
    return pd.DataFrame(rows)


def orders_of(run, ticker):
    return [((r.date - DAY).days, r.side, r.status, r.filled) for r in run[1].itertuples() if r.ticker == ticker]


def test_a_failed_exit_stays_pending():
    """Bought at 100; the drawdown exit finds no price, the next day is limit-down, and the sale follows on the day after, without a new reason."""
    nan = float("nan")
    pdf = book({1: [100.0, 88.0, nan, 79.2, 90.0, 90.0, 90.0]}, {1: [1.0, 0, 1.0, 1.0, 1.0, 0, 0]})
    run = dual_leg_run(pdf, DualLeg(lot=1, stop=0.5, take=5.0, drawdown=0.10, cooldown=0, limit=0.10))
    assert orders_of(run, 1)[:4] == [(0, "buy", "filled", 9995), (2, "sell", "no_price", 0), (3, "sell", "limit_down", 0), (4, "sell", "filled", 9995)]
    # the day after the sale it may be bought again, not before
    assert all(d > 4 for d, side, status, _ in orders_of(run, 1)[4:] if side == "buy" and status == "filled")
    assert run[0]["n_failed"].tolist()[:5] == [0, 0, 1, 1, 0]


def test_names_that_leave_are_not_bought_and_drawdown_counts_once():
    pdf = book({1: [10.0] * 8, 2: [100.0, 80.0, 80.0, 80.0, 80.0, 80.0, 80.0, 80.0]}, {1: [0.0] * 8, 2: [0.9] + [0.9] * 7})
    run = dual_leg_run(pdf, DualLeg(lot=1, stop=0.9, take=5.0, drawdown=0.10, cooldown=2, limit=0.5, max_hold=99))
    assert [(d, s) for d, side, s, _ in orders_of(run, 2) if side == "sell"] == [(2, "filled")]
    assert [d for d, side, s, _ in orders_of(run, 2) if side == "buy" and s == "filled"][:3] == [0, 1, 5]


def test_sample_and_exit_flags_and_whole_lots():
    zero = [0.0] * 5
    pdf = book({1: [10.0] * 5, 2: [10.0] * 5}, {1: [0.5] * 5, 2: [0.5] * 5}, exit={1: [0, 0, 1, 0, 0], 2: zero}, sample={1: [1.0] * 5, 2: zero})
    run = dual_leg_run(pdf, DualLeg(cash=100_000.0, max_hold=99))
    assert not orders_of(run, 2) and (2, "sell", "filled", 50) in [(d, s, st, min(n, 50)) for d, s, st, n in orders_of(run, 1)]
    assert ((run[1]["amount"][run[1]["side"] == "buy"] / (100 * 10 * 1.0005)).round(9) % 1 == 0).all()
    none = book({1: [10.0] * 5}, {1: [0.5] * 5}, sample={1: zero})
    assert len(orders_of(dual_leg_run(none, DualLeg(cash=100_000.0)), 1))


@pytest.mark.parametrize("run,p", [(single_leg_run, SingleLeg(hold=2)), (dual_leg_run, DualLeg(lot=1))])
def test_orders_explain_the_cash(run, p):
    nav, trades = run(orders(), p)
    moved = trades.assign(signed=np.where(trades["side"] == "sell", trades["amount"], -trades["amount"])).groupby("date")["signed"].sum()
    np.testing.assert_allclose(nav["cash"], p.cash + nav["date"].map(moved).fillna(0.0).cumsum(), rtol=1e-9)
    done = trades[trades["status"] == "filled"]
    assert nav["n_bought"].sum() == (done["side"] == "buy").sum() and nav["n_sold"].sum() == (done["side"] == "sell").sum()


def test_orders_of_scenarios(spark):
    out = simulate_trades(spark.createDataFrame(orders(gaps=False)), [SingleLeg("one"), DualLeg("two", lot=1)])
    assert {r.scenario for r in out.select("scenario").distinct().collect()} == {"one", "two"}


def test_newey_west_and_low_runs(spark):
    from panelforge.operators.walkforward import longest_low_run, newey_west_t

    draw = np.random.default_rng(3)
    x = draw.normal(0.1, 1, 60)
    rows = [("g", i, float(v)) for i, v in enumerate(x)] + [("g", 100, None)]
    r = newey_west_t(spark.createDataFrame(rows, "k string, i int, x double"), ["k"], "x", "i", 4).first()
    u = x - x.mean()
    s = u @ u / 60 + sum(2 * (1 - k / 5) * (u[k:] @ u[:-k]) / 60 for k in range(1, 5))
    assert r.n == 60 and r.t == pytest.approx(x.mean() / np.sqrt(s / 60))
    low = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0]
    found = longest_low_run(spark.createDataFrame([("g", i, v) for i, v in enumerate(low)], "k string, i int, x double"), ["k"], "x", "i", 2, 0.5).first()
    assert found.longest == 3


def test_one_call_over_all_slices(spark):
    from panelforge.operators.walkforward import choose, walk_forward

    df, _ = frame(spark, days=80)
    spec = ScreenSpec(train=50, least_train=40, every=15, holdout=10, least_days=30, least_oos=5)
    table, bank = walk_forward(df, ("a", "b"), "y", np.array([1e-4, 1e-2]), spec)
    rows = table.collect()
    assert {r.slice for r in rows} == {r.slice for r in slices(df, spec).collect()} and all(any(r.factor == "a" and r.coefficient > 0 for r in rows if r.slice == k) for k in {r.slice for r in rows})
    assert bank.count() > 0
    path = spark.createDataFrame([(0.1, 0.2, 1.0), (0.01, 0.2, 1.0), (0.001, 0.2, 0.5), (0.0, None, None)], "alpha double, rank_ic double, ir double")
    assert choose(path).first().alpha == 0.01


def test_rolling_market_volatility(spark):
    spec = RollingVolatility(window=60, every=20, beta_below=1.0)
    rng = np.random.default_rng(4)
    r = rng.standard_t(8, 130) * np.where(np.arange(130) < 90, 0.01, 0.04)
    r[100] = np.nan
    sigma = rolling_sigma(r, spec)
    assert np.isnan(sigma[:60]).all() and np.isfinite(sigma[60:]).all()
    later = r.copy()
    later[110:] = 0.5
    assert (rolling_sigma(later, spec)[60:111] == sigma[60:111]).all()
    assert sigma[120:].mean() > 1.5 * sigma[60:90].mean()
    assert np.isnan(rolling_sigma(np.zeros(130), spec)).all() and len(rolling_sigma(r[:0], spec)) == 0

    flat = r.copy()
    flat[60:80] = 0.0
    still = RollingVolatility(window=20, every=20, beta_below=1.0)
    carried = rolling_sigma(flat, still)
    assert np.isfinite(carried[80:100]).all(), "the refit at 80, on rows without variance, goes on with the last usable fit"

    rows = [(1, DAY + dt.timedelta(d), None if np.isnan(x) else float(x)) for d, x in enumerate(r)]
    rows += [(2, d, None if x is None else x / 2) for _, d, x in rows] + [(3, d, None) for _, d, _ in rows]
    schema = "ticker long, date date, logret double"
    out = {x.date: x for x in market_volatility(spark.createDataFrame(rows, schema), spec).collect()}
    assert set(out) == {DAY + dt.timedelta(d) for d in range(60, 130)} and {x.n for x in out.values()} == {2}
    half = rolling_sigma(r / 2, spec)
    for d in range(60, 130):
        assert out[DAY + dt.timedelta(d)].sigma == pytest.approx((sigma[d] + half[d]) / 2)
    assert market_volatility(spark.createDataFrame([], schema), spec).count() == 0
