"""Panels saved as blocks: those of the planner's expressions, moved and saved once."""

import datetime as dt
import glob
import os

import numpy as np
import pytest
from .conftest import SMALL

from panelforge.functions.dag import compute
from panelforge.functions.features import FEATURES
from panelforge.functions.ops import col, correlation, cs_mean, delay, fwd_sum, stddev, zscore
from panelforge.operators import blocks
from panelforge.operators.connector import search_slices
from panelforge.operators.panel import FILLED_WEEK, load_panel
from panelforge.operators.search import SearchSpec
from panelforge.operators.walkforward import ScreenSpec
from panelforge.plans.modelling import BETA, search_panel


def by_cell(rows, columns):
    return {(r["date"], r["ticker"]): [np.nan if r[c] is None else r[c] for c in columns] for r in rows.collect()}


def assert_same(found, wanted, columns):
    assert found.keys() == wanted.keys() and found
    keys = sorted(found)
    a, b = (np.array([x[k] for k in keys], dtype=float) for x in (found, wanted))
    for k, c in enumerate(columns):
        assert np.array_equal(np.isnan(a[:, k]), np.isnan(b[:, k])), c
        assert np.allclose(a[:, k], b[:, k], rtol=1e-9, atol=1e-9, equal_nan=True), c


def test_the_search_panel_is_that_of_the_planner(spark, tmp_path, monkeypatch):
    """All 24 features, beta, log cap, sector and target, in blocks of three names; trades are the only rows shuffled whole."""
    monkeypatch.setattr(blocks, "MOST_CELLS", 357 * 3)
    panel = search_panel(spark, SMALL, tuple(FEATURES), str(tmp_path))
    outputs = {f: zscore(delay(x, 1), 2) for f, x in FEATURES.items()} | {"beta": BETA, "y": fwd_sum(col("logret"), 5)}
    rows = compute(load_panel(spark, SMALL, FILLED_WEEK), outputs, keep=("mcap", "sector"))
    rows = rows.selectExpr("*", "CASE WHEN mcap > 0 THEN ln(mcap) END AS ln_cap")
    columns = (*FEATURES, "beta", "ln_cap", "sector", "y")
    assert_same(by_cell(panel.rows(columns), columns), by_cell(rows, columns), columns)
    assert panel.read(()).count() > 3 and panel.codes() == sorted({r["sector"] for r in rows.select("sector").distinct().collect()})


def test_windows_and_days_with_holes(spark, tmp_path):
    rng = np.random.default_rng(2)
    data = [(dt.date(2021, 1, 1) + dt.timedelta(d), t, *(None if rng.random() < 0.1 else float(v) for v in rng.normal(size=2))) for d in range(40) for t in range(9) if rng.random() < 0.98]
    rows = spark.createDataFrame(data, "date date, ticker long, a double, b double")
    a, b = col("a"), col("b")
    outputs = {"corr": correlation(a, delay(b, 1), 4), "sd": stddev(a * b, 3), "z": zscore(a - cs_mean(b), 5), "pop": zscore(b, 2, False), "mean": cs_mean(zscore(a)), "long": stddev(a, 60), "ahead": fwd_sum(b, 3)}
    dates = tuple(sorted({r[0] for r in data}))
    saved = blocks.save_rows(rows, dates, ("a", "b"), f"{tmp_path}/rows")
    made = blocks.compute_blocks(saved, dict, outputs, f"{tmp_path}/made")
    dense = rows.select("date").distinct().crossJoin(rows.select("ticker").distinct()).join(rows, ["date", "ticker"], "left")
    assert_same(by_cell(made.rows(tuple(outputs)), outputs), by_cell(compute(dense, outputs), outputs), outputs)


def test_a_chain_saves_its_panel_once(spark, tmp_path):
    """Slices, their searches and holdouts read ranges of one saved panel; nothing of its size is written beside it."""
    rng = np.random.default_rng(4)
    data = [(dt.date(2020, 1, 6) + dt.timedelta(d), t, float(t % 3), *map(float, rng.normal(size=4))) for d in range(130) for t in range(14)]
    panel = spark.createDataFrame(data, "date date, ticker long, sector double, risk double, a double, b double, y double")
    screening = ScreenSpec(train=80, least_train=70, every=30, holdout=25, least_days=30, least_oos=10, purge=2)
    search = SearchSpec(population=6, generations=2, least_names=5, least_days=20, least_validation_days=5, purge=2, regressors=("risk",), group="sector")
    assert search_slices(panel, ("a", "b"), "y", np.array([1e-4, 1e-2]), screening, search, f"{tmp_path}/chain").count() > 0
    sizes = {f: os.path.getsize(f) for f in glob.glob(f"{tmp_path}/chain/**/*.parquet", recursive=True)}
    inside = sum(n for f, n in sizes.items() if f.startswith(f"{tmp_path}/chain/panel/"))
    assert inside > 130 * 14 * 8 * 4 and sum(sizes.values()) < 1.5 * inside + 20_000


def test_operators_without_matrices_are_refused():
    with pytest.raises(ValueError, match="no such operator"):
        blocks.Cells({"a": np.zeros((2, 2))}, {}).value(blocks.Node.make("rank", col("a")))
