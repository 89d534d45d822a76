"""A query of each family gives the rows of its DuckDB twin on the smallest tables."""

import pytest

from panelforge.plans import catalog

from .conftest import SMALL, same_rows

NAMES = (
    "panel_month", "adv_ladder", "ts_corr", "ts_decay", "ts_rank", "ts_argmin", "ts_product", "ts_std_frac80", "rolling_beta", "ffill_limit3", "cs_rank", "cs_indneutralize", "cs_winsor_z_clip",
    "features24", "universe_liquid_listed", "formulas_001_010", "formulas_101_101", "ic_spearman", "ic_summary", "nw_tstat", "hac_se", "screen_gates", "softmax_topk", "dual_leg_split", "purged_folds",
    "median_mad_budget", "upsert_latest", "chunk_by_ts_drop", "asof_classification", "ewma_fold", "logret_ca", "signal_tests_merged", "two_sided_filter", "nw_one_sided", "pair_corr_min_pairs", "ticker_formats",
    "legacy_fill", "universe_by_age_and_dollars", "partial_autocorrelation", "pacf_lags", "alpha_significance", "adaptive_significance", "spearman_matrix", "dual_leg_regimes", "slice_backtest",
    "slice_backtest_returns", "symbol_load", "stage_ttest",
)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, duck, name):
    mine, theirs = same_rows(catalog.queries()[name](spark, SMALL), duck.sql(catalog.oracle_sql()[name]))
    assert mine == theirs and mine


def test_asof_covers_all_customers(spark, duck):
    found = catalog.queries()["asof_classification_all"](spark, SMALL)
    mine, theirs = same_rows(found, duck.sql(catalog.oracle_sql()["asof_classification_all"]))
    assert mine == theirs and mine
    assert found.select("k").distinct().count() == duck.sql("SELECT count(DISTINCT o_custkey) FROM orders").fetchall()[0][0]
    orders = duck.sql("SELECT o_custkey, CAST(o_orderdate AS DATE), o_orderpriority FROM orders").fetchall()
    own = {}
    for k, day, code in orders:
        own.setdefault(k, {})[day] = max(code, own.get(k, {}).get(day, code))
    for r in found.limit(2000).collect():
        past = [d for d in own[r.k] if d <= r.date]
        assert r.code == (own[r.k][max(past)] if past else "UNK")


def test_upsert_keeps_all_orders(spark, duck):
    found = catalog.queries()["upsert_latest_all"](spark, SMALL)
    mine, theirs = same_rows(found, duck.sql(catalog.oracle_sql()["upsert_latest_all"]))
    assert mine == theirs
    want = {k: (2 * v, 1) if k % 2 == 0 else (v, 0) for k, v in duck.sql("SELECT o_orderkey, o_totalprice FROM orders").fetchall()}
    assert {r.k: (r.v, r.fresh) for r in found.collect()} == want and len(mine) == len(want)


def test_names_match():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_one_sided_test_against_plain_definition(spark, duck):
    """Lags by the rule, Bartlett weights and the tail of the normal distribution."""
    import math

    r = catalog.queries()["nw_one_sided"](spark, SMALL).first()
    body = catalog.oracle_sql()["nw_one_sided"]
    x = [v[0] for v in duck.sql(body[: body.index("\ns AS (SELECT date, r,")].rstrip().rstrip(",") + " SELECT r FROM mkt ORDER BY date").fetchall()]
    n, mean = len(x), sum(x) / len(x)
    lags = max(1, min(int(4 * (n / 100) ** (2 / 9)), n - 1))
    u = [v - mean for v in x]
    s = sum(a * a for a in u) / n + sum(2 * (1 - k / (lags + 1)) * sum(a * b for a, b in zip(u[k:], u)) / n for k in range(1, lags + 1))
    t = mean / math.sqrt(s / n)
    assert (r.n, r.lags) == (n, lags) and abs(r.t - t) < 1e-5 and abs(r.p_one_sided - 0.5 * math.erfc(t / math.sqrt(2))) < 2e-6


def test_legacy_fill_looks_ahead_only_before_the_first_value(spark):
    rows = catalog.queries()["legacy_fill"](spark, SMALL).collect()
    assert all(r.filled is not None for r in rows) and all(r.forward == r.filled for r in rows if r.forward is not None)
