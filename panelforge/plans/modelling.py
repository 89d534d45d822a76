"""Queries that SQL does not express: regressions, searches, volatility, regimes, simulators, streams."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import astuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dag import compute
from ..functions.features import FEATURES
from ..functions.ops import col, cs_mean, delay, fwd_sum, ln, rolling_beta, zscore
from ..operators import ledger
from ..operators.blocks import BlockPanel, compute_blocks, filled_columns, save_bars
from ..operators.connector import search_slices
from ..operators.evaluation import shared_folder
from ..operators.engines import DualLeg, Lots, SingleLeg, simulate, simulate_trades
from ..operators.grams import lasso_search
from ..operators.models import EgarchSpec, egarch_forecast, fama_macbeth, hmm_probabilities, market_volatility
from ..operators.panel import FILLED_WEEK, MONTH, NATION_WEEK, load_panel
from ..operators.search import SearchSpec, evolve_blocks
from ..operators.walkforward import ScreenSpec, choose, neutralize, screen, signal_bank, slices, walk_forward
from ..streaming.bars import daily_bars, read_events, run_available
from .catalog import register
from .library import GRAM, KEPT, SIGNALS

FACTORS = GRAM[:-1]
ALPHAS = np.logspace(-7, -2, 80)
#: The whole search of the reference, with 50 names a date.
SEARCH = SearchSpec(population=384, generations=180, least_names=50, least_days=60, regressors=("beta", "ln_cap"), group="sector")
BETA = rolling_beta(delay(col("logret"), 1), delay(cs_mean(col("logret")), 1), 60)
TERMINALS = ("mom_20", "rev_5", "rv_20", "range_1", "gap_rev")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compute(load_panel(spark, sf_dir, NATION_WEEK), SIGNALS, keep=KEPT)


def _kept(rows: DataFrame, of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``of`` makes of ``rows``, which are kept meanwhile and then released; the result is a row for each penalty or slice and factor."""
    rows = rows.persist()
    try:
        found = of(rows)
        return rows.sparkSession.createDataFrame(found.collect(), found.schema)
    finally:
        rows.unpersist()


def lasso_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals(spark, sf_dir).select("date", "ticker", *FACTORS, "y5").dropna()
    found = _kept(rows, lambda rows: lasso_search(rows, FACTORS, "y5", ALPHAS))
    return found.select("alpha", F.round("rank_ic", 8).alias("rank_ic"), F.round("ir", 8).alias("ir"), "coefficients")


def fama_macbeth_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fama_macbeth(signals(spark, sf_dir), FACTORS, "y")


def egarch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return egarch_forecast(load_panel(spark, sf_dir, NATION_WEEK), EgarchSpec())


def hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    market = load_panel(spark, sf_dir, MONTH).where("logret IS NOT NULL").groupBy("date").agg(F.stddev_samp("logret").alias("value")).where("value IS NOT NULL")
    return hmm_probabilities(market, 48, partial=True)


def egarch_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market_volatility(load_panel(spark, sf_dir, NATION_WEEK))


def hmm_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regimes of the rolling market volatility, a row for each date that has one."""
    return hmm_probabilities(egarch_market(spark, sf_dir).select("date", F.col("sigma").alias("value")), 48, partial=True)


def search_panel(spark: SparkSession, sf_dir: str, features: tuple[str, ...], folder: str) -> BlockPanel:
    """Blocks of supplier weeks: standardised features of the day before, beta, log cap, sector, and ``y``, the return over the next five weeks."""
    bars = save_bars(spark, sf_dir, FILLED_WEEK, f"{folder}/bars")
    outputs = {f: zscore(delay(FEATURES[f], 1), 2) for f in features}
    outputs |= {"beta": BETA, "ln_cap": ln(col("mcap")), "sector": col("sector"), "y": fwd_sum(col("logret"), 5)}
    return compute_blocks(bars, filled_columns, outputs, f"{folder}/panel", "sector")


def formula_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evolve_blocks(search_panel(spark, sf_dir, TERMINALS, shared_folder(spark, "search")), TERMINALS, SEARCH)
    rows = [astuple(f) for f in found]
    return spark.createDataFrame(rows, "formula string, adjusted double, objective double, t double, validation_t double, mean_ic double, complexity int, generations int")


def slice_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain over slices: all 24 features screened, regressed on 80 penalties, the full search budget, holdout scores."""
    features, folder = tuple(FEATURES), shared_folder(spark, "slices")
    panel = search_panel(spark, sf_dir, features, folder)
    return search_slices(panel, features, "y", ALPHAS, ScreenSpec(train=208, least_train=170, every=104, holdout=52, least_abs_mean=0.0), SEARCH, folder)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax weights of the five best names a week, the lower half by variation as leg 2."""
    found = signals(spark, sf_dir).select("date", "ticker", F.col("close").alias("price"), F.col("s4").alias("s"), F.abs("logret").alias("v"))
    return spark.sql("""
      WITH r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY s DESC NULLS LAST, ticker) AS r, percent_rank() OVER (PARTITION BY date ORDER BY v) AS p FROM {found}),
      e AS (SELECT *, CASE WHEN r <= 5 AND s IS NOT NULL THEN exp(1.4 * (s - max(s) OVER (PARTITION BY date))) END AS e FROM r)
      SELECT date, ticker, price, coalesce(e / nullif(sum(e) OVER (PARTITION BY date), 0), 0) AS weight, CASE WHEN p <= 0.5 THEN 1.0 ELSE 2.0 END AS leg FROM e""", found=found)


def engine_single_leg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate(_orders(spark, sf_dir), [SingleLeg(f"hold{h}", hold=h) for h in (1, 2, 4)])


def engine_dual_leg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate(_orders(spark, sf_dir), [DualLeg(), DualLeg("tight", stop=0.03, drawdown=0.05)])


def engine_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate(_orders(spark, sf_dir), [Lots()])


def stream_daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_available(daily_bars(read_events(spark, sf_dir)))


STREAM_ORACLE = """SELECT CAST(date_trunc('day', ts) AS DATE) AS date, user_id, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, row(ts, event_id)) AS close, count(*) AS n FROM events GROUP BY 1, 2"""

register("lasso_path", lasso_path)
register("famamacbeth", fama_macbeth_query)
register("egarch_sigma", egarch)
register("hmm_probs", hmm)
register("egarch_market_volatility", egarch_market)
register("hmm_market_regimes", hmm_market)
register("gp_generation", formula_search)
register("walk_forward_search", slice_search)
register("engine_single_leg", engine_single_leg)
register("engine_dual_leg", engine_dual_leg)
register("engine_lots", engine_lots)
register("stream_daily_bars", stream_daily_bars, STREAM_ORACLE)


def walk_forward_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals(spark, sf_dir).select("date", "ticker", *FACTORS, "y5")
    return _kept(rows, lambda rows: screen(rows, FACTORS, "y5", ScreenSpec(stability_window=60, stability_run=60)))


def signal_bank_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals(spark, sf_dir).select("date", "ticker", *FACTORS, "y5")
    screened = _kept(rows, lambda rows: screen(rows, FACTORS, "y5", ScreenSpec(least_abs_mean=0.0)))
    return signal_bank(rows.drop("y5"), screened, slices(rows, ScreenSpec()))


def walk_forward_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screening and sparse regression chained over all slices: the penalty and factors taken in each."""
    rows = signals(spark, sf_dir).select("date", "ticker", *FACTORS, "y5")
    found = _kept(rows, lambda rows: walk_forward(rows, FACTORS, "y5", ALPHAS, ScreenSpec(every=104, least_abs_mean=0.0))[0])
    return found.select("slice", "factor", F.round("coefficient", 8).alias("coefficient"), "alpha", F.round("rank_ic", 8).alias("rank_ic"), F.round("ir", 8).alias("ir"))


def lasso_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choose(lasso_path(spark, sf_dir))


def regime_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On how many dates each regime is likelier than not."""
    found = hmm(spark, sf_dir)
    return found.agg(*[F.count(F.when(F.col(c) > 0.5, 1)).alias(f"n_{c}") for c in found.columns if c != "date"], F.count("*").alias("n"))


def engine_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate_trades(_orders(spark, sf_dir), [SingleLeg("hold2", hold=2), DualLeg(), DualLeg("tight", stop=0.03, drawdown=0.05)])


def barra_neutral(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals(spark, sf_dir).withColumn("ln_cap", F.log(F.when(F.col("mcap") > 0, F.col("mcap"))))
    return neutralize(rows, "s4", ("ln_cap", "s5"), "sector")


def blotter_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = simulate(_orders(spark, sf_dir), [SingleLeg(f"hold{h}", hold=h) for h in (1, 4)] + [Lots()])
    return days.groupBy("scenario", F.year("date").alias("year")).agg(
        F.sum("n_bought").alias("bought"), F.sum("n_sold").alias("sold"), F.sum("n_failed").alias("failed"), F.max_by("nav", "date").alias("nav"), F.avg(1 - F.col("cash") / F.col("nav")).alias("used")
    )


register("walk_forward_screen", walk_forward_screen)
register("signal_bank", signal_bank_query)
register("walk_forward_choice", walk_forward_choice)
register("lasso_choice", lasso_choice)
register("hmm_regime_counts", regime_counts)
register("engine_trades", engine_trades)
register("barra_neutral", barra_neutral)
register("blotter_daily", blotter_daily)


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lots of ``_orders`` in yearly stages, each with ``hold`` more dates to sell in."""
    rows = _orders(spark, sf_dir).withColumn("eligible", F.col("price").isNotNull())
    year = F.trunc("date", "year")
    stages = rows.groupBy(year.alias("stage")).agg(F.min("date").alias("first"), F.max("date").alias("last"))
    scenario = Lots()
    return ledger.lot_ledger(ledger.stage_rows(rows, stages, scenario.hold), [scenario])


for _name, _report in {
    "lot_orders": ledger.orders, "lot_trades": ledger.trades, "lot_sell_failures": ledger.sell_failures, "lot_table": ledger.lots,
    "lot_round_trips": ledger.round_trips, "lot_execution_daily": ledger.execution_daily,
}.items():
    register(_name, lambda spark, sf_dir, report=_report: report(_ledger(spark, sf_dir)))
