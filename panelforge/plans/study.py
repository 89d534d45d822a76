"""Queries on whole sets of signals, regimes and slices: the operators of :mod:`..operators.statistics` beside SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dag import DUCK, SPARK, Dialect, compute
from ..functions.distributions import normal_tail, partial_autocorrelations, t_quantile95, t_tail
from ..functions.features import FEATURES
from ..functions.ops import col, fwd_sum
from ..operators.engines import DualLeg, simulate, simulate_trades
from ..operators.evaluation import shared_folder
from ..operators.panel import NATION_WEEK, load_panel
from ..operators.statistics import holdout_returns, regime_legs, spearman_pairs, split_by_clock
from ..operators.walkforward import ScreenSpec, in_training, lasso_choices, screen, slices
from ..sources.loading import create_table, insert_by_symbol, read_table
from .catalog import _formula_output, register, rounded
from .formulas import FORMULAS
from .library import FACTORS, _frames, _hac, _ic, _newey_west, corr, duck_text, sql_query

# ---------------------------------------------------------------- tests of means by Student's t


def _acf(lags: int) -> str:
    """acf(factor, n, r): autocorrelations from lag 1 on, each covariance over its own number of pairs."""
    terms = ", ".join(f"sum(u * u{k}) / (count(*) - {k}) / nullif(sum(u * u) / count(*), 0)" for k in range(1, lags + 1))
    return f"acf AS (SELECT factor, count(*) AS n, {{array}}({terms}) AS r, {', '.join(f'sum(u * u{k}) / nullif(sum(u * u), 0) AS r{k}' for k in range(1, 6))} FROM lagged GROUP BY factor)"


def _pacf(d: Dialect, lags: int) -> str:
    """pacf(factor, n, out): partial autocorrelations of lags 1 to ``lags``, by Durbin and Levinson."""
    acf = _acf(lags).replace("{array}", "array" if d.spark else "list_value")
    if d.spark:
        return f"{acf}, pacf AS (SELECT factor, n, {partial_autocorrelations('r')} AS out FROM acf)"
    dot = lambda right: f"coalesce(list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * {right})), 0)"
    return f"""{acf}, walk AS (
  SELECT factor, n, r, 0 AS k, CAST([] AS DOUBLE[]) AS phi, CAST([] AS DOUBLE[]) AS out FROM acf
  UNION ALL
  SELECT factor, n, r, k + 1, list_concat(list_transform(range(1, k + 1), lambda j: phi[j] - p * phi[k + 1 - j]), [p]), list_concat(out, [p])
  FROM (SELECT *, (r[k + 1] - {dot('r[k + 1 - j]')}) / nullif(1 - {dot('r[j]')}, 0) AS p FROM walk WHERE k < {lags})),
pacf AS (SELECT factor, n, out FROM walk WHERE k = {lags})"""


def _recursive(d: Dialect) -> str:
    return "WITH" if d.spark else "WITH RECURSIVE"


def _unnested(d: Dialect) -> str:
    return "LATERAL VIEW posexplode(out) e AS lag0, pacf" if d.spark else "CROSS JOIN LATERAL (SELECT unnest(range(20)) AS lag0, unnest(out) AS pacf) e"


sql_query("pacf_lags", lambda d: f"""{_recursive(d)} {_ic(d)}, {_newey_west(20)}, {_pacf(d, 20)}
SELECT factor, CAST(lag0 + 1 AS INT) AS lag, {rounded('pacf')} AS pacf, abs(pacf) > 1.96 / sqrt(n) AS beyond FROM pacf {_unnested(d)}""")  # fmt: skip


def _tested(d: Dialect, source: str) -> str:
    """Columns of a one-sided test of ``mean`` with standard error ``se`` of ``n`` values, in the direction of the mean."""
    tail = t_tail(d, "abs(mean / nullif(se, 0))", "CAST(n - 1 AS DOUBLE)")
    critical = t_quantile95("CAST(n - 1 AS DOUBLE)")
    return f"""SELECT *, {tail} AS p, {critical} AS critical FROM {source}"""


sql_query("alpha_significance", lambda d: f"""WITH {_ic(d)}, {_hac(5)}, tested AS ({_tested(d, 'hac')})
SELECT factor, n, {rounded('mean')} AS mean, {rounded('mean / nullif(se, 0)')} AS t, {rounded('p')} AS p_value, {rounded('CASE WHEN mean >= 0 THEN mean - critical * se END')} AS ci_lower,
       {rounded('CASE WHEN mean < 0 THEN mean + critical * se END')} AS ci_upper, p < 0.05 AS reject FROM tested""")  # fmt: skip
#: The robust error if any of the first five autocorrelations or partial ones passes the bound of white noise.
sql_query("adaptive_significance", lambda d: f"""{_recursive(d)} {_ic(d)}, {_newey_west(5)}, {_pacf(d, 5)},
{_hac(5).replace('dev AS', 'hac_dev AS').replace('FROM dev', 'FROM hac_dev').replace('lagged AS', 'hac_lagged AS').replace('FROM lagged', 'FROM hac_lagged')},
plain AS (SELECT factor, count(*) AS n, avg(ic) AS mean, stddev_samp(ic) / sqrt(count(*)) AS se FROM ic WHERE ic IS NOT NULL GROUP BY factor),
rule AS (SELECT acf.factor, greatest({', '.join(f'abs(r{k})' for k in range(1, 6))}) > 1.96 / sqrt(acf.n) OR greatest({', '.join(f"abs(out[{k - d.spark}])" for k in range(1, 6))}) > 1.96 / sqrt(acf.n) AS robust
         FROM acf JOIN pacf ON pacf.factor = acf.factor),
chosen AS (SELECT plain.factor, plain.n, plain.mean, robust, CASE WHEN robust THEN hac.se ELSE plain.se END AS se FROM plain JOIN rule ON rule.factor = plain.factor JOIN hac ON hac.factor = plain.factor),
tested AS ({_tested(d, 'chosen')})
SELECT factor, n, {rounded('mean')} AS mean, robust, {rounded('mean / nullif(se, 0)')} AS t, {rounded('p')} AS p_value, p < 0.05 AS reject FROM tested""")  # fmt: skip

#: H1: the mean return is positive; lags by the rule 4 (n / 100) ^ (2 / 9), at least one and at most 24, which is enough for 300,000 dates.
_LAGS = range(1, 25)
sql_query("nw_one_sided", lambda d: f"""WITH mkt AS (SELECT date, avg(logret) AS r FROM {{month}} WHERE logret IS NOT NULL GROUP BY date),
s AS (SELECT date, r, r - avg(r) OVER () AS u, count(*) OVER () AS n FROM mkt),
l AS (SELECT *, greatest(1, least(CAST(floor(4 * power(n / CAST(100 AS DOUBLE), 2 / CAST(9 AS DOUBLE))) AS INT), CAST(n AS INT) - 1)) AS lags, {', '.join(f'lag(u, {k}) OVER (ORDER BY date) AS u{k}' for k in _LAGS)} FROM s),
c AS (SELECT count(*) AS n, max(lags) AS lags, avg(r) AS mean, stddev_samp(r) AS sd,
      (sum(u * u) + {' + '.join(f'coalesce(sum(CASE WHEN lags >= {k} THEN 2 * (1 - {k} / CAST(lags + 1 AS DOUBLE)) * u * u{k} END), 0)' for k in _LAGS)}) / count(*) AS spread FROM l),
t AS (SELECT *, CASE WHEN n >= 10 AND spread > 0 THEN mean / sqrt(spread / n) END AS t FROM c)
SELECT n, lags, {rounded('mean')} AS mean, {rounded('sd')} AS sd, {rounded('t')} AS t, {rounded(normal_tail('t'))} AS p_one_sided FROM t""")  # fmt: skip


# ---------------------------------------------------------------- pairs of signals


def _pairs_of(d: Dialect) -> str:
    pairs = [(a, b) for i, a in enumerate(FACTORS) for b in FACTORS[i + 1 :]]
    count = lambda a, b: f"count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END)"
    wide = ", ".join(f"{count(a, b)} AS n_{a}_{b}, CASE WHEN {count(a, b)} >= 200 THEN {corr(a, b)} END AS c_{a}_{b}" for a, b in pairs)
    rows = ", ".join(f"{'named_struct' if d.spark else ''}({', '.join(([f'{chr(39)}a{chr(39)}'] if d.spark else []) + [f'{chr(39)}{a}{chr(39)}'] + ([f'{chr(39)}b{chr(39)}'] if d.spark else []) + [f'{chr(39)}{b}{chr(39)}'] + ([f'{chr(39)}pairs{chr(39)}'] if d.spark else []) + [f'n_{a}_{b}'] + ([f'{chr(39)}c{chr(39)}'] if d.spark else []) + [f'c_{a}_{b}'])})" for a, b in pairs)
    lateral = f"LATERAL VIEW inline(array({rows})) e AS a, b, pairs, c" if d.spark else f"CROSS JOIN LATERAL (VALUES {rows}) e(a, b, pairs, c)"
    return f"WITH wide AS (SELECT {wide} FROM {{signals}}) SELECT a, b, pairs, {rounded('c')} AS corr FROM wide {lateral}"


sql_query("pair_corr_min_pairs", _pairs_of)


def frame_query(name: str, frame: str, build: Callable[[SparkSession, DataFrame], DataFrame], twin: str) -> None:
    """A query over a computed panel of the library, with SQL of its own for DuckDB."""
    spec, outputs, keep = _frames[frame]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(spark, compute(load_panel(spark, sf_dir, spec), outputs, keep=keep))

    register(name, query, duck_text(twin, [frame]))


def _average_rank(x: str) -> str:
    return f"(rank() OVER (ORDER BY {x}) + (count(*) OVER (ORDER BY {x} RANGE BETWEEN CURRENT ROW AND CURRENT ROW) - 1) / CAST(2 AS DOUBLE))"


frame_query(
    "spearman_matrix", "signals",
    lambda spark, rows: spearman_pairs(rows, FACTORS).select("a", "b", "n", F.expr(rounded("rho")).alias("rho")),
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, {rounded(corr('x', 'y'))} AS rho FROM (SELECT {_average_rank(f'round({a}, 9)')} AS x, {_average_rank(f'round({b}, 9)')} AS y FROM {{signals}} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
        for i, a in enumerate(FACTORS) for b in FACTORS[i + 1 :]
    ),
)

# ---------------------------------------------------------------- legs by regimes

#: Regimes by the rank of the day's spread of returns, known on the first week of a month only.
_REGIMES = """SELECT date, greatest(0, 1 - 2 * p) AS prob_low, 1 - greatest(0, 1 - 2 * p) - greatest(0, 2 * p - 1) AS prob_mid, greatest(0, 2 * p - 1) AS prob_high
FROM (SELECT date, percent_rank() OVER (ORDER BY round(v, 9)) AS p FROM (SELECT date, stddev_samp(logret) AS v FROM {signals} WHERE logret IS NOT NULL GROUP BY date) WHERE v IS NOT NULL) WHERE extract(day FROM date) <= 7"""
_SCORED = """SELECT date, ticker, CASE WHEN stddev_samp(s4) OVER w > 1e-12 THEN (s4 - avg(s4) OVER w) / nullif(stddev_samp(s4) OVER w, 0) END AS s, abs(logret) AS v FROM {signals} WINDOW w AS (PARTITION BY date)"""


def scored(spark: SparkSession, signals: DataFrame) -> DataFrame:
    return spark.sql(_SCORED, signals=signals)


def _legs(spark: SparkSession, signals: DataFrame) -> DataFrame:
    found = regime_legs(scored(spark, signals), spark.sql(_REGIMES, signals=signals))
    return found.select("date", "ticker", "leg", F.expr(rounded("weight")).alias("weight"), "exit")


frame_query("dual_leg_regimes", "signals", _legs, f"""WITH regimes AS ({_REGIMES}), scored AS ({_SCORED}), known AS (SELECT * FROM scored WHERE s IS NOT NULL AND v IS NOT NULL),
days AS (SELECT DISTINCT date FROM known),
carried AS (SELECT d.date, coalesce(max_by(prob_low, r.date), 0) AS lo, coalesce(max_by(prob_mid, r.date), 0) AS mi, coalesce(max_by(prob_high, r.date), 0) AS hi FROM days d LEFT JOIN regimes r ON r.date <= d.date GROUP BY d.date),
split AS (SELECT k.date, ticker, s, least(1, greatest(0, lo * 0.2 + mi * 0.3 + hi * 0.5)) AS share, CASE WHEN v <= quantile_cont(v, 0.5) OVER (PARTITION BY k.date) THEN 1 ELSE 2 END AS leg FROM known k JOIN carried c ON c.date = k.date),
ranked AS (SELECT *, row_number() OVER (PARTITION BY date, leg ORDER BY round(s, 9) DESC, ticker) AS r, count(*) OVER (PARTITION BY date, leg) AS n FROM split),
inside AS (SELECT *, r <= CASE WHEN leg = 1 THEN greatest(floor(n * 0.3), 1) ELSE greatest(floor(n * 0.5), 5) END AS near FROM ranked),
marked AS (SELECT *, near AND (leg = 1 OR round(s, 9) > 1.8) AS picked, near AND leg = 2 AND round(s, 9) < -0.1 AS exit FROM inside),
lifted AS (SELECT *, CASE WHEN picked THEN exp(CASE WHEN leg = 1 THEN 5 ELSE 2 END * (s - max(CASE WHEN picked THEN s END) OVER (PARTITION BY date, leg))) END AS e FROM marked)
SELECT date, ticker, leg, {rounded('coalesce(CASE WHEN leg = 1 THEN share ELSE 1 - share END * e / nullif(sum(e) OVER (PARTITION BY date, leg), 0), 0)')} AS weight, exit FROM lifted""")  # fmt: skip


def _regime_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights and exit flags of legs that follow the hidden Markov regimes of the market."""
    from .modelling import hmm_market, signals

    rows = signals(spark, sf_dir)
    regimes = hmm_market(spark, sf_dir).withColumnsRenamed({"p0": "prob_low", "p1": "prob_mid", "p2": "prob_high"})
    found = regime_legs(scored(spark, rows), regimes)
    prices = rows.select("date", "ticker", F.col("close").alias("price"))
    whole = prices.join(found, ["date", "ticker"], "left")
    return whole.select("date", "ticker", "price", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("leg", F.lit(2)).cast("double").alias("leg"), F.coalesce("exit", F.lit(False)).alias("exit"))


register("engine_dual_leg_regimes", lambda spark, sf_dir: simulate(_regime_orders(spark, sf_dir), [DualLeg()]))
register("engine_trades_regimes", lambda spark, sf_dir: simulate_trades(_regime_orders(spark, sf_dir), [DualLeg()]))

# ---------------------------------------------------------------- backtests of overlapping holdouts

ALPHAS = np.logspace(-7, -2, 80)
#: Holdouts of 26 dates every 13, so that two slices cover most dates.
OVERLAP = ScreenSpec(every=13, holdout=26)
_KEPT = """SELECT slice, factor FROM {ic} ic JOIN {days} days ON days.date = ic.date JOIN {plan} plan ON days.i >= train_from AND days.i < train_to
WHERE ic IS NOT NULL GROUP BY slice, factor HAVING count(*) >= 60 AND avg(ic) >= 0.005"""


def _backtest(which: int) -> Callable[[SparkSession, DataFrame], DataFrame]:
    def build(spark: SparkSession, rows: DataFrame) -> DataFrame:
        plan = slices(rows, OVERLAP)
        ic = spark.sql(f"WITH {_ic(SPARK)} SELECT * FROM ic", signals=rows)
        days = spark.sql("SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM {signals})", signals=rows)
        kept = spark.sql(_KEPT, ic=ic, days=days, plan=plan)
        report, pooled = holdout_returns(rows.select("date", "ticker", *FACTORS, "y"), kept, plan, "y")
        if which == 0:
            return report.select("slice", "n", F.expr(rounded("mean")).alias("mean"), F.expr(rounded("t")).alias("t"), "passed")
        return pooled.select("date", F.expr(rounded("ret")).alias("ret"), "slices")

    return build


def _backtest_sql(final: str) -> str:
    lags = range(1, 11)
    columns = " UNION ALL ".join(f"SELECT slice, date, i, ticker, y, '{f}' AS factor, {f} AS x FROM held" for f in FACTORS)
    sd = "stddev_samp(x) OVER w"
    spread = " + ".join(f"2 * (1 - {k} / CAST(11 AS DOUBLE)) * coalesce(sum(u * u{k}), 0)" for k in lags)
    return f"""WITH {_ic(DUCK)}, days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM {{signals}})),
plan AS (SELECT CAST((i - {OVERLAP.least_train + OVERLAP.purge}) // {OVERLAP.every} AS INT) AS slice, greatest(0, i - {OVERLAP.purge + OVERLAP.train}) AS train_from, i - {OVERLAP.purge} AS train_to, i AS hold_from, least(n, i + {OVERLAP.holdout}) AS hold_to
  FROM days WHERE i >= {OVERLAP.least_train + OVERLAP.purge} AND i < n - 1 AND (i - {OVERLAP.least_train + OVERLAP.purge}) % {OVERLAP.every} = 0),
kept AS ({_KEPT.format(ic='ic', days='days', plan='plan')}),
held AS (SELECT slice, d.i, s.* FROM {{signals}} s JOIN days d ON d.date = s.date JOIN plan ON d.i >= hold_from AND d.i < hold_to),
long AS (SELECT l.* FROM ({columns}) l JOIN kept ON kept.slice = l.slice AND kept.factor = l.factor WHERE x IS NOT NULL),
z AS (SELECT *, CASE WHEN {sd} > 1e-12 THEN (x - avg(x) OVER w) / nullif({sd}, 0) END AS z FROM long WINDOW w AS (PARTITION BY slice, factor, date)),
composite AS (SELECT slice, date, i, ticker, avg(z) AS s, max(y) AS y FROM z GROUP BY 1, 2, 3, 4 HAVING avg(z) IS NOT NULL AND max(y) IS NOT NULL),
centred AS (SELECT *, s - avg(s) OVER (PARTITION BY slice, date) AS c FROM composite),
daily AS (SELECT slice, date, i, sum(c * y) / nullif(sum(abs(c)), 0) AS ret FROM centred GROUP BY 1, 2, 3 HAVING count(*) >= 10),
dev AS (SELECT *, ret - avg(ret) OVER (PARTITION BY slice) AS u FROM daily WHERE ret IS NOT NULL),
lagged AS (SELECT *, {', '.join(f'lag(u, {k}) OVER (PARTITION BY slice ORDER BY i) AS u{k}' for k in lags)} FROM dev),
tested AS (SELECT slice, count(*) AS n, avg(ret) AS mean, avg(ret) / nullif(sqrt(greatest(sum(u * u) + {spread}, 0)) / count(*), 0) AS t FROM lagged GROUP BY slice),
report AS (SELECT *, coalesce(mean > 0 OR t > 0, FALSE) AS passed FROM tested) {final}"""


frame_query("slice_backtest", "signals", _backtest(0), _backtest_sql(f"SELECT slice, n, {rounded('mean')} AS mean, {rounded('t')} AS t, passed FROM report"))
frame_query("slice_backtest_returns", "signals", _backtest(1), _backtest_sql(f"SELECT date, {rounded('avg(ret)')} AS ret, count(*) AS slices FROM daily JOIN report ON report.slice = daily.slice WHERE passed GROUP BY date"))

# ---------------------------------------------------------------- feeds


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("user_id") % 7).alias("part"), "ts")
    found = split_by_clock(feed, ["part", "ts", "event_id"], "ts")
    return found.groupBy("chunk").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


register("chunk_by_ts_drop", chunks, """WITH o AS (SELECT event_id, user_id % 7 AS part, ts FROM events), s AS (SELECT *, row_number() OVER (ORDER BY part, ts, event_id) AS i FROM o),
j AS (SELECT i, ts, CASE WHEN ts < lag(ts) OVER (ORDER BY i) THEN 1 ELSE 0 END AS jump FROM s), c AS (SELECT i, ts, sum(jump) OVER (ORDER BY i) AS chunk FROM j)
SELECT CAST(chunk AS BIGINT) AS chunk, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM c GROUP BY chunk""")  # fmt: skip

# ---------------------------------------------------------------- loads by symbol

_MONTHS = "SELECT CAST(l_suppkey AS VARCHAR(20)) AS symbol, CAST(date_trunc('month', l_shipdate) AS DATE) AS trade_date, CAST(sum(l_quantity) AS DOUBLE) AS volume, count(*) AS n FROM {lineitem} WHERE l_suppkey IS NOT NULL AND l_shipdate IS NOT NULL GROUP BY 1, 2"


def symbol_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads of the months of each supplier; in the second one, those in debt bring a month that the table has, and stay as they were."""
    path = f"{shared_folder(spark, 'load')}/bars"
    create_table(spark, path, "symbol string, trade_date date, volume double, n long")
    months = spark.sql(_MONTHS, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    debt = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("symbol"), (F.col("s_acctbal") < 0).alias("debt"))
    keys = ("symbol", "trade_date")
    insert_by_symbol(spark, path, months.where("trade_date < DATE'1998-01-01'"), keys, ("volume",))
    later = months.join(debt, "symbol", "left").where("trade_date >= DATE'1998-01-01' OR (debt AND trade_date = DATE'1997-12-01')").drop("debt")
    insert_by_symbol(spark, path, later, keys, ("volume",))
    return read_table(spark, path).select("symbol", "trade_date", "volume", "n")


register("symbol_load", symbol_load, f"""WITH m AS ({_MONTHS.replace('{lineitem}', 'lineitem')}), debt AS (SELECT CAST(s_suppkey AS VARCHAR) AS symbol FROM supplier WHERE s_acctbal < 0)
SELECT symbol, trade_date, volume, n FROM m WHERE trade_date < DATE '1998-01-01' OR symbol NOT IN (SELECT m.symbol FROM m JOIN debt ON debt.symbol = m.symbol WHERE trade_date = DATE '1997-12-01')""")  # fmt: skip

# ---------------------------------------------------------------- all signals at once

EVERY = dict(_formula_output(n) for n in sorted(FORMULAS)) | FEATURES


def every_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, ticker, the 101 formulas and the 24 features, and the return over the next five weeks; written once."""
    path = shared_folder(spark, "signals")
    compute(load_panel(spark, sf_dir, NATION_WEEK), EVERY | {"y5": fwd_sum(col("logret"), 5)}).write.parquet(path)
    return spark.read.parquet(path)


def screen_every_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screening, pruning and sparse regression over all 125 signals in every slice: a row for each slice and signal.

    Not registered: it has not been seen to end yet (see the README).
    """
    rows = every_signal(spark, sf_dir)
    spec = ScreenSpec(train=150, every=52, least_abs_mean=0.0)
    screened = screen(rows, tuple(EVERY), "y5", spec)
    kept: dict[int, list[str]] = {}
    for r in screened.where("kept").select("slice", "factor").collect():
        kept.setdefault(r["slice"], []).append(r["factor"])
    days = rows.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)
    chosen = {k: tuple(sorted(v)) for k, v in kept.items()}
    best = lasso_choices(in_training(rows, days, slices(rows, spec)), chosen, "y5", ALPHAS, spec.purge)
    lines = [(b["slice"], f, float(c), b["alpha"]) for b in best for f, c in zip(chosen[b["slice"]], b["coefficients"], strict=True)]
    taken = spark.createDataFrame(lines, "slice int, factor string, coefficient double, alpha double")
    found = screened.join(F.broadcast(taken), ["slice", "factor"], "left")
    return found.select("slice", "factor", "n", *[F.round(c, 6).alias(c) for c in ("mean", "mean_oos", "t", "t_oos", "mean_hold")], "passed", "kept", F.round("coefficient", 8).alias("coefficient"), "alpha")

