"""Leak-free walk-forward work: slices, screening, neutralisation on several regressors, signal banks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .grams import correlations, sliced_lasso
from .models import greedy_prune


@dataclass(frozen=True)
class ScreenSpec:
    train: int = 120
    least_train: int = 80
    holdout: int = 13
    every: int = 26
    purge: int = 5
    oos_share: float = 0.3
    least_days: int = 60
    least_oos: int = 20
    least_abs_mean: float = 0.0005
    corr_limit: float = 0.85
    most: int = 60
    lags: int = 10
    #: Rolling mean of ICs over so many dates; a factor fails that stays under the level for so many in a row (0: no such gate).
    stability_window: int = 0
    stability_level: float = 0.0005
    stability_run: int = 252
    least_pairs: int = 200


def slices(dates: DataFrame, spec: ScreenSpec) -> DataFrame:
    """A row for each rebalance date: slice, and the calendar positions of training and holdout rows.

    Training ends ``purge`` rows before the rebalance, so no forward target reaches into the holdout.
    """
    n = dates.select("date").distinct().count()
    spark = dates.sparkSession
    at = [i for i in range(spec.least_train + spec.purge, n - 1, spec.every)]
    return spark.createDataFrame(
        [(k, max(0, i - spec.purge - spec.train), i - spec.purge, i, min(n, i + spec.holdout)) for k, i in enumerate(at)] or [(0, 0, 0, 0, 0)],
        "slice int, train_from int, train_to int, hold_from int, hold_to int",
    ).where("hold_to > hold_from")


def newey_west_t(series: DataFrame, by: list[str], value: str, order: str, lags: int) -> DataFrame:
    """n, mean and Newey-West t (Bartlett weights, ``lags``) of ``value`` for each group of ``by``; null values are gaps that close up."""
    own = Window.partitionBy(*by)
    dev = series.where(F.col(value).isNotNull()).select(*by, order, F.col(value).alias("_x"), (F.col(value) - F.avg(value).over(own)).alias("_u"))
    lagged = dev.select("*", *[F.lag("_u", k).over(own.orderBy(order)).alias(f"_u{k}") for k in range(1, lags + 1)])
    spread = F.sum(F.col("_u") * F.col("_u"))
    for k in range(1, lags + 1):
        spread = spread + F.lit(2 * (1 - k / (lags + 1))) * F.coalesce(F.sum(F.col("_u") * F.col(f"_u{k}")), F.lit(0.0))
    per = lagged.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_x").alias("mean"), spread.alias("_s"))
    return per.select(*by, "n", "mean", (F.col("mean") / F.nullif(F.sqrt(F.greatest("_s", F.lit(0.0))) / F.col("n"), F.lit(0.0))).alias("t"))


def longest_low_run(series: DataFrame, by: list[str], value: str, order: str, window: int, level: float) -> DataFrame:
    """``longest``: the most dates in a row on which the mean of the last ``window`` values lies under ``level``."""
    w = Window.partitionBy(*by).orderBy(order)
    roll = w.rowsBetween(1 - window, 0)
    low = series.select(*by, order, F.when(F.count(value).over(roll) == window, F.abs(F.avg(value).over(roll)) < level).alias("_low"), F.row_number().over(w).alias("_i")).where("_low")
    return low.withColumn("_island", F.col("_i") - F.row_number().over(w)).groupBy(*by, "_island").count().groupBy(*by).agg(F.max("count").alias("longest"))


def screen(signals: DataFrame, factors: tuple[str, ...], target: str, spec: ScreenSpec = ScreenSpec(), days: DataFrame | None = None) -> DataFrame:
    """For each slice and factor: statistics of its training ICs, whether it passes, whether pruning keeps it, and holdout IC.

    t and t_oos are Newey-West statistics of the training window and of its last part; the score
    puts t_oos first, then the size of the mean there, then t.  Null ICs are gaps.  All slices are
    scored in one job by a range join of the daily ICs with the slice table; the driver then prunes
    on the pairs of factors of a slice that are too alike, pairs with few common rows counting as unrelated.
    ``days`` (date and its place ``i``) saves a look for the dates of ``signals``.
    """
    long = signals.select("date", "ticker", F.col(target).alias("y"), F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("x")) for f in factors])).alias("e")).select("date", "y", "e.*")
    sd = F.stddev_samp("x") * F.stddev_samp("y")
    ic = long.where("x IS NOT NULL AND y IS NOT NULL").groupBy("date", "factor").agg(F.when(sd > 1e-12, F.covar_samp("x", "y") / F.nullif(sd, F.lit(0.0))).alias("ic"))
    pos = days if days is not None else signals.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)
    plan = F.broadcast(slices(pos, spec))
    placed = ic.join(pos, "date").where("ic IS NOT NULL")
    inside = placed.join(plan, (F.col("i") >= F.col("train_from")) & (F.col("i") < F.col("hold_to")))
    cut = F.col("train_to") - F.floor((F.col("train_to") - F.col("train_from")) * spec.oos_share)
    parts = F.filter(F.array(F.when(F.col("i") < F.col("train_to"), "full"), F.when((F.col("i") < F.col("train_to")) & (F.col("i") >= cut), "oos"), F.when(F.col("i") >= F.col("hold_from"), "hold")), lambda x: x.isNotNull())
    tested = newey_west_t(inside.select("slice", "factor", "i", "ic", F.explode(parts).alias("part")), ["slice", "factor", "part"], "ic", "i", spec.lags)
    of = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c)))
    per = tested.groupBy("slice", "factor").agg(
        F.coalesce(of("full", "n"), F.lit(0)).alias("n"), F.coalesce(of("oos", "n"), F.lit(0)).alias("n_oos"), of("full", "mean").alias("mean"), of("oos", "mean").alias("mean_oos"),
        of("full", "t").alias("t"), of("oos", "t").alias("t_oos"), of("hold", "mean").alias("mean_hold"),
    )
    agree = (F.signum("mean") == F.signum("mean_oos")) | (F.col("mean_oos") == 0)
    passed = (F.col("n") >= spec.least_days) & (F.col("n_oos") >= spec.least_oos) & agree & (F.abs("mean_oos") >= spec.least_abs_mean)
    if spec.stability_window:
        runs = longest_low_run(inside.where(F.col("i") < F.col("train_to")), ["slice", "factor"], "ic", "i", spec.stability_window, spec.stability_level)
        per = per.join(runs, ["slice", "factor"], "left")
        passed = passed & (F.coalesce("longest", F.lit(0)) < spec.stability_run)
        per = per.withColumn("passed", F.coalesce(passed, F.lit(False))).drop("longest")
    else:
        per = per.withColumn("passed", F.coalesce(passed, F.lit(False)))
    worst = F.lit(-1e9)
    scored = per.withColumn("score", F.coalesce("t_oos", worst) * 1e6 + F.coalesce(F.abs("mean_oos"), worst) * 1e4 + F.coalesce("t", worst))
    # A row for each slice and factor: collected, so that its two readers do not score the signals twice.
    scored = signals.sparkSession.createDataFrame(scored.collect(), scored.schema)
    by_slice = in_training(signals, pos, plan)
    passing = scored.where("passed").orderBy("slice", F.desc("score"), "factor").select("slice", "factor").collect()
    order: dict[int, list[str]] = {}
    for r in passing:
        order.setdefault(r["slice"], []).append(r["factor"])
    close = correlations(by_slice, "slice", tuple(factors), spec.least_pairs).where(F.abs("corr") > spec.corr_limit).collect() if len(factors) > 1 and order else []
    corr: dict[int, dict[tuple[str, str], float]] = {}
    for r in close:
        corr.setdefault(r["slice"], {})[r["a"], r["b"]] = r["corr"]
    kept = [(k, f) for k, names in order.items() for f in greedy_prune(names, corr.get(k, {}), spec.corr_limit, spec.most)]
    chosen = signals.sparkSession.createDataFrame(kept, "slice int, factor string").withColumn("kept", F.lit(True))
    return scored.join(F.broadcast(chosen), ["slice", "factor"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def in_training(signals: DataFrame, places: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows of each slice's training dates, with ``slice``; slices overlap, so a row can be in several."""
    return signals.join(F.broadcast(places), "date").join(F.broadcast(plan), (F.col("i") >= F.col("train_from")) & (F.col("i") < F.col("train_to"))).drop("i")


def residuals(y: np.ndarray, good: pd.DataFrame, regressors: tuple[str, ...], group: str, ridge: float = 1e-4, most_groups: int = 40) -> np.ndarray:
    """``y`` of the rows of one date less its ridge fit on a constant, regressors and dummies of the largest groups but the first."""
    sizes = good[group].dropna().value_counts()
    top = sorted(sorted(sizes.index, key=lambda g: (-sizes[g], g))[:most_groups])[1:]
    x = np.column_stack([np.ones(len(good)), *[good[r].to_numpy(float) for r in regressors], *[(good[group] == g).to_numpy(float) for g in top]])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 0
    beta = np.linalg.solve(x.T @ x + penalty + 1e-10 * np.eye(x.shape[1]), x.T @ y)
    return y - x @ beta


def neutralize(rows: DataFrame, value: str, regressors: tuple[str, ...], group: str, ridge: float = 1e-4, most_groups: int = 40, least: int = 10) -> DataFrame:
    """date, ticker and the residual of ``value`` on a constant, regressors and group dummies, date by date.

    The dummies are those of the ``most_groups`` largest groups of the date, the first left out.
    Rows with a missing input, and dates with fewer rows than ``least``, give no residual.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        good = pdf.dropna(subset=[value, *regressors])
        if len(good) < least:
            return pdf.iloc[:0][["date", "ticker"]].assign(residual=pd.Series(dtype=float))
        return pd.DataFrame({"date": good["date"], "ticker": good["ticker"], "residual": residuals(good[value].to_numpy(float), good, regressors, group, ridge, most_groups)})

    return rows.select("date", "ticker", value, *regressors, group).groupBy("date").applyInPandas(fit, "date date, ticker long, residual double")


def signal_bank(signals: DataFrame, kept: DataFrame, plan: DataFrame) -> DataFrame:
    """slice, date, ticker, signal (mean of the slice's kept factors, missing ones skipped) and z, on holdout dates only."""
    pos = signals.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)
    chosen = F.broadcast(kept.where("kept").groupBy("slice").agg(F.collect_set("factor").alias("factors")).join(plan, "slice"))
    names = [c for c in signals.columns if c not in ("date", "ticker")]
    values = F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).cast("double").alias("v")) for c in names])
    held = signals.join(pos, "date").join(chosen, (F.col("i") >= F.col("hold_from")) & (F.col("i") < F.col("hold_to")))
    used = F.filter(F.transform(F.filter(values, lambda s: F.array_contains("factors", s.f)), lambda s: s.v), lambda v: v.isNotNull())
    mean = F.when(F.size(used) > 0, F.aggregate(used, F.lit(0.0), lambda a, v: a + v) / F.size(used))
    day = Window.partitionBy("slice", "date")
    out = held.select("slice", "date", "ticker", mean.alias("signal"))
    return out.withColumn("z", (F.col("signal") - F.avg("signal").over(day)) / F.nullif(F.stddev_samp("signal").over(day), F.lit(0.0)))


def walk_forward(signals: DataFrame, factors: tuple[str, ...], target: str, alphas: np.ndarray, spec: ScreenSpec = ScreenSpec(), purge: int = 5) -> tuple[DataFrame, DataFrame]:
    """One call over all slices: screening, sparse regression on what it keeps, and the bank of holdout signals.

    Returns the choice of each slice (slice, factor, coefficient, alpha, rank_ic, ir) and the bank.  In
    a slice the penalty of the best rank IC is taken, of equal ones that of the better ratio, then
    the smaller one; factors with a coefficient enter the bank, all kept ones if none has.
    """
    spark = signals.sparkSession
    plan = slices(signals, spec)
    kept: dict[int, list[str]] = {}
    for r in screen(signals, factors, target, spec).where("kept").select("slice", "factor").collect():
        kept.setdefault(r["slice"], []).append(r["factor"])
    pos = signals.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)
    chosen = []
    for best in lasso_choices(in_training(signals, pos, plan), {k: tuple(sorted(v)) for k, v in kept.items()}, target, alphas, purge):
        names = sorted(kept[best["slice"]])
        used = [(f, c) for f, c in zip(names, best["coefficients"], strict=True) if abs(c) > 1e-12] or [(f, 0.0) for f in names]
        chosen += [(best["slice"], f, float(c), best["alpha"], best["rank_ic"], best["ir"]) for f, c in used]
    table = spark.createDataFrame(chosen, "slice int, factor string, coefficient double, alpha double, rank_ic double, ir double")
    return table, signal_bank(signals.drop(target), table.withColumn("kept", F.lit(True)), plan)


def lasso_choices(rows: DataFrame, chosen: dict[int, tuple[str, ...]], target: str, alphas: np.ndarray, gap: int) -> list:
    """The row of the penalty taken in each slice, in the order of slices; all slices in one search."""
    if not chosen:
        return []
    best = Window.partitionBy("slice").orderBy(F.desc_nulls_last(F.round("rank_ic", 9)), F.desc_nulls_last(F.round("ir", 9)), "alpha")
    return sliced_lasso(rows, chosen, target, alphas, gap=gap).withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r").orderBy("slice").collect()


def choose(path: DataFrame) -> DataFrame:
    """The row of a penalty path that is taken: best rank IC, then best ratio, then smallest penalty."""
    return path.orderBy(F.desc_nulls_last(F.round("rank_ic", 9)), F.desc_nulls_last(F.round("ir", 9)), "alpha").limit(1)
