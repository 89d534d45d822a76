"""Sums of products of many columns at once, and what needs no more: correlations and sparse regression.

A matrix of k columns has k * (k + 1) / 2 products, too many for one expression each once k is more
than a few dozen.  Here each task multiplies its rows as a matrix and keeps one sum for each group, and
the sums are added up in long form, a row for each group and pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .models import lasso_path

SUMS = ("n", "sa", "sb", "saa", "sbb", "sab")
#: Predictions (rows of a date by penalties) that a task ranks at once.
RANKED_CELLS = 1 << 19


def _matrix(batch: pa.RecordBatch, names: tuple[str, ...]) -> np.ndarray:
    found = np.column_stack([np.asarray(batch.column(c).to_numpy(zero_copy_only=False), dtype=np.float64) for c in names]) if len(names) else np.zeros((batch.num_rows, 0))
    return np.where(np.isfinite(found), found, np.nan)


def pair_sums(rows: DataFrame, by: str, names: tuple[str, ...]) -> DataFrame:
    """by, a, b (places in ``names``, a < b) and n, sa, sb, saa, sbb, sab over the rows where both are known.

    ``by`` is an integer column of few values: a task holds six matrices for each of them.
    """
    upper = np.triu_indices(len(names), 1)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            groups, x = batch.column(by).to_numpy(zero_copy_only=False), _matrix(batch, names)
            for g in np.unique(groups):
                own = x[groups == g]
                m = np.isfinite(own).astype(float)
                z = np.nan_to_num(own)
                found = np.array([(p.T @ q)[upper] for p, q in ((m, m), (z, m), (m, z), (z * z, m), (m, z * z), (z, z))])
                held[int(g)] = held.get(int(g), 0) + found
        for g, sums in held.items():
            columns = [pa.array(np.full(len(upper[0]), g), pa.int32()), pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), *[pa.array(s) for s in sums]]
            yield pa.RecordBatch.from_arrays(columns, names=[by, "a", "b", *SUMS])

    schema = f"`{by}` int, a int, b int, {', '.join(f'{s} double' for s in SUMS)}"
    found = rows.select(F.col(by).cast("int").alias(by), *[F.col(c).cast("double").alias(c) for c in names]).mapInArrow(part, schema)
    return found.groupBy(by, "a", "b").agg(*[F.sum(s).alias(s) for s in SUMS])


def correlations(rows: DataFrame, by: str, names: tuple[str, ...], least: int = 2) -> DataFrame:
    """by, a, b, n and Pearson's correlation of every pair of columns over their common rows; null below ``least`` rows."""
    cov = F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")
    spread = lambda s, ss: F.greatest(F.col(ss) - F.col(s) * F.col(s) / F.col("n"), F.lit(0.0))
    flat = (spread("sa", "saa") <= F.col("saa") * 1e-14) | (spread("sb", "sbb") <= F.col("sbb") * 1e-14)
    corr = F.when((F.col("n") >= least) & ~flat, cov / F.nullif(F.sqrt(spread("sa", "saa") * spread("sb", "sbb")), F.lit(0.0)))
    name = lambda c: F.element_at(F.array(*[F.lit(n) for n in names]), F.col(c) + 1).alias(c)
    return pair_sums(rows, by, names).where("n > 0").select(by, name("a"), name("b"), F.col("n").cast("long").alias("n"), corr.alias("corr"))


def folded(rows: DataFrame, chosen: dict[int, tuple[str, ...]], target: str, folds: int) -> DataFrame:
    """The rows that know ``target`` and the chosen columns of their slice, with ``i``, the place of the date among the slice's, ``days`` and ``fold``.

    Folds are blocks of dates of sizes that differ by one at most.
    """
    known = F.lit(False)
    for s, names in chosen.items():
        fits = F.col("slice") == s
        for c in (*names, target):
            fits = fits & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
        known = known | fits
    complete = rows.where(known)
    dates = complete.select("slice", "date").distinct()
    own = Window.partitionBy("slice")
    dates = dates.withColumn("i", F.row_number().over(own.orderBy("date")) - 1).withColumn("days", F.count("*").over(own).cast("int"))
    size, rest = F.floor(F.col("days") / folds), F.col("days") % folds
    long = rest * (size + 1)
    fold = F.when(F.col("i") < long, F.floor(F.col("i") / (size + 1))).otherwise(rest + F.floor((F.col("i") - long) / F.greatest(size, F.lit(1))))
    return complete.join(F.broadcast(dates.withColumn("fold", fold.cast("int"))), ["slice", "date"])


def fold_sums(placed: DataFrame, chosen: dict[int, tuple[str, ...]], target: str, folds: int, gap: int) -> DataFrame:
    """slice, fold, a, b and value: sums over the rows outside each purged fold (``folds``: all rows).

    a and b are places in the slice's columns and target; b is -1 for the sum of a column, both are -1 for
    the number of rows.  Training ends ``gap`` dates before a fold and begins ``gap`` after it.
    """
    columns = tuple(dict.fromkeys(c for names in chosen.values() for c in names))
    wide = (*columns, target)
    at = {s: [wide.index(c) for c in (*names, target)] for s, names in chosen.items()}

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            s, i, days = (batch.column(c).to_numpy(zero_copy_only=False).astype(int) for c in ("slice", "i", "days"))
            x = np.column_stack([_matrix(batch, wide), np.ones(batch.num_rows)])
            for g in np.unique(s):
                mine = s == g
                own, place, n = x[mine][:, [*at[int(g)], len(wide)]], i[mine], int(days[mine][0])
                size, rest = divmod(n, folds)
                for k in range(folds + 1):
                    first = k * size + min(k, rest)
                    last = first + size + (k < rest)
                    use = own[(place < first - gap) | (place >= last + gap)] if k < folds else own
                    held[int(g), k] = held.get((int(g), k), 0) + use.T @ use
        for (g, k), gram in held.items():
            a, b = np.triu_indices(len(gram))
            one = len(gram) - 1
            columns = [np.full(len(a), g, np.int32), np.full(len(a), k, np.int32), np.where(a == one, -1, a).astype(np.int32), np.where(b == one, -1, b).astype(np.int32), gram[a, b]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["slice", "fold", "a", "b", "value"])

    found = placed.select("slice", "i", "days", *[F.col(c).cast("double").alias(c) for c in wide]).mapInArrow(part, "slice int, fold int, a int, b int, value double")
    return found.groupBy("slice", "fold", "a", "b").agg(F.sum("value").alias("value"))


def as_gram(sums: pd.DataFrame) -> dict:
    """n, sum and gram (columns and target) from the rows of one slice and fold."""
    a, b, value = sums["a"].to_numpy(), sums["b"].to_numpy(), sums["value"].to_numpy()
    size = int(a.max()) + 1
    gram, total = np.zeros((size, size)), np.zeros(size)
    inner, single = b >= 0, (b < 0) & (a >= 0)
    gram[a[inner], b[inner]] = gram[b[inner], a[inner]] = value[inner]
    total[a[single]] = value[single]
    return {"n": float(value[a < 0].sum()), "sum": total, "gram": gram}


def rank_ics(x: np.ndarray, lines: np.ndarray, y: pd.Series) -> np.ndarray:
    """Rank correlation with ``y`` of the predictions of each of ``lines``, some of them at a time; nan without spread."""
    b = y.rank().to_numpy()
    b = b - b.mean()
    out, most = np.full(len(lines), np.nan), max(1, RANKED_CELLS // max(1, len(x)))
    for k in range(0, len(lines), most):
        a = pd.DataFrame(np.round(x @ lines[k : k + most].T, 12)).rank().to_numpy()
        a = a - a.mean(axis=0)
        spread = np.sqrt((a * a).sum(axis=0) * (b * b).sum())
        out[k : k + most] = np.where(spread > 0, (a * b[:, None]).sum(axis=0) / np.where(spread > 0, spread, 1.0), np.nan)
    return out


def sliced_lasso(rows: DataFrame, chosen: dict[int, tuple[str, ...]], target: str, alphas: np.ndarray, folds: int = 5, gap: int = 5) -> DataFrame:
    """slice, alpha, rank_ic, ir and coefficients (in the order of the slice's columns) for every slice of ``chosen``.

    One pass over the rows for all slices, folds and products, one fit a slice and fold in parallel, and
    one pass that ranks the out-of-fold predictions of all penalties and the target on each date.
    rank_ic is the mean over dates, a date without spread counting as zero; ir is that of the others over
    their deviation.  The driver holds the lines: slices x folds x penalties x columns numbers.
    """
    placed = folded(rows, chosen, target, folds)
    sums = fold_sums(placed, chosen, target, folds, gap)
    penalties = np.asarray(alphas, dtype=float)

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        gram = as_gram(pdf)
        coef, mean, sd = lasso_path(gram, penalties)
        slopes = coef / sd
        constant = mean[-1] - (mean[:-1] * slopes).sum(axis=1)
        return pd.DataFrame({"slice": key[0], "fold": key[1], "a": range(len(penalties)), "line": [[float(c), *map(float, s)] for c, s in zip(constant, slopes, strict=True)], "coef": [list(map(float, c)) for c in coef]})

    fitted = sums.groupBy("slice", "fold").applyInPandas(fit, "slice int, fold int, a int, line array<double>, coef array<double>").collect()
    spark = rows.sparkSession
    lines: dict[tuple[int, int], list] = {}
    for r in sorted(fitted, key=lambda r: r["a"]):
        lines.setdefault((r["slice"], r["fold"]), []).append(r["line"])
    shared = spark.sparkContext.broadcast({k: np.array(v) for k, v in lines.items()})

    def rank(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        s, names = int(key[0]), chosen[int(key[0])]
        line = shared.value[s, int(pdf["fold"].iloc[0])]
        x = np.column_stack([np.ones(len(pdf)), *[pdf[c].to_numpy(float) for c in names]])
        return pd.DataFrame({"slice": s, "a": range(len(line)), "ic": rank_ics(x, line, pdf[target])})

    used = placed.select("slice", "date", "fold", target, *dict.fromkeys(c for names in chosen.values() for c in names))
    ic = used.groupBy("slice", "date").applyInPandas(rank, "slice int, a int, ic double").withColumn("ic", F.nanvl("ic", F.lit(None).cast("double")))
    per = ic.groupBy("slice", "a").agg(F.avg(F.coalesce("ic", F.lit(0.0))).alias("rank_ic"), (F.avg("ic") / F.nullif(F.stddev_samp("ic"), F.lit(0.0))).alias("ir"))
    whole = [(r["slice"], r["a"], float(penalties[r["a"]]), list(r["coef"])) for r in fitted if r["fold"] == folds]
    table = spark.createDataFrame(whole, "slice int, a int, alpha double, coefficients array<double>")
    return table.join(per, ["slice", "a"]).select("slice", "alpha", "rank_ic", "ir", "coefficients")


def lasso_search(rows: DataFrame, features: tuple[str, ...], target: str, alphas: np.ndarray, folds: int = 5, gap: int = 5) -> DataFrame:
    """alpha, rank_ic, ir and coefficients over all rows: :func:`sliced_lasso` of one slice."""
    return sliced_lasso(rows.withColumn("slice", F.lit(0)), {0: tuple(features)}, target, alphas, folds, gap).drop("slice")
