"""Statistics that need more than one aggregate: rank correlations of pairs, regime-driven legs, holdout backtests, clock chunks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .evaluation import shared_folder
from .walkforward import newey_west_t

#: Parts that a column is cut into for ranks; ranks within a part need its rows only.
PARTS = 256


def _cuts(rows: DataFrame, columns: tuple[str, ...]) -> dict[str, list[float]]:
    found = rows.approxQuantile(list(columns), [k / PARTS for k in range(1, PARTS)], 0.25 / PARTS)
    return {c: sorted(set(q)) for c, q in zip(columns, found, strict=True)}


def _part(value: Column, cuts: list[float]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]).cast("array<double>"), lambda e: e < value))


def _ranked(rows: DataFrame, side: str) -> DataFrame:
    """Adds r_<side>, the rank among the rows of the pair with the mean for ties, from ranks within parts and the sizes of the parts below."""
    own, part = f"x_{side}", f"p_{side}"
    sizes = rows.groupBy("a", "b", part).agg(F.count("*").alias("_n"))
    below = Window.partitionBy("a", "b").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_below", F.coalesce(F.sum("_n").over(below), F.lit(0))).drop("_n")
    w = Window.partitionBy("a", "b", part).orderBy(own)
    inside = F.rank().over(w) + (F.count("*").over(w.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / 2
    return rows.withColumn("_r", inside).join(F.broadcast(offsets), ["a", "b", part]).withColumn(f"r_{side}", F.col("_r") + F.col("_below")).drop("_r", "_below", own, part)


def spearman_pairs(rows: DataFrame, columns: tuple[str, ...], digits: int = 9) -> DataFrame:
    """a, b, n and the rank correlation of every pair of columns, ranked anew on the rows where both are known.

    Each row is dealt out once for each pair that it knows.  A column is cut into ``PARTS`` parts by its
    values; ranks are counted within a part and moved up by the sizes of the parts below, so no task sees a
    whole column.  Values are compared at ``digits`` decimals.
    """
    path = shared_folder(rows.sparkSession, "pairs")
    rows.select(*[F.round(F.col(c).cast("double"), digits).alias(c) for c in columns]).write.parquet(path)
    known = rows.sparkSession.read.parquet(path)
    cuts = _cuts(known, columns)
    one = lambda i, c: F.struct(F.lit(i).alias("i"), F.lit(c).alias("name"), F.col(c).alias("x"), _part(F.col(c), cuts[c]).alias("p"))
    values = known.select(F.filter(F.array(*[one(i, c) for i, c in enumerate(columns)]), lambda v: v["x"].isNotNull() & ~F.isnan(v["x"])).alias("v"))
    first = values.select("v", F.explode("v").alias("l"))
    pairs = first.select("l", F.explode(F.filter("v", lambda v: v["i"] > F.col("l.i"))).alias("r"))
    flat = pairs.select(*[F.col(f"{s}.{f}").alias(t) for s, k in (("l", "a"), ("r", "b")) for f, t in (("name", k), ("x", f"x_{k}"), ("p", f"p_{k}"))])
    ranked = _ranked(_ranked(flat, "a"), "b")
    spread = F.stddev_samp("r_a") * F.stddev_samp("r_b")
    return ranked.groupBy("a", "b").agg(F.count("*").alias("n"), F.when(spread > 1e-12, F.covar_samp("r_a", "r_b") / F.nullif(spread, F.lit(0.0))).alias("rho"))


@dataclass(frozen=True)
class Legs:
    """Weights of the regimes, and of the two legs; fixed values of the strategy."""

    low: float = 0.20
    mid: float = 0.30
    high: float = 0.50
    scale: float = 1.0
    enter: float = 1.8
    leave: float = -0.1
    high_sharpness: float = 5.0
    low_sharpness: float = 2.0
    high_share: float = 0.30
    low_share: float = 0.50
    least_low: int = 5


def as_of(rows: DataFrame, dated: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``rows`` with the ``columns`` of the last row of ``dated`` (a row a date) on or before their date, 0 before the first."""
    days = rows.select("date").distinct().select("date", F.lit(1).alias("_asked"))
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = days.join(dated.select("date", *columns), "date", "full")
    carried = both.select("date", "_asked", *[F.coalesce(F.last(c, True).over(w), F.lit(0.0)).alias(c) for c in columns]).where("_asked = 1").drop("_asked")
    return rows.join(F.broadcast(carried), "date")


def regime_legs(rows: DataFrame, regimes: DataFrame, legs: Legs = Legs()) -> DataFrame:
    """date, ticker, leg (1: calm names, 2: lively ones), weight and exit of every name with a score, volatility and price.

    ``rows`` has date, ticker, s (score) and v (volatility); ``regimes`` has date, prob_low, prob_mid and
    prob_high.  The calm half of a date gets the share that the regimes of the day give it, by softmax over
    its best names; the rest goes to the best lively names whose scaled score passes ``enter``.  Those of
    them under ``leave`` are to be sold.
    """
    total = legs.low + legs.mid + legs.high
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("prob_low") * legs.low + F.col("prob_mid") * legs.mid + F.col("prob_high") * legs.high) / total))
    known = as_of(rows.where("s IS NOT NULL AND v IS NOT NULL"), regimes, ("prob_low", "prob_mid", "prob_high"))
    day = Window.partitionBy("date")
    split = known.withColumn("leg", F.when(F.col("v") <= F.percentile("v", F.lit(0.5)).over(day), 1).otherwise(2))
    side = Window.partitionBy("date", "leg")
    ranked = split.withColumn("r", F.row_number().over(side.orderBy(F.round("s", 9).desc(), "ticker"))).withColumn("n", F.count("*").over(side))
    limit = F.when(F.col("leg") == 1, F.greatest(F.floor(F.col("n") * legs.high_share), F.lit(1))).otherwise(F.greatest(F.floor(F.col("n") * legs.low_share), F.lit(legs.least_low)))
    z = F.round(F.col("s") * legs.scale, 9)
    marked = ranked.withColumn("picked", (F.col("r") <= limit) & ((F.col("leg") == 1) | (z > legs.enter))).withColumn("exit", (F.col("r") <= limit) & (F.col("leg") == 2) & (z < legs.leave))
    best = F.max(F.when(F.col("picked"), F.col("s"))).over(side)
    sharpness = F.when(F.col("leg") == 1, legs.high_sharpness).otherwise(legs.low_sharpness * legs.scale)
    lifted = marked.withColumn("_e", F.when(F.col("picked"), F.exp(sharpness * (F.col("s") - best))))
    part = F.when(F.col("leg") == 1, share).otherwise(1 - share)
    weight = F.coalesce(part * F.col("_e") / F.nullif(F.sum("_e").over(side), F.lit(0.0)), F.lit(0.0))
    return lifted.select("date", "ticker", "leg", weight.alias("weight"), "exit")


def holdout_returns(signals: DataFrame, kept: DataFrame, plan: DataFrame, target: str, least: int = 10, lags: int = 10) -> tuple[DataFrame, DataFrame]:
    """Backtest of each slice on its holdout dates: (a row a slice, the daily returns of the slices that pass, averaged where they overlap).

    The composite of a slice is the mean of its kept factors, each standardised over the names of the date;
    its weights are the composite less its mean, scaled to an absolute sum of 1.  A slice passes if the mean
    of its returns or their Newey-West t is positive, which looks at the holdout itself: ``passed`` says so.
    """
    factors = [c for c in signals.columns if c not in ("date", "ticker", target)]
    days = signals.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)
    held = signals.join(F.broadcast(days), "date").join(F.broadcast(plan.select("slice", "hold_from", "hold_to")), (F.col("i") >= F.col("hold_from")) & (F.col("i") < F.col("hold_to")))
    long = held.select("slice", "date", "i", "ticker", target, F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("x")) for f in factors])).alias("e")).select("slice", "date", "i", "ticker", target, "e.*")
    long = long.where("x IS NOT NULL").join(F.broadcast(kept.select("slice", "factor")), ["slice", "factor"])
    w = Window.partitionBy("slice", "factor", "date")
    sd = F.stddev_samp("x").over(w)
    z = long.withColumn("z", F.when(sd > 1e-12, (F.col("x") - F.avg("x").over(w)) / F.nullif(sd, F.lit(0.0))))
    mean = z.groupBy("slice", "date", "i", "ticker").agg(F.avg("z").alias("s"), F.max(target).alias("y")).where("s IS NOT NULL AND y IS NOT NULL")
    day = Window.partitionBy("slice", "date")
    centred = mean.withColumn("s", F.col("s") - F.avg("s").over(day))
    daily = centred.groupBy("slice", "date", "i").agg((F.sum(F.col("s") * F.col("y")) / F.nullif(F.sum(F.abs("s")), F.lit(0.0))).alias("ret"), F.count("*").alias("names")).where(F.col("names") >= least)
    tested = newey_west_t(daily, ["slice"], "ret", "i", lags)
    report = tested.select("slice", "n", "mean", "t", F.coalesce((F.col("mean") > 0) | (F.col("t") > 0), F.lit(False)).alias("passed"))
    pooled = daily.join(F.broadcast(report.where("passed").select("slice")), "slice").groupBy("date").agg(F.avg("ret").alias("ret"), F.count("*").alias("slices"))
    return report, pooled


def split_by_clock(flat: DataFrame, order: list[str], clock: str) -> DataFrame:
    """``flat`` with ``chunk``: a feed of several tickers in ``order``, where a new one begins when the clock goes back.

    The feed is dealt out by ranges of ``order`` and written once, so that the ranges stay; each range
    counts its own drops as it streams by, and a row a range tells how many lie before it.
    """
    spark = flat.sparkSession
    path = shared_folder(spark, "feed")
    staged = flat.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in staged.schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, drops, first = None, 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            ticks = batch.column(clock)
            at = (ticks.cast(pa.int64()) if pa.types.is_timestamp(ticks.type) else ticks).to_numpy(zero_copy_only=False)
            before = np.r_[at[0] if last is None else last, at[:-1]]
            own = drops + np.cumsum(at < before)
            edge = np.zeros(len(at), dtype=bool)
            edge[0], first = first, False
            last, drops = at[-1], int(own[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64()), pa.array(edge)], names=[*batch.schema.names, "_drops", "_edge"])

    staged.mapInArrow(count, f"{schema}, _drops long, _edge boolean").write.parquet(f"{path}/{uuid.uuid4().hex}")
    ready = spark.read.parquet(f"{path}/*")
    ranges = ready.groupBy("_range").agg(F.max(F.when(F.col("_edge"), F.col(clock))).alias("_first"), F.max_by(clock, F.struct(*order)).alias("_last"), F.max("_drops").alias("_n"))
    along = Window.orderBy("_range")
    seam = F.when(F.col("_first") < F.lag("_last").over(along), 1).otherwise(0)
    steps = ranges.withColumn("_seam", seam)
    before = F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.sum("_seam").over(along)
    offsets = steps.select("_range", before.alias("_before"))
    return ready.join(F.broadcast(offsets), "_range").withColumn("chunk", F.col("_before") + F.col("_drops")).select(*flat.columns, "chunk")
