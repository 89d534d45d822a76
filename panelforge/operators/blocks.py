"""Panels saved as blocks of names: one row a block, each column a matrix of its dates by its names.

Rows are dealt once by ticker and packed as they come, so a block holds a bounded number of cells whatever the
number of names.  From then on all work on the rows of a ticker stays inside a row: windows are computed on the
matrices in the order in which Spark's sliding frames add, so they are those of the planner's expressions.
What a date needs of all names, means and deviations, are sums over blocks, a row for each task, date and
expression.  Saved once, a panel serves screening, training and holdout: a slice is a range of its dates.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dag import KIND, Node
from .evaluation import MATRIX, MOST_CELLS, SAVED, _each, matrices, row_by_row
from .panel import PanelSpec, panel_ctes

#: What a row of a saved panel holds beside its matrices.
HEAD = ("block", "dates", "names", "tickers", "codes")
#: Shuffle files go when the query that wrote them ends, and not when the driver's memory is tidied up.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What a bar holds; the classes of a ticker are the same on all its dates.
BARS = ("open", "high", "low", "close", "volume", "amount", "sector", "shares")
TRADES = ("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")


@dataclass(frozen=True)
class BlockPanel:
    """Saved blocks; ``dates`` are those of their rows, in order, and ``columns`` their matrices."""

    spark: SparkSession
    path: str
    dates: tuple[dt.date, ...]
    columns: tuple[str, ...]

    def read(self, columns: tuple[str, ...]) -> DataFrame:
        """A row for each block with the matrices of ``columns``; the others are not read."""
        return self.spark.read.schema(_schema(self.columns)).parquet(self.path).select(*HEAD, *[f"{MATRIX}{c}" for c in columns])

    def codes(self) -> list[float]:
        """The values of the group's column."""
        return sorted(r["code"] for r in self.read(()).select(F.explode("codes").alias("code")).distinct().collect())

    def days(self) -> DataFrame:
        """date and its place."""
        return self.spark.createDataFrame([(d, i) for i, d in enumerate(self.dates)], "date date, i int")

    def rows(self, columns: tuple[str, ...]) -> DataFrame:
        """date, ticker and ``columns`` with a row for each cell."""
        days = np.array(self.dates, dtype="datetime64[D]")
        schema = pa.schema([("date", pa.date32()), ("ticker", pa.int64()), *[(c, pa.float64()) for c in columns]])

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, r in _each(batches):
                held = matrices(r)
                found = [held[c].ravel() for c in columns]
                keys = [np.repeat(days, r["names"]), np.tile(np.array(r["tickers"], dtype=np.int64), r["dates"])]
                yield pa.RecordBatch.from_arrays([*[pa.array(k, f.type) for k, f in zip(keys, schema, strict=False)], *[pa.array(x, from_pandas=True) for x in found]], schema=schema)

        return self.read(columns).mapInArrow(unpack, f"date date, ticker long{''.join(f', `{c}` double' for c in columns)}")


def _schema(columns: tuple[str, ...]) -> str:
    return f"block long, dates int, names int, tickers array<long>, codes array<double>{''.join(f', `{MATRIX}{c}` binary' for c in columns)}"


def _record(block: int, tickers: list[int], columns: dict[str, np.ndarray], group: str | None) -> pa.RecordBatch:
    dates, names = next(iter(columns.values())).shape
    codes = np.unique(columns[group]) if group else np.zeros(0)
    head = [pa.array([x], kind) for x, kind in zip((block, dates, names, tickers, codes[np.isfinite(codes)].tolist()), (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.float64())), strict=True)]
    data = [pa.array([np.ascontiguousarray(m, dtype=np.float64).tobytes()], pa.binary()) for m in columns.values()]
    return pa.RecordBatch.from_arrays([*head, *data], names=[*HEAD, *[f"{MATRIX}{c}" for c in columns]])


def save_rows(rows: DataFrame, dates: tuple[dt.date, ...], columns: tuple[str, ...], path: str, group: str | None = None) -> BlockPanel:
    """``rows`` (date, ticker and ``columns``, one for each date and ticker at most) as blocks under ``path``; cells without a row hold nothing."""
    spark, names = rows.sparkSession, max(1, MOST_CELLS // max(1, len(dates)))
    days = spark.createDataFrame([(d, i) for i, d in enumerate(dates)], "date date, i int")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, [np.zeros(0, dtype=np.int64)] * 2 + [np.zeros(0)] * len(columns)

        def record(part: list[np.ndarray]) -> pa.RecordBatch:
            tickers, at = np.unique(part[1], return_inverse=True)
            found = {}
            for c, x in zip(columns, part[2:], strict=True):
                found[c] = np.full((len(dates), len(tickers)), np.nan)
                found[c][part[0], at] = x
            return _record(block, tickers.tolist(), found, group)

        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(batch.num_columns)]
            held = [np.concatenate(p) for p in zip(held, new, strict=True)]
            steps = np.diff(held[1])
            if (steps < 0).any():
                raise ValueError("rows of a ticker are not together")
            starts = np.flatnonzero(steps) + 1
            while len(starts) >= names:
                cut = starts[names - 1]
                yield record([x[:cut] for x in held])
                block, held, starts = block + 1, [x[cut:] for x in held], starts[names:] - cut
        if len(held[0]):
            yield record(held)

    placed = rows.join(F.broadcast(days), "date").select("i", F.col("ticker").cast("long").alias("ticker"), *[F.col(c).cast("double").alias(c) for c in columns])
    dealt = placed.repartition("ticker").sortWithinPartitions("ticker", "i")
    before = spark.conf.get(TIDY)
    spark.conf.set(TIDY, "true")
    try:
        dealt.mapInArrow(pack, _schema(columns)).write.options(**SAVED).mode("overwrite").parquet(path)
    finally:
        spark.conf.set(TIDY, before)
    return BlockPanel(spark, path, dates, columns)


def save_bars(spark: SparkSession, sf_dir: str, spec: PanelSpec, path: str) -> BlockPanel:
    """The bars of ``spec`` as blocks; a trade moves once, by its ticker, and is aggregated where it arrives."""
    trades = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*TRADES).where("l_shipdate IS NOT NULL AND l_suppkey IS NOT NULL")
    dates = tuple(r["date"] for r in trades.select(F.date_trunc(spec.unit, "l_shipdate").cast("date").alias("date")).distinct().orderBy("date").collect())
    ctes = panel_ctes(spec, sf_dir, trades="{trades}")
    bars, classes = ctes[0], next(c for c in ctes if c.startswith("classes "))
    found = spark.sql(f"WITH {bars}, {classes} SELECT b.*, sector, shares FROM bars b LEFT JOIN classes c ON c.ticker = b.ticker", trades=trades.repartition("l_suppkey"))
    return save_rows(found, dates, BARS, path)


def filled_columns(held: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The columns of a panel with closes carried forward, from those of bars: as ``FILLED_WEEK``."""
    close = held["close"]
    last = carried(close)
    of_ticker = lambda x: np.broadcast_to(np.fmax.reduce(x, axis=0), x.shape)
    with np.errstate(all="ignore"):
        vwap = held["amount"] / np.where(held["volume"] == 0, np.nan, held["volume"])
        before = shifted(last, 1)
        out = {c: np.where(np.isnan(held[c]), last, held[c]) for c in ("open", "high", "low")}
        out |= {"close": last, "vwap": np.where(np.isnan(vwap), last, vwap), "sector": of_ticker(held["sector"])}
        out |= {c: np.nan_to_num(held[c]) for c in ("volume", "amount")}
        out["mcap"] = of_ticker(held["shares"] * close / np.where(close == 0, np.nan, close)) * last
        out["logret"] = np.log(np.where((last > 0) & (before > 0), last / before, np.nan))
    return out


def carried(x: np.ndarray) -> np.ndarray:
    """The last known value of each column at each row."""
    at = np.maximum.accumulate(np.where(np.isnan(x), 0, np.arange(len(x))[:, None]), axis=0)
    return np.take_along_axis(x, at, axis=0)


def shifted(x: np.ndarray, back: int) -> np.ndarray:
    out = np.full(x.shape, np.nan)
    out[back:] = x[: max(0, len(x) - back)]
    return out


class Cells:
    """Values of expressions over a block, rows by date and columns by name; nan is null.

    Windows are full ones (a missing value in them gives none) and add oldest rows first.  ``days`` has for each
    expression over the names of a date its number, mean and sample deviation on each date.
    """

    def __init__(self, columns: dict[str, np.ndarray], days: dict[Node, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.columns, self.days = columns, days
        self.shape = next(iter(columns.values())).shape
        self.known: dict[Node, np.ndarray] = {}

    def value(self, n: Node) -> np.ndarray:
        if n not in self.known:
            with np.errstate(all="ignore"):
                self.known[n] = self._value(n)
        return self.known[n]

    def _value(self, n: Node) -> np.ndarray:
        if n.op == "col":
            return self.columns[n.params[0]]
        if n.op == "const":
            return np.full(self.shape, n.params[0])
        if n.op in ("cs_mean", "zscore"):
            count, mean, sd = (x[:, None] for x in self.days[n])
            if n.op == "cs_mean":
                return np.broadcast_to(np.where(count > 0, mean, np.nan), self.shape)
            return np.where((count >= n.params[0]) & (sd > 1e-12), (self.value(n.args[0]) - mean) / sd, np.nan)
        a = [self.value(k) for k in n.args]
        w = n.params[0] if n.params else 0
        match n.op:
            case "+": return a[0] + a[1]
            case "-": return a[0] - a[1]
            case "*": return a[0] * a[1]
            case "/": return a[0] / np.where(a[1] == 0, np.nan, a[1])
            case "div_eps": return a[0] / (a[1] + 1e-12)
            case "neg": return -a[0]
            case "abs": return np.abs(a[0])
            case "ln": return np.log(np.where(a[0] > 0, a[0], np.nan))
            case "nullif0": return np.where(a[0] == 0, np.nan, a[0])
            case "delay": return shifted(a[0], w)
            case "fwd_sum":
                ahead = _placed(a[0], _sum(a[0], w), w)
                return np.concatenate([ahead[w:], np.full((min(w, len(ahead)), self.shape[1]), np.nan)])[: len(ahead)]
            case "ts_sum": return _placed(a[0], _sum(a[0], w), w)
            case "ts_mean": return _placed(a[0], _sum(a[0], w) / w, w)
            case "ts_std": return _placed(a[0], np.sqrt(_squares(a[0], w) / (w - 1)), w)
            case "ts_corr" | "ts_beta":
                both = a[0] + a[1]
                x, y = (np.where(np.isnan(both), np.nan, v) for v in a)
                cov = _products(x, y, w) / (w - 1)
                spread = lambda v: _squares(v, w) / (w - 1)
                live = lambda v, s: np.sqrt(s) > 1e-10 * (np.abs(_sum(v, w) / w) + 0.01)
                sy = spread(y)
                if n.op == "ts_beta":
                    return _placed(x, np.where(live(y, sy), cov / np.where(sy == 0, np.nan, sy), np.nan), w)
                sx = spread(x)
                under = np.sqrt(sx) * np.sqrt(sy)
                return _placed(x, np.where(live(x, sx) & live(y, sy), cov / np.where(under == 0, np.nan, under), np.nan), w)
        raise ValueError(f"no such operator over blocks: {n.op}")


def _placed(x: np.ndarray, found: np.ndarray, w: int) -> np.ndarray:
    """``found`` of whole windows at the row where each ends."""
    return np.concatenate([np.full((len(x) - len(found), *x.shape[1:]), np.nan), found])


def _steps(x: np.ndarray, w: int) -> Iterator[np.ndarray]:
    """The rows of all whole windows, the oldest of each first."""
    whole = max(0, len(x) - w + 1)
    return (x[k : k + whole] for k in range(w))


def _sum(x: np.ndarray, w: int) -> np.ndarray:
    total = np.zeros((max(0, len(x) - w + 1), *x.shape[1:]))
    for v in _steps(x, w):
        total += v
    return total


def _squares(x: np.ndarray, w: int) -> np.ndarray:
    """Sums of squared deviations, row by row of a window."""
    mean = np.zeros((max(0, len(x) - w + 1), *x.shape[1:]))
    total = np.zeros(mean.shape)
    for k, v in enumerate(_steps(x, w), 1):
        away = v - mean
        step = away / k
        mean += step
        total += away * (away - step)
    return total


def _products(x: np.ndarray, y: np.ndarray, w: int) -> np.ndarray:
    """Sums of products of deviations, row by row of a window."""
    at = np.zeros((max(0, len(x) - w + 1), *x.shape[1:]))
    of, total = np.zeros(at.shape), np.zeros(at.shape)
    for k, (u, v) in enumerate(zip(_steps(x, w), _steps(y, w), strict=True), 1):
        away = u - at
        at += away / k
        of += (v - of) / k
        total += away * (v - of)
    return total


def _over_dates(outputs: list[Node]) -> list[Node]:
    """The expressions over the names of a date, those that others need first."""
    found: dict[Node, None] = {}
    seen: set[Node] = set()

    def visit(n: Node) -> None:
        if n not in seen:
            seen.add(n)
            for k in n.args:
                visit(k)
            if KIND.get(n.op) == "D":
                found[n] = None

    for n in outputs:
        visit(n)
    return list(found)


def day_moments(panel: BlockPanel, columns: Callable[[dict], dict], nodes: list[Node], known: dict) -> dict[Node, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Number, mean and sample deviation on each date of what each of ``nodes`` is taken of; one pass over the blocks."""
    size = len(panel.dates)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, away = np.zeros((3, len(nodes), size))
        for _, r in _each(batches):
            cells = Cells(columns(matrices(r)), known)
            for k, node in enumerate(nodes):
                x = cells.value(node.args[0])
                good = np.isfinite(x)
                count = good.sum(axis=1)
                own = np.where(good, x, 0.0).sum(axis=1) / np.maximum(count, 1)
                rest = np.where(good, x - own[:, None], 0.0)
                whole, step = n[k] + count, own - mean[k]
                share = count / np.maximum(whole, 1)
                away[k] += (rest * rest).sum(axis=1) + step * step * n[k] * share
                mean[k] += step * share
                n[k] = whole
        k, i = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(i, pa.int32()), pa.array(n[k, i]), pa.array(mean[k, i]), pa.array(away[k, i])], names=["k", "i", "n", "mean", "away"])

    own = Window.partitionBy("k", "i")
    parts = panel.read(panel.columns).coalesce(panel.spark.sparkContext.defaultParallelism).mapInArrow(part, "k int, i int, n double, mean double, away double")
    parts = parts.withColumn("all", F.sum(F.col("n") * F.col("mean")).over(own) / F.sum("n").over(own))
    found = parts.groupBy("k", "i").agg(F.sum("n").alias("n"), F.first("all").alias("mean"), F.sum(F.col("away") + F.col("n") * (F.col("mean") - F.col("all")) * (F.col("mean") - F.col("all"))).alias("away"))
    n, mean, away = np.zeros((3, len(nodes), size))
    with row_by_row(panel.spark):
        for r in found.collect():
            n[r["k"], r["i"]], mean[r["k"], r["i"]], away[r["k"], r["i"]] = r["n"], r["mean"], r["away"]
    out = {}
    for k, node in enumerate(nodes):
        less = 1 if node.op != "zscore" or node.params[1] else 0
        sd = np.where(n[k] > less, np.sqrt(away[k] / np.maximum(n[k] - less, 1)), np.nan)
        out[node] = (n[k], mean[k], sd)
    return out


def compute_blocks(panel: BlockPanel, columns: Callable[[dict], dict], outputs: dict[str, Node], path: str, group: str | None = None) -> BlockPanel:
    """A panel of ``outputs`` over the same blocks; ``columns`` makes the columns they read from those saved.

    One pass over the blocks for all expressions over dates that need no other ones, and so on, and one that writes.
    """
    days: dict[Node, tuple] = {}
    waiting = _over_dates(list(outputs.values()))
    while waiting:
        ready = [n for n in waiting if not any(k in waiting for k in _over_dates(list(n.args)))]
        days |= day_moments(panel, columns, ready, days)
        waiting = [n for n in waiting if n not in days]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, r in _each(batches):
            cells = Cells(columns(matrices(r)), days)
            yield _record(r["block"], r["tickers"], {c: cells.value(n) for c, n in outputs.items()}, group)

    with row_by_row(panel.spark):
        panel.read(panel.columns).mapInArrow(write, _schema(tuple(outputs))).write.options(**SAVED).mode("overwrite").parquet(path)
    return BlockPanel(panel.spark, path, panel.dates, tuple(outputs))
