"""Scores of many formulas over blocks of names, with a store of the windows that formulas share.

A panel is cut once into blocks of names with all their dates, so that a block holds a bounded number of
cells whatever the number of names, and is saved with one row a block.  From then on a generation of
formulas is one pass over the blocks without a shuffle of the panel: a block computes its formulas and adds
what the daily regressions and ICs need, sums of products over its names.  Only these sums are shuffled, a
row for each task and date, then the ICs, to Newey-West statistics.  Rolling windows inside formulas are kept
in a store of bounded size: a window that it holds is read and not computed again.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import pickle
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .walkforward import newey_west_t

#: Dates whose products with the regressors a task holds at once.
BLOCK_DATES = 128
#: Cells (dates by names) of a block: at most, and at least where there are more blocks than cores.
MOST_CELLS, LEAST_CELLS = 1 << 14, 1 << 13
#: Lengths of the windows that formulas may hold.
WINDOWS = (5, 10, 20, 60)
#: Formulas whose values a task holds at once.
AT_ONCE = 64
#: Bytes of sums that a task holds at once; more formulas or dates take more passes.
SUMS_BYTES = 200_000_000
#: Bytes of stored windows: in a block, and of all blocks.  Windows beyond are computed whenever they are met.
BLOCK_STORE, WHOLE_STORE = 12_500_000, 250_000_000
#: Bytes of windows that a task keeps beside the stored ones while it has a block.
BLOCK_KNOWN = 50_000_000
#: Bytes of a batch where saved blocks are made rows again.
LIGHT_BYTES = 4_000_000
#: Saved blocks are megabytes each: one in a row group, so that neither writers nor readers hold more of them at once.
SAVED = {"parquet.block.row.count.limit": "1"}


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the checkpoint folder that the cluster names; on one machine, if none is set, a temporary one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="panelforge-")
    return f"{named.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def row_by_row(spark: SparkSession) -> Iterator[None]:
    """Jobs inside hand Python one row in a batch: a batch of saved blocks grows with their number, in the executor and in its worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 1)
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextlib.contextmanager
def light_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs inside hand Python a few saved blocks at a time, and rows as always."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, LIGHT_BYTES)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def rolling(x: np.ndarray, kind: str, window: int) -> np.ndarray:
    """Mean or sample deviation of the last ``window`` rows (axis 0), as the operators ``ts_mean_frac`` and ``ts_std_frac``.

    At least 80 % of a window must be known, and the panel must have begun ``window`` rows before.  Windows
    are put together from ones of 1, 2, 4, ... rows, so no value outside a window touches its result.
    """
    known = np.isfinite(x)
    holes = np.flatnonzero(~known.all(axis=1))
    whole = (holes[-1] + 1 if len(holes) else 0) + window - 1
    if whole < len(x) and window > 1:
        # From here on windows have no missing value; those before are few.
        return np.concatenate([_rolling_known(x[:whole], known[:whole], kind, window) if whole else x[:0], _rolling_whole(x[whole - window + 1 :], kind, window)])
    return _rolling_known(x, known, kind, window)


def _rolling_whole(x: np.ndarray, kind: str, window: int) -> np.ndarray:
    """As :func:`_rolling_known` at the rows from ``window`` - 1 on, for a matrix without missing values."""
    spread = kind == "ts_std"
    one, found, covered, size = (x, None), None, 0, 1

    def joined(late: tuple, early: tuple, n1: int, n2: int) -> tuple:
        """Windows of ``n1`` rows with those of ``n2`` rows before; row k of either is of the window that begins at row k."""
        mean1, mean2 = late[0][n2:], early[0][: len(late[0]) - n2]
        step = mean2 - mean1
        if not spread:
            step *= n2 / (n1 + n2)
            step += mean1
            return step, None
        mean = step * (n2 / (n1 + n2))
        mean += mean1
        step *= step
        step *= n1 * (n2 / (n1 + n2))
        if late[1] is not None:
            step += late[1][n2:]
        if early[1] is not None:
            step += early[1][: len(step)]
        return mean, step

    while True:
        if window & size:
            found = one if found is None else joined(found, one, covered, size)
            covered += size
        if covered == window:
            break
        one = joined(one, one, size, size)
        size *= 2
    return np.sqrt(found[1] / (window - 1)) if spread else found[0]


def _rolling_known(x: np.ndarray, known: np.ndarray, kind: str, window: int) -> np.ndarray:
    one = (known.astype(float), np.where(known, x, 0.0), np.zeros_like(x))
    spread = kind == "ts_std"
    found, covered, size = None, 0, 1
    while True:
        if window & size:
            found = one if found is None else _joined(found, one, covered, spread)
            covered += size
        if covered == window:
            break
        one = _joined(one, one, size, spread)
        size *= 2
    n, middle, away = found
    least = -(-window * 4 // 5)
    if spread:
        least, middle = max(least, 3), np.sqrt(away / np.maximum(n - 1, 1))
    enough = n >= least
    enough[: window - 1] = False
    return np.where(enough, middle, np.nan)


def _joined(late: tuple, early: tuple, back: int, spread: bool) -> tuple:
    """Count, mean and squared deviations of windows ``late`` with the windows ``early`` that end ``back`` rows before; rows before the first hold nothing."""
    if back >= len(late[0]):
        return late
    n1, mean1, away1 = (a[back:] for a in late)
    n2, mean2, away2 = (a[:-back] for a in early)
    n = n1 + n2
    share = n2 / np.maximum(n, 1)
    step = mean2 - mean1
    out = tuple(a.copy() for a in late)
    out[0][back:] = n
    out[1][back:] = mean1 + step * share
    if spread:
        out[2][back:] = away1 + away2 + step * step * n1 * share
    return out


class Block:
    """The matrices of one block, rows by date and columns by name."""

    def __init__(self, columns: dict[str, np.ndarray]) -> None:
        self.columns = columns
        #: Windows met so far; other parts of formulas cost less than their room.
        self.known: dict[str, np.ndarray] = {}
        self.shape = next(iter(columns.values())).shape

    def value(self, tree) -> np.ndarray:
        with np.errstate(all="ignore"):
            found = self._value(tree)
        return np.where(np.isfinite(found), found, np.nan) if np.isinf(found).any() else found

    def _value(self, tree) -> np.ndarray:
        if tree.op == "const":
            return np.full(self.shape, tree.value)
        if not tree.kids:
            return self.columns[tree.op]
        if tree.op in ("ts_mean", "ts_std"):
            key = tree.key()
            if key in self.columns:
                return self.columns[key]
            if key not in self.known:
                found = rolling(self.value(tree.kids[0]), tree.op, tree.window)
                if len(self.known) * found.nbytes >= BLOCK_KNOWN:
                    return found
                self.known[key] = found
            return self.known[key]
        a = [self.value(k) for k in tree.kids]
        match tree.op:
            case "+": return a[0] + a[1]
            case "-": return a[0] - a[1]
            case "*": return a[0] * a[1]
            case "/":
                found = a[0] / a[1]
                # The divisor passes 1e-9 after rounding to nine decimals.
                np.copyto(found, np.nan, where=~(np.abs(a[1] * 1e9) >= 1.5))
                return found
            case "neg": return -a[0]
            case "abs": return np.abs(a[0])
            case "tanh": return np.tanh(a[0])
        return np.sign(np.rint(a[0] * 1e9))


class Sums:
    """Sums over names, date by date, of what the regressions and ICs of formulas need; parts of the names add up.

    Of a formula x, less a value near its mean on the date (``pivot``): its products with a constant, each
    group, each regressor, y and itself, over the names where x and all regressors are known.  Those without
    y among them are summed apart.  Products without x only depend on the set of names, which many formulas
    share: they are kept for each set that differs on some date (``of`` a formula), not for each formula.
    """

    def __init__(self, formulas: int, dates: int, regressors: int, codes: np.ndarray) -> None:
        self.codes, self.wide = codes, 1 + len(codes) + regressors
        self.pivot = np.full((formulas, dates), np.nan)
        self.mine = np.zeros((dates, formulas, self.wide + 2))
        self.apart = np.zeros((dates, formulas, self.wide + 1))
        self.of = np.zeros(formulas, dtype=np.int32)
        self.sets: list[np.ndarray] = [np.zeros((dates, 2 * self.products(regressors, len(codes)) + self.wide + 1))]
        self.any_apart = np.zeros(dates, dtype=bool)

    @staticmethod
    def products(regressors: int, codes: int) -> int:
        """Products of a constant, regressors and groups among each other that are not zero or the same."""
        return (1 + regressors) * (1 + codes) + regressors * (regressors + 1) // 2

    @staticmethod
    def bytes_of(regressors: int, codes: int) -> int:
        """Of one formula and date, if no formulas share a set of names."""
        wide = 1 + codes + regressors
        return 8 * (1 + 2 * wide + 3 + 2 * Sums.products(regressors, codes) + wide + 1)

    def add(self, block: Block, trees: list, regressors: tuple[str, ...], group: str | None) -> None:
        dates, names = block.shape
        y = block.columns["y"]
        has_y = np.isfinite(y)
        risks = [block.columns[c] for c in regressors]
        usable = np.ones((dates, names), dtype=bool)
        for r in risks:
            usable &= np.isfinite(r)
        lacking = usable & ~has_y
        self.any_apart |= lacking.any(axis=1)
        seen: dict[bytes, np.ndarray] = {}
        marks: list[bytes] = []
        # Windows read all dates; sums only those on which the regressors of some name are known.
        live = np.flatnonzero(usable.any(axis=1))
        low, high = (live[0], live[-1] + 1) if len(live) else (0, 0)
        days = self._days(low, high, y, has_y, lacking, risks, usable, block.columns[group] if group else None)
        for at in range(0, len(trees), AT_ONCE):
            part = slice(at, min(at + AT_ONCE, len(trees)))
            # Dates outside: what is multiplied lies together.
            x = np.empty((high - low, part.stop - at, names))
            fresh_sets: list[np.ndarray] = []
            into: list[np.ndarray] = []
            for k, t in enumerate(trees[part]):
                found = block.value(t)
                good = np.isfinite(found)
                good &= usable
                mark = hashlib.blake2b(np.packbits(good).tobytes(), digest_size=16).digest()
                marks.append(mark)
                if mark not in seen:
                    seen[mark] = np.zeros(self.sets[0].shape)
                    into.append(seen[mark])
                    fresh_sets.append(good)
                pivot = self.pivot[at + k]
                if np.isnan(pivot).any():
                    n = good.sum(axis=1)
                    fresh = np.isnan(pivot) & (n > 0)
                    pivot[fresh] = np.where(good[fresh], found[fresh], 0.0).sum(axis=1) / n[fresh]
                np.subtract(found[low:high], pivot[low:high, None], out=x[:, k])
                np.copyto(x[:, k], 0.0, where=~good[low:high])
            for at_once, own in days:
                self._add_dates(at_once, part, x[at_once.start - low : at_once.stop - low], fresh_sets, into, *own)
        self._refine(marks, seen)

    def _days(self, first: int, last: int, y: np.ndarray, has_y: np.ndarray, lacking: np.ndarray, risks: list[np.ndarray], usable: np.ndarray, group: np.ndarray | None) -> list[tuple[slice, tuple]]:
        """What all formulas of a block are multiplied with, some dates at a time."""
        out = []
        for low in range(first, last, BLOCK_DATES):
            days = slice(low, min(low + BLOCK_DATES, last))
            use = usable[days]
            own = [np.ones(use.shape)] + [(group[days] == c).astype(float) for c in self.codes]
            risk = [np.where(use, r[days], 0.0) for r in risks]
            target = np.where(has_y[days], y[days], 0.0)
            base = np.stack([*own, *risk], axis=2)
            out.append((days, (own, risk, target, base, np.concatenate([base, target[:, :, None]], axis=2), lacking[days])))
        return out

    def _add_dates(self, days: slice, part: slice, x: np.ndarray, sets: list[np.ndarray], into: list[np.ndarray], own: list[np.ndarray], risk: list[np.ndarray], target: np.ndarray, base: np.ndarray, both: np.ndarray, lacking: np.ndarray) -> None:
        apart = np.flatnonzero(lacking.any(axis=1))
        with np.errstate(all="ignore"):
            self.mine[days, part, :-1] += x @ both
            self.mine[days, part, -1] += np.einsum("dfk,dfk->df", x, x)
            if len(apart):
                u = x[apart] * lacking[apart][:, None, :]
                self.apart[days][apart, part, :-1] += u @ base[apart]
                self.apart[days][apart, part, -1] += np.einsum("dfk,dfk->df", u, u)
        if into:
            pairs = [a * b for i, a in enumerate(risk) for b in risk[i:]]
            design = np.stack([*own, *[r * e for r in risk for e in own], *pairs], axis=2)
            full = np.concatenate([design, design * lacking[:, :, None], base * target[:, :, None], (target * target)[:, :, None]], axis=2)
            found = np.stack([g[days] for g in sets], axis=1).astype(float) @ full
            for k, total in enumerate(into):
                total[days] = found[:, k]

    def _refine(self, marks: list[bytes], seen: dict[bytes, np.ndarray]) -> None:
        """Formulas that shared their names so far and no longer do part here."""
        old, first = self.sets, {}
        place: dict[tuple[int, bytes], int] = {}
        for f, mark in enumerate(marks):
            key = (int(self.of[f]), mark)
            if key not in place:
                place[key] = len(place)
                first[place[key]] = key
            self.of[f] = place[key]
        self.sets = [old[was] + seen[mark] for was, mark in first.values()]

    def rows(self) -> Iterator[tuple]:
        """For each date: place, and the bytes of pivots, sums, those without y (None: there are none), sets and the set of each formula."""
        for d in range(len(self.mine)):
            sets = np.stack([s[d] for s in self.sets])
            yield d, self.pivot[:, d].tobytes(), self.mine[d].tobytes(), self.apart[d].tobytes() if self.any_apart[d] else None, sets.tobytes(), self.of.tobytes()


def _symmetric(products: np.ndarray, regressors: int, codes: int) -> np.ndarray:
    """The matrix of a constant, groups and regressors from the products of each formula."""
    wide, g = 1 + codes + regressors, 1 + codes
    out = np.zeros((len(products), wide, wide))
    for k in range(regressors + 1):
        row = products[:, k * g : (k + 1) * g]
        if k == 0:
            out[:, 0, :g] = out[:, :g, 0] = row
            out[:, np.arange(1, g), np.arange(1, g)] = row[:, 1:]
        else:
            out[:, g + k - 1, :g] = out[:, :g, g + k - 1] = row
    at = (regressors + 1) * g
    for i in range(regressors):
        for j in range(i, regressors):
            out[:, g + i, g + j] = out[:, g + j, g + i] = products[:, at]
            at += 1
    return out


def ics_of_sums(parts: list[tuple], formulas: int, regressors: int, codes: int, fit: bool, least: int, ridge: float = 1e-4, most_groups: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Number of names and correlation with y of each formula on one date, from the sums of all parts of its names; nan where too few.

    With ``fit``, formulas are replaced by what a ridge fit on a constant, the regressors and dummies of the
    largest groups but the first leaves.  A spread in the last digits of the sums counts as none.
    """
    wide, products = 1 + codes + regressors, Sums.products(regressors, codes)
    loaded = []
    for pivot, mine, apart, sets, of in parts:
        sets = np.frombuffer(sets).reshape(-1, 2 * products + wide + 1)[np.frombuffer(of, dtype=np.int32)]
        apart = np.zeros((formulas, wide + 1)) if apart is None else np.frombuffer(apart).reshape(formulas, wide + 1)
        loaded.append((np.nan_to_num(np.frombuffer(pivot)), np.frombuffer(mine).reshape(formulas, wide + 2), apart, sets))
    with np.errstate(all="ignore"):
        sets = sum(s for *_, s in loaded)
        n = sets[:, 0]
        # The pivots of the parts that have names are near each other; so are their distances from the first of these.
        origin = np.full(formulas, np.nan)
        for pivot, _, _, s in loaded:
            origin = np.where(np.isnan(origin) & (s[:, 0] > 0), pivot, origin)
        mean = origin + sum(np.where(s[:, 0] > 0, (pivot - origin) * s[:, 0] + mine[:, 0], 0.0) for pivot, mine, _, s in loaded) / np.maximum(n, 1)
        xv, xu = np.zeros((formulas, wide)), np.zeros((formulas, wide))
        vv, uu, vy = np.zeros(formulas), np.zeros(formulas), np.zeros(formulas)
        for pivot, mine, apart, s in loaded:
            shift = np.where(s[:, 0] > 0, pivot - mean, 0.0)
            ones = lambda at: np.column_stack([s[:, at : at + 1 + codes], *[s[:, at + (1 + codes) * (k + 1)] for k in range(regressors)]])  # noqa: E731, B023
            xv += mine[:, :wide] + shift[:, None] * ones(0)
            vv += mine[:, wide + 1] + 2 * shift * mine[:, 0] + shift * shift * s[:, 0]
            vy += mine[:, wide] + shift * s[:, 2 * products]
            xu += apart[:, :wide] + shift[:, None] * ones(products)
            uu += apart[:, wide] + 2 * shift * apart[:, 0] + shift * shift * s[:, products]
        sd = np.sqrt(np.maximum(vv, 0.0) / np.maximum(n, 1))
        live = (n >= least) & (sd > 1e-12) & np.isfinite(sd)
        xy, yy = sets[:, 2 * products : 2 * products + wide], sets[:, -1]
        count = n - sets[:, products]
        first, square, cross = xv[:, 0] - xu[:, 0], vv - uu, vy
        if fit and live.any():
            whole, without = _symmetric(sets[:, :products], regressors, codes), _symmetric(sets[:, products : 2 * products], regressors, codes)
            sizes = sets[:, 1 : 1 + codes]
            rank = np.argsort(np.argsort(-sizes, axis=1, kind="stable"), axis=1)
            used = (sizes > 0) & (rank < most_groups)
            if codes:
                used[np.arange(formulas), used.argmax(axis=1)] = False
            used = np.column_stack([np.ones(formulas, dtype=bool), used, np.ones((formulas, regressors), dtype=bool)])
            whole, without = (m * used[:, :, None] * used[:, None, :] for m in (whole, without))
            penalty = ridge * np.eye(wide)
            penalty[0, 0] = 0
            b = np.zeros((formulas, wide))
            ok = live & np.isfinite(xv).all(axis=1)
            b[ok] = np.linalg.solve(whole[ok] + penalty + 1e-10 * np.eye(wide), (xv * used)[ok][:, :, None])[:, :, 0]
            own = whole - without
            first = first - np.einsum("fp,fp->f", b, own[:, 0])
            square = square - 2 * np.einsum("fp,fp->f", b, (xv - xu) * used) + np.einsum("fp,fpq,fq->f", b, own, b)
            cross = cross - np.einsum("fp,fp->f", b, xy)
        spread = square - first * first / np.maximum(count, 1)
        spread_y = yy - xy[:, 0] ** 2 / np.maximum(count, 1)
        moves = (spread > count * (1e-9 * sd) ** 2) & (spread > 1e-14 * vv) & (spread_y > count * 1e-24) & (spread_y > 1e-14 * yy)
        known = live & (count >= max(least, 2))
        ic = np.where(known & moves, (cross - first * xy[:, 0] / np.maximum(count, 1)) / np.sqrt(np.where(moves, spread * spread_y, 1.0)), np.nan)
    return np.where(live, count, 0).astype(np.int64), ic


@dataclass(frozen=True)
class Wanted:
    """A formula to be scored in a slice."""

    slice: int
    name: str
    tree: object


def _windows_inside(tree) -> Iterator[object]:
    if tree.op in ("ts_mean", "ts_std") and _reads(tree):
        yield tree
    for kid in tree.kids:
        yield from _windows_inside(kid)


def _leaves(tree) -> Iterator[str]:
    """The columns that a formula reads."""
    if not tree.kids and tree.op != "const":
        yield tree.op
    for kid in tree.kids:
        yield from _leaves(kid)


def _siblings(tree) -> list:
    """A window, and where it reads a column as it stands, all other windows of that column: the search will soon ask for them."""
    if tree.kids[0].kids:
        return [tree]
    return [replace(tree, op=op, window=w) for op in ("ts_mean", "ts_std") for w in WINDOWS]


def _reads(tree) -> bool:
    """Whether the tree holds a column; windows over constants are not worth keeping."""
    return any(_reads(k) for k in tree.kids) if tree.kids else tree.op != "const"


#: What the names of columns that hold matrices begin with.
MATRIX = "x_"
STORED = "slice int, block int, dates int, names int, keys array<string>, data array<binary>"
SUMS = "slice int, i int, first long, pivot binary, mine binary, apart binary, sets binary, of binary"


class Evaluator:
    """Blocks of a panel and the windows stored with them.

    ``panel`` has a row for each slice, date and ticker: ``slice``, ``i`` (place of the date in the slice,
    from 0), ``ticker``, the terminals, ``y``, and the regressors and group of ``spec``.  ``use_store`` False
    computes every window anew; the results are the same.
    """

    def __init__(self, panel: DataFrame, terminals: Iterable[str], spec, folder: str | None = None, use_store: bool = True) -> None:
        self.spark, self.spec, self.use_store = panel.sparkSession, spec, use_store
        self.terminals = tuple(terminals)
        self.folder = folder or shared_folder(self.spark, "search")
        self.columns = (*self.terminals, "y", *spec.regressors, *([spec.group] if spec.group else []))
        self.version, self.stored = 0, set()
        #: Of each slice the number of dates, of names and of blocks, and its group codes.
        self.shapes: dict[int, dict] = {}
        places = self._places()
        if places is None:
            self._cut(panel)
        else:
            self.version, self.stored = places["version"], set(places["stored"])
            self.shapes = {int(s): shape for s, shape in places["shapes"].items()}

    @classmethod
    def of_blocks(cls, panel, terminals: Iterable[str], spec, ranges: dict[int, tuple[int, int]], folder: str | None = None) -> Evaluator:
        """Scores over the saved blocks of a :class:`.blocks.BlockPanel`, which has ``y``; a slice is a range of its dates, and nothing is written but states in ``folder``."""
        self = cls.__new__(cls)
        self.spark, self.spec, self.use_store, self.terminals = panel.spark, spec, False, tuple(terminals)
        self.folder, self.version, self.stored = folder, 0, set()
        self.columns = (*self.terminals, "y", *spec.regressors, *([spec.group] if spec.group else []))
        codes = panel.codes() if spec.group else []
        self.shapes = {s: {"dates": high - low, "codes": codes} for s, (low, high) in ranges.items()}
        self.panel, self.ranges = panel, ranges
        return self

    #: Blocks that hold whole panels, and the dates of each slice in them; None where the evaluator cuts its own blocks.
    panel, ranges = None, None

    # ---- the store

    def _path(self, version: int) -> str:
        return f"{self.folder}/blocks-{version}"

    def _places(self) -> dict | None:
        """What an interrupted run left in the folder."""
        found = read_state(self.spark, f"{self.folder}/store")
        return None if found is None else json.loads(found[1])

    def _cut(self, panel: DataFrame) -> None:
        columns, group, cores = self.columns, self.spec.group, self.spark.sparkContext.defaultParallelism
        codes = F.collect_set(F.col(group).cast("double")) if group else F.array().cast("array<double>")
        found = panel.groupBy("slice").agg((F.max("i") + 1).alias("dates"), F.approx_count_distinct("ticker").alias("names"), codes.alias("codes")).collect()
        for r in found:
            cells = r["dates"] * r["names"]
            blocks = max(1, -(-cells // MOST_CELLS), min(2 * cores, cells // LEAST_CELLS))
            self.shapes[r["slice"]] = {"dates": r["dates"], "names": r["names"], "blocks": min(blocks, max(1, r["names"])), "codes": sorted(c for c in r["codes"] if np.isfinite(c))}
        sizes = self.spark.createDataFrame([(s, x["dates"], x["blocks"]) for s, x in self.shapes.items()], "slice int, _dates int, _blocks int")
        rows = panel.select("slice", "i", "ticker", *[F.col(c).cast("double").alias(c) for c in columns]).join(F.broadcast(sizes), "slice")
        rows = rows.withColumn("block", F.pmod(F.xxhash64("ticker"), F.col("_blocks")).cast("int"))

        def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            names, dates = np.unique(pdf["ticker"]), int(pdf["_dates"].iloc[0])
            at = (pdf["i"].to_numpy(), np.searchsorted(names, pdf["ticker"].to_numpy()))
            data = []
            for c in columns:
                m = np.full((dates, len(names)), np.nan)
                m[at] = pdf[c].to_numpy(float)
                data.append(m.tobytes())
            return pd.DataFrame([(key[0], key[1], dates, len(names), list(columns), data)], columns=[c.split()[0] for c in STORED.split(", ")])

        # A fixed number of partitions: blocks are many rows' work each, though few bytes, and are not to be merged.
        blocks = sum(x["blocks"] for x in self.shapes.values())
        rows.repartition(max(1, min(2 * blocks, 4 * cores), blocks // 16), "slice", "block").groupBy("slice", "block").applyInPandas(build, STORED).write.options(**SAVED).mode("overwrite").parquet(self._path(0))
        self._note()

    def _note(self) -> None:
        write_state(self.spark, f"{self.folder}/store", self.version, json.dumps({"version": self.version, "stored": sorted(self.stored), "shapes": self.shapes}))

    def _room(self, slice: int) -> int:
        """Windows that the store may still take of a slice."""
        x = self.shapes[slice]
        column, whole = 8 * x["dates"] * -(-x["names"] // x["blocks"]), 8 * x["dates"] * x["names"]
        mine = sum(k.startswith(f"{slice}:") for k in self.stored)
        return min(BLOCK_STORE // column, WHOLE_STORE // len(self.shapes) // whole) - mine

    def _remember(self, wanted: list[Wanted]) -> None:
        """Adds the windows that are not stored yet to each block of their slices, as long as there is room."""
        met = {(w.slice, t.key()): t for w in wanted for t in _windows_inside(w.tree) if f"{w.slice}:{t.key()}" not in self.stored}
        fresh = {(s, k.key()): k for (s, _), t in met.items() for k in _siblings(t) if f"{s}:{k.key()}" not in self.stored}
        if not fresh or not self.use_store:
            return
        by_slice: dict[int, list] = {}
        for (s, _), t in fresh.items():
            by_slice.setdefault(s, []).append(t)
        by_slice = {s: trees[: self._room(s)] for s, trees in by_slice.items() if s in self.shapes and self._room(s) > 0}
        if not by_slice:
            return

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, r in _each(batches):
                block, more = _block(r), by_slice.get(r["slice"], [])
                r["keys"] = [*r["keys"], *[t.key() for t in more]]
                r["data"] = [*map(bytes, r["data"]), *[np.ascontiguousarray(block.value(t)).tobytes() for t in more]]
                yield pa.RecordBatch.from_pylist([r], schema=batch.schema)

        more = self.spark.read.schema(STORED).parquet(self._path(self.version)).mapInArrow(add, STORED)
        with row_by_row(self.spark):
            more.write.options(**SAVED).mode("overwrite").parquet(self._path(self.version + 1))
        self.version += 1
        self.stored |= {f"{s}:{t.key()}" for s, trees in by_slice.items() for t in trees}
        self._note()

    # ---- scores

    def ics(self, wanted: list[Wanted]) -> DataFrame:
        """slice, name, i, n and ic of the formulas ``wanted`` on each date of their slice."""
        self._remember(wanted)
        by_slice: dict[int, list[Wanted]] = {}
        for w in wanted:
            if w.slice in self.shapes:
                by_slice.setdefault(w.slice, []).append(w)
        passes: list[dict[int, list[Wanted]]] = [{}]
        for s, mine in by_slice.items():
            x = self.shapes[s]
            most = max(1, SUMS_BYTES // (len(by_slice) * x["dates"] * Sums.bytes_of(len(self.spec.regressors), len(x["codes"]))))
            for k, at in enumerate(range(0, len(mine), most)):
                if k == len(passes):
                    passes.append({})
                passes[k][s] = mine[at : at + most]
        found = self._pass(passes[0])
        for more in passes[1:]:
            found = found.unionAll(self._pass(more))
        return found

    def _pass(self, by_slice: dict[int, list[Wanted]]) -> DataFrame:
        spec, shapes, ranges, cores = self.spec, self.shapes, self.ranges, self.spark.sparkContext.defaultParallelism
        regressors = len(spec.regressors)
        schema = pa.schema([("slice", pa.int32()), ("i", pa.int32()), ("first", pa.int64()), *[(c, pa.binary()) for c in ("pivot", "mine", "apart", "sets", "of")]])

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, tuple[int, Sums]] = {}
            for _, r in _each(batches):
                for s, (low, high) in (ranges or {r.get("slice"): (0, r["dates"])}).items():
                    if mine := by_slice.get(s, []):
                        if s not in held:
                            held[s] = r["block"], Sums(len(mine), high - low, regressors, np.array(shapes[s]["codes"]))
                        held[s][1].add(_block(r, low, high), [w.tree for w in mine], spec.regressors, spec.group)
            for s, (first, total) in held.items():
                for d, *data in total.rows():
                    yield pa.RecordBatch.from_pydict({k: [v] for k, v in zip(schema.names, (s, d, first, *data), strict=True)}, schema=schema)

        def scored(key: tuple, rows: pa.Table) -> pa.Table:
            s, i = (k.as_py() for k in key)
            mine, codes = by_slice[s], len(shapes[s]["codes"])
            rows = sorted(rows.to_pylist(), key=lambda r: r["first"])
            n, ic = ics_of_sums([tuple(r[c] for c in ("pivot", "mine", "apart", "sets", "of")) for r in rows], len(mine), regressors, codes, spec.group is not None, spec.least_names)
            k = np.flatnonzero((n >= spec.least_names) & np.isfinite(ic))
            arrays = [pa.array([s] * len(k), pa.int32()), pa.array([mine[j].name for j in k], pa.string()), pa.array([i] * len(k), pa.int32()), pa.array(n[k], pa.int32()), pa.array(ic[k], pa.float64())]
            return pa.table(arrays, names=["slice", "name", "i", "n", "ic"])

        read = {*self.columns[len(self.terminals) :], *[c for mine in by_slice.values() for w in mine for c in _leaves(w.tree)]}
        saved = self.panel.read(tuple(c for c in self.columns if c in read)) if self.panel else self.spark.read.schema(STORED).parquet(self._path(self.version))
        parts = saved.coalesce(cores).mapInArrow(sums, SUMS)
        return parts.repartition(cores, "slice", "i").groupBy("slice", "i").applyInArrow(scored, "slice int, name string, i int, n int, ic double")

    def scores(self, wanted: list[Wanted], parts: DataFrame) -> dict[tuple[int, str, str], tuple[int, float, float]]:
        """(slice, name, part) -> days, mean IC and Newey-West t; ``parts`` has slice, part, low and high place (exclusive).

        The driver gets one row for each formula and part.
        """
        if not wanted:
            return {}
        inside = self.ics(wanted).join(F.broadcast(parts), "slice").where((F.col("i") >= F.col("low")) & (F.col("i") < F.col("high")))
        found = newey_west_t(inside, ["slice", "name", "part"], "ic", "i", 10)
        with row_by_row(self.spark):
            rows = found.collect()
        return {(r["slice"], r["name"], r["part"]): (r["n"], r["mean"], r["t"]) for r in rows}


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict]]:
    """Row by row, as a batch can hold hundreds of blocks; the matrices stay where Arrow has them."""
    for batch in batches:
        names = batch.schema.names
        for k in range(batch.num_rows):
            yield batch, {c: _value(batch.column(c)[k], c) for c in names}


def _value(x: pa.Scalar, name: str) -> object:
    if name == "data":
        return [v.as_buffer() for v in x.values]
    return x.as_buffer() if name.startswith(MATRIX) else x.as_py()


def matrices(r: dict, low: int = 0, high: int | None = None) -> dict[str, np.ndarray]:
    """The columns of a saved block on the dates from ``low`` to ``high``."""
    held = zip(r["keys"], r["data"], strict=True) if "data" in r else [(k.removeprefix(MATRIX), raw) for k, raw in r.items() if k.startswith(MATRIX)]
    return {k: np.frombuffer(raw, dtype=np.float64).reshape(r["dates"], r["names"])[low:high] for k, raw in held}


def _block(r: dict, low: int = 0, high: int | None = None) -> Block:
    return Block(matrices(r, low, high))


def write_state(spark: SparkSession, path: str, step: int, state: str) -> None:
    """One string as the state after ``step``, through Spark's writers, which reach every folder that the cluster can."""
    spark.createDataFrame([(state,)], "state string").coalesce(1).write.mode("overwrite").parquet(f"{path}/step-{step}")


def read_state(spark: SparkSession, path: str) -> tuple[int, str] | None:
    """The last step that was written to its end, and its string; None where there is none."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return None
    steps = [s.getPath() for s in files.listStatus(root)]
    done = [int(s.getName().rpartition("-")[2]) for s in steps if files.exists(s.suffix("/_SUCCESS"))]
    return (max(done), spark.read.parquet(f"{path}/step-{max(done)}").first()["state"]) if done else None


def pickled(value: object) -> str:
    return pickle.dumps(value).hex()


def unpickled(text: str) -> object:
    return pickle.loads(bytes.fromhex(text))
