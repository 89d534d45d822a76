"""Expressions over a dense panel, and the planner that turns them into few shuffles.

A :class:`Node` is built once for each distinct expression (hash-consing), so formulas share what
they have in common.  Row-wise nodes are inlined; window nodes become named columns.  Windows run
over the rows of a ticker (``T``) or of a date (``D``; groups of a date need no other partitioning).
The planner deals windows into waves of one partitioning, so a whole library of formulas costs one
exchange for each alternation of its deepest formula and not one for each formula.

The same plan is emitted for Spark and, as the reference for tests, for DuckDB.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import ClassVar, Union

from pyspark.sql import DataFrame

Number = Union[int, float]

#: Values are compared, ranked and searched at this many decimals, so that the last bits of a sum,
#: which depend on the order of addition, do not decide.
DIGITS = 9


@dataclass(frozen=True, eq=False)
class Node:
    """One expression; equal expressions are the same object."""

    op: str
    args: tuple["Node", ...] = ()
    params: tuple = ()
    _all: ClassVar[dict] = {}

    @staticmethod
    def make(op: str, *args: "Node | Number", params: tuple = ()) -> "Node":
        nodes = tuple(a if isinstance(a, Node) else Node.make("const", params=(float(a),)) for a in args)
        mark = (op, tuple(id(a) for a in nodes), params)
        if mark not in Node._all:
            Node._all[mark] = Node(op, nodes, params)
        return Node._all[mark]

    def __add__(self, o): return Node.make("+", self, o)
    def __radd__(self, o): return Node.make("+", o, self)
    def __sub__(self, o): return Node.make("-", self, o)
    def __rsub__(self, o): return Node.make("-", o, self)
    def __mul__(self, o): return Node.make("*", self, o)
    def __rmul__(self, o): return Node.make("*", o, self)
    def __truediv__(self, o): return Node.make("/", self, o)
    def __rtruediv__(self, o): return Node.make("/", o, self)
    def __neg__(self): return Node.make("neg", self)
    def __pow__(self, o): return Node.make("pow", self, o)
    def __lt__(self, o): return Node.make("<", self, o)
    def __gt__(self, o): return Node.make("<", o, self)
    def __le__(self, o): return Node.make("<=", self, o)
    def __ge__(self, o): return Node.make("<=", o, self)
    def __or__(self, o): return Node.make("or", self, o)
    def __and__(self, o): return Node.make("and", self, o)


WINDOWS = {
    "T": {"delay", "ts_sum", "ts_mean", "ts_min", "ts_max", "ts_std", "ts_corr", "ts_cov", "ts_product", "ts_argmax", "ts_argmin", "ts_rank", "ts_decay", "ts_mean_frac", "ts_std_frac", "ts_beta", "fwd_sum", "ffill", "cum_count"},
    "D": {"rank", "rank_ordinal", "scale", "zscore", "neutral", "cs_mean", "cs_sum"},
}
KIND = {op: kind for kind, ops in WINDOWS.items() for op in ops}


class Dialect:
    """The few places where Spark and DuckDB write the same thing differently."""

    def __init__(self, spark: bool) -> None:
        self.spark = spark

    def array(self, x: str, over: str) -> str:
        return f"collect_list({x}) OVER {over}" if self.spark else f"list({x}) OVER {over}"

    def position(self, array: str, best: str) -> str:
        return f"array_position({array}, array_{best}({array}))" if self.spark else f"list_position({array}, list_{best}({array}))"

    def at_most(self, array: str, x: str) -> str:
        return f"size(filter({array}, z -> z <= {x}))" if self.spark else f"len(list_filter({array}, lambda z: z <= {x}))"

    def product(self, x: str, over: str) -> str:
        return f"aggregate(collect_list({x}) OVER {over}, CAST(1 AS DOUBLE), (a, z) -> a * z)" if self.spark else f"product({x}) OVER {over}"

    def last(self, x: str, over: str) -> str:
        return f"last({x}, true) OVER {over}" if self.spark else f"last_value({x} IGNORE NULLS) OVER {over}"

    def struct(self, *columns: str) -> str:
        return f"{'struct' if self.spark else 'row'}({', '.join(columns)})"


SPARK, DUCK = Dialect(True), Dialect(False)


def literal(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


class Emitter:
    """Text of nodes in one dialect; ``names`` has the windows that are columns already."""

    def __init__(self, dialect: Dialect, keys: tuple[str, str]) -> None:
        self.d = dialect
        self.date, self.ticker = keys
        self.names: dict[Node, str] = {}

    def text(self, n: Node) -> str:
        if n in self.names:
            return self.names[n]
        a = [self.text(x) for x in n.args]
        match n.op:
            case "col":
                return n.params[0]
            case "const":
                return literal(n.params[0])
            case "+" | "-" | "*":
                return f"({a[0]} {n.op} {a[1]})"
            case "/":
                return f"({a[0]} / nullif({a[1]}, 0))"
            case "div_eps":
                return f"({a[0]} / ({a[1]} + {literal(1e-12)}))"
            case "neg":
                return f"(-{a[0]})"
            case "abs" | "exp" | "tanh" | "floor":
                return f"{n.op}({a[0]})"
            case "sqrt":
                return f"(CASE WHEN {a[0]} >= 0 THEN sqrt({a[0]}) END)"
            case "sign":
                return f"CAST(sign(round({a[0]}, {DIGITS})) AS DOUBLE)"
            case "ln":
                return f"(CASE WHEN {a[0]} > 0 THEN ln({a[0]}) END)"
            case "pow":
                raised = f"power({a[0]}, {a[1]})"
                safe = f"(CASE WHEN {a[0]} > 0 OR ({a[0]} = 0 AND {a[1]} > 0) OR ({a[0]} < 0 AND {a[1]} = floor({a[1]})) THEN {raised} END)"
                return f"(CASE WHEN {a[0]} = 1 OR {a[1]} = 0 THEN 1.0 WHEN abs({safe}) < 1e300 THEN {safe} END)"
            case "parity":
                return f"(CASE WHEN {a[0]} = floor({a[0]}) THEN CASE WHEN mod(CAST({a[0]} AS BIGINT), 2) = 0 THEN 1.0 ELSE -1.0 END END)"
            case "<" | "<=":
                return f"(round({a[0]}, {DIGITS}) {n.op} round({a[1]}, {DIGITS}))"
            case "or" | "and":
                return f"({a[0]} {n.op.upper()} {a[1]})"
            case "flag":
                return f"CAST(CASE WHEN {a[0]} THEN 1 ELSE 0 END AS DOUBLE)"
            case "if":
                return f"(CASE WHEN {a[0]} THEN {a[1]} ELSE {a[2]} END)"
            case "known":
                return f"({a[0]} IS NOT NULL)"
            case "null":
                return "CAST(NULL AS DOUBLE)"
            case "coalesce":
                return f"coalesce({a[0]}, {a[1]})"
            case "maxn" | "minn":
                return f"(CASE WHEN {a[0]} IS NOT NULL AND {a[1]} IS NOT NULL THEN {'greatest' if n.op == 'maxn' else 'least'}({a[0]}, {a[1]}) END)"
            case "clip":
                return f"(CASE WHEN {a[0]} IS NOT NULL THEN least(greatest({a[0]}, {literal(n.params[0])}), {literal(n.params[1])}) END)"
            case "nullif0":
                return f"nullif({a[0]}, 0)"
        return self.window(n, a)

    def _rows(self, first: str, last: str = "CURRENT ROW") -> str:
        return f"(PARTITION BY {self.ticker} ORDER BY {self.date} ROWS BETWEEN {first} AND {last})"

    def window(self, n: Node, a: list[str]) -> str:
        d, x = self.d, a[0]
        w = n.params[0] if n.params else 0
        over = self._rows(f"{w - 1} PRECEDING") if isinstance(w, int) and w > 0 else ""
        full = f"count({x}) OVER {over} = {w}"
        rounded = f"round({x}, {DIGITS})"
        day = f"(PARTITION BY {self.date})"
        match n.op:
            case "delay":
                return f"lag({x}, {w}) OVER (PARTITION BY {self.ticker} ORDER BY {self.date})"
            case "ts_sum" | "ts_min" | "ts_max" | "ts_mean" | "ts_std":
                name = {"ts_mean": "avg", "ts_std": "stddev_samp"}.get(n.op, n.op[3:])
                return f"(CASE WHEN {full} THEN {name}({x}) OVER {over} END)"
            case "ts_mean_frac" | "ts_std_frac":
                least = -(-w * 4 // 5)
                name = "avg" if n.op == "ts_mean_frac" else "stddev_samp"
                started = f"row_number() OVER (PARTITION BY {self.ticker} ORDER BY {self.date}) >= {w}"
                return f"(CASE WHEN {started} AND count({x}) OVER {over} >= {max(least, 3 if n.op == 'ts_std_frac' else 1)} THEN {name}({x}) OVER {over} END)"
            case "ts_corr" | "ts_cov" | "ts_beta":
                y = a[1]
                both = f"count({x} + {y}) OVER {over} = {w}"
                cov = f"covar_samp({x}, {y}) OVER {over}"
                if n.op == "ts_cov":
                    return f"(CASE WHEN {both} THEN {cov} END)"
                live = lambda v: f"stddev_samp({v}) OVER {over} > 1e-10 * (abs(avg({v}) OVER {over}) + 0.01)"
                if n.op == "ts_beta":
                    return f"(CASE WHEN {both} AND {live(y)} THEN {cov} / nullif(var_samp({y}) OVER {over}, 0) END)"
                return f"(CASE WHEN {both} AND {live(x)} AND {live(y)} THEN {cov} / nullif(stddev_samp({x}) OVER {over} * stddev_samp({y}) OVER {over}, 0) END)"
            case "ts_product":
                return f"(CASE WHEN {full} THEN {d.product(x, over)} END)"
            case "ts_argmax" | "ts_argmin":
                return f"(CASE WHEN {full} THEN CAST({d.position(d.array(rounded, over), n.op[-3:])} - 1 AS DOUBLE) END)"
            case "ts_rank":
                return f"(CASE WHEN {full} THEN CAST({d.at_most(d.array(rounded, over), rounded)} AS DOUBLE) / {w} END)"
            case "ts_decay":
                newest = bool(n.params[1]) if len(n.params) > 1 else False
                order = f"OVER (PARTITION BY {self.ticker} ORDER BY {self.date})"
                terms = [f"{w - i if newest else i + 1} * {f'lag({x}, {i}) {order}' if i else x}" for i in range(w)]
                return f"(({' + '.join(terms)}) / {w * (w + 1) / 2})"
            case "fwd_sum":
                ahead = self._rows("1 FOLLOWING", f"{w} FOLLOWING")
                return f"(CASE WHEN count({x}) OVER {ahead} = {w} THEN sum({x}) OVER {ahead} END)"
            case "ffill":
                return d.last(x, self._rows(f"{w} PRECEDING" if w else "UNBOUNDED PRECEDING"))
            case "cum_count":
                return f"count({x}) OVER {self._rows('UNBOUNDED PRECEDING')}"
            case "rank":
                by = f"PARTITION BY {self.date} ORDER BY {rounded} NULLS LAST"
                ties = f"count(*) OVER ({by} RANGE BETWEEN CURRENT ROW AND CURRENT ROW)"
                return f"(CASE WHEN {x} IS NOT NULL THEN (rank() OVER ({by}) + ({ties} - 1) / {literal(2.0)}) / count({x}) OVER {day} END)"
            case "rank_ordinal":
                by = f"PARTITION BY {self.date} ORDER BY {rounded} NULLS LAST, {self.ticker}"
                return f"(CASE WHEN {x} IS NOT NULL THEN CAST(row_number() OVER ({by}) AS DOUBLE) / count({x}) OVER {day} - {literal(0.5)} END)"
            case "scale":
                return f"({x} / nullif(sum(abs({x})) OVER {day}, 0))"
            case "cs_mean":
                return f"avg({x}) OVER {day}"
            case "cs_sum":
                return f"sum({x}) OVER {day}"
            case "zscore":
                least, sample = n.params
                sd = f"{'stddev_samp' if sample else 'stddev_pop'}({x}) OVER {day}"
                return f"(CASE WHEN count({x}) OVER {day} >= {least} AND {sd} > 1e-12 THEN ({x} - avg({x}) OVER {day}) / nullif({sd}, 0) END)"
            case "neutral":
                return f"(CASE WHEN {a[1]} IS NOT NULL THEN {x} - avg({x}) OVER (PARTITION BY {self.date}, {a[1]}) END)"
        raise ValueError(f"no such operator: {n.op}")


@dataclass(frozen=True)
class Step:
    """Windows that can be computed in one select; ``wave`` counts changes of partitioning."""

    wave: int
    kind: str
    windows: tuple[Node, ...]


def plan(outputs: list[Node]) -> list[Step]:
    """Steps in order.  A window comes in the earliest wave of its partitioning after those it needs."""
    at: dict[Node, tuple[int, int]] = {}
    below: dict[Node, tuple[Node, ...]] = {}

    def inner(n: Node) -> tuple[Node, ...]:
        """The nearest windows below a node (itself, if it is one)."""
        if n not in below:
            deep = tuple(dict.fromkeys(x for c in n.args for x in inner(c)))
            if n.op in KIND:
                visit(n, deep)
                below[n] = (n,)
            else:
                below[n] = deep
        return below[n]

    def visit(n: Node, needs: tuple[Node, ...]) -> None:
        parity = 0 if KIND[n.op] == "T" else 1
        wave = max((at[x][0] for x in needs), default=0)
        wave += (wave & 1) != parity
        at[n] = (wave, max((at[x][1] + 1 for x in needs if at[x][0] == wave), default=0))

    for n in outputs:
        inner(n)
    steps: dict[tuple[int, int], list[Node]] = {}
    for n, place in at.items():
        steps.setdefault(place, []).append(n)
    return [Step(w, "T" if w % 2 == 0 else "D", tuple(steps[w, k])) for w, k in sorted(steps)]


def compute(panel: DataFrame, outputs: dict[str, Node], keys: tuple[str, str] = ("date", "ticker"), keep: tuple[str, ...] = ()) -> DataFrame:
    """``panel`` rows with a column for each output.

    Windows of a wave share one exchange: the panel is dealt by ticker or by date once a wave, and
    each select only carries the columns that later steps still need.
    """
    emitter = Emitter(SPARK, keys)
    steps = plan(list(outputs.values()))
    live = _last_use(steps, list(outputs.values()))
    df = panel
    for i, step in enumerate(steps):
        fresh = {n: f"w{i}_{j}" for j, n in enumerate(step.windows)}
        texts = [f"{emitter.text(n)} AS {name}" for n, name in fresh.items()]
        held = [*panel.columns, *[name for n, name in emitter.names.items() if live[n] >= i]]
        df = df.selectExpr(*[f"`{c}`" for c in held], *texts)
        emitter.names.update(fresh)
    return df.selectExpr(*keys, *keep, *[f"{emitter.text(n)} AS `{name}`" for name, n in outputs.items()])


def _last_use(steps: list[Step], outputs: list[Node]) -> dict[Node, int]:
    """The last step (or ``len(steps)``) that reads each window."""
    last: dict[Node, int] = {}

    def read(n: Node, i: int, top: bool = False) -> None:
        if n.op in KIND and not top:
            last[n] = max(last.get(n, -1), i)
            return
        for c in n.args:
            read(c, i)

    for i, s in enumerate(steps):
        for n in s.windows:
            last.setdefault(n, -1)
            read(n, i, True)
    for n in outputs:
        read(n, len(steps))
    return last


def duck_sql(source: str, outputs: dict[str, Node], keys: tuple[str, str] = ("date", "ticker"), keep: tuple[str, ...] = ()) -> tuple[list[str], str]:
    """Common table expressions after ``source`` and the final select, in DuckDB's dialect."""
    emitter = Emitter(DUCK, keys)
    ctes, last = [], source
    for i, step in enumerate(plan(list(outputs.values()))):
        fresh = {n: f"w{i}_{j}" for j, n in enumerate(step.windows)}
        texts = [f"{emitter.text(n)} AS {name}" for n, name in fresh.items()]
        ctes.append(f"{source}_{i} AS (SELECT *, {', '.join(texts)} FROM {last})")
        last = f"{source}_{i}"
        emitter.names.update(fresh)
    return ctes, f"SELECT {', '.join([*keys, *keep, *[f'{emitter.text(n)} AS {name}' for name, n in outputs.items()]])} FROM {last}"
