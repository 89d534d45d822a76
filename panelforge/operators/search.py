"""Search for formulas by genetic programming over the expression planner.

A generation is scored in one job over saved blocks of the panel (:mod:`.evaluation`): a row for each
formula and date, then one for each formula.  The same job gives the ICs of the training dates, which
breed, and of the later validation dates, which choose.  :func:`fitness` scores the same formulas as
expressions of the planner, without blocks and store; the two agree.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, replace
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dag import DIGITS, Node, compute
from ..functions.ops import absolute, col, tanh, sign, ts_mean_frac, ts_std_frac, zscore
from .evaluation import WINDOWS, Evaluator, Wanted, pickled, read_state, unpickled, write_state
from .walkforward import residuals

BINARY = ("+", "-", "*", "/")
UNARY = ("neg", "abs", "tanh", "sign")
ROLLING = ("ts_mean", "ts_std")
#: Generations between two records of the state of a search.
SAVE_EVERY = 5


@dataclass(frozen=True)
class Tree:
    op: str
    kids: tuple["Tree", ...] = ()
    window: int = 0
    value: float = 0.0

    def size(self) -> int:
        return 1 + sum(k.size() for k in self.kids)

    def depth(self) -> int:
        return 1 + max((k.depth() for k in self.kids), default=0)

    def complexity(self) -> int:
        """Nodes, rolling operators counting three times."""
        return self.size() + 2 * self.rolling()

    def rolling(self) -> int:
        return (self.op in ROLLING) + sum(k.rolling() for k in self.kids)

    def key(self) -> str:
        if self.op == "const":
            return f"{self.value:.4f}"
        if not self.kids:
            return self.op
        if self.op in BINARY:
            return f"({self.kids[0].key()} {self.op} {self.kids[1].key()})"
        return f"{self.op}{self.window or ''}({self.kids[0].key()})"

    def paths(self, at: tuple[int, ...] = ()) -> list[tuple[int, ...]]:
        return [at, *[p for i, k in enumerate(self.kids) for p in k.paths((*at, i))]]

    def get(self, path: tuple[int, ...]) -> "Tree":
        return self.kids[path[0]].get(path[1:]) if path else self

    def put(self, path: tuple[int, ...], new: "Tree") -> "Tree":
        if not path:
            return new
        kids = list(self.kids)
        kids[path[0]] = kids[path[0]].put(path[1:], new)
        return replace(self, kids=tuple(kids))

    def node(self) -> Node:
        """The tree as an expression; a divisor within 1e-9 of zero gives null."""
        if self.op == "const":
            return Node.make("const", params=(self.value,))
        if not self.kids:
            return col(self.op)
        a = [k.node() for k in self.kids]
        match self.op:
            case "+": return a[0] + a[1]
            case "-": return a[0] - a[1]
            case "*": return a[0] * a[1]
            case "/": return Node.make("if", absolute(a[1]) > 1e-9, a[0] / a[1], Node.make("null"))
            case "neg": return -a[0]
            case "abs": return absolute(a[0])
            case "tanh": return tanh(a[0])
            case "sign": return sign(a[0])
            case "ts_mean": return ts_mean_frac(a[0], self.window)
        return ts_std_frac(a[0], self.window)


@dataclass(frozen=True)
class SearchSpec:
    population: int = 24
    generations: int = 3
    depth: int = 3
    elites: float = 0.06
    tournament: int = 5
    cross: float = 0.55
    mutate: float = 0.35
    constants: float = 0.06
    early_leaf: float = 0.25
    penalty: float = 0.022
    least_names: int = 10
    least_days: int = 40
    least_validation_days: int = 20
    train_share: float = 0.8
    purge: int = 5
    validated: int = 16
    gap_penalty: float = 0.15
    flip_penalty: float = 1.0
    least_gain: float = 1e-3
    patience: int = 25
    pool: int = 300
    kept: int = 10
    seed: int = 7
    regressors: tuple[str, ...] = ()
    group: str | None = None

    def __post_init__(self) -> None:
        if not 0 <= self.cross + self.mutate <= 1:
            raise ValueError("the chances of crossover and mutation pass 1")


def grow(rng: random.Random, terminals: tuple[str, ...], spec: SearchSpec, depth: int) -> Tree:
    if depth <= 1 or rng.random() < spec.early_leaf:
        return Tree("const", value=round(rng.uniform(-1.5, 1.5), 4)) if rng.random() < spec.constants else Tree(rng.choice(terminals))
    kind = rng.random()
    child = lambda: grow(rng, terminals, spec, depth - 1)
    if kind < 0.58:
        return Tree(rng.choice(BINARY), (child(), child()))
    if kind < 0.80:
        return Tree(rng.choice(UNARY), (child(),))
    return Tree(rng.choice(ROLLING), (child(),), window=rng.choice(WINDOWS))


def cross(rng: random.Random, a: Tree, b: Tree, spec: SearchSpec) -> Tree:
    new = a.put(rng.choice(a.paths()), b.get(rng.choice(b.paths())))
    return new if new.depth() <= spec.depth else a


def mutate(rng: random.Random, t: Tree, terminals: tuple[str, ...], spec: SearchSpec) -> Tree:
    path, kind = rng.choice(t.paths()), rng.random()
    at = t.get(path)
    if kind < 0.55:
        new = t.put(path, grow(rng, terminals, spec, max(1, spec.depth - len(path))))
    elif kind < 0.90:
        if at.op in BINARY:
            at = replace(at, op=rng.choice(BINARY))
        elif at.op in UNARY:
            at = replace(at, op=rng.choice(UNARY))
        elif at.op in ROLLING:
            at = replace(at, window=rng.choice(WINDOWS))
        else:
            at = Tree(rng.choice(terminals))
        new = t.put(path, at)
    else:
        new = t.put(path, replace(at, value=round(at.value + rng.gauss(0, 0.3), 4))) if at.op == "const" else t
    return new if new.depth() <= spec.depth else t


@dataclass(frozen=True)
class Score:
    """Newey-West t and mean of the daily ICs of some dates."""

    t: float
    mean_ic: float
    days: int


@dataclass(frozen=True)
class Candidate:
    """A formula met in the search, with its scores on training and validation dates (None: too few)."""

    tree: Tree
    train: Score | None
    validation: Score | None

    def objective(self, spec: SearchSpec) -> float:
        return self.train.t - spec.penalty * self.tree.complexity() if self.train else float("-inf")

    def adjusted(self, spec: SearchSpec) -> float:
        """The validation objective less penalties for falling behind training and for a change of sign."""
        if not self.train or not self.validation:
            return float("-inf")
        t, v = self.train.t, self.validation.t
        return v - spec.penalty * self.tree.complexity() - spec.gap_penalty * max(0.0, t - v) - spec.flip_penalty * (t * v < 0)


def newey_west(series: list[float], least: int, lags: int = 10) -> Score | None:
    n = len(series)
    if n < max(least, 3):
        return None
    mean = sum(series) / n
    u = [x - mean for x in series]
    most = min(lags, n - 2)
    var = sum(x * x for x in u) / n + sum(2 * (1 - k / (most + 1)) * sum(a * b for a, b in zip(u[k:], u, strict=False)) / n for k in range(1, most + 1))
    return Score(mean / (max(var, 1e-18) / n) ** 0.5, mean, n)


def purged_split(panel: DataFrame, spec: SearchSpec) -> tuple:
    """The last training and the first validation date: ``purge`` dates on either side of the cut are in neither."""
    at = Window.orderBy("date")
    found = panel.select("date").distinct().withColumn("i", F.row_number().over(at) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))
    cut = F.floor(F.col("n") * spec.train_share)
    ends = found.agg(F.max(F.when(F.col("i") < cut - spec.purge, F.col("date"))), F.min(F.when(F.col("i") >= cut + spec.purge, F.col("date")))).first()
    return ends[0], ends[1]


def neutral_ics(wide: DataFrame, names: list[str], spec: SearchSpec) -> DataFrame:
    """g, date, n and ic of each formula's residual on ``spec.regressors`` and dummies of ``spec.group``, date by date."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, risks = [], pdf[list(spec.regressors)].notna().all(axis=1).to_numpy()
        for g in names:
            x, y = pdf[g].to_numpy(float), pdf["target"].to_numpy(float)
            good = risks & np.isfinite(x)
            if good.sum() < spec.least_names or x[good].std() <= 1e-12:
                continue
            x = residuals((x[good] - x[good].mean()) / x[good].std(), pdf[good], spec.regressors, spec.group)
            both = np.isfinite(y[good])
            x, y = x[both], y[good][both]
            if len(x) >= spec.least_names and x.std() > 1e-9 and y.std() > 1e-12:
                rows.append((g, pdf["date"].iloc[0], len(x), float(np.corrcoef(x, y)[0, 1])))
        return pd.DataFrame(rows, columns=["g", "date", "n", "ic"])

    return wide.groupBy("date").applyInPandas(one, "g string, date date, n long, ic double")


def _plain_ics(wide: DataFrame, names: dict[str, str]) -> DataFrame:
    long = wide.where("target IS NOT NULL").select("date", "target", F.explode(F.array(*[F.struct(F.lit(g).alias("g"), F.col(g).alias("x")) for g in names])).alias("e")).select("date", "target", "e.*")
    sd = F.stddev_samp("x") * F.stddev_samp("target")
    return long.where("x IS NOT NULL").groupBy("g", "date").agg(F.count("*").alias("n"), F.when(sd > 1e-12, F.covar_samp("x", "target") / F.nullif(sd, F.lit(0.0))).alias("ic"))


def fitness(panel: DataFrame, trees: list[Tree], target: Node, spec: SearchSpec, ends: tuple) -> dict[str, Candidate]:
    """Formula -> candidate, of the formulas that hold a column; scored in one job."""
    unique = {t.key(): t for t in trees if has_column(t)}
    if not unique:
        return {}
    names = {f"g{i}": k for i, k in enumerate(unique)}
    outputs = {g: zscore(unique[k].node(), spec.least_names) for g, k in names.items()} | {"target": target}
    if spec.group:
        keep = (*spec.regressors, spec.group)
        ic = neutral_ics(compute(panel, {g: unique[k].node() for g, k in names.items()} | {"target": target}, keep=keep), list(names), spec)
    else:
        ic = _plain_ics(compute(panel, outputs), names)
    ic = ic.where((F.col("n") >= spec.least_names) & F.col("ic").isNotNull())
    series = F.array_sort(F.collect_list(F.struct("date", "ic")))
    last, first = ends
    out = {}
    for r in ic.groupBy("g").agg(series.alias("s")).collect():
        key = names[r["g"]]
        train = newey_west([x["ic"] for x in r["s"] if last is not None and x["date"] <= last], spec.least_days)
        validation = newey_west([x["ic"] for x in r["s"] if first is not None and x["date"] >= first], spec.least_validation_days)
        out[key] = Candidate(unique[key], train, validation)
    return out


@dataclass(frozen=True)
class Found:
    formula: str
    adjusted: float
    objective: float
    t: float
    validation_t: float | None
    mean_ic: float
    complexity: int
    generations: int


class Search:
    """One search as a sequence of generations: ``unseen`` formulas are scored somewhere and given to ``learn``.

    Training ICs breed the generations.  The best of each generation are looked at on the validation
    dates; the search ends early after ``patience`` generations without a better one.  The result is
    drawn from a pool that favours formulas that stayed over generations; the best one validated leads
    it into the table.  The same seed gives the same search.  The whole state is plain data, so a
    search can be written down after any generation and go on later.
    """

    def __init__(self, terminals: tuple[str, ...], spec: SearchSpec) -> None:
        self.terminals, self.spec = terminals, spec
        self.rng = random.Random(spec.seed)
        self.people = [grow(self.rng, terminals, spec, self.rng.randint(1, spec.depth)) for _ in range(spec.population)]
        self.seen: dict[str, Candidate] = {}
        #: Training and validation scores of each kin met so far.
        self.kin: dict[str, tuple[Score | None, Score | None]] = {}
        self.stayed: dict[str, int] = {}
        self.best, self.best_key, self.idle, self.generation = float("-inf"), None, 0, 0

    @property
    def done(self) -> bool:
        return self.idle >= self.spec.patience or self.generation >= self.spec.generations

    def unseen(self) -> dict[str, Tree]:
        """Formulas of this generation that hold a column and were not met before."""
        return {k: t for k, t in {t.key(): t for t in self.people}.items() if k not in self.seen and has_column(t)}

    def learn(self, scores: dict[str, Candidate]) -> None:
        spec, rng, seen = self.spec, self.rng, self.seen
        for t in self.people:
            k = t.key()
            if k not in seen:
                seen[k] = scores.get(k, Candidate(t, None, None))
        ranks = [(-seen[k].objective(spec), k) for k in (t.key() for t in self.people)]
        order = sorted(range(len(ranks)), key=ranks.__getitem__)
        distinct = list({ranks[i][1]: self.people[i] for i in order}.items())
        for k, _ in distinct:
            self.stayed[k] = self.stayed.get(k, 0) + 1
        adjusted, top = max((seen[k].adjusted(spec), k) for k, _ in distinct[: spec.validated])
        self.generation += 1
        if adjusted > self.best + spec.least_gain:
            self.best, self.best_key, self.idle = adjusted, top, 0
        else:
            self.idle += 1
        if self.done:
            return
        parents = self.people

        def pick() -> Tree:
            return parents[min((rng.randrange(len(parents)) for _ in range(spec.tournament)), key=ranks.__getitem__)]

        people = [t for _, t in distinct[: max(1, int(spec.elites * spec.population))]]
        while len(people) < spec.population:
            u = rng.random()
            people.append(cross(rng, pick(), pick(), spec) if u < spec.cross else mutate(rng, pick(), self.terminals, spec) if u < spec.cross + spec.mutate else pick())
        self.people = people

    def table(self) -> list[Found]:
        return _table(self.seen, self.stayed, self.best_key, self.spec)

    def leaders(self) -> dict[str, Tree]:
        """The formulas of the table, best first."""
        return {f.formula: self.seen[f.formula].tree for f in self.table()}


def has_column(t: Tree) -> bool:
    return any(has_column(k) for k in t.kids) if t.kids else t.op != "const"


def kin(tree: Tree) -> tuple[str, int]:
    """What formulas of the same ICs have in common, and 1, or -1 where this one has them with the other sign.

    An IC does not change with a formula's scale and offset, and its sign goes with the formula's.  So sums are put
    in order, and factors and constants move out of sums, products, quotients and windows as far as they decide
    neither what is missing nor a threshold; sums in which a term cancels stay as they are.
    """
    text, scale = _scaled(*_linear(tree), offset=False)
    return text, -1 if scale < 0 else 1


def _scaled(terms: dict[str, Fraction], constant: Fraction, offset: bool) -> tuple[str, Fraction]:
    """The text of a sum over its first factor, and that factor; with ``offset``, the constant is part of it."""
    first = terms[min(terms)] if terms else constant or Fraction(1)
    return " ".join([*[f"{c / first}*{a}" for a, c in sorted(terms.items())], *([str(constant / first)] if offset else [])]), first


def _linear(t: Tree) -> tuple[dict[str, Fraction], Fraction]:
    """A formula as factors of parts, none of them 0, and a constant."""
    if t.op == "const":
        return {}, Fraction(repr(t.value))
    if not t.kids:
        return {t.op: Fraction(1)}, Fraction(0)
    kids = [_linear(k) for k in t.kids]
    if not all(terms for terms, _ in kids) and t.op not in "+-*":
        return {t.key(): Fraction(1)}, Fraction(0)
    terms, constant = kids[0]
    match t.op:
        case "+" | "-":
            sign = 1 if t.op == "+" else -1
            terms = dict(terms)
            for a, c in kids[1][0].items():
                terms[a] = terms.get(a, 0) + sign * c
            return (terms, constant + sign * kids[1][1]) if all(terms.values()) else ({t.key(): Fraction(1)}, Fraction(0))
        case "*":
            for one, other in (kids, kids[::-1]):
                if not one[0]:
                    return ({a: one[1] * c for a, c in other[0].items()}, one[1] * other[1]) if one[1] else ({t.key(): Fraction(1)}, Fraction(0))
            (a, s), (b, r) = (_scaled(*k, offset=True) for k in kids)
            return {f"({min(a, b)}) * ({max(a, b)})": s * r}, Fraction(0)
        case "neg":
            return {a: -c for a, c in terms.items()}, -constant
        case "/":
            (a, s), (b, r) = (_scaled(*k, offset=True) for k in kids)
            return {f"({a}) / {abs(r)}({b})": s if r > 0 else -s}, Fraction(0)
        case "abs":
            a, s = _scaled(terms, constant, offset=True)
            return {f"abs({a})": abs(s)}, Fraction(0)
        case "ts_mean" | "ts_std":
            a, s = _scaled(terms, constant, offset=False)
            return {f"{t.op}{t.window}({a})": s if t.op == "ts_mean" else abs(s)}, constant if t.op == "ts_mean" else Fraction(0)
    a, s = _scaled(terms, constant, offset=True)
    return {f"{t.op}({abs(s)}({a}))": Fraction(1 if s > 0 else -1)}, Fraction(0)


def split_places(n: int, spec: SearchSpec) -> list[tuple[str, int, int]]:
    """Places of the training and of the validation dates of ``n``; ``purge`` dates on either side of the cut are in neither."""
    cut = int(n * spec.train_share)
    return [("train", 0, cut - spec.purge), ("validation", cut + spec.purge, n)]


def score_of(found: tuple[int, float, float] | None, least: int) -> Score | None:
    """Rounded, so that the order in which sums were added up decides nothing."""
    if found is None or found[0] < max(least, 3):
        return None
    n, mean, t = found
    return Score(round(t if t is not None else mean * 1e9 * n**0.5, DIGITS), round(mean, DIGITS), n)


def signed(score: Score | None, sign: int) -> Score | None:
    return score if score is None or sign > 0 else Score(0.0 - score.t, 0.0 - score.mean_ic, score.days)


def run_searches(searches: dict[int, Search], evaluator: Evaluator, dates: dict[int, int], save: bool = False, stop_after: int | None = None) -> None:
    """All searches to their ends, one job a generation for all of them; ``searches`` and ``dates`` (number of dates) are by slice.

    With ``save``, the state is written every few generations beside the evaluator's blocks and taken up
    again from there: after a stop in the middle the same call gives the same searches.  ``stop_after`` is
    such a stop, after so many generations.
    """
    spark, spec = evaluator.spark, evaluator.spec
    parts = spark.createDataFrame([(s, *p) for s, n in dates.items() for p in split_places(n, spec)], "slice int, part string, low int, high int")
    step = 0
    if save and (found := read_state(spark, f"{evaluator.folder}/searches")):
        step = found[0]
        searches.update(unpickled(found[1]))
    while active := {s: x for s, x in searches.items() if not x.done and (stop_after is None or step < stop_after)}:
        unseen = {s: {k: (t, *kin(t)) for k, t in x.unseen().items()} for s, x in active.items()}
        # Of formulas with the same ICs one is scored, once.
        asked = {s: {of: (t, sign) for t, of, sign in reversed(new.values()) if of not in active[s].kin} for s, new in unseen.items()}
        scores = evaluator.scores([Wanted(s, of, t) for s, new in asked.items() for of, (t, _) in new.items()], parts)
        for s, x in active.items():
            for of, (_, sign) in asked[s].items():
                found = score_of(scores.get((s, of, "train")), spec.least_days), score_of(scores.get((s, of, "validation")), spec.least_validation_days)
                x.kin[of] = tuple(signed(f, sign) for f in found)
            x.learn({k: Candidate(t, *[signed(f, sign) for f in x.kin[of]]) for k, (t, of, sign) in unseen[s].items()})
        step += 1
        if save and (step % SAVE_EVERY == 0 or all(x.done for x in searches.values()) or step == stop_after):
            write_state(spark, f"{evaluator.folder}/searches", step, pickled(searches))


def placed(panel: DataFrame) -> tuple[DataFrame, int]:
    """``panel`` as slice 0 with ``i``, the place of its date, and the number of dates; dates are few beside rows."""
    days = panel.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)
    return panel.join(F.broadcast(days), "date").withColumn("slice", F.lit(0)), days.count()


def evolve_blocks(panel, terminals: tuple[str, ...], spec: SearchSpec = SearchSpec(), folder: str | None = None) -> list[Found]:
    """As :func:`evolve`, over the saved blocks of a :class:`.blocks.BlockPanel` with ``y``."""
    searches = {0: Search(terminals, spec)}
    if dates := len(panel.dates):
        run_searches(searches, Evaluator.of_blocks(panel, terminals, spec, {0: (0, dates)}, folder), {0: dates}, save=folder is not None)
    return searches[0].table()


def evolve(panel: DataFrame, terminals: tuple[str, ...], target: Node, spec: SearchSpec = SearchSpec(), folder: str | None = None) -> list[Found]:
    """The best formulas found over the whole panel, best first; with ``folder``, a run that was stopped goes on from there."""
    keep = tuple(dict.fromkeys((*terminals, *spec.regressors, *([spec.group] if spec.group else []))))
    rows, dates = placed(compute(panel, {"y": target}, keep=keep))
    searches = {0: Search(terminals, spec)}
    if dates:
        run_searches(searches, Evaluator(rows, terminals, spec, folder), {0: dates}, save=folder is not None)
    return searches[0].table()


def _table(seen: dict[str, Candidate], stayed: dict[str, int], best_key: str | None, spec: SearchSpec) -> list[Found]:
    good = [(k, c) for k, c in seen.items() if c.train]
    pool = sorted(good, key=lambda x: (-(x[1].objective(spec) + 0.05 * stayed[x[0]]), x[0]))[: spec.pool]

    def order(x: tuple[str, Candidate]) -> tuple:
        k, c = x
        return -c.adjusted(spec), -stayed[k], -(c.validation.t if c.validation else float("-inf")), -c.objective(spec), c.tree.complexity(), k

    chosen = sorted(pool, key=order)[: spec.kept]
    if best_key is not None and best_key not in dict(chosen):
        chosen = [(best_key, seen[best_key]), *chosen][: spec.kept]
    return [
        Found(k, c.adjusted(spec), c.objective(spec), c.train.t, c.validation.t if c.validation else None, c.train.mean_ic, c.tree.complexity(), stayed[k]) for k, c in sorted(chosen, key=order)
    ]
