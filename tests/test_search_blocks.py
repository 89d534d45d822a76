"""The formula search over blocks: equal to the planner's expressions, with and without store, and after a stop."""

import datetime as dt

import numpy as np
import pytest

from panelforge.functions.ops import col
from panelforge.operators import evaluation
from panelforge.operators.connector import search_slices, seed_of, terminals_of
from panelforge.operators.evaluation import Evaluator, Wanted
from panelforge.operators.search import Search, SearchSpec, Tree, fitness, grow, placed, purged_split, run_searches
from panelforge.operators.walkforward import ScreenSpec

DAY = dt.date(2020, 1, 6)
SPEC = SearchSpec(population=10, generations=7, least_names=5, least_days=20, least_validation_days=5, purge=2, patience=50, regressors=("risk",), group="sector")


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(3)
    rows = []
    for d in range(130):
        for t in range(14):
            a, b, e, r = rng.normal(size=4)
            hole = rng.random() < 0.05
            rows.append((DAY + dt.timedelta(d), t, float(t % 3), float(r), None if hole else float(a), float(b), float(0.4 * a + e)))
    df = spark.createDataFrame(rows, "date date, ticker long, sector double, risk double, a double, b double, y double")
    return df.cache()


def trees(n, seed):
    import random

    rng = random.Random(seed)
    found = {t.key(): t for t in (grow(rng, ("a", "b"), SPEC, 3) for _ in range(n))}
    return [t for t in found.values() if any(not t.get(p).kids and t.get(p).op != "const" for p in t.paths())]


@pytest.mark.parametrize("regressors, group", [(("risk",), "sector"), ((), None)])
def test_blocks_score_like_expressions(spark, panel, regressors, group, monkeypatch):
    import dataclasses

    monkeypatch.setattr(evaluation, "BLOCK_DATES", 17)
    spec = dataclasses.replace(SPEC, regressors=regressors, group=group)
    wanted = [*trees(40, 1), Tree("/", (Tree("a"), Tree("ts_std", (Tree("ts_mean", (Tree("a"),), window=20),), window=5)))]
    whole = fitness(panel, wanted, col("y"), spec, purged_split(panel, spec))
    rows, dates = placed(panel)
    parts = spark.createDataFrame([(0, "train", 0, int(dates * 0.8) - 2), (0, "validation", int(dates * 0.8) + 2, dates)], "slice int, part string, low int, high int")
    found = Evaluator(rows, ("a", "b"), spec).scores([Wanted(0, t.key(), t) for t in wanted], parts)
    assert len(whole) > 20
    for key, c in whole.items():
        for part, score, least in (("train", c.train, 20), ("validation", c.validation, 5)):
            n, mean, t = found.get((0, key, part), (0, None, None))
            assert (score is None) == (n < least), key
            if score:
                assert n == score.days and mean == pytest.approx(score.mean_ic, abs=1e-9), key
                if part == "train":
                    assert t == pytest.approx(score.t, rel=1e-6), key


def run(panel, **more):
    rows, dates = placed(panel)
    searches = {0: Search(("a", "b"), SPEC)}
    evaluator = Evaluator(rows, ("a", "b"), SPEC, **more)
    run_searches(searches, evaluator, {0: dates})
    return searches[0].table(), evaluator


def test_the_store_changes_nothing_and_is_filled_once(panel):
    with_store, evaluator = run(panel)
    without, bare = run(panel, use_store=False)
    assert with_store == without and with_store
    wanted = [Wanted(0, t.key(), t) for t in (Tree("neg", (Tree("ts_mean", (Tree("b"),), window=w),)) for w in (5, 60))]
    found = [sorted(map(tuple, e.ics(wanted).collect())) for e in (evaluator, bare)]
    assert found[0] == found[1] and {r[1] for r in found[0]} == {"neg(ts_mean5(b))", "neg(ts_mean60(b))"}
    assert {"0:ts_mean60(b)", "0:ts_std20(b)"} <= evaluator.stored and not bare.stored
    version = evaluator.version
    evaluator.ics(wanted)
    assert evaluator.version == version


def test_terminals():
    assert terminals_of(["x", "y", "z"], ["x"], ["x", "y", "z"]) == (["x", "y", "z"], "regression")
    assert terminals_of(["z"], ["y", "x"], ["a", "b", "c", "x", "y", "z"]) == (["z", "y", "x"], "regression+screened")
    assert terminals_of([], [], ["a", "b"]) == (["a", "b"], "regression+screened+all")
    assert terminals_of(None, ["p", "q", "r", "s", "t", "u"], ["p"]) == (["p", "q", "r", "s", "t"], "screened")
    assert seed_of(dt.date(2021, 3, 4)) == 7 + 10304


def test_a_stopped_chain_goes_on_to_the_same_result(spark, panel, tmp_path):
    screening = ScreenSpec(train=80, least_train=70, every=30, holdout=25, least_days=30, least_oos=10, purge=2)
    search = SearchSpec(population=8, generations=6, least_names=5, least_days=20, least_validation_days=5, purge=2, regressors=("risk",), group="sector")
    go = lambda folder, **more: search_slices(panel, ("a", "b"), "y", np.array([1e-4, 1e-2]), screening, search, f"{tmp_path}/{folder}", **more)
    whole = sorted(map(tuple, go("whole").collect()))
    assert go("stopped", stop_after=3) is None
    assert sorted(map(tuple, go("stopped").collect())) == whole
    assert len({r[0] for r in whole}) == 2 and all(r[9] >= 20 for r in whole if r[10] is not None) and any(r[10] is not None and r[10] > 0.1 for r in whole)
    cold = go("cold", warm=0).collect()
    assert {r.formula for r in cold} == {r[3] for r in whole}


def test_no_rows(spark, panel):
    from panelforge.operators.search import evolve

    assert evolve(panel.limit(0), ("a", "b"), col("y"), SPEC) == []


def test_blocks_are_bounded_whatever_the_names(spark, panel, monkeypatch):
    """Many blocks of names give the ICs of a single one; a row of the saved blocks stays small, with its stored windows."""
    found = {}
    for most, store in ((130 * 40, 10**8), (130 * 3, 40_000)):
        for name, v in (("MOST_CELLS", most), ("LEAST_CELLS", most), ("BLOCK_STORE", store)):
            monkeypatch.setattr(evaluation, name, v, raising=False)
        rows, _ = placed(panel)
        wanted = [Wanted(0, t.key(), t) for t in (*trees(25, 4), *[Tree("ts_std", (Tree("*", (Tree(c), Tree(c))),), window=w) for c in "ab" for w in (5, 10, 20, 60)])]
        evaluator = Evaluator(rows, ("a", "b"), SPEC)
        ics = {(r.name, r.i): (r.n, r.ic) for r in evaluator.ics(wanted).collect()}
        saved = [(len(r.data), sum(map(len, r.data))) for r in spark.read.parquet(evaluator._path(evaluator.version)).collect()]
        found[most] = ics, saved
    (one, few), (many, parts) = found.values()
    assert len(few) == 1 and len(parts) > 3 and max(b for _, b in parts) < sum(b for _, b in few) / 3
    assert all(n <= 5 + 40_000 // (8 * 130) for n, _ in parts) and one.keys() == many.keys() and len(one) > 1000
    assert all(one[k][0] == many[k][0] and one[k][1] == pytest.approx(many[k][1], abs=1e-11) for k in one)


def test_scoring_holds_one_block_at_a_time(spark, panel, tmp_path, monkeypatch):
    """Saved blocks, many to a file, reach writers, readers and workers one by one; the session's batches are as before afterwards."""
    import glob
    import uuid

    import pyarrow.parquet as pq

    each = evaluation._each

    def watched(batches):
        for b in batches:
            with open(f"{tmp_path}/batch-{uuid.uuid4().hex}", "w") as f:
                f.write(str(b.num_rows))
            yield from each([b])

    for name in ("MOST_CELLS", "LEAST_CELLS"):
        monkeypatch.setattr(evaluation, name, 130)
    monkeypatch.setattr(evaluation, "_each", watched)
    rows, dates = placed(panel)
    rows = rows.unionAll(rows.withColumn("ticker", rows.ticker + 100)).unionAll(rows.withColumn("ticker", rows.ticker + 200))
    evaluator = Evaluator(rows, ("a", "b"), SPEC, f"{tmp_path}/search")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    parts = spark.createDataFrame([(0, "train", 0, dates)], "slice int, part string, low int, high int")
    assert evaluator.scores([Wanted(0, t.key(), t) for t in (Tree("a"), Tree("ts_mean", (Tree("b"),), window=5))], parts)
    seen = [open(f).read() for f in glob.glob(f"{tmp_path}/batch-*")]
    assert evaluator.version == 1 and len(seen) > 40 and set(seen) == {"1"}
    for version in (0, 1):
        files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{evaluator._path(version)}/*.parquet")]
        assert max(m.num_rows for m in files) > 1 and all(m.row_group(k).num_rows == 1 for m in files for k in range(m.num_row_groups))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_ranks_of_many_names_are_bounded():
    """A date of many names ranks its predictions some penalties at a time, with the same correlations."""
    import tracemalloc

    import pandas as pd

    from panelforge.operators.grams import rank_ics

    rng = np.random.default_rng(5)
    x, y = np.column_stack([np.ones(60_000), rng.normal(size=(60_000, 3))]), pd.Series(rng.normal(size=60_000))
    lines = np.vstack([rng.normal(size=(79, 4)), [[1.0, 0, 0, 0]]])
    tracemalloc.start()
    found = rank_ics(x, lines, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000 * 80 * 8
    whole = pd.DataFrame(np.round(x @ lines.T, 12)).rank().corrwith(y.rank()).to_numpy()
    assert np.isnan(found[-1]) and found[:-1] == pytest.approx(whole[:-1], abs=1e-12)


def test_formulas_of_a_kin_have_the_same_ics(spark, panel):
    """What counts as kin agrees on every date but for the sign, with holes, quotients and windows."""
    import random

    from panelforge.operators.search import kin

    rng, wanted = random.Random(8), {}
    for t in (grow(rng, ("a", "b"), SPEC, 3) for _ in range(900)):
        wanted[t.key()] = t
    groups = {}
    for t in wanted.values():
        groups.setdefault(kin(t)[0], []).append(t)
    groups = {of: g[:4] for of, g in groups.items() if len(g) > 1}
    a, b, c = Tree("a"), Tree("b"), Tree("const", value=-0.5)
    pairs = [(Tree("/", (a, Tree("neg", (b,)))), Tree("/", (Tree("*", (c, a)), b)), 1), (Tree("-", (a, b)), Tree("-", (b, a)), -1), (Tree("ts_std", (Tree("*", (c, a)),), window=5), Tree("ts_std", (Tree("+", (a, c)),), window=5), 1), (Tree("tanh", (Tree("neg", (a,)),)), Tree("tanh", (a,)), -1)]
    apart = [(a, Tree("-", (Tree("+", (a, b)), b))), (Tree("tanh", (a,)), Tree("tanh", (Tree("+", (a, a)),))), (Tree("abs", (a,)), Tree("abs", (Tree("+", (a, c)),))), (Tree("/", (a, b)), Tree("/", (a, Tree("+", (b, c))))), (Tree("ts_mean", (a,), window=5), Tree("ts_mean", (a,), window=10))]
    assert all(kin(x)[0] == kin(y)[0] and kin(x)[1] * kin(y)[1] == sign for x, y, sign in pairs) and all(kin(x)[0] != kin(y)[0] for x, y in apart)
    groups |= {f"pair {k}": list(p[:2]) for k, p in enumerate(pairs)}
    rows, _ = placed(panel)
    ask = {t.key(): t for g in groups.values() for t in g}
    ics = {}
    for r in Evaluator(rows, ("a", "b"), SPEC, use_store=False).ics([Wanted(0, k, t) for k, t in ask.items()]).collect():
        ics.setdefault(r.name, {})[r.i] = r.ic
    assert len(groups) > 20 and len(ics) > 40
    for of, (first, *others) in groups.items():
        for t in others:
            x, y = ics.get(first.key(), {}), ics.get(t.key(), {})
            assert x.keys() == y.keys() and all(kin(first)[1] * x[i] == pytest.approx(kin(t)[1] * y[i], abs=1e-9) for i in x), (of, first.key(), t.key())


def test_a_search_scores_one_formula_of_a_kin(panel):
    import dataclasses

    from panelforge.operators.search import kin

    rows, dates = placed(panel)
    spec = dataclasses.replace(SPEC, population=50, generations=3)
    searches, asked = {0: Search(("a", "b"), spec)}, []
    evaluator = Evaluator(rows, ("a", "b"), spec)
    scores = evaluator.scores
    evaluator.scores = lambda wanted, parts: asked.extend(kin(w.tree)[0] for w in wanted) or scores(wanted, parts)
    run_searches(searches, evaluator, {0: dates})
    met = {k: c for k, c in searches[0].seen.items() if c.train}
    assert len(asked) == len(set(asked)) < len(searches[0].seen) and len(met) > 20
    by_kin = {}
    for k, c in met.items():
        of, sign = kin(c.tree)
        assert by_kin.setdefault(of, sign * c.train.t) == sign * c.train.t, k
