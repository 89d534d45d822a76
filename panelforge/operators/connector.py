"""The walk-forward chain to its end: screening, sparse regression, and a formula search for each slice.

Each slice searches formulas over the factors that the regression left it, on its training dates only,
with a seed of its own date; its ten best formulas are then scored on the holdout dates, which no earlier
step has seen.  All slices move on together, one job a generation.  What the chain has decided is written
to a folder as it goes, so a run that was stopped in the middle goes on from there to the same result.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BlockPanel, save_rows
from .evaluation import Evaluator, Wanted, light_batches, read_state, shared_folder, write_state
from .search import Search, SearchSpec, run_searches
from .walkforward import ScreenSpec, lasso_choices, in_training, screen, slices

#: A slice with fewer factors than the first number is topped up to the second.
LEAST_TERMINALS, FULL_TERMINALS = 3, 5
SEED_BASE = 7
HOLDOUT_DAYS = (20, 40)

SCHEMA = "slice int, rebalance date, rank int, formula string, terminals array<string>, origin string, train_t double, validation_t double, adjusted double, holdout_days int, holdout_ic double, holdout_t double"


def terminals_of(nonzero: list[str] | None, selected: list[str], every: list[str]) -> tuple[list[str], str]:
    """The factors that a slice searches over, and where they come from.

    Those with a coefficient first; where they are too few, more from the screened ones in their order,
    then from all.  A slice without a regression takes the first screened ones (all, if none passed).
    """
    pool = selected or every
    found, origin = (pool[:FULL_TERMINALS], "screened") if nonzero is None else (list(dict.fromkeys(nonzero)), "regression")
    found = list(found)
    for more, name in ((pool, "screened"), (every, "all")):
        if len(found) < LEAST_TERMINALS:
            found += [f for f in more if f not in found][: FULL_TERMINALS - len(found)]
            origin = f"{origin}+{name}"
    return found, origin


def seed_of(date) -> int:
    return SEED_BASE + int(date.strftime("%Y%m%d")) % 100_000


def plan_slices(panel: BlockPanel, factors: tuple[str, ...], target: str, alphas: np.ndarray, spec: ScreenSpec) -> list[dict]:
    """For each slice its date, places and terminals."""
    signals, days, dates = panel.rows((*factors, target)), panel.days(), panel.dates
    plan = slices(days, spec)
    scored = screen(signals, factors, target, spec, days).where("kept").select("slice", "factor", "score").collect()
    selected: dict[int, list[str]] = {}
    for r in sorted(scored, key=lambda r: (r["slice"], -r["score"], r["factor"])):
        selected.setdefault(r["slice"], []).append(r["factor"])
    chosen = {s: tuple(sorted(names)) for s, names in selected.items()}
    nonzero = {b["slice"]: [f for f, c in zip(chosen[b["slice"]], b["coefficients"], strict=True) if abs(c) > 1e-12] for b in lasso_choices(in_training(signals, days, plan), chosen, target, alphas, spec.purge)}
    out = []
    for r in sorted(plan.collect(), key=lambda r: r["slice"]):
        terminals, origin = terminals_of(nonzero.get(r["slice"]), selected.get(r["slice"], []), list(factors))
        out.append({**r.asDict(), "rebalance": dates[r["hold_from"]].isoformat(), "seed": seed_of(dates[r["hold_from"]]), "terminals": terminals, "origin": origin})
    return out


def _saved(rows: DataFrame, columns: tuple[str, ...], target: str, group: str | None, path: str, fresh: bool) -> BlockPanel:
    """``rows`` as blocks with ``target`` as ``y``; where they are saved already, as they are there."""
    if not fresh:
        places = json.loads(read_state(rows.sparkSession, f"{path}-dates")[1])
        return BlockPanel(rows.sparkSession, path, tuple(map(dt.date.fromisoformat, places)), (*columns, "y"))
    dates = tuple(r["date"] for r in rows.select("date").distinct().orderBy("date").collect())
    saved = save_rows(rows.select("date", "ticker", *columns, F.col(target).alias("y")), dates, (*columns, "y"), path, group)
    write_state(rows.sparkSession, f"{path}-dates", 0, json.dumps([d.isoformat() for d in dates]))
    return saved


def search_slices(panel: DataFrame | BlockPanel, factors: tuple[str, ...], target: str, alphas: np.ndarray, screening: ScreenSpec, search: SearchSpec, folder: str | None = None, stop_after: int | None = None, warm: int = 118) -> DataFrame | None:
    """A row for each slice and formula of its best ten, with training, validation and holdout statistics.

    ``panel`` has date, ticker, the factors, ``target``, and the regressors and group of ``search``; rows are saved as
    blocks first, and screening, searches and holdout all read these, each slice its dates of them.  Windows
    inside formulas begin anew at the first training date of a slice; in the holdout they may read the ``warm``
    dates before it, which are past by then (0: windows begin anew there too).  ``folder`` is where the chain writes its decisions and goes on from, a fresh one if not given;
    ``stop_after`` ends the call after so many generations, without result.
    """
    spark = panel.spark if isinstance(panel, BlockPanel) else panel.sparkSession
    folder = folder or shared_folder(spark, "slices")
    known = read_state(spark, f"{folder}/plan")
    if not isinstance(panel, BlockPanel):
        panel = _saved(panel, tuple(dict.fromkeys((*factors, *search.regressors, *([search.group] if search.group else [])))), target, search.group, f"{folder}/panel", known is None)
    if known is None:
        with light_batches(spark):
            plan = plan_slices(panel, factors, "y", alphas, screening)
        write_state(spark, f"{folder}/plan", 0, json.dumps(plan))
    else:
        plan = json.loads(known[1])
    if not plan:
        return spark.createDataFrame([], SCHEMA)
    used = tuple(dict.fromkeys(t for p in plan for t in p["terminals"]))
    train = Evaluator.of_blocks(panel, used, search, {p["slice"]: (p["train_from"], p["train_to"]) for p in plan}, f"{folder}/train")
    searches = {p["slice"]: Search(tuple(p["terminals"]), dataclasses.replace(search, seed=p["seed"])) for p in plan}
    run_searches(searches, train, {p["slice"]: p["train_to"] - p["train_from"] for p in plan}, save=True, stop_after=stop_after)
    if any(not s.done for s in searches.values()):
        return None
    early = [{**p, "warm_from": max(0, p["hold_from"] - warm)} for p in plan]
    held = Evaluator.of_blocks(panel, used, search, {p["slice"]: (p["warm_from"], p["hold_to"]) for p in early})
    length = {p["slice"]: p["hold_to"] - p["hold_from"] for p in plan}
    parts = spark.createDataFrame([(p["slice"], "hold", p["hold_from"] - p["warm_from"], p["hold_to"] - p["warm_from"]) for p in early], "slice int, part string, low int, high int")
    scores = held.scores([Wanted(s, k, t) for s, x in searches.items() for k, t in x.leaders().items()], parts)
    out = []
    for p in plan:
        s = p["slice"]
        least = max(HOLDOUT_DAYS[0], min(HOLDOUT_DAYS[1], length[s]))
        for rank, f in enumerate(searches[s].table(), 1):
            days, mean, t = scores.get((s, f.formula, "hold"), (0, None, None))
            enough = days >= least
            out.append((s, p["rebalance"], rank, f.formula, p["terminals"], p["origin"], f.t, f.validation_t, f.adjusted, days, mean if enough else None, t if enough else None))
    found = spark.createDataFrame(out, SCHEMA.replace("rebalance date", "rebalance string"))
    return found.withColumn("rebalance", F.to_date("rebalance"))
