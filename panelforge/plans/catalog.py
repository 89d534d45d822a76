"""Registry of the analytics queries and of their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dag import Node, compute, duck_sql
from ..functions.ops import absolute, ln, sign
from ..operators.panel import MONTH, NATION_WEEK, PanelSpec, load_panel, panel_ctes
from .formulas import FORMULAS

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}
DIGITS = 6


def rounded(x: str) -> str:
    """Six decimals.  Prices are cents over whole quantities, so some results lie exactly between two
    roundings, where the last bit of a float would decide; the offset moves them off that point."""
    return f"round({x} + 0.0000001234, {DIGITS})"


def register(name: str, query: Query, oracle: str | None = None) -> None:
    _queries[name] = query
    if oracle is not None:
        _oracles[name] = oracle


def panel_query(name: str, spec: PanelSpec, outputs: dict[str, Node]) -> None:
    """A query of expressions over a panel: planned windows in Spark, the same plan as SQL in DuckDB."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = compute(load_panel(spark, sf_dir, spec), outputs)
        return df.select("date", "ticker", *[F.expr(rounded(c)).alias(c) for c in outputs])

    ctes, final = duck_sql("panel", outputs)
    columns = ", ".join(f"{rounded(c)} AS {c}" for c in outputs)
    register(name, query, f"WITH {', '.join([*panel_ctes(spec, None), *ctes])} SELECT date, ticker, {columns} FROM ({final})")


def _formula_output(n: int) -> tuple[str, Node]:
    """A formula under its name; 53, 54 and 84, which reach beyond 1e12, as signed logarithms."""
    f = FORMULAS[n]
    return (f"f{n:03d}_signed_log", sign(f) * ln(1 + absolute(f))) if n in (53, 54, 84) else (f"f{n:03d}", f)


def _formula_queries() -> None:
    numbers = sorted(FORMULAS)
    for at in range(0, len(numbers), 10):
        chosen = numbers[at : at + 10] if at < 100 else numbers[at:]
        panel_query(f"formulas_{chosen[0]:03d}_{chosen[-1]:03d}", NATION_WEEK, dict(_formula_output(n) for n in chosen))


_formula_queries()


def queries() -> dict[str, Query]:
    from . import library, modelling, study  # noqa: F401  they register the rest

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    from . import library, modelling, study  # noqa: F401

    return dict(_oracles)
