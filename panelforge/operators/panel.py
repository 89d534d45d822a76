"""Dense panels of bars from the trade table, as text that Spark and DuckDB both run.

A panel has a row for every ticker on every date of the calendar; what did not trade is null.
Windows count rows of the calendar, so panels are always made dense before any of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.dag import DUCK, SPARK, Dialect

#: Keys of the trade table repeat; this order makes first and last trades of a bar definite.
TRADE_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")


@dataclass(frozen=True)
class PanelSpec:
    """What a panel is made of: the ticker expression, the length of a bar and the classification."""

    name: str
    unit: str
    by_nation: bool = False
    #: The last close goes on where nothing traded: such a bar has that one price and no volume.
    fill: bool = False


MONTH = PanelSpec("supplier_month", "month")
WEEK = PanelSpec("supplier_week", "week")
NATION_WEEK = PanelSpec("nation_week", "week", by_nation=True)
FILLED_WEEK = PanelSpec("supplier_week_filled", "week", fill=True)

COLUMNS = ("open", "high", "low", "close", "volume", "amount", "n_trades", "vwap", "logret", "mcap", "sector", "industry", "subindustry")


def table_name(spark_dir: str | None, name: str) -> str:
    return f"parquet.`{spark_dir}/{name}.parquet`" if spark_dir else name


def panel_ctes(spec: PanelSpec, sf_dir: str | None, trades: str | None = None) -> list[str]:
    """Common table expressions that end in ``panel``; ``sf_dir`` None is for DuckDB's views, ``trades`` may stand for the table of trades."""
    d: Dialect = SPARK if sf_dir else DUCK
    t = lambda n: table_name(sf_dir, n)
    order = d.struct(*TRADE_ORDER)
    price = "l_extendedprice / nullif(l_quantity, 0)"
    if spec.by_nation:
        source = f"(SELECT l.*, s_nationkey FROM {trades or t('lineitem')} l JOIN {t('supplier')} s ON l_suppkey = s_suppkey)"
        ticker = "s_nationkey"
        classes = f"SELECT n_nationkey AS ticker, n_regionkey AS sector, n_regionkey * 2 + n_nationkey % 2 AS industry, n_regionkey * 3 + n_nationkey % 3 AS subindustry, CAST(1000 + n_nationkey AS DOUBLE) AS shares FROM {t('nation')}"
    else:
        source, ticker = trades or t("lineitem"), "l_suppkey"
        classes = (
            f"SELECT s_suppkey AS ticker, n_regionkey AS sector, s_nationkey AS industry, s_nationkey * 2 + s_suppkey % 2 AS subindustry, s_acctbal + 2000 AS shares "
            f"FROM {t('supplier')} JOIN {t('nation')} ON s_nationkey = n_nationkey"
        )
    return [
        f"""bars AS (
  SELECT CAST(date_trunc('{spec.unit}', l_shipdate) AS DATE) AS date, {ticker} AS ticker, min_by({price}, {order}) AS open, max({price}) AS high, min({price}) AS low,
         max_by({price}, {order}) AS close, CAST(sum(l_quantity) AS DOUBLE) AS volume, round(CAST(sum(l_extendedprice) AS DOUBLE), 4) AS amount, count(*) AS n_trades
  FROM {source} WHERE l_shipdate IS NOT NULL AND {ticker} IS NOT NULL GROUP BY 1, 2)""",
        "calendar AS (SELECT DISTINCT date FROM bars)",
        "tickers AS (SELECT DISTINCT ticker FROM bars)",
        f"classes AS ({classes})",
        f"""dense AS (
  SELECT c.date, k.ticker, open, high, low, close, volume, amount, n_trades, amount / nullif(volume, 0) AS vwap, {', '.join(f'CAST({g} AS DOUBLE) AS {g}' for g in ('sector', 'industry', 'subindustry'))},
         CAST(shares AS DOUBLE) * close AS mcap
  FROM calendar c CROSS JOIN tickers k LEFT JOIN bars b ON b.date = c.date AND b.ticker = k.ticker LEFT JOIN classes g ON g.ticker = k.ticker)""",
        *([filled(d)] if spec.fill else []),
        f"panel AS (SELECT *, CASE WHEN close > 0 AND lag(close) OVER (PARTITION BY ticker ORDER BY date) > 0 THEN ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY date)) END AS logret FROM {'filled' if spec.fill else 'dense'})",
    ]


def filled(d: Dialect) -> str:
    """The dense panel with closes carried forward."""
    last = d.last("close", "(PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    flat = ", ".join(f"coalesce({c}, last_close) AS {c}" for c in ("open", "high", "low"))
    return f"""filled AS (
  SELECT date, ticker, {flat}, last_close AS close, coalesce(volume, 0) AS volume, coalesce(amount, 0) AS amount, coalesce(n_trades, 0) AS n_trades,
         coalesce(vwap, last_close) AS vwap, sector, industry, subindustry, max(mcap / nullif(close, 0)) OVER (PARTITION BY ticker) * last_close AS mcap
  FROM (SELECT *, {last} AS last_close FROM dense))"""


def load_panel(spark: SparkSession, sf_dir: str, spec: PanelSpec = MONTH) -> DataFrame:
    """The dense panel.  The calendar and the ticker list are small next to the trades they come from."""
    return spark.sql(f"WITH {', '.join(panel_ctes(spec, sf_dir))} SELECT * FROM panel")
