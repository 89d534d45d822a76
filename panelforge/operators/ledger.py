"""The ledger of the staggered-lot simulator over stages, and the reports made of it.

Stages follow each other: one starts with the value that the one before ended with, so a scenario
is one group.  Its output is a log of events; orders, trades, failed sales, lots, round trips and daily
summaries are plain queries over the log.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .engines import Lot, Lots, lot_days

LEDGER_SCHEMA = (
    "scenario string, stage date, date date, kind string, ticker string, book int, lot long, status string, weight double, budget double, wanted double, shares double, "
    "price double, each double, entry_date date, entry_price double, entry_each double, due_date date, cash double, nav_open double, nav double, n_held long"
)
COLUMNS = [c.split()[0] for c in LEDGER_SCHEMA.split(", ")]


def stage_rows(rows: DataFrame, stages: DataFrame, buffer: int) -> DataFrame:
    """``rows`` under each stage (stage, first, last: dates) that holds their date, with ``entry``.

    A stage goes on for ``buffer`` dates of the calendar after its last one, in which lots are only sold.
    Stages and calendar are small beside the rows.
    """
    days = rows.select("date").distinct()
    after = days.join(F.broadcast(stages), F.col("date") > F.col("last")).groupBy("stage").agg(F.array_sort(F.collect_set("date")).alias("later"))
    ends = stages.join(after, "stage", "left").withColumn("end", F.coalesce(F.get(F.slice("later", 1, buffer), F.least(F.lit(buffer), F.size("later")) - 1), F.col("last")))
    return rows.join(F.broadcast(ends.select("stage", "first", "last", "end")), F.col("date").between(F.col("first"), F.col("end"))).select(
        rows["*"], "stage", (F.col("date") <= F.col("last")).alias("entry")
    )


def _events(pdf: pd.DataFrame, p: Lots, fractions: dict) -> pd.DataFrame:
    cash, out = p.cash, []
    for stage, part in pdf.groupby("stage", sort=True):
        wide = part.pivot(index="date", columns="ticker", values=["price", "weight", "eligible", "entry"]).sort_index()
        dates, names = list(wide.index), list(wide["price"].columns)
        shares = np.asarray(fractions.get(str(stage)[:10], [1.0] * p.hold), float)
        if len(shares) != p.hold or not np.nansum(shares) > 0:
            raise ValueError(f"the books of stage {stage} do not have {p.hold} fractions with a positive sum")
        days = lot_days(
            wide["price"].to_numpy(float), np.nan_to_num(wide["weight"].to_numpy(float)), np.nan_to_num(wide["eligible"].to_numpy(float)) > 0,
            np.nanmax(wide["entry"].to_numpy(float), axis=1) > 0, shares / np.nansum(shares), p, cash,
        )

        def of_lot(kind: str, t: int, lot: Lot, each: float | None) -> dict:
            due = lot.day + p.hold
            return {
                "kind": kind, "ticker": names[lot.name], "book": lot.book, "lot": lot.number, "shares": lot.shares, "price": None if each is None else float(part_price[t, lot.name]), "each": each,
                "entry_date": dates[lot.day], "entry_price": lot.price, "entry_each": lot.each, "due_date": dates[due] if due < len(dates) else None,
            }

        part_price = wide["price"].to_numpy(float)
        for t, day in enumerate(days):
            found = [{"kind": "day", "cash": day.cash, "nav_open": day.nav_open, "nav": day.nav, "n_held": day.n_held}]
            found += [
                {"kind": "order", "ticker": names[o.name], "book": o.book, "status": o.status, "weight": o.weight, "budget": o.budget, "wanted": o.wanted, "shares": o.filled} for o in day.orders
            ]
            found += [of_lot("buy", t, lot, lot.each) for lot in day.buys]
            found += [of_lot("sell", t, lot, each) for lot, each in day.sales]
            found += [of_lot("fail", t, lot, None) for lot in day.fails]
            out += [{"scenario": p.name, "stage": stage, "date": dates[t], **e} for e in found]
        cash = days[-1].nav
    # shares are whole, but a run that compounds over many stages can pass 64 bits
    kinds = {c: "Int64" for c in ("book", "lot", "n_held")} | {c: float for c in ("wanted", "shares")}
    return pd.DataFrame(out, columns=COLUMNS).astype(kinds)


def lot_ledger(rows: DataFrame, scenarios: list[Lots], fractions: dict[str, list[float]] | None = None) -> DataFrame:
    """The log of every scenario over ``rows`` (stage, date, ticker, price, weight, eligible, entry).

    ``fractions`` gives the shares of the books of a stage (its date as text); else they are equal.
    Missing prices, weights and flags are allowed; no rows give no log.
    """
    by_name = {s.name: s for s in scenarios}
    spread = rows.select(
        F.explode(F.array(*[F.lit(n) for n in by_name])).alias("scenario"), "stage", "date", F.col("ticker").cast("string"), F.col("price").cast("double"), F.col("weight").cast("double"),
        F.col("eligible").cast("double"), F.col("entry").cast("double"),
    )
    return spread.groupBy("scenario").applyInPandas(lambda pdf: _events(pdf, by_name[pdf["scenario"].iloc[0]], fractions or {}), LEDGER_SCHEMA)


KEY = ("scenario", "stage")


def orders(ledger: DataFrame) -> DataFrame:
    return ledger.where("kind = 'order'").select(*KEY, "date", "ticker", "book", "weight", "budget", "wanted", F.col("shares").alias("filled"), "status")


def trades(ledger: DataFrame) -> DataFrame:
    """Purchases and sales with their flow of cash and, for sales, the gain over the cost of the lot."""
    sold = F.col("kind") == "sell"
    flow = F.when(sold, F.col("shares") * F.col("each")).otherwise(-F.col("shares") * F.col("each"))
    gain = F.when(sold, F.col("shares") * (F.col("each") - F.col("entry_each"))).otherwise(0.0)
    return ledger.where("kind IN ('buy', 'sell')").select(
        *KEY, "date", "ticker", F.col("kind").alias("side"), "shares", "price", "each", flow.alias("cash_flow"), "book", "lot", "entry_date", "entry_price", "entry_each", gain.alias("gain")
    )


def sell_failures(ledger: DataFrame) -> DataFrame:
    return ledger.where("kind = 'fail'").select(*KEY, "date", "ticker", "lot")


def lots(ledger: DataFrame) -> DataFrame:
    """A row a lot: entry, due date, exit (normal, late or open) and how often its sale failed."""
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    found = ledger.where("lot IS NOT NULL").groupBy(*KEY, "lot").agg(
        F.max("ticker").alias("ticker"), F.max("book").alias("book"), F.max("entry_date").alias("entry_date"), F.max("entry_price").alias("entry_price"), F.max("entry_each").alias("entry_each"),
        F.max("shares").alias("shares"), F.max("due_date").alias("due_date"), of("sell", "date").alias("exit_date"), of("sell", "price").alias("exit_price"), of("sell", "each").alias("exit_each"),
        F.count_if(F.col("kind") == "fail").alias("fails"),
    )
    how = F.when(F.col("exit_date").isNull(), "open").when(F.col("exit_date") == F.col("due_date"), "normal").otherwise("late")
    return found.withColumn("exit", how)


def round_trips(ledger: DataFrame) -> DataFrame:
    sold = trades(ledger).where("side = 'sell'")
    paid = F.col("shares") * F.col("entry_each")
    return sold.select(*KEY, "lot", "ticker", "entry_date", F.col("date").alias("exit_date"), F.datediff("date", "entry_date").alias("days"), paid.alias("paid"), "gain", (F.col("gain") / paid).alias("return"))


def execution_daily(ledger: DataFrame) -> DataFrame:
    is_order = F.col("kind") == "order"
    gain = F.when(F.col("kind") == "sell", F.col("shares") * (F.col("each") - F.col("entry_each"))).otherwise(0.0)
    count = lambda c, name: F.count_if(c).alias(name)
    return ledger.groupBy(*KEY, "date").agg(
        count(is_order, "orders"), count(is_order & (F.col("shares") > 0), "filled"), *[count(F.col("status") == s, s) for s in ("ineligible", "no_price", "too_small", "no_cash")],
        count(F.col("kind") == "buy", "buys"), count(F.col("kind") == "sell", "sells"), count(F.col("kind") == "fail", "sell_failures"), F.sum(gain).alias("gain"),
        F.max("cash").alias("cash"), F.max("nav_open").alias("nav_open"), F.max("nav").alias("nav"), F.max("n_held").alias("n_held"),
    )
