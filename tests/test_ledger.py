"""The lot ledger against a hand-worked panel and the accounts that must hold."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import ledger
from panelforge.operators.engines import Lots, lot_days

DAY = dt.date(2024, 1, 1)


def test_orders_fail_for_their_reasons():
    price = np.array([[10.0, 20.0, np.nan, 5000.0, 10.0]])
    weight = np.array([[0.4, 0.3, 0.2, 0.06, 0.04]])
    able = np.array([[True, False, True, True, True]])
    day = lot_days(price, weight, able, np.array([True]), np.array([1.0]), Lots(hold=1, impact=0.0, fee=0.0), 1000.0)[0]
    assert [(o.name, o.wanted, o.status) for o in day.orders] == [(0, 40, "filled"), (1, 0, "ineligible"), (2, 0, "no_price"), (3, 0, "too_small"), (4, 4, "filled")]
    # 25 passes at most put one share more in each of the two filled orders
    assert [o.filled for o in day.orders] == [65, 0, 0, 0, 29] and day.cash == 1000 - 94 * 10


def test_sale_without_price_fails_twice_on_its_day_and_sells_later():
    price = np.array([[10.0], [np.nan], [np.nan], [12.0]])
    weight = np.array([[1.0], [0.0], [0.0], [0.0]])
    days = lot_days(price, weight, np.ones((4, 1), bool), np.ones(4, bool), np.array([1.0]), Lots(hold=1, impact=0.0, fee=0.0), 100.0)
    assert [len(d.fails) for d in days] == [0, 2, 1, 0] and len(days[3].sales) == 1
    assert [d.nav for d in days] == [100.0, 100.0, 100.0, 120.0]


@pytest.fixture(scope="module")
def log(spark):
    rng = np.random.default_rng(3)
    rows = []
    for t in range(40):
        w = rng.random(4)
        for i in range(4):
            price = None if rng.random() < 0.1 else float(10 + 3 * np.sin(t + i) + i)
            rows.append((DAY + dt.timedelta(t), f"n{i}", price, float(w[i] / w.sum()), bool(rng.random() < 0.9)))
    panel = spark.createDataFrame(rows, "date date, ticker string, price double, weight double, eligible boolean")
    stages = spark.createDataFrame([(DAY, DAY, DAY + dt.timedelta(19)), (DAY + dt.timedelta(20), DAY + dt.timedelta(20), DAY + dt.timedelta(39))], "stage date, first date, last date")
    return ledger.lot_ledger(ledger.stage_rows(panel, stages, 5), [Lots("a", cash=1e4, hold=5), Lots("b", cash=1e4, hold=3)]).cache()


def test_stages_are_chained_and_buffered(log):
    days = {(r.scenario, r.stage, r.date): r for r in log.where("kind = 'day'").collect()}
    second = DAY + dt.timedelta(20)
    assert sum(k[1] == DAY for k in days) == 2 * 25 and sum(k[1] == second for k in days) == 2 * 20
    for s in "ab":
        assert days[s, second, second].nav_open == pytest.approx(days[s, DAY, DAY + dt.timedelta(24)].nav)
    assert log.where(F.col("kind") == "buy").where((F.col("stage") == DAY) & (F.col("date") >= second)).isEmpty()


def test_accounts_hold(log):
    flows = {(r.scenario, r.stage): r.f for r in ledger.trades(log).groupBy("scenario", "stage").agg(F.sum("cash_flow").alias("f")).collect()}
    for r in log.where("kind = 'day'").groupBy("scenario", "stage").agg(F.min_by("nav_open", "date").alias("start"), F.max_by("cash", "date").alias("end")).collect():
        assert r.start + flows[r.scenario, r.stage] == pytest.approx(r.end)
    lots = ledger.lots(log).collect()
    trips = {(r.scenario, r.stage, r.lot): r for r in ledger.round_trips(log).collect()}
    assert {(r.scenario, r.stage, r.lot) for r in lots if r["exit"] != "open"} == set(trips)
    for r in lots:
        if r["exit"] == "late":
            assert r.fails >= 2 and r.exit_date > r.due_date
        if r["exit"] == "normal":
            assert r.fails == 0
    filled = ledger.orders(log).where("filled > 0").count()
    daily = ledger.execution_daily(log).agg(F.sum("filled").alias("f"), F.sum("buys").alias("b"), F.sum("sell_failures").alias("x")).first()
    assert filled == daily.f == daily.b == len(lots) and daily.x == ledger.sell_failures(log).count()


def test_no_rows_give_no_log(spark):
    empty = spark.createDataFrame([], "stage date, date date, ticker string, price double, weight double, eligible boolean, entry boolean")
    assert ledger.lot_ledger(empty, [Lots()]).count() == 0
