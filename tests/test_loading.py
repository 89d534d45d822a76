"""Loading symbol by symbol: failures stay with their symbol."""

import datetime as dt
import decimal

import pandas as pd
import pytest

from panelforge.sources import loading

SCHEMA = "symbol string, trade_date date, pe decimal(18,6), total decimal(20,2)"
D = dt.date


@pytest.fixture()
def path(spark, tmp_path):
    where = f"{tmp_path}/valuation"
    assert loading.create_table(spark, where, SCHEMA)
    return where


def rows(spark, path):
    return sorted((r.symbol, r.trade_date, r.pe) for r in loading.read_table(spark, path).collect())


def frame(spark, data):
    return spark.createDataFrame(data, "symbol string, trade_date date, pe double")


def test_create_drop_and_empty(spark, path):
    assert rows(spark, path) == [] and not loading.create_table(spark, path, SCHEMA)
    assert loading.read_table(spark, path).schema.simpleString() == "struct<symbol:string,trade_date:date,pe:decimal(18,6),total:decimal(20,2)>"
    loading.insert_by_symbol(spark, path, frame(spark, [("a", D(2020, 1, 1), 1.0)]), ("symbol", "trade_date"))
    assert loading.create_table(spark, path, SCHEMA, replace=True) and rows(spark, path) == []
    report = loading.insert_by_symbol(spark, path, frame(spark, []), ("symbol", "trade_date"))
    assert report.collect() == [] and rows(spark, path) == []
    loading.drop_table(spark, path)
    assert not loading.table_exists(spark, path)


def test_a_failing_symbol_leaves_the_others_and_its_old_rows(spark, path):
    keys = ("symbol", "trade_date")
    first = [("a", D(2020, 1, 1), 1.23456789), ("b", D(2020, 1, 1), 2.0), ("c", D(2020, 1, 1), 3.0)]
    assert {r.status for r in loading.insert_by_symbol(spark, path, frame(spark, first), keys).collect()} == {"loaded"}
    more = [("a", D(2020, 1, 2), 1.5), ("b", D(2020, 1, 1), 9.0), ("b", D(2020, 1, 2), 9.0), ("c", None, 1.0), ("d", D(2020, 1, 1), 4.0), ("e", D(2020, 1, 1), 5.0), ("e", D(2020, 1, 1), 6.0), (None, D(2020, 1, 1), 7.0)]
    report = {r.symbol: (r.status, r.rows, r.reason) for r in loading.insert_by_symbol(spark, path, frame(spark, more), keys).collect()}
    assert report == {
        "a": ("loaded", 1, None), "b": ("rolled back", 2, "key exists"), "c": ("rolled back", 1, "missing value"), "d": ("loaded", 1, None), "e": ("rolled back", 2, "repeated key"), None: ("rolled back", 1, "missing value"),
    }
    six = lambda x: decimal.Decimal(x).quantize(decimal.Decimal("0.000001"))
    assert rows(spark, path) == [("a", D(2020, 1, 1), six("1.234568")), ("a", D(2020, 1, 2), six("1.5")), ("b", D(2020, 1, 1), six(2)), ("c", D(2020, 1, 1), six(3)), ("d", D(2020, 1, 1), six(4))]


def test_calls_are_repeated_and_failures_reported(spark, path):
    def fetch(symbol):
        if symbol == "bad":
            raise ValueError("no such symbol")
        return pd.DataFrame({"symbol": [symbol], "trade_date": [D(2020, 1, 1)], "pe": [2.0]})

    symbols = spark.createDataFrame([("x",), ("bad",), ("y",), ("x",)], "symbol string")
    found = loading.fetch_symbols(symbols, fetch, "symbol string, trade_date date, pe double", attempts=2)
    report = {r.symbol: (r.status, r.reason) for r in loading.insert_by_symbol(spark, path, found, ("symbol", "trade_date")).collect()}
    assert report == {"x": ("loaded", None), "y": ("loaded", None), "bad": ("rolled back", "ValueError: no such symbol")}
    assert [r[0] for r in rows(spark, path)] == ["x", "y"]


def test_precision_changes(spark, path):
    loading.insert_by_symbol(spark, path, frame(spark, [("a", D(2020, 1, 1), 1.123456)]), ("symbol", "trade_date"))
    loading.change_types(spark, path, {"pe": "decimal(20,3)", "total": "double"})
    found = loading.read_table(spark, path)
    assert dict(found.dtypes) == {"symbol": "string", "trade_date": "date", "pe": "decimal(20,3)", "total": "double"} and found.first().pe == decimal.Decimal("1.123")


def test_files_follow_rows_and_not_symbols(spark, path):
    """300 symbols make few files, and a second load leaves those of the first as they are."""
    keys = ("symbol", "trade_date")
    loading.insert_by_symbol(spark, path, frame(spark, [(f"s{k}", D(2020, 1, d), 1.0) for k in range(300) for d in (1, 2)]), keys)
    first = files_of(path)
    loading.insert_by_symbol(spark, path, frame(spark, [(f"s{k}", D(2020, 1, 2 + k % 2), 2.0) for k in range(300)]), keys)
    assert len(first) < 20 and first < files_of(path) and len(files_of(path)) < 40
    found = loading.read_table(spark, path)
    assert found.count() == 750 and found.where("pe = 2").count() == 150 and found.distinct().count() == 750


def files_of(path):
    import pathlib

    return {(str(p), p.stat().st_mtime_ns) for p in pathlib.Path(path).rglob("*.parquet")}
