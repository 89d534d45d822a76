"""Tables that are loaded symbol by symbol: created if missing, loaded or left alone as a whole for each symbol, and re-typed.

A table is a folder with a folder of parquet for each load, its rows clustered by symbol, so the number of files
follows the size of the data and not the number of symbols.  New rows are fetched and checked in parallel and
written to a staging folder; those of the symbols that passed are written beside it and then put in place as one
folder by a rename.  Rows that the table has are never written again; a symbol that failed keeps its old ones,
and the others do not wait for it.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _folder(spark: SparkSession, path: str):
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root, root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def table_exists(spark: SparkSession, path: str) -> bool:
    root, files = _folder(spark, path)
    return files.exists(root)


def drop_table(spark: SparkSession, path: str) -> None:
    root, files = _folder(spark, path)
    files.delete(root, True)


def create_table(spark: SparkSession, path: str, schema: str, symbol: str = "symbol", replace: bool = False) -> bool:
    """An empty table, where there is none; with ``replace``, also where there is one.  Whether it was made."""
    if table_exists(spark, path):
        if not replace:
            return False
        drop_table(spark, path)
    # An empty table has no load, so its columns are kept in a file of no rows under a name that reads skip.
    spark.createDataFrame([], schema).write.parquet(f"{path}/_schema")
    return True


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table; its types are those it was created or last re-typed with."""
    schema = spark.read.parquet(f"{path}/_schema").schema
    root, files = _folder(spark, path)
    loads = [s.getPath().toString() for s in files.listStatus(root) if not s.getPath().getName().startswith("_")]
    return spark.read.schema(schema).parquet(*sorted(loads)) if loads else spark.createDataFrame([], schema)


def change_types(spark: SparkSession, path: str, changes: dict[str, str], symbol: str = "symbol") -> None:
    """Columns of new types, as of another precision; values that do not fit are an error and leave the table as it was."""
    old = read_table(spark, path)
    new = old.select(*[F.col(c).cast(changes[c]).alias(c) if c in changes else F.col(c) for c in old.columns])
    staged = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    spark.createDataFrame([], new.schema).write.parquet(f"{staged}/_schema")
    _clustered(new, symbol).write.parquet(f"{staged}/load-{uuid.uuid4().hex}")
    root, files = _folder(spark, path)
    files.delete(root, True)
    files.rename(_folder(spark, staged)[0], root)


def _clustered(rows: DataFrame, symbol: str) -> DataFrame:
    """The rows of a symbol side by side, so that reads of a symbol skip most of the table."""
    return rows.repartition(symbol).sortWithinPartitions(symbol)


def fetch_symbols(symbols: DataFrame, fetch: Callable[[str], pd.DataFrame], schema: str, attempts: int = 3, wait: float = 0.0, symbol: str = "symbol") -> DataFrame:
    """Rows of ``schema`` and ``error`` that ``fetch`` gives for each symbol, called in parallel on the executors.

    A call that fails is repeated up to ``attempts`` times, ``wait`` seconds longer each time; a symbol that
    still fails gives one row with the message in ``error`` and nulls elsewhere.
    """
    columns = [c.split()[0] for c in schema.split(", ")]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf[symbol].iloc[0]
        for attempt in range(attempts):
            try:
                return fetch(name).assign(error=None)[[*columns, "error"]]
            except Exception as problem:  # noqa: BLE001  whatever a vendor's call raises is that symbol's failure
                message = f"{type(problem).__name__}: {problem}"
                if attempt + 1 < attempts:
                    time.sleep(wait * (attempt + 1))
        return pd.DataFrame([{c: None for c in columns} | {symbol: name, "error": message}], columns=[*columns, "error"])

    return symbols.select(symbol).distinct().groupBy(symbol).applyInPandas(one, f"{schema}, error string")


def _typed(incoming: DataFrame, schema: StructType) -> DataFrame:
    """Columns in the table's order and types; what does not parse becomes null, decimals are rounded."""
    found = []
    for f in schema:
        if f.name not in incoming.columns:
            found.append(F.lit(None).cast(f.dataType).alias(f.name))
        else:
            found.append(F.col(f.name).try_cast(f.dataType).alias(f.name))
    return incoming.select(*found, *[c for c in incoming.columns if c == "error"])


def insert_by_symbol(spark: SparkSession, path: str, incoming: DataFrame, keys: tuple[str, ...], required: tuple[str, ...] = (), symbol: str = "symbol", staging: str | None = None) -> DataFrame:
    """Appends ``incoming`` to the table, each symbol as a whole or not at all; a report with a row a symbol.

    A symbol is refused (status ``rolled back``) if a row of it carries an ``error``, lacks a key or a
    ``required`` column, repeats the ``keys`` of another new row, or has those of a row in the table.  Rows
    without symbol are refused under a null symbol.  Symbols are checked and written in parallel; the driver
    holds nothing of them.
    """
    table = read_table(spark, path)
    staged = f"{(staging or path).rstrip('/')}-staged-{uuid.uuid4().hex}"
    typed = _typed(incoming, table.schema)
    if "error" not in typed.columns:
        typed = typed.withColumn("error", F.lit(None).cast("string"))
    typed.write.parquet(f"{staged}/new")
    new = spark.read.parquet(f"{staged}/new")
    lacking = F.lit(False)
    for c in dict.fromkeys((symbol, *keys, *required)):
        lacking = lacking | F.col(c).isNull()
    known = table.select(*keys).withColumn("_old", F.lit(1))
    counted = new.groupBy(*keys).agg(F.count("*").alias("_n"), F.max("error").alias("error"), F.max(lacking).alias("_lacking"))
    found = counted.join(known, list(keys), "left")
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("_lacking"), "missing value").when(F.col("_n") > 1, "repeated key").when(F.col("_old") == 1, "key exists")
    verdict = found.groupBy(symbol).agg(F.sum("_n").alias("rows"), F.min(reason).alias("reason"))
    verdict.write.parquet(f"{staged}/verdict")
    verdict = spark.read.parquet(f"{staged}/verdict")
    good = verdict.where("reason IS NULL").select(symbol)
    taken = new.drop("error").join(good, symbol, "left_semi").select(*table.columns)
    if not good.isEmpty():
        _clustered(taken, symbol).write.parquet(f"{staged}/taken")
        root, files = _folder(spark, f"{staged}/taken")
        # The whole load appears in the table at once.
        if not files.rename(root, _folder(spark, f"{path.rstrip('/')}/load-{uuid.uuid4().hex}")[0]):
            raise OSError(f"{staged}/taken could not be put into {path}")
    drop_table(spark, f"{staged}/new")
    return verdict.select(F.col(symbol).alias("symbol"), F.when(F.col("reason").isNull(), "loaded").otherwise("rolled back").alias("status"), "rows", "reason")
