"""Reading, writing and merging tables: typed text files, appends and upserts without a table format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BAR_SCHEMA = "date date, ticker string, open double, high double, low double, close double, volume double, vwap double, n_trades long"
ACTION_SCHEMA = "date date, ticker string, kind string, amount double"


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Daily bars from CSV with a header; a line that does not parse gives nulls."""
    return spark.read.csv(path, schema=BAR_SCHEMA, header=True, mode="PERMISSIVE")


def read_actions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=ACTION_SCHEMA, header=True)


def read_aggregates(spark: SparkSession, path: str) -> DataFrame:
    """Vendor aggregates from JSON lines, epoch milliseconds as the trading date of New York."""
    raw = spark.read.json(path, schema="ticker string, timestamp long, open double, high double, low double, close double, volume double, vwap double")
    local = F.to_date(F.from_utc_timestamp(F.timestamp_millis("timestamp"), "America/New_York"))
    last = Window.partitionBy("ticker", "date").orderBy(F.desc("timestamp"))
    return raw.withColumn("date", local).withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "timestamp")


def read_database(spark: SparkSession, url: str, table: str, columns: list[str], first: str, last: str, **options: str) -> DataFrame:
    """Columns of a table between two dates over JDBC; the projection and the range reach the database."""
    found = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return found.select(*columns).where(F.col("trade_date").between(first, last))


def upsert(target: DataFrame, source: DataFrame, keys: list[str], newest: str) -> DataFrame:
    """``target`` with the rows of ``source`` in place of those of the same keys; of several the newest."""
    latest = source.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(newest)))).where("_r = 1").drop("_r")
    return target.join(latest.select(*keys), keys, "left_anti").unionByName(latest, allowMissingColumns=True)


def append(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)
