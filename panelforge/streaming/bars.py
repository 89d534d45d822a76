"""Bars over a stream of events: the incremental form of the panel."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def read_events(spark: SparkSession, folder: str, pattern: str = "events*.parquet") -> DataFrame:
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_bars(events: DataFrame, late: str = "1 day") -> DataFrame:
    """One bar for each user and day, final when the watermark has passed the day."""
    order = F.struct("ts", "event_id")
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", "1 day").alias("w"), "user_id")
        .agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("n"))
        .select(F.to_date("w.start").alias("date"), "user_id", "open", "high", "low", "close", "n")
    )


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder under the checkpoint folder that the cluster names; on one machine, if none is set, a temporary one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="panelforge-")
    return f"{named.rstrip('/')}/stream-{uuid.uuid4().hex}"


def run_available(bars: DataFrame, keys: tuple[str, ...] = ("date", "user_id")) -> DataFrame:
    """All that is available now.  Each batch appends the bars that it changed to parquet; of each key the last one counts.

    State is kept only for days that the watermark has not passed, and nothing goes through the driver.
    """
    root = shared_folder(bars.sparkSession)

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/bars/batch-{number}")

    schema = StructType([*bars.schema.fields, StructField("_batch", IntegerType())])
    bars.sparkSession.createDataFrame([], schema).write.parquet(f"{root}/bars/batch-none")
    query = bars.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    written = bars.sparkSession.read.schema(schema).parquet(f"{root}/bars/*")
    newest = F.max_by(F.struct(*[c for c in bars.columns if c not in keys]), "_batch").alias("_bar")
    return written.groupBy(*keys).agg(newest).select(*keys, "_bar.*").select(*bars.columns)
