"""What the operators of this subpackage share: reading tables, checkpoints, word rules."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that are not word bytes under the rule ``[0-9a-z]`` or non-ASCII after lower-casing A-Z.
WORD_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound the memory of one Arrow batch: very long texts make default batches too large."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; executors and driver share it.

    Where it is unset, only a session on one machine (a local master, as in tests) gets a temporary
    folder; on a cluster that is an error, as executors would not find each other's files.
    """
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="panelforge-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder that the cluster names."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def free_name(taken: list[str], wanted: str) -> str:
    """``wanted``, or with underscores in front where a column already has that name."""
    lower = {c.lower() for c in taken}
    while wanted.lower() in lower:
        wanted = f"_{wanted}"
    return wanted


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
