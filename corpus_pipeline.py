"""The corpus pipeline: toxicity, near duplicates, benchmark passages, source mix, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame over all that its predecessor kept.
No rows give no rows, and columns besides those of documents go through.  Nulls in any column are
allowed; of rows that repeat in doc_id and text, and have words, one stays.
``run`` writes and rereads the result of each stage under the shared checkpoint folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import decontaminate, mixing, neardup, sharding, toxicity
from panelforge.llm.common import shared_folder, table

SHARDS = 8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5; the models are trained on the labelled rows of ``docs``."""
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), keep_all=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the one with the smallest doc_id, also where ids are null or repeat."""
    return neardup.keep_one(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut from the texts; documents that are little else go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    mixed = mixing.mix(docs, size=mixing.words(F.col("text")), quality=mixing.text_quality(F.col("text")))
    return mixed.where("times > 0").withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("doc.*")


def deal_to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents with their shard and slot."""
    return sharding.shard_documents(docs, SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_benchmark_passages),
    ("mixing", mix_to_targets),
    ("sharding", deal_to_shards),
]

#: Toxicity (a trained classifier) is not expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    root = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{root}/{i}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
