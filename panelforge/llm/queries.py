"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, licenses, linedups, mixing, neardup, negatives, pii, repair, secrets, sharding, topk, toxicity, transport
from .common import table


def _docs(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(table(spark, sf_dir, "documents"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op5_suffix_automaton(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op9_weak_supervision(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sampled_splitters": _docs(sharding.op1_sampled_splitters),
        "op2_weak_labels": _docs(pii.op2_weak_labels),
        "op3_transport_stream": _docs(transport.op3_transport_stream),
        "op4_license_dice": _docs(licenses.op4_license_dice),
        "op5_suffix_automaton": op5,
        "op6_divide_skip": _docs(neardup.op6_divide_skip),
        "op7_repeated_lines": _docs(linedups.op7_repeated_lines),
        "op7_repeated_passages": _docs(linedups.op7_repeated_passages),
        "op8_secret_forest": _docs(secrets.op8_secret_forest),
        "op9_weak_supervision": op9,
        "op10_mix_sources": _docs(mixing.op10_mix_sources),
        "op11_norm_buckets": lambda spark, sf_dir: topk.op11_norm_buckets(table(spark, sf_dir, "embeddings")),
        "op12_signatures": lambda spark, sf_dir: repair.op12_signatures(table(spark, sf_dir, "conversations")),
        "op13_dual_tree": lambda spark, sf_dir: negatives.op13_dual_tree(table(spark, sf_dir, "embeddings")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_suffix_automaton": decontaminate.ORACLE,
        "op6_divide_skip": neardup.ORACLE,
        "op7_repeated_lines": linedups.ORACLE,
        "op10_mix_sources": mixing.ORACLE,
        "op11_norm_buckets": topk.ORACLE,
        "op12_signatures": repair.ORACLE,
        "op13_dual_tree": negatives.ORACLE,
    }
