"""What the vector searches share: integer vectors, exact products, block joins."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved

#: Cells (rows times components) that the driver takes as a sample and sends to tasks: 16 MB of long.
SAMPLE_CELLS = 1 << 21


def integer_vectors(rows: DataFrame, vector: str = "embedding", *keep: str) -> DataFrame:
    """vec_id, ``keep`` and v, the components as floor(256 * x), of the rows that take part.

    Vectors that are null or hold a null or non-finite component take no part; components
    saturate at the range of long; shorter vectors are padded with zeros to the longest.
    """
    x = F.col(vector).cast("array<double>")
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    found = rows.select("vec_id", *keep, x.alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", bad))
    whole = found.withColumn("v", F.transform("v", lambda e: F.floor(e * 256.0)))
    ends = whole.agg(F.max(F.size("v")).alias("most"), F.min(F.size("v")).alias("least")).first()
    if ends["most"] == ends["least"]:
        return whole
    return whole.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(ends["most"]) - F.size("v"))))


def first_of_equals(rows: DataFrame, most: int, *same: str) -> DataFrame:
    """Of rows equal in v and ``same``, the ``most`` with the smallest vec_id: no other can be among the best ``most``.

    Spark limits each group before the shuffle, so a hot vector costs ``most`` rows a task.
    """
    order = Window.partitionBy(F.xxhash64("v"), *same, "v").orderBy(F.col("vec_id").asc_nulls_last())
    return rows.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= most).drop("_nth")


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    whole = column.combine_chunks()
    whole = whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole
    flat = np.asarray(whole.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)
    return flat.reshape(len(whole), -1) if len(whole) and len(flat) else np.zeros((len(whole), 0), dtype=np.int64)


def product_type(*parts: np.ndarray) -> type:
    """The fastest type that holds every inner product of the rows of ``parts`` exactly."""
    dims = parts[0].shape[1]
    tops = [max(abs(int(p.max())), abs(int(p.min()))) if p.size else 0 for p in parts]
    bound = dims * tops[0] * tops[-1]
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else object


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of ``a`` and ``b`` (of one product type) as long, saturated there."""
    found = a @ b.T
    if found.dtype != object:
        return found.astype(np.int64)
    if not a.shape[1]:
        return np.zeros(found.shape, dtype=np.int64)
    return np.clip(found, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def lengths(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))


def sample(rows: DataFrame, most: int, *columns: str) -> pa.Table:
    """At most ``most`` rows, and no more than ``SAMPLE_CELLS`` components, chosen by a hash of vector and id."""
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 1
    few = rows.select(*columns, "v").orderBy(F.xxhash64("v", "vec_id"), "vec_id").limit(max(1, min(most, SAMPLE_CELLS // max(dims, 1))))
    return few.toArrow()


def hits_table(schema: pa.Schema, *columns: np.ndarray | pa.Array) -> pa.Table:
    return pa.table([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def best(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Positions of the ``most`` best of each owner: higher scores first, then smaller ids (nulls come as the largest)."""
    order = np.lexsort((ids, ~score, owner))
    own = owner[order]
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, dtype=np.int64)
    within = np.arange(len(own)) - np.repeat(starts, np.diff(np.r_[starts, len(own)]))
    return order[within < most]


def plain_ids(column: pa.ChunkedArray) -> np.ndarray:
    """Ids for sorting; null sorts last, as the largest long."""
    return np.asarray(column.fill_null((1 << 63) - 1).combine_chunks().to_numpy(zero_copy_only=False), dtype=np.int64)


def blocks(count: int, rows: int) -> int:
    return max(1, math.ceil(count / rows))


def in_blocks(queries: DataFrame, vectors: DataFrame, keys: list[str], kernel: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``kernel`` of each block of queries and block of vectors that share ``keys``; both sides are bounded blocks."""

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        return kernel(left, right)

    return queries.groupBy(*keys).cogroup(vectors.groupBy(*keys)).applyInArrow(one, schema)


def distinct_queries(rows: DataFrame, *same: str) -> DataFrame:
    """Equal query rows once, with their number as ``copies`` and a ``key``; saved, so that keys stay."""
    once = rows.groupBy("vec_id", *same, "v").agg(F.count("*").alias("copies"))
    return saved(once.withColumn("key", F.monotonically_increasing_id()))


def drop_own(ranked: DataFrame, rank: str, own: str, most: int) -> DataFrame:
    """Ranked candidates of each ``key`` without the query's own row: the first that is like it in id and score."""
    by = Window.partitionBy("key")
    at = F.min(F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col(own)), F.col(rank))).over(by)
    left = ranked.withColumn("_own", at).where(F.col("_own").isNull() | (F.col(rank) != F.col("_own")))
    return left.withColumn(rank, F.col(rank) - F.when(F.col("_own") < F.col(rank), 1).otherwise(0)).where(F.col(rank) <= most).drop("_own")
