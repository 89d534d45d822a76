"""Exact top-k search by inner product with buckets of vectors of like length.

Vectors fall into ranges by length.  A query's best scores among the longest vectors give it a
threshold; with it, a range whose longest vector can't reach the threshold is never visited.
In a visited bucket the threshold becomes a local cosine threshold.  Where that is low, vectors
are pruned by length (a prefix of the bucket, sorted by length); where it is high, by coordinate
(only vectors whose values in the query's largest coordinates lie in the feasible interval).
What is left is verified by exact integer products.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved
from .vectors import SAMPLE_CELLS, best, blocks, distinct_queries, drop_own, first_of_equals, in_blocks, integer_vectors, lengths, matrix, plain_ids, product_type, products

#: Ranges of length at most, vectors of a bucket, queries of a block, longest vectors that give thresholds.
MOST_RANGES, BUCKET_ROWS, QUERY_ROWS, SEED_ROWS = 256, 8192, 4096, 2048
#: From this local cosine threshold on, a bucket is pruned by coordinate; so many coordinates are looked at.
COORDINATE_FROM, FOCUS = 0.8, 3
#: Queries that are multiplied at once.
SLICE = 256
#: Bounds are computed in floating point; they are widened by this share.
SLACK = 1e-9

HITS = "key long, vec_id long, score long"
_SCHEMA = pa.schema([("key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def local_cosine(theta: np.ndarray, length: np.ndarray, longest: float) -> np.ndarray:
    """The cosine that a vector of the bucket needs; no vector can reach values above 1."""
    reach = length * longest
    return np.where(theta <= 0, -np.inf, np.where(reach > 0, theta / np.where(reach > 0, reach, 1.0), np.inf))


def by_coordinate(q: np.ndarray, units: np.ndarray, orders: dict[int, np.ndarray], cosine: float) -> np.ndarray:
    """Rows of ``units`` that may reach ``cosine`` with the unit vector ``q``: in reach in each focus coordinate.

    Two unit vectors within an angle have angles to a coordinate axis that differ by no more.
    """
    focus = np.argsort(-np.abs(q), kind="stable")[:FOCUS]
    angle = math.acos(min(1.0, max(-1.0, cosine)))
    ends = []
    for f in focus:
        own = math.acos(min(1.0, max(-1.0, q[f])))
        ends.append((f, math.cos(min(math.pi, own + angle)) - 1e-7, math.cos(max(0.0, own - angle)) + 1e-7))
    found = None
    for f, low, high in ends:
        if f not in orders:
            orders[f] = np.argsort(units[:, f], kind="stable")
        column = units[orders[f], f]
        rows = orders[f][np.searchsorted(column, low, "left") : np.searchsorted(column, high, "right")]
        found = rows if found is None or len(rows) < len(found) else found
    for f, low, high in ends:
        found = found[(units[found, f] >= low) & (units[found, f] <= high)]
    return found


def search_bucket(queries: pa.Table, bucket: pa.Table, k: int) -> pa.Table:
    """The ``k`` best vectors of the bucket for each query, of those that reach its threshold."""
    if not queries.num_rows or not bucket.num_rows:
        return _SCHEMA.empty_table()
    v, q = matrix(bucket["v"]), matrix(queries["v"])
    size = lengths(v)
    order = np.argsort(-size, kind="stable")
    v, size, ids = v[order], size[order], plain_ids(bucket["vec_id"])[order]
    theta = np.asarray(queries["theta"].fill_null(-(1 << 62)).to_numpy(), dtype=np.float64)
    long = lengths(q)
    cosine = local_cosine(theta * np.where(theta > 0, 1 - SLACK, 1 + SLACK), long, float(size[0]))
    kind = product_type(q, v)
    exact_v, exact_q = v.astype(kind), q.astype(kind)
    floor = np.asarray(queries["theta"].fill_null(-(1 << 63)).to_numpy(), dtype=np.int64)
    owners, rows, scores = [], [], []

    def keep(of: np.ndarray, at: np.ndarray, score: np.ndarray) -> None:
        taken = best(of, score, ids[at], k)
        owners.append(of[taken])
        rows.append(at[taken])
        scores.append(score[taken])

    need = np.where(long > 0, theta * (1 - SLACK) / np.where(long > 0, long, 1.0), np.inf)
    prefix = np.where(theta <= 0, len(v), np.searchsorted(-size, -need, "right"))
    plain = np.flatnonzero((cosine < COORDINATE_FROM) & (prefix > 0))
    plain = plain[np.argsort(prefix[plain], kind="stable")]
    for s in range(0, len(plain), SLICE):
        part = plain[s : s + SLICE]
        found = products(exact_q[part], exact_v[: prefix[part].max()])
        of, at = np.nonzero(found >= floor[part][:, None])
        keep(part[of], at, found[of, at])
    units = orders = None
    for i in np.flatnonzero((cosine >= COORDINATE_FROM) & (cosine <= 1)):
        if units is None:
            units, orders = v / np.where(size > 0, size, 1.0)[:, None], {}
        at = by_coordinate(q[i] / long[i], units, orders, float(cosine[i]))
        at = at[at < prefix[i]]
        score = products(exact_q[i : i + 1], exact_v[at])[0]
        at, score = at[score >= floor[i]], score[score >= floor[i]]
        keep(np.full(len(at), i), at, score)
    of, at, score = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, dtype=np.int64) for x in (owners, rows, scores))
    names = bucket["vec_id"].combine_chunks().take(pa.array(order[at]))
    return pa.table([queries["key"].combine_chunks().take(pa.array(of)), names, pa.array(score)], schema=_SCHEMA)


def _with_thresholds(queries: DataFrame, seeds: np.ndarray, k: int) -> DataFrame:
    """own: the score of a query with itself; theta: the ``k``-th best among the seeds, null where they are fewer."""
    shared = queries.sparkSession.sparkContext.broadcast(seeds)

    def one(batches):
        rows = shared.value
        for batch in batches:
            q = matrix(pa.chunked_array([batch.column("v")]))
            theta, kind = np.zeros(len(q), dtype=np.int64), product_type(q, q)
            own = np.array([products(x, x)[0, 0] for x in np.split(q.astype(kind), len(q))] if len(q) else [], dtype=np.int64)
            if len(rows) >= k and len(q):
                kind = product_type(q, rows)
                exact = rows.astype(kind)
                for s in range(0, len(q), SLICE):
                    theta[s : s + SLICE] = np.partition(products(q[s : s + SLICE].astype(kind), exact), len(rows) - k, axis=1)[:, len(rows) - k]
            column = pa.array(theta) if len(rows) >= k else pa.nulls(len(q), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), column], names=[*batch.schema.names, "own", "theta"])

    return queries.mapInArrow(one, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in queries.schema)}, own long, theta long")


def _ranges(vectors: DataFrame) -> list[tuple[float, float, int]]:
    """Lower end, longest vector and number of parts of each range of length; at most ``MOST_RANGES`` rows."""
    count = vectors.count()
    wanted = min(MOST_RANGES, blocks(count, BUCKET_ROWS))
    ends = sorted(set(vectors.approxQuantile("length", [i / wanted for i in range(1, wanted)], 0.1 / wanted))) if wanted > 1 else []
    at = F.size(F.filter(F.array(*[F.lit(e) for e in ends]).cast("array<double>"), lambda e: e <= F.col("length")))
    found = vectors.groupBy(at.alias("i")).agg(F.max("length").alias("longest"), F.count("*").alias("n")).collect()
    known = {r["i"]: (r["longest"], blocks(r["n"], BUCKET_ROWS)) for r in found}
    return [(low, *known.get(i, (0.0, 0))) for i, low in enumerate([float("-inf"), *ends])]


def top_products(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best other rows of ``vectors`` for each row of ``queries``.

    Both have vec_id and v, whole numbers of one length; queries are rows of ``vectors``.  No buckets,
    candidates or results are capped: a range of any size is dealt into parts, and each block of
    queries meets each part that its thresholds leave.  Equal queries are searched once and returned
    as often as they stand there.
    """
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    kept = saved(first_of_equals(vectors.select("vec_id", "v"), k + 1).withColumn("length", length))
    dims = kept.agg(F.max(F.size("v"))).first()[0] or 1
    seeds = kept.orderBy(F.col("length").desc(), "vec_id").limit(max(k + 1, min(SEED_ROWS, SAMPLE_CELLS // max(dims, 1)))).select("v").toArrow()
    ranges = _ranges(kept)
    asked = saved(_with_thresholds(distinct_queries(queries.select("vec_id", "v")), matrix(seeds["v"]), k + 1).withColumn("length", length))
    n_blocks = blocks(asked.count(), QUERY_ROWS)
    spec = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(longest).alias("longest"), F.lit(parts).alias("parts")) for i, (_, longest, parts) in enumerate(ranges)])
    reach = lambda r: F.col("theta").isNull() | (F.col("theta") <= 0) | (F.col("theta") * (1 - SLACK) <= F.col("length") * r["longest"])
    visits = (
        asked.withColumn("block", F.pmod(F.xxhash64("v", "vec_id"), F.lit(n_blocks)))
        .withColumn("r", F.explode(F.filter(spec, lambda r: (r["parts"] > 0) & reach(r))))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("r.parts") - 1)))
        .select("key", "v", "theta", "block", F.col("r.i").alias("range"), "part")
    )
    at = F.size(F.filter(F.array(*[F.lit(low) for low, _, _ in ranges[1:]]).cast("array<double>"), lambda e: e <= F.col("length")))
    parts = F.element_at(F.array(*[F.lit(max(1, n)) for _, _, n in ranges]), F.col("range") + 1)
    dealt = (
        kept.withColumn("range", at).withColumn("part", F.pmod(F.xxhash64("v", "vec_id"), parts).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
        .select("vec_id", "v", "block", "range", "part")
    )
    hits = in_blocks(visits, dealt, ["block", "range", "part"], functools.partial(search_bucket, k=k + 1), HITS)
    order = Window.partitionBy("key").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)
    who = asked.select("key", F.col("vec_id").alias("query_id"), "copies", "own")
    found = drop_own(ranked.join(who, "key"), "rank", "own", k)
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op11_norm_buckets(embeddings: DataFrame) -> DataFrame:
    """The 5 highest integer inner products of each row whose vec_id is divisible by 50 with every other row.

    Null or non-finite components and null vectors take no part; shorter vectors count as padded with
    zeros, empty ones score 0.  Rows without vec_id are candidates, last among equal scores.  A repeated
    row is a query and a candidate of its own.  No rows give no rows; other columns are not read.
    """
    vectors = integer_vectors(embeddings)
    return top_products(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""
