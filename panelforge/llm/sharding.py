"""Sharding by sampled splitters: near-equal bytes a shard, equal keys next to each other.

A size-weighted sample of the keys gives quantile boundaries; records are dealt to ranges
between them; ranges that come out overfull are sampled again and subdivided, a hot key by
the second part of the key.  Whole ranges are then packed into shards in key order.
Only built-in expressions run on the executors.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_name, saved, utf8_bytes

LOW = -(2**63)
PREFIX_BITS = 12
ROUNDS = 3


Bound = tuple[int, int, int]


@dataclass(frozen=True)
class Splitters:
    """Lower bounds ``(key, tie, part)`` of the ranges in order, with the shard and first slot of each."""

    bounds: list[Bound]
    shard: list[int]
    offset: list[int]


def _unit(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the values only, so that retries draw the same sample."""
    return F.pmod(F.xxhash64(*cols, F.lit("splitters")), F.lit(2**52)).cast("double") / F.lit(float(2**52))


def _lookup(keyed: DataFrame, bounds: list[Bound]) -> DataFrame:
    """Add ``_range``: the number of the last bound not above (``_key``, ``_tie``, ``_part``).

    The bounds (a few times ``max_ranges`` at most, so a proven size) are broadcast as one row for
    each prefix of the key; a row then looks only at the bounds of its own prefix.
    """
    spark = keyed.sparkSession
    shift = 64 - PREFIX_BITS
    half = 2 ** (PREFIX_BITS - 1)
    rows = []
    for p in range(-half, half):
        lo = bisect.bisect_left(bounds, (p << shift, LOW, 0))
        hi = bisect.bisect_left(bounds, ((p + 1) << shift, LOW, 0)) if p + 1 < half else len(bounds)
        rows.append((p, max(lo - 1, 0), [(*b, i) for i, b in zip(range(lo, hi), bounds[lo:hi], strict=True)]))
    by_prefix = spark.createDataFrame(rows, "_prefix long, _before int, _inside array<struct<k: long, t: long, p: long, i: int>>")
    own = F.struct(F.col("_key").alias("k"), F.col("_tie").alias("t"), F.col("_part").alias("p"))
    here = F.filter("_inside", lambda b: F.struct(b.k.alias("k"), b.t.alias("t"), b.p.alias("p")) <= own)
    joined = keyed.withColumn("_prefix", F.shiftright("_key", shift)).join(F.broadcast(by_prefix), "_prefix")
    return joined.withColumn("_range", F.greatest("_before", F.coalesce(F.array_max(F.transform(here, lambda b: b.i)), F.lit(-1)))).drop(
        "_prefix", "_before", "_inside"
    )


def _quantiles(sample: list[tuple[int, int, int, float]], step: float) -> list[Bound]:
    """Bounds every ``step`` bytes of the weighted sample; only a key of over half a step is cut inside."""
    sample = sorted(sample)
    of_key: dict[int, float] = {}
    for k, _, _, w in sample:
        of_key[k] = of_key.get(k, 0.0) + w
    bounds, filled, last = [], 0.0, None
    for k, t, p, w in sample:
        heavy = of_key[k] > step / 2
        starts = k != last
        if starts and (filled >= step or heavy or (last is not None and of_key[last] > step / 2)):
            bounds.append((k, LOW, 0))
            filled = 0.0
        elif heavy and filled >= step:
            bounds.append((k, t, p))
            filled = 0.0
        filled += w
        last = k
    return bounds


def _groups(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("_key", "_tie", "_part").agg(F.count("*").alias("_rows"), F.sum("_size").alias("_bytes"))


def splitters(groups: DataFrame, shards: int, step: float) -> Splitters:
    """Choose ranges of about ``step`` bytes, and shards, for ``groups`` (``_key``, ``_tie``, ``_part``, ``_rows``, ``_bytes``).

    The driver gets a sample of about ten groups a range, each with its weight however many rows it
    has, and one row for each range.
    """
    bounds: list[Bound] = [(LOW, LOW, 0)]
    counts: dict[int, tuple[int, int]] = {}
    overfull: list[int] | None = None
    for _ in range(ROUNDS):
        part = groups
        rate = 10.0 / step
        if overfull is not None:
            part = _lookup(groups, bounds).where(F.col("_range").isin(overfull))
            rate *= 4
        chance = F.least(F.lit(1.0), F.col("_bytes") * F.lit(rate))
        drawn = part.where(_unit(F.col("_key"), F.col("_tie"), F.col("_part")) < chance).select("_key", "_tie", "_part", (F.col("_bytes") / chance).alias("w")).collect()
        bounds = sorted({*bounds, *_quantiles([tuple(r) for r in drawn], step)})
        found = _lookup(groups, bounds).groupBy("_range").agg(F.sum("_rows"), F.sum("_bytes"), F.count("*")).collect()
        counts = {r[0]: (r[1], r[2]) for r in found}
        overfull = [i for i, _, size, several in found if size > 2 * step and several > 1]
        if not overfull:
            break
    shard, offset = _pack(bounds, counts, shards)
    return Splitters(bounds, shard, offset)


def _pack(bounds: list[Bound], counts: dict[int, tuple[int, int]], shards: int) -> tuple[list[int], list[int]]:
    """Cut the ranges into shards nearest to equal bytes, within one percent not inside a key."""
    ends, filled = [0], 0
    for i in range(len(bounds)):
        filled += counts.get(i, (0, 0))[1]
        ends.append(filled)
    cuts = []
    for j in range(1, shards):
        ideal = filled * j / shards
        slack = filled / shards * 0.01
        best = min(range(len(ends)), key=lambda i: (abs(ends[i] - ideal), i))
        whole = [i for i in range(len(bounds)) if bounds[i][1] == LOW and abs(ends[i] - ideal) <= max(slack, abs(ends[best] - ideal))]
        cuts.append(min(whole, key=lambda i: (abs(ends[i] - ideal), i)) if whole else best)
    cuts = [max(cuts[: j + 1]) for j in range(len(cuts))]
    shard = [bisect.bisect_right(cuts, i) for i in range(len(bounds))]
    offset, used = [], [0] * shards
    for i, s in enumerate(shard):
        offset.append(used[s])
        used[s] += counts.get(i, (0, 0))[0]
    return shard, offset


def shard_records(df: DataFrame, shards: int, *, key: Column, tie: Column, size: Column, rows_a_range: int = 50_000, min_ranges: int = 2048, max_ranges: int = 65_536) -> DataFrame:
    """Every row of ``df`` with ``shard`` (0 to shards-1) and ``slot`` (gapless from 0 within the shard).

    ``key`` and ``tie`` are any columns, hashed to 64 bits; equal keys stay together unless
    they outweigh half a range.  Rows alike in key and tie are one group; a group that outweighs
    half a range (there are at most twice as many as ranges) is written to the checkpoint folder
    and its rows are told apart by where they stand there.  Nulls in key and tie are values like
    others; a null size counts 0.  Repeated rows each get their own slot.  An empty table gives no
    rows.  If ``df`` has columns named shard or slot already, the new ones get an underscore in front.
    """
    spark = df.sparkSession
    to_shard, to_slot = free_name(df.columns, "shard"), free_name(df.columns, "slot")
    own = [F.col(f"`{c}`") for c in df.columns]
    keyed = df.select(
        F.struct(*own).alias("_row"), F.xxhash64(key).alias("_key"), F.xxhash64(tie).alias("_tie"), F.coalesce(size, F.lit(0)).cast("long").alias("_size"), F.lit(0).cast("long").alias("_part")
    )
    groups = saved(_groups(keyed))
    n, total = groups.agg(F.coalesce(F.sum("_rows"), F.lit(0)), F.coalesce(F.sum("_bytes"), F.lit(0))).first()
    ranges = max(min_ranges, min(max_ranges, n // rows_a_range))
    step = max(1.0, total / ranges)
    hot = [tuple(r) for r in groups.where((F.col("_rows") > 1) & (F.col("_bytes") > step / 2)).select("_key", "_tie").collect()]
    if hot:
        names = F.broadcast(spark.createDataFrame(hot, "_key long, _tie long"))
        apart = saved(keyed.join(names, ["_key", "_tie"]).select(*keyed.columns[:-1], F.monotonically_increasing_id().alias("_part")))
        groups = saved(groups.join(names, ["_key", "_tie"], "left_anti").unionByName(_groups(apart)))
        keyed = keyed.join(names, ["_key", "_tie"], "left_anti").unionByName(apart)
    plan = splitters(groups, shards, step)
    places = spark.createDataFrame([(i, *x) for i, x in enumerate(zip(plan.shard, plan.offset, strict=True))], "_range int, _shard int, _offset long")
    inside = Window.partitionBy("_range").orderBy("_key", "_tie", "_part")
    placed = _lookup(keyed, plan.bounds).withColumn("_nth", F.row_number().over(inside)).join(F.broadcast(places), "_range")
    return placed.select("_row.*", F.col("_shard").alias(to_shard), (F.col("_offset") + F.col("_nth") - 1).alias(to_slot))


def shard_documents(docs: DataFrame, shards: int) -> DataFrame:
    """Documents (doc_id, text and any others) sharded by bytes of text, copies side by side."""
    return shard_records(docs, shards, key=F.col("text"), tie=F.col("doc_id"), size=utf8_bytes(F.col("text")) + 1)


def op1_sampled_splitters(docs: DataFrame) -> DataFrame:
    """The digest of ``shard_documents`` over 8 shards; the text is read once and not shuffled."""
    text = F.col("text")
    narrow = saved(
        docs.select(
            "doc_id", (utf8_bytes(text) + 1).alias("size"), F.crc32(F.coalesce(F.encode(text, "UTF-8"), F.lit(b""))).alias("text_crc32"), F.xxhash64(text).alias("key")
        )
    )
    placed = shard_records(narrow, 8, key=F.col("key"), tie=F.col("doc_id"), size=F.col("size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
