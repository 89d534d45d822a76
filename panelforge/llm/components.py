"""Connected components of a graph of links, as joins over checkpointed tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Links that one task joins by union-find (16 MB); more are joined in rounds across the cluster.
LOCAL_LINKS = 1_000_000


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links a-b and the smallest node that each of them reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while True:
        low = np.minimum(up[x], up[y])
        new = up.copy()
        np.minimum.at(new, up[x], low)
        np.minimum.at(new, up[y], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == up).all():
            return nodes, nodes[up]
        up = new


def _in_one_task(links: DataFrame) -> DataFrame:
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        ends = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in smallest_reachable(*ends)], ["node", "comp"])

    return links.coalesce(1).mapInArrow(join, "node bigint, comp bigint")


def connected(links: DataFrame, local: int | None = None) -> DataFrame:
    """node and comp (the smallest node reachable) for every node of ``links`` (columns a, b: bigint, none null).

    Up to ``local`` distinct links are joined in one task.  Beyond, each round takes the least label
    among the neighbours and then the label of that label, so long chains shrink by more than half;
    rounds end when no label changes.  Both ways give the same rows.  No links, no rows.
    """
    pairs = saved(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if pairs.count() <= (LOCAL_LINKS if local is None else local):
        return saved(_in_one_task(pairs))
    both = saved(pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).union(pairs.select("b", "a")))
    labels = saved(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("comp")))
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("comp").alias("seen")), "other").groupBy("node").agg(F.min("seen").alias("seen"))
        pulled = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "seen").alias("comp"))
        heads = labels.select(F.col("node").alias("comp"), F.col("comp").alias("head"))
        moved = saved(pulled.join(heads, "comp", "left").select("node", "old", F.least("comp", F.coalesce("head", "comp")).alias("comp")))
        labels = moved.select("node", "comp")
        if moved.where("old <> comp").isEmpty():
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, comp) after merging the components that ``links`` (a, b: components) connect."""
    into = connected(links).select(F.col("node").alias("comp"), F.col("comp").alias("into"))
    return saved(labels.join(into, "comp", "left").select("node", F.coalesce("into", "comp").alias("comp")))
