"""Hard negatives by dual-tree search: trees over anchors and candidates, pruned pair by pair of nodes.

The upper tree is fitted on a bounded sample; every row is then dealt to one of its cells, and the
ball of a cell covers all its rows.  A group of anchors and a cell whose interval of inner products
holds no score that any anchor of the group wants is dropped before anything is shuffled to it.  The
pairs that stay are dealt out as blocks; within a block, two lower trees are walked together, and
pairs of leaves that stay are scored exactly.  The search runs twice: for the positives of an anchor
(at least as good as its threshold), and for the negatives within the windows that these give.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved
from .vectors import best, blocks, distinct_queries, drop_own, first_of_equals, in_blocks, integer_vectors, lengths, matrix, plain_ids, product_type, products, sample

#: Rows that the upper tree is fitted on and that give thresholds, its cells at most, rows of a block and of a leaf.
SAMPLE_ROWS, MOST_CELLS, BLOCK_ROWS, ANCHOR_ROWS, LEAF_ROWS = 4096, 1024, 8192, 4096, 256
#: Balls and intervals are computed in floating point; they are widened by this share.
SLACK = 1e-9
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1

_HITS = pa.schema([("key", pa.int64()), ("positive_rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
HITS = "key long, positive_rank int, vec_id long, score long"


@dataclass(frozen=True)
class Upper:
    """Splits of the upper tree, level by level, and the centre of each cell."""

    directions: list[np.ndarray]
    cuts: list[np.ndarray]
    centres: np.ndarray

    def cell(self, v: np.ndarray) -> np.ndarray:
        at = np.zeros(len(v), dtype=np.int64)
        for directions, cuts in zip(self.directions, self.cuts, strict=True):
            at = 2 * at + ((v * directions[at]).sum(axis=1) > cuts[at])
        return at

    def distance(self, v: np.ndarray, cell: np.ndarray) -> np.ndarray:
        return lengths(v - self.centres[cell])


def _far_apart(v: np.ndarray) -> np.ndarray:
    """The direction between two rows of ``v`` that lie far apart."""
    one = v[np.argmax(lengths(v - v.mean(axis=0)))]
    return v[np.argmax(lengths(v - one))] - one


def fit_upper(v: np.ndarray, levels: int) -> Upper:
    groups, directions, cuts = [v], [], []
    for _ in range(levels):
        ways = [_far_apart(g) if len(g) else np.zeros(v.shape[1]) for g in groups]
        at = [g @ w for g, w in zip(groups, ways, strict=True)]
        middle = [float(np.median(a)) if len(a) else 0.0 for a in at]
        groups = [part for g, a, m in zip(groups, at, middle, strict=True) for part in (g[a <= m], g[a > m])]
        directions.append(np.array(ways))
        cuts.append(np.array(middle))
    return Upper(directions, cuts, np.array([g.mean(axis=0) if len(g) else np.zeros(v.shape[1]) for g in groups]))


def interval(a: np.ndarray, ra: np.ndarray, b: np.ndarray, rb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of a point of each ball (rows of a, radii ra) with one of each ball (b, rb)."""
    middle = a @ b.T
    reach = lengths(a)[:, None] * rb[None, :] + ra[:, None] * lengths(b)[None, :] + ra[:, None] * rb[None, :]
    reach = reach * (1 + SLACK) + SLACK * (1 + np.abs(middle))
    return middle - reach, middle + reach


@dataclass
class Nodes:
    """A lower tree: rows in leaf order, and for each node its slice, ball and children (-1: leaf)."""

    order: np.ndarray
    start: list[int]
    end: list[int]
    left: list[int]
    centre: np.ndarray
    radius: np.ndarray


def lower_tree(v: np.ndarray, leaf: int) -> Nodes:
    order = np.arange(len(v))
    start, end, left, centres, radii = [0], [len(v)], [-1], [], []
    node = 0
    while node < len(start):
        s, e = start[node], end[node]
        rows = v[order[s:e]]
        centre = rows.mean(axis=0)
        apart = lengths(rows - centre)
        centres.append(centre)
        radii.append(float(apart.max()))
        if e - s > leaf and radii[-1] > 0:
            along = np.argsort(rows @ _far_apart(rows), kind="stable")
            order[s:e] = order[s:e][along]
            middle = s + (e - s) // 2
            left[node] = len(start)
            start += [s, middle]
            end += [middle, e]
            left += [-1, -1]
        node += 1
    return Nodes(order, start, end, left, np.array(centres), np.array(radii))


def walk(a: Nodes, b: Nodes, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of leaves that may hold a score within the bounds of the anchors, ``low`` and ``high`` by node of ``a``."""
    pairs = np.array([[0, 0]])
    while len(pairs):
        at, to = pairs[:, 0], pairs[:, 1]
        middle = (a.centre[at] * b.centre[to]).sum(axis=1)
        reach = lengths(a.centre[at]) * b.radius[to] + a.radius[at] * lengths(b.centre[to]) + a.radius[at] * b.radius[to]
        reach = reach * (1 + SLACK) + SLACK * (1 + np.abs(middle))
        stays = (middle + reach >= low[at]) & (middle - reach <= high[at])
        following = []
        for x, y in pairs[stays]:
            if a.left[x] < 0 and b.left[y] < 0:
                yield x, y
            elif b.left[y] < 0 or (a.left[x] >= 0 and a.radius[x] >= b.radius[y]):
                following += [(a.left[x], y), (a.left[x] + 1, y)]
            else:
                following += [(x, b.left[y]), (x, b.left[y] + 1)]
        pairs = np.array(following).reshape(-1, 2)


def _windows(anchors: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest wanted score of each anchor and window, as matrices."""
    return tuple(matrix(anchors[c]) for c in ("low", "high"))


def search_block(anchors: pa.Table, candidates: pa.Table, same: bool, k: int) -> pa.Table:
    """The ``k`` best scores in each window of each anchor, of candidates with the same label or another one."""
    if not anchors.num_rows or not candidates.num_rows:
        return _HITS.empty_table()
    q, v = matrix(anchors["v"]), matrix(candidates["v"])
    low, high = _windows(anchors)
    least, most = low.min(axis=1), high.max(axis=1)
    labels, others = (np.asarray(t["label"].to_numpy(), dtype=np.int64) for t in (anchors, candidates))
    ids = plain_ids(candidates["vec_id"])
    a, b = lower_tree(q.astype(np.float64), max(1, LEAF_ROWS // 4)), lower_tree(v.astype(np.float64), LEAF_ROWS)
    node_low = np.array([least[a.order[s:e]].min() for s, e in zip(a.start, a.end, strict=True)], dtype=np.float64)
    node_high = np.array([most[a.order[s:e]].max() for s, e in zip(a.start, a.end, strict=True)], dtype=np.float64)
    kind = product_type(q, v)
    exact_q, exact_v = q.astype(kind), v.astype(kind)
    found: list[list[np.ndarray]] = [[], [], [], []]

    def keep(parts: list[np.ndarray]) -> list[np.ndarray]:
        """The best of each anchor and window."""
        of, window, at, score = parts
        taken = best(of * low.shape[1] + window, score, ids[at], k)
        return [p[taken] for p in parts]

    held = 0
    for x, y in walk(a, b, node_low, node_high):
        rows, cols = a.order[a.start[x] : a.end[x]], b.order[b.start[y] : b.end[y]]
        score = products(exact_q[rows], exact_v[cols])
        fits = (labels[rows][:, None] == others[cols][None, :]) == same
        i, j = np.nonzero(fits & (score >= least[rows][:, None]) & (score <= most[rows][:, None]))
        s = score[i, j]
        for w in range(low.shape[1]):
            inside = (s >= low[rows[i], w]) & (s <= high[rows[i], w])
            for to, part in zip(found, (rows[i[inside]], np.full(inside.sum(), w), cols[j[inside]], s[inside]), strict=True):
                to.append(part)
            held += int(inside.sum())
        if held > 1 << 20:
            found = [[p] for p in keep([np.concatenate(p) for p in found])]
            held = len(found[0][0])
    if not found[0]:
        return _HITS.empty_table()
    of, window, at, score = keep([np.concatenate(p) for p in found])
    keys, names = (t.combine_chunks().take(pa.array(p)) for t, p in ((anchors["key"], of), (candidates["vec_id"], at)))
    return pa.table([keys, pa.array(window + 1, pa.int32()), names, pa.array(score)], schema=_HITS)


def _arrow(rows: DataFrame, add: Callable[[pa.RecordBatch], list[pa.Array]], more: str) -> DataFrame:
    """``rows`` with the columns ``more`` that ``add`` makes of each batch."""
    names = [c.split()[0] for c in more.split(", ")]

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *add(batch)], names=[*batch.schema.names, *names])

    return rows.mapInArrow(one, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, {more}")


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return matrix(pa.chunked_array([batch.column(name)]))


def _in_cells(rows: DataFrame, upper: Upper) -> DataFrame:
    """``rows`` with their cell and their distance from its centre."""
    shared = rows.sparkSession.sparkContext.broadcast(upper)

    def add(batch: pa.RecordBatch) -> list[pa.Array]:
        v = _column(batch, "v").astype(np.float64)
        cell = shared.value.cell(v) if len(v) else np.zeros(0, dtype=np.int64)
        return [pa.array(cell.astype(np.int32)), pa.array(shared.value.distance(v, cell) if len(v) else np.zeros(0))]

    return _arrow(rows, add, "cell int, apart double")


def _windowed(anchors: DataFrame, seen: pa.Table, same: bool, k: int) -> DataFrame:
    """Raises ``low`` to the ``k``-th best score that the rows of the sample give within a window, where they are enough."""
    shared = anchors.sparkSession.sparkContext.broadcast((matrix(seen["v"]), np.asarray(seen["label"].to_numpy(), dtype=np.int64)))

    def add(batch: pa.RecordBatch) -> list[pa.Array]:
        v, labels = shared.value
        q, low, high = (_column(batch, c) for c in ("v", "least", "high"))
        low, mine = low.copy(), batch.column("label").to_numpy(zero_copy_only=False)
        kind = product_type(q, v) if len(q) and len(v) else np.float64
        exact = v.astype(kind)
        for s in range(0, len(q), 256):
            score = products(q[s : s + 256].astype(kind), exact)
            fits = (mine[s : s + 256][:, None] == labels[None, :]) == same
            for w in range(low.shape[1]):
                inside = fits & (score >= low[s : s + 256, w : w + 1]) & (score <= high[s : s + 256, w : w + 1])
                if len(v) >= k:
                    kth = np.partition(np.where(inside, score, LOWEST), len(v) - k, axis=1)[:, len(v) - k]
                    low[s : s + 256, w] = np.maximum(low[s : s + 256, w], kth)
        return [pa.array(list(low), pa.list_(pa.int64()))]

    return _arrow(anchors.withColumnRenamed("low", "least"), add, "low array<bigint>").drop("least")


def _pairs(groups: DataFrame, upper: Upper, balls: list[tuple[int, float, int]]) -> DataFrame:
    """Groups of anchors with each part of each cell that they may find something in.

    ``balls`` is radius and number of parts of each cell, at most ``MOST_CELLS`` rows.
    """
    cells = np.array([c for c, _, _ in balls], dtype=np.int64)
    radii, parts = np.array([r for _, r, _ in balls]), [n for _, _, n in balls]
    shared = groups.sparkSession.sparkContext.broadcast(upper.centres)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in batch.to_pylist():
                low, high = interval(shared.value[[g["cell"]]], np.array([g["radius"]]), shared.value[cells], radii)
                stays = np.flatnonzero((high[0] >= g["least"]) & (low[0] <= g["most"]))
                to = [(int(cells[i]), p) for i in stays for p in range(parts[i])]
                if to:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([g["cell"]] * len(to), pa.int32()), pa.array([g["part"]] * len(to), pa.int32()), pa.array([c for c, _ in to], pa.int32()), pa.array([p for _, p in to], pa.int32())],
                        names=["cell", "part", "to_cell", "to_part"],
                    )

    return groups.mapInArrow(one, "cell int, part int, to_cell int, to_part int")


def _parts(counts: list[tuple[int, float, int]], rows: int, cell: str = "cell"):
    """The part of its cell that a row falls into; parts are as many as keep blocks at ``rows`` rows."""
    spec = F.create_map(*[x for c, _, n in counts for x in (F.lit(c), F.lit(blocks(n, rows)))]) if counts else F.lit(None).cast("map<int,int>")
    return F.pmod(F.xxhash64("v", "vec_id"), F.coalesce(spec[F.col(cell)], F.lit(1))).cast("int")


def _balls(rows: DataFrame) -> list[tuple[int, float, int]]:
    """Cell, radius and number of rows; at most ``MOST_CELLS`` rows."""
    return [(r["cell"], r["radius"], r["n"]) for r in rows.groupBy("cell").agg(F.max("apart").alias("radius"), F.count("*").alias("n")).collect()]


class Forest:
    """Candidates dealt to the cells of an upper tree; ``search`` looks for scores within windows."""

    def __init__(self, candidates: DataFrame) -> None:
        self.seen = sample(candidates, SAMPLE_ROWS, "label")
        v = matrix(self.seen["v"]).astype(np.float64)
        levels = min(MOST_CELLS, blocks(candidates.count(), BLOCK_ROWS)).bit_length() - 1 if len(v) else 0
        self.upper = fit_upper(v, levels)
        self.rows = saved(_in_cells(candidates, self.upper))
        self.balls = _balls(self.rows)

    def search(self, anchors: DataFrame, same: bool, k: int) -> DataFrame:
        """key, positive_rank, vec_id, score: the ``k`` best of each window ``low`` to ``high`` of each anchor, by block.

        ``anchors`` has key, vec_id, label, v and the arrays low and high.
        """
        placed = saved(_in_cells(_windowed(anchors, self.seen, same, k), self.upper))
        placed = placed.withColumn("part", _parts(_balls(placed), ANCHOR_ROWS))
        groups = placed.groupBy("cell", "part").agg(F.max("apart").alias("radius"), F.min(F.array_min("low")).alias("least"), F.max(F.array_max("high")).alias("most"))
        pairs = saved(_pairs(groups, self.upper, [(c, r, blocks(n, BLOCK_ROWS)) for c, r, n in self.balls]))
        asked = placed.join(pairs, ["cell", "part"]).select("key", "label", "v", "low", "high", "cell", "part", "to_cell", "to_part")
        dealt = self.rows.select("vec_id", "label", "v", F.col("cell").alias("to_cell"), _parts(self.balls, BLOCK_ROWS).alias("to_part"))
        dealt = dealt.join(pairs, ["to_cell", "to_part"]).select("vec_id", "label", "v", "cell", "part", "to_cell", "to_part")
        return in_blocks(asked, dealt, ["cell", "part", "to_cell", "to_part"], functools.partial(search_block, same=same, k=k), HITS)


def _one_window(anchors: DataFrame) -> DataFrame:
    return anchors.withColumn("low", F.array(F.lit(LOWEST))).withColumn("high", F.array(F.lit(HIGHEST)))


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90) -> DataFrame:
    """anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, label and v (whole numbers of one length); ``anchors`` are rows of it.  For
    each of an anchor's best ``positives`` rows of its label, the best ``negatives`` rows of other labels
    whose score is ``least`` to ``most`` percent of the positive's.  Nothing is capped or left out;
    equal anchors are searched once and returned as often as they stand there.
    """
    forest = Forest(first_of_equals(vectors.select("vec_id", "label", "v"), max(positives + 1, negatives), "label"))
    asked = _with_own(distinct_queries(anchors.select("vec_id", "label", "v"), "label"))
    order = Window.partitionBy("key").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    near = forest.search(_one_window(asked), True, positives + 1).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives + 1)
    who = asked.select("key", F.col("vec_id").alias("query_id"), "own")
    found = saved(drop_own(near.join(who, "key"), "rank", "own", positives).select("key", F.col("rank").alias("positive_rank"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    score = F.col("positive_score").cast("decimal(20,0)")
    low, high = F.ceil(score * least / 100).cast("decimal(20,0)"), F.floor(score * most / 100).cast("decimal(20,0)")
    fits = found.where(low <= high).withColumn("low", low.cast("long")).withColumn("high", high.cast("long"))
    # Ranks of positives without a possible negative leave no window; windows are numbered by what is left.
    windows = fits.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("positive_rank", "low", "high"))).alias("w"))
    wide = windows.select("key", F.col("w.positive_rank").alias("ranks"), *[F.col(f"w.{c}").alias(c) for c in ("low", "high")])
    # Blocks want matrices: an anchor with fewer windows repeats its last one, and only the first copy is read.
    full = lambda c: F.concat(c, F.array_repeat(F.element_at(c, -1), F.lit(positives) - F.size(c)))
    ready = wide.withColumn("low", full("low")).withColumn("high", full("high"))
    hits = forest.search(asked.join(ready, "key").select("key", "vec_id", "label", "v", "low", "high"), False, negatives)
    hits = hits.join(ready.select("key", "ranks"), "key").where(F.col("positive_rank") <= F.size("ranks")).withColumn("positive_rank", F.get("ranks", F.col("positive_rank") - 1))
    order = Window.partitionBy("key", "positive_rank").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    out = ranked.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(found, ["key", "positive_rank"])
    out = out.join(asked.select("key", F.col("vec_id").alias("anchor_id"), "copies"), "key").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select("anchor_id", "positive_id", "positive_rank", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def _with_own(queries: DataFrame) -> DataFrame:
    """Queries with ``own``, the exact score of a row with itself."""

    def add(batch: pa.RecordBatch) -> list[pa.Array]:
        q = _column(batch, "v")
        kind = product_type(q, q)
        return [pa.array(np.array([products(x, x)[0, 0] for x in np.split(q.astype(kind), len(q))] if len(q) else [], dtype=np.int64))]

    return saved(_arrow(queries, add, "own long"))


def op13_dual_tree(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of each row whose vec_id is divisible by 100, for each of its 5 best positives.

    Where vec_id is divisible by 7, the label becomes (label + 1) % 10 first.  Rows with a null label, a
    null vector or a null or non-finite component take no part; shorter vectors count as padded with
    zeros.  Rows without vec_id are candidates, last among equal scores; a repeated row is an anchor, a
    positive and a negative of its own.  No rows give no rows; other columns are not read.
    """
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    vectors = integer_vectors(embeddings.where(F.col("label").isNotNull()).select("vec_id", "embedding", label.alias("label")), "embedding", "label")
    found = hard_negatives(vectors, vectors.where(F.col("vec_id") % 100 == 0))
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10"""
