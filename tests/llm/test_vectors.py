"""Searches over vectors against all pairs in plain Python."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from panelforge.llm import negatives, topk, vectors

SCHEMA = "vec_id long, embedding array<double>, label int"
CLASH = ", key long, v string, theta int, block int, cell int, part int, copies int, score string, rank int, length int, own int"


def whole(row):
    i, e, label = row[:3]
    if e is None or any(x is None or not math.isfinite(x) for x in e):
        return None
    return i, [math.floor(256 * x) for x in e], label


def product(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def late(i):
    return (i is None, i or 0)


def brute_top(rows):
    usable = [w for w in map(whole, rows) if w]
    out = []
    for n, (i, e, _) in enumerate(usable):
        if i is None or i % 50:
            continue
        others = sorted(((-product(e, f), late(j), j) for m, (j, f, _) in enumerate(usable) if m != n))[:5]
        out += [(i, r, j, -s) for r, (s, _, j) in enumerate(others, 1)]
    return sorted(out, key=repr)


def brute_negatives(rows):
    usable = [w for w in map(whole, rows) if w and w[2] is not None]
    usable = [(i, e, (y + 1) % 10 if i is not None and i % 7 == 0 else y) for i, e, y in usable]
    out = []
    for n, (i, e, y) in enumerate(usable):
        if i is None or i % 100:
            continue
        scored = sorted(((-product(e, f), late(j), j, z) for m, (j, f, z) in enumerate(usable) if m != n))
        for p, _, j, _ in [s for s in scored if s[3] == y][:5]:
            fits = [s for s in scored if s[3] != y and 30 * -p <= 100 * -s[0] <= 90 * -p][:10]
            out += [(i, j, r, s[2], -p, -s[0]) for r, s in enumerate(fits, 1)]
    return sorted(out, key=repr)


def points(seed, n=240, dims=6, spread=1.0):
    draw = random.Random(seed)
    middles = [[draw.gauss(0, 1) for _ in range(dims)] for _ in range(7)]
    rows = []
    for i in range(n):
        m = draw.choice(middles)
        scale = math.exp(draw.gauss(0, spread))
        rows.append((i * 10, [scale * (x + draw.gauss(0, 0.2)) for x in m], draw.randrange(3)))
    return rows


def odd_rows():
    rows = points(3, 60)
    rows += [rows[0], rows[0], rows[10], (None, rows[1][1], 1), (None, rows[1][1], 2), (None, None, 1), (50, None, 1), (150, [1.0, None, 2.0], 1), (200, [float("nan")] * 6, 0)]
    rows += [(250, [float("inf")] + [0.0] * 5, 1), (350, [], 1), (400, [0.0] * 6, 2), (450, [1.0, 2.0], 1), (500, rows[2][1], None), (700, rows[2][1], 0), (50, rows[3][1], 1)]
    return rows + [(1000 + i, rows[4][1], 1) for i in range(40)]


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def small(monkeypatch):
    """Blocks so small that a few hundred rows make many of them."""
    monkeypatch.setattr(topk, "BUCKET_ROWS", 16)
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    monkeypatch.setattr(topk, "SEED_ROWS", 8)
    monkeypatch.setattr(negatives, "SAMPLE_ROWS", 48)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 16)
    monkeypatch.setattr(negatives, "ANCHOR_ROWS", 3)
    monkeypatch.setattr(negatives, "LEAF_ROWS", 4)


@pytest.mark.parametrize("rows", [points(1), points(2, spread=0.0), odd_rows()], ids=["lengths", "one length", "odd"])
def test_top_products_in_small_buckets(spark, small, rows):
    assert found(topk.op11_norm_buckets(spark.createDataFrame(rows, SCHEMA))) == brute_top(rows)


@pytest.mark.parametrize("rows", [points(4), points(5, spread=0.0), odd_rows()], ids=["lengths", "one length", "odd"])
def test_negatives_in_small_blocks(spark, small, rows):
    assert found(negatives.op13_dual_tree(spark.createDataFrame(rows, SCHEMA))) == brute_negatives(rows)


def test_other_columns_and_no_rows(spark):
    rows = odd_rows()
    more = spark.createDataFrame([(*r, *[None] * 11) for r in rows], SCHEMA + CLASH)
    assert found(topk.op11_norm_buckets(more)) == brute_top(rows)
    assert found(negatives.op13_dual_tree(more)) == brute_negatives(rows)
    none = spark.createDataFrame([], SCHEMA)
    assert topk.op11_norm_buckets(none).collect() == [] and negatives.op13_dual_tree(none).collect() == []


def test_huge_components_are_exact(spark):
    rows = [(i * 50, [float(2**18 + i), float(2**20 - i * i)], i % 2) for i in range(12)] + [(7, [2.0**19, 2.0**20], 1)]
    assert found(topk.op11_norm_buckets(spark.createDataFrame(rows, SCHEMA))) == brute_top(rows)
    over = [(0, [1e30, 1.0], 0), (50, [1e30, 2.0], 0), (3, [-1e30, 0.0], 0)]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.op11_norm_buckets(spark.createDataFrame(over, SCHEMA)).collect()}
    assert got[0, 1] == (50, 2**63 - 1) and got[0, 2] == (3, -(2**63))


@pytest.mark.parametrize("cosine", [0.8, 0.9, 0.99, 1.0])
def test_coordinates_prune_and_lose_nothing(cosine):
    draw = np.random.default_rng(1)
    units = draw.normal(size=(2000, 5))
    units /= np.linalg.norm(units, axis=1)[:, None]
    for q in units[:20]:
        rows = topk.by_coordinate(q, units, {}, cosine)
        assert set(np.flatnonzero(units @ q >= cosine)) <= set(rows)
        assert len(rows) < 1000


def test_local_cosine_prunes_by_length():
    got = topk.local_cosine(np.array([10.0, 10.0, -3.0]), np.array([2.0, 10.0, 1.0]), 4.0)
    assert got[0] > 1 and got[1] == 0.25 and got[2] == -np.inf


def test_node_pairs_hold_every_product():
    draw = np.random.default_rng(2)
    a, b = draw.normal(size=(300, 4)), draw.normal(size=(500, 4)) + 1
    left, right = negatives.lower_tree(a, 16), negatives.lower_tree(b, 32)
    score = a @ b.T
    met = np.zeros_like(score, dtype=bool)
    low = np.full(len(left.start), 6.0)
    for x, y in negatives.walk(left, right, low, np.full(len(left.start), 9.0)):
        met[np.ix_(left.order[left.start[x] : left.end[x]], right.order[right.start[y] : right.end[y]])] = True
    assert met[(score >= 6) & (score <= 9)].all() and not met.all()


def test_a_group_of_anchors_skips_cells(spark, small):
    """Far clusters: cells that no anchor of a group can use get no pair."""
    draw = random.Random(9)
    rows = [(i, [10 * (i % 4 == c) + draw.random() / 10 for c in range(4)], i % 2) for i in range(400)]
    forest = negatives.Forest(vectors.integer_vectors(spark.createDataFrame(rows, SCHEMA).selectExpr("vec_id", "embedding", "cast(label as long) label"), "embedding", "label"))
    assert len(forest.balls) > 4
    groups = spark.createDataFrame([(forest.balls[0][0], 0, forest.balls[0][1], 10**6, 10**9)], "cell int, part int, radius double, least long, most long")
    kept = negatives._pairs(groups, forest.upper, [(c, r, 1) for c, r, _ in forest.balls]).count()
    assert 0 < kept < len(forest.balls)


def test_product_types():
    small, large = np.full((2, 4), 255), np.full((2, 4), 1 << 40)
    assert vectors.product_type(small, small) is np.float32 and vectors.product_type(large, large) is object
    assert vectors.products(large.astype(object), large.astype(object))[0, 0] == 2**63 - 1
    assert vectors.matrix(pa.chunked_array([pa.array([[1, 2], [3, 4]])])).tolist() == [[1, 2], [3, 4]]
