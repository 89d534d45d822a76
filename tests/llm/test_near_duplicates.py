import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelforge.llm import components, neardup
from panelforge.llm.shingles import set_key, shingle_sets


def plain_sets(text):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(table))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}


def brute_force(texts):
    sets = [plain_sets(t) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(sets[i]), root(i)) for i in range(len(texts))}


def edited(text, places, word):
    words = text.split(" ")
    for p in places:
        words[p] = f"{word}{p}"
    return " ".join(words)


def corpus(prose):
    base = prose(12)
    texts = [None, "", "  \n\t ", "one", "One", "two words", *base, base[0], base[0].upper(), base[1].replace(" ", "  \n")]
    for k, b in enumerate(base):
        texts += [edited(b, [30], f"x{k}"), edited(b, [5, 30], f"y{k}"), edited(b, [5, 15, 25, 35], f"z{k}")]
    chain = base[3].split(" ")
    for step in range(6):
        chain = [*chain[4:], *[f"n{step}{j}" for j in range(4)]]
        texts.append(" ".join(chain))
    return texts + [prose(1, 3000, 9)[0], prose(1, 3000, 9)[0] + " end", base[2] + " " + base[4]]


def test_components_equal_brute_force(docs, prose):
    texts = corpus(prose)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.components(docs(texts)).collect()}
    assert found == brute_force(texts)


def test_large_groups_and_blocks(docs, prose, monkeypatch):
    monkeypatch.setattr(neardup, "GROUP", 4)
    monkeypatch.setattr(neardup, "BLOCK", 3)
    base = prose(3, 80, 5)
    texts = [edited(base[k % 3], [10 + 7 * (k // 3 % 9)], f"w{k}") for k in range(60)] + prose(20, 40, 6)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.components(docs(texts)).collect()}
    assert found == brute_force(texts)


def test_buckets_hot_shingles_and_rounds_change_nothing(spark, docs, prose, monkeypatch):
    """Many buckets, hot lists that are never brought together, small flushes, other partitions and components in rounds give the same rows."""
    phrase = " ".join(f"common{i}" for i in range(40))
    texts = [f"{t} {phrase}" for t in prose(60, 10, 21)] + corpus(prose)
    want = brute_force(texts)
    of_class = neardup.classes(docs(texts))
    monkeypatch.setattr(neardup, "HOT_SEEN", 2)
    monkeypatch.setattr(neardup, "BUCKET_SHINGLES", 500)
    monkeypatch.setattr(neardup, "HOT_SHARE", 500)
    buckets, hot = neardup._buckets(of_class)
    assert buckets > 8 and 20 < len(hot) <= 500
    monkeypatch.setattr(neardup, "FLUSH_BYTES", 4000)
    monkeypatch.setattr(components, "LOCAL_LINKS", 0)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("4", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.components(docs(texts)).collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_components_in_one_task_and_in_rounds(spark):
    import random

    draw = random.Random(2)
    pairs = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    links = spark.createDataFrame(pairs, "a long, b long")
    one, many = ({(r.node, r.comp) for r in components.connected(links, local).collect()} for local in (10**6, 0))
    assert one == many and (1060, 1000) in one
    assert components.connected(links.where("a < 0")).count() == 0


def test_lists_alone_lose_no_link(docs, prose):
    """The merged lists find every link also where no group was joined before."""
    from panelforge.llm.common import saved

    texts = [edited(b, [p], f"q{p}") for b in prose(6, 120, 8) for p in (8, 20, 33)]
    d = docs(texts)
    survivors = saved(neardup._survivors(neardup._shared(neardup._entries(d, 4, neardup.np.zeros(0, neardup.np.uint64)), 4), 4))
    labels = survivors.select(F.col("key").alias("node"), F.col("key").alias("comp"))
    pairs = neardup._mixed_lists(neardup._lists_of_several(survivors, labels), survivors, labels, False, 4).distinct()
    links = {frozenset((r.a, r.b)) for r in neardup._verified(pairs, survivors).collect()}
    keys = [set_key(s) for s in shingle_sets([t.encode() for t in texts])]
    sets = [plain_sets(t) for t in texts]
    want = {frozenset((keys[i], keys[j])) for i in range(len(texts)) for j in range(i) if keys[i] != keys[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert links == want and want


def test_no_rows_repeated_rows_nulls_and_clashing_names(spark, docs, prose):
    assert neardup.components(docs([])).count() == 0
    t = prose(1)[0]
    twice = docs([t, None]).union(docs([t, None])).withColumn("key", F.lit("k")).withColumn("component_id", F.lit(9))
    rows = [tuple(r) for r in neardup.components(twice).orderBy("doc_id").collect()]
    assert rows == [(0, 56, 0), (0, 56, 0), (1, 0, 1), (1, 0, 1)]
    assert neardup.keep_one(docs([t, t + " ", "", ""])).orderBy("doc_id").select("doc_id").collect() == [(0,), (2,), (3,)]


def test_one_row_stays_of_null_and_repeated_ids(spark, prose):
    a, b, c, d, e = prose(5, 40, 77)
    rows = [
        (None, a, "x"), (None, a, "x"), (None, edited(a, [20], "q"), "y"),  # a component without ids
        (7, b, "x"), (7, b, "y"), (9, b, "x"), (None, b, "x"),  # a repeated head
        (5, c, "x"), (5, edited(d, [20], "q"), "x"), (3, d, "x"),  # one id, two texts: one of them is a copy
        (2, None, "x"), (2, None, "x"), (None, "", "x"), (1, e, "x"),
    ]
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, source string, _row int, head int, row int")
    kept = neardup.keep_one(table)
    assert kept.columns == table.columns
    got = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    lone = {t for i, t in got if i == 0 and t}
    assert len(lone) == 1 and lone < {a, edited(a, [20], "q")}
    assert [x for x in got if x[0] or not x[1]] == sorted([(0, ""), (1, e), (2, ""), (2, ""), (3, d), (5, c), (7, b)])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1, max_size=14), min_size=2, max_size=12))
def test_divide_skip_spans_the_components(sets):
    arrays = [np.array(sorted(s), np.int64) for s in sets]
    links = neardup.divide_skip(np.array([len(s) for s in sets]), arrays)
    up = list(range(len(sets)))
    root = lambda i: i if up[i] == i else root(up[i])
    for a, b in links:
        assert neardup.linked(len(sets[a] & sets[b]), len(sets[a]), len(sets[b]))
        up[root(a)] = root(b)
    for i in range(len(sets)):
        for j in range(i):
            if neardup.linked(len(sets[i] & sets[j]), len(sets[i]), len(sets[j])):
                assert root(i) == root(j)
