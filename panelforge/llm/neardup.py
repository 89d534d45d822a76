"""Exact n-gram Jaccard join by T-occurrence search, and its connected components.

1. Every text becomes its set of shingle fingerprints.  Texts with equal sets are one class.
2. Fingerprints are dealt to buckets, which hold the inverted lists.  Entries of lists with at
   least two classes go back to their classes.  A class that shares fewer than three quarters of
   its shingles with others can't have a link and is done.  The few lists that outweigh a bucket
   are known before and never brought together: their entries go straight back.
3. Of the rest, classes with a common min-hash are joined locally by DivideSkip: the short lists
   of a query are merged, its T-1 longest ones only probed, by binary search, for what the merge
   found.  Links found so give components early, so that groups of copies need no pairs.
4. For all pairs still in different components the lists of the rarest shingles (those that
   DivideSkip merges) are merged across the cluster; candidates pass an exact bound on the overlap
   by parity bitmaps and are verified by probing.  Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, saved, small_batches
from .components import connected, merged
from .shingles import mixed, set_key, shingle_sets

#: Members of a min-hash group that are joined in one go; larger groups are salted.
GROUP = 400
#: Entries of an inverted list that are compared with one another in one go.
BLOCK = 512
BITS = 1024
#: Shingles a bucket holds on average (16 MB of fingerprints), and the least number of buckets.
BUCKET_SHINGLES, LEAST_BUCKETS = 2_000_000, 8
#: A shingle is hot if it has over one in so many of all entries, so hot ones are at most so many.
HOT_SHARE = 100_000
#: Text that is hashed before its entries are dealt out; a shingle in so many of its sets may be hot.
FLUSH_BYTES, HOT_SEEN = 2_000_000, 8
#: Parts into which the classes of a component are dealt when its least doc_id is looked up.
PARTS = 16
#: Pairs of 16 bytes whose keys are broadcast.
BROADCAST_PAIRS = 1_000_000
SALTS = np.array([0x2545F4914F6CDD1D, 0x9FB21C651E98DF25], np.uint64)


def least_overlap(n: int) -> int:
    """Common shingles that a set of n needs at least: Jaccard >= 3/4 with any set."""
    return (3 * n + 3) // 4


def linked(common: int, n: int, m: int) -> bool:
    return 100 * common >= 75 * (n + m - common)


# ---------------------------------------------------------------- sets and classes


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of the text), n_shingles, key (the class; null for a text without words) of each row, and frequent.

    ``frequent`` holds shingles that many sets near this row have, with their number of sets: what
    hot shingles are found by.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _flushes(batches, 1, FLUSH_BYTES):
            sets = shingle_sets(batch.column(1).to_pylist())
            keys = [set_key(s) if len(s) else None for s in sets]
            own = list({k: s for k, s in zip(keys, sets, strict=True) if k is not None}.values())
            frequent: list[list[dict] | None] = [None] * batch.num_rows
            if own:
                tokens, seen = np.unique(np.concatenate(own), return_counts=True)
                often = seen >= HOT_SEEN
                if often.any():
                    frequent[0] = [{"token": t, "seen": c} for t, c in zip(tokens[often].view(np.int64).tolist(), seen[often].tolist(), strict=True)]
            kind = pa.list_(pa.struct([("token", pa.int64()), ("seen", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.int64()), pa.array(frequent, kind)],
                ["doc_id", "row", "n_shingles", "key", "frequent"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    spec = f"doc_id {kind}, row bigint, n_shingles bigint, key bigint, frequent array<struct<token: bigint, seen: bigint>>"
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("row")).mapInArrow(scan, spec)


def _flushes(batches: Iterator[pa.RecordBatch], text: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batches joined or cut to about ``most`` bytes of the binary column ``text``; a longer text stands alone."""
    held: list[pa.RecordBatch] = []
    filled = 0
    for batch in batches:
        column = batch.column(text)
        sizes = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]) if len(column) else np.zeros(0, int)
        at = 0
        for i, size in enumerate(sizes.tolist()):
            if filled and filled + size > most:
                held.append(batch.slice(at, i - at))
                yield pa.concat_batches([b for b in held if b.num_rows])
                held, filled, at = [], 0, i
            filled += size
        held.append(batch.slice(at))
    held = [b for b in held if b.num_rows]
    if held:
        yield pa.concat_batches(held)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    change = np.zeros(len(columns[0]), bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def _entries(docs: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """Inverted-list entries in packed rows: for each bucket, runs of (class, set size, count) over fingerprints.

    Entries of the sorted ``hot`` shingles are in rows of their own, dealt by class and not by shingle.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _flushes(batches, 0, FLUSH_BYTES):
            seen: dict[int, np.ndarray] = {}
            for s in shingle_sets(batch.column(0).to_pylist()):
                if len(s):
                    seen.setdefault(set_key(s), s)
            if not seen:
                continue
            keys, sizes = np.array(list(seen), np.int64), np.array([len(s) for s in seen.values()], np.int32)
            hashes = np.concatenate(list(seen.values()))
            owner = np.repeat(np.arange(len(keys), dtype=np.int32), sizes)
            is_hot = np.isin(hashes, hot) if len(hot) else np.zeros(len(hashes), bool)
            rows = []
            for apart in (False, True):
                chosen = is_hot == apart
                if chosen.any():
                    token, who = hashes[chosen], owner[chosen]
                    bucket = _home(keys, buckets)[who] if apart else ((token >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                    for b, r, i in _dealt(bucket, who, buckets):
                        rows.append((b, keys[r.who].tobytes(), sizes[r.who].tobytes(), r.counts.tobytes(), token[i].tobytes(), apart))
            yield _packed(rows, ["bucket", "keys", "sizes", "counts", "tokens", "hot"])

    spec = "bucket int, keys binary, sizes binary, counts binary, tokens binary, hot boolean"
    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(scan, spec)


class _Run(NamedTuple):
    who: np.ndarray
    counts: np.ndarray


def _home(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys.view(np.uint64) % np.uint64(buckets)).astype(np.int64)


def _dealt(bucket: np.ndarray, owner: np.ndarray, buckets: int) -> Iterator[tuple[int, _Run, np.ndarray]]:
    """For each bucket that has entries: its owners with their counts, and the places of its entries."""
    order = np.lexsort((owner, bucket))
    bucket, owner = bucket[order], owner[order]
    starts = _runs(bucket, owner)
    counts = np.diff(np.append(starts, len(order))).astype(np.int32)
    run_bucket, run_owner = bucket[starts], owner[starts]
    firsts = np.append(_runs(run_bucket), len(starts))
    for r, q in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        yield int(run_bucket[r]), _Run(run_owner[r:q], counts[r:q]), order[starts[r] : starts[r] + counts[r:q].sum()]


def _packed(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    kinds = {"bucket": pa.int32(), "hot": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.binary())) for c, n in zip(columns, names, strict=True)], names)


def _unpacked(columns: list[pa.Array], kinds: list[type]) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(c.to_pylist()), k) for c, k in zip(columns, kinds, strict=True)]


def _shared(entries: DataFrame, buckets: int) -> DataFrame:
    """From the whole lists of each bucket, the entries of lists with two classes or more, packed by class.

    Entries of hot shingles come with the largest length of a list.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches([b for b in batches if b.num_rows] or [_packed([], ["bucket", "keys", "sizes", "counts", "tokens", "hot"])])
        for apart in (False, True):
            part = whole.filter(pc.equal(whole["hot"], apart))
            if not part.num_rows:
                continue
            keys, sizes, counts, token = _unpacked([part[c] for c in ("keys", "sizes", "counts", "tokens")], [np.int64, np.int32, np.int32, np.uint64])
            names, which = np.unique(keys, return_inverse=True)
            size_of = np.zeros(len(names), np.int32)
            size_of[which] = sizes
            owner = np.repeat(which.astype(np.int32), counts)
            order = np.lexsort((owner, token))
            token, owner = token[order], owner[order]
            keep = _runs(token, owner)
            token, owner = token[keep], owner[keep]
            starts = _runs(token)
            df = np.diff(np.append(starts, len(token)))
            df = np.repeat(df, df).astype(np.int32)
            if apart:
                df[:] = np.iinfo(np.int32).max
            keep = df >= 2
            token, owner, df = token[keep].view(np.int64), owner[keep], df[keep]
            rows = []
            for b, r, i in _dealt(_home(names, buckets)[owner], owner, buckets):
                rows.append((b, names[r.who].tobytes(), size_of[r.who].tobytes(), r.counts.tobytes(), token[i].tobytes(), df[i].tobytes()))
            yield _packed(rows, ["bucket", "keys", "sizes", "counts", "tokens", "dfs"])

    spec = "bucket int, keys binary, sizes binary, counts binary, tokens binary, dfs binary"
    return entries.repartitionById(buckets, "bucket").mapInArrow(merge, spec)


def _survivors(shared: DataFrame, buckets: int) -> DataFrame:
    """key, n, p, tokens, bits, h0, h1 of the classes that share enough shingles to have a link.

    ``tokens`` are the shared shingles, rarest first; the first p are those that DivideSkip merges:
    of two linked sets each has at least one common shingle among them.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches([b for b in batches if b.num_rows] or [_packed([], ["bucket", "keys", "sizes", "counts", "tokens", "dfs"])])
        if not whole.num_rows:
            return
        keys, sizes, counts, tokens, dfs = _unpacked(whole.columns[1:], [np.int64, np.int32, np.int32, np.int64, np.int32])
        names, which = np.unique(keys, return_inverse=True)
        size_of = np.zeros(len(names), np.int64)
        size_of[which] = sizes
        total = np.bincount(which, weights=counts, minlength=len(names)).astype(np.int64)
        good = total >= (3 * size_of + 3) // 4
        owner = np.repeat(which, counts)
        keep = good[owner]
        owner, tokens, dfs = owner[keep], tokens[keep], dfs[keep]
        order = np.lexsort((tokens, dfs, owner))
        owner, tokens = owner[order], tokens[order]
        starts = np.append(_runs(owner), len(owner)).tolist() if len(owner) else [0]
        for at in range(0, len(starts) - 1, 1024):
            rows = []
            for a, b in zip(starts[at : at + 1024], starts[at + 1 : at + 1025], strict=False):
                c = owner[a]
                own = tokens[a:b]
                n = int(size_of[c])
                rows.append((int(names[c]), n, b - a - least_overlap(n) + 1, own, parity(own), *min_hashes(own)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.int64()))],
                ["key", "n", "p", "tokens", "bits", "h0", "h1"],
            )

    spec = "key bigint, n int, p int, tokens array<bigint>, bits binary, h0 bigint, h1 bigint"
    return shared.repartitionById(buckets, "bucket").mapInArrow(gather, spec)


def parity(tokens: np.ndarray) -> bytes:
    """Whether an odd number of tokens falls on each of BITS places.

    Two sets differ in at least as many tokens as their parities differ in places.
    """
    places = (mixed(tokens.view(np.uint64)) % np.uint64(BITS)).astype(np.int64)
    return np.packbits(np.bincount(places, minlength=BITS) & 1).tobytes()


def min_hashes(tokens: np.ndarray) -> list[int]:
    return [int(mixed(tokens.view(np.uint64) ^ salt).min().view(np.int64)) for salt in SALTS]


# ---------------------------------------------------------------- local joins


class _Union:
    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i


def divide_skip(sizes: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links among the given sets.

    Sets are queried in order of size against those before.  T is the overlap that a query needs
    with any set; its T-1 longest lists are set aside and the others merged, and what they hold
    is probed by binary search in the whole set, unless it is in the query's component already.
    """
    order = np.argsort(sizes, kind="stable")
    ordered = [np.sort(sets[i]) for i in order]
    n = sizes[order]
    tokens = np.concatenate(ordered)
    owner = np.repeat(np.arange(len(ordered)), [len(s) for s in ordered])
    by = np.lexsort((owner, tokens))
    tokens, owner = tokens[by], owner[by]
    starts = _runs(tokens)
    heads, ends = tokens[starts], np.append(starts, len(tokens))
    union = _Union(len(ordered))
    links = []
    for q in range(1, len(ordered)):
        own = ordered[q]
        lists = np.searchsorted(heads, own)
        lengths = ends[lists + 1] - ends[lists]
        short = len(own) - least_overlap(int(n[q])) + 1
        if short <= 0:
            continue
        chosen = lists[np.argpartition(lengths, short - 1)[:short]]
        merged = np.concatenate([owner[ends[x] : ends[x + 1]] for x in chosen])
        merged = np.bincount(merged[merged < q], minlength=q)
        candidates = np.flatnonzero((merged > 0) & (4 * n[:q] >= 3 * n[q]))
        candidates = candidates[np.argsort(-merged[candidates], kind="stable")]
        for c in candidates.tolist():
            a, b = union.root(c), union.root(q)
            if a != b and linked(_probe(ordered[c], own), int(n[c]), int(n[q])):
                union.up[max(a, b)] = min(a, b)
                links.append((int(order[c]), int(order[q])))
    return links


def _probe(sorted_set: np.ndarray, tokens: np.ndarray) -> int:
    at = np.searchsorted(sorted_set, tokens)
    at[at == len(sorted_set)] = 0
    return int((sorted_set[at] == tokens).sum())


def _lists(column: pa.Array) -> list[np.ndarray]:
    offsets, values = column.offsets.to_numpy(), column.flatten().to_numpy(zero_copy_only=False)
    base = offsets[0]
    return [values[a - base : b - base] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _partition_of(df: DataFrame, by: str, partitions: int) -> DataFrame:
    return df.repartitionById(partitions, F.pmod(F.xxhash64(by), F.lit(partitions)).cast("int"))


def _group_links(members: DataFrame, facts: DataFrame, partitions: int) -> DataFrame:
    """Links (a, b: ids) inside the min-hash groups of ``members`` (mh, key, id); large groups are salted.

    Only the keys of groups of two or more get their n and tokens, from ``facts``.
    """
    counts = members.groupBy("mh").count().where(F.col("count") > 1)
    salted = members.join(counts, "mh").withColumn("salts", F.ceil(F.col("count") / GROUP).cast("long"))
    gid = F.xxhash64("mh", F.pmod(F.xxhash64("key"), F.col("salts")))
    salted = salted.groupBy("key", "id").agg(F.collect_set(gid).alias("gids"))  # one or two of each class
    dealt = salted.join(facts.select("key", "n", "tokens"), "key").select(F.explode("gids").alias("gid"), "id", "n", "tokens")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, list[tuple[int, int, np.ndarray]]] = {}
        for batch in batches:
            for g, k, n, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), _lists(batch.column(3)), strict=True):
                groups.setdefault(g, []).append((k, n, s))
        links = []
        for group in groups.values():
            if len(group) > 1:
                links += [(group[i][0], group[j][0]) for i, j in divide_skip(np.array([x[1] for x in group]), [x[2] for x in group])]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    return _partition_of(dealt, "gid", partitions).mapInArrow(join, "a bigint, b bigint")


# ---------------------------------------------------------------- lists across the cluster


def _lists_of_several(survivors: DataFrame, labels: DataFrame) -> DataFrame:
    """token, key of the merged lists that have classes of different components."""
    prefixes = survivors.select("key", F.slice("tokens", F.lit(1), F.col("p")).alias("own"))
    entries = prefixes.join(labels.withColumnRenamed("node", "key"), "key").select("key", "comp", F.explode("own").alias("token"))
    several = entries.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("token")
    return entries.join(several, "token").select("token", "key")


def _mixed_lists(lists: DataFrame, survivors: DataFrame, labels: DataFrame, best_only: bool, partitions: int) -> DataFrame:
    """Candidate pairs (a, b, and their components x, y) from ``lists`` (token, key), of classes in different components.

    A list is cut into blocks of its entries.  Entries outside the list's largest component are
    also queries to all its blocks, so every pair of different components meets.  With
    ``best_only`` a query gives one candidate for each block and component, else all.
    """
    entries = lists.join(labels.withColumnRenamed("node", "key"), "key")
    per = entries.groupBy("token", "comp").agg(F.count("*").alias("c"))
    mixed_ones = per.groupBy("token").agg(F.sum("c").alias("f"), F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("k")).where("k > 1")
    chosen = entries.join(mixed_ones.select("token", "f", F.col("top.comp").alias("home")), "token").withColumn("blocks", F.ceil(F.col("f") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    place = F.when(F.col("comp") == F.col("home"), F.array(own)).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = chosen.withColumn("own", own).withColumn("at", F.explode(place)).select(
        F.xxhash64("token", "at").alias("gid"), "key", "comp", (F.col("at") == F.col("own")).alias("resident"), (F.col("comp") != F.col("home")).alias("query")
    )
    facts = survivors.select("key", "n", F.size("tokens").alias("s"), "bits")
    dealt = dealt.join(facts, "key").select("gid", "key", "comp", "n", "bits", "resident", "query", "s")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [[] for _ in range(8)]
        for batch in batches:
            for i in range(8):
                columns[i] += batch.column(i).to_pylist()
        found: set[tuple[int, int, int, int]] = set()
        if columns[0]:
            gid, key, comp, n = (np.array(c, np.int64) for c in columns[:4])
            bits = np.frombuffer(b"".join(columns[4]), np.uint64).reshape(len(gid), -1)
            resident, query, shared = np.array(columns[5], bool), np.array(columns[6], bool), np.array(columns[7], np.int64)
            order = np.argsort(gid, kind="stable")
            starts = np.append(_runs(gid[order]), len(gid))
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                rows = order[a:b]
                inside, asks = rows[resident[rows]], rows[query[rows]]
                for q in asks:
                    able = (comp[inside] != comp[q]) & (4 * n[inside] >= 3 * n[q]) & (4 * n[q] >= 3 * n[inside])
                    near = inside[able]
                    if not len(near):
                        continue
                    apart = np.bitwise_count(bits[near] ^ bits[q]).sum(axis=1, dtype=np.int64)
                    # the overlap is at most (shared[x] + shared[y] - apart) / 2
                    ok = 7 * (shared[near] + shared[q] - apart) >= 6 * (n[near] + n[q])
                    near, apart = near[ok], apart[ok]
                    if best_only:
                        by = np.lexsort((apart, comp[near]))
                        near = near[by[_runs(comp[near][by])]] if len(near) else near
                    me = (int(key[q]), int(comp[q]))
                    for other in zip(key[near].tolist(), comp[near].tolist(), strict=True):
                        (a, x), (b, y) = sorted((me, other))
                        found.add((a, b, x, y))
        pairs = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in range(4)], ["a", "b", "x", "y"])

    return _partition_of(dealt, "gid", partitions).mapInArrow(search, "a bigint, b bigint, x bigint, y bigint")


def _verified(pairs: DataFrame, survivors: DataFrame, few: bool = False) -> DataFrame:
    """Of the candidate pairs (a, b and any others) those with enough common shingles, found by probing one set for the other's.

    ``few`` pairs (at most ``BROADCAST_PAIRS``) first pick their sets from the survivors by broadcast.
    """
    if few:
        keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        survivors = survivors.join(F.broadcast(keys), "key", "left_semi")
    x = survivors.select(F.col("key").alias("a"), F.col("n").alias("n"), F.col("tokens").alias("s"))
    y = survivors.select(F.col("key").alias("b"), F.col("n").alias("m"), F.col("tokens").alias("t"))
    k = len(pairs.columns)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(i).to_numpy() for i in (k, k + 1))
            ok = [linked(_probe(np.sort(s), t), int(p), int(q)) for s, t, p, q in zip(_lists(batch.column(k + 2)), _lists(batch.column(k + 3)), n, m, strict=True)]
            yield batch.select(range(k)).filter(pa.array(ok, pa.bool_()))

    return pairs.join(x, "a").join(y, "b").select(*pairs.columns, "n", "m", "s", "t").mapInArrow(probe, pairs.schema)


def _buckets(of_class: DataFrame) -> tuple[int, np.ndarray]:
    """How many buckets the shingles of ``classes`` need, and the hot shingles (sorted, at most ``HOT_SHARE``)."""
    total = of_class.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    seen = of_class.select(F.explode("frequent").alias("f")).groupBy(F.col("f.token").alias("token")).agg(F.sum("f.seen").alias("seen"))
    hot = seen.where(F.col("seen") > max(total / HOT_SHARE, BUCKET_SHINGLES / 100)).select("token").collect()
    return max(LEAST_BUCKETS, -(-total // BUCKET_SHINGLES)), np.sort(np.array([r[0] for r in hot], np.int64).view(np.uint64))


def class_components(docs: DataFrame, of_class: DataFrame) -> DataFrame:
    """node (class) and comp of the classes that may have a link to another class; ``of_class`` is ``classes(docs)``."""
    small_batches(docs.sparkSession)
    buckets, hot = _buckets(of_class)
    survivors = saved(_survivors(_shared(_entries(docs, buckets, hot), buckets), buckets))
    hashes = survivors.select(F.explode(F.array_distinct(F.array("h0", "h1"))).alias("mh"), "key")
    labels = merged(survivors.select(F.col("key").alias("node"), F.col("key").alias("comp")), _group_links(hashes.withColumn("id", F.col("key")), survivors, buckets))
    # what salting kept apart: one member of each component and large group meets the others
    large = hashes.groupBy("mh").count().where(F.col("count") > GROUP).select("mh")
    heads = hashes.join(large, "mh").join(labels.withColumnRenamed("node", "key"), "key").groupBy("mh", "comp").agg(F.min("key").alias("key"))
    heads = saved(heads.select("mh", "key", F.col("comp").alias("id")))
    if not heads.isEmpty():
        labels = merged(labels, _group_links(heads, survivors, buckets))
    lists = saved(_lists_of_several(survivors, labels))
    for best_only in (True, False):
        pairs = saved(_mixed_lists(lists, survivors, labels, best_only, buckets).distinct())
        n = pairs.count()
        if n:
            links = _verified(pairs, survivors, n <= BROADCAST_PAIRS).select(F.col("x").alias("a"), F.col("y").alias("b"))
            labels = merged(labels, links)
    return labels


def _headed(docs: DataFrame) -> DataFrame:
    """doc_id, row, n_shingles and head (absent, doc_id, row) of each row of ``docs``.

    The head of a component is its row with the least doc_id, then the least hash of the text; one
    without a doc_id only where all are.  A row without words has no head.
    """
    small_batches(docs.sparkSession)
    of_class = saved(classes(docs))
    labels = class_components(docs, of_class)
    place = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "row")
    least = of_class.where("key IS NOT NULL").groupBy("key").agg(F.min(place).alias("least"))
    least = least.join(labels.withColumnRenamed("node", "key"), "key", "left").select("key", "least", F.coalesce("comp", "key").alias("comp"))
    per_comp = least.groupBy("comp").agg(F.min("least").alias("head"), F.count("*").alias("n")).withColumn("part", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > 1, PARTS - 1).otherwise(0))))
    part = F.when(F.col("key") == F.col("comp"), 0).otherwise(F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int"))
    named = least.withColumn("part", part).join(per_comp, ["comp", "part"]).select("key", "head")
    # most classes have one row; the join is by class, with the rows of large classes split
    return of_class.join(named, "key", "left").select("doc_id", "row", "n_shingles", "head")


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) of each row of ``docs``.

    Texts link at a Jaccard similarity of at least 0.75 of their distinct five-word shingles.  A
    null, empty or wordless text has no shingles and links with nothing.  Rows that repeat link
    with each other.  A row whose doc_id is null counts in links but is no smallest id; a
    component of such rows only has a null id.  Columns besides doc_id and text are not looked at;
    no rows, no rows.
    """
    component = F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id"))
    return _headed(docs).select("doc_id", "n_shingles", component.alias("component_id"))


def op6_divide_skip(docs: DataFrame) -> DataFrame:
    """``components`` of the documents, with its rules on nulls, empty texts, repeated rows and no rows."""
    return components(docs)


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without all but one row of each component: the one with the smallest doc_id.

    A row is known by its doc_id and a hash of its text, so rows that share a doc_id, or have none,
    are told apart; among equal ids the least hash stays, and a row without an id only where no
    other has one.  Of rows that repeat in doc_id and text one stays, no matter which.  Rows without
    words all stay.  All columns are kept; no rows, no rows.
    """
    found = saved(_headed(docs).where("n_shingles > 0").select("doc_id", "row", F.expr("doc_id <=> head.doc_id AND row = head.row").alias("stays")))
    gone = found.where("NOT stays").select("doc_id", "row").distinct()
    twice = found.where("stays").groupBy("doc_id", "row").count().where("count > 1").select("doc_id", "row")
    name = free_name(docs.columns, "_row")
    rows = docs.withColumn(name, F.xxhash64("text"))

    def among(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        other = right.select(F.col("doc_id").alias("_other_id"), F.col("row").alias("_other_row"))
        return left.join(other, left["doc_id"].eqNullSafe(other["_other_id"]) & (left[name] == other["_other_row"]), how)

    kept = among(rows, gone, "left_anti")
    if not twice.isEmpty():
        # map-side aggregation brings a hot repeated row down to one for each partition before the shuffle
        kept = among(kept, twice, "left_anti").unionByName(among(kept, twice, "left_semi").dropDuplicates(["doc_id", name]))
    return kept.drop(name)


ORACLE = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + least(len(ws), 5) - 1], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.seen = e.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, coalesce(min(r.seen), d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY d.doc_id
"""
