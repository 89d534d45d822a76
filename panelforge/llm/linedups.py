"""Line-level dedup by a suffix array over line IDs.

Texts become sequences of line IDs (128 bits); equal texts are one sequence, that of the smallest
doc_id.  Lines that occur once can't repeat, so the suffixes are those that begin at other lines.
Distributed prefix doubling sorts them: suffixes of equal rank are told apart by the rank of what
follows 1, 2, 4 ... lines later, until every rank is one suffix.  A round is a join and a range
sort; ranks are places in the suffix array, numbered within sorted partitions from one summary row
for each.  Where a suffix and its predecessor have the same line before them, their common prefix
is one line shorter than that of the suffix before; the others are compared line by line.  The
LCP intervals of a depth are the sets of equal runs of so many lines: in each, all runs but the
first in the corpus are later copies, whose lines go.

Every repeated run of at least ``run`` lines, or over ``limit`` words, is covered by repeated runs of
at most ``run`` lines that are so themselves, so intervals of depths up to ``run`` decide all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, saved, small_batches

RUN = 3
WORDS = 50


def line_ids(text: bytes) -> list[bytes]:
    """A 128-bit fingerprint of each line (split at line feeds; no line is an empty text)."""
    import xxhash

    return [xxhash.xxh3_128_digest(x) for x in text.split(b"\n")] if text else []


def lengths_that_count(text: bytes, run: int, limit: int | None) -> list[int]:
    """For each line the lengths up to ``run`` of runs from there that have ``run`` lines or over ``limit`` words, as bits."""
    if not text:
        return []
    total = np.concatenate([[0], np.cumsum([len(x.split()) for x in text.split(b"\n")])])
    n = len(total) - 1
    bits = np.zeros(n, np.int64)
    for k in range(1, min(run, n) + 1):
        bits[: n - k + 1] |= ((total[k:] - total[:-k] > limit if limit is not None else np.zeros(n - k + 1, bool)) | (k == run)).astype(np.int64) << k
    return bits.tolist()


def text_key(text: Column) -> Column:
    return F.md5(F.encode(text, "UTF-8"))


def sequences(docs: DataFrame, run: int = RUN, limit: int | None = None) -> DataFrame:
    """One row for each distinct text with lines: t (in order of the smallest doc_id), first (that id), name, copies, ids, bits, whole."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            words = [len(t.split()) for t in texts]
            ids = [line_ids(t) for t in texts]
            whole = [len(x) >= run or limit is not None and w > limit for x, w in zip(ids, words, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.binary())), pa.array([lengths_that_count(t, run, limit) for t in texts], pa.list_(pa.int64())), pa.array(whole, pa.bool_())],
                ["doc_id", "name", "ids", "bits", "whole"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select("doc_id", text_key(F.col("text")).alias("name"), F.col("text").cast("binary").alias("text"))
    scanned = texts.mapInArrow(scan, f"doc_id {kind}, name string, ids array<binary>, bits array<bigint>, whole boolean")
    distinct = scanned.groupBy("name").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.first("ids").alias("ids"), F.first("bits").alias("bits"), F.first("whole").alias("whole"))
    return saved(distinct.orderBy("first", "name").select(F.monotonically_increasing_id().alias("t"), "first", "name", "copies", "ids", "bits", "whole"))


# ---------------------------------------------------------------- places in a sorted table


def _columns(batches: Iterator[pa.RecordBatch], names: list[str]) -> dict[str, np.ndarray]:
    held = [b for b in batches if b.num_rows]
    whole = pa.Table.from_batches(held) if held else None
    return {c: whole[c].to_numpy() if whole is not None else np.zeros(0, np.int64) for c in names}


def _starts(*columns: np.ndarray) -> np.ndarray:
    """For each row the place where its run of equal values begins."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


_KEY = ["g", "k0", "k1", "k2"]


def ranked(rows: DataFrame) -> DataFrame:
    """t, line, left, rank, alone of ``rows`` (g, k0, k1, k2, t, line, left), where g is the rank of the group to be split.

    Rows equal in g and k keep one rank: g and the number of rows of g that sort before.  A group
    may lie over many partitions: each gives one summary row, from which the driver tells what
    comes before and behind.
    """
    ordered = saved(rows.orderBy(*_KEY, "t", "line").withColumn("part", F.spark_partition_id()))

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _columns(batches, [*_KEY, "part"])
        if n := len(c["g"]):
            first, last = ([int(c[k][i]) for k in _KEY] for i in (0, -1))
            tails = [n - int(_starts(c["g"])[-1]), n - int(_starts(*[c[k] for k in _KEY])[-1])]
            yield pa.RecordBatch.from_arrays([pa.array([int(c["part"][0])]), pa.array([n]), pa.array([first]), pa.array([last]), pa.array([tails])], ["part", "n", "first", "last", "tails"])

    parts = ordered.mapInArrow(summary, "part bigint, n bigint, first array<bigint>, last array<bigint>, tails array<bigint>").orderBy("part").collect()
    before: dict[int, tuple[int, int, bool]] = {}
    in_group = in_key = 0
    for i, r in enumerate(parts):
        if not i or r["first"][0] != parts[i - 1]["last"][0]:
            in_group = 0
        if not i or r["first"] != parts[i - 1]["last"]:
            in_key = 0
        before[r["part"]] = (in_group, in_key, i + 1 < len(parts) and parts[i + 1]["first"] == r["last"])
        in_group = r["tails"][0] + (in_group if r["tails"][0] == r["n"] else 0)
        in_key = r["tails"][1] + (in_key if r["tails"][1] == r["n"] else 0)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _columns(batches, [*_KEY, "part", "t", "line", "left"])
        n = len(c["g"])
        if not n:
            return
        in_group, in_key, goes_on = before[int(c["part"][0])]
        group, key = _starts(c["g"]), _starts(*[c[k] for k in _KEY])
        rank = c["g"] + key - group + np.where(group == 0, in_group, 0) - np.where(key == 0, in_key, 0)
        size = np.bincount(key, minlength=n)[key]
        alone = (size == 1) & ~((key == 0) & (in_key > 0)) & ~((key == key[-1]) & goes_on)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (c["t"], c["line"], c["left"], rank, alone)], ["t", "line", "left", "rank", "alone"])

    return saved(ordered.mapInArrow(number, "t bigint, line bigint, left bigint, rank bigint, alone boolean"))


def suffix_array(texts: DataFrame) -> DataFrame:
    """rank (the place in the suffix array), t, line, left and reach of every suffix that begins at a line which occurs twice or more.

    ``left`` numbers the line before (-1: none, or one that occurs once); the suffix shares fewer than
    ``reach`` lines with any other.  Ends of texts and lines that occur once differ from all others.
    """
    lines = texts.select("t", F.posexplode("ids").alias("line", "id")).select("t", F.col("line").cast("long").alias("line"), "id")
    repeated = lines.groupBy("id").count().where(F.col("count") > 1).select("id")
    symbols = saved(repeated.orderBy("id").select("id", F.monotonically_increasing_id().alias("symbol")))
    known = saved(lines.join(symbols, "id").select("t", "line", "symbol"))
    before = known.select("t", (F.col("line") + 1).alias("line"), F.col("symbol").alias("left"))
    begun = known.join(before, ["t", "line"], "left").select("t", "line", F.coalesce("left", F.lit(-1)).alias("left"), "symbol")
    zero = F.lit(0).cast("long")
    current = ranked(begun.select(zero.alias("g"), zero.alias("k0"), F.col("symbol").alias("k1"), zero.alias("k2"), "t", "line", "left"))
    settled: list[DataFrame] = []
    step = 1
    while True:
        active = current.where(~F.col("alone"))
        settled.append(current.where("alone").select("rank", "t", "line", "left", F.lit(step).cast("long").alias("reach")))
        if active.isEmpty():
            break
        everything = active.select("t", "line", "rank")
        for done in settled:
            everything = everything.unionByName(done.select("t", "line", "rank"))
        behind = everything.select("t", (F.col("line") - step).alias("line"), F.col("rank").alias("next"))
        gone = F.col("next").isNull()
        rows = active.join(behind, ["t", "line"], "left").select(
            F.col("rank").alias("g"), gone.cast("long").alias("k0"), F.coalesce("next", "t").alias("k1"), F.when(gone, F.col("line")).otherwise(zero).alias("k2"), "t", "line", "left"
        )
        current = ranked(rows)
        step *= 2
    found = settled[0]
    for done in settled[1:]:
        found = found.unionByName(done)
    return saved(found)


def with_lcp(suffixes: DataFrame, texts: DataFrame) -> DataFrame:
    """``suffixes`` with pt, pline (the predecessor in the suffix array; null for the first), lcp (lines in common with it) and compared (not derived)."""
    ahead = suffixes.select((F.col("rank") + 1).alias("rank"), F.col("t").alias("pt"), F.col("line").alias("pline"), F.col("left").alias("pleft"), F.col("reach").alias("preach"))
    pairs = suffixes.join(ahead, "rank", "left").withColumn("compared", F.coalesce((F.col("left") < 0) | (F.col("left") != F.col("pleft")), F.lit(True)))
    pairs = saved(pairs.withColumn("within", F.coalesce(F.least("reach", "preach"), F.lit(0)).cast("int")))
    ids = texts.select("t", "ids")
    window = lambda line: F.slice("ids", F.col(line).cast("int") + 1, F.col("within"))
    mine = pairs.where(F.col("compared") & F.col("pt").isNotNull()).select("rank", "t", "line", "pt", "pline", "within").join(ids, "t").select("rank", "pt", "pline", "within", window("line").alias("a"))
    both = mine.join(ids.withColumnRenamed("t", "pt"), "pt").select("rank", "a", window("pline").alias("b"))
    differs = F.array_position(F.zip_with("a", "b", lambda x, y: x.eqNullSafe(y)), False)
    measured = both.select("rank", F.when(differs > 0, differs - 1).otherwise(F.size("a")).cast("long").alias("measured"))
    upto = Window.partitionBy("t").orderBy("line")
    last = F.last(F.when(F.col("compared"), F.struct(F.col("line").alias("at"), F.coalesce("measured", F.lit(0).cast("long")).alias("lcp"))), ignorenulls=True).over(upto)
    joined = pairs.join(measured, "rank", "left").withColumn("from", last)
    return joined.select("rank", "t", "line", "pt", "pline", (F.col("from.lcp") - F.col("line") + F.col("from.at")).alias("lcp"), "compared")


def intervals(suffixes: DataFrame, depth: int) -> DataFrame:
    """rank, t, line and heads of every suffix: heads[k-1] is where its LCP interval of depth k begins, for k up to ``depth``.

    Partitions sorted by rank each tell the last head in them; the rest is a running maximum.
    """
    ordered = saved(suffixes.select("rank", "t", "line", "lcp").orderBy("rank").withColumn("part", F.spark_partition_id()))

    def heads_in(c: dict[str, np.ndarray], k: int) -> np.ndarray:
        return np.maximum.accumulate(np.where(c["lcp"] < k, c["rank"], -1))

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _columns(batches, ["rank", "lcp", "part"])
        if len(c["rank"]):
            yield pa.RecordBatch.from_arrays([pa.array([int(c["part"][0])]), pa.array([[int(heads_in(c, k)[-1]) for k in range(1, depth + 1)]])], ["part", "heads"])

    before, running = {}, [-1] * depth
    for r in ordered.mapInArrow(summary, "part bigint, heads array<bigint>").orderBy("part").collect():
        before[r["part"]] = running
        running = [h if h >= 0 else old for h, old in zip(r["heads"], running, strict=True)]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _columns(batches, ["rank", "lcp", "part", "t", "line"])
        if not len(c["rank"]):
            return
        carried = before[int(c["part"][0])]
        heads = [np.where((h := heads_in(c, k)) < 0, carried[k - 1], h) for k in range(1, depth + 1)]
        flat = np.stack(heads, axis=1).reshape(-1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, depth), pa.int32()), pa.array(flat))
        yield pa.RecordBatch.from_arrays([pa.array(c["rank"]), pa.array(c["t"]), pa.array(c["line"]), lists], ["rank", "t", "line", "heads"])

    return ordered.mapInArrow(number, "rank bigint, t bigint, line bigint, heads array<bigint>")


def maximal_runs(docs: DataFrame) -> DataFrame:
    """Repeated runs of lines that can't be extended to either side, as the suffix array shows them.

    doc_id, line, length and of_doc_id, of_line (its neighbour in the suffix array): equal runs that
    have different lines before and behind.  Copies of a whole text count once.
    """
    small_batches(docs.sparkSession)
    texts = sequences(docs)
    found = with_lcp(suffix_array(texts), texts).where(F.col("compared") & (F.col("lcp") > 0))
    ids = texts.select("t", "first")
    return (
        found.join(ids.withColumnRenamed("first", "doc_id"), "t").join(ids.select(F.col("t").alias("pt"), F.col("first").alias("of_doc_id")), "pt")
        .select("doc_id", "line", F.col("lcp").alias("length"), "of_doc_id", F.col("pline").alias("of_line"))
    )


def later_copies(docs: DataFrame, run: int = RUN, limit: int | None = None) -> DataFrame:
    """name (of a text), first (its smallest doc_id), removed (lines of that document, ascending from 0) and whole.

    A line goes if it is in a run of at least ``run`` lines, or over ``limit`` words, that also begins
    earlier: in a document of a smaller doc_id, or before in the same one.  Other documents with the
    same text lose all lines if it is ``whole``, i.e. such a run itself, else none.  Texts of which
    nothing goes have no row.  Words are parted by ASCII white space.
    """
    small_batches(docs.sparkSession)
    texts = sequences(docs, run, limit)
    placed = intervals(with_lcp(suffix_array(texts), texts), run)
    counts = texts.select("t", F.posexplode("bits").alias("line", "lengths")).where("lengths > 0")
    placed = placed.join(counts.withColumn("line", F.col("line").cast("long")), ["t", "line"])
    depths = F.filter(F.sequence(F.lit(1), F.lit(run)), lambda k: F.expr("lengths").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), k)) > 0)
    runs = saved(placed.select("t", "line", "heads", F.explode(depths).alias("k")).select("t", "line", "k", F.element_at("heads", F.col("k")).alias("head")))
    first = runs.groupBy("k", "head").agg(F.min(F.struct("t", "line")).alias("earliest"), F.count("*").alias("n")).where("n > 1").select("k", "head", "earliest")
    later = runs.join(first, ["k", "head"]).where(F.struct("t", "line") != F.col("earliest"))
    spans = later.groupBy("t", "line").agg(F.max("k").alias("k"))
    gone = spans.groupBy("t").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("line").cast("int"), (F.col("line") + F.col("k") - 1).cast("int")))))).alias("removed"))
    whole = texts.select("t", "name", "first", (F.col("whole") & (F.col("copies") > 1)).alias("whole"))
    return whole.join(gone, "t", "left").where(F.col("whole") | F.col("removed").isNotNull()).select("name", "first", "removed", "whole")


def dedup_lines(docs: DataFrame, run: int = RUN, limit: int | None = None) -> DataFrame:
    """``docs`` with later copies of repeated line runs (also of fewer lines, if over ``limit`` words) deleted from text, and ``removed`` (their line numbers).

    A null text stays null, an empty one empty, a text all of whose lines go becomes empty; no row
    goes.  Rows alike in doc_id and text are treated alike; of other rows of one doc_id that of the
    smaller digest of the text is the earlier one.  A row without doc_id stays as it is.  No rows,
    no rows.  A column named removed already gives the new one an underscore.
    """
    name = free_name(docs.columns, "removed")
    found = later_copies(docs, run, limit).select(F.col("name").alias("_name"), F.col("first").alias("_first"), F.col("removed").alias("_removed"), F.col("whole").alias("_whole"))
    joined = docs.join(found, (text_key(docs["text"]) == F.col("_name")) & docs["doc_id"].isNotNull(), "left")
    lines = F.split("text", "\n", -1)
    every = F.sequence(F.lit(0), F.size(lines) - 1)
    none = F.array().cast("array<int>")
    removed = F.when(F.col("_first").isNull(), none).when(docs["doc_id"] == F.col("_first"), F.coalesce("_removed", none)).when(F.col("_whole"), every).otherwise(none)
    kept = F.transform(F.array_except(every, F.col(name)), lambda i: F.get(lines, i))
    joined = joined.select(*[docs[c] for c in docs.columns], removed.alias(name))
    return joined.select(*[F.when(F.size(name) > 0, F.array_join(kept, "\n")).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], name)


def _cleaned(docs: DataFrame, limit: int | None) -> DataFrame:
    cleaned = dedup_lines(docs.select("doc_id", "text"), limit=limit)
    return cleaned.select(
        "doc_id", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.transform("removed", lambda i: i.cast("string")), ",").alias("removed_lines"), F.col("text").alias("clean_text")
    )


def op7_repeated_lines(docs: DataFrame) -> DataFrame:
    """Lines removed, and the cleaned text, of each document; only runs of three lines, as in ORACLE."""
    return _cleaned(docs, None)


def op7_repeated_passages(docs: DataFrame) -> DataFrame:
    """As op7_repeated_lines, also with runs of one or two lines of over 50 words."""
    return _cleaned(docs, WORDS)


ORACLE = f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (
  SELECT doc_id, i, array_to_string(ls[i : i + {RUN - 1}], chr(10)) AS g
  FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls) - {RUN - 1})) AS i FROM d WHERE text <> '' AND len(ls) >= {RUN})),
l AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM w) WHERE r > 1),
c AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(generate_series(i, i + {RUN - 1})) AS p FROM l)),
k AS (SELECT doc_id, count(*) AS n, string_agg((p - 1)::VARCHAR, ',' ORDER BY p) AS ps, list(p) AS gone FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.n, 0)::BIGINT AS n_removed, coalesce(k.ps, '') AS removed_lines,
       CASE WHEN k.n IS NULL THEN d.text ELSE array_to_string([ls[i] FOR i IN generate_series(1, len(ls)) IF NOT list_contains(gone, i)], chr(10)) END AS clean_text
FROM d LEFT JOIN k USING (doc_id)
"""
