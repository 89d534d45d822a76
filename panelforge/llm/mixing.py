"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws the key u ** (1 / quality); within its source the keys, largest first,
are prefix-summed to what is left of the source's token budget after its complete epochs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved

BUCKETS = 4096
JUNK = "%$&#*!|~^<>{}[]="
MAX_BROADCAST_SOURCES = 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \x09-\x0D]+")), F.lit(0)).cast("long")


def text_quality(text: Column) -> Column:
    """1 for text without symbols, 0.1 where a quarter of the characters are symbols."""
    length = F.coalesce(F.length(text), F.lit(0))
    junk = length - F.coalesce(F.length(F.translate(text, JUNK, "")), F.lit(0))
    return F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(4.0) * junk.cast("double") / F.greatest(length, F.lit(1)).cast("double"))


def unit_draw(key: Column) -> Column:
    """A number in (0, 1] that depends on the key alone, so reruns agree."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 1.0) / F.lit(float(2**52))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """One row a source: source_size and target.

    Sources in order of code points, null last, take the weights in turn and share all words;
    no target passes ``most`` times its source's size.  The excess goes to the others by weight:
    with sources in order of cap / weight, the first k are at their caps where k is the least
    number for which the share of the rest fits under the next cap.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn % len(weights) + 1).cast("int")).cast("long")
    order = Window.orderBy(F.col("source_size") * most / F.col("weight"), F.col("turn"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    capped = sizes.withColumn("turn", turn).withColumn("weight", weight)
    stepped = capped.select(
        "source", "source_size", "weight", (F.col("source_size") * most).alias("cap"),
        F.sum("source_size").over(everything).alias("total"),
        (F.sum("source_size").over(everything) - F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0))).alias("left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"),
        F.row_number().over(order).alias("nth"),
    )
    fits = F.col("left") * F.col("weight") <= F.col("cap") * F.col("weight_left")
    first = F.min(F.when(fits, F.struct("nth", "left", "weight_left"))).over(everything)
    chosen = stepped.withColumn("first", first)
    share = (F.col("first.left") * F.col("weight")).cast("double") / F.col("first.weight_left").cast("double")
    return chosen.select(
        "source", "source_size", F.when(F.col("nth") < F.coalesce(F.col("first.nth"), F.lit(2**31 - 1)), F.col("cap").cast("double")).otherwise(share).alias("target")
    )


def _bucket() -> Column:
    """Buckets of about equal rows, in the order of draws."""
    return F.least(F.lit(BUCKETS - 1), F.floor((F.lit(1.0) - F.exp(-F.col("draw") * F.col("mean_weight"))) * BUCKETS)).cast("int")


def _reached(sums: DataFrame, order: list[str]) -> DataFrame:
    """source, budget and ``end``: the last of the ordered ``order`` of each source that begins within its budget, with what lies ``before`` it.

    ``sums`` has source, budget, ``start`` (what lies before all), the columns of ``order`` and ``part``, a sum of sizes.
    """
    upto = Window.partitionBy("source").orderBy(*order)
    ran = sums.withColumn("before", F.sum("part").over(upto) - F.col("part") + F.col("start"))
    return ran.where(F.col("before") <= F.col("budget")).groupBy("source").agg(F.first("budget").alias("budget"), F.max(F.struct(*order, "before")).alias("end"))


def _thresholds(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """For each source: complete epochs, and the last (draw, id, tie, place) of the fractional selection.

    Draws fall into buckets in order; sums of buckets find the one in which a budget ends.  Rows of that
    bucket (one in ``BUCKETS``) are summed by draw and id, which finds the rows alike in both among which
    the budget ends; these are dealt by a draw of their own place, again summed by buckets, and only the
    rows of the last bucket are sorted.  So neither a source nor an id with a third of all rows is sorted
    in one task.
    """
    mean = drawn.groupBy("source").agg(F.avg("weight").alias("mean_weight"))
    bucketed = drawn.join(_small(mean), _same_source(drawn), "inner").drop("_s").withColumn("bucket", _bucket())
    plan = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")).withColumn(
        "budget", F.col("target") - F.col("epochs") * F.col("source_size")
    )

    def with_end(rows: DataFrame, ends: DataFrame) -> DataFrame:
        return rows.join(_small(ends), _same_source(rows), "inner").drop("_s")

    sums = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("part"))
    first = _reached(with_end(sums, plan.select("source", "budget", F.lit(0).alias("start"))), ["bucket"])
    near = with_end(bucketed, first).where(F.col("bucket") == F.col("end.bucket"))
    alike = near.groupBy("source", "draw", "id").agg(F.sum("size").alias("part"), F.first("budget").alias("budget"), F.first("end.before").alias("start"))
    second = saved(_reached(alike, ["draw", "id"]))
    tied = with_end(bucketed, second).where((F.col("draw") == F.col("end.draw")) & F.col("id").eqNullSafe(F.col("end.id")))
    tied = tied.withColumn("tie_bucket", F.floor(F.col("tie") * BUCKETS).cast("int"))
    parts = tied.groupBy("source", "tie_bucket").agg(F.sum("size").alias("part"), F.first("budget").alias("budget"), F.first("end.before").alias("start"))
    third = _reached(parts, ["tie_bucket"])
    left = with_end(tied.drop("budget", "end"), third).where(F.col("tie_bucket") == F.col("end.tie_bucket"))
    upto = Window.partitionBy("source").orderBy("tie", "place")
    summed = left.withColumn("cum", F.sum("size").over(upto) + F.col("end.before"))
    kept = summed.where(F.col("cum") - F.col("size") / 2 <= F.col("budget")).groupBy("source").agg(F.max(F.struct("tie", "place")).alias("last"))
    before = third.select("source", F.col("end.tie_bucket").alias("tie_end"))
    out = plan
    for more in (mean, first.select("source", F.col("end.bucket").alias("end_bucket")), second.select("source", F.struct("end.draw", "end.id").alias("block")), before, kept):
        out = out.join(_small(more), _same_source(out), "left").drop("_s")
    return out


def _small(per_source: DataFrame) -> DataFrame:
    return per_source.withColumnRenamed("source", "_s")


def _same_source(df: DataFrame) -> Column:
    return df["source"].eqNullSafe(F.col("_s"))


def mix(docs: DataFrame, *, size: Column, quality: Column, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """Documents (doc_id, source and any others) under ``doc``, with size, source_size, target and times.

    ``times`` is how often the mix takes the document.  A null size counts 0, a quality that is
    null or not positive as 1e-6; a null source is a source.  Rows without doc_id draw by their place in the
    table; rows that repeat in doc_id draw alike, and where the budget ends among them, as many of them are
    taken as come nearest to it, by a draw of their places.  Places are those of the rows as Spark reads
    ``docs``, so it should be a table (read or saved) and not the result of a shuffle.  The document at the
    end of a budget is taken if that comes nearer to it.  An empty table gives no rows.  Columns of ``docs``
    stay inside ``doc``, so no names clash.
    """
    drawn = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("source"), F.col("doc_id").cast("string").alias("id"),
        F.coalesce(size, F.lit(0)).cast("long").alias("size"), F.greatest(F.coalesce(quality, F.lit(0.0)), F.lit(1e-6)).alias("weight"), F.monotonically_increasing_id().alias("place"),
    )
    named = F.coalesce("id", F.concat(F.lit("row "), F.col("place").cast("string")))
    drawn = drawn.withColumn("tie", unit_draw(F.concat(F.lit("place "), F.col("place").cast("string")))).withColumn("draw", -F.log(unit_draw(named)) / F.col("weight"))
    return _take(drawn, drawn.drop("doc"), weights, most)


def _take(drawn: DataFrame, narrow: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    narrow = saved(narrow)
    plan = saved(_thresholds(narrow, source_targets(narrow, weights, most)))
    plan = _small(plan)
    if plan.count() <= MAX_BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    same = (F.col("draw") == F.col("block.draw")) & F.col("id").eqNullSafe(F.col("block.id"))
    earlier = (F.col("draw") < F.col("block.draw")) | ((F.col("draw") == F.col("block.draw")) & (text("id") < text("block.id")))
    tie_bucket = F.floor(F.col("tie") * BUCKETS).cast("int")
    within = (tie_bucket < F.col("tie_end")) | (F.col("tie") < F.col("last.tie")) | ((F.col("tie") == F.col("last.tie")) & (F.col("place") <= F.col("last.place")))
    inside = earlier | (same & F.coalesce(within, F.lit(False)))
    extra = (_bucket() < F.col("end_bucket")) | ((_bucket() == F.col("end_bucket")) & F.coalesce(inside, F.lit(False)))
    return drawn.join(plan, _same_source(drawn), "inner").withColumn("times", F.col("epochs") + F.coalesce(extra.cast("long"), F.lit(0))).drop(
        "_s", "last", "end_bucket", "block", "tie_end", "mean_weight", "epochs", "budget", "draw", "weight", "tie", "place"
    )


def op10_mix_sources(docs: DataFrame) -> DataFrame:
    """Words that the mix takes of each document; texts are read once and not shuffled.

    Null texts have no words; rows without doc_id, repeated rows and no rows are as in :func:`mix`.
    """
    narrow = docs.select("doc_id", "source", words(F.col("text")).alias("n_words"), text_quality(F.col("text")).alias("quality"))
    mixed = mix(saved(narrow), size=F.col("n_words"), quality=F.col("quality"))
    return mixed.select(F.col("doc.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(length(text), 0) AS chars, coalesce(length(translate(text, '{JUNK}', '')), 0) AS clean,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 1.0) / 4503599627370496.0 AS u
  FROM documents),
k AS (SELECT *, -ln(u) / greatest(0.1::DOUBLE, 1.0::DOUBLE - 4.0::DOUBLE * (chars - clean)::DOUBLE / greatest(chars, 1)::DOUBLE) AS draw FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY (source IS NULL), encode(source)) - 1 AS turn FROM d GROUP BY source),
w AS (SELECT *, CASE turn % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM s),
l AS (
  SELECT *, row_number() OVER o AS nth, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::BIGINT AS lft,
         (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::BIGINT AS wl
  FROM w WINDOW o AS (ORDER BY cap / weight, turn), b AS (ORDER BY cap / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT nth AS fn, lft AS fl, wl AS fw FROM l WHERE lft * weight <= cap * wl ORDER BY nth LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN nth < fn THEN cap::DOUBLE ELSE (fl * weight)::DOUBLE / fw::DOUBLE END AS target FROM l, f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id::VARCHAR) - sum(size) OVER (PARTITION BY source, draw, doc_id) / 2 AS mid FROM k)
SELECT c.doc_id, c.size, e.source_size, e.target,
       (c.size * (e.epochs + CASE WHEN c.mid <= e.target - e.epochs * e.source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c JOIN e ON c.source IS NOT DISTINCT FROM e.source
"""
