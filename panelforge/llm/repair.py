"""Repair of the turn structure of conversations, each distinct signature of roles and faults solved once.

Rows are put in order across the cluster and written as one letter each: role initial and fault.
Letters of a conversation, cut into pieces, are its signature.  Each distinct piece is solved once by
memoised recursion, for every pair of states before and after it, so that pieces chain and a
conversation of any length needs no group of its rows.  Audits go back to the conversations and are
replayed over the rows as they stream by in order.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, small_batches

#: Rows of a piece; recursion goes at most three times as deep.
PIECE = 128
#: Pieces that make up more than this share of all are joined by broadcast; so they are fewer than its reciprocal.
HOT_SHARE = 1 / 1024
SPACE = " \t\n\x0b\x0c\r"
INITIALS, FAULTS = "suax", ("", "blank", "duplicate", "truncated")
#: States of a repaired prefix: nothing kept, after s, after u, after a.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
TURN = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}
CLOSING = {START: (0, ""), AFTER_S: (4, "II"), AFTER_U: (2, "I"), AFTER_A: (0, "")}
LEGAL = {"su", "ua", "au"}
ROLE = {AFTER_U: "user", AFTER_A: "assistant"}


def letter(initial: str, fault: str) -> str:
    return chr(65 + 4 * INITIALS.index(initial) + FAULTS.index(fault))


def meaning(code: str) -> tuple[str, str]:
    return INITIALS[(ord(code) - 65) // 4], FAULTS[(ord(code) - 65) % 4]


def keeps(state: int, initial: str) -> int | None:
    """The state after keeping a row of this initial, None where it may not stand there."""
    if initial == "s":
        return AFTER_S if state == START else None
    if initial == "u":
        return AFTER_U if state != AFTER_U else None
    return AFTER_A if initial == "a" and state == AFTER_U else None


def moves(state: int, code: str) -> Iterator[tuple[int, str, int]]:
    """Cost, edit and following state of what may be done with a row."""
    initial, fault = meaning(code)
    yield 3, "D", state
    if fault in ("blank", "duplicate"):
        return
    extra = int(fault == "truncated")
    kept = keeps(state, initial)
    if kept is not None:
        yield extra, "K", kept
    yield 2 + extra, "R", TURN[state]


def solve(piece: str) -> list[list[tuple[int, str] | None]]:
    """Cheapest edits of a piece, least in ASCII among equals, by state before and after it.

    Inserts stand before a row, so that no solution is the beginning of another one and pieces
    can be chained by cost and then by audit.  Two inserts in a row lead to every state that more do.
    """

    @functools.cache
    def best(at: int, state: int, end: int, inserted: int) -> tuple[int, str] | None:
        if at == len(piece):
            return (0, "") if state == end and not inserted else None
        found = []
        for cost, edit, following in moves(state, piece[at]):
            rest = best(at + 1, following, end, 0)
            if rest is not None:
                found.append((cost + rest[0], edit + rest[1]))
        if inserted < 2:
            rest = best(at, TURN[state], end, inserted + 1)
            if rest is not None:
                found.append((2 + rest[0], "I" + rest[1]))
        return min(found, default=None)

    return [[best(0, state, end, 0) for end in range(4)] for state in range(4)]


def chain(pieces: list[tuple[list[int | None], list[str | None]]]) -> tuple[int, str]:
    """Cost and audit of a conversation from its pieces' costs and audits, sixteen of each by state before and after."""
    after: list[tuple[int, int] | None] = [(CLOSING[s][0], s) for s in range(4)]
    chosen = []
    for nth, (costs, audits) in enumerate(reversed(pieces)):
        now, step = [], []
        for state in range(4):
            ways = [
                (costs[4 * state + end] + after[end][0], audits[4 * state + end] + (CLOSING[end][1] if nth == 0 else ""), end)
                for end in range(4) if costs[4 * state + end] is not None and after[end] is not None
            ]
            way = min(ways, default=None)
            now.append(way and (way[0], way[2]))
            step.append(way)
        after = now
        chosen.append(step)
    state, parts = START, []
    for step in reversed(chosen):
        parts.append(step[state][1])
        state = step[state][2]
    return after[START][0], "".join(parts)


def illegal_pairs(initials: str) -> int:
    return sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1))


SOLVED = "piece string, n long, costs array<int>, audits array<string>, cost long, audit string, blank long, duplicate long, truncated long, illegal long, first string, last string"


def _solve_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for piece, n in zip(batch["piece"], batch["n"], strict=True):
            table = [x for line in solve(piece) for x in line]
            costs, audits = [x and x[0] for x in table], [x and x[1] for x in table]
            read = [meaning(c) for c in piece]
            initials, faults = "".join(i for i, _ in read), [f for _, f in read]
            rows.append((piece, n, costs, audits, *chain([(costs, audits)]), *[faults.count(f) for f in FAULTS[1:]], illegal_pairs(initials), initials[0], initials[-1]))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in SOLVED.split(", ")])


AUDITED = "cost long, audit string, blank long, duplicate long, truncated long, illegal long"


def _chain_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["run", "nth"])
    integer = lambda xs: [None if x is None or x != x else int(x) for x in xs]
    cost, audit = chain([(integer(c), list(a)) for c, a in zip(pdf["costs"], pdf["audits"], strict=True)])
    seams = sum(a + b not in LEGAL for a, b in zip(pdf["last"], pdf["first"].iloc[1:], strict=False))
    return pd.DataFrame({
        "conv_id": [pdf["conv_id"].iloc[0]], "cost": [cost], "audit": [audit], **{f: [int(pdf[f].sum())] for f in FAULTS[1:]}, "illegal": [int(pdf["illegal"].sum()) + seams]
    })


def ordered(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with ``at``, their place by conversation, turn (nulls first), role and MD5 of text.

    The order is made by ranges over all tasks, so a conversation of any size is spread over them;
    the upper bits of ``at`` are the range.  Saved, so that places stay.
    """
    keys = ["conv_id", F.col("turn").asc_nulls_first(), "role", "digest"]
    hashed = rows.withColumn("digest", F.md5(F.col("text").cast("binary")))
    return saved(hashed.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))


def coded(rows: DataFrame) -> DataFrame:
    """at, conv_id and the letter of each row of :func:`ordered`: role initial and first fault."""
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    marks = rows.select("at", "conv_id", "role", "digest", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    firsts = marks.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), 1).when(F.col("first").isNull(), 2).when(F.col("cut"), 3).otherwise(0)
    start = F.substring("role", 1, 1)
    initial = F.when(start == "s", 0).when(start == "u", 1).when(start == "a", 2).otherwise(3)
    return marks.join(firsts, "at", "left").select("at", "conv_id", F.char(F.lit(65) + initial * 4 + fault).alias("code"))


def pieces_of(codes: DataFrame) -> DataFrame:
    """conv_id, run, nth, piece: the letters of each conversation in order, by range of the order and then by ``PIECE`` rows."""
    letters = F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda x: x["code"])
    runs = codes.groupBy("conv_id", F.shiftright("at", 33).alias("run")).agg(F.array_join(letters, "").alias("letters"))
    starts = F.sequence(F.lit(0), F.floor((F.length("letters") - 1) / PIECE).cast("int"))
    return runs.select("conv_id", "run", "letters", F.explode(starts).alias("nth")).select("conv_id", "run", "nth", F.substring("letters", F.col("nth") * PIECE + 1, F.lit(PIECE)).alias("piece"))


def _join_solved(rows: DataFrame, solved: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with the solution of their piece; pieces of a large share, which are few, by broadcast."""
    limit = solved.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > limit * HOT_SHARE
    few = solved.where(hot).select("piece", *columns)
    flagged = rows.join(F.broadcast(few.select("piece", F.lit(True).alias("hot"))), "piece", "left")
    return flagged.where("hot").drop("hot").join(F.broadcast(few), "piece").unionByName(
        flagged.where("hot IS NULL").drop("hot").join(solved.where(~hot).select("piece", *columns), "piece")
    )


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, cost, audit and the numbers of faults and illegal neighbours of each conversation of :func:`ordered` rows."""
    pieces = saved(pieces_of(coded(rows)))
    solved = saved(pieces.groupBy("piece").agg(F.count("*").alias("n")).mapInPandas(_solve_all, SOLVED))
    answers = [c.split()[0] for c in AUDITED.split(", ")]
    sizes = pieces.groupBy("conv_id").agg(F.count("*").alias("k"), F.max("piece").alias("piece"))
    single = _join_solved(sizes.where("k = 1").drop("k"), solved, answers).select("conv_id", *answers)
    long = sizes.where("k > 1").select(F.col("conv_id").alias("_id"))
    several = pieces.join(long, F.col("conv_id").eqNullSafe(F.col("_id")), "leftsemi")
    parts = _join_solved(several, solved, ["costs", "audits", "blank", "duplicate", "truncated", "illegal", "first", "last"]).drop("piece")
    kind = rows.schema["conv_id"].dataType.simpleString()
    return single.unionByName(parts.groupBy("conv_id").applyInPandas(_chain_group, f"conv_id {kind}, {AUDITED}"))


def _replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Headers of conversations with the SHA-256 of the repaired rows that follow each of them."""
    head, edits, state, at, sha, lines = None, "", START, 0, None, 0

    def say(role: str, text: str) -> None:
        nonlocal lines
        sha.update((("\n" if lines else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        lines += 1

    def inserts() -> None:
        nonlocal at, state
        while at < len(edits) and edits[at] == "I":
            state = TURN[state]
            say(ROLE[state], "")
            at += 1

    def finished() -> tuple:
        inserts()
        return (*head, sha.hexdigest())

    columns = None
    for batch in batches:
        columns = [c for c in batch.columns if c not in ("at", "role", "text")]
        out = []
        heads = batch[columns].itertuples(index=False, name=None)
        for place, role, text, values in zip(batch["at"], batch["role"], batch["text"], heads, strict=True):
            if place < 0:
                if head is not None:
                    out.append(finished())
                head, edits, state, at, sha, lines = values, values[columns.index("audit")], START, 0, hashlib.sha256(), 0
                continue
            inserts()
            edit, at = edits[at], at + 1
            if edit == "K":
                state = keeps(state, role[:1])
                say(role, text)
            elif edit == "R":
                state = TURN[state]
                say(ROLE[state], text)
        if out:
            yield pd.DataFrame(out, columns=[*columns, "repaired_sha256"])
    if head is not None:
        yield pd.DataFrame([finished()], columns=[*columns, "repaired_sha256"])


def repair(rows: DataFrame, everyone: DataFrame) -> DataFrame:
    """Faults, cheapest audit and digest of the repaired conversation, for each conv_id of ``everyone``.

    ``rows`` has conv_id, turn, role and text without nulls in role and text; ``everyone`` has conv_id
    once each and columns that go through.  SHA-256 has no parts, so a conversation's rows stream by
    in one task, a batch at a time; everything before that is spread over all tasks.
    """
    small_batches(rows.sparkSession)
    placed = ordered(rows)
    answers = [c.split()[0] for c in AUDITED.split(", ")]
    found = audits(placed).withColumnRenamed("conv_id", "_id")
    heads = everyone.join(found, F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    heads = heads.select(*everyone.columns, *[F.coalesce(c, F.lit("" if c == "audit" else 0)).alias(c) for c in answers])
    stream = heads.withColumn("at", F.lit(-1).cast("long")).unionByName(placed.select("conv_id", "at", "role", "text"), allowMissingColumns=True)
    # Counts are null in rows of text; as strings they do not turn into floats in pandas.
    plain = [F.col(c).cast("string").alias(c) if c not in ("conv_id", "audit", "role", "text", "at") else F.col(c) for c in stream.columns]
    key = F.col("conv_id").cast("string").alias("conv_id")
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", "at").select(key, *plain[1:])
    fields = ", ".join(f"`{c}` string" for c in [*heads.columns, "repaired_sha256"])
    done = stream.mapInPandas(_replay, fields)
    kinds = {f.name: f.dataType for f in heads.schema}
    return done.select(*[F.col(c).cast(kinds[c]).alias(c) for c in heads.columns], "repaired_sha256")


def damage(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The damaged rows, and each conv_id with ``gaps`` of what is left of it."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = (F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20).cast("int")
    drawn = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), draw.alias("draw"))
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    left = drawn.where("draw <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("draw") == 3, 2).otherwise(1))).alias("_copy"))
    return left.drop("_copy"), drawn.groupBy("conv_id").agg(_gaps(F.when(F.col("draw") != 0, F.col("turn"))).alias("gaps"))


def _gaps(turn: Column) -> Column:
    return F.coalesce(F.max(turn).cast("long") - F.min(turn).cast("long") + 1 - F.count_distinct(turn), F.lit(0)).cast("long")


def op12_signatures(conversations: DataFrame) -> DataFrame:
    """Damages the conversations by the contract and returns audit, costs and digest of each one's repair.

    Null texts and roles are one space, so such rows are blank or of no legal role; rows without conv_id
    are one conversation; null turns come first and count in no gap.  Rows of one turn stand by role, then
    by MD5 of the text; repeated rows are duplicates of the first.  Roles whose initial is not s, u or a
    can't be kept.  No rows give no rows; other columns are not read.
    """
    rows, everyone = damage(conversations)
    return repair(rows, everyone)


ORACLE = r"""
WITH RECURSIVE drawn AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
crc AS (
  SELECT *, xor(4294967295, list_reduce(list_transform(range(0, length(k) + 1), lambda i: CASE WHEN i = 0 THEN 4294967295 ELSE ascii(substr(k, CAST(i AS INTEGER), 1)) END),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) % 20 AS draw FROM drawn),
damaged AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role, CASE draw WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN draw = 3 THEN 2 ELSE 1 END)) AS copy FROM crc WHERE draw <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS n,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS i FROM damaged),
marked AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(i) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM placed),
counted AS (
  SELECT conv_id, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM marked GROUP BY conv_id),
turns(s, e) AS (VALUES ('0', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
inserted AS (SELECT s, s AS e, 0 AS c, '' AS t FROM turns UNION ALL SELECT s, e, 2, 'I' FROM turns UNION ALL SELECT x.s, y.e, 4, 'II' FROM turns x JOIN turns y ON y.s = x.e),
kinds AS (SELECT i, f FROM (VALUES ('s'), ('u'), ('a'), ('x')) a(i), (VALUES (''), ('truncated'), ('must')) b(f)),
acts AS (
  SELECT i, f, s, s AS e, 3 AS c, 'D' AS t FROM kinds, turns
  UNION ALL SELECT i, f, s, e, 2 + CAST(f = 'truncated' AS INTEGER), 'R' FROM kinds, turns WHERE f <> 'must'
  UNION ALL SELECT i, f, s, i, CAST(f = 'truncated' AS INTEGER), 'K' FROM kinds, turns WHERE f <> 'must' AND (i = 's' AND s = '0' OR i = 'u' AND s <> 'u' OR i = 'a' AND s = 'u')),
steps AS (SELECT p.s, a.e, a.i, a.f, p.c + a.c AS c, p.t || a.t AS t FROM inserted p JOIN acts a ON a.s = p.e),
closing(s, c, t) AS (VALUES ('0', 0, ''), ('s', 4, 'II'), ('u', 2, 'I'), ('a', 0, '')),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS n, '0' AS s, '000000000' AS k FROM counted
  UNION ALL
  SELECT w.conv_id, w.n + 1, t.e, min(lpad(CAST(CAST(left(w.k, 9) AS BIGINT) + t.c AS VARCHAR), 9, '0') || substr(w.k, 10) || t.t)
  FROM walk w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.n = w.n + 1
  JOIN steps t ON t.s = w.s AND t.i = m.i AND t.f = CASE WHEN m.fault IN ('blank', 'duplicate') THEN 'must' ELSE m.fault END GROUP BY 1, 2, 3),
ends AS (
  SELECT w.conv_id, min(lpad(CAST(CAST(left(w.k, 9) AS BIGINT) + z.c AS VARCHAR), 9, '0') || substr(w.k, 10) || z.t) AS k
  FROM walk w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.n JOIN closing z ON z.s = w.s GROUP BY 1),
edits AS (SELECT conv_id, unnest(range(1, length(k) - 8)) AS j, substr(k, CAST(9 + unnest(range(1, length(k) - 8)) AS INTEGER), 1) AS t FROM ends),
numbered AS (SELECT *, count(*) FILTER (t <> 'I') OVER w AS n, count(*) FILTER (t <> 'D') OVER w AS p FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
joined AS (SELECT x.*, m.role, m.text, m.i FROM numbered x LEFT JOIN marked m ON x.t <> 'I' AND m.conv_id IS NOT DISTINCT FROM x.conv_id AND m.n = x.n),
offsets AS (SELECT conv_id, count(*) AS o FROM joined WHERE t = 'K' AND i = 's' GROUP BY 1),
lines AS (
  SELECT x.conv_id, x.j, CASE WHEN t = 'K' THEN role WHEN (p - coalesce(o, 0)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN t = 'I' THEN '' ELSE text END AS line
  FROM joined x LEFT JOIN offsets o ON o.conv_id IS NOT DISTINCT FROM x.conv_id WHERE t <> 'D'),
digests AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY j) AS body FROM lines GROUP BY 1),
everyone AS (SELECT DISTINCT conv_id FROM conversations)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(CAST(left(k, 9) AS BIGINT), 0) AS cost, coalesce(substr(k, 10), '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM everyone e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN ends x ON x.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN digests d ON d.conv_id IS NOT DISTINCT FROM e.conv_id"""
