"""Repair of conversations against a search over all edits in plain Python."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest

from panelforge.llm import repair

COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SCHEMA = "conv_id long, turn long, role string, text string"
WORD, GOOD = re.compile(r"[^ \x09-\x0D]"), re.compile(r"(s?(ua)+)?")


def damaged(rows):
    """conv_id -> rows in order after damage, (turn, role, text)."""
    out = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        out[conv] += [(turn, "user" if draw == 4 else role, text)] * (draw != 0) * (2 if draw == 3 else 1)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest())
    return {c: sorted(rs, key=key) for c, rs in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        marks = WORD.findall(text)
        out.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """Dijkstra over (cost, audit): the first finished audit with legal roles is the answer."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, roles, lines = heapq.heappop(heap)
        tail = roles[-1:] if roles else ""
        if (at, tail) in seen and not GOOD.fullmatch(roles):
            continue
        if at == len(rows) and GOOD.fullmatch(roles):
            return cost, audit, lines
        if (at, tail, audit) in seen:
            continue
        seen.add((at, tail, audit))
        steps = [(2, "I", at, r, ("user" if r == "u" else "assistant") + ":") for r in "ua"]
        if at < len(rows):
            _, role, text = rows[at]
            steps.append((3, "D", at + 1, "", None))
            if marks[at] not in ("blank", "duplicate"):
                extra = marks[at] == "truncated"
                steps.append((extra, "K", at + 1, role[:1] or "?", f"{role}:{text}"))
                steps += [(2 + extra, "R", at + 1, r, ("user" if r == "u" else "assistant") + ":" + text) for r in "ua"]
        for more, edit, to, role, line in steps:
            now = roles + role
            if re.fullmatch(r"s?(ua)*u?", now):
                heapq.heappush(heap, (cost + more, audit + edit, to, now, lines if line is None else (*lines, line)))


def brute(rows):
    out = []
    for conv, after in damaged(rows).items():
        marks = faults(after)
        turns = [t for t, _, _ in after if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        first = [(r[1][:1] or "?") for r in after]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
        cost, audit, lines = cheapest(after, marks)
        out.append((conv, gaps, *[marks.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def talks(n, seed):
    draw = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(draw.randrange(1, 9)):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool"]) if draw.random() < 0.4 else ("user", "assistant")[turn % 2]
            rows.append((conv, turn + draw.randrange(2), role, draw.choice(["Yes.", "What now?", "half a sent", "  ", f"Number {turn}!  \n", "One. Two."])))
    return rows


ODD = [
    (None, 1, "user", "Hello."), (None, None, "assistant", "Hi!"), (None, None, None, None), (None, 1, "user", "Hello."), (5, None, "user", None), (6, 0, "", "No role."),
    (7, 2, "user", "é\U0001f600."), (7, 2, "user", "é\U0001f600."), (7, 2, "assistant", "x" * 50_000 + "."), (7, 1, "system", "\x0b\x0c."), (8, 3, "User", "Case?"), (9, 9, "user", "a "),
]


@pytest.mark.parametrize("rows", [talks(60, 1), talks(60, 2), ODD, ODD + talks(20, 3)], ids=["talks", "more talks", "odd", "both"])
def test_repairs_like_brute_force(spark, rows):
    assert found(repair.op12_signatures(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_pieces_chain(spark, monkeypatch):
    """Pieces of three rows, and ranges that cut conversations, give the same as whole ones."""
    rows = talks(40, 4)
    whole = found(repair.op12_signatures(spark.createDataFrame(rows, SCHEMA)))
    monkeypatch.setattr(repair, "PIECE", 3)
    cut = repair.op12_signatures(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert found(cut) == whole == brute(rows)


def test_a_long_conversation_is_spread(spark):
    """One conversation of 3,000 turns beside short ones: in several ranges, and equal to the SQL."""
    draw = random.Random(5)
    rows = [(1, t, draw.choice(["user", "assistant"]), draw.choice([f"Turn {t}.", "Yes.", f"cut {t}"])) for t in range(3000)] + [(2, 0, "user", "Hi."), (3, 0, "system", "Be.")]
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = found(repair.op12_signatures(df))
        placed = repair.ordered(df)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert placed.where("conv_id = 1").selectExpr("count(DISTINCT shiftright(at, 33))").first()[0] > 1
    con = duckdb.connect()
    con.register("conversations", df.toPandas())
    assert got == sorted((tuple(r) for r in con.sql(repair.ORACLE).select(*COLUMNS).fetchall()), key=repr)


def test_other_columns_and_no_rows(spark):
    clash = ", at long, code string, piece string, run int, nth int, digest string, cost string, audit int, gaps int, draw int, n int"
    more = spark.createDataFrame([(*r, *[None] * 11) for r in ODD], SCHEMA + clash)
    assert found(repair.op12_signatures(more)) == brute(ODD)
    assert repair.op12_signatures(spark.createDataFrame([], SCHEMA)).collect() == []


def test_all_rows_dropped():
    assert repair.chain([]) == (0, "")


def test_each_signature_is_solved_once(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"{c} {t}.") for c in range(50) for t in range(4)]
    pieces = repair.pieces_of(repair.coded(repair.ordered(spark.createDataFrame(rows, SCHEMA))))
    assert pieces.count() >= 50 > 5 > pieces.select("piece").distinct().count()
