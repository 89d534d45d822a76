import random
import re
import time
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelforge.llm import decontaminate, licenses, linedups, mixing, secrets, sharding, toxicity, transport
from panelforge.llm.queries import oracle_sql, queries

from ..conftest import SMALL, same_rows

ODD = [None, "", " ", "\n\n\n", "é😀 ß", "a" * 30_000, "x " * 20_000, "x " * 20_000, "ends\n"]


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    mine, theirs = same_rows(queries()[name](spark, SMALL), duck.sql(oracle_sql()[name]))
    assert mine == theirs and mine


# ---- sharding


def check_shards(rows, shards, share):
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [sum(r["size"] for r in rows if r.shard == s) for s in range(shards)]
    largest = max((r["size"] for r in rows), default=0)
    assert max(sizes) - min(sizes) <= share * sum(sizes) + 2 * largest


def test_shards_are_even_and_gapless(docs, prose):
    texts = prose(300, 20, 1) + ["the same text"] * 200 + ODD[:5]
    rows = sharding.op1_sampled_splitters(docs(texts)).collect()
    assert len(rows) == len(texts) and {r.law for r in rows} == {"bytes"}
    check_shards(rows, 8, 0.02)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), None)


def test_small_groups_stay_together(docs, prose):
    texts = [t for t in prose(2000, 5, 2) for _ in range(2)]
    where = {}
    for r in sharding.op1_sampled_splitters(docs(texts)).collect():
        where.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_overfull_ranges_are_subdivided(docs, prose):
    d = docs(prose(400, 10, 3)).withColumn("size", F.lit(10)).withColumn("shard", F.lit("own"))
    rows = sharding.shard_records(d, 4, key=F.lit(1), tie=F.col("doc_id"), size=F.col("size"), min_ranges=16).collect()
    counts = [sum(r["_shard"] == s for r in rows) for s in range(4)]
    assert sum(counts) == 400 and min(counts) > 60 and {r.shard for r in rows} == {"own"}


def test_repeated_rows_are_split_and_not_collected(docs, prose, monkeypatch):
    """Rows alike in every column, a third of all and more, go to several shards; the sample holds groups, not rows."""
    same = docs(["the very same row"]).select("doc_id", "text")
    many = same.crossJoin(same.sparkSession.range(6000).repartition(24)).drop("id").unionByName(docs(prose(3000, 3, 5)).select("doc_id", "text"))
    drawn = []
    quantiles = sharding._quantiles
    monkeypatch.setattr(sharding, "_quantiles", lambda sample, step: drawn.append(len(sample)) or quantiles(sample, step))
    rows = sharding.op1_sampled_splitters(many).collect()
    assert len(rows) == 9000
    check_shards(rows, 8, 0.02)
    assert len({r.shard for r in rows if r.text_crc32 == zlib.crc32(b"the very same row")}) > 2
    drawn.clear()
    few = sharding.shard_records(many, 8, key=F.col("text"), tie=F.col("doc_id"), size=F.length("text"), min_ranges=16).collect()
    assert max(drawn) < 16 * 10 * 4 and len({(r.shard, r.slot) for r in few}) == 9000


def test_sharding_nothing(docs):
    assert sharding.op1_sampled_splitters(docs([])).count() == 0
    assert sharding.op1_sampled_splitters(docs([None])).first().shard is not None


# ---- mixing


def test_mix_comes_near_its_targets(docs, prose):
    d = docs(prose(600, 15, 4) + ODD)
    rows = mixing.op10_mix_sources(d).collect()
    text = {r.doc_id: (r.text, r.source) for r in d.collect()}
    assert len(rows) == 609
    by, target = {}, {}
    for r in rows:
        t, s = text[r.doc_id]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) and r.taken <= 3 * r["size"]
        by[s] = by.get(s, 0) + r.taken
        target[s] = r.target
    assert sum(target.values()) == pytest.approx(sum(r["size"] for r in rows))
    assert all(abs(by[s] - target[s]) <= 20_000 / 2 + 15 for s in by)


def test_mix_of_nothing_and_of_wordless_texts(docs):
    assert mixing.op10_mix_sources(docs([])).count() == 0
    assert {r.taken for r in mixing.op10_mix_sources(docs([None, "", " "])).collect()} == {0}


# ---- decontamination


def brute_hits(text, items, window=10):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(table))
    w = words(text)
    hit, found = set(), set()
    for name, t in items:
        x = words(t)
        k = min(len(x), window)
        for i in range(len(x) - k + 1 if k else 0):
            for j in range(len(w) - k + 1):
                if w[j : j + k] == x[i : i + k]:
                    hit.update(range(j, j + k))
                    found.add(str(name))
    return len(w), len(hit), sorted(found)


def test_hits_equal_brute_force(spark, docs):
    draw = random.Random(5)
    some = lambda lo, hi: " ".join(draw.choice("abcd") for _ in range(draw.randint(lo, hi)))
    items = [(i, some(1, 14)) for i in range(12)] + [(50, None), (51, "?!"), (None, "a b c"), (52, "Shared words"), (53, "shared WORDS")]
    texts = [some(0, 60) for _ in range(150)] + ODD + ["shared, words"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.match_spans(docs(texts), bench).collect()
    known = [x for x in items if x[0] is not None]
    for r in rows:
        assert (r.n_words, sum(s.end - s.start for s in r.spans), list(r["items"])) == brute_hits(texts[r.doc_id], known)
    blocks = decontaminate.match_spans(docs(texts), bench, block_bytes=20).collect()
    assert sorted(map(str, blocks)) == sorted(map(str, rows))
    whole = decontaminate.decontaminate(docs(texts), bench).collect()
    parts = decontaminate.decontaminate(docs(texts), bench, block_bytes=20).collect()
    assert sorted(map(str, parts)) == sorted(map(str, whole))


def test_rounds_join_batches_only_for_several_blocks(monkeypatch):
    batches = [pa.RecordBatch.from_pydict({"x": [i] * 10}) for i in range(7)]
    monkeypatch.setattr(decontaminate, "ROUND_BYTES", 3 * batches[0].nbytes)
    assert [b.num_rows for b in decontaminate._rounds(iter(batches), 1)] == [10] * 7
    assert [b.num_rows for b in decontaminate._rounds(iter(batches), 2)] == [30, 30, 10]
    assert list(decontaminate._rounds(iter([]), 2)) == []


def test_spans_are_cut(spark, docs):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    passage = "One, two three four five six seven eight nine ten eleven"
    out = {r.doc_id: r for r in decontaminate.decontaminate(docs([f"Before {passage}! after it all comes", "clean", None, passage]), bench).collect()}
    assert out[0].text == "Before ! after it all comes" and out[0].n_chars == len(out[0].text)
    assert out[1].text == "clean" and out[2].text is None and 3 not in out


# ---- media, licences, lines, secrets, toxicity


def test_streams_give_back_the_texts(docs, prose):
    texts = ODD + [t[:k] for k, t in zip(range(60, 68), prose(8), strict=True)]
    for r in transport.op3_transport_stream(docs(texts)).collect():
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == transport.brute_force(texts[r.doc_id])
        assert r.media_bytes % transport.PACKET == 0 and "discontinuities=0" in r.feature


def test_damaged_streams():
    media = transport.mux(b"x" * 9000)
    assert transport.parse(media)[0].random_access == [True, False, False, False, True]
    lost = media[: 188 * 5] + media[188 * 6 :]
    with pytest.raises(transport.StreamError):
        transport.parse(lost)
    with pytest.raises(transport.StreamError):
        transport.parse(media[:-1])
    with pytest.raises(transport.StreamError):
        transport.parse(media[:376] + b"\0" + media[377:])
    again = media[: 188 * 4] + media[188 * 3 : 188 * 4] + media[188 * 4 :]
    assert transport.parse(again)[0].data == b"x" * 9000


def test_tables_over_packets_and_open_lengths():
    """A program table of many streams runs over several packets; an elementary packet may leave its length open."""
    body = (0xE000 | transport.DATA_PID).to_bytes(2, "big") + b"\xf0\x00"
    pids = [transport.DATA_PID, *range(0x200, 0x250)]
    body += b"".join(bytes([6]) + (0xE000 | p).to_bytes(2, "big") + b"\xf0\x00" for p in pids)
    section = b"\0" + transport._section(2, 1, body)
    packets = []
    for n, at in enumerate(range(0, len(section), 184)):
        head = bytes([0x47]) + ((0x4000 if n == 0 else 0) | transport.PMT_PID).to_bytes(2, "big") + bytes([0x10 | n])
        packets.append((head + section[at : at + 184]).ljust(188, b"\xff"))
    assert len(packets) > 1
    media = transport.mux(b"y" * 5000)
    found = transport.parse(transport.PAT + b"".join(packets) + media[376:])
    assert [s.pid for s in found] == pids and found[0].data == b"y" * 5000 and found[1].data == b""
    start = media.index(b"\0\0\1\xbd")
    assert transport.parse(media[: start + 4] + b"\0\0" + media[start + 6 :])[0].data == b"y" * 5000
    bare = bytes([0x47, 0x41, 0, 0x30, 183]) + b"\0" + b"\xff" * 182  # a start without payload begins no unit
    assert transport.parse(media[:376] + bare + media[376:])[0].data == b"y" * 5000


def test_damaged_rows_leave_the_others(spark):
    good = transport.mux(b"z" * 64)
    rows = [(1, 64, good), (2, 64, good[:-1]), (3, 0, None), (4, 0, b""), (4, 64, transport.PAT + transport.PMT), (None, 64, good)]
    got = transport.read_media(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()
    assert sorted((r.doc_id or 0, r.payload, r.error) for r in got if r.payload is not None) == [(0, b"z" * 64, None), (1, b"z" * 64, None), (4, b"", None)]
    assert {(r.doc_id, r.error) for r in got if r.payload is None} == {(2, "not a whole number of packets"), (3, None), (4, "no program")}


def test_licence_scan_equals_brute_force(docs, prose):
    names = sorted(licenses.TEMPLATES)
    texts = [f"{p}\n{licenses.TEMPLATES[n]}\n{p}" for p, n in zip(prose(len(names), 12, 7), names, strict=True)] + ODD
    texts += [licenses.TEMPLATES["MIT-text"].replace(". ", ".\n").replace("software", "program", 1)]
    for r in licenses.scan_licenses(docs(texts)).collect():
        lines = [x.split() for x in (texts[r.doc_id] or "").encode().translate(licenses._KEEP_LINES).split(b"\n")]
        want = set()
        for name, t in licenses.TEMPLATES.items():
            own = licenses.bigrams(t.encode().translate(licenses.WORD_TABLE).split())
            if any(licenses.dice(licenses.bigrams(sum(lines[i : j + 1], [])), own) >= licenses.THRESHOLD for i in range(len(lines)) for j in range(i, min(len(lines), i + 40))):
                want.add(name)
        assert {m.license for m in r.matches} == want
    assert licenses.op4_license_dice(docs([])).count() == 0


def plain_passages(text, threshold=licenses.THRESHOLD, most=60):
    """Every run of up to ``most`` lines against every template; of overlapping ones of a template the best, shortest, first."""
    lines = [x.split() for x in (text or "").encode().translate(licenses._KEEP_LINES).split(b"\n")]
    out = []
    for name, t in licenses.TEMPLATES.items():
        own = licenses.bigrams(t.encode().translate(licenses.WORD_TABLE).split())
        every = [(-licenses.dice(licenses.bigrams(sum(lines[i : j + 1], [])), own), j - i, i) for i in range(len(lines)) for j in range(i, min(len(lines), i + most)) if lines[i]]
        taken = []
        for d, n, i in sorted(e for e in every if -e[0] >= threshold):
            if all(i + n < a or a + b < i for a, b in taken):
                taken.append((i, n))
                out.append((name, i, i + n, round(-d, 9)))
    return sorted(out, key=lambda m: (m[1], m[0], m[2]))


def test_licence_passages_equal_brute_force():
    """Names, lines and scores, with notices split at any word, doubled and repeated."""
    draw = random.Random(8)
    matcher = licenses.Matcher(licenses.TEMPLATES, licenses.THRESHOLD)
    texts = ["Released\nunder the MIT License.", "Released under the MIT License.\n" * 30, "a b\nc d\n" * 20 + "Licensed under CC BY-NC 4.0."]
    for _ in range(60):
        words = []
        for _ in range(draw.randint(1, 3)):
            words += licenses.TEMPLATES[draw.choice(sorted(licenses.TEMPLATES))].split()[: draw.randint(3, 60)]
            words += ["other", "words"][: draw.randint(0, 2)]
        texts.append("".join(w + draw.choice([" "] * 9 + ["\n", "\n\n"]) for w in words))
    for t in texts:
        got = [(n, i, j, round(d, 9)) for n, i, j, d in matcher.scan(t.encode())]
        want = plain_passages(t)
        assert [g for g in got if g[2] - g[1] < 60] == want
    assert plain_passages(texts[0])[0][:3] == ("MIT", 0, 1)


def test_licence_scan_is_linear_in_repeated_lines():
    import time

    matcher = licenses.Matcher(licenses.TEMPLATES, licenses.THRESHOLD)
    began = time.perf_counter()
    assert len(matcher.scan(b"Released under the MIT License.\n" * 20_000)) == 20_000
    matcher.scan(b"under the license\nof the work\nyou may\n" * 7_000)
    matcher.scan(b"under the terms " * 100_000)
    assert time.perf_counter() - began < 5


def test_repeated_runs(docs):
    texts = ["a\nb\nc\nd", "x\na\nb\nc\ny", None, "", "a\nb", "q\nq\nq\nq\nq", "a\nb\nc\nd"]
    out = {r.doc_id: (r.clean_text, r.removed_lines) for r in linedups.op7_repeated_lines(docs(texts)).collect()}
    assert out == {0: (texts[0], ""), 1: ("x\ny", "1,2,3"), 2: (None, ""), 3: ("", ""), 4: ("a\nb", ""), 5: ("q", "1,2,3,4"), 6: ("", "0,1,2,3")}
    clash = linedups.dedup_lines(docs(texts).withColumn("removed", F.lit(1)))
    assert clash.columns[-2:] == ["removed", "_removed"] and linedups.dedup_lines(docs([])).count() == 0


def later_lines(texts, run=3, limit=50):
    """Lines in a run of any length that begins earlier and has ``run`` lines or over ``limit`` words, by all pairs of lines."""
    lines = [x.split("\n") if x else [] for x in texts]
    gone = [set() for _ in texts]
    places = [(d, i) for d, x in enumerate(lines) for i in range(len(x))]
    for d, i in places:
        for e, j in places:
            if (e, j) >= (d, i):
                break
            n = next((k for k, (a, b) in enumerate(zip(lines[d][i:], lines[e][j:])) if a != b), min(len(lines[d]) - i, len(lines[e]) - j))
            if n >= run or sum(len(x.split()) for x in lines[d][i : i + n]) > limit:
                gone[d].update(range(i, i + n))
    return [",".join(map(str, sorted(x))) for x in gone]


def test_repeated_passages_equal_brute_force(docs):
    draw = random.Random(7)
    long = [" ".join(f"w{k}x{j}" for j in range(n)) for k, n in enumerate((50, 51, 137, 30, 26, 25, 1))]
    texts = [long[2], long[2], "x\n" + long[1], long[1] + "\ny", long[0], long[0], f"a\n{long[3]}\n{long[4]}\nb", f"c\n{long[3]}\n{long[4]}\nd", f"{long[2]}\nshort\nq", f"z\n{long[2]}\nshort\nr", *ODD]
    pool = [*long, "", "a", "b c"]
    texts += ["\n".join(draw.choice(pool) for _ in range(draw.randint(1, 9))) for _ in range(60)]
    out = {r.doc_id: (r.removed_lines, r.clean_text) for r in linedups.op7_repeated_passages(docs(texts)).collect()}
    want = later_lines(texts)
    assert [out[i][0] for i in range(len(texts))] == want
    assert want[1] == "0" and want[3] == "0" and want[5] == "" and want[7] == "1,2" and want[9] == "1,2"
    assert out[1][1] == "" and out[3][1] == "y" and linedups.op7_repeated_passages(docs([])).count() == 0


def test_suffix_array_and_lcp_equal_brute_force(spark, docs, monkeypatch):
    """Order, common prefixes, depth intervals and maximal runs over many small partitions."""
    draw = random.Random(9)
    block = [f"line {i}" for i in range(40)]
    texts = ["\n".join(draw.choice("abc") for _ in range(draw.randint(1, 12))) for _ in range(40)] + ["\n".join(block), "x\n" + "\n".join(block[3:]), "\n".join(block[:30]) + "\ny", "a\na\na\na\na\na\na", "alone"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        seqs = linedups.sequences(docs(texts))
        rows = linedups.with_lcp(linedups.suffix_array(seqs), seqs).orderBy("rank").collect()
        heads = {r["rank"]: r.heads for r in linedups.intervals(linedups.with_lcp(linedups.suffix_array(seqs), seqs), 4).collect()}
        runs = {tuple(r) for r in linedups.maximal_runs(docs(texts)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    first = {r.t: r.first for r in seqs.collect()}
    lines = {t: texts[d].split("\n") for t, d in first.items()}
    assert [first[t] for t in sorted(first)] == sorted(first.values())
    common = lambda x, y: next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
    seen = {}
    for t in lines.values():
        for x in t:
            seen[x] = seen.get(x, 0) + 1
    assert {(r.t, r.line) for r in rows} == {(t, i) for t, x in lines.items() for i, one in enumerate(x) if seen[one] > 1}
    assert [r["rank"] for r in rows] == list(range(len(rows)))
    tails = [lines[r.t][r.line :] for r in rows]
    assert rows[0].lcp == 0 and all(r.lcp == common(x, y) for r, x, y in zip(rows[1:], tails, tails[1:]))
    # neighbours share the most lines: no suffix shares more with one further off
    for i in range(0, len(rows), 3):
        most = max((common(tails[i], tails[j]) for j in range(len(rows)) if j != i), default=0)
        assert most == max(rows[i].lcp, rows[i + 1].lcp if i + 1 < len(rows) else 0)
    for k in range(1, 5):
        equal = {}
        for r, x in zip(rows, tails):
            if len(x) >= k and (r.lcp >= k or heads[r["rank"]][k - 1] == r["rank"]):
                equal.setdefault(heads[r["rank"]][k - 1], set()).add(tuple(x[:k]))
        assert all(len(v) == 1 for v in equal.values())
    assert (41, 1, 37, 40, 3) in runs or (40, 3, 37, 41, 1) in runs
    for d, i, n, e, j in runs:
        x, y = texts[d].split("\n"), texts[e].split("\n")
        assert x[i : i + n] == y[j : j + n] and common(x[i:], y[j:]) == n and (not i or not j or x[i - 1] != y[j - 1])


def test_lines_of_repeated_rows_and_copies(spark):
    """Rows that repeat, ids that repeat with other texts, rows without an id, and copies of short and of long texts."""
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc"), (2, "q"), (3, "q"), (3, "x\na\nb\nc"), (None, "a\nb\nc"), (4, None), (5, "a\nb")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("name", F.lit(1)).withColumn("first", F.lit(2))
    out = sorted(((r.doc_id, r.text, list(r.removed)) for r in linedups.dedup_lines(d).collect()), key=str)
    want = [(1, "a\nb\nc", []), (1, "a\nb\nc", []), (2, "", [0, 1, 2]), (2, "q", []), (3, "q", []), (3, "x", [1, 2, 3]), (None, "a\nb\nc", []), (4, None, []), (5, "a\nb", [])]
    assert out == sorted(want, key=str)


def test_secret_forest_on_findings_held_out():
    forest = secrets.train_forest(secrets.sample_findings())
    held = secrets.sample_findings(1500, seed=1234)
    right = [(p >= 0.5) == bool(f[4]) for p, f in zip(forest.predict(secrets.np.array([secrets.features(*f[:4]) for f in held])), held, strict=True)]
    assert sum(right) / len(right) > 0.97


def test_secrets_in_texts(docs):
    token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"
    texts = [f'elle token = "{token}" enon', f"commit {token} of the day", *ODD]
    out = {r.doc_id: r.secrets for r in secrets.op8_secret_forest(docs(texts)).collect()}
    assert out[0] == "14:54" and not out[1] and all(not out[i] for i in range(2, 6))
    assert secrets.op8_secret_forest(docs([])).count() == 0


def test_long_and_short_secrets(docs):
    draw = random.Random(3)
    long = "".join(draw.choice("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/") for _ in range(1600))
    texts = [f'private_key = "{long}"', long[:513], long[:512], 'password = "s3cr3tP4ss"', "https://h/x?token=Xy9!kLm2", "password: changeme", "colour = s3cr3tP4ss", "key=key=key=" * 20_000, "keykey" * 20_000 + ":", f"{long}===", *ODD]
    out = {r.doc_id: (r.n_candidates, r.secrets) for r in secrets.op8_secret_forest(docs(texts)).collect()}
    assert [out[i][1] for i in range(5)] == ["15:1615", "0:513", "0:512", "12:22", "18:26"]
    assert out[5] == (1, "") and out[6] == (0, "") and out[7][0] == 1 and out[9] == (0, "")


def test_toxicity_held_out(spark):
    """Labels outside the held-out fold train; in it, clean texts stay and marked ones with known words go."""
    d = "/root/testdata/sf0.1"
    found = queries()["op9_weak_supervision"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out")
    counts = {(r.toxic, r.predicted): r["count"] for r in found.groupBy("toxic", "predicted").count().collect()}
    assert counts.get((0, 1), 0) <= 0.005 * (counts[0, 0] + counts.get((0, 1), 0))
    assert counts[1, 1] / (counts[1, 1] + counts.get((1, 0), 0)) > 0.7


def test_labelled_rows_are_bounded(spark, docs, prose):
    """Rows that share a doc_id, and labels that repeat, count once."""
    d = spark.createDataFrame([(7, f"text {i % 5}", "s") for i in range(500)] + [(i, t, "s") for i, t in enumerate(prose(200, 5, 11), 100)], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(7, 1, 0), (7, 1, 1)] + [(i, 1, 0) for i in range(100, 300)] + [(None, 1, 1), (101, 1, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.labelled_sample(d, labels).collect()
    outside = {i for i in (7, *range(100, 300)) if zlib.crc32(str(i).encode()) % 5}
    assert {r.doc_id for r in rows} == outside and len(rows) == len(outside)
    assert {(bytes(r.text), r.toxic) for r in rows if r.doc_id == 7} == ({(b"text 0", 1)} if 7 in outside else set())
    assert toxicity.labelled_sample(d, labels, 40).count() < 80


def test_vote_patterns_are_summed_as_the_rows_would_be():
    """Counts of patterns give the posteriors and weights of the full matrix of votes."""
    draw = toxicity.np.random.default_rng(4)
    x = (draw.random((400, 6)) < [0.05, 0.2, 0.2, 0.5, 0.02, 0.3]).astype(int)
    x[:, 2] = x[:, 1]
    y = ((x[:, 1] + x[:, 0] > 0) & (draw.random(400) < 0.9)).astype(int)
    seen = {}
    for v, t in zip(x.tolist(), y.tolist(), strict=True):
        key = (tuple(i for i, b in enumerate(v) if b), t)
        seen[key] = seen.get(key, 0) + 1
    one = toxicity.Votes([list(k[0]) for k in seen], [k[1] for k in seen], list(seen.values()), 6)
    every = toxicity.Votes([[i for i, b in enumerate(v) if b] for v in x.tolist()], y.tolist(), [1] * 400, 6)
    (q, w), (p, u) = toxicity.label_model(one), toxicity.label_model(every)
    assert toxicity.np.allclose(w, u) and abs((q * one.counts).sum() - p.sum()) < 1e-6
    by_rows = (x.T @ x).astype(float)
    assert toxicity.np.allclose(one.together(one.counts), by_rows)
    assert toxicity.np.allclose(toxicity.logistic(one, q)[0], toxicity.logistic(every, p)[0])
    assert w[1] > 0 and w[2] > 0 and abs(w[3]) < w[1]


def test_toxicity_without_labels(spark, docs):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.predicted for r in toxicity.op9_weak_supervision(docs(["you idiot moron", "hello there", *ODD]), empty).collect()}
    assert out[0] == 1 and sum(out.values()) == 1
    assert toxicity.op9_weak_supervision(docs([]), empty).count() == 0


@pytest.mark.parametrize("share", [0.0, 0.3, 0.6, 1.0])
def test_mix_meets_targets_with_null_and_repeated_ids(spark, share):
    """Sources come within one document of their targets whatever share of the rows has no doc_id, or one and the same."""
    draw = random.Random(1)
    rows = [(None if draw.random() < share else (7 if draw.random() < share else i), draw.randint(0, 9), "abc"[min(2, int(draw.random() * 4))], i) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, n int, source string, row int")
    found = mixing.mix(df, size=F.col("n"), quality=F.lit(1.0)).selectExpr("doc.row", "doc.source", "size", "source_size", "target", "times").collect()
    assert sorted(r.row for r in found) == list(range(3000)) and all(0 <= r.times <= 3 for r in found)
    for s in "abc":
        own = [r for r in found if r.source == s]
        assert abs(sum(r.size * r.times for r in own) - own[0].target) <= 9
    again = mixing.mix(df, size=F.col("n"), quality=F.lit(1.0)).selectExpr("doc.row", "times").collect()
    assert {r.row: r.times for r in again} == {r.row: r.times for r in found}


def test_tokens_after_an_equals_sign_and_runs_of_token_starts():
    token = "Zm9vYmFyYmF6cXV4Zm9vYmFyYmF6"
    for text in (f"x=https://h/x?sig={token}", f"AWS_CRED={token} next", f"{token}=="):
        assert [text[a:b].rstrip("=") for a, b in secrets.candidates(text)] == [token]
    began = time.perf_counter()
    assert secrets.candidates("x=" + "eyJ" * 333_333) and time.perf_counter() - began < 1
