import hashlib
import random
import re

import regex
from pyspark.sql import functions as F

from panelforge.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
FIXED = [
    None, "", "a@b.c_x@d.e mail", "a@b.c@d.e", "..@a.b..c", "1.2.3.4.5.6.7.8.9", "0001.02.255.256 1.1.1.1", "+1 (743) 555-3824", "4111 1111 1111 1111", "4111-1111-1111-1111 5", "+12 3..",
    "++1234567890+1234567890", "é😀 a@b.co é +49 (30) 1234567", "x" * 5000 + "@", "a@" + "a." * 3000 + "a", "a@b.co,c@d.co\r\ne@f.co", "1" * 30,
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text):
    out = []
    for i, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), i, kind, m.end()))
    return sorted(out)


def test_base_spans_equal_brute_force(docs):
    draw = random.Random(1)
    texts = FIXED + ["".join(draw.choice("a1.@+ -()59é_%b0") for _ in range(draw.randint(1, 60))) for _ in range(800)]
    d = docs(texts).withColumn("base", F.lit(1)).withColumn("spans", F.lit("own"))
    for r in pii.op2_weak_labels(d).collect():
        want = base_spans(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), texts[r.doc_id]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[2] == k for s in want) for k in PLAIN)
        assert set(joined.split(",")) <= set(r.spans.split(","))


def test_method_adds_spans(docs):
    texts = ["Dear John Smith, my SSN 123-45-6789 and phone (743) 555-3824", "mail me: joe [at] site [dot] com", "plain words only"] + ["card 4111 1111 1111 1111 mail a@b.com"] * 5
    spans = {r.doc_id: r.spans for r in pii.op2_weak_labels(docs(texts)).collect()}
    assert "ssn:" in spans[0] and "localphone:" in spans[0] and "mailwords:" in spans[1] and spans[2] == ""


def test_no_rows(docs):
    assert pii.op2_weak_labels(docs([])).count() == 0


def test_reliabilities_follow_the_votes():
    patterns = [("email", (1, 0, 1, 1, 1), 50), ("email", (-1, 0, -1, 0, -1), 50), ("ssn", (1, 0, 0, 1, 1), 10)]
    q = pii.estimate(patterns)
    assert q["email", (1, 0, 1, 1, 1)] > 0.9 > 0.1 > q["email", (-1, 0, -1, 0, -1)]


def test_the_prior_of_labelers_fades():
    """A labeler that votes against what all others say is found out once there are many spans, not with few."""
    few = [("email", (1, 1, 1, 1, -1), 3), ("email", (-1, -1, -1, -1, 1), 3)]
    many = [(k, v, n * 10_000) for k, v, n in few]
    lone = ("ssn", (0, 0, 0, 0, -1), 1)
    assert pii.estimate([*many, lone])["ssn", lone[1]] > pii.estimate([*few, lone])["ssn", lone[1]]


def test_the_classifier_learns_traits():
    good, none = (1, 0, 0, 0, 0), (0, 0, 0, 0, 0)
    patterns = [("ssn", good, (1, 1, 0, 0, 1), 500), ("ssn", good, (0, 0, 0, 0, 0), 20), ("ssn", none, (1, 1, 0, 0, 1), 20), ("ssn", none, (0, 0, 0, 0, 0), 500)]
    _, weights = pii.classifier(patterns, {("ssn", good): 0.95, ("ssn", none): 0.05})
    assert weights[len(pii.LABELERS)] > 0.3


def test_many_matches_have_right_places(docs):
    """Thousands of spans of a text, over many blocks."""
    text = " ".join(f"u{i}@h{i}.org, 10.0.{i % 256}.{i % 7}" for i in range(1500))
    r = pii.op2_weak_labels(docs([text])).first()
    want = base_spans(text)
    assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in want).encode()).hexdigest() and r.n_email == r.n_ip == 1500


def loose_by_hand(text, base):
    """Matches of the loose patterns that overlap no base span, kind by kind."""
    found = [(m.start(), m.end(), k) for k in pii.LOOSE for m in regex.finditer(pii.PATTERNS[k], text)]
    return sorted(s for s in found if not any(b.start < s[1] and s[0] < b.end for b in base))


def test_loose_spans_are_those_apart_from_base_ones(spark):
    draw = random.Random(4)
    bits = [
        "a@b.com", "123-45-6789", "DE12ABCDEFGHIJK34567", "(212) 555-0199", "me at home", "joe [at] site.org", "Dr. Anna Smith", "Mary Jones", "10.0.0.1", "4111 1111 1111 1111", "+49 (0) 30 123-45-6789",
        "é\U0001f600", "word",
    ]
    texts = [" ".join(draw.choice(bits) for _ in range(n)) for n in (1, 3, 10, 60, 400)] + ["".join(f"a{i}@b.com {100 + i % 800}-45-6789 " for i in range(600)), "no spans", ""]
    rows = pii.find_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert sorted((s.start, s.end, s.kind) for s in r.loose) == loose_by_hand(texts[r.doc_id], r.base), r.doc_id
