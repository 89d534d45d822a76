"""Personal data by weak supervision, in built-in expressions only.

Patterns propose spans: the four base kinds, which always stand, and looser ones (numbers of
social security, IBANs, local phone numbers, spelled-out addresses, names after a title or a known
given name).  Labelers vote on every span: its format, a checksum, a gazetteer, the words before
it and the characters around it.  Expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is, and a logistic span classifier trained on the posteriors
decides which of the looser spans are added.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

BASE = ("email", "ip", "card", "phone")
LOOSE = ("iban", "localphone", "mailwords", "name", "ssn")
KINDS = BASE + LOOSE

#: Java forms of the patterns.  Possessive quantifiers and the look-behinds give the leftmost matches
#: of the plain patterns in linear time: a match can only begin where a run of its first class does.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "localphone": r"(?<![0-9+)] |[0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "mailwords": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]{1,63} ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sr|Sra|{names})\.? [A-Z][a-z]{1,30}(?: [A-Z][a-z]{1,30})?(?![A-Za-z])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}

# Given names, top-level domains and key words of the gazetteer and context labelers.
GIVEN_NAMES = "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Susan Thomas Sarah Hans Peter Ursula Klaus Monika Jean Marie Pierre Juan Carmen Antonio"
DOMAINS = "com|org|net|edu|gov|io|de|fr|es|uk|eu|info"
CONTEXT = {
    "email": r"e-?mail|contact|write|reach|@",
    "ip": r"\bip\b|host|server|address|login|from",
    "card": r"card|visa|master|credit|payment|karte|carte|tarjeta",
    "phone": r"phone|tel|call|mobile|fax|fon|contact",
    "iban": r"iban|bank|account|konto|compte|cuenta",
    "localphone": r"phone|tel|call|mobile|fax|contact",
    "mailwords": r"e-?mail|contact|write|reach|mail",
    "name": r"name|dear|signed|by|from|regards|author",
    "ssn": r"ssn|social|security|insurance",
}
PATTERNS["name"] = PATTERNS["name"].replace("{names}", GIVEN_NAMES.replace(" ", "|"))
#: A cheap test that every match passes, so that most texts skip the pattern.
NEEDS = {"email": "@", "phone": "+", "ip": ".", "mailwords": "at", "ssn": "-"}
LABELERS = ("format", "checksum", "gazetteer", "context", "edges")
#: What the span classifier sees beside the votes and the kind: yes or no.
TRAITS = ("long", "digits", "capital", "spaced", "ends")
#: Matches whose places are summed in one go.
BLOCK = 64
#: Spans' worth of votes by which a labeler is taken for better than chance before any are counted.
PRIOR_SPANS = 20.0


def _found(text: Column, kind: str) -> Column:
    """Matches of a kind as structs start, end (code points, end exclusive), kind, m, before, after."""
    pattern = F.lit(PATTERNS[kind])
    wanted = F.coalesce(text, F.lit(""))
    test = wanted.contains(NEEDS[kind]) if kind in NEEDS else F.lit(True)
    hits = F.when(test, F.regexp_extract_all(wanted, pattern, F.lit(0)))
    gaps = F.split(wanted, PATTERNS[kind], -1)
    blank = "array<struct<start: int, end: int, kind: string, m: string, before: string, after: string>>"

    def step(acc: Column, pair: Column) -> Column:
        start = acc.at + F.length(pair.g)
        end = start + F.length(pair.m)
        one = F.struct(
            start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), pair.m.alias("m"),
            F.substring(pair.g, -32, 32).alias("before"), F.substring(pair.n, 1, 1).alias("after"),
        )
        return F.struct(end.alias("at"), F.concat(acc.out, F.array(one)).alias("out"))

    # what a lambda takes from outside is evaluated for every element, so pairs are zipped and then bound
    # as the one element of an array; and an array grows by copying, so places are summed first over
    # blocks of matches and then inside each
    pairs = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    pairs = F.zip_with(pairs, F.slice(gaps, F.lit(2), F.size(hits)), lambda p, n: F.struct(p.m.alias("m"), p.g.alias("g"), n.alias("n")))
    cut = lambda whole: F.transform(F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / BLOCK).cast("int")), lambda b: F.slice(whole, b * BLOCK + 1, BLOCK))
    blocks = F.flatten(F.transform(F.array(pairs), cut))
    width = lambda block: F.aggregate(block, F.lit(0), lambda n, p: n + F.length(p.g) + F.length(p.m))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at: int, block: array<struct<m: string, g: string, n: string>>>>").alias("out"))
    begun = F.aggregate(
        blocks, zero, lambda acc, block: F.struct((acc.at + width(block)).alias("at"), F.concat(acc.out, F.array(F.struct(acc.at.alias("at"), block.alias("block")))).alias("out")), lambda acc: acc.out
    )
    inside = lambda x: F.aggregate(x.block, F.struct(x.at.alias("at"), F.array().cast(blank).alias("out")), step, lambda acc: acc.out)
    placed = F.flatten(F.transform(begun, inside))
    return F.when(F.size(F.coalesce(hits, F.array().cast("array<string>"))) > 0, placed).otherwise(F.array().cast(blank))


def _valid(kind: str, m: Column) -> Column:
    """Whether a base match stands: its numbers are in range or its digits pass."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.coalesce(F.call_function("luhn_check", digits), F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "ip":
        return ~m.rlike(r"(^|\.)0*(25[6-9]|2[6-9][0-9]|[3-9][0-9]{2}|[1-9][0-9]{3,})(\.|$)")
    return F.lit(True)


def _test(kind: str) -> Callable[[Column], Column]:
    return lambda s: _valid(kind, s.m)


def _votes(c: Column) -> list[Column]:
    """-1, 0 or 1 of each labeler for a span."""
    digits = F.regexp_replace(c.m, "[^0-9]", "")
    yes = lambda x: F.when(x, 1).otherwise(-1)

    def by_kind(cases: dict[str, Column], other: int = 0) -> Column:
        return reduce(lambda w, kv: w.when(c.kind == kv[0], kv[1]), cases.items(), F.when(F.lit(False), 0)).otherwise(other)

    format_ = by_kind({
        "email": yes(c.m.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[^@]+\.[A-Za-z]{2,24}$")),
        "ip": yes(~c.m.rlike(r"(^|\.)0[0-9]")),
        "card": yes(F.length(digits).isin(13, 14, 15, 16, 19)),
        "phone": yes(F.length(digits).between(10, 14)),
        "name": yes(F.length(c.m) <= 40),
        "ssn": yes(~c.m.rlike(r"^(000|666|9)|-00-|-0000$")),
    }, 1)
    checksum = by_kind({"card": yes(F.coalesce(F.call_function("luhn_check", digits), F.lit(False))), "iban": yes(F.length(c.m).between(15, 34))})
    gazetteer = by_kind({
        "email": yes(c.m.rlike(rf"\.({DOMAINS})$")), "mailwords": yes(c.m.rlike(rf"({DOMAINS})$")),
        "ip": F.when(c.m.rlike(r"^(0|127|255)\."), -1).otherwise(0), "card": F.when(digits.rlike("^[3456]"), 1).otherwise(-1),
        "name": yes(c.m.rlike(rf"^({GIVEN_NAMES.replace(' ', '|')}) ")), "phone": F.when(digits.rlike("^(1|33|34|44|49)"), 1).otherwise(0),
    })
    context = F.when(F.lower(c.before).rlike("x^"), 0)
    for kind, keys in CONTEXT.items():
        context = context.when((c.kind == kind) & F.lower(c.before).rlike(keys), 1)
    edges = F.when((c.before == "") | c.before.rlike(r"[\s(:=|,;]$"), 1).otherwise(-1)
    return [format_, checksum, gazetteer, context.otherwise(0), edges]


def _traits(c: Column) -> list[Column]:
    """Of a span: 12 characters or more, half digits or more, begins with a capital, has a space, stands before an end or mark."""
    digits = F.length(F.regexp_replace(c.m, "[^0-9]", ""))
    tests = [F.length(c.m) >= 12, digits * 2 >= F.length(c.m), c.m.rlike("^[A-Z]"), c.m.contains(" "), (c.after == "") | c.after.rlike(r"[\s.,;:!?)|]")]
    return [F.coalesce(x, F.lit(False)).cast("int") for x in tests]


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base and loose spans with their votes and traits, of each row; the texts are read once.

    Loose spans that overlap a base span are left out.  A null or empty text has no spans.
    """
    text = F.col("text")
    base = F.flatten(F.array(*[F.filter(_found(text, k), _test(k)) for k in BASE]))
    loose = F.flatten(F.array(*[_found(text, k) for k in LOOSE]))
    order = {k: i for i, k in enumerate(KINDS)}
    number = lambda s: reduce(lambda w, kv: w.when(s.kind == kv[0], kv[1]), order.items(), F.when(F.lit(False), 0))
    slim = lambda s: F.struct(s.start.alias("start"), number(s).alias("rank"), s.kind.alias("kind"), s.end.alias("end"), F.array(*_votes(s)).alias("votes"), F.array(*_traits(s)).alias("traits"))
    both = docs.select("doc_id", base.alias("base"), loose.alias("loose"))
    both = both.select("doc_id", F.transform("base", slim).alias("base"), F.transform("loose", slim).alias("loose"))
    return both.select("doc_id", F.array_sort("base").alias("base"), _apart(F.col("base"), F.col("loose")).alias("loose"))


def _apart(base: Column, loose: Column) -> Column:
    """The loose spans that overlap no base span.

    Stretches of the text, about as many as the root of the number of spans, first gather their own loose
    and base spans; a loose span is then compared with those of its stretch only.
    """
    zero = F.lit(0)
    last = F.array_max(F.transform(loose, lambda s: s.start))
    longest = F.array_max(F.transform(loose, lambda s: s.end - s.start))
    stretches = F.ceil(F.sqrt((F.size(base) + F.size(loose)).cast("double"))).cast("int")
    bounds = F.struct(last.alias("last"), longest.alias("longest"), stretches.alias("n"), (F.floor(last / stretches) + 1).cast("int").alias("width"))

    def gather(x: Column, r: Column) -> Column:
        low, high = r * x.width, (r + 1) * x.width
        own = F.filter(loose, lambda s: (s.start >= low) & (s.start < high))
        near = F.filter(base, lambda b: (b.end > low) & (b.start < high + x.longest))
        return F.struct(own.alias("own"), near.alias("near"))

    gathered = F.flatten(F.transform(F.array(bounds), lambda x: F.transform(F.sequence(zero, x.n - 1), lambda r: gather(x, r))))
    kept = F.transform(gathered, lambda g: F.filter(g.own, lambda s: ~F.exists(g.near, lambda b: (b.start < s.end) & (s.start < b.end))))
    return F.when((F.size(base) > 0) & (F.size(loose) > 0), F.flatten(kept)).otherwise(loose)


def estimate(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 50) -> dict[tuple[str, tuple[int, ...]], float]:
    """Posterior that a span is personal data, for each (kind, votes), by expectation-maximisation.

    A labeler has its chances of voting for and against in either class; the classes start from
    the majority of the votes and the prior of a kind from its mean.
    """
    q = {(k, v): 1 / (1 + math.exp(-1.2 * sum(v))) for k, v, _ in patterns}
    for _ in range(rounds):
        totals = [1e-9, 1e-9]
        cast: list[dict[tuple[int, int], float]] = [{}, {}]
        kinds: dict[str, list[float]] = {}
        for k, v, n in patterns:
            for y, share in ((1, q[k, v] * n), (0, (1 - q[k, v]) * n)):
                totals[y] += share
                for j, vote in enumerate(v):
                    cast[y][j, vote] = cast[y].get((j, vote), 0.0) + share
            seen = kinds.setdefault(k, [1.0, 2.0])
            seen[0] += q[k, v] * n
            seen[1] += n
        fresh = {}
        for k, v, _ in patterns:
            prior = kinds[k][0] / kinds[k][1]
            z = math.log(prior / (1 - prior))
            for j, vote in enumerate(v):
                # a labeler is taken for better than chance by a fixed number of spans, which fades as spans are seen
                right = {1: 0.7, 0: 0.2, -1: 0.1}[vote]
                wrong = {1: 0.1, 0: 0.2, -1: 0.7}[vote]
                on = (cast[1].get((j, vote), 0.0) + right * PRIOR_SPANS) / (totals[1] + PRIOR_SPANS)
                off = (cast[0].get((j, vote), 0.0) + wrong * PRIOR_SPANS) / (totals[0] + PRIOR_SPANS)
                z += math.log(on / off) if vote else 0.0
            fresh[k, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        if max(abs(fresh[x] - q[x]) for x in q) < 1e-6:
            return fresh
        q = fresh
    return q


Pattern = tuple[str, tuple[int, ...], tuple[int, ...], int]


def classifier(patterns: list[Pattern], posterior: dict, rounds: int = 400) -> tuple[dict[str, float], list[float]]:
    """A logistic span classifier on kind, votes and traits, fitted to the posteriors by gradient steps.

    Two kinds of spans with the same votes can differ in traits; the classifier so learns from the
    spans themselves what the labelers only stand for.
    """
    kinds = {k: 0.0 for k, _, _, _ in patterns}
    start = [1.0] * len(LABELERS) + [0.0] * len(TRAITS)
    weights = list(start)
    total = float(sum(n for _, _, _, n in patterns)) or 1.0
    for _ in range(rounds):
        by_kind, by_input = dict.fromkeys(kinds, 0.0), [0.0] * len(weights)
        for k, v, t, n in patterns:
            z = kinds[k] + sum(w * x for w, x in zip(weights, v + t, strict=True))
            miss = (posterior[k, v] - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) * n / total
            by_kind[k] += miss
            for j, x in enumerate(v + t):
                by_input[j] += miss * x
        kinds = {k: b + by_kind[k] - 0.001 * b for k, b in kinds.items()}
        weights = [w + g - 0.001 * (w - s) for w, g, s in zip(weights, by_input, start, strict=True)]
    return kinds, weights


def classify(spans: DataFrame) -> DataFrame:
    """``spans`` (see ``find_spans``; saved, as they are read twice) with ``added``: the loose spans that the classifier takes.

    The driver gets one count for each kind, pattern of votes and traits: at most nine times three to
    the fifth times two to the fifth, however many spans there are.
    """
    every = spans.select(F.explode(F.concat("base", "loose")).alias("s")).groupBy(F.col("s.kind").alias("kind"), F.col("s.votes").alias("votes"), F.col("s.traits").alias("traits")).count()
    patterns = [(r[0], tuple(r[1]), tuple(r[2]), r[3]) for r in every.orderBy("kind", "votes", "traits").collect()]
    by_votes: dict[tuple[str, tuple[int, ...]], int] = {}
    for k, v, _, n in patterns:
        by_votes[k, v] = by_votes.get((k, v), 0) + n
    kinds, weights = classifier(patterns, estimate([(k, v, n) for (k, v), n in by_votes.items()])) if patterns else ({}, [1.0] * len(LABELERS) + [0.0] * len(TRAITS))

    def accept(s: Column) -> Column:
        b = F.when(F.lit(False), F.lit(0.0))
        for k, v in kinds.items():
            b = b.when(s.kind == k, F.lit(float(v)))
        z = b.otherwise(0.0)
        inputs = F.concat(s.votes, s.traits)
        for j, w in enumerate(weights):
            z = z + F.lit(float(w)) * F.get(inputs, F.lit(j))
        return z > 0

    return spans.withColumn("added", F.filter("loose", accept))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def op2_weak_labels(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of each document.

    Null and empty texts have no spans; repeated rows, also of one doc_id or none, each give a row;
    columns besides doc_id and text are not looked at; no rows, no rows.
    """
    found = classify(saved(find_spans(docs)))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("base", "added"))).alias("spans"))
