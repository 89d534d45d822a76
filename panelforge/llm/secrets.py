"""Secret scans: patterns propose findings, a random forest removes the false positives.

Features of a finding are the length and the character transitions of the candidate, how much of it
dictionary words cover, its path (source) and the words beside it.  The forest is trained from
labelled findings.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Runs that could be secrets: known prefixes and long tokens.
#: Runs are taken whole (possessive), and a JSON web token begins where a run does, so a text takes time in proportion to its length.
#: An equals sign before a run, as in ``?sig=`` and ``CRED=``, is no part of it.
CANDIDATE = re.compile(
    r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]*+"
    r"|(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}(?![A-Za-z0-9+/_=-])"
)

# Words that stand beside secrets, beside harmless tokens, and in place of secrets.
KEYS = "key secret token password passwd pwd apikey api_key auth credential bearer private access".split()
HARMLESS = "sha1 sha256 md5 commit checksum digest hash uuid etag revision version integrity id".split()
PLACEHOLDERS = "example sample dummy test changeme placeholder your xxxx todo".split()
DICTIONARY = frozenset(
    "the and for that with this from have are not was his they one all word but what some can out other were your when use how said each she which their time will way about many then them write "
    "would like these her long make thing see him two has look more day could come did number sound most people my over know water than call first who may down side been now find any new work part "
    "take get place made live where after back little only round man year came show every good give our under name very through just form sentence great think say help low line differ turn cause much "
    "mean before move right boy old too same tell does set three want air well also play small end put home read hand port large spell add even land here must big high such follow act why ask men change "
    "went light kind off need house picture try again animal point mother world near build self earth father string config default value path user admin server client data file".split()
)
#: A value assigned to a key word: what ends before the separator, the separator, and the value on its line.
KEYED = re.compile(rf"(?:{'|'.join(sorted(KEYS, key=len, reverse=True))})[\w-]*[\"'`\])]*[ \t]*$", re.IGNORECASE)
SEPARATOR = re.compile("[:=]")
VALUE = re.compile(r"[:=>]*[ \t]*[\"'`]?([^\s\"'`,;]+)")
#: Bytes that stand in candidates; others become spaces.
TOKEN_TABLE = bytes(b if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=." else 0x20 for b in range(256))
LEAST = 15
CLASSES = ("lower", "upper", "digit", "symbol")
FEATURES = ("length", "entropy", "hex", *(f"{a}_{b}" for a in CLASSES for b in CLASSES), "covered", "key_before", "harmless_before", "placeholder", "assigned", "quoted", "prefix", "path_code", "distinct")
CONTEXT = 32


def _class(c: str) -> int:
    return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3


def assigned_values(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the values of any length, up to white space or a quote, that are assigned to a key word."""
    at = 0
    while m := SEPARATOR.search(text, at):
        at = m.end()
        if KEYED.search(text[max(0, m.start() - CONTEXT) : m.start()]) and (value := VALUE.match(text, at)):
            yield value.span(1)
            at = value.end()


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of the matches of CANDIDATE and, where none of them lies, of assigned values."""
    found = []
    if max(map(len, text.encode().translate(TOKEN_TABLE).split()), default=0) >= LEAST:  # else CANDIDATE has none
        found = [m.span() for m in CANDIDATE.finditer(text)]
    more, at = [], 0
    for a, b in assigned_values(text):
        while at < len(found) and found[at][1] <= a:
            at += 1
        if at == len(found) or found[at][0] >= b:
            more.append((a, b))
    return sorted(found + more)


def covered_share(candidate: str) -> float:
    """The share of the candidate's characters that dictionary words of four letters or more cover, longest first."""
    text, n, i = candidate.lower(), 0, 0
    while i < len(text):
        size = next((k for k in range(min(10, len(text) - i), 3, -1) if text[i : i + k] in DICTIONARY), 0)
        n += size
        i += size or 1
    return n / max(len(text), 1)


def features(candidate: str, before: str, after: str, path: str) -> list[float]:
    n = len(candidate)
    kinds = [_class(c) for c in candidate]
    steps = [0.0] * 16
    for a, b in zip(kinds, kinds[1:], strict=False):
        steps[4 * a + b] += 1 / max(n - 1, 1)
    counts = {c: candidate.count(c) for c in set(candidate)}
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    near, low = before.lower(), candidate.lower()
    return [
        float(n), entropy, float(all(c in "0123456789abcdefABCDEF" for c in candidate)), *steps, covered_share(candidate),
        float(any(k in near for k in KEYS)), float(any(re.search(rf"\b{k}\b", near) for k in HARMLESS)), float(any(k in low for k in PLACEHOLDERS)),
        float(bool(re.search(r"[:=]\s*[\"']?$", before))), float(bool(re.search(r"[\"']$", before)) and after[:1] in "\"'" and after != ""),
        float(bool(re.match(r"AKIA|ASIA|gh[pousr]_|xox[abprs]-|eyJ", candidate))), float(bool(re.search(r"\.(env|ya?ml|json|ini|conf|py|js|tf)$", path.lower()))), len(counts) / n,
    ]


def sample_findings(n: int = 4000, seed: int = 7) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings (candidate, before, after, path, label) as reviews give them, drawn at random.

    Secrets are random strings of the usual alphabets behind a key word; false positives are digests
    and identifiers, long compounds of words, repeated characters and placeholders.
    """
    draw = random.Random(seed)
    alphabets = ["0123456789abcdef", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-"]
    words = sorted(w for w in DICTIONARY if len(w) > 3)
    syllables = "th er on an re he in ed nd ha at en es or nt ti ou is it sch ung keit ment eau tion ción ado".replace("ó", "o").split()
    paths = ["app/config.yaml", "settings.py", ".env", "src1", "notes.md", "README", ""]
    out = []
    for _ in range(n):
        some = lambda a, lo, hi: "".join(draw.choice(a) for _ in range(draw.randint(lo, hi)))
        quote = draw.choice(['"', '"', "'", ""])
        if draw.random() < 0.5:
            kind = draw.random()
            value = "AKIA" + some(alphabets[1], 16, 16) if kind < 0.1 else "ghp_" + some(alphabets[2], 36, 36) if kind < 0.2 else some(draw.choice(alphabets), 20, 64)
            key = draw.choice(KEYS) + draw.choice(["", "_id", "_value"])
            bare = kind < 0.2 and draw.random() < 0.5
            out.append((value, some(syllables, 1, 3) + " " if bare else f"{draw.choice(['', 'my_', 'the '])}{key} {draw.choice(['=', ':', ' = '])} {quote}".replace("  ", " "), quote if not bare else " ", draw.choice(paths), 1))
        else:
            kind = draw.randrange(6)
            value = [
                some(alphabets[0], 40, 40), some(words, 4, 8), some(syllables, 8, 20), draw.choice("x*0aA-") * draw.randint(16, 40), draw.choice(PLACEHOLDERS) + some(words, 3, 5),
                "-".join(some(alphabets[0], k, k) for k in (8, 4, 4, 4, 12)),
            ][kind]
            value = value if len(value) >= 16 else value * 4
            marked = kind in (0, 5)
            before = f"{draw.choice(HARMLESS)}{draw.choice([' ', ': ', '='])}" if marked else f"{draw.choice(KEYS)} = {quote}" if kind in (3, 4) else some(syllables, 1, 4) + " "
            out.append((value, before, quote if not marked and kind in (3, 4) else " ", draw.choice(paths), 0))
    return out


@dataclass(frozen=True)
class Forest:
    """Trees as flat arrays: feature (-1 in a leaf), threshold, left, right, share of secrets."""

    trees: tuple[tuple[np.ndarray, ...], ...]

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, right, share in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                inner = np.flatnonzero(feature[at] >= 0)
                if not len(inner):
                    break
                node = at[inner]
                goes = x[inner, feature[node]] <= threshold[node]
                at[inner] = np.where(goes, left[node], right[node])
            total += share[at]
        return total / max(len(self.trees), 1)


def _tree(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int) -> tuple[np.ndarray, ...]:
    nodes: list[list[float]] = []

    def grow(rows: np.ndarray, level: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, 0, 0, float(y[rows].mean())])
        best = None
        if level < depth and len(rows) >= 2 * least and 0 < y[rows].mean() < 1:
            for f in rng.choice(x.shape[1], max(1, int(math.sqrt(x.shape[1]))), replace=False):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v, ones = x[order, f], np.cumsum(y[order])
                cut = np.flatnonzero(v[1:] > v[:-1])
                cut = cut[(cut + 1 >= least) & (len(rows) - cut - 1 >= least)]
                if not len(cut):
                    continue
                n = cut + 1.0
                p, q = ones[cut] / n, (ones[-1] - ones[cut]) / (len(rows) - n)
                gini = n * p * (1 - p) + (len(rows) - n) * q * (1 - q)
                k = int(np.argmin(gini))
                if best is None or gini[k] < best[0]:
                    best = (gini[k], f, v[cut[k]])
        if best is not None:
            goes = x[rows, best[1]] <= best[2]
            nodes[me][:2] = [best[1], best[2]]
            nodes[me][2] = grow(rows[goes], level + 1)
            nodes[me][3] = grow(rows[~goes], level + 1)
        return me

    grow(rng.integers(0, len(x), len(x)), 0)
    kinds = (np.int64, float, np.int64, np.int64, float)
    return tuple(np.array([node[i] for node in nodes], kind) for i, kind in enumerate(kinds))


def train_forest(findings: list[tuple[str, str, str, str, int]], trees: int = 40, depth: int = 10, least: int = 2, seed: int = 11) -> Forest:
    """A random forest on the labelled findings; without any it takes every finding."""
    if not findings:
        return Forest(((np.array([-1]), np.zeros(1), np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1)),))
    x = np.array([features(*f[:4]) for f in findings])
    y = np.array([float(f[4]) for f in findings])
    rng = np.random.default_rng(seed)
    return Forest(tuple(_tree(x, y, rng, depth, least) for _ in range(trees)))


def scan_secrets(docs: DataFrame, forest: Forest, threshold: float = 0.5) -> DataFrame:
    """doc_id, n_candidates and findings (start, end in code points, score) of each row.

    Whole texts are scanned.  Null and empty texts have none; a null source is an empty path;
    repeated rows each give a row.
    """
    small_batches(docs.sparkSession)
    fields = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, rows = [], []
            for i, (text, path) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for a, b in candidates(text or ""):
                    spans.append((i, a, b))
                    rows.append(features(text[a:b], text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT], path or ""))
            scores = forest.predict(np.array(rows)) if rows else []
            counts = [0] * batch.num_rows
            found: list[list[dict]] = [[] for _ in counts]
            for (i, a, b), s in zip(spans, scores, strict=True):
                counts[i] += 1
                if s >= threshold:
                    found[i].append({"start": a, "end": b, "score": float(s)})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, pa.list_(fields))], ["doc_id", "n_candidates", "findings"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "source").mapInArrow(scan, f"doc_id {kind}, n_candidates bigint, findings array<struct<start: bigint, end: bigint, score: double>>")


def op8_secret_forest(docs: DataFrame) -> DataFrame:
    """Candidates and findings of each document."""
    found = scan_secrets(docs, train_forest(sample_findings()))
    return found.select(
        "doc_id", "n_candidates", F.size("findings").cast("long").alias("n_secrets"),
        F.array_join(F.transform("findings", lambda f: F.concat_ws(":", f.start.cast("string"), f.end.cast("string"))), ",").alias("secrets"),
        F.round(F.array_max(F.transform("findings", lambda f: f.score)), 6).alias("best_score"),
    )
