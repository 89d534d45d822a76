"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

Every word of the lexicon is a voter, and so are patterns of the text.  The label model gives each
voter its rates on toxic and on other texts, by expectation-maximisation in which the given labels
are one more, imperfect voter; voters that still agree with each other within a class share their
weight.  A logistic regression is trained on the posterior labels and scores every text.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_TABLE, saved, small_batches

# Common insults in the languages of the corpus, the seed of the lexicon.
INSULTS = (
    "idiot idiots moron morons stupid dumb imbecile scum trash garbage filth filthy vermin loser losers pathetic worthless "
    "disgusting clown jerk bastard bitch asshole shit fuck fucking damn slut whore freak creep coward liar retard "
    "dumm blöd trottel depp arschloch abschaum müll versager widerlich "
    "connard salaud débile ordure pourriture minable dégoûtant "
    "idiota imbécil estúpido basura escoria patético asqueroso mierda"
).split()

#: Rows of labelled text that are looked at for the lexicon and the models.
MAX_LABELLED = 20_000
#: Words and stems that labelled rows may add to the lexicon.
MAX_MINED = 128
#: Lengths in bytes of the stems that may be lexicon entries; an entry is b"=word" or b"^stem".
STEMS = (4, 5, 6)
HELD_OUT_FOLDS = 5
LABEL_ACCURACY = 0.95
PATTERNS = ("shouting", "exclaims", "symbols", "addresses")
ADDRESS = frozenset(w.encode() for w in "you your yourself du dich dein tu te ton vous eres tú tus".split())


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(HELD_OUT_FOLDS))


def bag(raw: bytes) -> list[bytes]:
    return raw.translate(WORD_TABLE).split()


def entries(words: list[bytes]) -> set[bytes]:
    """What of the words could stand in a lexicon: the words themselves and their stems."""
    distinct = set(words)
    return {b"=" + w for w in distinct} | {b"^" + w[:k] for w in distinct for k in STEMS if len(w) >= k}


class Voters:
    """Which voters vote for a text: one for each lexicon word, then the patterns."""

    def __init__(self, lexicon: list[bytes]) -> None:
        self.lexicon = lexicon
        self.place = {w[1:]: i for i, w in enumerate(lexicon) if w[:1] == b"="}
        self.stems = {w[1:]: i for i, w in enumerate(lexicon) if w[:1] == b"^"}
        self.gates = frozenset(w[: STEMS[0]] for w in self.stems)
        self.known = frozenset(self.place)

    def votes(self, raw: bytes) -> list[int]:
        words = bag(raw)
        distinct = set(words)
        hit = {self.place[w] for w in self.known.intersection(distinct)}
        gates, stems = self.gates, self.stems
        for w in distinct:
            if w[: STEMS[0]] in gates:
                hit.update(stems[w[:k]] for k in STEMS if w[:k] in stems)
        out = sorted(hit)
        n = len(self.lexicon)
        letters = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        small = len(raw) - len(raw.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
        if letters > small:
            out.append(n)
        if raw.count(b"!") * 20 > len(words):
            out.append(n + 1)
        if len(raw) - len(raw.translate(None, b"#$%&*")) > len(words):
            out.append(n + 2)
        if hit and not ADDRESS.isdisjoint(distinct):
            out.append(n + 3)
        return out

    def __len__(self) -> int:
        return len(self.lexicon) + len(PATTERNS)


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: tuple[bytes, ...]
    weights: tuple[float, ...]
    bias: float


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """doc_id, text, toxic of at most about ``limit`` labelled documents outside the held-out fold.

    The sample is by a hash of doc_id, one row for each: of labels that repeat the highest counts,
    of texts that share a doc_id the least one.  Rows without an id, text or label are left out.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).where(fold(F.col("doc_id")) != 0)
    usable = usable.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = usable.count()
    share = min(1.0, limit / max(n, 1))
    pick = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(2**32)) < F.lit(int(share * 2**32))
    texts = docs.where(fold(F.col("doc_id")) != 0).where(pick).where(F.col("text").isNotNull())
    # the labels picked are at most about ``limit`` rows of two numbers
    chosen = texts.select("doc_id", "text").join(F.broadcast(usable.where(pick)), "doc_id")
    return chosen.groupBy("doc_id").agg(F.min("text").cast("binary").alias("text"), F.first("toxic").alias("toxic")).select("doc_id", "text", "toxic")


def mine_lexicon(sample: DataFrame, most: int = MAX_MINED) -> list[bytes]:
    """Words and stems that stand in toxic texts far more often than in others, in many different contexts.

    Counting contexts instead of texts keeps words that came with copies of one text out.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[Counter] = [Counter(), Counter()]
        for batch in batches:
            for raw, toxic in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found[int(toxic > 0)].update(entries(bag(raw)))
        words = list(found[1] | found[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.binary()), pa.array([found[1][w] for w in words], pa.int64()), pa.array([found[0][w] for w in words], pa.int64())], ["word", "pos", "neg"]
        )

    counts = sample.mapInArrow(count, "word binary, pos bigint, neg bigint").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    n, p = F.col("pos") + F.col("neg"), F.col("pos") / (F.col("pos") + F.col("neg"))
    low = (p + 2.0 / n - 2.0 * F.sqrt(p * (1 - p) / n + 1.0 / (n * n))) / (1 + 4.0 / n)
    likely = [bytes(r[0]) for r in counts.where("pos >= 5").withColumn("low", low).where("low >= 0.6").orderBy(F.desc("low"), "word").limit(16 * most).select("word").collect()]
    if not likely:
        return []
    wanted = frozenset(likely)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[bytes, int]] = set()
        for batch in batches:
            for raw, toxic in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = bag(raw) if toxic > 0 else []
                for i, w in enumerate(words):
                    for entry in wanted.intersection(entries([w])):
                        seen.add((entry, zlib.crc32(b" ".join(words[max(i - 1, 0) : i + 2]))))
        pairs = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in pairs], pa.binary()), pa.array([x[1] for x in pairs], pa.int64())], ["word", "context"])

    varied = sample.mapInArrow(contexts, "word binary, context bigint").distinct().groupBy("word").count().where("count >= 5")
    return [bytes(r[0]) for r in varied.orderBy(F.desc("count"), "word").limit(most).select("word").collect()]


class Votes:
    """Distinct (vote pattern, label) with their number of texts; votes are kept as places, not as a matrix."""

    def __init__(self, patterns: list[list[int]], labels: list[int], counts: list[int], voters: int) -> None:
        self.rows = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
        self.cols = np.array([c for p in patterns for c in p], np.int64)
        self.labels, self.counts, self.voters = np.array(labels, float), np.array(counts, float), voters

    def by_voter(self, of_pattern: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, weights=of_pattern[self.rows], minlength=self.voters)

    def by_pattern(self, of_voter: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights=of_voter[self.cols], minlength=len(self.counts))

    def together(self, of_pattern: np.ndarray) -> np.ndarray:
        """For each two voters the sum of ``of_pattern`` over what both vote for; dense only in blocks of patterns."""
        out = np.zeros((self.voters, self.voters))
        for a in range(0, len(self.counts), 1024):
            lo, hi = np.searchsorted(self.rows, [a, a + 1024])
            block = np.zeros((min(1024, len(self.counts) - a), self.voters))
            block[self.rows[lo:hi] - a, self.cols[lo:hi]] = 1
            out += (block.T * of_pattern[a : a + 1024]) @ block
        return out


def label_model(votes: Votes, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each pattern being toxic, and each voter's weight (log of its rate ratio, shared among correlated voters)."""
    labels, counts = votes.labels, votes.counts
    n = counts.sum()
    both = votes.together(counts)
    cast = votes.by_voter(counts)
    q = np.where(labels > 0, 0.9, 0.02)
    factor = np.ones(votes.voters)
    for _ in range(rounds):
        yes, no = q * counts, (1 - q) * counts
        on = (votes.by_voter(yes) + 0.5) / (yes.sum() + 2.0)
        off = (votes.by_voter(no) + 0.05) / (no.sum() + 2.0)
        right = np.clip((yes @ labels + LABEL_ACCURACY) / (yes.sum() + 1), 0.6, 0.99)
        wrong = np.clip((no @ labels + 1 - LABEL_ACCURACY) / (no.sum() + 1), 0.005, 0.4)
        prior = np.clip(yes.sum() / n, 0.005, 0.5)
        weight = np.log(on / off) * factor
        silent = np.log((1 - on) / (1 - off)) * factor
        z = np.log(prior / (1 - prior)) + votes.by_pattern(weight - silent) + silent.sum()
        z = z + np.where(labels > 0, np.log(right / wrong), np.log((1 - right) / (1 - wrong)))
        q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        # correlations of voters within the classes: what the latent label leaves unexplained of
        # votes - q on - (1 - q) off, summed from the pairs of votes and the shares of the classes
        shares = np.stack([q, 1 - q])
        rates = np.stack([on, off])
        toward = np.stack([votes.by_voter(counts * s) for s in shares])
        crossed = toward.T @ rates
        left = both - crossed - crossed.T + rates.T @ ((shares * counts) @ shares.T) @ rates
        spread = cast - 2 * (toward * rates).sum(axis=0) + np.einsum("ij,ik,kj->j", rates, (shares * counts) @ shares.T, rates)
        scale = np.sqrt(np.maximum(spread, 0) / n) + 1e-9
        corr = left / n / np.outer(scale, scale)
        np.fill_diagonal(corr, 0)
        factor = 1 / (1 + np.where(corr > 0.2, corr, 0).sum(axis=1))
    return q, weight


def logistic(votes: Votes, target: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels, by Newton's method."""
    w, bias = np.zeros(votes.voters), 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(votes.by_pattern(w) + bias, -30, 30)))
        slope, miss = (p * (1 - p) + 1e-6) * votes.counts, (p - target) * votes.counts
        edge = votes.by_voter(slope)
        hessian = np.block([[votes.together(slope) + ridge * np.eye(votes.voters), edge[:, None]], [edge[None, :], np.array([[slope.sum() + 1e-3]])]])
        step = np.linalg.solve(hessian, np.append(votes.by_voter(miss) + ridge * w, miss.sum() + 1e-3 * bias))
        w, bias = w - step[:-1], bias - step[-1]
        if np.abs(step).max() < 1e-6:
            break
    return w, float(bias)


def train(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> ToxicityModel:
    """Lexicon, label model and classifier from a bounded sample of labelled rows.

    Without labelled rows the seed lexicon alone scores: any of its words makes a text toxic.  The
    driver gets the distinct vote patterns of the sample with their counts.
    """
    small_batches(docs.sparkSession)
    sample = saved(labelled_sample(docs, labels, limit))
    lexicon = list(dict.fromkeys([b"=" + w.encode() for w in INSULTS] + mine_lexicon(sample)))
    voters = Voters(lexicon)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([voters.votes(r) for r in batch.column(1).to_pylist()], pa.list_(pa.int32())), batch.column(2)], ["votes", "toxic"])

    rows = sample.mapInArrow(vote, "votes array<int>, toxic int").groupBy("votes", "toxic").count().orderBy("votes", "toxic").collect()
    if not rows:
        return ToxicityModel(tuple(lexicon), (6.0,) * len(lexicon) + (0.0,) * len(PATTERNS), -3.0)
    votes = Votes([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], len(voters))
    posterior, _ = label_model(votes)
    weights, bias = logistic(votes, posterior)
    unseen = votes.by_voter(votes.counts) == 0
    seed = np.arange(len(voters)) < len(INSULTS)
    weights = np.where(unseen & seed, 4.0, weights)
    return ToxicityModel(tuple(lexicon), tuple(weights.tolist()), bias)


def score(docs: DataFrame, model: ToxicityModel, *, keep_all: bool = False) -> DataFrame:
    """doc_id and score (0 to 1) of each row; with ``keep_all`` the rows scored under 0.5 in full instead.

    Whole texts are looked at.  Null and empty texts get the score of a text without votes.
    """
    small_batches(docs.sparkSession)
    voters = Voters(list(model.lexicon))
    weights = np.array(model.weights)

    def scored(raws: list) -> list[float]:
        return [float(1 / (1 + np.exp(-np.clip(model.bias + weights[voters.votes(r)].sum(), -30, 30)))) if r else float(1 / (1 + np.exp(-model.bias))) for r in raws]

    if keep_all:
        at = docs.columns.index("text")

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raws = [t.encode() if t else b"" for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(np.array(scored(raws)) < 0.5))

        return docs.mapInArrow(keep, docs.schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scored(batch.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(add, f"doc_id {kind}, score double")


def op9_weak_supervision(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and prediction of each document."""
    found = score(docs, train(docs, labels))
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
