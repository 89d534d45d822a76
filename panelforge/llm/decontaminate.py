"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton is built from the items' words once and broadcast (items up to a checked size,
else in blocks).  Each document's words are streamed through it; the length of the longest
match that ends at a word tells which windows of an item occur there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_TABLE, small_batches

WINDOW = 10
#: Bytes of item text whose automaton one task may hold; more items are searched block by block.
BLOCK_BYTES = 2_000_000
#: Bytes of documents that a task searches for one block after the other, where there are several.
ROUND_BYTES = 32_000_000


def word_list(text: bytes) -> list[bytes]:
    """Words of the contract: runs of digits, letters and non-ASCII bytes, A-Z lower-cased."""
    return text.translate(WORD_TABLE).split()


class SuffixAutomaton:
    """All word sequences of all items; see ``hits`` for what a document's words match."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.vocab: dict[bytes, int] = {}
        ids = [[self.vocab.setdefault(w, len(self.vocab)) for w in words] for _, words in items]
        for seq in ids:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        #: state -> items with a window of which the state stands for
        self.full: dict[int, set[str]] = {}
        #: state -> (words, item) of items shorter than a window
        self.short: dict[int, list[tuple[int, str]]] = {}
        for (name, _), seq in zip(items, ids, strict=True):
            if not seq:
                continue
            if len(seq) < window:
                state = self._find(seq)
                self.short.setdefault(state, []).append((len(seq), name))
                continue
            state, matched = 0, 0
            for c in seq:
                state, matched = self._step(state, matched, c)
                while self.length[self.link[state]] >= window:
                    state = self.link[state]
                matched = min(matched, self.length[state])
                if matched >= window:
                    self.full.setdefault(state, set()).add(name)
        #: nearest state on the way to the root, itself included, that ends a short item
        self.ends = [0] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.ends[s] = s if s in self.short else self.ends[self.link[s]]
        sizes = [min(len(seq), window) for seq in ids if seq]
        self.least = min(sizes, default=0)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = self._state(length[last] + 1, {})
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p < 0:
            link[cur] = 0
        else:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _state(self, length: int, nxt: dict[int, int]) -> int:
        self.next.append(nxt)
        self.link.append(0)
        self.length.append(length)
        return len(self.link) - 1

    def _find(self, seq: list[int]) -> int:
        state = 0
        for c in seq:
            state = self.next[state][c]
        return state

    def _step(self, state: int, matched: int, c: int) -> tuple[int, int]:
        while state and c not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        if c in self.next[state]:
            return self.next[state][c], matched + 1
        return 0, 0

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans [start, end) of words inside occurring windows, and the items they are of.

        A match cannot hold a word that no item has, so only runs of known words are streamed.
        """
        get, least = self.vocab.get, self.least
        if not least or len(words) < least:
            return [], set()
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        for a, b in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            if b - a >= least:
                self._run(ids[a:b].tolist(), a, spans, found)
        return spans, found

    def _run(self, ids: list[int], base: int, spans: list[tuple[int, int]], found: set[str]) -> None:
        window, length, link = self.window, self.length, self.link
        state = matched = 0
        for i, c in enumerate(ids):
            state, matched = self._step(state, matched, c)
            reach = 0
            at = state
            while at and length[link[at]] >= window:
                at = link[at]
            if min(matched, length[at]) >= window:
                reach = window
                found |= self.full.get(at, set())
            end = self.ends[state]
            while end:
                for k, name in self.short[end]:
                    if k <= matched:
                        reach = max(reach, k)
                        found.add(name)
                end = self.ends[link[end]]
            if reach:
                start, stop = base + i + 1 - reach, base + i + 1
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, stop))


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[list[tuple[str, bytes]]]:
    """The items in blocks of at most ``block_bytes`` of text (an item longer than that is a block).

    Items without an id or text match nothing and are left out.
    """
    blocks: list[list[tuple[str, bytes]]] = [[]]
    filled = 0
    rows = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string"), "text").toLocalIterator()
    for name, text in rows:
        raw = text.encode()
        if filled + len(raw) > block_bytes and blocks[-1]:
            blocks.append([])
            filled = 0
        blocks[-1].append((name, raw))
        filled += len(raw)
    return blocks


_BUILT: dict[tuple[bytes, int], SuffixAutomaton] = {}


def _automaton(block: list[tuple[str, bytes]], window: int) -> SuffixAutomaton:
    """Built once in a Python worker for the block and reused by its later tasks."""
    mark = (hashlib.sha256(repr(block).encode()).digest(), window)
    if mark not in _BUILT:
        _BUILT.clear()
        _BUILT[mark] = SuffixAutomaton([(n, word_list(t)) for n, t in block], window)
    return _BUILT[mark]


def _rounds(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    """The batches; with several blocks joined to ``ROUND_BYTES``, so that automata are rebuilt seldom."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if blocks < 2 or sum(b.nbytes for b in held) >= ROUND_BYTES:
            yield pa.concat_batches(held) if len(held) > 1 else held[0]
            held = []
    if held:
        yield pa.concat_batches(held)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def match_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans (word ranges inside occurring windows) and items of each row of ``docs``.

    A null text has no words; repeated rows each give a row; no items, no spans.  Blocks of items
    are searched one after the other by the same task, so that documents are read once.
    """
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    shared = [sc.broadcast(block) for block in item_blocks(benchmark, block_bytes)]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _rounds(batches, len(shared)):
            raws = batch.column(1).to_pylist()
            counts = [0] * len(raws)
            spans: list[list[tuple[int, int]]] = [[] for _ in raws]
            items: list[set[str]] = [set() for _ in raws]
            for block in shared:
                automaton = _automaton(block.value, window)
                for i, raw in enumerate(raws):
                    words = word_list(raw or b"")
                    got, names = automaton.hits(words)
                    counts[i] = len(words)
                    spans[i] += got
                    items[i] |= names
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(counts, pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in _merged(s)] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array([sorted(i) for i in items], pa.list_(pa.string())),
                ],
                ["doc_id", "n_words", "spans", "items"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        search, f"doc_id {kind}, n_words bigint, spans array<struct<start: bigint, end: bigint>>, items array<string>"
    )


def cut_words(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of ``spans``; what stands between two cut words goes with them."""
    flags = np.frombuffer(raw.translate(WORD_TABLE), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*out, raw[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, max_coverage: float = 0.8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without benchmark passages: hit words are cut from the text.

    A document of which more than ``max_coverage`` of the words are hit goes altogether.  Others
    keep all columns; text loses the spans and n_chars, if there, is counted again.  Documents
    without hits pass unchanged, null and empty texts included.
    """
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    shared = [sc.broadcast(block) for block in item_blocks(benchmark, block_bytes)]
    at = docs.columns.index("text")
    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _rounds(batches, len(shared)):
            texts = batch.column(at).to_pylist()
            sizes = batch.column(counted).to_pylist() if counted is not None else []
            keep = np.ones(len(texts), bool)
            hit: dict[int, list[tuple[int, int]]] = {}
            for block in shared:
                automaton = _automaton(block.value, window)
                for i, text in enumerate(texts):
                    if text and (found := automaton.hits(word_list(text.encode()))[0]):
                        hit.setdefault(i, []).extend(found)
            for i, found in hit.items():
                raw = texts[i].encode()
                spans = _merged(found)
                keep[i] = sum(b - a for a, b in spans) <= max_coverage * len(word_list(raw))
                texts[i] = cut_words(raw, spans).decode()
                if sizes:
                    sizes[i] = len(texts[i])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if counted is not None:
                columns[counted] = pa.array(sizes, batch.schema.field(counted).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep))

    return docs.mapInArrow(clean, docs.schema)


def op5_suffix_automaton(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Hit words and occurring items of each document."""
    found = match_spans(docs, benchmark)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.end - s.start)
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


ORACLE = rf"""
WITH b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item, least(len(ws), {WINDOW}) AS k, array_to_string(ws[i : i + least(len(ws), {WINDOW}) - 1], ' ') AS gram
  FROM (SELECT item, ws, unnest(generate_series(1, greatest(len(ws) - {WINDOW - 1}, 1))) AS i FROM b WHERE len(ws) > 0)),
d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT rid, k, i, array_to_string(ws[i : i + k - 1], ' ') AS gram
  FROM (SELECT rid, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM d, ks WHERE len(ws) >= k)),
hits AS (SELECT rid, i, bw.k, item FROM dw JOIN bw ON dw.k = bw.k AND dw.gram = bw.gram),
hw AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(generate_series(i, i + k - 1)) AS p FROM hits) GROUP BY rid),
hi AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(hw.n, 0)::BIGINT AS n_hit, coalesce(hi.n, 0)::BIGINT AS n_items,
       sha256(coalesce(hi.items, '')) AS items_sha256, coalesce(hw.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)
"""
