"""Word shingles of whole texts as 64-bit fingerprints, computed for a batch of texts at once."""

from __future__ import annotations

import numpy as np

#: A-Z to a-z and the white space of the contract (0x09-0x0D) to a space.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if 0x09 <= b <= 0x0D else b for b in range(256))
WORDS = 5
#: Texts are hashed in groups of about so many bytes, which bounds memory.
GROUP_BYTES = 1_000_000

_BASE = 0x9E3779B97F4A7C55
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
_STEP = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of all texts in order, and how many words come before each text (and in all)."""
    joined = b" ".join(raws) + b" "
    buf = np.frombuffer(joined, np.uint8)
    offsets = np.zeros(len(raws) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raws], out=offsets[1:])
    edges = np.flatnonzero(np.diff((buf != 0x20).view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _STEP[0])
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(texts: list[bytes | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle fingerprints of each text; none for a null text or one without words.

    A text of fewer words than a shingle has its whole sequence as one.  Fingerprints are 64 bits
    wide, so two different shingles count as one with a chance of 2**-64 a pair.
    """
    out: list[np.ndarray] = []
    group: list[bytes] = []
    filled = 0
    for text in texts:
        raw = (text or b"").translate(LOWER)
        if group and filled + len(raw) > GROUP_BYTES:
            out += _group_sets(group, words)
            group, filled = [], 0
        group.append(raw)
        filled += len(raw)
    return out + _group_sets(group, words) if group else out


def _group_sets(raws: list[bytes], words: int) -> list[np.ndarray]:
    hashes, first = _word_hashes(raws)
    n = len(hashes) - words + 1
    if n > 0:
        rolled = np.zeros(n, np.uint64)
        for j in range(words):
            rolled += hashes[j : j + n] * _STEP[j]
        rolled = mixed(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            parts = np.append(hashes[a:b] * _STEP[: b - a], np.uint64(b - a))
            out.append(mixed(parts.sum(dtype=np.uint64, keepdims=True)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(shingles: np.ndarray) -> int:
    """A 64-bit name of the set, as a signed number; equal sets have equal names."""
    spread = mixed(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    total = np.append(spread, np.array([len(shingles)], np.uint64) * _STEP[1]).sum(dtype=np.uint64, keepdims=True)
    return int(mixed(total).view(np.int64)[0])
