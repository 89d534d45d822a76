"""The 101 published formulaic signals, in the vocabulary of :mod:`panelforge.functions.ops`.

Inputs are lagged by one row, but for the delay-0 formulas (42, 48, 53, 54), which read the row
itself.  Where the usual implementation of a formula and its publication differ, the former is the
default: the decay weighs the oldest row most, 47 raises -1 to the price (``PAPER[47]`` has 1 / C).
"""

from __future__ import annotations

from ..functions.dag import Node
from ..functions.ops import (
    absolute, coalesce, col, correlation, covariance, decay_linear, delay, delta, flag, indneutralize, ln, lt, maxn, minn, null, nullif0,
    parity, product, rank, scale, sign, signedpower, stddev, ts_argmax, ts_argmin, ts_max, ts_mean, ts_min, ts_rank, ts_sum, where,
)

O0, H0, L0, C0, V0, A0 = (col(c) for c in ("open", "high", "low", "close", "volume", "amount"))
O, H, L, C, V, A, R, MV = (delay(col(c), 1) for c in ("open", "high", "low", "close", "volume", "amount", "logret", "mcap"))
VW0 = A0 / V0
VW = delay(VW0, 1)
SEC, IND, SUB = col("sector"), col("industry"), col("subindustry")
HL = (H + L) * 0.5


def adv(n: int) -> Node:
    return delay(ts_mean(V0, n), 1)


def blend(x: Node, y: Node, w: float) -> Node:
    return x * w + y * (1 - w)


def _slope() -> Node:
    """The change of the ten-row slopes of the close."""
    return (delay(C, 20) - delay(C, 10)) / 10 - (delay(C, 10) - C) / 10


def _swing(d: Node, w: int) -> Node:
    """d while it keeps its sign over w rows, else -d."""
    return where((ts_min(d, w) > 0) | (ts_max(d, w) < 0), d, -d)


_MID, _SD, _PAIR = ts_sum(C, 8) / 8, stddev(C, 8), ts_sum(C, 2) / 2
_CLV = (C - L - (H - C)) / nullif0(H - L) * V
_VOL_RANGE = (H - L) / (ts_sum(C, 5) / 5)
_MIX73 = 0.147155 * O + 0.852845 * L
_TURN8 = ts_sum(O, 5) * ts_sum(R, 5)

FORMULAS: dict[int, Node] = {
    1: rank(ts_argmax(signedpower(where(R < 0, stddev(R, 20), C), 2), 5)) - 0.5,
    2: -correlation(rank(delta(ln(V), 2)), rank((C - O) / O), 6),
    3: -correlation(rank(O), rank(V), 10),
    4: -ts_rank(rank(L), 9),
    5: rank(O - ts_sum(VW, 10) / 10) * -absolute(rank(C - VW)),
    6: -correlation(O, V, 10),
    7: where(adv(20) < V, -ts_rank(absolute(delta(C, 7)), 60) * sign(delta(C, 7)), -1.0),
    8: -rank(_TURN8 - delay(_TURN8, 10)),
    9: _swing(delta(C, 1), 5),
    10: rank(_swing(delta(C, 1), 4)),
    11: (rank(ts_max(VW - C, 3)) + rank(ts_min(VW - C, 3))) * rank(delta(V, 3)),
    12: sign(delta(V, 1)) * -delta(C, 1),
    13: -rank(covariance(rank(C), rank(V), 5)),
    14: -rank(delta(R, 3)) * correlation(O, V, 10),
    15: -ts_sum(rank(correlation(rank(H), rank(V), 3)), 3),
    16: -rank(covariance(rank(H), rank(V), 5)),
    17: -rank(ts_rank(C, 10)) * rank(delta(delta(C, 1), 1)) * rank(ts_rank(V / adv(20), 5)),
    18: -rank(stddev(absolute(C - O), 5) + (C - O) + correlation(C, O, 10)),
    19: -sign(C - delay(C, 7) + delta(C, 7)) * (1 + rank(1 + ts_sum(R, 250))),
    20: -rank(O - delay(H, 1)) * rank(O - delay(C, 1)) * rank(O - delay(L, 1)),
    21: where(_MID + _SD < _PAIR, -1.0, where(_PAIR < _MID - _SD, 1.0, where(V / adv(20) >= 1, 1.0, -1.0))),
    22: -delta(correlation(H, V, 5), 5) * rank(stddev(C, 20)),
    23: where(ts_sum(H, 20) / 20 < H, -delta(H, 2), 0.0),
    24: coalesce(where(delta(ts_sum(C, 100) / 100, 100) / delay(C, 100) <= 0.05, -(C - ts_min(C, 100)), null()), -delta(C, 3)),
    25: rank(-1 * R * adv(20) * VW * (H - C)),
    26: -ts_max(correlation(ts_rank(V, 5), ts_rank(H, 5), 5), 3),
    27: where(rank(ts_sum(correlation(rank(V), rank(A / V), 6), 2) / 2) > 0.5, -1.0, 1.0),
    28: scale(correlation(adv(20), L, 5) + HL - C),
    29: ts_min(rank(scale(ln(ts_sum(ts_min(ts_rank(rank(rank(-delta(C, 1))), 2), 5), 2)))), 5) + ts_rank(delay(-R, 6), 5),
    30: (1.0 - rank(sign(C - delay(C, 1)) + sign(delay(C, 1) - delay(C, 2)) + sign(delay(C, 2) - delay(C, 3)))) * (ts_sum(V, 5) / ts_sum(V, 20)),
    31: rank(rank(rank(decay_linear(-rank(rank(delta(C, 10))), 10)))) + rank(-delta(C, 3)) + sign(scale(correlation(adv(20), L, 12))),
    32: scale(ts_sum(C, 7) / 7 - C) + 20.0 * scale(correlation(VW, delay(C, 5), 230)),
    33: rank(O / C - 1.0),
    34: rank(1.0 - rank(stddev(R, 2) / stddev(R, 5)) + (1.0 - rank(delta(C, 1)))),
    35: ts_rank(V, 32) * (1.0 - ts_rank(C + H - L, 16)) * (1.0 - ts_rank(R, 32)),
    36: 2.21 * rank(correlation(C - O, delay(V, 1), 15)) + 0.7 * rank(O - C) + 0.73 * rank(ts_rank(delay(-R, 6), 5)) + rank(absolute(correlation(VW, adv(20), 6)))
    + 0.6 * rank((ts_sum(C, 200) / 200 - O) * (C - O)),
    37: rank(correlation(delay(O - C, 1), C, 200)) + rank(O - C),
    38: -rank(ts_rank(C, 10)) * rank(C / O),
    39: -rank(delta(C, 7) * (1.0 - rank(decay_linear(V / adv(20), 9)))) * (1.0 + rank(ts_sum(R, 250))),
    40: -rank(stddev(H, 10)) * correlation(H, V, 10),
    41: (H * L) ** 0.5 - VW,
    42: rank(VW0 - C0) / rank(VW0 + C0),
    43: ts_rank(V / adv(20), 20) * ts_rank(-delta(C, 7), 8),
    44: -correlation(H, rank(V), 5),
    45: -(rank(ts_sum(delay(C, 5), 20) / 20) * correlation(C, V, 2) * rank(correlation(ts_sum(C, 5), ts_sum(C, 20), 2))),
    46: where(_slope() > 0.25, -1.0, where(_slope() < 0, 1.0, -(C - delay(C, 1)))),
    47: rank(parity(C)) * (V / adv(20)) * (H * rank(H - C) / (ts_sum(H, 5) / 5)) - rank(VW - delay(VW, 5)),
    48: indneutralize(correlation(delta(C0, 1), delta(delay(C0, 1), 1), 250) * delta(C0, 1) / C0, SUB) / nullif0(ts_sum((delta(C0, 1) / delay(C0, 1)) ** 2, 250)),
    49: where(_slope() < -0.1, 1.0, -(C - delay(C, 1))),
    50: -ts_max(rank(correlation(rank(V), rank(VW), 5)), 5),
    51: where(_slope() < -0.05, 1.0, -(C - delay(C, 1))),
    52: (-ts_min(L, 5) + delay(ts_min(L, 5), 5)) * rank((ts_sum(R, 240) - ts_sum(R, 20)) / 220.0) * ts_rank(V, 5),
    53: -delta((C0 - L0 - (H0 - C0)) / (C0 - L0 + 1e-09), 9),
    54: -((L0 - C0) * signedpower(O0, 5)) / nullif0((L0 - H0) * signedpower(C0, 5)),
    55: -correlation(rank((C - ts_min(L, 12)) / nullif0(ts_max(H, 12) - ts_min(L, 12))), rank(V), 6),
    56: -rank(ts_sum(R, 10) / ts_sum(ts_sum(R, 2), 3)) * rank(R * MV),
    57: -(C - VW) / nullif0(decay_linear(rank(ts_argmax(C, 30)), 2)),
    58: -ts_rank(decay_linear(correlation(indneutralize(VW, SEC), V, 3), 7), 5),
    59: -ts_rank(decay_linear(correlation(indneutralize(VW, IND), V, 4), 16), 8),
    60: -(2 * scale(rank(_CLV)) - scale(rank(ts_argmax(C, 10)))),
    61: lt(rank(VW - ts_min(VW, 16)), rank(correlation(VW, adv(180), 17))),
    62: -lt(rank(correlation(VW, ts_sum(adv(20), 22), 9)), rank(lt(2 * rank(O), rank(HL) + rank(H)))),
    63: -(rank(decay_linear(delta(indneutralize(C, IND), 2), 8)) - rank(decay_linear(correlation(blend(VW, O, 0.318108), ts_sum(adv(180), 37), 13), 12))),
    64: -lt(rank(correlation(ts_sum(blend(O, L, 0.178404), 12), ts_sum(adv(120), 12), 16)), rank(delta(blend(HL, VW, 0.178404), 3))),
    65: -lt(rank(correlation(blend(O, VW, 0.00817205), ts_sum(adv(60), 8), 6)), rank(O - ts_min(O, 13))),
    66: -(rank(decay_linear(delta(VW, 3), 7)) + ts_rank(decay_linear((L - VW) / nullif0(O - HL), 11), 6)),
    67: -(rank(H - ts_min(H, 2)) ** rank(correlation(indneutralize(VW, SEC), indneutralize(adv(20), SUB), 6))),
    68: -lt(ts_rank(correlation(rank(H), rank(adv(15)), 8), 13), rank(delta(blend(C, L, 0.518371), 1))),
    69: -(rank(ts_max(delta(indneutralize(VW, IND), 2), 4)) ** ts_rank(correlation(blend(C, VW, 0.490655), adv(20), 4), 9)),
    70: -(rank(delta(VW, 1)) ** ts_rank(correlation(indneutralize(C, IND), adv(50), 17), 17)),
    71: maxn(ts_rank(decay_linear(correlation(ts_rank(C, 3), ts_rank(adv(180), 12), 18), 4), 15), ts_rank(decay_linear(rank(L + O - 2 * VW) ** 2, 16), 4)),
    72: rank(decay_linear(correlation(HL, adv(40), 8), 10)) / nullif0(rank(decay_linear(correlation(ts_rank(VW, 3), ts_rank(V, 18), 6), 2))),
    73: -maxn(rank(decay_linear(delta(VW, 4), 2)), ts_rank(decay_linear(-delta(_MIX73, 2) / nullif0(_MIX73), 3), 16)),
    74: -lt(rank(correlation(C, ts_sum(adv(30), 37), 15)), rank(correlation(rank(blend(H, VW, 0.0261661)), rank(V), 11))),
    75: lt(rank(correlation(VW, V, 4)), rank(correlation(rank(L), rank(adv(50)), 12))),
    76: -maxn(rank(decay_linear(delta(VW, 1), 11)), ts_rank(decay_linear(ts_rank(correlation(indneutralize(L, SEC), adv(81), 8), 19), 17), 19)),
    77: minn(rank(decay_linear(HL - VW, 20)), rank(decay_linear(correlation(HL, adv(40), 3), 5))),
    78: rank(correlation(ts_sum(blend(L, VW, 0.352233), 19), ts_sum(adv(40), 19), 6)) ** rank(correlation(rank(VW), rank(V), 5)),
    79: lt(rank(delta(indneutralize(blend(C, O, 0.60733), SEC), 1)), rank(correlation(ts_rank(VW, 3), ts_rank(adv(150), 9), 14))),
    80: -(rank(sign(delta(indneutralize(blend(O, H, 0.868128), IND), 4))) ** ts_rank(correlation(H, adv(10), 5), 5)),
    81: -lt(rank(ln(product(rank(rank(correlation(VW, ts_sum(adv(10), 49), 8)) ** 4), 14))), rank(correlation(rank(VW), rank(V), 5))),
    82: -minn(rank(decay_linear(delta(O, 1), 14)), ts_rank(decay_linear(correlation(indneutralize(V, SEC), O, 17), 6), 13)),
    83: rank(delay(_VOL_RANGE, 2)) * rank(rank(V)) / nullif0(_VOL_RANGE / (VW - nullif0(C))),
    84: signedpower(ts_rank(VW - ts_max(VW, 15), 20), delta(C, 4)),
    85: rank(correlation(blend(H, C, 0.876703), adv(30), 9)) ** rank(correlation(ts_rank(HL, 3), ts_rank(V, 10), 7)),
    86: -lt(ts_rank(correlation(C, ts_sum(adv(20), 14), 6), 20), rank(O + C - (VW + O))),
    87: -maxn(rank(decay_linear(delta(0.369701 * C + 0.630299 * VW, 1), 2)), ts_rank(decay_linear(absolute(correlation(indneutralize(adv(81), IND), C, 13)), 4), 14)),
    88: minn(rank(decay_linear(rank(O) + rank(L) - (rank(H) + rank(C)), 8)), ts_rank(decay_linear(correlation(ts_rank(C, 8), ts_rank(adv(60), 20), 8), 6), 2)),
    89: ts_rank(decay_linear(correlation(L, adv(10), 6), 5), 3) - ts_rank(decay_linear(delta(indneutralize(VW, IND), 3), 10), 15),
    90: -(rank(C - ts_max(C, 4)) ** ts_rank(correlation(indneutralize(adv(40), SUB), L, 5), 3)),
    91: -(ts_rank(decay_linear(decay_linear(correlation(indneutralize(C, IND), V, 9), 16), 3), 4) - rank(decay_linear(correlation(VW, adv(30), 4), 2))),
    92: minn(ts_rank(decay_linear(flag(HL + C < L + O), 14), 18), ts_rank(decay_linear(correlation(rank(L), rank(adv(30)), 7), 6), 6)),
    93: ts_rank(decay_linear(correlation(indneutralize(VW, IND), adv(81), 17), 19), 7) / nullif0(rank(decay_linear(delta(blend(C, VW, 0.524434), 2), 16))),
    94: -(rank(VW - ts_min(VW, 11)) ** ts_rank(correlation(ts_rank(VW, 19), ts_rank(adv(60), 4), 18), 2)),
    95: lt(rank(O - ts_min(O, 12)), ts_rank(rank(correlation(ts_sum(HL, 19), ts_sum(adv(40), 19), 12)) ** 5, 11)),
    96: -maxn(ts_rank(decay_linear(correlation(rank(VW), rank(V), 3), 4), 8), ts_rank(decay_linear(ts_argmax(correlation(ts_rank(C, 7), ts_rank(adv(60), 4), 3), 12), 14), 13)),
    97: -(rank(decay_linear(delta(indneutralize(blend(L, VW, 0.721001), IND), 3), 20)) - ts_rank(decay_linear(ts_rank(correlation(ts_rank(L, 7), ts_rank(adv(60), 17), 4), 18), 15), 6)),
    98: rank(decay_linear(correlation(VW, ts_sum(adv(5), 26), 4), 7)) - rank(decay_linear(ts_rank(ts_argmin(correlation(rank(O), rank(adv(15)), 20), 8), 6), 8)),
    99: -lt(rank(correlation(ts_sum(HL, 19), ts_sum(adv(60), 19), 8)), rank(correlation(L, V, 6))),
    100: -((1.5 * scale(indneutralize(rank(_CLV), SUB)) - scale(indneutralize(correlation(C, rank(adv(20)), 5) - rank(ts_argmin(C, 30)), SUB))) * V / nullif0(adv(20))),
    101: (C - O) / (H - L + 0.001),
}

PAPER: dict[int, Node] = {47: rank(1.0 / C) * (V / adv(20)) * (H * rank(H - C) / (ts_sum(H, 5) / 5)) - rank(VW - delay(VW, 5))}

#: Formulas of the single-leg market, which has no capitalisation and no delay-0 group.
SINGLE_LEG = tuple(n for n in FORMULAS if n not in (42, 48, 53, 54, 56))


def masked(n: int, sample: Node | None = None) -> Node:
    """A formula where the row is in the sample, else null."""
    f = FORMULAS[n]
    return f if sample is None else where(sample, f, null())

