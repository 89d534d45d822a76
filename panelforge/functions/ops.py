"""The vocabulary of formulas: one function for each operator, over :class:`Node`."""

from __future__ import annotations

from math import floor

from .dag import Node, Number

make = Node.make


def col(name: str) -> Node:
    return make("col", params=(name,))


def _w(d: Number) -> int:
    """Windows may be given as fractions; they count whole rows."""
    return int(floor(d))


# ---- per ticker
def delay(x: Node, d: Number) -> Node: return make("delay", x, params=(_w(d),))
def delta(x: Node, d: Number) -> Node: return x - delay(x, d)
def ts_sum(x: Node, w: Number) -> Node: return make("ts_sum", x, params=(_w(w),))
def ts_mean(x: Node, w: Number) -> Node: return make("ts_mean", x, params=(_w(w),))
def ts_min(x: Node, w: Number) -> Node: return make("ts_min", x, params=(_w(w),))
def ts_max(x: Node, w: Number) -> Node: return make("ts_max", x, params=(_w(w),))
def stddev(x: Node, w: Number) -> Node: return make("ts_std", x, params=(_w(w),))
def product(x: Node, w: Number) -> Node: return make("ts_product", x, params=(_w(w),))
def ts_argmax(x: Node, w: Number) -> Node: return make("ts_argmax", x, params=(_w(w),))
def ts_argmin(x: Node, w: Number) -> Node: return make("ts_argmin", x, params=(_w(w),))
def ts_rank(x: Node, w: Number) -> Node: return make("ts_rank", x, params=(_w(w),))
def correlation(x: Node, y: Node, w: Number) -> Node: return make("ts_corr", x, y, params=(_w(w),))
def covariance(x: Node, y: Node, w: Number) -> Node: return make("ts_cov", x, y, params=(_w(w),))
def rolling_beta(x: Node, y: Node, w: Number) -> Node: return make("ts_beta", x, y, params=(_w(w),))
def ts_mean_frac(x: Node, w: Number) -> Node: return make("ts_mean_frac", x, params=(_w(w),))
def ts_std_frac(x: Node, w: Number) -> Node: return make("ts_std_frac", x, params=(_w(w),))
def fwd_sum(x: Node, h: Number) -> Node: return make("fwd_sum", x, params=(_w(h),))
def ffill(x: Node, limit: int = 0) -> Node: return make("ffill", x, params=(limit,))
def cum_count(x: Node) -> Node: return make("cum_count", x)


def decay_linear(x: Node, w: Number, newest_heaviest: bool = False) -> Node:
    """Weighted mean of a window; by default the oldest row weighs most."""
    return make("ts_decay", x, params=(_w(w), newest_heaviest))


# ---- per date
def rank(x: Node) -> Node: return make("rank", x)
def rank_ordinal(x: Node) -> Node: return make("rank_ordinal", x)
def scale(x: Node) -> Node: return make("scale", x)
def cs_mean(x: Node) -> Node: return make("cs_mean", x)
def cs_sum(x: Node) -> Node: return make("cs_sum", x)
def zscore(x: Node, least: int = 2, sample: bool = True) -> Node: return make("zscore", x, params=(least, sample))
def indneutralize(x: Node, group: Node) -> Node: return make("neutral", x, group)


# ---- per row
def ln(x: Node) -> Node: return make("ln", x)
def sign(x: Node) -> Node: return make("sign", x)
def absolute(x: Node) -> Node: return make("abs", x)
def tanh(x: Node) -> Node: return make("tanh", x)
def signedpower(x: Node, a: Node | Number) -> Node: return sign(x) * make("pow", absolute(x), a)
def where(cond: Node, yes: Node | Number, no: Node | Number) -> Node: return make("if", cond, yes, no)
def lt(a: Node, b: Node) -> Node: return make("flag", a < b)
def flag(cond: Node) -> Node: return make("flag", cond)
def maxn(a: Node, b: Node) -> Node: return make("maxn", a, b)
def minn(a: Node, b: Node) -> Node: return make("minn", a, b)
def coalesce(a: Node, b: Node | Number) -> Node: return make("coalesce", a, b)
def nullif0(x: Node) -> Node: return make("nullif0", x)
def known(x: Node) -> Node: return make("known", x)
def null() -> Node: return make("null")
def parity(x: Node) -> Node: return make("parity", x)
def div_eps(a: Node, b: Node) -> Node: return make("div_eps", a, b)
def clip(x: Node, low: float, high: float) -> Node: return make("clip", x, params=(low, high))
