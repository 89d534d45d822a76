"""The 24 base features of a daily panel."""

from __future__ import annotations

from .dag import Node
from .ops import col, correlation, delay, delta, div_eps, ln, nullif0, stddev, ts_mean, ts_sum

EPS = 1e-12
O, H, L, C, V, VWAP = (col(x) for x in ("open", "high", "low", "close", "volume", "vwap"))
R = col("logret")
LV = ln(nullif0(V))
DV = C * V
RNG = H - L
MOM = {w: ts_sum(R, w) for w in (3, 5, 10, 20, 60)}
RV = {w: stddev(R, w) for w in (10, 20, 60)}

FEATURES: dict[str, Node] = {
    **{f"mom_{w}": x for w, x in MOM.items()},
    "accel_5_20": MOM[5] - MOM[20],
    "rev_1": -delay(R, 1),
    "rev_3": -MOM[3],
    "rev_5": -MOM[5],
    "gap_rev": -ln(div_eps(O, delay(C, 1))),
    **{f"rv_{w}": x for w, x in RV.items()},
    "vol_shock_10_60": div_eps(RV[10] - RV[60], RV[60]),
    "vol_of_vol_20": div_eps(stddev(RV[20], 20), ts_mean(RV[20], 20)),
    "range_1": ln(div_eps(H, L)),
    "lvol_z_20": div_eps(LV - ts_mean(LV, 20), stddev(LV, 20)),
    "dvol": ln(DV),
    "amihud": div_eps(Node.make("abs", R), DV),
    "vol_trend": ts_mean(LV, 5) - ts_mean(LV, 20),
    "pv_corr_20": correlation(R, delta(LV, 1), 20),
    "close_vwap": div_eps(C - VWAP, C),
    "close_vwap_range": div_eps(C - VWAP, RNG),
    "clv": div_eps(2 * C - H - L, RNG),
}
assert len(FEATURES) == 24
