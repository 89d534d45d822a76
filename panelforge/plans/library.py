"""Operators over panels, cross-sections, signals and tables, each a query with a DuckDB twin.

``panel_query`` registers expressions over a panel; ``sql_query`` registers relational text in which
``{name}`` stands for a table or for a set of signals and which both engines run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.dag import DUCK, SPARK, Dialect, Node, compute, duck_sql
from ..functions.distributions import t_tail
from ..functions.features import FEATURES
from ..functions.ops import (
    absolute, clip, coalesce, col, correlation, covariance, cs_mean, cum_count, decay_linear, delay, delta, ffill, flag, fwd_sum, indneutralize, known, null, product, rank,
    rank_ordinal, rolling_beta, scale, sign, signedpower, stddev, ts_argmax, ts_argmin, ts_max, ts_mean, ts_mean_frac, ts_min, ts_rank, ts_std_frac, ts_sum, where, zscore,
)
from ..operators.panel import COLUMNS, MONTH, NATION_WEEK, WEEK, PanelSpec, load_panel, panel_ctes
from .catalog import panel_query, register, rounded
from .formulas import FORMULAS

C, V, A, R, H, L, O = (col(x) for x in ("close", "volume", "amount", "logret", "high", "low", "open"))
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

# ---------------------------------------------------------------- panels and windows of a ticker

#: Capitalisations are reported in millions, within the digits that a float's sixth decimal needs.
BARS = {c: col(c) for c in COLUMNS if c != "mcap"} | {"mcap_millions": col("mcap") / 1e6}
panel_query("panel_month", MONTH, BARS)
panel_query("panel_week_dense", WEEK, BARS)
panel_query("adv_ladder", NATION_WEEK, {f"adv{n}": delay(ts_mean(V, n), 1) for n in (5, 10, 15, 20, 30, 40, 50, 60, 81, 120, 150, 180)})
for _name, _node in {
    "ts_delay": delay(C, 3), "ts_delta": delta(C, 3), "ts_sum": ts_sum(V, 10), "ts_mean": ts_mean(C, 10), "ts_min": ts_min(L, 10), "ts_max": ts_max(H, 10),
    "ts_std": stddev(C, 10), "ts_corr": correlation(O, V, 10), "ts_cov": covariance(C, V, 5), "ts_product": product(1 + coalesce(R, 0.0), 10),
    "ts_argmax": ts_argmax(C, 10), "ts_argmin": ts_argmin(C, 10), "ts_rank": ts_rank(C, 10), "ts_decay": decay_linear(C, 8), "ts_decay_newest": decay_linear(C, 8, True),
    "ts_mean_frac80": ts_mean_frac(C, 10), "ts_std_frac80": ts_std_frac(C, 10), "rolling_z": (C - ts_mean(C, 20)) / (stddev(C, 20) + 1e-12),
    "rolling_beta": rolling_beta(delay(R, 1), delay(cs_mean(R), 1), 20), "fwd_sum_strict": fwd_sum(R, 5), "ffill_limit3": ffill(C, 3), "returns": C / delay(C, 1) - 1,
    "running_max_drawdown": C / ts_max(C, 20) - 1,
}.items():
    panel_query(_name, WEEK if _name in ("ffill_limit3", "ts_mean_frac80", "ts_std_frac80") else MONTH, {"value": _node})

# ---------------------------------------------------------------- cross-sections

for _name, _node in {
    "cs_rank": rank(C), "cs_rank_ordinal": rank_ordinal(V), "cs_rank_centered": rank(V) - 0.5, "cs_scale": scale(C - cs_mean(C)), "cs_indneutralize": indneutralize(C, col("industry")),
    "cs_zscore": zscore(C), "cs_zscore_population": zscore(C, 2, False), "cs_zscore_gated": zscore(C, 99), "cs_z_clip": clip(zscore(R), -3.0, 3.0), "signedpower_pow": signedpower(R, 0.5) + rank(C) ** absolute(R),
    "mixed_depth": rank(correlation(rank(C), rank(V), 6)),
}.items():
    panel_query(_name, MONTH, {"value": _node})

panel_query("features24", NATION_WEEK, FEATURES)
_liquid = ts_sum(coalesce(delay(A, 1), 0.0), 10) / 10
_count = ts_sum(flag(known(delay(A, 1))), 10)
panel_query(
    "universe_liquid_listed", WEEK,
    {"liquid": flag((where(_count >= 7, _liquid, null()) >= 40000.0)), "listed": flag(cum_count(C) >= 60), "in_sample": flag((where(_count >= 7, _liquid, null()) >= 40000.0) & (cum_count(C) >= 60))},
)
panel_query("universe_active_lagged", WEEK, {"in_sample": delay(flag((ts_mean(coalesce(A, 0.0), 20) > 30000.0) & (cum_count(C) >= 30) & (C > 0)), 1)})

# ---------------------------------------------------------------- relational text

SIGNALS: dict[str, Node] = {"s1": FORMULAS[3], "s2": FORMULAS[4], "s3": FORMULAS[12], "s4": FORMULAS[33], "s5": FORMULAS[101], "y": fwd_sum(R, 1), "y5": fwd_sum(R, 5)}
GRAM = ("s1", "s2", "s4", "s5", "y5")
FACTORS = ("s1", "s2", "s3", "s4", "s5")
KEPT = ("close", "volume", "amount", "logret", "mcap", "sector", "industry")
_frames: dict[str, tuple[PanelSpec, dict[str, Node], tuple[str, ...]]] = {
    "signals": (NATION_WEEK, SIGNALS, KEPT),
    "month": (MONTH, {"prev": delay(C, 1)}, (*KEPT, "open", "high", "low", "vwap")),
}


def sql_query(name: str, text: Callable[[Dialect], str]) -> None:
    uses = [f for f in _frames if f"{{{f}}}" in text(SPARK)]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        body = text(SPARK)
        frames = {f: compute(load_panel(spark, sf_dir, _frames[f][0]), _frames[f][1], keep=_frames[f][2]) for f in uses}
        frames |= {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in body}
        return spark.sql(body, **frames)

    register(name, query, duck_text(text(DUCK), uses))


def duck_text(body: str, uses: list[str]) -> str:
    """``body`` for DuckDB, with the panels that it ``uses`` as common table expressions before its own."""
    ctes: list[str] = []
    for f in uses:
        spec, outputs, keep = _frames[f]
        more, final = duck_sql("panel", outputs, keep=keep)
        ctes += [*panel_ctes(spec, None), *more, f"{f} AS ({final})"]
    for t in (*TABLES, *uses):
        body = body.replace(f"{{{t}}}", t)
    start = next((w for w in ("WITH RECURSIVE", "WITH") if body.lstrip().upper().startswith(w)), "")
    if not ctes:
        return body
    return f"{start or 'WITH'} {', '.join(ctes)}{',' if start else ''} {body.lstrip()[len(start):]}"


def corr(x: str, y: str) -> str:
    """Pearson correlation of a group, null where a side is constant."""
    both = f"FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
    return f"CASE WHEN stddev_samp({x}) {both} > 1e-12 AND stddev_samp({y}) {both} > 1e-12 THEN covar_samp({x}, {y}) / (stddev_samp({x}) {both} * stddev_samp({y}) {both}) END"


def melted(d: Dialect, source: str, columns: tuple[str, ...], more: str) -> str:
    """Long form: a row for each of the columns."""
    if d.spark:
        pairs = ", ".join(f"named_struct('factor', '{c}', 'x', {c})" for c in columns)
        return f"(SELECT {more}, factor, x FROM {source} LATERAL VIEW inline(array({pairs})) e AS factor, x)"
    return f"(SELECT {more}, e.factor, e.x FROM {source} CROSS JOIN LATERAL (VALUES {', '.join(f'({chr(39)}{c}{chr(39)}, {c})' for c in columns)}) e(factor, x))"


def quantile(d: Dialect, x: str, q: float) -> str:
    return f"percentile({x}, {q!r}D)" if d.spark else f"quantile_cont({x}, {q!r})"


def _ic(d: Dialect, spearman: bool = False) -> str:
    """Common table expression ic(factor, date, ic): factor against the next return on each date."""
    valid = f"SELECT date, ticker, factor, x, y FROM {melted(d, '{signals}', FACTORS, 'date, ticker, y')} m WHERE x IS NOT NULL AND y IS NOT NULL"
    if spearman:
        r = lambda c: f"rank() OVER (PARTITION BY factor, date ORDER BY round({c}, 9)) + (count(*) OVER (PARTITION BY factor, date ORDER BY round({c}, 9) RANGE BETWEEN CURRENT ROW AND CURRENT ROW) - 1) / CAST(2 AS DOUBLE)"
        valid = f"SELECT date, factor, {r('x')} AS x, {r('y')} AS y FROM ({valid})"
    return f"ic AS (SELECT factor, date, {corr('x', 'y')} AS ic, count(*) AS n FROM ({valid}) GROUP BY factor, date)"


sql_query("ic_pearson", lambda d: f"WITH {_ic(d)} SELECT factor, date, n, {rounded('ic')} AS ic FROM ic")
sql_query("ic_spearman", lambda d: f"WITH {_ic(d, True)} SELECT factor, date, n, {rounded('ic')} AS ic FROM ic")
sql_query("ic_flagship", lambda d: f"WITH {_ic(d)} SELECT date, n, {rounded('ic')} AS ic FROM ic WHERE factor = 's1'")
sql_query("ic_summary", lambda d: f"""WITH {_ic(d, True)}
SELECT factor, count(ic) AS n, {rounded('avg(ic)')} AS mean, {rounded('stddev_samp(ic)')} AS sd, {rounded('avg(ic) / nullif(stddev_samp(ic), 0)')} AS ir,
       {rounded('avg(CASE WHEN round(ic, 9) > 0 THEN CAST(1 AS DOUBLE) WHEN ic IS NOT NULL THEN CAST(0 AS DOUBLE) END)')} AS positive, {rounded('avg(ic) / nullif(stddev_samp(ic) / sqrt(count(ic)), 0)')} AS t_classic
FROM ic GROUP BY factor""")  # fmt: skip


def _newey_west(lags: int) -> str:
    """nw(factor, n, mean, se): Bartlett weights over the series without its gaps."""
    lagged = ", ".join(f"lag(u, {k}) OVER (PARTITION BY factor ORDER BY date) AS u{k}" for k in range(1, lags + 1))
    terms = " + ".join(f"2 * (1 - {k} / CAST({lags + 1} AS DOUBLE)) * coalesce(sum(u * u{k}), 0)" for k in range(1, lags + 1))
    return f"""dev AS (SELECT factor, date, ic, ic - avg(ic) OVER (PARTITION BY factor) AS u FROM ic WHERE ic IS NOT NULL),
lagged AS (SELECT *, {lagged} FROM dev),
nw AS (SELECT factor, count(*) AS n, avg(ic) AS mean, sqrt(greatest((sum(u * u) + {terms}) / count(*), 0) / count(*)) AS se FROM lagged GROUP BY factor)"""


def _hac(lags: int) -> str:
    """hac(factor, n, mean, se): lags count rows of the calendar, each covariance scaled by n / (n - lag)."""
    lagged = ", ".join(f"lag(u, {k}) OVER (PARTITION BY factor ORDER BY date) AS u{k}" for k in range(1, lags + 1))
    terms = " + ".join(f"2 * (1 - {k} / CAST({lags + 1} AS DOUBLE)) * coalesce(avg(u * u{k}), 0) * count(u) / greatest(count(u) - {k}, 1)" for k in range(1, lags + 1))
    return f"""grid AS (SELECT f.factor, c.date FROM (SELECT DISTINCT factor FROM ic) f CROSS JOIN (SELECT DISTINCT date FROM ic) c),
dev AS (SELECT g.factor, g.date, ic, ic - avg(ic) OVER (PARTITION BY g.factor) AS u FROM grid g LEFT JOIN ic ON ic.factor = g.factor AND ic.date = g.date),
lagged AS (SELECT *, {lagged} FROM dev),
hac AS (SELECT factor, count(u) AS n, avg(ic) AS mean, sqrt(greatest((avg(u * u) + {terms}) / nullif(count(u), 0), 0)) AS se FROM lagged GROUP BY factor)"""


sql_query("nw_tstat", lambda d: f"WITH {_ic(d)}, {_newey_west(10)} SELECT factor, n, {rounded('mean')} AS mean, {rounded('mean / nullif(se, 0)')} AS t FROM nw")
sql_query("hac_se", lambda d: f"WITH {_ic(d)}, {_hac(5)} SELECT factor, n, {rounded('mean')} AS mean, {rounded('se')} AS se, {rounded('mean / nullif(se, 0)')} AS t FROM hac")
sql_query("acf_lags", lambda d: f"""WITH {_ic(d)}, {_newey_west(5)}
SELECT factor, {', '.join(rounded(f'sum(u * u{k}) / nullif(sum(u * u), 0)') + f' AS acf{k}' for k in range(1, 6))}, {rounded('1.96 / sqrt(count(*))')} AS bound FROM lagged GROUP BY factor""")  # fmt: skip
sql_query("alpha_corr_matrix", lambda d: "SELECT " + ", ".join(f"{rounded(corr(a, b))} AS {a}_{b}" for i, a in enumerate(FACTORS) for b in FACTORS[i + 1 :]) + " FROM {signals}")
sql_query("long_zero_run", lambda d: f"""WITH {_ic(d)},
roll AS (SELECT factor, date, CASE WHEN count(ic) OVER w = 20 THEN avg(ic) OVER w END AS m, row_number() OVER (PARTITION BY factor ORDER BY date) AS i FROM ic
         WINDOW w AS (PARTITION BY factor ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
runs AS (SELECT factor, i - row_number() OVER (PARTITION BY factor ORDER BY date) AS island FROM roll WHERE abs(m) < 0.05)
SELECT factor, max(n) AS longest FROM (SELECT factor, island, count(*) AS n FROM runs GROUP BY factor, island) GROUP BY factor""")  # fmt: skip
sql_query("screen_gates", lambda d: f"""WITH {_ic(d)},
pos AS (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY date) AS i, count(*) OVER (PARTITION BY factor) AS t FROM ic WHERE ic IS NOT NULL),
agg AS (SELECT factor, count(*) AS n_full, count(CASE WHEN i > floor(t * 0.7) THEN 1 END) AS n_oos, avg(ic) AS m_full, avg(CASE WHEN i <= floor(t * 0.7) THEN ic END) AS m_is,
        avg(CASE WHEN i > floor(t * 0.7) THEN ic END) AS m_oos, avg(CASE WHEN i > floor(t * 0.7) THEN ic END) / nullif(stddev_samp(CASE WHEN i > floor(t * 0.7) THEN ic END) / sqrt(count(CASE WHEN i > floor(t * 0.7) THEN 1 END)), 0) AS t_oos
        FROM pos GROUP BY factor)
SELECT factor, n_full, n_oos, {rounded('m_full')} AS m_full, {rounded('m_is')} AS m_is, {rounded('m_oos')} AS m_oos,
       n_full >= 250 AND n_oos >= 100 AND (sign(m_full) = sign(m_oos) OR m_oos = 0) AND abs(m_oos) >= 0.0005 AS passed, {rounded('t_oos * 1e6 + abs(m_oos) * 1e4')} AS score FROM agg""")  # fmt: skip

# ---------------------------------------------------------------- standardising, neutralising, weights

sql_query("cs_winsor_z_clip", lambda d: f"""WITH q AS (SELECT date, {quantile(d, 'logret', 0.01)} AS lo, {quantile(d, 'logret', 0.99)} AS hi FROM {{month}} WHERE logret IS NOT NULL GROUP BY date),
w AS (SELECT m.date, m.ticker, CASE WHEN logret IS NOT NULL THEN least(greatest(logret, lo), hi) END AS x, logret FROM {{month}} m LEFT JOIN q ON q.date = m.date),
z AS (SELECT date, ticker, (x - avg(x) OVER (PARTITION BY date)) / nullif(stddev_samp(x) OVER (PARTITION BY date), 0) AS z, CASE WHEN x <> logret THEN 1 ELSE 0 END AS changed FROM w)
SELECT date, ticker, {rounded('CASE WHEN z IS NOT NULL THEN least(greatest(z, -3), 3) END')} AS z, changed FROM z""")  # fmt: skip
sql_query("cs_beta_neutral", lambda d: f"""WITH f AS (SELECT date, ticker, x, b, avg(x) OVER w AS mx, avg(b) OVER w AS mb, covar_samp(x, b) OVER w AS c, var_samp(b) OVER w AS v
 FROM (SELECT date, ticker, logret AS x, ln(mcap) AS b FROM {{month}} WHERE logret IS NOT NULL AND mcap > 0) WINDOW w AS (PARTITION BY date))
SELECT date, ticker, {rounded('x - mx - c / nullif(v + 1e-8, 0) * (b - mb)')} AS residual FROM f""")  # fmt: skip
sql_query("industry_cap_agg", lambda d: f"SELECT date, industry, {rounded('sum(mcap) / 1e6')} AS cap_millions, count(mcap) AS n FROM {{month}} WHERE mcap IS NOT NULL GROUP BY date, industry")
sql_query("weighted_demean", lambda d: f"""WITH w AS (SELECT date, ticker, industry, logret, mcap / nullif(sum(mcap) OVER (PARTITION BY date, industry), 0) AS w FROM {{month}} WHERE logret IS NOT NULL AND mcap IS NOT NULL)
SELECT date, ticker, {rounded('logret - sum(w * logret) OVER (PARTITION BY date, industry)')} AS demeaned, {rounded('w')} AS weight FROM w""")  # fmt: skip
sql_query("industry_dummies_check", lambda d: "SELECT date, count(*) AS n, count(DISTINCT industry) AS n_industries, max(c) AS most FROM (SELECT date, industry, count(*) OVER (PARTITION BY date, ticker) AS c FROM {month}) GROUP BY date")
sql_query("composite_score", lambda d: f"""WITH {_ic(d, True)}, wt AS (SELECT factor, avg(ic) / nullif(stddev_samp(ic), 0) AS w FROM ic GROUP BY factor),
z AS (SELECT date, ticker, factor, (x - avg(x) OVER (PARTITION BY date, factor)) / nullif(stddev_samp(x) OVER (PARTITION BY date, factor), 0) AS z FROM {melted(d, '{signals}', FACTORS, 'date, ticker')} m WHERE x IS NOT NULL)
SELECT date, ticker, {rounded('sum(w * z)')} AS score, count(z) AS n FROM z JOIN wt ON wt.factor = z.factor GROUP BY date, ticker""")  # fmt: skip
_top = "ranked AS (SELECT date, ticker, s4 AS s, y, row_number() OVER (PARTITION BY date ORDER BY round(s4, 9) DESC, ticker) AS r FROM {signals} WHERE s4 IS NOT NULL)"
sql_query("softmax_topk", lambda d: f"""WITH {_top}, e AS (SELECT date, ticker, r, exp(1.4 * (s - max(s) OVER (PARTITION BY date))) AS e FROM ranked WHERE r <= 5)
SELECT date, ticker, r, {rounded('e / sum(e) OVER (PARTITION BY date)')} AS weight FROM e""")  # fmt: skip
sql_query("top_pct_picks", lambda d: f"""WITH {_top}, n AS (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM ranked)
SELECT date, ticker, r, CASE WHEN r <= greatest(floor(n * 0.15), 3) THEN 'long' ELSE 'bottom' END AS side FROM n WHERE r <= greatest(floor(n * 0.15), 3) OR r > n - greatest(floor(n * 0.15), 3)""")  # fmt: skip
sql_query("portfolio_l1_return", lambda d: f"""WITH c AS (SELECT date, ticker, s4 - avg(s4) OVER (PARTITION BY date) AS x, y FROM {{signals}} WHERE s4 IS NOT NULL AND y IS NOT NULL),
w AS (SELECT date, x / nullif(sum(abs(x)) OVER (PARTITION BY date), 0) AS w, y FROM c) SELECT date, {rounded('sum(w * y)')} AS ret, count(*) AS n FROM w GROUP BY date HAVING count(*) >= 10""")  # fmt: skip
sql_query("dual_leg_split", lambda d: f"""WITH v AS (SELECT date, ticker, s4 AS s, abs(logret) AS v FROM {{signals}} WHERE s4 IS NOT NULL AND logret IS NOT NULL),
m AS (SELECT date, {quantile(d, 'v', 0.5)} AS med FROM v GROUP BY date),
l AS (SELECT v.date, v.ticker, s, CASE WHEN v.v <= med THEN 'HF' ELSE 'LF' END AS leg FROM v JOIN m ON m.date = v.date),
r AS (SELECT *, row_number() OVER (PARTITION BY date, leg ORDER BY round(s, 9) DESC, ticker) AS r, count(*) OVER (PARTITION BY date, leg) AS n FROM l),
e AS (SELECT *, exp((CASE WHEN leg = 'HF' THEN 5 ELSE 2 END) * (s - max(s) OVER (PARTITION BY date, leg))) AS e FROM r WHERE r <= CASE WHEN leg = 'HF' THEN greatest(floor(n * 0.3), 1) ELSE greatest(floor(n * 0.5), 5) END)
SELECT date, ticker, leg, {rounded("e / sum(e) OVER (PARTITION BY date, leg) * CASE WHEN leg = 'HF' THEN 0.3 ELSE 0.7 END")} AS weight FROM e""")  # fmt: skip
sql_query("factor_exposure", lambda d: f"""WITH {_top}, w AS (SELECT date, ticker, 1 / CAST(count(*) OVER (PARTITION BY date) AS DOUBLE) AS w FROM ranked WHERE r <= 5)
SELECT w.date, factor, {rounded('sum(w * x)')} AS exposure FROM w JOIN {melted(d, '{signals}', FACTORS, 'date, ticker')} m ON m.date = w.date AND m.ticker = w.ticker GROUP BY w.date, factor""")  # fmt: skip
sql_query("factor_contrib", lambda d: f"""WITH e AS (SELECT date, factor, avg(x) AS expo, {corr('x', 'y')} AS f FROM {melted(d, '{signals}', FACTORS, 'date, ticker, y')} m GROUP BY date, factor)
SELECT factor, {rounded('sum(expo * f)')} AS total, {rounded('avg(expo * f)')} AS mean, {rounded('stddev_samp(expo * f)')} AS sd FROM e GROUP BY factor""")  # fmt: skip
sql_query("gram_matrix", lambda d: "SELECT " + ", ".join(f"{rounded(f'sum({a} * {b})')} AS g_{a}_{b}" for i, a in enumerate(GRAM) for b in GRAM[i:]) + ", count(*) AS n FROM {signals} WHERE " + " AND ".join(f"{a} IS NOT NULL" for a in GRAM))
sql_query("purged_folds", lambda d: """WITH c AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM {month})),
f AS (SELECT *, CAST(CASE WHEN i < (n % 5) * (floor(n / 5) + 1) THEN floor(i / (floor(n / 5) + 1)) ELSE (n % 5) + floor((i - (n % 5) * (floor(n / 5) + 1)) / floor(n / 5)) END AS INT) AS fold FROM c),
b AS (SELECT fold, min(i) AS a, max(i) + 1 AS z FROM f GROUP BY fold)
SELECT b.fold, min(CASE WHEN f.fold = b.fold THEN date END) AS test_from, max(CASE WHEN f.fold = b.fold THEN date END) AS test_to, count(CASE WHEN f.fold = b.fold THEN 1 END) AS n_test,
       count(CASE WHEN f.i < b.a - 5 OR f.i >= b.z + 5 THEN 1 END) AS n_train FROM b CROSS JOIN f GROUP BY b.fold""")  # fmt: skip
sql_query("rebalance_grid", lambda d: """WITH days AS (SELECT DISTINCT CAST(date_trunc('day', l_shipdate) AS DATE) AS date FROM {lineitem}), ends AS (SELECT DISTINCT last_day(date) AS e FROM days)
SELECT e AS month_end, min(date) AS rebalance FROM ends JOIN days ON date >= e AND date <= e + INTERVAL 10 DAY GROUP BY e""")  # fmt: skip
sql_query("holdout_windows", lambda d: """WITH s AS (SELECT DISTINCT date FROM {month}), q AS (SELECT date AS stage, lead(date) OVER (ORDER BY date) AS until FROM s WHERE extract(month FROM date) IN (1, 4, 7, 10))
SELECT stage, min(s.date) AS first_date, max(s.date) AS last_date, count(*) AS n FROM q JOIN s ON s.date >= stage AND (until IS NULL OR s.date < until) GROUP BY stage""")  # fmt: skip
_market = "mkt AS (SELECT date, avg(logret) AS r FROM {month} WHERE logret IS NOT NULL GROUP BY date), nav AS (SELECT date, r, exp(sum(r) OVER (ORDER BY date)) AS nav FROM mkt)"
sql_query("nav_drawdown", lambda d: f"WITH {_market} SELECT date, {rounded('r')} AS ret, {rounded('nav')} AS nav, {rounded('nav / max(nav) OVER (ORDER BY date) - 1')} AS drawdown FROM nav")
sql_query("nav_metrics", lambda d: f"""WITH {_market}, dd AS (SELECT *, nav / max(nav) OVER (ORDER BY date) - 1 AS drawdown FROM nav)
SELECT count(*) AS n, {rounded('avg(r) * 12')} AS ann_return, {rounded('stddev_samp(r) * sqrt(12)')} AS ann_vol, {rounded('avg(r) / nullif(stddev_samp(r), 0) * sqrt(12)')} AS sharpe, {rounded('min(drawdown)')} AS max_drawdown FROM dd""")  # fmt: skip
sql_query("hday_roll_stats", lambda d: f"""WITH {_market}, h AS (SELECT date, CASE WHEN count(r) OVER (ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 5 THEN sum(r) OVER (ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS h FROM nav)
SELECT count(h) AS n, {rounded('avg(h)')} AS mean, {rounded('stddev_samp(h)')} AS vol, {rounded(quantile(d, 'h', 0.05))} AS var5 FROM h""")  # fmt: skip
sql_query("stage_ttest", lambda d: f"""WITH {_market}, st AS (SELECT extract(year FROM date) AS stage, sum(r) AS r FROM nav GROUP BY 1),
a AS (SELECT count(*) AS n, avg(r) AS mean, avg(r) / nullif(stddev_samp(r) / sqrt(count(*)), 0) AS t, CAST(min_by(stage, r) AS BIGINT) AS worst, CAST(max_by(stage, r) AS BIGINT) AS best FROM st)
SELECT n, {rounded('mean')} AS mean, {rounded('t')} AS t, {rounded(t_tail(d, 't', 'CAST(n - 1 AS DOUBLE)'))} AS p_one_sided, worst, best FROM a""")  # fmt: skip
sql_query("median_mad_budget", lambda d: f"""WITH med AS (SELECT date, {quantile(d, 'abs(logret)', 0.5)} AS m FROM {{month}} WHERE logret IS NOT NULL GROUP BY date),
dev AS (SELECT s.date, m, {quantile(d, 'abs(abs(logret) - m)', 0.5)} AS mad FROM {{month}} s JOIN med ON med.date = s.date WHERE logret IS NOT NULL GROUP BY s.date, m),
risk AS (SELECT date, m * (1 + 0.35 * 1.4826 * mad / nullif(m, 0)) AS r FROM dev)
SELECT date, {rounded('r')} AS risk, {rounded('(1 / nullif(r, 0)) / sum(1 / nullif(r, 0)) OVER ()')} AS fraction FROM risk""")  # fmt: skip

# ---------------------------------------------------------------- ingest, keys, joins

for _name in ("upsert_latest", "upsert_latest_all"):
    sql_query(_name, lambda d: """WITH target AS (SELECT o_orderkey AS k, o_orderdate AS d, o_totalprice AS v, 0 AS fresh FROM {orders}),
source AS (SELECT o_orderkey AS k, o_orderdate AS d, o_totalprice * 2 AS v, 1 AS fresh FROM {orders} WHERE o_orderkey % 2 = 0),
latest AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d DESC, v DESC) AS r FROM source)
SELECT k, v, fresh FROM latest WHERE r = 1 UNION ALL SELECT t.k, t.v, t.fresh FROM target t LEFT ANTI JOIN source s ON s.k = t.k""".replace("LEFT ANTI" if not d.spark else "@", "ANTI"))  # fmt: skip
sql_query("tz_date_dedupe", lambda d: f"""WITH e AS (SELECT user_id, value, ts, event_id, CAST({"from_utc_timestamp(ts, 'America/New_York')" if d.spark else "(ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York'"} AS DATE) AS local_date FROM {{events}}),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, local_date ORDER BY ts DESC, event_id DESC) AS r FROM e) SELECT user_id, local_date, value FROM r WHERE r = 1""")  # fmt: skip
sql_query("semi_anti_universe", lambda d: """SELECT 'traded' AS kind, count(*) AS n FROM {supplier} WHERE s_suppkey IN (SELECT l_suppkey FROM {lineitem} WHERE l_quantity > 49)
UNION ALL SELECT 'idle', count(*) FROM {supplier} s WHERE NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_suppkey = s.s_suppkey AND l_quantity > 49)""")  # fmt: skip
sql_query("union_sources", lambda d: "SELECT DISTINCT s_nationkey AS nation FROM {supplier} INTERSECT SELECT DISTINCT c_nationkey FROM {customer} UNION SELECT n_nationkey FROM {nation} WHERE n_regionkey = 1")
sql_query("first_trade_date", lambda d: "SELECT ticker, min(CASE WHEN close IS NOT NULL THEN date END) AS first_priced, min(CASE WHEN volume > 0 THEN date END) AS first_traded, count(close) AS traded FROM {month} GROUP BY ticker")
for _name in ("asof_classification", "asof_classification_all"):
    sql_query(_name, lambda d: f"""WITH changes AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS date, max(o_orderpriority) AS code FROM {{orders}} GROUP BY 1, 2),
cal AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS date FROM {{orders}}), keys AS (SELECT DISTINCT k FROM changes),
merged AS (SELECT k, date, code, 0 AS asked FROM changes UNION ALL SELECT k, date, CAST(NULL AS VARCHAR(20)), 1 FROM keys CROSS JOIN cal)
SELECT k, date, coalesce(code, 'UNK') AS code FROM (SELECT k, date, asked, {d.last('code', '(PARTITION BY k ORDER BY date, asked ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS code FROM merged) WHERE asked = 1""")  # fmt: skip
sql_query("exchange_prefix", lambda d: """WITH s AS (SELECT s_suppkey, lpad(CAST(600000 + s_suppkey * 977 % 400000 AS VARCHAR(6)), 6, '0') AS code FROM {supplier})
SELECT s_suppkey, code, CASE WHEN substring(code, 1, 3) IN ('600', '601', '603', '605', '688', '689') THEN concat('sh', code) WHEN substring(code, 1, 3) IN ('000', '001', '002', '003', '300', '301', '900') THEN concat('sz', code) END AS symbol,
       CASE WHEN substring(code, 1, 3) IN ('688', '689', '300', '301') THEN 0.2 ELSE 0.1 END AS price_limit FROM s""")  # fmt: skip
sql_query("corporate_actions", lambda d: f"""SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, o_custkey % 100 AS ticker, {rounded('exp(sum(ln(1 + o_totalprice / 1e7)))')} AS split_factor, round(sum(o_totalprice) / 1e6, 4) AS cash
FROM {{orders}} WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 0 GROUP BY 1, 2""")  # fmt: skip
sql_query("logret_ca", lambda d: f"""WITH ca AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, o_custkey % 100 AS ticker, sum(o_totalprice) / 1e6 AS cash, count(*) / 1000.0 AS bonus FROM {{orders}} WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2)
SELECT m.date, m.ticker, {rounded('CASE WHEN prev > 0 AND close > 0 THEN ln((close * (1 + coalesce(bonus, 0)) + coalesce(cash, 0)) / prev) END')} AS logret FROM {{month}} m LEFT JOIN ca ON ca.date = m.date AND ca.ticker = m.ticker""")  # fmt: skip
sql_query("conflict_check", lambda d: "SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM {lineitem} GROUP BY l_orderkey, l_linenumber HAVING count(DISTINCT l_suppkey) > 1")
sql_query("numeric_coercion", lambda d: f"SELECT event_id, try_cast(regexp_extract(props, '([0-9.]+)', 1) AS DOUBLE) AS k, round(value / 10, 4) AS per_share FROM {{events}} WHERE value IS NOT NULL")
sql_query("ewma_fold", lambda d: f"""WITH a AS (SELECT user_id, {'transform(array_sort(collect_list(struct(ts, event_id, value))), z -> z.value)' if d.spark else 'list(value ORDER BY ts, event_id)'} AS v FROM {{events}} WHERE value IS NOT NULL GROUP BY user_id)
SELECT user_id, {rounded('aggregate(v, CAST(0 AS DOUBLE), (s, z) -> 0.3 * abs(z) + 0.7 * s)' if d.spark else 'list_reduce(list_prepend(0::DOUBLE, v), lambda s, z: 0.3 * abs(z) + 0.7 * s)')} AS vp FROM a""")  # fmt: skip
sql_query("tpch_pricing_summary", lambda d: """SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM {lineitem} WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus""")  # fmt: skip

# ---------------------------------------------------------------- standardising, stages and reports

sql_query("standardize_diagnostics", lambda d: f"""WITH q AS (SELECT date, {quantile(d, 'logret', 0.01)} AS lo, {quantile(d, 'logret', 0.99)} AS hi FROM {{month}} WHERE logret IS NOT NULL GROUP BY date),
w AS (SELECT m.date, logret, CASE WHEN logret IS NOT NULL THEN least(greatest(logret, lo), hi) END AS x FROM {{month}} m LEFT JOIN q ON q.date = m.date),
z AS (SELECT date, logret, x, (x - avg(x) OVER (PARTITION BY date)) / nullif(stddev_samp(x) OVER (PARTITION BY date), 0) AS z FROM w),
c AS (SELECT date, count(z) AS n, count(*) AS t, count(CASE WHEN x <> logret THEN 1 END) AS wins, count(CASE WHEN abs(z) > 3 THEN 1 END) AS clips FROM z GROUP BY date)
SELECT {rounded('avg(n / CAST(t AS DOUBLE))')} AS coverage, {rounded('avg(CAST(n AS DOUBLE))')} AS avg_names, {rounded('avg(wins / CAST(nullif(n, 0) AS DOUBLE))')} AS winsor_rate, {rounded('avg(clips / CAST(nullif(n, 0) AS DOUBLE))')} AS clip_rate FROM c""")  # fmt: skip
sql_query("latest_picks", lambda d: f"""WITH last AS (SELECT max(date) AS date FROM {{signals}} WHERE s4 IS NOT NULL),
r AS (SELECT s.date, ticker, s4, row_number() OVER (ORDER BY round(s4, 9) DESC, ticker) AS r FROM {{signals}} s JOIN last ON last.date = s.date WHERE s4 IS NOT NULL)
SELECT date, ticker, {rounded('s4')} AS score, r FROM r WHERE r <= 10""")  # fmt: skip
sql_query("benchmark_excess", lambda d: f"""WITH p AS (SELECT date, avg(CASE WHEN sector = 1 THEN logret END) AS r, avg(logret) AS b FROM {{month}} WHERE logret IS NOT NULL GROUP BY date)
SELECT date, {rounded('r - b')} AS excess, {rounded('exp(sum(coalesce(r, 0)) OVER (ORDER BY date)) - exp(sum(b) OVER (ORDER BY date))')} AS cumulative_excess FROM p""")  # fmt: skip
sql_query("stage_windows_buffer", lambda d: """WITH c AS (SELECT date, row_number() OVER (ORDER BY date) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM {month})),
s AS (SELECT i AS stage, date AS stage_from, least(i + 11, n) AS last_i, least(i + 14, n) AS buffer_i FROM c WHERE i % 12 = 1)
SELECT stage, stage_from, a.date AS stage_to, b.date AS liquidate_to FROM s JOIN c a ON a.i = last_i JOIN c b ON b.i = buffer_i""")  # fmt: skip
sql_query("book_fractions", lambda d: f"""WITH {_market}, b AS (SELECT date, (row_number() OVER (ORDER BY date) - 1) % 5 AS book, 1 / nullif(abs(r) + 0.01, 0) AS w FROM nav)
SELECT book, {rounded('sum(w) / sum(sum(w)) OVER ()')} AS fraction, count(*) AS n FROM b GROUP BY book""")  # fmt: skip
sql_query("split_factor_daily", lambda d: f"""SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n, {rounded('exp(sum(ln(1 + o_totalprice / 1e7)))')} AS factor, extract(year FROM o_orderdate) AS year
FROM {{orders}} WHERE o_totalprice > 0 GROUP BY 1, extract(year FROM o_orderdate) HAVING count(*) > 1""")  # fmt: skip
sql_query("pivot_report", lambda d: "SELECT extract(year FROM date) AS year, " + ", ".join(f"{rounded(f'avg(CASE WHEN sector = {k} THEN logret END)')} AS sector_{k}" for k in range(5)) + " FROM {month} GROUP BY 1")


# ---------------------------------------------------------------- tests of returns, filters of signals, tickers, legacy fills


def _both_ics(d: Dialect) -> str:
    """ic(factor, date, ic) of both kinds, the factors marked p_ (Pearson) and r_ (ranks)."""
    body = lambda spearman: _ic(d, spearman).removeprefix("ic AS (").removesuffix(")")
    return f"p AS ({body(False)}), r AS ({body(True)}), ic AS (SELECT concat('p_', factor) AS factor, date, ic FROM p UNION ALL SELECT concat('r_', factor), date, ic FROM r)"


sql_query("signal_tests_merged", lambda d: f"""WITH {_both_ics(d)}, {_hac(5)},
tests AS (SELECT substring(factor, 3) AS factor, substring(factor, 1, 1) AS kind, n, mean, se, abs(mean) / nullif(se, 0) > 1.6449 AS reject FROM hac)
SELECT a.factor, a.n AS n_ic, b.n AS n_ric, {rounded('a.mean')} AS mean_ic, {rounded('b.mean')} AS mean_ric, {rounded('abs(a.mean)')} AS abs_mean_ic, {rounded('abs(b.mean)')} AS abs_mean_ric,
       CAST(sign(a.mean) AS BIGINT) AS sign_ic, CAST(sign(b.mean) AS BIGINT) AS sign_ric, a.reject AS reject_ic, b.reject AS reject_ric
FROM tests a JOIN tests b ON a.factor = b.factor WHERE a.kind = 'p' AND b.kind = 'r'""")  # fmt: skip
sql_query("two_sided_filter", lambda d: f"""WITH {_both_ics(d)}, {_hac(5)},
tests AS (SELECT substring(factor, 3) AS factor, substring(factor, 1, 1) AS kind, mean, se, coalesce(abs(mean) / nullif(se, 0) > 1.6449, FALSE) AS reject,
          CASE WHEN mean >= 0 THEN mean - 1.6449 * se END AS lower, CASE WHEN mean < 0 THEN mean + 1.6449 * se END AS upper FROM hac),
paired AS (SELECT a.factor, a.mean AS mean_ic, b.mean AS mean_ric, a.reject AND b.reject AS rejected, a.lower AS lower_ic, b.lower AS lower_ric, a.upper AS upper_ic, b.upper AS upper_ric
         FROM tests a JOIN tests b ON a.factor = b.factor WHERE a.kind = 'p' AND b.kind = 'r')
SELECT factor, {rounded('mean_ic')} AS mean_ic, {rounded('mean_ric')} AS mean_ric,
       coalesce(rejected AND ((mean_ic > 0.001 AND mean_ric > 0.001 AND lower_ic > 0 AND lower_ric > 0) OR (mean_ic < -0.001 AND mean_ric < -0.001 AND upper_ic < 0 AND upper_ric < 0)), FALSE) AS kept FROM paired""")  # fmt: skip
sql_query("ticker_formats", lambda d: """WITH s AS (SELECT s_suppkey, concat(CASE WHEN s_suppkey % 2 = 0 THEN 'sh' ELSE 'sz' END, lpad(CAST(s_suppkey * 977 % 1000000 AS VARCHAR(6)), 6, '0')) AS symbol FROM {supplier}),
f AS (SELECT *, concat(substring(symbol, 3), CASE WHEN substring(symbol, 1, 2) = 'sh' THEN '.SS' ELSE '.SZ' END) AS listed FROM s)
SELECT s_suppkey, symbol, listed, concat(CASE WHEN upper(substring(listed, 8)) = 'SS' THEN 'sh' ELSE 'sz' END, substring(listed, 1, 6)) AS back FROM f""")  # fmt: skip
#: The legacy fill: forward, then backward for what comes before the first value (it looks ahead; off everywhere else).
sql_query("legacy_fill", lambda d: f"""WITH f AS (SELECT date, ticker, close, {d.last('close', '(PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS forward,
{d.last('close', '(PARTITION BY ticker ORDER BY date DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS backward FROM {{month}})
SELECT date, ticker, {rounded('forward')} AS forward, {rounded('coalesce(forward, backward)')} AS filled FROM f""")  # fmt: skip
sql_query("universe_by_age_and_dollars", lambda d: f"""WITH a AS (SELECT date, ticker, CASE WHEN volume > 0 THEN vwap * volume END AS dollars, coalesce(volume, 0) > 0 AS active, min(CASE WHEN volume > 0 THEN date END) OVER (PARTITION BY ticker) AS listed FROM {{month}}),
r AS (SELECT *, CASE WHEN count(dollars) OVER w = 20 THEN avg(dollars) OVER w END AS adv FROM a WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT date, ticker, coalesce(active AND date >= listed + INTERVAL 365 DAY AND dollars >= 1e6, FALSE) AS instant, coalesce(active AND date >= listed + INTERVAL 365 DAY AND adv >= 1e6, FALSE) AS rolling FROM r""")  # fmt: skip
sql_query("partial_autocorrelation", lambda d: f"""WITH {_ic(d)}, {_newey_west(3)}, a AS (SELECT factor, count(*) AS n, sum(u * u1) / nullif(sum(u * u), 0) AS r1, sum(u * u2) / nullif(sum(u * u), 0) AS r2, sum(u * u3) / nullif(sum(u * u), 0) AS r3 FROM lagged GROUP BY factor),
p AS (SELECT factor, n, r1 AS p1, (r2 - r1 * r1) / nullif(1 - r1 * r1, 0) AS p2, r1, r2, r3 FROM a)
SELECT factor, {rounded('p1')} AS pacf1, {rounded('p2')} AS pacf2, {rounded('(r3 - (r1 - p2 * r1) * r2 - p2 * r1) / nullif(1 - (r1 - p2 * r1) * r1 - p2 * r2, 0)')} AS pacf3,
       greatest(abs(p1), abs(p2)) > 1.96 / sqrt(n) AS dependent FROM p""")  # fmt: skip
