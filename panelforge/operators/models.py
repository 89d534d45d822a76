"""Models over signals: sparse regression, cross-sectional regression, volatility and regimes."""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# ---------------------------------------------------------------- distributions without SciPy


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_cdf(t: float, df: float) -> float:
    tail = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return 1 - tail if t > 0 else tail


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


# ---------------------------------------------------------------- sparse regression on Gram matrices


def lasso_path(gram: dict, alphas: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients (one row an alpha) on standardised features, with their means and deviations.

    Minimises (1 / 2n) |y - Xb|^2 + alpha |b|_1 by coordinate descent on the sums of products, from
    the largest alpha on, each started from the one before.  A column without spread keeps a zero.
    """
    n = max(gram["n"], 1)
    mean = gram["sum"] / n
    cov = gram["gram"] / n - np.outer(mean, mean)
    k = len(mean) - 1
    sd = np.sqrt(np.maximum(np.diag(cov)[:k], 1e-24))
    q = cov[:k, :k] / np.outer(sd, sd)
    flat = np.diag(cov)[:k] <= 1e-24
    c = np.where(flat, 0.0, cov[:k, k] / sd)
    q[flat] = q[:, flat] = 0.0
    out = np.zeros((len(alphas), k))
    b, left, own = np.zeros(k), c.copy(), np.maximum(np.diag(q), 1e-12)
    for i in np.argsort(-alphas):
        for _ in range(rounds):
            moved = 0.0
            # Only coefficients that are not zero, or whose correlation with what is left passes the penalty, can move.
            for j in np.flatnonzero((b != 0) | (np.abs(left) > alphas[i])):
                r = left[j] + own[j] * b[j]
                step = math.copysign(max(abs(r) - alphas[i], 0.0), r) / own[j] - b[j]
                if step:
                    b[j] += step
                    left -= q[:, j] * step
                    moved = max(moved, abs(step))
            if moved < 1e-10:
                break
        out[i] = b
    return out, mean, sd


# ---------------------------------------------------------------- cross-sectional regression


def fama_macbeth(rows: DataFrame, features: tuple[str, ...], target: str, lags: int = 5) -> DataFrame:
    """Mean slope, standard error, t and two-sided p of each factor over the dates.

    Each date is one least-squares fit on its rows without missing values, constant factors left
    out; the error is robust to correlation if any of the first lags exceeds 1.96 / sqrt(T).
    """
    names = list(features)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[names].to_numpy(), pdf[target].to_numpy()
        live = [j for j in range(len(names)) if len(x) and x[:, j].std() > 1e-12]
        if len(x) <= len(live):
            return pdf.iloc[:0][["date"]].assign(factor=pd.Series(dtype=str), beta=pd.Series(dtype=float))
        design = np.column_stack([np.ones(len(x)), x[:, live]])
        beta = np.linalg.lstsq(design, y, rcond=None)[0]
        return pd.DataFrame({"date": pdf["date"].iloc[0], "factor": ["const", *[names[j] for j in live]], "beta": beta})

    clean = rows.select("date", *names, target).dropna()
    betas = clean.groupBy("date").applyInPandas(fit, "date date, factor string, beta double")

    def infer(pdf: pd.DataFrame) -> pd.DataFrame:
        b = pdf.sort_values("date")["beta"].to_numpy()
        t = len(b)
        u = b - b.mean()
        cov = [float((u[k:] * u[: t - k]).sum() / t) for k in range(min(lags, t - 1) + 1)]
        rho = [c / cov[0] if cov[0] > 0 else 0.0 for c in cov[1:]]
        robust = any(abs(r) > 1.96 / math.sqrt(t) for r in [*rho, *partial_correlations(rho)])
        var = cov[0] + sum(2 * (1 - k / (lags + 1)) * c * t / max(t - k, 1) for k, c in enumerate(cov) if k) if robust else cov[0] * t / max(t - 1, 1)
        se = math.sqrt(max(var, 0.0) / t)
        stat = b.mean() / se if se > 0 else float("nan")
        p = 2 * (1 - t_cdf(abs(stat), t - 1)) if se > 0 and t > 1 else float("nan")
        return pd.DataFrame({"factor": [pdf["factor"].iloc[0]], "n": [t], "mean": [b.mean()], "se": [se], "t": [stat], "p": [p], "robust": [robust]})

    return betas.groupBy("factor").applyInPandas(infer, "factor string, n long, mean double, se double, t double, p double, robust boolean")


def partial_correlations(rho: list[float]) -> list[float]:
    """Durbin-Levinson recursion on autocorrelations."""
    out: list[float] = []
    phi: list[float] = []
    for k in range(1, len(rho) + 1):
        top = rho[k - 1] - sum(p * rho[k - 2 - j] for j, p in enumerate(phi))
        low = 1 - sum(p * rho[j] for j, p in enumerate(phi))
        last = top / low if abs(low) > 1e-12 else 0.0
        phi = [p - last * phi[-1 - j] for j, p in enumerate(phi)] + [last]
        out.append(last)
    return out


# ---------------------------------------------------------------- volatility and regimes


@dataclass(frozen=True)
class EgarchSpec:
    horizon: int = 5
    paths: int = 4000
    least: int = 60
    cap: float = 2.0
    floor: float = 1e-4
    seed: int = 7


def mean_abs_t(nu: float) -> float:
    """E|z| of a t variable scaled to unit variance."""
    return 2 * math.sqrt(nu - 2) * math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / ((nu - 1) * math.sqrt(math.pi))


def egarch_filter(r: np.ndarray, omega: float, alpha: float, gamma: float, beta: float, nu: float) -> np.ndarray:
    """Log variances of an EGARCH(1,1,1); the first is that of the sample."""
    out = np.empty(len(r) + 1)
    out[0] = math.log(max(r.var(), 1e-12))
    expected = mean_abs_t(nu)
    for i, x in enumerate(r):
        z = x / math.exp(out[i] / 2)
        out[i + 1] = min(max(omega + alpha * (abs(z) - expected) + gamma * z + beta * out[i], -30.0), 30.0)
    return out


def _simplex(f, x: np.ndarray, rounds: int = 250) -> np.ndarray:
    """Nelder-Mead minimisation."""
    n = len(x)
    points = [x, *[x + np.eye(n)[i] * (0.1 if x[i] == 0 else 0.1 * abs(x[i]) + 0.02) for i in range(n)]]
    values = [f(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if values[-1] - values[0] < 1e-7:
            break
        center = np.mean(points[:-1], axis=0)
        trial = center + (center - points[-1])
        v = f(trial)
        if v < values[0]:
            far = center + 2 * (center - points[-1])
            w = f(far)
            trial, v = (far, w) if w < v else (trial, v)
        elif v >= values[-2]:
            trial = center + 0.5 * (points[-1] - center)
            v = f(trial)
            if v >= values[-1]:
                points = [points[0], *[points[0] + 0.5 * (p - points[0]) for p in points[1:]]]
                values = [values[0], *[f(p) for p in points[1:]]]
                continue
        points[-1], values[-1] = trial, v
    return points[int(np.argmin(values))]


def fit_egarch(r: np.ndarray) -> tuple[float, float, float, float, float]:
    """omega, alpha, gamma, beta, nu of the largest likelihood with standardised t errors."""

    def loss(p: np.ndarray) -> float:
        omega, alpha, gamma, beta, nu = p
        if not (-1.5 < alpha < 1.5 and -1.5 < gamma < 1.5 and 0 <= beta < 0.999 and 2.1 < nu < 60):
            return 1e12
        h = egarch_filter(r, *p)[:-1]
        z2 = r * r / np.exp(h)
        const = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2))
        return float(-(const - h / 2 - (nu + 1) / 2 * np.log1p(z2 / (nu - 2))).sum())

    start = np.array([0.1 * math.log(max(r.var(), 1e-12)), 0.1, 0.0, 0.9, 8.0])
    return tuple(_simplex(loss, start))


def egarch_forecast(returns: DataFrame, spec: EgarchSpec = EgarchSpec()) -> DataFrame:
    """ticker, n, sigma: volatility of the next ``horizon`` rows, by simulation from a fit for each ticker.

    Tickers with fewer rows than asked for, or no variance, get the exponentially weighted
    volatility (0.94) of what they have; without any return, null.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        r = 100 * pdf.sort_values("date")["logret"].dropna().to_numpy()
        ticker, method, sigma = pdf["ticker"].iloc[0], "egarch", None
        if len(r) >= spec.least and r.var() > 1e-10:
            omega, alpha, gamma, beta, nu = fit_egarch(r)
            rng = np.random.default_rng(spec.seed + (int(ticker) if isinstance(ticker, (int, np.integer)) else zlib.crc32(str(ticker).encode())))
            h = np.full(spec.paths, egarch_filter(r, omega, alpha, gamma, beta, nu)[-1])
            total = 0.0
            low, high = 2 * math.log(100 * spec.floor), 2 * math.log(100 * spec.cap)
            for _ in range(spec.horizon):
                h = np.clip(h, low, high)
                total += float(np.exp(h).mean())
                z = rng.standard_t(nu, spec.paths) * math.sqrt((nu - 2) / nu)
                h = omega + alpha * (np.abs(z) - mean_abs_t(nu)) + gamma * z + beta * h
            sigma = math.sqrt(total) / 100
        if sigma is None or not math.isfinite(sigma) or sigma > spec.cap * math.sqrt(spec.horizon):
            method, v = "ewma", 0.0
            for i, x in enumerate(r):
                v = x * x if i == 0 else 0.94 * v + 0.06 * x * x
            sigma = math.sqrt(v * spec.horizon) / 100 if len(r) else None
        return pd.DataFrame({"ticker": [ticker], "n": [len(r)], "method": [method], "sigma": [sigma]})

    return returns.select("ticker", "date", "logret").groupBy("ticker").applyInPandas(one, "ticker long, n long, method string, sigma double")


@dataclass(frozen=True)
class RollingVolatility:
    window: int = 104
    every: int = 52
    # Limits of usable fits and of returns and variances (fixed values of the strategy).
    beta_below: float = 0.9
    size_most: float = 1.5
    fit_clip: tuple[float, float] = (math.log(0.5), math.log(2.0))
    log_variance: tuple[float, float] = (-14.0, -2.0)


def rolling_sigma(r: np.ndarray, spec: RollingVolatility) -> np.ndarray:
    """Volatility of each row given the rows before it, NaN before the first full window and while no fit is usable.

    Parameters are fitted again at row ``window`` and each ``every`` rows after it, on the ``window`` rows
    before, without missing or extreme returns; between fits the recursion runs on the returns as they are.
    A row without a return carries the variance on.  Where a fit is degenerate, the last usable one goes on,
    and the variance runs through all refits; a ticker begins with its first usable fit.
    """
    out = np.full(len(r), np.nan)
    shift, (low, high) = 2 * math.log(100), spec.log_variance
    params = h = None
    for start in range(spec.window, len(r), spec.every):
        past = r[start - spec.window : start]
        past = past[np.isfinite(past)]
        fitted = 100 * np.clip(past, *spec.fit_clip)
        if len(past) >= spec.window // 2 and fitted.var() > 1e-10:
            fresh = fit_egarch(fitted)
            if np.isfinite(fresh).all() and abs(fresh[1]) <= spec.size_most and abs(fresh[2]) <= spec.size_most and fresh[3] < spec.beta_below:
                params = fresh
                h = egarch_filter(100 * past, *params)[-1] if h is None else h
        if params is None:
            continue
        omega, alpha, gamma, beta, nu = params
        expected = mean_abs_t(nu)
        for i in range(start, min(start + spec.every, len(r))):
            h = min(max(h, low + shift), high + shift)
            out[i] = math.exp(h / 2) / 100
            if np.isfinite(r[i]):
                z = r[i] / out[i]
                h = omega + alpha * (abs(z) - expected) + gamma * z + beta * h
    return out


def market_volatility(returns: DataFrame, spec: RollingVolatility = RollingVolatility()) -> DataFrame:
    """date, sigma, n: mean over tickers of their rolling volatility, and how many have one; dates without any give no row.

    ``returns`` has date, ticker and logret (null where missing); a ticker is one group, as long as its history.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        return pd.DataFrame({"date": pdf["date"], "sigma": rolling_sigma(pdf["logret"].to_numpy(float, na_value=np.nan), spec)})

    each = returns.select("ticker", "date", "logret").groupBy("ticker").applyInPandas(one, "date date, sigma double")
    return each.where("sigma IS NOT NULL AND NOT isnan(sigma)").groupBy("date").agg(F.avg("sigma").alias("sigma"), F.count("*").alias("n"))


def fit_hmm(x: np.ndarray, states: int = 3, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Means in order and the state probabilities one step ahead, of a Gaussian hidden Markov model by EM."""
    mean = np.quantile(x, (np.arange(states) + 0.5) / states)
    var = np.full(states, x.var() + 1e-12)
    move = np.full((states, states), 0.1 / max(states - 1, 1)) + np.eye(states) * (0.9 - 0.1 / max(states - 1, 1))
    first = np.full(states, 1 / states)
    post = np.full(states, 1 / states)
    for _ in range(rounds):
        dens = np.exp(-0.5 * (x[:, None] - mean) ** 2 / var) / np.sqrt(2 * np.pi * var) + 1e-300
        ahead, back = np.empty_like(dens), np.ones_like(dens)
        norm = np.empty(len(x))
        for t in range(len(x)):
            a = (first if t == 0 else ahead[t - 1] @ move) * dens[t]
            norm[t] = a.sum()
            ahead[t] = a / norm[t]
        for t in range(len(x) - 2, -1, -1):
            back[t] = move @ (dens[t + 1] * back[t + 1]) / norm[t + 1]
        g = ahead * back
        pairs = sum(np.outer(ahead[t], dens[t + 1] * back[t + 1]) * move / norm[t + 1] for t in range(len(x) - 1))
        first, weight = g[0], g.sum(axis=0) + 1e-12
        move = pairs / np.maximum(pairs.sum(axis=1, keepdims=True), 1e-12)
        mean = (g * x[:, None]).sum(axis=0) / weight
        var = (g * (x[:, None] - mean) ** 2).sum(axis=0) / weight + 1e-10
        post = ahead[-1]
    order = np.argsort(mean)
    return mean[order], (post @ move)[order]


def hmm_probabilities(series: DataFrame, window: int = 60, states: int = 3, partial: bool = False) -> DataFrame:
    """date and the probabilities (low, mid, high mean) of the next state, from the ``window`` rows before each date.

    ``partial`` also gives the dates before the first full window, from the rows there are; equal
    probabilities where they are fewer than the states.

    Windows are independent, so dates are dealt to all executors with their own window as an array.
    """
    w = Window.orderBy("date").rowsBetween(-window, -1)
    windows = series.withColumn("past", F.collect_list("value").over(w)).where(F.lit(partial) | (F.size("past") == window))

    def fit(batches):
        for pdf in batches:
            rows = []
            for d, past in zip(pdf["date"], pdf["past"], strict=True):
                try:
                    p = fit_hmm(np.asarray(past, float), states)[1] if len(past) >= states else np.full(states, 1 / states)
                    p = p if np.isfinite(p).all() and abs(p.sum() - 1) < 1e-6 else np.full(states, 1 / states)
                except (FloatingPointError, np.linalg.LinAlgError):
                    p = np.full(states, 1 / states)
                rows.append((d, *p))
            yield pd.DataFrame(rows, columns=["date", *[f"p{i}" for i in range(states)]])

    spec = "date date, " + ", ".join(f"p{i} double" for i in range(states))
    return windows.repartition("date").select("date", "past").mapInPandas(fit, spec)


def greedy_prune(order: list[str], corr: dict[tuple[str, str], float], limit: float = 0.85, most: int = 60) -> list[str]:
    """Names in order of score, without those too correlated with one kept before."""
    kept: list[str] = []
    for name in order:
        if len(kept) >= most:
            break
        if all(abs(corr.get((name, k), corr.get((k, name), 0.0)) or 0.0) <= limit for k in kept):
            kept.append(name)
    return kept
