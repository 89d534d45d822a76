"""Tails of distributions and partial autocorrelations as column expressions, in the text of either engine."""

from __future__ import annotations

from .dag import Dialect

#: Terms of the continued fraction of the incomplete beta function.
TERMS = 80
#: The 95 % quantile of the normal distribution and the coefficients of the expansion of Student's quantile
#: in powers of 1 / df (fixed values, Abramowitz and Stegun 26.7.5).
Z95 = 1.6448536269514722
#: ln(gamma(z + 1/2) / gamma(z)) = ln(z) / 2 + these over odd powers of z (fixed values of the asymptotic series).
GAMMA_RATIO = (-1 / 8, 1 / 192, -1 / 640, 17 / 14336)


#: The upper tail of the normal distribution to seven digits, by the published polynomial (fixed values of Abramowitz and Stegun 26.2.17).
_TAIL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_tail(z: str) -> str:
    """P(Z > z) of the normal distribution."""
    k = f"(1 / (1 + CAST(0.2316419 AS DOUBLE) * abs({z})))"
    polynomial = " + ".join(f"CAST({c!r} AS DOUBLE) * power({k}, {i + 1})" for i, c in enumerate(_TAIL))
    upper = f"(exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * ({polynomial}))"
    return f"CASE WHEN ({z}) >= 0 THEN {upper} ELSE 1 - {upper} END"


def _double(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _ln_gamma_ratio(a: str, shift: int = 8) -> str:
    """ln(gamma(a + 1/2) / gamma(a)), by the series at a + ``shift`` and the recurrence down to a."""
    z = f"({a} + {shift})"
    series = " + ".join(f"{_double(c)} / power({z}, {2 * k + 1})" for k, c in enumerate(GAMMA_RATIO))
    down = " + ".join(f"ln(({a} + {k}) / ({a} + {_double(k + 0.5)}))" for k in range(shift))
    return f"(ln({z}) / 2 + {series} + {down})"


def _fraction(d: Dialect, a: str, b: str, x: str) -> str:
    """The continued fraction of the incomplete beta function, folded from its ``TERMS``-th term up; each term takes two steps."""
    even = f"(m * ({b} - m) * ({x}) / (({a} + 2 * m - 1) * ({a} + 2 * m)))"
    odd = f"(-({a} + m) * ({a} + {b} + m) * ({x}) / (({a} + 2 * m) * ({a} + 2 * m + 1)))"
    step = f"1 + {even} / (1 + {odd} / v)"
    terms = f"transform(sequence({TERMS}, 1, -1), k -> CAST(k AS DOUBLE))" if d.spark else f"list_transform(range({TERMS}, 0, -1), lambda k: CAST(k AS DOUBLE))"
    folded = f"aggregate({terms}, CAST(1 AS DOUBLE), (v, m) -> {step})" if d.spark else f"list_reduce({terms}, lambda v, m: {step}, CAST(1 AS DOUBLE))"
    zeroth = f"(-({a} + {b}) * ({x}) / ({a} + 1))"
    return f"(1 / (1 + {zeroth} / {folded}))"


def t_tail(d: Dialect, t: str, df: str) -> str:
    """P(T > t) of Student's distribution; null where df is not positive."""
    a, b = f"(({df}) / {_double(2.0)})", _double(0.5)
    x = f"(({df}) / (({df}) + ({t}) * ({t})))"
    log_front = f"({a} * ln({x}) + ln(1 - {x}) / 2 + {_ln_gamma_ratio(a)} - ln(pi()) / 2)"
    direct = f"(exp({log_front}) * {_fraction(d, a, b, x)} / {a})"
    mirrored = f"(1 - exp({log_front}) * {_fraction(d, b, a, f'(1 - {x})')} / {b})"
    both = f"CASE WHEN ({t}) = 0 THEN {_double(1.0)} WHEN {x} < ({a} + 1) / ({a} + {b} + 2) THEN {direct} ELSE {mirrored} END"
    return f"(CASE WHEN ({df}) > 0 THEN CASE WHEN ({t}) >= 0 THEN ({both}) / 2 ELSE 1 - ({both}) / 2 END END)"


def t_quantile95(df: str) -> str:
    """The 95 % quantile by its expansion in 1 / df; within 1e-6 from 20 degrees of freedom on."""
    z = Z95
    terms = (
        (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    )
    return f"({_double(z)} + " + " + ".join(f"{_double(c)} / power({df}, {k + 1})" for k, c in enumerate(terms)) + ")"


def partial_autocorrelations(r: str) -> str:
    """An array of the partial autocorrelations of the array ``r`` of autocorrelations from lag 1 on (Spark text).

    Durbin and Levinson's recursion as a fold: the state is the coefficients of the last order and the
    results so far.
    """
    dot = lambda x, y: f"aggregate(zip_with({x}, {y}, (a, b) -> a * b), CAST(0 AS DOUBLE), (a, b) -> a + b)"
    newest = f"((element_at({r}, k) - {dot('s.phi', f'reverse(slice({r}, 1, k - 1))')}) / nullif(1 - {dot('s.phi', f'slice({r}, 1, k - 1)')}, 0))"
    after = f"transform(array({newest}), p -> named_struct('phi', concat(zip_with(s.phi, reverse(s.phi), (a, b) -> a - p * b), array(p)), 'out', concat(s.out, array(p))))[0]"
    orders = f"CASE WHEN size({r}) > 0 THEN sequence(1, size({r})) ELSE array() END"
    return f"aggregate({orders}, named_struct('phi', CAST(array() AS array<double>), 'out', CAST(array() AS array<double>)), (s, k) -> {after}, s -> s.out)"
