"""p-values by the regularized incomplete beta and gamma functions (continued fractions and series)."""

from __future__ import annotations

from math import erfc, exp, lgamma, log, sqrt

_TINY, _EPS = 1e-300, 1e-15


def _lentz(step, limit: int = 10_000) -> float:
    """A continued fraction b0 + a1/(b1 + a2/(b2 + ...)) by Lentz's method; step(n) gives (a_n, b_n), step(0) b0."""
    value = step(0)[1] or _TINY
    c, d = value, 0.0
    for n in range(1, limit):
        a, b = step(n)
        d = 1.0 / ((b + a * d) or _TINY)
        c = (b + a / c) or _TINY
        value *= c * d
        if abs(c * d - 1.0) < _EPS:
            break
    return value


def beta_regularized(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return min(max(x, 0.0), 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_regularized(b, a, 1.0 - x)

    def step(n):
        if n == 0:
            return 0.0, 1.0
        m, odd = divmod(n, 2)
        if odd:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0

    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1.0 - x)) / a
    return front / _lentz(step)


def gamma_upper(s: float, x: float) -> float:
    if x <= 0:
        return 1.0
    front = exp(-x + s * log(x) - lgamma(s))
    if x < s + 1:
        term = total = 1.0 / s
        n = s
        while term > total * _EPS:
            n += 1
            term *= x / n
            total += term
        return 1.0 - front * total
    return front / _lentz(lambda n: (0.0, x + 1 - s) if n == 0 else (-n * (n - s), x + 2 * n + 1 - s))


def p_value(kind: str, df1: float | None, df2: float | None, value: float) -> float | None:
    """Two-sided for z, t and r; the upper tail for F and chi2."""
    try:
        if kind == "z":
            return erfc(abs(value) / sqrt(2))
        if kind == "r":
            kind, value = "t", value * sqrt(df1 / (1 - value * value))
        if kind == "t":
            return beta_regularized(df1 / 2, 0.5, df1 / (df1 + value * value))
        if kind == "F":
            return beta_regularized(df2 / 2, df1 / 2, df2 / (df2 + df1 * value))
        return gamma_upper(df1 / 2, value / 2)
    except (ValueError, ZeroDivisionError, TypeError, OverflowError):
        return None
