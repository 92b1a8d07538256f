"""Student-t quantile and the Grubbs critical value, per column on the driver."""

from __future__ import annotations

import math


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def _log_beta(a: float, b: float) -> float:
    """log B(a, b); the large-``a`` branch avoids subtracting two huge log-gammas."""
    if a < 1e5:
        return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    s = a + b
    return (math.lgamma(b) - b * math.log(s) + (a - 0.5) * math.log1p(-b / s) + b
            + 1 / (12 * a) - 1 / (12 * s))


def _regularized_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - _log_beta(a, b))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_upper_quantile(tail: float, df: float) -> float:
    """t with P(T > t) = tail, for tail < 0.5, by bisection."""
    lo, hi = 0.0, 1.0

    def upper(t: float) -> float:
        return 0.5 * _regularized_beta(df / 2.0, 0.5, df / (df + t * t))

    while upper(hi) > tail:
        lo, hi = hi, hi * 2.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        if upper(mid) > tail:
            lo = mid
        else:
            hi = mid
        if hi - lo <= 1e-14 * hi:
            break
    return (lo + hi) / 2.0


def grubbs_critical(n: int, alpha: float = 0.05) -> float:
    t = t_upper_quantile(alpha / (2.0 * n), n - 2)
    return (n - 1) / math.sqrt(n) * math.sqrt(t * t / (n - 2 + t * t))
