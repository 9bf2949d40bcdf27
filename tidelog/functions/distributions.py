"""Upper tails of the F, chi-squared and normal distributions, by the continued fraction of the incomplete beta and gamma functions."""

from __future__ import annotations

from math import erf, exp, lgamma, log, sqrt

TINY, STEPS, CLOSE = 1e-300, 500, 1e-14


def _lentz(terms, start: float) -> float:
    """A continued fraction start + a1 / (b1 + a2 / (b2 + ...)) of the (a, b) in ``terms``."""
    f = start or TINY
    c, d = f, 0.0
    for a, b in terms:
        d = 1 / ((b + a * d) or TINY)
        c = (b + a / c) or TINY
        f *= c * d
        if abs(c * d - 1) < CLOSE:
            break
    return f


def incomplete_beta(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(1 - x, b, a)

    def terms():
        yield 1.0, 1.0
        for m in range(STEPS):
            yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
            yield (m + 1) * (b - m - 1) * x / ((a + 2 * m + 1) * (a + 2 * m + 2)), 1.0

    return exp(a * log(x) + b * log(1 - x) + lgamma(a + b) - lgamma(a) - lgamma(b)) / a * _lentz(terms(), 0.0)


def f_tail(x: float, one: float, two: float) -> float:
    return 1.0 if x <= 0 else incomplete_beta(two / (two + one * x), two / 2, one / 2)


def chi2_tail(x: float, k: float) -> float:
    if x <= 0:
        return 1.0
    a, z = k / 2, x / 2
    scale = exp(a * log(z) - z - lgamma(a))
    if z < a + 1:
        total = term = 1 / a
        n = a
        while abs(term) > abs(total) * CLOSE:
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1 - total * scale)

    def terms():
        yield 1.0, z + 1 - a
        for i in range(1, STEPS):
            yield -i * (i - a), z + 2 * i + 1 - a

    return scale * _lentz(terms(), 0.0)


def normal_cdf(x: float) -> float:
    return 0.5 * (1 + erf(x / sqrt(2)))
