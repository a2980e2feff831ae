"""Tail probabilities of a finished statistic. They run on one number per test, after Spark has done the
ranking and the sums."""

from __future__ import annotations

import math
from statistics import NormalDist


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _incomplete_beta(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 1000):
        for top in (
            m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0)),
        ):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * total / a


def student_two_sided(t: float, df: float) -> float:
    if math.isinf(t):
        return 0.0
    return _incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def chi_square_upper(x: float, df: float) -> float:
    """P(X >= x): series below the mean, continued fraction above."""
    a, x = df / 2.0, x / 2.0
    if x <= 0:
        return 1.0
    lead = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while term > total * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return max(0.0, 1.0 - lead * total)
    tiny = 1e-300
    b = x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    total = d
    for i in range(1, 2000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        total *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return lead * total


def signed_rank_two_sided(w: float, n: int) -> float:
    """Exact two-sided p of min(W+, W-) for n untied, non-zero differences."""
    counts = [1]
    for i in range(1, n + 1):
        longer = counts + [0] * i
        for s, ways in enumerate(counts):
            longer[s + i] += ways
        counts = longer
    below = sum(counts[: int(math.floor(w)) + 1])
    return min(1.0, 2.0 * below / 2.0**n)


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)
