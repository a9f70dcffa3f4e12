"""Distribution functions in plain Python, for the last scalar step of a test."""

from __future__ import annotations

import math


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def norm_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def norm_ppf(p: float) -> float:
    """Inverse of norm_cdf by bisection and Newton steps."""
    if not 0 < p < 1:
        return math.inf if p >= 1 else -math.inf
    lo, hi = -40.0, 40.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if norm_cdf(mid) < p else (lo, mid)
    x = (lo + hi) / 2
    for _ in range(2):
        d = math.exp(-x * x / 2) / math.sqrt(2 * math.pi)
        if d > 0:
            x -= (norm_cdf(x) - p) / d
    return x


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_sf(t: float, df: float) -> float:
    if math.isinf(t):
        return 0.0 if t > 0 else 1.0
    tail = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1 - tail


def t_cdf(t: float, df: float) -> float:
    return t_sf(-t, df)


def f_sf(f: float, d1: float, d2: float) -> float:
    if math.isinf(f):
        return 0.0
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_sf(x: float, k: float) -> float:
    """Upper tail by series or continued fraction of the incomplete gamma function."""
    if x <= 0:
        return 1.0
    a, z = k / 2, x / 2
    front = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-17:
            n += 1
            term *= z / n
            total += term
        return 1 - front * total
    b, c = z + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        num = -i * (i - a)
        b += 2
        d = 1 / (num * d + b)
        c = b + num / c
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def binom_two_sided(k: int, n: int) -> float:
    """Exact two-sided binomial p at 1/2."""
    if n == 0:
        return 1.0
    k = min(k, n - k)
    if 2 * k == n:
        return 1.0
    log_half = n * math.log(2)
    tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - log_half) for i in range(k + 1))
    return min(1.0, 2 * tail)


def signed_rank_two_sided(w: float, n: int) -> float:
    """Exact two-sided p of the signed-rank statistic, counting subsets of 1..n by their sum."""
    ways = [1]
    for r in range(1, n + 1):
        wider = ways + [0] * r
        for s, x in enumerate(ways):
            wider[s + r] += x
        ways = wider
    low = min(w, n * (n + 1) / 2 - w)
    return min(1.0, 2 * sum(ways[: int(math.floor(low)) + 1]) / 2**n)


def studentized_range_sf(q: float, k: int) -> float:
    """Upper tail of the range of k standard normals, by Simpson's rule."""
    if q <= 0:
        return 1.0
    n, lo, hi = 2000, -9.0, 9.0 + q
    h = (hi - lo) / n
    total = 0.0
    for i in range(n + 1):
        z = lo + i * h
        w = 1 if i in (0, n) else 4 if i % 2 else 2
        total += w * math.exp(-z * z / 2) * (norm_cdf(z) - norm_cdf(z - q)) ** (k - 1)
    return max(0.0, 1 - k * total * h / 3 / math.sqrt(2 * math.pi))


def studentized_range_ppf(p: float, k: int) -> float:
    lo, hi = 0.0, 50.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - studentized_range_sf(mid, k) < p else (lo, mid)
    return (lo + hi) / 2
