"""Scalar helpers: functions from columns to columns, all evaluated by the engine itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def corr(a: str | Column, b: str | Column) -> Column:
    """Pearson correlation over rows that have both; null where either is constant."""
    a, b = col(a).cast("double"), col(b).cast("double")
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(F.when(b.isNotNull(), a)) * F.stddev_pop(F.when(a.isNotNull(), b)))


def isclose(a: str | Column, b: str | Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """|a - b| <= atol + rtol * |b|; false where either is null, as nothing is close to a missing value."""
    return F.coalesce(F.abs(col(a) - col(b)) <= F.lit(atol) + F.lit(rtol) * F.abs(col(b)), F.lit(False))


def days_between(late: str | Column, early: str | Column) -> Column:
    """Complete elapsed days of 24 hours, not calendar days."""
    late, early = col(late), col(early)
    return F.timestamp_diff("DAY", early, late)


def clip(x: str | Column, low: float | None = None, high: float | None = None) -> Column:
    """x within [low, high]; null stays null."""
    x = col(x)
    out = x
    if low is not None:
        out = F.when(x.isNotNull(), F.greatest(out, F.lit(low)))
    if high is not None:
        out = F.when(x.isNotNull(), F.least(out, F.lit(high)))
    return out


def half_even(x: str | Column, digits: int = 0) -> Column:
    """Rounding to even on ties."""
    return F.bround(col(x), digits)


def sigmoid(x: str | Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x)))


def logit(p: str | Column, eps: float = 1e-6) -> Column:
    p = clip(p, eps, 1 - eps)
    return F.ln(p / (F.lit(1.0) - p))


def logaddexp(a: str | Column, b: str | Column) -> Column:
    a, b = col(a), col(b)
    top = F.greatest(a, b)
    return top + F.ln(F.exp(a - top) + F.exp(b - top))


def skew_g1(x: str | Column) -> Column:
    """Bias-corrected sample skewness; null below three values."""
    n = F.count(col(x)).cast("double")
    return F.when(n > 2, F.skewness(col(x)) * F.sqrt(n * (n - 1)) / (n - 2))


def bin_left(x: str | Column, cuts: Column) -> Column:
    """Number of cuts below x (a cut equal to x isn't)."""
    x = col(x)
    return F.size(F.filter(cuts, lambda c: c < x))


def bin_right(x: str | Column, cuts: Column) -> Column:
    """Number of cuts at or below x."""
    x = col(x)
    return F.size(F.filter(cuts, lambda c: c <= x))


def hist_bucket(x: str | Column, low: Column, high: Column, n: int) -> Column:
    """1..n for n equal bins of [low, high], the last one closed; outside values go to the end bins."""
    return F.least(F.greatest(F.width_bucket(col(x).cast("double"), low.cast("double"), high.cast("double"), F.lit(n)), F.lit(1)), F.lit(n))


def interp(x: str | Column, xs: Column, ys: Column) -> Column:
    """Piecewise-linear through (xs, ys), arrays with xs ascending; constant beyond both ends."""
    x = col(x).cast("double")
    k = bin_right(x, xs)
    n = F.size(xs)
    x0, x1 = F.get(xs, k - 1), F.get(xs, k)
    y0, y1 = F.get(ys, k - 1), F.get(ys, k)
    inner = y0 + (y1 - y0) * F.try_divide(x - x0, x1 - x0)
    return F.when(x.isNull(), None).when(k == 0, F.get(ys, F.lit(0))).when(k >= n, F.get(ys, n - 1)).otherwise(inner)


def recode(x: str | Column, table: dict, default=None) -> Column:
    """Value by dictionary, default where the key isn't there."""
    pairs = [F.lit(v) for kv in table.items() for v in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), col(x)), F.lit(default))


def branch(*cases: tuple[Column, object], otherwise=None) -> Column:
    """The value of the first case that holds."""
    out = F.when(*cases[0])
    for c in cases[1:]:
        out = out.when(*c)
    return out.otherwise(otherwise)


#: Bands of effect sizes.
CLIFF, COHEN = (0.147, 0.33, 0.474), (0.2, 0.5, 0.8)


def magnitude(x: str | Column, cuts: tuple[float, float, float]) -> Column:
    v = F.abs(col(x))
    return F.when(v < cuts[0], "negligible").when(v < cuts[1], "small").when(v < cuts[2], "medium").when(v.isNotNull(), "large")


#: Hart's rational approximation of the normal tail (double precision, as published by West 2005).
TAIL_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
TAIL_LOW = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
TAIL_FAR = 7.07106781186547


def norm_sf(z: str | Column) -> Column:
    """P(a standard normal exceeds z): a ratio of polynomials up to TAIL_FAR, a continued fraction beyond; null stays null."""
    z = col(z)
    x = F.abs(z)
    bell = F.exp(-x * x / 2)
    top, low = F.lit(0.0), F.lit(0.0)
    for k in TAIL_TOP:
        top = top * x + k
    for k in TAIL_LOW:
        low = low * x + k
    far = x + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        far = x + k / far
    tail = F.when(x < TAIL_FAR, bell * top / low).when(x < 37, bell / far / 2.506628274631).otherwise(0.0)
    return F.when(z > 0, tail).when(z.isNotNull(), 1.0 - tail)


def place_among(x: str | Column, cuts: Column, most: int) -> Column:
    """Number of ascending cuts (``most`` at most) at or below x, by binary search."""
    x, steps = col(x), [1 << k for k in range(max(1, most).bit_length() - 1, -1, -1)]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when(F.get(cuts, at + s - 1) <= x, at + s).otherwise(at))


def dice(key: Column, seed: int) -> Column:
    """A number in [0, 1) that only key and seed decide."""
    return F.conv(F.substring(F.md5(F.concat_ws("#", key.cast("string"), F.lit(str(seed))).cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
