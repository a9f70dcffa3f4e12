"""Normal mixtures with one variance: fitted to a histogram, and what a fitted one says.

Spark counts the histogram, some hundred bars whatever the data's size; the rest is arithmetic on the bars.
A mixture is given by its shares ``pi``, centres ``c`` and deviation ``sigma``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import norm_sf
from tidemark.functions.dist import norm_cdf

#: Rounds at most, and how near to its extrapolated limit the mean log density must come.
ROUNDS, NEAR = 500, 1e-10
#: Steps nearer than this many sigmas are one; steps with a lesser share of the rows are none.
MIN_SEPARATION, MIN_SHARE = 4.0, 0.01


def kmeans_1d(positions: Sequence[float], weights: Sequence[float], k: int) -> list[float]:
    """Centres of the k groups of sorted positions with the least weighted squared distance.

    Best groups are intervals.  A layer of the dynamic program says for each end of the row what g intervals cost up to
    it; where the last interval begins moves right as the end does (the cost satisfies the quadrangle
    inequality), so a layer is filled by halving: the middle end first, which bounds the search of both sides.
    """
    x, w = np.asarray(positions, float), np.asarray(weights, float)
    m, k = len(x), min(k, len(x))
    origin = float(np.average(x, weights=w)) if m else 0.0
    y = x - origin
    total = np.zeros((m + 1, 3))
    np.cumsum(np.stack([w, w * y, w * y * y], 1), axis=0, out=total[1:])

    def spread(i: np.ndarray | int, j: np.ndarray | int) -> np.ndarray:
        """Squared distance of bars i to j - 1 from their mean."""
        part = total[j] - total[i]
        return part[..., 2] - part[..., 1] ** 2 / part[..., 0]

    cost = np.concatenate(([np.inf], spread(0, np.arange(1, m + 1)))) if m else np.zeros(1)
    begins: list[np.ndarray] = []
    for g in range(1, k):
        nxt, begin = np.full(m + 1, np.inf), np.zeros(m + 1, int)
        open_ = [(g + 1, m, g, m - 1)]
        while open_:
            lo, hi, first, last = open_.pop()
            if lo > hi:
                continue
            end = (lo + hi) // 2
            i = np.arange(first, min(last, end - 1) + 1)
            tried = cost[i] + spread(i, end)
            at = int(np.argmin(tried))
            nxt[end], begin[end] = tried[at], i[at]
            open_ += [(lo, end - 1, first, int(i[at])), (end + 1, hi, int(i[at]), last)]
        cost = nxt
        begins.append(begin)
    cuts = [m]
    for begin in reversed(begins):
        cuts.append(int(begin[cuts[-1]]))
    cuts = [0, *reversed(cuts)] if m else []
    return [origin + float((total[b, 1] - total[a, 1]) / (total[b, 0] - total[a, 0])) for a, b in zip(cuts, cuts[1:], strict=False)]


class Mixture(NamedTuple):
    pi: np.ndarray
    c: np.ndarray
    sigma: float
    log_likelihood: float = math.nan

    def cdf(self, x: float) -> float:
        return float(sum(p * norm_cdf((x - c) / self.sigma) for p, c in zip(self.pi, self.c, strict=True)))

    def density(self, x: np.ndarray) -> np.ndarray:
        z = (np.asarray(x, float)[..., None] - self.c) / self.sigma
        return (self.pi * np.exp(-0.5 * z * z)).sum(-1) / (self.sigma * math.sqrt(2 * math.pi))

    def support(self) -> tuple[float, float]:
        """Ends beyond which nothing of note lies."""
        return float(min(self.c)) - 9 * self.sigma, float(max(self.c)) + 9 * self.sigma

    def quantile(self, p: float) -> float:
        """Where the distribution function reaches p, by halving."""
        lo, hi = self.support()
        for _ in range(90):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if self.cdf(mid) < p else (lo, mid)
        return (lo + hi) / 2

    def above(self, level: float, points: int = 4096) -> list[tuple[float, float]]:
        """The intervals where the density is at least level; ends lie where a fine grid's density crosses it, or at the support's."""
        grid = np.linspace(*self.support(), points)
        f = self.density(grid)
        up = np.concatenate(([False], f >= level, [False]))
        turn = np.flatnonzero(up[1:] != up[:-1])

        def crossing(k: int) -> float:
            if k in (0, points):
                return float(grid[min(k, points - 1)])
            a, b = f[k - 1], f[k]
            return float(grid[k - 1] + (level - a) / (b - a) * (grid[k] - grid[k - 1]))

        return [(crossing(int(a)), crossing(int(b))) for a, b in zip(turn[::2], turn[1::2], strict=True)]

    def level_set(self, share: float, points: int = 4096) -> list[tuple[float, float]]:
        """The intervals of greatest density that hold share, least in total length; the density's level is halved until they do."""
        lo, hi = 0.0, float(self.density(np.linspace(*self.support(), points)).max())
        for _ in range(60):
            level = (lo + hi) / 2
            lo, hi = (level, hi) if sum(self.cdf(b) - self.cdf(a) for a, b in self.above(level, points)) >= share else (lo, level)
        return self.above(lo, points)


def settled(levels: list[float]) -> bool:
    """Whether a rising series is at its limit, as Aitken's extrapolation of the last three terms has it."""
    if len(levels) < 3:
        return False
    was, now = levels[-2] - levels[-3], levels[-1] - levels[-2]
    if now <= 0 or was <= 0 or now >= was:
        return now <= NEAR / 100
    return now * now / (was - now) < NEAR


def fit_bars(x: np.ndarray, n: np.ndarray, width: float, k: int, sigma_min: float = 0.0) -> Mixture:
    """Expectation maximization over bars: centres x, counts n, one width.

    A bar's rows lie anywhere in it, which adds width ** 2 / 12 to the variance.  Components without rows go.
    """
    blur, total = max(width * width / 12, sigma_min * sigma_min, 1e-300), float(n.sum())
    c = np.array(kmeans_1d(x, n, k))
    owner = np.abs(x[:, None] - c).argmin(1)
    pi = np.bincount(owner, n, len(c)) / total
    var = float(n @ (x - c[owner]) ** 2) / total + blur
    moments, levels = n[:, None] * np.stack([np.ones_like(x), x, x * x], 1), []
    while True:
        joint = np.log(pi) - 0.5 * (np.log(2 * math.pi * var) + (x[:, None] - c) ** 2 / var)
        density = np.logaddexp.reduce(joint, axis=1)
        levels.append(float(n @ density) / total)
        if settled(levels) or len(levels) > ROUNDS:
            return Mixture(pi, c, math.sqrt(var), levels[-1] * total)
        mass, first, second = (np.exp(joint - density[:, None]).T @ moments).T
        some = mass > 1e-12 * total
        mass, first, second = mass[some], first[some], second[some]
        c, pi = first / mass, mass / mass.sum()
        var = max(0.0, float((second - first * c).sum()) / total) + blur


def useful_steps(pi: Sequence[float], c: Sequence[float], sigma: float) -> int:
    """Components that are steps of their own, one at least.

    A step takes all centres less than MIN_SEPARATION sigmas above its lowest; those with MIN_SHARE of the rows count.
    """
    order = np.argsort(c)
    at, upto = np.asarray(c, float)[order], np.concatenate(([0.0], np.cumsum(np.asarray(pi, float)[order])))
    end = np.searchsorted(at, at + MIN_SEPARATION * sigma)  # where a step that begins at each centre would end
    lows = [0]
    while lows[-1] < len(at):
        lows.append(int(max(end[lows[-1]], lows[-1] + 1)))
    return max(1, int((np.diff(upto[lows]) >= MIN_SHARE).sum()))


def choose_bars(x: np.ndarray, n: np.ndarray, width: float, most: int, sigma_min: float = 0.0) -> Mixture:
    """The mixture of up to ``most`` components with the least BIC, refitted with its useful steps alone."""
    rows = float(n.sum())
    bic: Callable[[Mixture], float] = lambda m: 2 * len(m.c) * math.log(rows) - 2 * m.log_likelihood
    best = min((fit_bars(x, n, width, k, sigma_min) for k in range(1, most + 1)), key=bic)
    steps = useful_steps(best.pi, best.c, best.sigma)
    return best if steps == len(best.c) else fit_bars(x, n, width, steps, sigma_min)


def fit_mixture(df: DataFrame, r: str, k: int | None = None, bins: int = 512, sigma_min: float = 0.0, most: int = 8) -> DataFrame:
    """One row pi, c, sigma, log_likelihood; without ``k`` BIC and pruning choose the number of components.

    Null and NaN values are left out; no value at all is an error.
    """
    from tidemark.operators.profile import histogram

    bars = histogram(df.filter(~F.isnan(F.col(r).cast("double"))), r, bins).filter("n > 0").orderBy("low").collect()  # bins rows at most
    if not bars:
        raise ValueError(f"{r} has no value")
    x, n = np.array([(b.low + b.high) / 2 for b in bars], float), np.array([b.n for b in bars], float)
    width = float(bars[0].high - bars[0].low)
    m = choose_bars(x, n, width, most, sigma_min) if k is None else fit_bars(x, n, width, k, sigma_min)
    return df.sparkSession.createDataFrame([(m.pi.tolist(), m.c.tolist(), m.sigma, m.log_likelihood)], "pi array<double>, c array<double>, sigma double, log_likelihood double")


def exceedance(mean: Column, threshold: Column, pi: Column, c: Column, sigma: Column) -> Column:
    """P(mean + mixture error > threshold), in column functions."""
    tails = F.zip_with(pi, c, lambda p, k: p * norm_sf((threshold - mean - k) / sigma))
    return F.aggregate(tails, F.lit(0.0), lambda a, t: a + t)


def mixture_outputs(df: DataFrame, mean: str, m: Mixture, threshold: float, share: float = 0.9, at: float = 0.5) -> DataFrame:
    """df with p_exceeds, quantile (at), low and high (equal tails), and level_set (array of intervals).

    One mixture serves all rows, so its quantiles and intervals are numbers that move with each row's mean.
    """
    arr = lambda v: F.array(*(F.lit(float(x)) for x in v))
    tail = (1 - share) / 2
    moved = lambda x: F.col(mean) + F.lit(float(x))
    sets = F.array(*(F.struct(moved(a).alias("low"), moved(b).alias("high")) for a, b in m.level_set(share)))
    return df.withColumns({
        "p_exceeds": exceedance(F.col(mean), F.lit(float(threshold)), arr(m.pi), arr(m.c), F.lit(float(m.sigma))),
        "quantile": moved(m.quantile(at)), "low": moved(m.quantile(tail)), "high": moved(m.quantile(1 - tail)), "level_set": sets,
    })


def set_coverage(df: DataFrame, y: str) -> DataFrame:
    """One row: share of rows whose y is in the interval and in the level set, and their mean lengths."""
    inside = F.exists("level_set", lambda s: (F.col(y) >= s["low"]) & (F.col(y) <= s["high"]))
    length = F.aggregate("level_set", F.lit(0.0), lambda a, s: a + s["high"] - s["low"])
    return df.agg(F.avg(F.col(y).between(F.col("low"), F.col("high")).cast("double")).alias("interval_coverage"), F.avg(F.col("high") - F.col("low")).alias("interval_length"), F.avg(inside.cast("double")).alias("set_coverage"), F.avg(length).alias("set_length"))


def density_column(r: Column, m: Mixture) -> Column:
    """The mixture's density at r, in column functions."""
    z = lambda c: (r - F.lit(float(c))) / F.lit(float(m.sigma))
    terms = [F.lit(float(p)) * F.exp(-0.5 * z(c) * z(c)) for p, c in zip(m.pi, m.c, strict=True)]
    return sum(terms[1:], terms[0]) / F.lit(m.sigma * math.sqrt(2 * math.pi))


def calibrated_sets(fit: DataFrame, calibration: DataFrame, test: DataFrame, r: str, coverages: Sequence[float], components: int | None = None) -> DataFrame:
    """nominal, level, length, pieces, covered: prediction sets by density, with the density as the conformal score.

    A mixture is fitted to the residuals r of ``fit``; a set is where its density reaches the floor((1 - nominal) * (n + 1))-th smallest
    density of the n calibration rows (0, and the whole support, where that place is below 1), and covered is the share of test rows in
    it.  The order statistics come from running counts of distinct densities, whatever the number of rows.
    """
    from tidemark.operators.order import running_totals

    g = fit_mixture(fit, r, components).head()
    m = Mixture(np.array(g.pi), np.array(g.c), g.sigma)
    score = calibration.filter(F.col(r).isNotNull()).select(density_column(F.col(r), m).alias("f"))
    counts = score.groupBy("f").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    place = [math.floor(round((1 - c) * (total + 1), 9)) for c in coverages]
    upto = running_totals(counts, "f", {"upto": "n"})
    found = upto.agg(*(F.min(F.when(F.col("upto") >= k, F.col("f"))).alias(f"l{i}") for i, k in enumerate(place))).first()
    levels = [float(found[i]) if k >= 1 and found[i] is not None else 0.0 for i, k in enumerate(place)]
    f = density_column(F.col(r), m)
    share = test.filter(F.col(r).isNotNull()).agg(*(F.avg((f >= F.lit(x)).cast("double")).alias(f"s{i}") for i, x in enumerate(levels))).first()
    rows = []
    for i, (c, x) in enumerate(zip(coverages, levels, strict=True)):
        pieces = m.above(x)
        rows.append((float(c), x, float(sum(b - a for a, b in pieces)), len(pieces), share[i]))
    return test.sparkSession.createDataFrame(rows, "nominal double, level double, length double, pieces int, covered double")
