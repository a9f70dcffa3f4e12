"""Additive models of binned variables, fitted from sums alone, and their pairwise interactions.

With squared loss a step of cyclic boosting needs the residuals' sum in each bin of a variable.  That sum is the
target's, less what the other variables' scores add: numbers of rows by pairs of bins, times scores.  So one pass counts rows and sums
targets by bin and by pair of bins, (variables x bins) ** 2 numbers whatever the data's size, for the
training and the validation part at once, and every round after it, the stop included, is arithmetic on them.

Interactions: a second pass sums the main effects' residuals by pairs of bins.  A pair's worth is what the best
cut in four quadrants explains beyond each cut alone, from the corner totals of its two-dimensional running sums; the best
pairs get a table of residual means, shrunk towards 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import bin_right, dice
from tidemark.operators.model import bin_cuts

#: Rows of a bin below which a step doesn't cut, and rows that shrink a pair's cell.
LEAST, SHRINK = 10, 5.0


class Additive(NamedTuple):
    features: list[str]
    cuts: dict[str, list[float]]
    intercept: float
    scores: dict[str, list[float]]  # by slot: 0 missing, then bins
    pairs: dict[tuple[str, str], list[list[float]]]
    rounds: int
    worth: dict[tuple[str, str], float]


def slot(feature: str, cuts: Sequence[float]) -> Column:
    """0 for a missing value, else one more than the number of cuts at or below it."""
    x = F.col(feature).cast("double")
    array = F.array(*map(F.lit, map(float, cuts))) if cuts else F.expr("cast(array() as array<double>)")
    return F.when(x.isNull() | F.isnan(x), 0).otherwise(bin_right(x, array) + 1)


def step(g: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The best cut of one variable's bins in two, slot 0 on its own: mean residual of each side; zeros where none gains."""
    out = np.zeros(len(g))
    if n[0] >= LEAST:
        out[0] = g[0] / n[0]
    g1, n1 = g[1:].cumsum(), n[1:].cumsum()
    if not len(g1) or n1[-1] < 1:
        return out
    low, high = n1[:-1], n1[-1] - n1[:-1]
    ok = (low >= LEAST) & (high >= LEAST)
    if ok.any():
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(ok, g1[:-1] ** 2 / low + (g1[-1] - g1[:-1]) ** 2 / high, -np.inf)
        k = int(gain.argmax())
        out[1 : k + 2], out[k + 2 :] = g1[k] / low[k], (g1[-1] - g1[k]) / high[k]
    return out


def pair_worth(g: np.ndarray, n: np.ndarray) -> float:
    """What the best two cuts' quadrants explain beyond the better of their two halves, from corner totals (slots 0 left out)."""
    g, n = g[1:, 1:].cumsum(0).cumsum(1), n[1:, 1:].cumsum(0).cumsum(1)
    if min(g.shape) < 2:
        return 0.0
    corner = lambda t: (t[:-1, :-1], t[:-1, -1:] - t[:-1, :-1], t[-1:, :-1] - t[:-1, :-1], t[-1, -1] - t[:-1, -1:] - t[-1:, :-1] + t[:-1, :-1])
    q, m = corner(g), corner(n)
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda a, b: np.where(b > 0, a**2 / b, 0.0)
        four = sum(part(a, b) for a, b in zip(q, m, strict=True))
        rows = part(q[0] + q[1], m[0] + m[1]) + part(q[2] + q[3], m[2] + m[3])
        columns = part(q[0] + q[2], m[0] + m[2]) + part(q[1] + q[3], m[1] + m[3])
    ok = np.minimum.reduce(m) >= LEAST
    return float(np.where(ok, four - np.maximum(rows, columns), 0.0).max(initial=0.0))


def fit_additive(df: DataFrame, key: str, features: Sequence[str], target: str, bins: int = 32, rounds: int = 500, rate: float = 0.1, patience: int = 30, held: float = 0.2, pairs: int = 0, seed: int = 42) -> Additive:
    """Cyclic boosting with a stop, then up to ``pairs`` interactions.

    A share ``held`` of the keys, drawn by a hash, judges: rounds end when its squared error hasn't fallen for ``patience`` rounds, and
    scores go back to their best.  Scores of a variable are centred over the training rows.  Rows without a target are left out; a
    missing value has a slot of its own, and so has a value beyond the outer cuts in the outer bins.
    """
    names = list(features)
    rows = df.filter(F.col(target).isNotNull())
    cuts = {r.variable: [float(c) for c in r.cuts] for r in bin_cuts(rows, names, bins).collect()}
    cuts = {f: cuts.get(f, []) for f in names}
    size = [len(cuts[f]) + 2 for f in names]
    base = np.concatenate(([0], np.cumsum(size)))
    coded = rows.select((dice(F.col(key), seed) < held).alias("held"), F.col(target).cast("double").alias("y"), *(slot(f, cuts[f]).alias(f"c{i}") for i, f in enumerate(names)))
    cells = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    every = F.array(*(F.struct((F.col(f"c{i}") + int(base[i])).cast("int").alias("a"), (F.col(f"c{j}") + int(base[j])).cast("int").alias("b")) for i, j in cells))
    sums = coded.select("held", "y", F.explode(every).alias("x")).groupBy("held", "x.a", "x.b").agg(F.count("*").alias("n"), F.sum("y").alias("g"))
    n, g = np.zeros((2, base[-1], base[-1])), np.zeros((2, base[-1]))
    for r in sums.collect():  # at most (variables x bins) ** 2 numbers for each part
        n[int(r.held), r.a, r.b] = n[int(r.held), r.b, r.a] = r.n
        if r.a == r.b:
            g[int(r.held), r.a] = r.g
    train, test = 0, 1 if n[1].any() else 0
    own = np.stack([np.diag(x) for x in n])
    first = slice(0, size[0]) if names else slice(0, 0)
    total = own[train][first].sum()
    intercept = float(g[train][first].sum() / total) if total else 0.0
    left = g - intercept * own  # sums of residuals by bin
    score = np.zeros(base[-1])
    best, best_score, since, used = np.inf, score.copy(), 0, 0
    for r in range(rounds):
        for i in range(len(names)):
            mine = slice(base[i], base[i + 1])
            change = rate * step(left[train][mine], own[train][mine])
            score[mine] += change
            left -= n[:, :, mine] @ change
        # squared error less a constant: -2 f * sums + f * counts * f, of which sums of residuals know all
        error = -float(score @ (left[test] + g[test] - intercept * own[test]))
        if error < best - 1e-12 * abs(best if np.isfinite(best) else 1):
            best, best_score, since, used = error, score.copy(), 0, r + 1
        else:
            since += 1
        if since >= patience:
            break
    score = best_score
    for i in range(len(names)):
        mine = slice(base[i], base[i + 1])
        mean = float(score[mine] @ own[train][mine] / total) if total else 0.0
        score[mine] -= mean
        intercept += mean
    model = Additive(names, cuts, intercept, {f: score[base[i] : base[i + 1]].tolist() for i, f in enumerate(names)}, {}, used, {})
    return add_pairs(rows, model, target, pairs) if pairs and len(names) > 1 else model


def add_pairs(rows: DataFrame, model: Additive, target: str, most: int) -> Additive:
    """The model with its ``most`` pairs of greatest worth, each a table of shrunk residual means; tables follow one another."""
    pairs, names = dict(model.pairs), model.features
    codes = [slot(f, model.cuts[f]).alias(f"c{i}") for i, f in enumerate(names)]
    every = list(combinations(range(len(names)), 2))

    def tables(wanted: list[tuple[int, int]]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        now = Additive(*model[:4], pairs, *model[5:])
        coded = rows.select((F.col(target) - additive_column(now)).alias("r"), *codes)
        cell = F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"c{i}").alias("a"), F.col(f"c{j}").alias("b")) for k, (i, j) in enumerate(wanted)))
        out = {p: (np.zeros((len(model.cuts[names[p[0]]]) + 2, len(model.cuts[names[p[1]]]) + 2)), np.zeros((len(model.cuts[names[p[0]]]) + 2, len(model.cuts[names[p[1]]]) + 2))) for p in wanted}
        for r in coded.select("r", F.explode(cell).alias("x")).groupBy("x.k", "x.a", "x.b").agg(F.sum("r").alias("g"), F.count("*").alias("n")).collect():  # pairs x bins ** 2 numbers
            out[wanted[r.k]][0][r.a, r.b], out[wanted[r.k]][1][r.a, r.b] = r.g, r.n
        return out

    worth = {p: pair_worth(*t) for p, t in tables(every).items()}
    for p in sorted(worth, key=lambda p: (-worth[p], p))[:most]:
        if worth[p] > 0:
            g, n = tables([p])[p]  # after the pairs before it
            pairs[names[p[0]], names[p[1]]] = (g / (n + SHRINK)).tolist()
    return Additive(*model[:4], pairs, model.rounds, {(names[i], names[j]): w for (i, j), w in worth.items()})


def additive_column(model: Additive) -> Column:
    """Intercept, scores of all variables and pairs, in column functions."""
    table = lambda v: F.array(*map(F.lit, map(float, v)))
    total = F.lit(float(model.intercept))
    for f in model.features:
        total = total + F.get(table(model.scores[f]), slot(f, model.cuts[f]))
    for (a, b), t in model.pairs.items():
        total = total + F.get(table([x for row in t for x in row]), slot(a, model.cuts[a]) * len(t[0]) + slot(b, model.cuts[b]))
    return total


def term_table(spark, model: Additive) -> DataFrame:
    """The main effects as score_terms reads them: a last slot 0 for unknown values, values as they are."""
    rows = [(f, f, "numeric", 0.0, 1.0, None, model.cuts[f], [*model.scores[f], 0.0]) for f in model.features]
    return spark.createDataFrame(rows, "term string, variable string, kind string, mean double, scale double, category string, cuts array<double>, scores array<double>")
