"""Additive trees and the step-mixture model on them.

Trees split at cuts, so they can't tell rows of equal bins apart: rows become cells once, with their number and mean target, which
is all that squared and logistic losses need.  The state is an expression: each tree is a nested condition, so a round is ``depth``
aggregations of the cells into (node, variable, bin) sums, a few thousand numbers whatever the data's size.  Every ``CUT`` rounds
predictions become a checkpointed column, which bounds the expression and the lineage.  What needs single rows (a mixture's
responsibilities) joins the cells' predictions, once a turn.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import bin_left, sigmoid
from tidemark.operators.metrics import conformal_level, kth_smallest
from tidemark.operators.mixture import exceedance, fit_mixture
from tidemark.operators.model import bin_cuts, mixture_e_step
from tidemark.session import scratch_root

CUT = 5
#: Cells up to this many are broadcast to the rows; more are joined as Spark sees fit.
BROADCAST_CELLS = 100_000


def checkpointed(df: DataFrame) -> DataFrame:
    """Rows written to the shared checkpoint folder."""
    scratch_root(df.sparkSession)  # sets one for local sessions, refuses a cluster without
    return df.checkpoint()


def tree_column(tree: dict, features: Sequence[str], k: int = 0, leaf: str = "value") -> Column:
    """A tree, lists by heap place, as nested conditions; leaf 'node' gives the leaf's place instead of its value."""
    if k not in tree["split"]:
        return F.lit(k) if leaf == "node" else F.lit(float(tree["value"].get(k, 0.0)))
    v, cut = tree["split"][k]
    return F.when(F.col(features[v]) <= cut, tree_column(tree, features, 2 * k + 1, leaf)).otherwise(tree_column(tree, features, 2 * k + 2, leaf))


def code_column(feature: str, cuts: Sequence[float]) -> Column:
    """Number of cuts below the feature; nulls get the last code, for they go right at every split."""
    table = F.array(*map(F.lit, cuts)) if cuts else F.expr("cast(array() as array<double>)")
    return F.when(F.col(feature).isNull(), len(cuts)).otherwise(bin_left(feature, table))


def coded(df: DataFrame, features: Sequence[str], cuts: dict[str, list[float]]) -> DataFrame:
    """df with the features' codes in __c0, __c1, ..."""
    return df.withColumns({f"__c{i}": code_column(f, cuts[f]) for i, f in enumerate(features)})


def cells(rows: DataFrame, features: Sequence[str], target: str | None = None) -> DataFrame:
    """A row for each combination of codes in coded rows: codes, features (a value each that every cut sees alike), __n and the mean target.

    Rows without a target are left out if one is named.  There are no more cells than rows, and no more than products of bins.
    """
    at = [f"__c{i}" for i in range(len(features))]
    mean = [] if target is None else [F.avg(target).alias(target)]
    rows = rows if target is None else rows.filter(F.col(target).isNotNull())
    return checkpointed(rows.groupBy(*at).agg(*(F.min(f).alias(f) for f in features), F.count("*").alias("__n"), *mean))


def at_rows(rows: DataFrame, of: DataFrame, features: Sequence[str], column: Column, name: str = "__f") -> DataFrame:
    """Coded rows with a column of their cells."""
    at = [f"__c{i}" for i in range(len(features))]
    side = of.select(*at, column.alias(name))
    return rows.join(F.broadcast(side) if of.count() <= BROADCAST_CELLS else side, at)


def _splits(sums: Sequence, least: int, lam: float) -> dict[int, tuple]:
    """By node variable, code, nl, nr, gl, gr of the split of greatest gain, ties by variable and code, as model.best_split has it."""
    by: dict[tuple, list] = {}
    for r in sums:
        by.setdefault((r.node, r.variable), []).append((r.code, r.n, r.g or 0.0))
    best: dict[int, tuple] = {}
    for (node, variable), bins in sorted(by.items()):
        bins.sort()
        nt, gt = sum(x[1] for x in bins), math.fsum(x[2] for x in bins)
        nl, gl = 0, 0.0
        for code, n, g in bins:
            nl, gl = nl + n, gl + g
            nr, gr = nt - nl, gt - gl
            if nl < least or nr < least:
                continue
            gain = round(gl**2 / (nl + lam) + gr**2 / (nr + lam) - gt**2 / (nt + lam), 9)
            if gain > 1e-9 and (node not in best or gain > best[node][0]):
                best[node] = (gain, variable, code, nl, nr, gl, gr)
    return {k: b[1:] for k, b in best.items()}


def fit_tree(df: DataFrame, features: Sequence[str], cuts: dict[str, list[float]], residual: Column, depth: int, least: int, lam: float, n: str | None = None) -> dict:
    """A least-squares tree of the residual, grown by levels: one job a level, whose sums are the leaves' values too.

    Nulls go right at every split, in the sums as in tree_column.  ``n``: df has cells, this column their numbers of rows, and
    residual is a cell's mean.
    """
    tree: dict = {"split": {}, "value": {}}
    size = F.lit(1) if n is None else F.col(n)
    code = lambda i, c: code_column(c, cuts[c]) if n is None else F.col(f"__c{i}")
    codes = F.array(*(F.struct(F.lit(i).alias("i"), code(i, c).alias("code")) for i, c in enumerate(features)))
    for level in range(depth):
        rows = df.select(tree_column(tree, features, leaf="node").alias("node"), (size * residual).alias("r"), size.alias("n"), F.inline(codes)).filter(F.col("node") >= 2**level - 1)
        sums = rows.groupBy("node", "i", "code").agg(F.sum("r").alias("g"), F.sum("n").alias("n")).withColumn("variable", F.element_at(F.array(*map(F.lit, features)), F.col("i") + 1))
        best = _splits(sums.collect(), least, lam)  # at most nodes x variables x bins numbers
        if not best:
            break
        for node, (variable, at, nl, nr, gl, gr) in best.items():
            tree["split"][node] = (features.index(variable), cuts[variable][at])
            tree["value"] |= {2 * node + 1: gl / (nl + lam), 2 * node + 2: gr / (nr + lam)}
    if not tree["split"]:
        tree["value"] = {0: df.agg(F.sum(size * residual) / (F.sum(size) + lam)).head()[0] or 0.0}
    return tree


class Followed:
    """Cells with the sum of trees so far, in column ``__f`` and an expression on it that becomes the column every CUT trees."""

    def __init__(self, df: DataFrame, model: dict):
        self.features, self.rate, self.trees = model["features"], model["rate"], 0
        self.df, self.done = df.withColumn("__f", F.lit(float(model["intercept"]))), F.col("__f")
        for tree in model["trees"]:
            self.add(tree)
        self.settle()

    def add(self, tree: dict) -> None:
        self.done = self.done + self.rate * tree_column(tree, self.features)
        self.trees += 1
        if self.trees % CUT == 0:
            self.settle()

    def settle(self) -> None:
        self.df, self.done = checkpointed(self.df.withColumn("__f", self.done)), F.col("__f")

    def state(self) -> tuple[DataFrame, Column, int]:
        return self.df, self.done, self.trees

    def back(self, state: tuple[DataFrame, Column, int]) -> None:
        self.df, self.done, self.trees = state


def value_cuts(df: DataFrame, features: Sequence[str], bins: int) -> dict[str, list[float]]:
    """Cuts by variable, variables x bins numbers."""
    return {r.variable: list(r.cuts) for r in bin_cuts(df, features, bins).collect()}


def boost(df: DataFrame, features: Sequence[str], target: str, rounds: int = 20, depth: int = 3, rate: float = 0.1, least: int = 20, lam: float = 1.0, bins: int = 32, logistic: bool = False, watch: DataFrame | None = None, patience: int = 10) -> dict:
    """Least-squares boosting; with ``watch``, rows that judge, it stops after ``patience`` trees without a lesser error and keeps the best.

    ``logistic``: the target is 0 or 1 and the sum of trees is its log odds.  A row's curvature is at most 1/4, so trees
    follow four times the gradient, a step that can't raise the loss.
    """
    mean = df.agg(F.avg(target)).head()[0]
    if logistic:
        share = min(max(mean, 1e-6), 1 - 1e-6)
        mean = math.log(share / (1 - share))
    model = {"features": list(features), "trees": [], "rate": rate, "intercept": mean}
    cuts = value_cuts(df, features, bins)
    follow = lambda x: Followed(cells(coded(x, features, cuts), features, target), model)
    rows, judge = follow(df), None if watch is None else follow(watch)
    _warm(model, rows, judge, cuts, target, rounds, patience, depth, least, lam, logistic)
    return model


def _warm(model: dict, rows: Followed, judge: Followed | None, cuts: dict, target: str, rounds: int, patience: int, depth: int, least: int, lam: float, logistic: bool) -> None:
    """Trees on the residuals, in place; the judge's error stops them.  Errors of CUT trees come from one job, and count one by one."""

    def loss(f: Column) -> Column:
        y = F.col(target)
        of = F.log1p(F.exp(-F.abs(f))) + F.greatest(f, F.lit(0.0)) - y * f if logistic else (y - f) ** 2  # without the spread within cells, which no tree changes
        return F.sum(F.col("__n") * of) / F.sum("__n")

    def better(waiting: list) -> bool:
        """Take in the errors of waiting trees; whether patience has ended."""
        nonlocal best
        errors = waiting[0][1].agg(*(loss(f).alias(f"e{i}") for i, (_, _, f, _, _) in enumerate(waiting))).head()
        for e, (n, _, _, mine, theirs) in zip(errors, waiting, strict=True):
            if best is None or (e or 0.0) < best[0]:
                best = (e or 0.0, n, mine, theirs)
            elif n - best[1] >= patience:
                return True
        return False

    best, waiting = None, []
    if judge is not None:
        better([(0, judge.df, judge.done, rows.state(), judge.state())])
    for k in range(rounds):
        goal = 4 * (F.col(target) - sigmoid(rows.done)) if logistic else F.col(target) - rows.done
        tree = fit_tree(rows.df, model["features"], cuts, goal, depth, least, lam, "__n")
        model["trees"].append(tree)
        rows.add(tree)
        if judge is None:
            continue
        seen = judge.df, judge.done + judge.rate * tree_column(tree, judge.features)
        judge.add(tree)
        waiting.append((len(model["trees"]), *seen, rows.state(), judge.state()))
        if judge.trees % CUT == 0 or k == rounds - 1:
            if better(waiting):
                break
            waiting = []
    if judge is not None:
        del model["trees"][best[1] :]
        rows.back(best[2])
        judge.back(best[3])


def predict_column(model: dict) -> Column:
    return reduce(lambda a, t: a + model["rate"] * tree_column(t, model["features"]), model["trees"], F.lit(float(model["intercept"])))


def fit_steps(train: DataFrame, calibration: DataFrame, features: Sequence[str], target: str, components: int | None = None, warm: int = 100, turns: int = 400, rounds: int = 5, coverage: float = 0.9, validation: DataFrame | None = None, warm_patience: int = 10, patience: int = 20, depth: int = 3, rate: float = 0.1, least: int = 20, lam: float = 1.0, bins: int = 32) -> dict:
    """Boosting plus a mixture of latent steps: warm-up trees, a mixture of their residuals, then generalized EM.

    In each turn responsibilities give every row its expected step, ``rounds`` trees go on against the rest, and the mixture follows the
    new residuals under the same responsibilities.  ``validation`` rows (none: no stop) judge: the warm-up by its error, with ``warm_patience``
    trees, the turns by the distance of residuals from the nearest step, with ``patience`` turns; forest and mixture go back to
    the best turn.  There are as many components as were given, or as BIC and pruning leave; the half width of the interval comes from
    calibration rows.  model["history"] has the turns' errors.
    """
    mean, spread = train.agg(F.avg(target), F.stddev_pop(target)).head()
    model = {"features": list(features), "trees": [], "rate": rate, "intercept": mean, "history": []}
    model["cuts"] = cuts = value_cuts(train, features, bins)
    at = [f"__c{i}" for i in range(len(features))]
    y = F.col(target)
    single = lambda df: checkpointed(coded(df.filter(y.isNotNull()), features, cuts).select(*at, *features, target))
    mine, theirs = single(train), None if validation is None else single(validation)
    rows, judge = Followed(cells(mine, features, target), model), None if theirs is None else Followed(cells(theirs, features, target), model)
    mine, theirs = mine.select(*at, target), None if theirs is None else theirs.select(*at, target)
    _warm(model, rows, judge, cuts, target, warm, warm_patience, depth, least, lam, False)
    model["warm"] = len(model["trees"])
    m = fit_mixture(at_rows(mine, rows.df, features, rows.done).select((y - F.col("__f")).alias("__r")), "__r", components).head()
    pi, c, sigma = list(m.pi), list(m.c), m.sigma
    least_sigma = 1e-6 * (spread or 1.0)

    def error() -> float:
        r = y - F.col("__f")
        near = F.array_min(F.array(*((r - float(x)) ** 2 for x in c)))
        return math.sqrt(at_rows(theirs, judge.df, features, judge.done).agg(F.avg(near)).head()[0] or 0.0)

    best = None if judge is None else (error(), len(model["trees"]), (pi, c, sigma))
    since = 0
    for _ in range(turns):
        p = train.sparkSession.createDataFrame([(pi, c, sigma)], "pi array<double>, c array<double>, sigma double")
        owned = mixture_e_step(at_rows(mine, rows.df, features, rows.done).withColumn("__r", y - F.col("__f")), "__r", p)
        k = range(len(c))
        gamma = lambda j: F.get("gamma", F.lit(j))
        # per cell and component the sums of responsibilities, and of residuals and their squares under them: all that a turn needs of rows
        sums = owned.groupBy(*at).agg(*(F.sum(gamma(j) * F.col("__r") ** e).alias(f"__{n}{j}") for j in k for e, n in enumerate("msq")))
        turn = rows.df.withColumn("__f", rows.done).join(F.broadcast(sums) if rows.df.count() <= BROADCAST_CELLS else sums, at)
        rest = sum((F.col(f"__s{j}") - F.lit(float(c[j])) * F.col(f"__m{j}") for j in k), F.lit(0.0))
        turn = turn.withColumns({"__was": F.col("__f"), "__goal": F.col("__f") + rest / F.col("__n")})
        rows.df, rows.done = turn, F.col("__f")
        rows.settle()
        for _ in range(rounds):
            tree = fit_tree(rows.df, model["features"], cuts, F.col("__goal") - rows.done, depth, least, lam, "__n")
            model["trees"].append(tree)
            rows.add(tree)
            if judge is not None:
                judge.add(tree)
        pi, c, sigma = _moved(rows.df, rows.done - F.col("__was"), c, sigma, least_sigma)
        kept = [x for x in rows.df.columns if x not in ("__was", "__goal") and x[:3] not in ("__m", "__s", "__q")]
        rows.df, rows.done = rows.df.withColumn("__f", rows.done).select(*kept), F.col("__f")
        rows.settle()
        if judge is None:
            continue
        judge.settle()
        model["history"].append(now := error())
        if now < best[0] * (1 - 1e-6):
            best, since = (now, len(model["trees"]), (pi, c, sigma)), 0
        else:
            since += 1
            if since >= patience:
                break
    if judge is not None:
        del model["trees"][best[1] :]
        pi, c, sigma = best[2]
    model |= {"pi": pi, "c": c, "sigma": sigma}
    shift = sum(p * x for p, x in zip(pi, c, strict=True))
    model["half_width"] = kth_smallest(predicted(calibration, model).select(F.abs(y - F.col("__f") - shift).alias("r")), "r", conformal_level(coverage)).head()[0]
    return model


def _moved(df: DataFrame, by: Column, c: Sequence[float], sigma: float, least_sigma: float) -> tuple[list[float], list[float], float]:
    """The mixture's maximum, shares, centres (an empty component's stays) and deviation, from the cells' sums once their predictions moved."""
    m, s, q = F.col, lambda j: F.col(f"__s{j}") - by * F.col(f"__m{j}"), lambda j: F.col(f"__q{j}") - 2 * by * F.col(f"__s{j}") + by * by * F.col(f"__m{j}")
    k = range(len(c))
    g = df.agg(*(F.sum(e).alias(f"{n}{j}") for j in k for n, e in (("m", m(f"__m{j}")), ("s", s(j)), ("q", q(j))))).head()
    total = sum(g[f"m{j}"] or 0.0 for j in k)
    if not total:
        return [1 / len(c)] * len(c), list(c), sigma
    centres = [g[f"s{j}"] / g[f"m{j}"] if g[f"m{j}"] else c[j] for j in k]
    var = sum(g[f"q{j}"] - 2 * x * g[f"s{j}"] + x * x * g[f"m{j}"] for j, x in zip(k, centres, strict=True)) / total
    return [g[f"m{j}"] / total for j in k], centres, max(math.sqrt(max(var, 0.0)), least_sigma)


def predicted(df: DataFrame, model: dict) -> DataFrame:
    """df with the sum of trees in __f, found once for each cell of the model's cuts."""
    features = model["features"]
    rows = coded(df, features, model["cuts"])
    of = Followed(cells(rows, features), model).df
    return at_rows(rows, of, features, F.col("__f")).select(*df.columns, "__f")


def mean_column(model: dict) -> Column:
    """Expected value: trees plus the mean step."""
    return predict_column(model) + sum(p * c for p, c in zip(model["pi"], model["c"], strict=True))


def step_outputs(df: DataFrame, model: dict, threshold: float) -> DataFrame:
    """df with forecast, low, high and the probability of exceeding the threshold; the model is one of fit_steps."""
    arr = lambda v: F.array(*map(F.lit, map(float, v)))
    out = predicted(df, model).withColumn("forecast", F.col("__f") + sum(p * c for p, c in zip(model["pi"], model["c"], strict=True)))
    out = out.withColumns({"low": F.col("forecast") - model["half_width"], "high": F.col("forecast") + model["half_width"]})
    return out.withColumn("p_exceeds", exceedance(F.col("__f"), F.lit(float(threshold)), arr(model["pi"]), arr(model["c"]), F.lit(float(model["sigma"])))).drop("__f")
