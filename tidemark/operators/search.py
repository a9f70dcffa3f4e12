"""Parameter search and nested cross-validation from fold sums.

One pass turns the data into sums of outer products per fold; every combination of training folds, penalty and
variables is then arithmetic on these sums, so neither a grid nor a whole adaptive search costs a further pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import dice


def grid(spark, **axes: Sequence) -> DataFrame:
    """All combinations of parameter values, with a number each."""
    from itertools import product

    rows = [(k, *map(float, v)) for k, v in enumerate(product(*axes.values()))]
    return spark.createDataFrame(rows, "config long, " + ", ".join(f"{a} double" for a in axes))


def random_configs(spark, n: int, seed: int = 42, **ranges: tuple[float, float]) -> DataFrame:
    """n configurations, log-uniform in the given ranges, that only seed and number decide."""
    df = spark.range(n).withColumnRenamed("id", "config")
    return df.select("config", *(F.exp(F.log(F.lit(float(lo))) + dice(F.col("config"), seed + k) * (F.log(F.lit(float(hi))) - F.log(F.lit(float(lo))))).alias(name) for k, (name, (lo, hi)) in enumerate(ranges.items())))


def fold_sums(df: DataFrame, features: Sequence[str], target: str, fold: str = "fold") -> DataFrame:
    """fold, n, m: sums of products of (1, features, target), row by row."""
    cols = ["__1", *features, target]
    d = df.withColumn("__1", F.lit(1.0))
    return d.groupBy(fold).agg(F.count("*").alias("n"), F.array(*(F.sum(F.col(a).cast("double") * F.col(b).cast("double")) for a in cols for b in cols)).alias("m"))


def nested_ridge(df: DataFrame, features: Sequence[str], target: str, configs: DataFrame, fold: str = "fold") -> DataFrame:
    """outer, config, penalty, inner_rmse, outer_rmse, optimism: the best penalty of inner folds, tried on the outer one.

    configs has config and penalty; folds and configurations, not data, meet in the one task.
    """
    sums = fold_sums(df, features, target, fold).select(F.col(fold).cast("long").alias("f"), "n", "m")
    q = len(features) + 2
    every = sums.withColumn("all", F.lit(1)).groupBy("all").agg(F.collect_list(F.struct("f", "n", "m")).alias("s")).crossJoin(configs.agg(F.collect_list(F.struct("config", "penalty")).alias("c")))

    def run(batches):
        import numpy as np
        import pandas as pd

        def fit(m, lam):
            x, b = m[:-1, :-1], m[:-1, -1]
            pen = lam * np.eye(len(x))
            pen[0, 0] = 0.0
            return np.linalg.solve(x + pen, b)

        def rmse(m, n, w):
            return float(np.sqrt(max(0.0, m[-1, -1] - 2 * w @ m[:-1, -1] + w @ m[:-1, :-1] @ w) / n))

        for pdf in batches:
            for s, c in zip(pdf.s, pdf.c, strict=True):
                by = {r["f"]: (r["n"], np.array(r["m"]).reshape(q, q)) for r in s}
                total, out = sum(m for _, m in by.values()), []
                for outer in sorted(by):
                    inner = [f for f in sorted(by) if f != outer]
                    best = min((float(np.mean([rmse(by[i][1], by[i][0], fit(total - by[outer][1] - by[i][1], r["penalty"])) for i in inner])), r["config"], r["penalty"]) for r in c)
                    got = rmse(by[outer][1], by[outer][0], fit(total - by[outer][1], best[2]))
                    out.append((outer, best[1], best[2], best[0], got, got - best[0]))
                yield pd.DataFrame(out, columns=["outer", "config", "penalty", "inner_rmse", "outer_rmse", "optimism"])

    return every.select("s", "c").mapInPandas(run, "outer long, config long, penalty double, inner_rmse double, outer_rmse double, optimism double")


class Folds:
    """Cross-validated error of ridge models from the sums of folds, for nested shares of the rows.

    A row is in a share if a hash of its key is below it, so shares are nested and one pass, by fold and the least share that
    has the row, serves them all.  The driver holds folds x shares x (variables + 2) ** 2 numbers.
    """

    def __init__(self, df: DataFrame, key: str, features: Sequence[str], target: str, fold: str = "fold", shares: Sequence[float] = (1.0,), seed: int = 42):
        self.features, self.shares = list(features), sorted(shares)
        level = F.size(F.filter(F.array(*map(F.lit, self.shares)), lambda s: s <= dice(F.col(key), seed)))
        rows = df.dropna(subset=[key, target, fold, *features]).withColumn("__level", level)
        sums = fold_sums(rows.withColumn("__both", F.struct(F.col(fold).cast("string").alias("f"), F.col("__level").alias("l"))), features, target, "__both").collect()
        q = len(self.features) + 2
        self.names = sorted({r["__both"].f for r in sums})
        n, m = np.zeros((len(self.shares) + 1, len(self.names))), np.zeros((len(self.shares) + 1, len(self.names), q, q))
        for r in sums:
            at = r["__both"].l, self.names.index(r["__both"].f)
            n[at], m[at] = r.n, np.array(r.m).reshape(q, q)
        self.n, self.m = n.cumsum(0), m.cumsum(0)

    def error(self, penalty: float, used: Sequence[bool], share: float = 1.0) -> float:
        """Root of the mean squared error over the folds left out in turn; the intercept is never shrunk or left out."""
        level = self.shares.index(share)
        keep = np.flatnonzero([True, *used, True])
        n, m = self.n[level], self.m[level][:, keep][:, :, keep]
        total, wrong = m.sum(0), 0.0
        pen = penalty * np.eye(len(keep) - 1)
        pen[0, 0] = 0.0
        for own in m:
            rest = total - own
            w = np.linalg.lstsq(rest[:-1, :-1] + pen, rest[:-1, -1], rcond=None)[0]
            wrong += max(0.0, own[-1, -1] - 2 * w @ own[:-1, -1] + w @ own[:-1, :-1] @ w)
        return math.sqrt(wrong / n.sum()) if n.sum() else math.inf


#: Genes are numbers in [0, 1): the penalty on a log scale, then whether each variable is used.
def decoded(genes: np.ndarray, low: float, high: float) -> tuple[float, list[bool]]:
    return math.exp(math.log(low) + float(genes[0]) * (math.log(high) - math.log(low))), [bool(g >= 0.5) for g in genes[1:]]


def grid_genes(budget: int, size: int, draw: np.random.Generator, tried: Callable) -> None:
    """The penalty's grid for all variables, and for each left out, as far as the budget goes."""
    steps = max(1, budget // size)
    masks = [np.full(size - 1, 0.99)] + [np.where(np.arange(size - 1) == k, 0.0, 0.99) for k in range(size - 1)]
    points = [np.concatenate(([(k + 0.5) / steps], mask)) for mask in masks for k in range(steps)]
    for x in (points + [draw.random(size) for _ in range(budget)])[:budget]:
        tried(x, 0)


def random_genes(budget: int, size: int, draw: np.random.Generator, tried: Callable) -> None:
    for _ in range(budget):
        tried(draw.random(size), 0)


def parzen_genes(budget: int, size: int, draw: np.random.Generator, tried: Callable, start: int = 10, best: float = 0.25, offers: int = 24) -> None:
    """Tree-structured Parzen search: of offers drawn around the good trials, the one most likely among them against the others."""
    seen: list[tuple[float, np.ndarray]] = []

    def density(x: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Of each gene, a uniform share and a bell of common width around each point."""
        width = max(0.05, 1 / math.sqrt(len(points) + 1) / 2)
        bells = np.exp(-0.5 * ((x[:, None] - points[None]) / width) ** 2) / (width * math.sqrt(2 * math.pi))
        return (bells.sum(1) + 1) / (len(points) + 1)

    for k in range(budget):
        if k < start:
            x = draw.random(size)
        else:
            order = sorted(range(len(seen)), key=lambda i: seen[i][0])
            cut = max(1, math.ceil(best * len(order)))
            good, rest = (np.array([seen[i][1] for i in part]) for part in (order[:cut], order[cut:]))
            around = good[draw.integers(0, len(good), (offers, size)), np.arange(size)] + draw.normal(0, max(0.05, 1 / math.sqrt(len(good) + 1) / 2), (offers, size))
            some = np.where(draw.random((offers, size)) < 1 / (len(good) + 1), draw.random((offers, size)), np.clip(around, 0, 0.999999))
            ratio = np.log(density(some, good)) - np.log(density(some, rest))
            x = some[ratio.argmax(0), np.arange(size)]  # genes are independent
        seen.append((tried(x, max(0, k - start + 1)), x))


def genetic_genes(budget: int, size: int, draw: np.random.Generator, tried: Callable, people: int = 10, cross: float = 0.7, change: float = 0.3) -> None:
    """Tournaments of three, uniform crossing, normal changes of genes; the best lives on, and each generation is tried as a whole."""
    left = budget
    now = [draw.random(size) for _ in range(min(people, budget))]
    fit = [tried(x, 0) for x in now]
    left -= len(now)
    generation = 0
    while left > 0:
        generation += 1
        win = lambda: now[min(draw.integers(0, len(now), 3), key=lambda i: fit[i])].copy()  # noqa: B023, E731
        children = []
        while len(children) < min(len(now) - 1 or 1, left):
            a, b = win(), win()
            child = np.where(draw.random(size) < 0.5, a, b) if draw.random() < cross else a
            turn = draw.random(size) < 1 / size
            children.append(np.where(turn, np.clip(child + draw.normal(0, 0.15, size), 0, 0.999999), child) if draw.random() < change else child)
        champion = int(np.argmin(fit))
        scores = [tried(x, generation) for x in children]
        left -= len(children)
        now, fit = [*children, now[champion]], [*scores, fit[champion]]


METHODS = {"grid": grid_genes, "random": random_genes, "parzen": parzen_genes, "genetic": genetic_genes}


def search(df: DataFrame, key: str, features: Sequence[str], target: str, methods: Sequence[str] = tuple(METHODS), budget: int = 60, low: float = 1e-3, high: float = 1e3, fold: str = "fold", seed: int = 42) -> DataFrame:
    """method, trial, generation, penalty, used (0s and 1s by variable), rmse, best (so far): each method tries ``budget`` configurations.

    All methods share one pass over the data; reruns with a seed agree.  Rows with a null in any column are left out.
    """
    folds, rows = Folds(df, key, features, target, fold), []
    for name in methods:
        best, trial = math.inf, 0

        def tried(genes: np.ndarray, generation: int, name: str = name) -> float:
            nonlocal best, trial
            penalty, used = decoded(genes, low, high)
            rmse = folds.error(penalty, used)
            best = min(best, rmse)
            rows.append((name, trial, generation, penalty, "".join(str(int(u)) for u in used), rmse, best))
            trial += 1
            return rmse

        METHODS[name](budget, len(features) + 1, np.random.default_rng(seed), tried)
    return df.sparkSession.createDataFrame(rows, "method string, trial int, generation int, penalty double, used string, rmse double, best double")


def halving(df: DataFrame, key: str, features: Sequence[str], target: str, n: int = 81, part: int = 3, low: float = 1e-3, high: float = 1e3, fold: str = "fold", seed: int = 42) -> DataFrame:
    """rung, share, config, penalty, used, rmse, kept: random configurations on a small nested sample, the best ``part``-th of them on one ``part`` times as large, to all rows."""
    rungs = max(1, int(round(math.log(n, part))))
    shares = [float(part) ** (k - rungs) for k in range(rungs + 1)]
    shares[-1] = 1.0
    folds, draw = Folds(df, key, features, target, fold, shares, seed), np.random.default_rng(seed)
    alive, rows = [(k, draw.random(len(features) + 1)) for k in range(n)], []
    for rung, share in enumerate(shares):
        scored = sorted((folds.error(*decoded(x, low, high), share), k) for k, x in alive)
        keep = {k for _, k in scored[: max(1, len(scored) // part)]}
        genes = dict(alive)
        for rmse, k in scored:
            penalty, used = decoded(genes[k], low, high)
            rows.append((rung, share, k, penalty, "".join(str(int(u)) for u in used), rmse, k in keep))
        alive = [(k, x) for k, x in alive if k in keep]
    return df.sparkSession.createDataFrame(rows, "rung int, share double, config int, penalty double, used string, rmse double, kept boolean")
