"""Model primitives as relational operators: bins, histograms, splits, trees, mixtures, table-driven scoring, explanation."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import bin_left, bin_right, dice, sigmoid
from tidemark.operators.order import quantiles


def standardize(df: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns minus the training mean over the population deviation (1 where that is 0)."""
    m = train.agg(*(a.alias(n) for c in columns for a, n in ((F.avg(c), f"__m_{c}"), (F.stddev_pop(c), f"__s_{c}"))))
    one = lambda c: F.when(F.col(f"__s_{c}") == 0, 1.0).otherwise(F.col(f"__s_{c}"))
    return df.crossJoin(F.broadcast(m)).withColumns({c: (F.col(c) - F.col(f"__m_{c}")) / one(c) for c in columns}).drop(*(f"__{k}_{c}" for c in columns for k in "ms"))


def one_hot(df: DataFrame, column: str, levels: Sequence[str]) -> DataFrame:
    """An indicator per level but the first in sorted order; unknown values have none."""
    return df.withColumns({f"{column}__{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in sorted(levels)[1:]}).drop(column)


def variable_of(columns: Sequence[str]) -> dict[str, str]:
    """Encoded column -> its variable."""
    return {c: c.split("__", 1)[0] for c in columns}


def class_weight(train: DataFrame, y: str) -> DataFrame:
    """One row: negatives over positives."""
    return train.agg(F.try_divide(F.count_if(F.col(y) == 0).cast("double"), F.count_if(F.col(y) == 1).cast("double")).alias("weight"))


def applicable(model: str, balancing: str) -> Column:
    """Whether a model can use a balancing: models without class weights can't be weighted."""
    return ~((F.col(balancing) == "weights") & F.col(model).isin("knn", "naive_bayes"))


def decode_search(u: Column, kind: str, low: float, high: float, levels: Sequence | None = None) -> Column:
    """A parameter value from u in [0, 1): float, log, int, int_log or cat."""
    if kind == "cat":
        return F.element_at(F.array(*map(F.lit, levels)), F.least(F.floor(u * len(levels)) + 1, F.lit(len(levels))).cast("int"))
    x = F.exp(math.log(low) + u * (math.log(high) - math.log(low))) if kind.endswith("log") else low + u * (high - low)
    return F.bround(x).cast("long") if kind.startswith("int") else x


# bins, histograms, splits, trees -----------------------------------------------------------------


def bin_cuts(df: DataFrame, columns: Sequence[str], most: int) -> DataFrame:
    """variable, cuts: midpoints of distinct values where there are at most ``most``, else inner quantiles."""
    from tidemark.operators.profile import unpivot

    long = unpivot(df, columns).filter("value IS NOT NULL")
    q = [k / most for k in range(1, most)]
    few = long.select("variable", "value").distinct()
    n = few.groupBy("variable").agg(F.count("*").alias("d"))
    few = few.join(n.filter(F.col("d") <= most), "variable").withColumn("prev", F.lag("value").over(Window.partitionBy("variable").orderBy("value")))
    mids = few.filter("prev IS NOT NULL").groupBy("variable").agg(F.array_sort(F.collect_list((F.col("value") + F.col("prev")) / 2)).alias("mid"))  # at most ``most`` values
    quant = quantiles(long, "value", q, "quant", ["variable"]).withColumn("quant", F.array_sort(F.array_distinct("quant")))
    j = n.join(quant, "variable").join(mids, "variable", "left")
    return j.select("variable", F.when(F.col("d") <= most, F.coalesce("mid", F.expr("cast(array() as array<double>)"))).otherwise(F.col("quant")).alias("cuts"))


def encode_bins(df: DataFrame, columns: Sequence[str], cuts: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Long codes: keep, variable, code = number of cuts below the value."""
    from tidemark.operators.profile import unpivot

    rows = cuts.select("variable", "cuts").collect()  # variables x bins numbers, so that the cuts aren't computed by every job on the codes
    cuts = df.sparkSession.createDataFrame([(r.variable, list(r.cuts)) for r in rows], "variable string, cuts array<double>")
    long = unpivot(df, columns, keep)
    return long.join(F.broadcast(cuts), "variable").select(*keep, "variable", bin_left("value", F.col("cuts")).alias("code"))


def bin_sums(codes: DataFrame, residual: str, by: Sequence[str] = ()) -> DataFrame:
    """Sum of residuals and rows per (node,) variable and bin."""
    return codes.groupBy(*by, "variable", "code").agg(F.sum(residual).alias("g"), F.count("*").alias("n"))


def best_split(sums: DataFrame, least: int, lam: float, by: Sequence[str] = ()) -> DataFrame:
    """Per node the variable and bin of greatest gain GL2/(NL+lam) + GR2/(NR+lam) - G2/(N+lam); ties by variable and bin."""
    w = Window.partitionBy(*by, "variable").orderBy("code").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*by, "variable")
    c = sums.withColumns({"gl": F.sum("g").over(w), "nl": F.sum("n").over(w), "gt": F.sum("g").over(all_), "nt": F.sum("n").over(all_)})
    gr, nr = F.col("gt") - F.col("gl"), F.col("nt") - F.col("nl")
    gain = F.col("gl") ** 2 / (F.col("nl") + lam) + gr**2 / (nr + lam) - F.col("gt") ** 2 / (F.col("nt") + lam)
    c = c.filter((F.col("nl") >= least) & (nr >= least)).withColumn("gain", gain).filter("gain > 1e-9")
    order = Window.partitionBy(*by).orderBy(F.round("gain", 9).desc(), "variable", "code")
    return c.withColumn("__k", F.row_number().over(order)).filter("__k = 1").select(*by, "variable", "code", "gain", "nl", nr.alias("nr"), "gl", gr.alias("gr"))


def _code_map(codes: DataFrame, key: str, *keep: str) -> DataFrame:
    """A row per key with its codes as a map by variable, as many entries as there are variables."""
    return codes.groupBy(key).agg(*(F.first(c).alias(c) for c in keep), F.map_from_entries(F.collect_list(F.struct("variable", "code"))).alias("__codes"))


def _node(splits: dict[int, tuple[str, int]], k: int = 0) -> Column:
    """The place that a row reaches, as nested conditions on its codes."""
    if k not in splits:
        return F.lit(k)
    variable, cut = splits[k]
    return F.when(F.element_at("__codes", variable) <= cut, _node(splits, 2 * k + 1)).otherwise(_node(splits, 2 * k + 2))


def grow_tree(codes: DataFrame, key: str, residual: str, depth: int, least: int, lam: float) -> DataFrame:
    """node, variable, code, value, n of a least-squares tree grown by levels; children of k are 2k + 1 and 2k + 2.

    codes has key, variable, code and residual.  Each level is one aggregation to (node, variable, bin) sums; a level's
    splits, a row per node, come back and become conditions, so rows never move.
    """
    rows, splits = _code_map(codes, key, residual), {}
    for level in range(depth):
        sums = bin_sums(rows.select(_node(splits).alias("node"), residual, F.explode("__codes").alias("variable", "code")).filter(F.col("node") >= 2**level - 1), residual, ["node"])
        best = best_split(sums, least, lam, ["node"]).select("node", "variable", "code").collect()
        if not best:
            break
        splits |= {b.node: (b.variable, b.code) for b in best}
    leaves = rows.groupBy(_node(splits).alias("node")).agg((F.sum(residual) / (F.count("*") + lam)).alias("value"), F.count("*").alias("n"))
    inner = codes.sparkSession.createDataFrame([(k, v, c) for k, (v, c) in splits.items()], "node int, variable string, code int")
    return inner.unionByName(leaves, allowMissingColumns=True)


def predict_tree(codes: DataFrame, key: str, tree: DataFrame) -> DataFrame:
    """key, value: the tree, a small table, as conditions on each row's codes."""
    nodes = tree.collect()
    splits = {r.node: (r.variable, r.code) for r in nodes if r.variable is not None}
    values = F.create_map(*(F.lit(x) for r in nodes if r.variable is None for x in (r.node, float(r.value))))
    return _code_map(codes, key).select(key, F.element_at(values, _node(splits)).alias("value"))


def evaluate_forest(df: DataFrame, key: str, features: Sequence[str], trees: list[dict], intercept: float = 0.0, rate: float = 1.0) -> DataFrame:
    """key, score: intercept + rate * sum of trees, each a dict of lists variable (-1: leaf), cut, value, by heap place.

    Trees become nested conditions and so run inside the engine.
    """

    def node(t: dict, k: int) -> Column:
        v = t["variable"][k]
        if v < 0:
            return F.lit(float(t["value"][k]))
        return F.when(F.col(features[v]) <= t["cut"][k], node(t, 2 * k + 1)).otherwise(node(t, 2 * k + 2))

    total = F.lit(float(intercept))
    for t in trees:
        total = total + rate * node(t, 0)
    return df.select(key, total.alias("score"))


# mixtures ----------------------------------------------------------------------------------------


def mixture_e_step(df: DataFrame, r: str, params: DataFrame) -> DataFrame:
    """Rows with gamma per component and log density; params is one row pi, c (arrays), sigma."""
    d = df.crossJoin(F.broadcast(params.select(F.col("pi").alias("__pi"), F.col("c").alias("__c"), F.col("sigma").alias("__s"))))
    z = lambda c: (F.col(r) - c) / F.col("__s")
    logs = F.zip_with("__c", "__pi", lambda c, p: F.lit(-0.5) * z(c) * z(c) + F.ln(F.greatest(p, F.lit(1e-300))))
    d = d.withColumn("__l", logs).withColumn("__m", F.array_max("__l")).withColumn("__e", F.transform("__l", lambda x: F.exp(x - F.col("__m"))))
    total = F.aggregate("__e", F.lit(0.0), lambda a, x: a + x)
    return d.withColumns({"gamma": F.transform("__e", lambda x: x / total), "log_density": F.col("__m") + F.ln(total) - F.ln("__s") - 0.5 * math.log(2 * math.pi)}).drop("__l", "__m", "__e", "__pi", "__c", "__s")


def mixture_m_step(rows: DataFrame, r: str, k: int, sigma_min: float, weight: str | None = None) -> DataFrame:
    """One row pi, c, sigma from three sums per component."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    g = lambda j: w * F.get("gamma", F.lit(j))
    s = rows.agg(*(F.sum(e).alias(f"{n}{j}") for j in range(k) for n, e in (("m", g(j)), ("s", g(j) * F.col(r)), ("q", g(j) * F.col(r) * F.col(r)))))
    total = sum((F.col(f"m{j}") for j in range(k)), F.lit(0.0))
    c = [F.try_divide(F.col(f"s{j}"), F.col(f"m{j}")) for j in range(k)]
    var = sum((F.col(f"q{j}") - 2 * c[j] * F.col(f"s{j}") + c[j] * c[j] * F.col(f"m{j}") for j in range(k)), F.lit(0.0)) / total
    return s.select(F.array(*(F.col(f"m{j}") / total for j in range(k))).alias("pi"), F.array(*c).alias("c"), F.greatest(F.sqrt(F.greatest(var, F.lit(0.0))), F.lit(sigma_min)).alias("sigma"))


# table-driven scoring and explanation ------------------------------------------------------------


def score_terms(df: DataFrame, key: str, terms: DataFrame, intercept: float, logit: bool = True) -> DataFrame:
    """key, raw, prediction of an additive model kept as a table.

    terms: term, variable, kind (numeric, category), mean, scale, category, cuts, scores; slot 0 of scores is for missing,
    the last for unknown values.
    df is long: key, variable, number, text.
    """
    j = df.join(F.broadcast(terms), "variable")
    z = F.when(F.col("kind") == "numeric", (F.col("number") - F.col("mean")) / F.col("scale")).otherwise(F.coalesce((F.col("text") == F.col("category")).cast("double"), F.lit(0.0)))
    j = j.withColumn("__z", z).withColumn("contribution", F.get("scores", F.when(F.col("__z").isNull() | F.isnan("__z"), 0).otherwise(bin_right("__z", F.col("cuts")) + 1)))
    g = j.groupBy(key).agg((F.sum("contribution") + intercept).alias("raw"))
    return g.withColumn("prediction", sigmoid("raw") if logit else F.col("raw"))


def term_importance(contributions: DataFrame, weight: str = "contribution") -> DataFrame:
    """variable, share of mean absolute contribution."""
    g = contributions.groupBy("variable").agg(F.avg(F.abs(weight)).alias("__i"))
    return g.select("variable", F.try_divide("__i", F.sum("__i").over(Window.partitionBy())).alias("share"))


def term_shape(terms: DataFrame, low: str = "low", high: str = "high") -> DataFrame:
    """term, step, from, to, effect of numeric terms in the variable's own units."""
    edges = F.concat(F.array(low), "cuts", F.array(high))
    t = terms.filter("kind = 'numeric'").withColumn("__e", F.transform(edges, lambda x: x * F.col("scale") + F.col("mean")))
    return t.select("term", "__e", F.posexplode(F.slice("scores", F.lit(2), F.size("scores") - 2)).alias("step", "effect")).select("term", "step", F.get("__e", F.col("step")).alias("from"), F.get("__e", F.col("step") + 1).alias("to"), "effect")


def linear_score(df: DataFrame, coefficients: dict[str, float], intercept: float) -> Column:
    """Intercept plus dot product."""
    total = F.lit(float(intercept))
    for c, b in coefficients.items():
        total = total + F.col(c) * F.lit(float(b))
    return total


def linear_explanation(df: DataFrame, key: str, coefficients: dict[str, float]) -> DataFrame:
    """key, variable, contribution: coefficient times distance from the column's mean."""
    m = df.agg(*(F.avg(c).alias(f"__m_{c}") for c in coefficients))
    rows = F.array(*(F.struct(F.lit(c).alias("variable"), (F.lit(float(b)) * (F.col(c) - F.col(f"__m_{c}"))).alias("contribution")) for c, b in coefficients.items()))
    return df.crossJoin(F.broadcast(m)).select(key, F.inline(rows))


def shapley(value_of, players: Sequence[str]) -> dict[str, Column]:
    """Exact Shapley columns of a set function of columns, for a handful of players."""
    n, out = len(players), {}
    for p in players:
        rest = [q for q in players if q != p]
        total = F.lit(0.0)
        for size in range(n):
            weight = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
            for s in combinations(rest, size):
                total = total + weight * (value_of({*s, p}) - value_of(set(s)))
        out[p] = total
    return out


def leaf_paths(tree: dict) -> list[tuple[float, dict[int, tuple[float, float, float]]]]:
    """Of each leaf, its value and, for each variable on the way to it, the share of rows that cover sends on and the bounds (above, upto)."""
    out, open_ = [], [(0, {})]
    while open_:
        k, path = open_.pop()
        v = tree["variable"][k]
        if v < 0:
            out.append((float(tree["value"][k]), path))
            continue
        share, above, upto = path.get(v, (1.0, -math.inf, math.inf))
        for side, low, high in ((2 * k + 1, above, min(upto, tree["cut"][k])), (2 * k + 2, max(above, tree["cut"][k]), upto)):
            part = tree["cover"][side] / tree["cover"][k] if tree["cover"][k] else 0.0
            open_.append((side, {**path, v: (share * part, low, high)}))
    return out


def path_contributions(x: np.ndarray, tree: dict) -> np.ndarray:
    """Shapley values of the tree for rows of x, as many columns as x; a missing value goes right at every split.

    A leaf's worth to a set of known variables is its value times, for each variable on its path, 1 or 0 by the row if the variable is
    known and its share of cover if not.  So the sum over sets of each size is a coefficient of the product of
    (share + row's side * t) over the path: the product is extended variable by variable, and each variable is divided out in turn.
    A leaf costs its path's length squared.
    """
    phi = np.zeros(x.shape)
    for value, path in leaf_paths(tree):
        m = len(path)
        if not m or value == 0.0:
            continue
        inside = np.stack([np.where(np.isnan(x[:, v]), high == math.inf, (x[:, v] > low) & (x[:, v] <= high)) for v, (_, low, high) in path.items()], 1).astype(float)
        shares = [share for share, _, _ in path.values()]
        p = np.zeros((len(x), m + 1))
        p[:, 0] = 1.0
        for j, z in enumerate(shares):
            p[:, 1 : j + 2] = p[:, 1 : j + 2] * z + p[:, : j + 1] * inside[:, j, None]
            p[:, 0] *= z
        weight = [math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) for k in range(m)]
        for j, (v, z) in enumerate(zip(path, shares, strict=True)):
            on = inside[:, j] > 0
            total, q = np.zeros(len(x)), p[:, m].copy()
            for k in range(m - 1, -1, -1):  # of the product without j, from the highest power
                off = p[:, k] / z if z > 0 else np.zeros(len(x))
                total += weight[k] * np.where(on, q, off)
                q = p[:, k] - z * q
            phi[:, v] += value * (inside[:, j] - z) * total
    return phi


def tree_explanation(df: DataFrame, key: str, features: Sequence[str], trees: list[dict], rate: float = 1.0) -> DataFrame:
    """key, variable, contribution: exact Shapley values of a forest, trees as in evaluate_forest with ``cover``, the training rows by place.

    A split on a variable outside the set is the mean of its sides by cover.  Batches of rows meet the trees in numpy; a tree costs
    its leaves times the square of its depth, however many variables there are.
    """
    names = list(features)
    rows = df.select(F.col(key).alias("__key"), *(F.col(f).cast("double").alias(f"__x{i}") for i, f in enumerate(names)))

    def run(batches):
        for b in batches:
            x = np.stack([np.asarray(b.column(i + 1).to_numpy(zero_copy_only=False), float) for i in range(len(names))], 1)
            phi = np.zeros(x.shape)
            for t in trees:
                phi += rate * path_contributions(x, t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(phi), pa.list_(pa.float64()))], ["__key", "__phi"])

    kind = rows.schema["__key"].dataType.simpleString()
    out = rows.mapInArrow(run, f"__key {kind}, __phi array<double>")
    return out.select(F.col("__key").alias(key), F.inline(F.array(*(F.struct(F.lit(f).alias("variable"), F.get("__phi", F.lit(i)).alias("contribution")) for i, f in enumerate(names)))))


def permutation_explanation(df: DataFrame, key: str, columns: Sequence[str], score, background: DataFrame, order: Column, most: int = 50, turns: int = 8, seed: int = 42) -> DataFrame:
    """key, variable, contribution: Shapley values of any score by sampled orders of the columns, each with its reverse.

    ``score`` maps a dict of columns to a column.  The background is the ``most`` rows of least ``order``, one array that
    every row meets; a column's contribution is the mean change of the score when it turns from a background row's value
    to the row's own.  With two columns one order and its reverse are exact.
    """
    draw = random.Random(seed)
    orders = [p for _ in range(turns) for o in [draw.sample(list(columns), len(columns))] for p in (o, o[::-1])]
    some = background.orderBy(order).limit(most).agg(F.collect_list(F.struct(*columns)).alias("__b"))

    def changes(x: Column) -> Column:
        total = dict.fromkeys(columns, F.lit(0.0))
        for o in orders:
            at = {c: x[c] for c in columns}
            for c in o:
                now = {**at, c: F.col(c)}
                total[c], at = total[c] + score(now) - score(at), now
        return F.array(*(total[c] / float(len(orders)) for c in columns))

    d = df.crossJoin(F.broadcast(some)).withColumn("__c", F.transform("__b", changes))
    mean = lambda k: F.aggregate("__c", F.lit(0.0), lambda a, x: a + F.get(x, F.lit(k))) / F.size("__c")
    rows = F.array(*(F.struct(F.lit(c).alias("variable"), mean(k).alias("contribution")) for k, c in enumerate(columns)))
    return d.select(key, F.inline(rows))


def what_if(df: DataFrame, changes: dict[str, object], products: Sequence[str], cap: float = 600.0) -> DataFrame:
    """Apply changes, then recompute the columns tied to others: shares of products held, capped activity, rounded score."""
    out = df.withColumns({c: F.lit(v) for c, v in changes.items()})
    held = sum((F.coalesce(F.col(p).cast("int"), F.lit(0)) for p in products), F.lit(0)) / float(len(products))
    out = out.withColumn("product_satisfaction", held).withColumn("tx_satisfaction", F.least(F.col("tx_count") / F.lit(cap), F.lit(1.0)))
    return out.withColumn("satisfaction_score", F.bround(0.5 * F.col("base_satisfaction") + 0.25 * F.col("tx_satisfaction") + 0.25 * F.col("product_satisfaction")).cast("long"))


def permutation_importance(df: DataFrame, key: str, column: str, score, loss, seed: int = 42) -> DataFrame:
    """One row: loss with the column's values dealt to other rows, minus the loss as is.

    ``score`` maps a table to one with ``prediction``; ``loss`` is an aggregate.  Values move by a join of two
    numberings, by key and by hash, made of running places per hash range.
    """
    a = df.withColumn("__b", F.floor(dice(F.col(key), seed) * 64).cast("int"))
    w1, w2 = Window.partitionBy("__b").orderBy(key), Window.partitionBy("__b").orderBy(dice(F.col(key), seed + 1), key)
    a = a.withColumns({"__i": F.row_number().over(w1), "__j": F.row_number().over(w2)})
    moved = a.drop(column).join(a.select("__b", F.col("__j").alias("__i"), F.col(column)), ["__b", "__i"])
    return score(df).agg(loss.alias("base")).crossJoin(score(moved).agg(loss.alias("shuffled"))).select("base", "shuffled", (F.col("shuffled") - F.col("base")).alias("importance"))


def add_noise(df: DataFrame, column: str, key: str, sd: float, seed: int = 42) -> DataFrame:
    """Column plus a normal number that only key and seed decide (Box-Muller)."""
    u, v = F.greatest(dice(F.col(key), seed), F.lit(1e-12)), dice(F.col(key), seed + 1)
    return df.withColumn(column, F.col(column) + sd * F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * v))


def add_outliers(df: DataFrame, column: str, key: str, share: float, factor: float, seed: int = 42) -> DataFrame:
    """Column times factor in about share of the rows, which only key and seed choose."""
    return df.withColumn(column, F.when(dice(F.col(key), seed) < share, F.col(column) * F.lit(float(factor))).otherwise(F.col(column)))


def sensitivity(df: DataFrame, columns: Sequence[str], score) -> DataFrame:
    """variable, low, high: mean score with one column a standard deviation down or up in every row, minus the mean as it is.

    ``score`` maps a dict of columns to a column.
    """
    sd = df.agg(*(F.stddev_samp(c).alias(f"__s_{c}") for c in columns))
    at = {c: F.col(c) for c in columns}
    moved = lambda c, k: score({**at, c: F.col(c) + k * F.col(f"__s_{c}")})
    wide = df.crossJoin(F.broadcast(sd)).agg(F.avg(score(at)).alias("__base"), *(F.avg(moved(c, k)).alias(f"__{n}_{c}") for c in columns for n, k in (("low", -1), ("high", 1))))
    return wide.select(F.inline(F.array(*(F.struct(F.lit(c).alias("variable"), (F.col(f"__low_{c}") - F.col("__base")).alias("low"), (F.col(f"__high_{c}") - F.col("__base")).alias("high")) for c in columns))))


def bayes_explanation(df: DataFrame, key: str, y: str, columns: Sequence[str]) -> DataFrame:
    """key, variable, contribution of a Gaussian naive Bayes classifier: log density ratio of the classes, from its mean over the rows."""
    side = lambda k, c: F.when(F.col(y) == k, F.col(c))
    p = df.agg(*(a.alias(f"__{n}{k}_{c}") for c in columns for k in (0, 1) for n, a in (("m", F.avg(side(k, c))), ("v", F.var_pop(side(k, c))))))
    log = lambda k, c: -0.5 * (F.ln(F.col(f"__v{k}_{c}")) + (F.col(c) - F.col(f"__m{k}_{c}")) ** 2 / F.col(f"__v{k}_{c}"))
    rows = df.crossJoin(F.broadcast(p)).select(key, *((log(1, c) - log(0, c)).alias(c) for c in columns))
    return linear_explanation(rows, key, dict.fromkeys(columns, 1.0))


def term_density(df: DataFrame, variable: str, cuts: Sequence[float]) -> DataFrame:
    """step, n, share of rows between a numeric term's cuts."""
    g = df.filter(F.col(variable).isNotNull()).groupBy(bin_right(variable, F.array(*map(F.lit, cuts))).alias("step")).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def category_effect(contributions: DataFrame, category: str) -> DataFrame:
    """category, n, mean contribution."""
    return contributions.groupBy(category).agg(F.count("*").alias("n"), F.avg("contribution").alias("effect"))


def learning_curve(df: DataFrame, key: str, fractions: Sequence[float], aggs: Sequence[Column], seed: int = 42) -> DataFrame:
    """fraction, aggregates over nested hash samples: one pass, a row joins every sample that holds it."""
    hit = F.filter(F.array(*(F.when(dice(F.col(key), seed) < f, F.lit(float(f))) for f in fractions)), lambda x: x.isNotNull())
    return df.withColumn("fraction", F.explode(hit)).groupBy("fraction").agg(*aggs)


def leave_group_out(df: DataFrame, group: str, sums: dict[str, str]) -> DataFrame:
    """group, mean of each column over all other groups, from group sums."""
    g = df.groupBy(group).agg(F.count("*").alias("__n"), *(F.sum(c).alias(n) for n, c in sums.items()))
    w = Window.partitionBy()
    return g.select(group, *(F.try_divide(F.sum(n).over(w) - F.col(n), (F.sum("__n").over(w) - F.col("__n")).cast("double")).alias(n) for n in sums))
