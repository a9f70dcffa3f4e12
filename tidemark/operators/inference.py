"""Statistical comparison: aggregates in Spark, then one scalar step per row of a tiny result.

The scalar step is a Python UDF over closed-form distribution functions; it sees a row per test, never data.
Replicates (bootstrap, permutation) are drawn inside tasks, which give one vector of sums per replicate (replicates.py);
what needs one order of all rows runs on its parts (series.py).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.functions import dist
from tidemark.functions.columns import CLIFF, COHEN, magnitude, ratio
from tidemark.operators.metrics import auc, score_table
from tidemark.operators.order import group_rank, lag_autocovariance, running_totals, top_fraction, value_ranks
from tidemark.operators.replicates import bootstrap_auc, paired_bootstrap_auc, replicate_sums  # noqa: F401
from tidemark.operators.series import stationary_means


def _scalar(f, *cols: Column) -> Column:
    """A distribution function on the single row of a result; null in, null out."""
    return F.udf(lambda *a: None if any(x is None for x in a) else float(f(*a)), DoubleType())(*cols)


def norm_two_sided(z: Column) -> Column:
    return _scalar(lambda x, sf=dist.norm_sf: 2 * sf(abs(x)), z)


def norm_upper(z: Column) -> Column:
    return _scalar(dist.norm_sf, z)


def t_two_sided(t: Column, df: Column) -> Column:
    return _scalar(lambda x, d, sf=dist.t_sf: 2 * sf(abs(x), d), t, df)


def t_upper(t: Column, df: Column) -> Column:
    return _scalar(dist.t_sf, t, df)


def chi2_upper(x: Column, df: Column) -> Column:
    return _scalar(dist.chi2_sf, x, df)


def f_upper(x: Column, a: Column, b: Column) -> Column:
    return _scalar(dist.f_sf, x, a, b)


def binomial_two_sided(k: Column, n: Column) -> Column:
    return _scalar(lambda i, m, p=dist.binom_two_sided: p(int(i), int(m)), k, n)


# T1, T2: DeLong ----------------------------------------------------------------------------------


def placements(df: DataFrame, y: str, s: str, out: str = "v") -> DataFrame:
    """Add each row's placement: share of the other class that it is rightly ordered to, ties counting half."""
    t = running_totals(score_table(df, y, s), "score", {"pb": "pos", "nb": "neg"})
    n = t.agg(F.sum("pos").alias("m"), F.sum("neg").alias("n"))
    t = t.crossJoin(F.broadcast(n)).select("score", ((F.col("nb") - F.col("neg") / 2.0) / F.col("n")).alias("vp"), (F.lit(1.0) - (F.col("pb") - F.col("pos") / 2.0) / F.col("m")).alias("vn"))
    rows = df.filter(F.col(y).isNotNull() & F.col(s).isNotNull()).withColumn("score", F.col(s).cast("double"))
    return rows.join(t, "score").withColumn(out, F.when(F.col(y) == 1, F.col("vp")).otherwise(F.col("vn"))).drop("score", "vp", "vn")


def delong(df: DataFrame, y: str, a: str, b: str | None = None, level: float = 0.95) -> DataFrame:
    """One row: AUC of a with its error and interval, or both AUCs, their difference b - a, error, z, p values, interval, correlation."""
    z = dist.norm_ppf(0.5 + level / 2)
    p = placements(df, y, a, "va")
    pos, neg = F.col(y) == 1, F.col(y) == 0
    if b is None:
        g = p.agg(F.avg(F.when(pos, F.col("va"))).alias("auc"), F.var_samp(F.when(pos, F.col("va"))).alias("vp"), F.var_samp(F.when(neg, F.col("va"))).alias("vn"), F.count_if(pos).alias("n_pos"), F.count_if(neg).alias("n_neg"))
        se = F.sqrt(F.col("vp") / F.col("n_pos") + F.col("vn") / F.col("n_neg"))
        return g.select("auc", se.alias("se"), F.greatest(F.lit(0.0), F.col("auc") - z * se).alias("low"), F.least(F.lit(1.0), F.col("auc") + z * se).alias("high"), "n_pos", "n_neg")
    p = placements(p, y, b, "vb")
    va, vb = F.col("va"), F.col("vb")
    on = lambda c, x: F.when(c, x)
    g = p.agg(
        F.avg(on(pos, va)).alias("auc_a"), F.avg(on(pos, vb)).alias("auc_b"), F.count_if(pos).alias("n_pos"), F.count_if(neg).alias("n_neg"),
        *(f(on(c, x), on(c, w)).alias(f"{n}_{k}") for k, c in (("p", pos), ("n", neg)) for n, f, x, w in (("aa", F.covar_samp, va, va), ("bb", F.covar_samp, vb, vb), ("ab", F.covar_samp, va, vb))),
    )
    s = {k: F.col(f"{k}_p") / F.col("n_pos") + F.col(f"{k}_n") / F.col("n_neg") for k in ("aa", "bb", "ab")}
    g = g.withColumns({"diff": F.col("auc_b") - F.col("auc_a"), "se": F.sqrt(F.greatest(s["aa"] + s["bb"] - 2 * s["ab"], F.lit(0.0))), "correlation": F.coalesce(F.try_divide(s["ab"], F.sqrt(s["aa"] * s["bb"])), F.lit(1.0))})
    g = g.withColumn("z", F.coalesce(F.try_divide("diff", "se"), F.lit(0.0)))
    return g.select("auc_a", "auc_b", "diff", "se", "z", norm_two_sided(F.col("z")).alias("p_two_sided"), norm_upper(F.col("z")).alias("p_upper"), (F.col("diff") - z * F.col("se")).alias("low"), (F.col("diff") + z * F.col("se")).alias("high"), "correlation", "n_pos", "n_neg")


def jackknife_auc(df: DataFrame, y: str, s: str, out: str = "auc_without") -> DataFrame:
    """Add the AUC without each row, in closed form."""
    p = placements(df, y, s, "__v")
    g = p.agg(F.avg(F.when(F.col(y) == 1, F.col("__v"))).alias("__a"), F.count_if(F.col(y) == 1).alias("__m"), F.count_if(F.col(y) == 0).alias("__n"))
    k = F.when(F.col(y) == 1, F.col("__m")).otherwise(F.col("__n"))
    return p.crossJoin(F.broadcast(g)).withColumn(out, F.try_divide(k * F.col("__a") - F.col("__v"), k - 1)).drop("__v", "__a", "__m", "__n")


#: Replicates of the reference: bootstraps, sign flips, confidence sets.
N_BOOT, N_PERM, N_MCS = 2000, 10000, 1000

# T3 to T5, T9: replicates ------------------------------------------------------------------------


def bootstrap_regression(df: DataFrame, key: str, y: str, a: str, b: str, n: int = 200, seed: int = 42) -> DataFrame:
    """rep, and differences b - a of RMSE, MAE and R2 under Poisson weights."""
    ea, eb = F.col(a) - F.col(y), F.col(b) - F.col(y)
    values = {"n": F.lit(1.0), "qa": ea**2, "qb": eb**2, "ma": F.abs(ea), "mb": F.abs(eb), "sy": F.col(y), "qy": F.col(y) ** 2}
    g = replicate_sums(df, key, values, n, seed).filter("n > 0")
    return _differences(g, "n", "qa", "qb", F.col("mb") - F.col("ma"), "sy", "qy").select("rep", "rmse", "mae", "r2")


def regression_differences(df: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """One row: rmse, mae, r2 of b minus those of a, and the sums that they come from."""
    ea, eb = F.col(a) - F.col(y), F.col(b) - F.col(y)
    g = df.agg(F.count(ea + eb).alias("n"), F.sum(ea**2).alias("qa"), F.sum(eb**2).alias("qb"), F.sum(F.abs(ea)).alias("ma"), F.sum(F.abs(eb)).alias("mb"), F.sum(y).alias("sy"), F.sum(F.col(y) ** 2).alias("qy"))
    return _differences(g, "n", "qa", "qb", F.col("mb") - F.col("ma"), "sy", "qy")


def _differences(g: DataFrame, n, qa, qb, m, sy, qy) -> DataFrame:
    n, qa, qb, sy, qy = (F.col(c) if isinstance(c, str) else c for c in (n, qa, qb, sy, qy))
    root = lambda q: F.sqrt(F.greatest(q, F.lit(0.0)) / n)
    return g.withColumns({"rmse": root(qb) - root(qa), "mae": m / n, "r2": F.try_divide(qa - qb, qy - sy * sy / n)})


def jackknife_regression(df: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """df with rmse, mae and r2: the differences b - a without each row, in closed form from the sums."""
    ea, eb = F.col(a) - F.col(y), F.col(b) - F.col(y)
    sums = ("n", "qa", "qb", "ma", "mb", "sy", "qy")
    g = regression_differences(df, y, a, b).select(*(F.col(c).alias(f"__{c}") for c in sums))
    s = {c: F.col(f"__{c}") for c in sums}
    d = df.filter((ea + eb).isNotNull()).crossJoin(F.broadcast(g))
    out = _differences(d, s["n"] - 1, s["qa"] - ea**2, s["qb"] - eb**2, s["mb"] - s["ma"] - F.abs(eb) + F.abs(ea), s["sy"] - F.col(y), s["qy"] - F.col(y) ** 2)
    return out.drop(*(f"__{c}" for c in sums))


def _bca_shape(replicates: DataFrame, value: str, estimate: DataFrame, jackknife: DataFrame | None, null: float = 0.0) -> DataFrame:
    """One row: replicates n, those below the estimate b and below the null z (ties half), acceleration a."""
    e = replicates.crossJoin(F.broadcast(estimate.select(F.col("estimate").alias("__e"))))
    under = lambda x: F.sum(F.when(F.col(value) < x, 1.0).when(F.col(value) == x, 0.5).otherwise(0.0))
    below = e.agg(under(F.col("__e")).alias("b"), under(F.lit(null)).alias("z"), F.count(value).alias("n"))
    if jackknife is None:
        return below.withColumn("a", F.lit(0.0))
    m = jackknife.agg(F.avg("estimate").alias("__m"))
    u = F.col("__m") - F.col("estimate")
    return below.crossJoin(jackknife.crossJoin(F.broadcast(m)).agg(F.coalesce(F.try_divide(F.sum(u * u * u), 6 * F.pow(F.sum(u * u), 1.5)), F.lit(0.0)).alias("a")))


def bca_p(replicates: DataFrame, value: str, estimate: DataFrame, jackknife: DataFrame | None = None, null: float = 0.0) -> DataFrame:
    """One row (p): twice the tail at which an end of the bca interval meets the null value, the formula of its ends solved for the level."""

    def f(b: float, z: float, n: int, a: float, ppf=dist.norm_ppf, cdf=dist.norm_cdf) -> float:
        inside = lambda k: min(max(k / n, 1 / (2 * n)), 1 - 1 / (2 * n))
        z0 = ppf(inside(b))
        w = ppf(inside(z)) - z0
        tail = cdf(w / (1 + a * w) - z0)
        return min(1.0, 2 * min(tail, 1 - tail))

    return _bca_shape(replicates, value, estimate, jackknife, null).select(_scalar(f, F.col("b"), F.col("z"), F.col("n"), F.col("a")).alias("p"))


def bca(replicates: DataFrame, value: str, estimate: DataFrame, jackknife: DataFrame | None = None, level: float = 0.95) -> DataFrame:
    """One row (low, high): bias-corrected and accelerated interval.

    ``estimate`` is one row, column ``estimate``; ``jackknife`` has a column ``estimate`` per left-out row (none: no acceleration).
    """
    below = _bca_shape(replicates, value, estimate, jackknife)
    tail = (1 - level) / 2

    def point(z: float):
        def f(b: float, n: int, a: float, ppf=dist.norm_ppf, cdf=dist.norm_cdf) -> float:
            z0 = ppf(min(max(b / n, 1 / (2 * n)), 1 - 1 / (2 * n)))
            return cdf(z0 + (z0 + z) / (1 - a * (z0 + z)))

        return _scalar(f, F.col("b"), F.col("n"), F.col("a"))

    q = below.select(point(dist.norm_ppf(tail)).alias("q_low"), point(dist.norm_ppf(1 - tail)).alias("q_high"))
    ordered = replicates.filter(F.col(value).isNotNull()).agg(F.array_sort(F.collect_list(value)).alias("v"))  # a value per replicate

    def at(c: str) -> Column:
        h = F.col(c) * (F.size("v") - 1)
        lo = F.get("v", F.floor(h).cast("int"))
        return lo + (h - F.floor(h)) * (F.coalesce(F.get("v", F.floor(h).cast("int") + 1), lo) - lo)

    return ordered.crossJoin(q).select(at("q_low").alias("low"), at("q_high").alias("high"))


def bca_regression(df: DataFrame, key: str, y: str, a: str, b: str, n: int = N_BOOT, level: float = 0.95, seed: int = 42) -> DataFrame:
    """metric, estimate, low, high, p of the differences b - a of RMSE, MAE and R2, on one set of replicates."""
    from tidemark.operators.boosting import checkpointed

    replicates = checkpointed(bootstrap_regression(df, key, y, a, b, n, seed))  # a row per replicate
    seen, left_out, out = regression_differences(df, y, a, b), jackknife_regression(df, y, a, b), None
    for m in ("rmse", "mae", "r2"):
        e, j = seen.select(F.col(m).alias("estimate")), left_out.select(F.col(m).alias("estimate"))
        one = e.crossJoin(bca(replicates, m, e, j, level)).crossJoin(bca_p(replicates, m, e, j)).select(F.lit(m).alias("metric"), "estimate", "low", "high", "p")
        out = one if out is None else out.unionByName(one)
    return out


def permutation_test(df: DataFrame, key: str, a: str, b: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """One row: mean of a - b, p of sign flips, n."""
    d = df.select(key, (F.col(a) - F.col(b)).alias("d")).filter("d IS NOT NULL")
    seen = d.agg(F.avg("d").alias("diff"), F.sum("d").alias("s"), F.count("*").alias("rows"))
    r = replicate_sums(d, key, {"up": F.col("d")}, n, seed, "coins").crossJoin(F.broadcast(seen))
    m = (2 * F.col("up") - F.col("s")) / F.col("rows")  # those with a 1 keep their sign
    g = r.groupBy("diff").agg(F.count_if(F.abs(m) >= F.abs("diff") - 1e-15).alias("k"))
    return g.select("diff", ((F.col("k") + 1) / F.lit(float(n + 1))).alias("p"), F.lit(n).alias("n_perm"))


# paired tests ------------------------------------------------------------------------------------


def wilcoxon(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: statistic, p (exact up to 50 untied differences, else normal with tie correction), n, wins of a."""
    d = df.select((F.col(a) - F.col(b)).alias("d")).filter("d IS NOT NULL")
    nz = d.filter("d <> 0").withColumn("m", F.abs("d"))
    counts = nz.groupBy("m").agg(F.count("*").alias("c"), F.count_if(F.col("d") > 0).alias("up"))
    t = running_totals(counts, "m", {"upto": "c"}).withColumn("r", F.col("upto") - (F.col("c") - 1) / 2.0)
    g = t.agg(F.sum(F.col("r") * F.col("up")).alias("plus"), F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("ties"))
    wins = d.agg(F.count("*").alias("n_pairs"), F.count_if(F.col("d") > 0).alias("wins"))

    def p(w: float, n: float, ties: float, exact=dist.signed_rank_two_sided, sf=dist.norm_sf) -> float:
        n = int(n)
        if ties == 0 and n <= 50:
            return exact(w, n)
        mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - ties / 48
        return 2 * sf(abs(w - mean) / math.sqrt(var)) if var > 0 else 1.0

    g = wins.crossJoin(g)
    all_ = F.col("n") * (F.col("n") + 1) / 2.0
    return g.select(F.coalesce(F.least("plus", all_ - F.col("plus")), F.lit(0.0)).alias("statistic"), F.coalesce(_scalar(p, F.col("plus"), F.col("n").cast("double"), F.col("ties").cast("double")), F.lit(1.0)).alias("p"), F.col("n_pairs").alias("n"), "wins")


def corrected_t(df: DataFrame, a: str, b: str, test_train: float = 0.25, by: Sequence[str] = ()) -> DataFrame:
    """Resampled t with the variance corrected by test / train size: t, df, p, mean, sd of a - b."""
    g = df.withColumn("__d", F.col(a) - F.col(b)).groupBy(*by).agg(F.avg("__d").alias("mean"), F.stddev_samp("__d").alias("sd"), F.count("__d").alias("n"))
    t = F.try_divide("mean", F.sqrt((1 / F.col("n") + F.lit(test_train)) * F.col("sd") * F.col("sd")))
    return g.withColumn("t", t).select(*by, "t", (F.col("n") - 1).alias("df"), t_two_sided(F.col("t"), (F.col("n") - 1).cast("double")).alias("p"), "mean", "sd")


def bayes_correlated_t(df: DataFrame, a: str, b: str, rope: float, test_train: float = 0.25) -> DataFrame:
    """One row: posterior shares of a - b below, within and above [-rope, rope]."""
    rho = test_train / (1 + test_train)
    g = df.select((F.col(a) - F.col(b)).alias("d")).agg(F.avg("d").alias("mean"), F.var_samp("d").alias("v"), F.count("d").alias("n"))
    scale = F.sqrt((1 / F.col("n") + F.lit(rho / (1 - rho))) * F.col("v"))
    cdf = lambda x: _scalar(dist.t_cdf, F.try_divide(F.lit(x) - F.col("mean"), scale), (F.col("n") - 1).cast("double"))
    return g.withColumns({"below": cdf(-rope), "upto": cdf(rope)}).select("mean", "below", (F.col("upto") - F.col("below")).alias("within"), (F.lit(1.0) - F.col("upto")).alias("above"))


def mcnemar(df: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """One row: rows that only a, only b gets right, exact p, n."""
    ra, rb = F.col(a) == F.col(y), F.col(b) == F.col(y)
    g = df.agg(F.count_if(ra & ~rb).alias("only_a"), F.count_if(~ra & rb).alias("only_b"), F.count("*").alias("n"))
    return g.select("only_a", "only_b", binomial_two_sided(F.col("only_a").cast("double"), (F.col("only_a") + F.col("only_b")).cast("double")).alias("p"), "n")


def tie_break_mcnemar(df: DataFrame, y: str, a: str, b: str, fraction: float, n: int = 2000, seed: int = 42) -> DataFrame:
    """rep, only_a, only_b, p, n of McNemar's test of the rows of greatest a against those of greatest b, ties at both cuts broken at random.

    A row is in, out or tied at each score's cut.  Which tied rows are drawn matters only through how many of each class and each
    state of the other score they are, and those numbers are hypergeometric: Spark counts rows by class and states, 18 numbers at
    most, and the draws are made from them.
    """
    import numpy as np

    rows = df.select(y, a, b).dropna(subset=[y])
    quota = {}
    for c, name in ((a, "__a"), (b, "__b")):
        ranks = value_ranks(rows, c, descending=True)
        ranks = ranks.withColumn("quota", F.bround(F.col("total") * F.lit(fraction)).cast("long"))
        last = F.col("rank_min") + F.col("n") - 1
        state = F.when(last <= F.col("quota"), 1).when(F.col("rank_min") > F.col("quota"), 0).otherwise(2)
        edge = ranks.filter(state == 2).agg(F.first(F.col("quota") - F.col("rank_min") + 1)).first()[0]
        quota[name] = int(edge or 0)
        rows = rows.join(ranks.select(c, state.alias(name)), c, "left").fillna(0, [name])
    cells = {(int(r[y]), r["__a"], r["__b"]): r.n for r in rows.groupBy(y, "__a", "__b").agg(F.count("*").alias("n")).collect()}
    draw, out = np.random.default_rng(seed), []
    for rep in range(1, n + 1):
        now = dict(cells)
        for at, name in ((1, "__a"), (2, "__b")):
            tied = sorted(k for k in now if k[at] == 2)
            got = draw.multivariate_hypergeometric([now[k] for k in tied], quota[name]) if tied else []
            for k, g in zip(tied, got, strict=True):
                all_ = now.pop(k)
                for state, m in ((1, int(g)), (0, all_ - int(g))):
                    to = (*k[:at], state, *k[at + 1 :])
                    now[to] = now.get(to, 0) + m
        only = [sum(m for (c, p, q), m in now.items() if (p == c) == x and (q == c) != x) for x in (True, False)]
        out.append((rep, only[0], only[1], dist.binom_two_sided(only[0], sum(only)), sum(now.values())))
    return df.sparkSession.createDataFrame(out, "rep int, only_a long, only_b long, p double, n long")


def diebold_mariano(df: DataFrame, order: str, a: str, b: str, h: int = 1) -> DataFrame:
    """One row: n, mean difference of losses, DM, the Harvey-Leybourne-Newbold statistic, p values with n - 1 degrees."""
    d = df.select(order, (F.col(a) - F.col(b)).alias("d")).filter("d IS NOT NULL")
    g = d.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.var_pop("d").alias("lrv"))
    if h > 1:
        acov = lag_autocovariance(d, "d", order, h - 1)
        g = g.drop("lrv").crossJoin(acov.agg(F.sum(F.col("acov") * F.when(F.col("k") == 0, 1.0).otherwise(2.0)).alias("lrv")))
    n = F.col("n").cast("double")
    g = g.withColumn("dm", F.try_divide("mean", F.sqrt(F.col("lrv") / n)))
    g = g.withColumn("statistic", F.col("dm") * F.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n))
    return g.select("n", "mean", "dm", "statistic", t_two_sided(F.col("statistic"), n - 1).alias("p_two_sided"), t_upper(F.col("statistic"), n - 1).alias("p_upper"))


def optimal_block(df: DataFrame, order: str, value: str, most: int = 250) -> float:
    """Mean block length for the stationary bootstrap by Politis and White's rule with Patton's correction, at least 1.

    Autocovariances up to sqrt(n) lags, ``most`` at the utmost, come back; the rule itself is arithmetic on them.
    """
    d = df.filter(F.col(value).isNotNull())
    n = d.count()
    if n < 9:
        return 1.0
    run = max(5, int(math.sqrt(math.log10(n))))
    top = min(math.ceil(math.sqrt(n)) + run, n - 1, most)
    acov = [r.acov for r in lag_autocovariance(d, value, order, top).orderBy("k").collect()]
    if acov[0] <= 0:
        return 1.0
    small = 2 * math.sqrt(math.log10(n) / n)
    loud = [k for k in range(1, top + 1) if abs(acov[k]) >= small * acov[0]]
    quiet = next((p for p, q in zip([0, *loud], [*loud, top + run + 1]) if q - p > run), top)  # the last lag before a run of small ones
    width = min(2 * max(quiet, 1), top)
    taper = [min(1.0, 2 * (1 - k / width)) for k in range(width + 1)]
    slope = 2 * sum(t * k * acov[k] for k, t in enumerate(taper))
    level = acov[0] + 2 * sum(taper[k] * acov[k] for k in range(1, width + 1))
    if level == 0:
        return 1.0
    return max(1.0, min(abs(slope / level) ** (2 / 3) * n ** (1 / 3), math.ceil(min(3 * math.sqrt(n), n / 3))))


def stationary_bootstrap(df: DataFrame, order: str, value: str, block: float | None = None, n: int = 500, seed: int = 42) -> DataFrame:
    """One row: mean, p values and 95 % interval of the mean, blocks of geometric length with mean ``block`` (none: optimal_block)."""
    block = optimal_block(df, order, value) if block is None else block
    v = df.filter(F.col(value).isNotNull()).select(order, F.col(value).cast("double").alias("b"))
    means = stationary_means(v, order, ["b"], block, n, seed)
    c = means.crossJoin(F.broadcast(v.agg(F.avg("b").alias("m"))))
    return c.agg(F.first("m").alias("mean"), F.avg((F.abs(F.col("b") - F.col("m")) >= F.abs("m")).cast("double")).alias("p_two_sided"), F.avg((F.col("b") - F.col("m") >= F.col("m")).cast("double")).alias("p_upper"), F.percentile("b", F.lit(0.025)).alias("low"), F.percentile("b", F.lit(0.975)).alias("high"))


def giacomini_white(df: DataFrame, a: str, b: str, instruments: Sequence[str]) -> DataFrame:
    """One row: statistic, df, p, mean of a - b; instruments with a constant.  Moments in Spark, the small solve in one row."""
    cols = ["__1", *instruments]
    d = df.withColumn("__1", F.lit(1.0)).select(*(F.col(c).cast("double").alias(c) for c in cols), (F.col(a) - F.col(b)).alias("__d")).dropna()
    q = len(cols)
    d2 = F.col("__d") * F.col("__d")
    g = d.agg(F.count("*").alias("n"), F.avg("__d").alias("mean"), F.array(*(F.avg(F.col(c) * F.col("__d")) for c in cols)).alias("z"), F.array(*(F.avg(F.col(x) * F.col(y) * d2) for x in cols for y in cols)).alias("o"))

    def stat(n: int, z: list, o: list) -> float:
        import numpy as np

        zz = np.array(z)
        return float(n * zz @ np.linalg.solve(np.array(o).reshape(len(z), -1), zz))

    g = g.withColumn("statistic", F.udf(stat, DoubleType())("n", "z", "o"))
    return g.select("statistic", F.lit(q).alias("df"), chi2_upper(F.col("statistic"), F.lit(float(q))).alias("p"), "mean")


# effect sizes and several comparisons ------------------------------------------------------------


def cliffs_delta(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: P(X > Y) - P(X < Y), X being rows with group 1, and its band; also A12."""
    t = running_totals(score_table(df, group, value), "score", {"below": "neg"})
    g = t.agg(F.try_divide(F.sum(F.col("pos") * (F.col("below") - F.col("neg") / 2.0)), (F.sum("pos") * F.sum("neg")).cast("double")).alias("a12")).withColumn("delta", 2 * F.col("a12") - 1)
    return g.select("delta", "a12", magnitude("delta", CLIFF).alias("magnitude"))


def cohens_d(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: difference of means over the pooled deviation, and its band."""
    x, y = F.when(F.col(group) == 1, F.col(value)), F.when(F.col(group) == 0, F.col(value))
    g = df.agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"), F.count(x).alias("nx"), F.count(y).alias("ny"))
    sp = F.sqrt(((F.col("nx") - 1) * F.col("vx") + (F.col("ny") - 1) * F.col("vy")) / (F.col("nx") + F.col("ny") - 2))
    return g.withColumn("d", F.try_divide(F.col("mx") - F.col("my"), sp)).select("d", magnitude("d", COHEN).alias("magnitude"))


def cohens_dz(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: mean of a - b over its deviation, and its band."""
    g = df.select((F.col(a) - F.col(b)).alias("x")).agg(F.try_divide(F.avg("x"), F.stddev_samp("x")).alias("d"))
    return g.select("d", magnitude("d", COHEN).alias("magnitude"))


def adjust_p(df: DataFrame, p: str, key: str, method: str = "holm", by: Sequence[str] = ()) -> DataFrame:
    """Add p_adjusted by holm, bonferroni or bh within each family."""
    m = F.count(p).over(Window.partitionBy(*by))
    up = Window.partitionBy(*by).orderBy(F.col(p), F.col(key))
    if method == "bonferroni":
        return df.withColumn("p_adjusted", F.least(F.lit(1.0), F.col(p) * m))
    d = df.withColumn("__i", F.row_number().over(up)).withColumn("__m", m)
    if method == "holm":
        adj = F.max((F.col("__m") - F.col("__i") + 1) * F.col(p)).over(up.rowsBetween(Window.unboundedPreceding, 0))
    else:
        adj = F.min(F.col("__m") / F.col("__i") * F.col(p)).over(up.rowsBetween(0, Window.unboundedFollowing))
    return d.withColumn("p_adjusted", F.least(F.lit(1.0), adj)).drop("__i", "__m")


def complete_blocks(long: DataFrame, block: str = "block", treatment: str = "treatment", value: str = "value") -> DataFrame:
    """Blocks that have every treatment."""
    k = long.select(treatment).distinct().agg(F.count("*").alias("__k"))
    n = F.count(value).over(Window.partitionBy(block))
    return long.filter(F.col(value).isNotNull()).withColumn("__n", n).crossJoin(F.broadcast(k)).filter("__n = __k").drop("__n", "__k")


def mean_ranks(long: DataFrame, higher_is_better: bool = True) -> DataFrame:
    """treatment, mean_rank over complete blocks; 1 is best."""
    r = complete_blocks(long).withColumn("rank", group_rank("value", ["block"], descending=higher_is_better))
    return r.groupBy("treatment").agg(F.avg("rank").alias("mean_rank"), F.count("*").alias("n_blocks"))


def friedman(long: DataFrame, higher_is_better: bool = True, alpha: float = 0.05, tie_corrected: bool = True) -> DataFrame:
    """One row: n_blocks, k, chi2, p, F (Iman-Davenport), its p, and Nemenyi's critical difference."""
    r = complete_blocks(long).withColumn("rank", group_rank("value", ["block"], descending=higher_is_better))
    sums = r.groupBy("treatment").agg(F.sum("rank").alias("s"), F.count("*").alias("n")).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.max("n").alias("n_blocks"), F.count("*").alias("k"))
    ties = r.groupBy("block", "value").agg(F.count("*").alias("c")).agg(F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("t"))
    g = sums.crossJoin(ties)
    n, k = F.col("n_blocks").cast("double"), F.col("k").cast("double")
    chi = 12.0 / (n * k * (k + 1)) * F.col("ss") - 3 * n * (k + 1)
    if tie_corrected:
        chi = F.try_divide(chi, 1 - F.col("t") / (n * k * (k * k - 1)))
    g = g.withColumn("chi2", chi).withColumn("F", F.try_divide((n - 1) * F.col("chi2"), n * (k - 1) - F.col("chi2")))
    q = _scalar(lambda kk, ppf=dist.studentized_range_ppf: ppf(1 - alpha, int(kk)) / math.sqrt(2), k)
    return g.select("n_blocks", "k", "chi2", chi2_upper(F.col("chi2"), k - 1).alias("p"), "F", f_upper(F.col("F"), k - 1, (k - 1) * (n - 1)).alias("p_iman_davenport"), (q * F.sqrt(k * (k + 1) / (6 * n))).alias("critical_difference"))


def nemenyi(long: DataFrame, higher_is_better: bool = True) -> DataFrame:
    """a, b, difference of mean ranks, p, for treatment pairs a < b."""
    m = mean_ranks(long, higher_is_better)
    k = m.agg(F.count("*").alias("k"))
    a, b = m.select(F.col("treatment").alias("a"), F.col("mean_rank").alias("ra"), "n_blocks"), m.select(F.col("treatment").alias("b"), F.col("mean_rank").alias("rb"))
    j = a.join(b, F.col("a") < F.col("b")).crossJoin(k)
    q = F.abs(F.col("ra") - F.col("rb")) / F.sqrt(F.col("k") * (F.col("k") + 1) / (6.0 * F.col("n_blocks"))) * math.sqrt(2)
    return j.select("a", "b", (F.col("ra") - F.col("rb")).alias("diff"), _scalar(lambda x, kk, sf=dist.studentized_range_sf: sf(x, int(kk)), q, F.col("k").cast("double")).alias("p"))


def model_confidence_set(losses: DataFrame, order: str, models: Sequence[str], alpha: float = 0.1, block: float = 1.0, n: int = 200, seed: int = 42) -> DataFrame:
    """model, p_mcs, included: models leave one by one while the range statistic rejects equal losses.

    Spark computes mean losses and their bootstrap replicates, models x replicates numbers; the elimination runs on
    that small table in one task.
    """
    v = losses.select(order, *(F.col(m).cast("double").alias(m) for m in models)).dropna(subset=list(models))
    means = stationary_means(v, order, models, block, n, seed).union(v.agg(F.lit(0).alias("rep"), *(F.avg(m).alias(m) for m in models)))
    names = list(models)

    def eliminate(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("rep")
        base, reps = pdf[names].to_numpy()[0], pdf[names].to_numpy()[1:]
        left, p_mcs, so_far = list(range(len(names))), {}, 0.0
        while len(left) > 1:
            d = base[left][:, None] - base[left][None, :]
            rd = reps[:, left][:, :, None] - reps[:, left][:, None, :] - d
            sd = np.sqrt((rd**2).mean(0))
            with np.errstate(divide="ignore", invalid="ignore"):
                t, rt = np.where(sd > 0, d / sd, 0.0), np.where(sd > 0, np.abs(rd) / sd, 0.0)
            so_far = max(so_far, float((rt.max((1, 2)) >= np.abs(t).max()).mean()))
            out = left[int(t.max(1).argmax())]
            p_mcs[out] = so_far
            left.remove(out)
        p_mcs[left[0]] = 1.0
        return pd.DataFrame({"model": names, "p_mcs": [p_mcs[i] for i in range(len(names))], "included": [p_mcs[i] > alpha for i in range(len(names))]})

    return means.groupBy(F.lit(0).alias("all")).applyInPandas(eliminate, "model string, p_mcs double, included boolean")


def battery(df: DataFrame, key: str, y: str, model: str, benchmarks: Sequence[str], fold: str = "fold", share: float = 0.25, alpha: float = 0.05) -> DataFrame:
    """benchmark, test, statistic, p, p_adjusted, in_favour, rejects: one score against each benchmark.

    P1 Wilcoxon and P2 corrected t on AUCs by fold, P3 DeLong and P4 McNemar (of the rows of greatest score) on all
    rows; p values are adjusted by Holm within a test.  A rejection speaks for the model only where in_favour.
    """
    from tidemark.operators.boosting import checkpointed

    names = [model, *benchmarks]
    long = df.select(y, fold, F.inline(F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("value")) for m in names))))
    per = checkpointed(auc(long, y, "value", ["model", fold]).groupBy(fold).pivot("model", names).agg(F.first("auc")))  # a row per fold
    marked, out = df.select(key, y, *names), None
    for m in names:  # written between, for each mark reads the table before it three times
        marked = checkpointed(top_fraction(marked, m, share, key, 0, f"__{m}"))
    for b in benchmarks:
        median = per.agg((F.median(F.col(model) - F.col(b)) > 0).alias("in_favour"))
        rows = {
            "P1": wilcoxon(per, model, b).crossJoin(median).select("statistic", "p", "in_favour"),
            "P2": corrected_t(per, model, b).select("t", "p", F.col("mean") > 0),
            "P3": delong(df, y, b, model).select("z", "p_two_sided", F.col("diff") > 0),
            "P4": mcnemar(marked, y, f"__{model}", f"__{b}").select((F.col("only_a") - F.col("only_b")).cast("double"), "p", F.col("only_a") > F.col("only_b")),
        }
        for test, r in rows.items():
            one = r.toDF("statistic", "p", "in_favour").select(F.lit(b).alias("benchmark"), F.lit(test).alias("test"), "*")
            one = checkpointed(one)  # one row, so that plans stay small
            out = one if out is None else out.unionByName(one)
    return adjust_p(out, "p", "benchmark", by=["test"]).withColumn("rejects", F.col("p_adjusted") < alpha)


def battery_regression(df: DataFrame, key: str, y: str, model: str, benchmarks: Sequence[str], fold: str = "fold", alpha: float = 0.05, n_perm: int = N_PERM, n_boot: int = N_BOOT) -> DataFrame:
    """As battery, for forecasts: P1 Wilcoxon and P2 corrected t on RMSE by fold, P3 paired sign flips of squared errors and P4 the
    paired bootstrap of the RMSE difference (p by inverting its BCa interval) on all rows.

    Differences are model - benchmark, so those below 0 speak for the model.  Rows where a value is null are left out of P3 and P4.
    """
    from tidemark.operators.boosting import checkpointed

    names = [model, *benchmarks]
    square = lambda m: (F.col(m) - F.col(y)) ** 2
    per = checkpointed(df.groupBy(fold).agg(*(F.sqrt(F.avg(square(m))).alias(m) for m in names)))  # a row per fold
    errors, out = df.select(key, *(square(m).alias(m) for m in names)), None
    for b in benchmarks:
        median = per.agg((F.median(F.col(model) - F.col(b)) < 0).alias("in_favour"))
        boot = bca_regression(df, key, y, b, model, n_boot).filter("metric = 'rmse'")
        rows = {
            "P1": wilcoxon(per, model, b).crossJoin(median).select("statistic", "p", "in_favour"),
            "P2": corrected_t(per, model, b).select("t", "p", F.col("mean") < 0),
            "P3": permutation_test(errors, key, model, b, n_perm).select("diff", "p", F.col("diff") < 0),
            "P4": boot.select("estimate", "p", F.col("estimate") < 0),
        }
        for test, r in rows.items():
            one = checkpointed(r.toDF("statistic", "p", "in_favour").select(F.lit(b).alias("benchmark"), F.lit(test).alias("test"), "*"))  # one row
            out = one if out is None else out.unionByName(one)
    return adjust_p(out, "p", "benchmark", by=["test"]).withColumn("rejects", F.col("p_adjusted") < alpha)


def share_of_wins(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: share of rows where a is greater, ties half."""
    return df.agg(ratio(F.sum(F.when(F.col(a) > F.col(b), 1.0).when(F.col(a) == F.col(b), 0.5).otherwise(0.0)), F.count("*")).alias("share"))
