"""Exploratory profiles: missingness, descriptions, outliers, associations, bins, histograms, rollups, reconciliation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import corr, hist_bucket, isclose, ratio, skew_g1
from tidemark.operators.order import quantiles, value_ranks


def _long(wide: DataFrame, parts: dict[str, Sequence[Column]], names: Sequence[str], key: str = "variable") -> DataFrame:
    """Rows of a one-row table: for each key the columns under ``names``."""
    rows = [F.struct(F.lit(k).alias(key), *(c.alias(n) for c, n in zip(cols, names, strict=True))) for k, cols in parts.items()]
    return wide.select(F.inline(F.array(*rows)))


def missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """variable, missing, pct for columns that miss any value."""
    columns = columns or df.columns
    wide = df.agg(F.count("*").alias("__n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return _long(wide, {c: (F.col(c), ratio(F.col(c) * 100, "__n")) for c in columns}, ("missing", "pct")).filter("missing > 0")


def missing_flags(df: DataFrame, columns: Sequence[str], prefix: str = "has_") -> DataFrame:
    """Add prefix<column>, 1 where the value is there."""
    return df.withColumns({f"{prefix}{c}": F.col(c).isNotNull().cast("int") for c in columns})


def duplicates(df: DataFrame) -> DataFrame:
    """One row: rows beyond the first of each set of rows equal in all columns, nulls equal to nulls."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("__n")).agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicates"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """variable, n, mean, sd, min, p25, p50, p75, max, skew (bias-corrected) of numeric columns: one pass, and one for quartiles."""
    names = ("n", "mean", "sd", "min", "max", "skew")
    aggs = [a.alias(f"{c}__{n}") for c in columns for a, n in zip((F.count(c), F.avg(c), F.stddev_samp(c), F.min(c).cast("double"), F.max(c).cast("double"), skew_g1(c)), names, strict=True)]
    wide = _long(df.agg(*aggs), {c: tuple(F.col(f"{c}__{n}") for n in names) for c in columns}, names)
    out = wide.join(quantiles(unpivot(df, columns), "value", [0.25, 0.5, 0.75], "__q", ["variable"]), "variable", "left")
    return out.select("variable", *names[:4], *(F.col("__q")[k].alias(p) for k, p in enumerate(("p25", "p50", "p75"))), "max", "skew")


def describe_categories(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """variable, levels, most and least frequent level (ties: the smallest) and their shares."""

    def one(c: str) -> DataFrame:
        counts = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(F.count("*").alias("n"))
        top, low = F.min(F.struct((-F.col("n")).alias("k"), "v")), F.min(F.struct(F.col("n").alias("k"), "v"))
        g = counts.agg(F.count("*").alias("levels"), F.sum("n").alias("t"), top.alias("top"), low.alias("low"))
        return g.select(F.lit(c).alias("variable"), "levels", F.col("top.v").alias("most"), ratio(-F.col("top.k"), "t").alias("most_share"), F.col("low.v").alias("least"), ratio("low.k", "t").alias("least_share"))

    return reduce(DataFrame.union, map(one, columns))


def value_counts(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """Value, n, share; with k the most frequent ones (ties by value)."""
    g = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("__t"))
    out = g.crossJoin(F.broadcast(total)).select(column, "n", ratio("n", "__t").alias("share"))
    return out if k is None else out.orderBy(F.col("n").desc(), column).limit(k)


def fences(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Quartiles and Tukey fences of each column, long, per group."""
    q = [0.25, 0.5, 0.75]
    g = df.groupBy(*by).agg(*(F.percentile(c, q).alias(c) for c in columns)) if by else reduce(DataFrame.crossJoin, (quantiles(df, c, q, c) for c in columns))
    spread = lambda c: F.col(c)[2] - F.col(c)[0]
    rows = [F.struct(F.lit(c).alias("variable"), F.col(c)[0].alias("q1"), F.col(c)[1].alias("q2"), F.col(c)[2].alias("q3"), (F.col(c)[0] - 1.5 * spread(c)).alias("low"), (F.col(c)[2] + 1.5 * spread(c)).alias("high")) for c in columns]
    return g.select(*by, F.inline(F.array(*rows)))


def unpivot(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), name: str = "variable", value: str = "value") -> DataFrame:
    """Long form of numeric columns."""
    return df.select(*keep, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(list(keep), list(columns), name, value)


def outliers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """variable, outliers, pct, low, high, zero_iqr by Tukey's rule."""
    long = unpivot(df, columns).filter("value IS NOT NULL")
    j = long.join(F.broadcast(fences(df, columns)), "variable")
    out = (F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))
    g = j.groupBy("variable", "low", "high", (F.col("q3") == F.col("q1")).alias("zero_iqr")).agg(F.count_if(out).alias("outliers"), F.count("*").alias("__n"))
    return g.select("variable", "outliers", ratio(F.col("outliers") * 100, "__n").alias("pct"), "low", "high", "zero_iqr")


def box(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, fences, and whiskers: the extreme values inside the fences, per group."""
    f = fences(df, [column], by).drop("variable")
    j = df.select(*by, column).join(F.broadcast(f), list(by)) if by else df.select(column).crossJoin(F.broadcast(f))
    inside = F.col(column).between(F.col("low"), F.col("high"))
    return j.groupBy(*by, "q1", "q2", "q3", "low", "high").agg(F.min(F.when(inside, F.col(column))).alias("whisker_low"), F.max(F.when(inside, F.col(column))).alias("whisker_high"), F.count(column).alias("n"))


def any_outlier(df: DataFrame, columns: Sequence[str], positive: str) -> DataFrame:
    """outlier flag over any of the columns, rows and positive rate of each side."""
    f = fences(df, columns).groupBy().pivot("variable", list(columns)).agg(F.first("low").alias("low"), F.first("high").alias("high"))
    j = df.crossJoin(F.broadcast(f))
    flag = reduce(Column.__or__, (F.coalesce((F.col(c) < F.col(f"{c}_low")) | (F.col(c) > F.col(f"{c}_high")), F.lit(False)) for c in columns))
    return j.groupBy(flag.alias("outlier")).agg(F.count("*").alias("n"), F.avg(F.col(positive).cast("double")).alias("positive_rate"))


def pearson(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """a, b, r of column pairs, each over rows that have both, in one pass."""
    wide = df.agg(*(corr(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)))
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)]
    return wide.select(F.inline(F.array(*rows)))


def high_correlations(df: DataFrame, columns: Sequence[str], least: float = 0.9) -> DataFrame:
    """Pairs of columns (a before b) with |r| above least, the greatest first."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    return pearson(df, pairs).filter(F.abs("r") > least).orderBy(F.abs("r").desc(), "a", "b")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: Pearson of average ranks, over rows that have both."""
    both = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    ra = value_ranks(both, "a").select("a", F.col("rank_avg").alias("ra"))
    rb = value_ranks(both, "b").select("b", F.col("rank_avg").alias("rb"))
    return both.groupBy("a", "b").agg(F.count("*").alias("w")).join(ra, "a").join(rb, "b").agg(weighted_corr(F.col("ra"), F.col("rb"), F.col("w")).alias("rho"))


def weighted_corr(x: Column, y: Column, w: Column) -> Column:
    """Correlation of rows that stand for w rows each."""
    n, sx, sy = F.sum(w).cast("double"), F.sum(w * x), F.sum(w * y)
    num = F.sum(w * x * y) - sx * sy / n
    return F.try_divide(num, F.sqrt((F.sum(w * x * x) - sx * sx / n) * (F.sum(w * y * y) - sy * sy / n)))


def eta_squared(df: DataFrame, group: str, value: str, null_is_level: bool = False) -> DataFrame:
    """One row: between-group over total sum of squares; null below two levels."""
    g = F.coalesce(F.col(group).cast("string"), F.lit("nan")) if null_is_level else F.col(group).cast("string")
    rows = df.select(g.alias("g"), F.col(value).cast("double").alias("v")).filter("g IS NOT NULL AND v IS NOT NULL")
    per = rows.groupBy("g").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    t = per.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"), F.count("*").alias("levels"))
    mean = F.col("s") * F.col("s") / F.col("n")
    return t.select(F.when(F.col("levels") >= 2, F.try_divide(F.col("between") - mean, F.col("q") - mean)).alias("eta2"))


def contingency(df: DataFrame, row: str, column: str) -> DataFrame:
    """Long row-normalised contingency table: row, column, n, share within the row, absent pairs 0."""
    rows = df.select(row, column).filter(F.col(row).isNotNull() & F.col(column).isNotNull())
    cells = rows.groupBy(row, column).agg(F.count("*").alias("n"))
    full = rows.select(row).distinct().crossJoin(rows.select(column).distinct()).join(cells, [row, column], "left").fillna(0, ["n"])
    return full.withColumn("share", ratio("n", F.sum("n").over(Window.partitionBy(row))))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: bias-corrected Cramer's V; chi-squared with Yates' correction on 2 x 2 tables."""
    cells = contingency(df, a, b)
    wa, wb, every = Window.partitionBy(a), Window.partitionBy(b), Window.partitionBy()
    e = cells.withColumns({"ta": F.sum("n").over(wa), "tb": F.sum("n").over(wb), "t": F.sum("n").over(every)}).withColumn("exp", F.col("ta") * F.col("tb") / F.col("t").cast("double"))
    size = e.agg(F.count_distinct(a).alias("r"), F.count_distinct(b).alias("k"))
    e = e.crossJoin(F.broadcast(size))
    gap = F.abs(F.col("n") - F.col("exp"))
    gap = F.when((F.col("r") == 2) & (F.col("k") == 2), gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    s = e.agg(F.sum(gap * gap / F.col("exp")).alias("chi2"), F.max("t").alias("n"), F.max("r").alias("r"), F.max("k").alias("k"))
    n, r, k = F.col("n").cast("double"), F.col("r").cast("double"), F.col("k").cast("double")
    phi = F.greatest(F.lit(0.0), F.col("chi2") / n - (k - 1) * (r - 1) / (n - 1))
    rc, kc = r - (r - 1) * (r - 1) / (n - 1), k - (k - 1) * (k - 1) / (n - 1)
    return s.select(F.sqrt(F.try_divide(phi, F.least(rc - 1, kc - 1))).alias("v"))


def quantile_edges(df: DataFrame, column: str, n: int) -> DataFrame:
    """One row: distinct quantile edges, ascending."""
    q = [k / n for k in range(n + 1)]
    return quantiles(df, column, q).select(F.array_sort(F.array_distinct("q")).alias("edges"))


def quantile_bins(df: DataFrame, column: str, n: int, out: str = "bin") -> DataFrame:
    """Add equal-frequency bins by value: right-closed between distinct quantile edges, the least value in the first, 1..m."""
    j = df.crossJoin(F.broadcast(quantile_edges(df, column, n)))
    below = F.size(F.filter(F.col("edges"), lambda e: e < F.col(column)))
    return j.withColumn(out, F.when(F.col(column).isNotNull(), F.greatest(below, F.lit(1)))).drop("edges")


def profile_variable(df: DataFrame, column: str, target: str, positive: str, bins: int = 20, most: int = 30, categorical: bool = False) -> DataFrame:
    """kind, x, low, high, level, n, mean_target, positive_rate per category, per value (at most ``most``) or per quantile bin."""
    aggs = [F.count("*").alias("n"), F.avg(target).alias("mean_target"), F.avg(F.col(positive).cast("double")).alias("positive_rate")]
    if categorical:
        g = df.groupBy(F.col(column).cast("string").alias("level")).agg(*aggs)
        none = F.lit(None).cast("double")
        return g.select(F.lit("category").alias("kind"), none.alias("x"), none.alias("low"), none.alias("high"), "level", "n", "mean_target", "positive_rate")
    x = df.withColumn("__x", F.col(column).cast("double")).filter("__x IS NOT NULL")
    ends = [F.min("__x").alias("low"), F.max("__x").alias("high")]
    distinct = x.select("__x").distinct().limit(most + 1).count()
    if distinct <= most:
        g = x.groupBy("__x").agg(*aggs, *ends).withColumnRenamed("__x", "x")
    else:
        edges = F.array(*map(F.lit, quantile_edges(x, "__x", bins).head().edges))  # bins + 1 numbers
        keyed = x.withColumn("__bin", F.greatest(F.size(F.filter(edges, lambda e: e < F.col("__x"))), F.lit(1)))
        g = keyed.groupBy("__bin").agg(*aggs, *ends).join(quantiles(keyed, "__x", [0.5], "__q", ["__bin"]), "__bin").withColumn("x", F.col("__q")[0])
    return g.select(F.lit("value" if distinct <= most else "bin").alias("kind"), "x", "low", "high", F.lit(None).cast("string").alias("level"), "n", "mean_target", "positive_rate")


def histogram(df: DataFrame, column: str, n: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """bin, low, high, n of n equal bins between the least and greatest value, or given edges; the last is closed."""
    c = F.col(column).cast("double")
    edge = df.agg((F.min(c) if low is None else F.lit(float(low))).alias("lo"), (F.max(c) if high is None else F.lit(float(high))).alias("hi"))
    counts = df.filter(c.isNotNull()).crossJoin(F.broadcast(edge)).groupBy(hist_bucket(c, F.col("lo"), F.col("hi"), n).alias("bin")).agg(F.count("*").alias("n"))
    grid = edge.select("lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("bin"))
    step = (F.col("hi") - F.col("lo")) / F.lit(float(n))
    return grid.join(counts, "bin", "left").select("bin", (F.col("lo") + (F.col("bin") - 1) * step).alias("low"), (F.col("lo") + F.col("bin") * step).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def histogram_with_tail(df: DataFrame, column: str, n: int = 30, p: float = 0.99) -> DataFrame:
    """bin, n: n equal bins up to the p-quantile, and bin n + 1 for what lies above."""
    c = F.col(column).cast("double")
    edge = df.agg(F.min(c).alias("lo")).crossJoin(quantiles(df, column, [p]).select(F.col("q")[0].alias("hi")))
    b = F.when(c > F.col("hi"), n + 1).otherwise(hist_bucket(c, F.col("lo"), F.col("hi"), n))
    return df.filter(c.isNotNull()).crossJoin(F.broadcast(edge)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def compare_shares(df: DataFrame, keep: Column, column: str, n: int) -> DataFrame:
    """bin, share of the filtered rows, share of all rows."""
    c = F.col(column).cast("double")
    edge = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi"))
    g = df.filter(c.isNotNull()).crossJoin(F.broadcast(edge)).groupBy(hist_bucket(c, F.col("lo"), F.col("hi"), n).alias("bin")).agg(F.count_if(keep).alias("a"), F.count("*").alias("b"))
    t = g.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    return g.crossJoin(F.broadcast(t)).select("bin", ratio("a", "ta").alias("share_kept"), ratio("b", "tb").alias("share_all"))


def staircase(df: DataFrame, level: str, value: str) -> DataFrame:
    """Count, mean, deviation per level, and the step from the level before."""
    g = df.filter(F.col(level).isNotNull()).groupBy(level).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return g.withColumn("step", F.col("mean") - F.lag("mean").over(Window.orderBy(level)))


def duplicate_columns(df: DataFrame, a: str, b: str, rtol: float = 1e-6) -> DataFrame:
    """One row: percent of rows where a is close to b, percent where their sorted values are, correlation, ratio of medians.

    Sorted values meet place by place; places come from running counts of distinct values, so neither list is
    gathered: value ranges of both are joined by overlap of their places.
    """
    rows = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    by_row = rows.agg(F.avg(isclose("a", "b", rtol).cast("double") * 100).alias("by_row_pct"), corr("a", "b").alias("r"), F.count("*").alias("__n"))
    by_row = by_row.crossJoin(quantiles(rows, "a", [0.5], "__qa")).crossJoin(quantiles(rows, "b", [0.5], "__qb")).withColumn("median_ratio", F.try_divide(F.col("__qa")[0], F.col("__qb")[0]))
    last = F.col("rank_min") + F.col("n") - 1
    chunks = lambda c: value_ranks(rows, c).select(F.col(c), last.alias("last"), F.explode(F.sequence(F.col("rank_min"), last, F.lit(1 << 16))).alias("at"))
    span = lambda c: chunks(c).select(c, F.explode(F.sequence(F.col("at"), F.least(F.col("last"), F.col("at") + (1 << 16) - 1))).alias("place"))
    same = span("a").join(span("b"), "place").agg(F.count_if(isclose("a", "b", rtol)).alias("__same"))
    return by_row.crossJoin(same).select("by_row_pct", ratio(F.col("__same") * 100, "__n").alias("same_values_pct"), "r", "median_ratio")


def reconcile(customers: DataFrame, tx: DataFrame, reported: dict[str, str], rtol: float = 0.01) -> DataFrame:
    """measure, pct of customers whose reported value is close to the recomputed one; measures n, total, mean."""
    real = tx.groupBy("customer_id").agg(F.count("*").cast("double").alias("n"), F.sum("amount").alias("total"), F.avg("amount").alias("mean"))
    j = customers.join(real, "customer_id", "left")
    wide = j.agg(*(F.avg(isclose(c, m, rtol).cast("double") * 100).alias(m) for m, c in reported.items()))
    return _long(wide, {m: (F.col(m),) for m in reported}, ("pct",), "measure")


def conditional_means(df: DataFrame, flag: Column, columns: Sequence[str]) -> DataFrame:
    """Means of columns on each side of a predicate."""
    return df.groupBy(flag.alias("flag")).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"mean_{c}") for c in columns))


def monthly(tx: DataFrame) -> DataFrame:
    """month, n, volume."""
    return tx.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.sum("amount").alias("volume"))


def monthly_mix(tx: DataFrame, types: Sequence[str]) -> DataFrame:
    """month and a count per type, 0 where absent."""
    return tx.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(*(F.count_if(F.col("type") == t).alias(f"n_{t}") for t in types))


def weekdays(tx: DataFrame) -> DataFrame:
    """weekday (Monday 0), n."""
    return tx.groupBy(F.weekday("date").alias("weekday")).agg(F.count("*").alias("n"))


def screen(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """variable, min, p1, p99, max, zero_share."""
    aggs = [a.alias(f"{c}__{n}") for c in columns for a, n in ((F.min(c).cast("double"), "min"), (F.max(c).cast("double"), "max"), (F.avg((F.col(c) == 0).cast("double")), "zero"))]
    wide = _long(df.agg(*aggs), {c: (F.col(f"{c}__min"), F.col(f"{c}__max"), F.col(f"{c}__zero")) for c in columns}, ("min", "max", "zero_share"))
    out = wide.join(quantiles(unpivot(df, columns), "value", [0.01, 0.99], "__q", ["variable"]), "variable", "left")
    return out.select("variable", "min", F.col("__q")[0].alias("p1"), F.col("__q")[1].alias("p99"), "max", "zero_share")


def within_slope(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """One row: least-squares slope of y on x inside groups, from group sums alone."""
    rows = df.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    g = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("x") * F.col("y")).alias("xy"))
    return g.agg(F.try_divide(F.sum(F.col("xy") - F.col("sx") * F.col("sy") / F.col("n")), F.sum(F.col("xx") - F.col("sx") * F.col("sx") / F.col("n"))).alias("slope"))


def mad_sigma(df: DataFrame, column: str) -> DataFrame:
    """One row: 1.4826 times the median absolute deviation from the median."""
    m = quantiles(df, column, [0.5]).select(F.col("q")[0].alias("__m"))
    gaps = df.crossJoin(F.broadcast(m)).select(F.abs(F.col(column) - F.col("__m")).alias("__d"))
    return quantiles(gaps, "__d", [0.5]).select((F.col("q")[0] * 1.4826).alias("sigma"))


def clipped_scale(df: DataFrame, column: str, out: str = "scaled", p: tuple[float, float] = (0.05, 0.95)) -> DataFrame:
    """Add (x - p5) / (p95 - p5) within [0, 1]."""
    q = quantiles(df, column, list(p), "__q")
    x = F.try_divide(F.col(column) - F.col("__q")[0], F.col("__q")[1] - F.col("__q")[0])
    return df.crossJoin(F.broadcast(q)).withColumn(out, F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))).drop("__q")


def grouped_bin_medians(df: DataFrame, x: str, y: str, group: str, bins: int) -> DataFrame:
    """group, bin, n and medians of x and y, bins being quantile bins of x over all rows."""
    return quantile_bins(df, x, bins).groupBy(group, "bin").agg(F.count("*").alias("n"), F.percentile(x, 0.5).alias("x"), F.percentile(y, 0.5).alias("y"))


def squared_error_share(df: DataFrame, group: str, error: str) -> DataFrame:
    """group, n, mean squared error, share of rows, share of all squared error."""
    g = df.groupBy(group).agg(F.count("*").alias("n"), F.sum(F.col(error) * F.col(error)).alias("sq"))
    t = g.agg(F.sum("n").alias("tn"), F.sum("sq").alias("tsq"))
    return g.crossJoin(F.broadcast(t)).select(group, "n", ratio("sq", "n").alias("mse"), ratio("n", "tn").alias("row_share"), ratio("sq", "tsq").alias("error_share"))


def overlapping_groups(df: DataFrame, groups: dict[str, Column], aggs: Sequence[Column]) -> DataFrame:
    """The same aggregates over named predicates that may overlap; a row goes to each group that holds it."""
    names = F.filter(F.array(*(F.when(F.coalesce(p, F.lit(False)), n) for n, p in groups.items())), lambda x: x.isNotNull())
    return df.withColumn("group", F.explode(names)).groupBy("group").agg(*aggs)
