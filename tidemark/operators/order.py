"""Ranks, running totals and selections over orders.

A window without a partition puts all rows into one task.  Here such orders run over distinct values
(one row per value and group, aggregated on the map side), and running totals over these go in two
levels: within value ranges, then over the few range totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import dice, half_even, place_among

RANGES = 64


def with_range(df: DataFrame, order: str, ranges: int) -> DataFrame:
    """df with ``__range``: about evenly filled value ranges 0 to ranges - 1, cut by a mergeable quantile sketch."""
    cuts = df.agg(F.percentile_approx(order, [k / ranges for k in range(1, ranges)], F.lit(max(10_000, 20 * ranges))).alias("__cuts")) if ranges > 1 else None
    if cuts is None:
        return df.withColumn("__range", F.lit(0))
    return df.crossJoin(F.broadcast(cuts)).withColumn("__range", place_among(order, F.col("__cuts"), ranges - 1)).drop("__cuts")


def running_totals(df: DataFrame, order: str, sums: dict[str, str], by: Sequence[str] = (), descending: bool = False, ranges: int | None = None) -> DataFrame:
    """Add inclusive running totals {new column: summed column} along ``order``, within ``by``.

    ``order`` is numeric and distinct within ``by``.  Values are cut into ranges of about equal numbers of rows, RANGES or
    as many as the session has shuffle partitions, so tasks hold a range each, and only range totals meet in one.
    """
    by = list(by)
    cut = with_range(df, order, ranges or max(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    key = F.col("__range").desc() if descending else F.col("__range").asc()
    totals = cut.groupBy(*by, "__range").agg(*(F.sum(c).alias(f"__t_{n}") for n, c in sums.items()))
    w = Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*by, "__range", *(F.coalesce(F.sum(f"__t_{n}").over(w), F.lit(0)).alias(f"__b_{n}") for n in sums))
    inside = Window.partitionBy(*by, "__range").orderBy(F.col(order).desc() if descending else F.col(order).asc()).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(before, [*by, "__range"])
    return out.withColumns({n: F.sum(c).over(inside) + F.col(f"__b_{n}") for n, c in sums.items()}).drop("__range", *(f"__b_{n}" for n in sums))


def value_ranks(df: DataFrame, value: str, by: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """Per distinct value: n, rank_min, rank_avg (ties share the mean of their places), and total."""
    by = list(by)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    run = running_totals(counts, value, {"upto": "n"}, by, descending)
    total = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    run = run.join(total, by) if by else run.crossJoin(F.broadcast(total))
    return run.select(*by, value, "n", (F.col("upto") - F.col("n") + 1).alias("rank_min"), (F.col("upto") - (F.col("n") - 1) / F.lit(2.0)).alias("rank_avg"), "total")


def quantiles(df: DataFrame, value: str, qs: Sequence[float], out: str = "q", by: Sequence[str] = ()) -> DataFrame:
    """One row (per group): array of exact quantiles with linear interpolation, by running counts of distinct values.

    The built-in exact percentile holds every distinct value of a group in one task; this one holds a value range.
    """
    by = list(by)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__c"))
    total = counts.groupBy(*by).agg(F.sum("__c").alias("__n"))
    t = running_totals(counts, "__v", {"__u": "__c"}, by)
    t = t.join(total, by) if by else t.crossJoin(F.broadcast(total))
    at = lambda q, k: F.floor((F.col("__n") - 1) * F.lit(float(q))) + k
    pick = lambda q, k: F.min(F.when(F.col("__u") >= at(q, k), F.col("__v")))
    row = t.groupBy(*by).agg(F.max("__n").alias("__n"), *(pick(q, k).alias(f"__{i}_{k}") for i, q in enumerate(qs) for k in (1, 2)))
    part = lambda q: (F.col("__n") - 1) * F.lit(float(q)) - F.floor((F.col("__n") - 1) * F.lit(float(q)))
    return row.select(*by, F.array(*(F.col(f"__{i}_1") + F.coalesce(part(q) * (F.col(f"__{i}_2") - F.col(f"__{i}_1")), F.lit(0.0)) for i, q in enumerate(qs))).alias(out))


def average_rank(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "rank", descending: bool = False) -> DataFrame:
    """Add the average rank of each row; null values have none."""
    ranks = value_ranks(df, value, by, descending).select(*by, value, F.col("rank_avg").alias(out))
    return df.join(ranks, [*by, value], "left")


def group_rank(value: str, by: Sequence[str], descending: bool = False) -> Column:
    """Average rank within small groups, as a window expression."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    peers = Window.partitionBy(*by, value)
    return F.rank().over(Window.partitionBy(*by).orderBy(order)) + (F.count("*").over(peers) - 1) / F.lit(2.0)


def percent_rank_avg(df: DataFrame, value: str, out: str = "pct") -> DataFrame:
    """Add average rank / count."""
    ranks = value_ranks(df, value).select(value, (F.col("rank_avg") / F.col("total")).alias(out))
    return df.join(ranks, value, "left")


def place_of(df: DataFrame, value: str, points: DataFrame, point: str = "x") -> DataFrame:
    """For each point: share of values at or below it, and its place from the top; points is a small table."""
    pairs = df.select(value).crossJoin(F.broadcast(points))
    g = pairs.groupBy(point).agg(F.count_if(F.col(value) <= F.col(point)).alias("le"), F.count_if(F.col(value) > F.col(point)).alias("gt"), F.count(value).alias("n"))
    return g.select(point, (F.col("le") / F.col("n").cast("double")).alias("percentile"), (F.col("gt") + 1).alias("place"))


def top_fraction(df: DataFrame, score: str, fraction: float, key: str, seed: int | None = None, out: str = "selected") -> DataFrame:
    """Mark the round-half-even(fraction * n) rows of greatest score.

    Ties at the cut go by key, or with a seed by a hash of it.  Only the rows tied at the cut score are
    ordered by key; whether other rows are in follows from counts by score.
    """
    ranks = value_ranks(df, score, descending=True)
    quota = half_even(F.col("total") * F.lit(fraction)).cast("long")
    state = ranks.select(score, F.col("rank_min").alias("__first"), F.col("n").alias("__n"), quota.alias("__quota"))
    rows = df.join(state, score, "left")
    tie = (F.col("__first") <= F.col("__quota")) & (F.col("__first") + F.col("__n") - 1 > F.col("__quota"))
    order = [F.col(key)] if seed is None else [dice(F.col(key), seed), F.col(key)]
    edge = rows.filter(tie).withColumn("__k", F.row_number().over(Window.partitionBy(score).orderBy(*order)))
    edge = edge.withColumn(out, (F.col("__k") <= F.col("__quota") - F.col("__first") + 1).cast("int")).drop("__k")
    rest = rows.filter(~F.coalesce(tie, F.lit(False))).withColumn(out, F.coalesce((F.col("__first") + F.col("__n") - 1 <= F.col("__quota")).cast("int"), F.lit(0)))
    return edge.unionByName(rest).drop("__first", "__n", "__quota")


def arg_max(df: DataFrame, value: str, by: Sequence[str], tie: Sequence[str], descending: bool = True) -> DataFrame:
    """The row of greatest (or least) value per group, ties by the tie columns."""
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    n = F.row_number().over(Window.partitionBy(*by).orderBy(order, *tie))
    return df.withColumn("__n", n).filter("__n = 1").drop("__n")


def lag_autocovariance(df: DataFrame, value: str, order: str, lags: int, by: Sequence[str] = ()) -> DataFrame:
    """k, acov, acf of k = 0..lags along an explicit order, divided by n; nulls count as the mean, and lags beyond the rows are 0.

    Without ``by`` the order runs over all rows, in parts with halos (series.py); with it, each group's order is a window of its own.
    """
    if not by:
        from tidemark.operators.series import lagged_products

        m = df.agg(F.avg(value).alias("__m"), F.count("*").alias("n"))
        d = df.select(order, F.col(value).alias("__x")).crossJoin(F.broadcast(m.select("__m"))).select(order, (F.col("__x") - F.col("__m")).alias("__d"))
        sums = lagged_products(d.withColumnRenamed(order, "__o"), "__d", "__o", lags)
        every = df.sparkSession.range(lags + 1).select(F.col("id").cast("int").alias("k")).join(F.broadcast(sums), "k", "left")
        zero = sums.filter("k = 0").select(F.col("s").alias("__z"))
        out = every.crossJoin(F.broadcast(m.select("n"))).crossJoin(F.broadcast(zero)).filter("n > 0")
        return out.select("k", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("acov"), F.try_divide(F.coalesce("s", F.lit(0.0)), "__z").alias("acf"))
    mean = Window.partitionBy(*by)
    d = df.withColumn("__d", F.col(value) - F.avg(value).over(mean))
    w = Window.partitionBy(*by).orderBy(order)
    d = d.withColumns({f"__l{k}": F.lag("__d", k).over(w) if k else F.col("__d") for k in range(lags + 1)})
    sums = d.groupBy(*by).agg(F.count("*").alias("n"), *(F.sum(F.col("__d") * F.col(f"__l{k}")).alias(f"s{k}") for k in range(lags + 1)))
    kinds = F.array(*(F.struct(F.lit(k).alias("k"), (F.col(f"s{k}") / F.col("n")).alias("acov"), F.try_divide(F.col(f"s{k}"), F.col("s0")).alias("acf")) for k in range(lags + 1)))
    return sums.select(*by, F.inline(kinds))


def islands(df: DataFrame, value: str, gap: float = 1, out: str = "island") -> DataFrame:
    """Distinct values grouped where neighbours are at most gap apart."""
    w = Window.orderBy(value)
    v = df.select(value).filter(F.col(value).isNotNull()).distinct()
    new = F.coalesce((F.col(value) - F.lag(value).over(w) > gap).cast("int"), F.lit(0))
    return v.withColumn("__new", new).withColumn(out, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
