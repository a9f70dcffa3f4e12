"""Evaluation of scores and forecasts.

Everything that depends on an order works on the table of distinct scores (score, pos, neg), which map-side
aggregation makes, and on running totals over it; no row-level global sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import bin_right, branch, clip, corr, half_even, ratio
from tidemark.operators.order import running_totals, top_fraction
from tidemark.operators.profile import quantile_edges


def score_table(df: DataFrame, y: str, s: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct scores with their positives and negatives."""
    return df.filter(F.col(y).isNotNull() & F.col(s).isNotNull()).groupBy(*by, F.col(s).cast("double").alias("score")).agg(F.sum((F.col(y) == 1).cast("long")).alias("pos"), F.sum((F.col(y) == 0).cast("long")).alias("neg"))


def auc(df: DataFrame, y: str, s: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve, ties counting half; null with one class only."""
    t = running_totals(score_table(df, y, s, by), "score", {"below": "neg"}, by)
    wins = F.col("pos") * (F.col("below") - F.col("neg") + F.col("neg") / F.lit(2.0))
    return t.groupBy(*by).agg(F.try_divide(F.sum(wins), (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def average_precision(df: DataFrame, y: str, s: str) -> DataFrame:
    """One row: sum over distinct scores of recall gained times precision there."""
    t = running_totals(score_table(df, y, s), "score", {"tp": "pos", "fp": "neg"}, descending=True)
    return t.agg(F.try_divide(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.sum("pos").cast("double")).alias("average_precision"))


def roc_points(df: DataFrame, y: str, s: str) -> DataFrame:
    """fpr, tpr at each distinct score and the origin."""
    t = running_totals(score_table(df, y, s), "score", {"tp": "pos", "fp": "neg"}, descending=True)
    n = t.agg(F.greatest(F.sum("pos"), F.lit(1)).alias("p"), F.greatest(F.sum("neg"), F.lit(1)).alias("n"))
    pts = t.crossJoin(F.broadcast(n)).select(ratio("fp", "n").alias("fpr"), ratio("tp", "p").alias("tpr"))
    return pts.union(df.sparkSession.sql("SELECT 0.0D AS fpr, 0.0D AS tpr"))


def roc_curve(df: DataFrame, y: str, s: str, points: int = 201) -> DataFrame:
    """The ROC curve interpolated on an even grid of fpr."""
    k = points - 1
    pts = roc_points(df, y, s).groupBy("fpr").agg(F.min("tpr").alias("lo"), F.max("tpr").alias("hi"))
    # of the points between two grid values only the outer ones matter, so at most 2 * points rows are ordered
    cells = pts.groupBy(F.ceil(F.col("fpr") * k - F.lit(1e-9)).cast("int").alias("cell")).agg(F.min(F.struct("fpr", "lo", "hi")).alias("a"), F.max(F.struct("fpr", "lo", "hi")).alias("b"))
    order = Window.orderBy("cell")
    seg = cells.select("cell", F.col("b.fpr").alias("fpr"), F.col("b.hi").alias("hi"), F.lead("a.fpr").over(order).alias("next"), F.lead("a.lo").over(order).alias("next_lo"), F.lead("cell").over(order).alias("next_cell"))
    grid = seg.withColumn("g", F.explode(F.sequence(F.col("cell"), F.coalesce(F.col("next_cell") - 1, F.lit(k))))).withColumn("x", F.col("g") / F.lit(float(k)))
    slope = F.try_divide(F.col("next_lo") - F.col("hi"), F.col("next") - F.col("fpr"))
    return grid.select(F.col("x").alias("fpr"), (F.col("hi") + F.coalesce((F.col("x") - F.col("fpr")) * slope, F.lit(0.0))).alias("tpr"))


def capture_curve(df: DataFrame, y: str, s: str, key: str, points: int = 101) -> DataFrame:
    """capacity, contacted, tp, capture, precision at even capacities; ties by key.

    Capacities fall into the score ranges of the running totals; only rows tied at a capacity's cut score are ordered.
    """
    t = running_totals(score_table(df, y, s).withColumn("n", F.col("pos") + F.col("neg")), "score", {"upto": "n", "tp_upto": "pos"}, descending=True)
    total = t.agg(F.sum("n").alias("total"), F.greatest(F.sum("pos"), F.lit(1)).alias("all_pos"))
    caps = total.select("total", "all_pos", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("g")).select("total", "all_pos", (F.col("g") / F.lit(float(points - 1))).alias("capacity"))
    caps = caps.withColumn("contacted", half_even(F.col("capacity") * F.col("total")).cast("long"))
    # the points capacities are what is broadcast, never the scores
    cut = t.join(F.broadcast(caps.filter("contacted > 0")), (F.col("upto") >= F.col("contacted")) & (F.col("upto") - F.col("n") < F.col("contacted")))
    cut = cut.select("capacity", "contacted", "score", (F.col("tp_upto") - F.col("pos")).alias("sure"), (F.col("contacted") - (F.col("upto") - F.col("n"))).alias("room"))
    edges = cut.select(F.col("score").alias("__s")).distinct()
    tied = df.filter(F.col(y).isNotNull() & F.col(s).isNotNull()).select(F.col(s).cast("double").alias("score"), F.col(y).alias("y"), key).join(F.broadcast(edges), F.col("score") == F.col("__s"), "left_semi")
    w = Window.partitionBy("score").orderBy(key)
    tied = tied.select("score", F.row_number().over(w).alias("room"), F.sum((F.col("y") == 1).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("won"))
    got = cut.join(tied, ["score", "room"]).select("capacity", (F.col("sure") + F.col("won")).alias("tp"))
    out = caps.join(got, "capacity", "left").withColumn("tp", F.coalesce("tp", F.lit(0)))
    return out.select("capacity", "contacted", "tp", ratio("tp", "all_pos").alias("capture"), ratio("tp", "contacted").alias("precision"))


def confusion(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts, accuracy, precision, recall, f1 (0 where undefined), MCC, balanced accuracy."""
    one = lambda a, b: F.count_if((F.col(pred) == a) & (F.col(y) == b))
    g = df.groupBy(*by).agg(one(1, 1).alias("tp"), one(1, 0).alias("fp"), one(0, 1).alias("fn"), one(0, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    recall, spec = zero(F.try_divide(tp, tp + fn)), zero(F.try_divide(tn, tn + fp))
    return g.select(
        *by, "tp", "fp", "fn", "tn",
        F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        zero(F.try_divide(tp, tp + fp)).alias("precision"),
        recall.alias("recall"),
        zero(F.try_divide(2 * tp, 2 * tp + fp + fn)).alias("f1"),
        zero(F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))).alias("mcc"),
        ((recall + spec) / 2).alias("balanced_accuracy"),
    )


def at_capacity(df: DataFrame, y: str, s: str, key: str, fractions: Sequence[float] = (0.25,), seed: int | None = None) -> DataFrame:
    """fraction, n, positives, contacted, tp, fp, fn, tn, capture, precision, prevalence, lift, cut score."""
    out = None
    for f in fractions:
        m = top_fraction(df.filter(F.col(y).isNotNull() & F.col(s).isNotNull()), s, f, key, seed, "__c")
        c, p = F.col("__c") == 1, F.col(y) == 1
        g = m.agg(F.count("*").alias("n"), F.count_if(p).alias("positives"), F.count_if(c).alias("contacted"), F.count_if(c & p).alias("tp"), F.count_if(c & ~p).alias("fp"), F.count_if(~c & p).alias("fn"), F.count_if(~c & ~p).alias("tn"), F.min(F.when(c, F.col(s).cast("double"))).alias("cut"))
        g = g.select(F.lit(float(f)).alias("fraction"), "*").withColumns({"capture": ratio("tp", "positives"), "precision": ratio("tp", "contacted"), "prevalence": ratio("positives", "n")})
        g = g.withColumn("lift", F.when(F.col("positives") > 0, F.try_divide("precision", "prevalence")))
        out = g if out is None else out.unionByName(g)
    return out


def tie_expectation(df: DataFrame, y: str, s: str, fraction: float) -> DataFrame:
    """One row: what random order among rows tied at the cut gives: mean, deviation, least and greatest capture."""
    t = running_totals(score_table(df, y, s).withColumn("n", F.col("pos") + F.col("neg")), "score", {"upto": "n", "tp_upto": "pos"}, descending=True)
    total = t.agg(F.sum("n").alias("total"), F.sum("pos").alias("all_pos"), F.count("*").alias("distinct_scores")).withColumn("quota", half_even(F.col("total") * F.lit(fraction)).cast("long"))
    c = t.crossJoin(F.broadcast(total)).filter("upto >= quota AND upto - n < quota")
    room, sure = F.col("quota") - (F.col("upto") - F.col("n")), F.col("tp_upto") - F.col("pos")
    rate = F.col("pos") / F.col("n").cast("double")
    var = room * rate * (1 - rate) * (F.col("n") - room) / F.greatest(F.col("n") - 1, F.lit(1))
    p = F.col("all_pos").cast("double")
    return c.select(
        "distinct_scores", F.col("score").alias("cut"), F.col("n").alias("tied"), room.alias("room"), F.col("pos").alias("tied_positives"), sure.alias("sure_positives"),
        F.try_divide(sure + room * rate, p).alias("expected"), F.try_divide(F.sqrt(var), p).alias("deviation"),
        F.try_divide((sure + F.greatest(F.lit(0), room - (F.col("n") - F.col("pos")))).cast("double"), p).alias("least"),
        F.try_divide((sure + F.least(room, F.col("pos"))).cast("double"), p).alias("greatest"),
    )


def probability_losses(df: DataFrame, y: str, p: str, eps: float = 1e-6, by: Sequence[str] = ()) -> DataFrame:
    """Brier score and log-loss (probabilities clipped to eps)."""
    q = clip(p, eps, 1 - eps)
    yy = F.col(y).cast("double")
    return df.groupBy(*by).agg(F.avg((F.col(p) - yy) * (F.col(p) - yy)).alias("brier"), F.avg(-(yy * F.ln(q) + (1 - yy) * F.ln(F.lit(1.0) - q))).alias("log_loss"))


def _weighted_gap(df: DataFrame, bin_: Column, y: str, p: str) -> DataFrame:
    g = df.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(y).cast("double")).alias("my"), F.avg(p).alias("mp"))
    return g.agg(F.try_divide(F.sum(F.col("n") * F.abs(F.col("my") - F.col("mp"))), F.sum("n").cast("double")).alias("ece"))


def ece_uniform(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """One row: calibration error over equal-width bins [lo, hi), the last closed."""
    edges = F.array(*(F.lit(k / bins) for k in range(bins + 1)))
    return _weighted_gap(df, F.least(F.greatest(bin_right(p, edges) - 1, F.lit(0)), F.lit(bins - 1)), y, p)


def ece_truncated(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """One row: the same over floor(p * bins)."""
    return _weighted_gap(df, F.least(F.greatest((F.col(p) * bins).cast("int"), F.lit(0)), F.lit(bins - 1)), y, p)


def ece_quantile(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """One row: the same between distinct quantile edges."""
    j = df.crossJoin(F.broadcast(quantile_edges(df, p, bins)))
    return _weighted_gap(j, F.least(F.greatest(bin_right(p, F.col("edges")) - 1, F.lit(0)), F.size("edges") - 2), y, p)


def ece_equal_count(df: DataFrame, y: str, p: str, key: str, bins: int = 10) -> DataFrame:
    """One row: the same over ordered chunks whose sizes differ by at most one, larger first.

    A place comes from the running count of its probability plus the place among equal ones, so no global sort.
    """
    rows = df.filter(F.col(p).isNotNull())
    counts = rows.groupBy(p).agg(F.count("*").alias("__c"))
    start = running_totals(counts, p, {"__u": "__c"}).select(p, (F.col("__u") - F.col("__c")).alias("__b"))
    n = counts.agg(F.sum("__c").alias("__n"))
    j = rows.join(start, p).crossJoin(F.broadcast(n))
    place = F.col("__b") + F.row_number().over(Window.partitionBy(p).orderBy(key)) - 1
    size, extra = F.floor(F.col("__n") / bins), F.col("__n") % bins
    edge = extra * (size + 1)
    chunk = F.when(F.col("__place") < edge, F.floor(F.col("__place") / (size + 1))).otherwise(extra + F.floor(F.try_divide(F.col("__place") - edge, size)))
    return _weighted_gap(j.withColumn("__place", place), chunk, y, p)


def reliability(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """bin, n, mean probability, observed rate."""
    b = F.least(F.greatest((F.col(p) * bins).cast("int"), F.lit(0)), F.lit(bins - 1))
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("observed"))


def regression_metrics(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """n, rmse, mae, r2, mape, bias, from sums of one pass."""
    e = F.col(pred) - F.col(y)
    g = df.groupBy(*by).agg(F.count(e).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("var"), F.avg(F.try_divide(F.abs(e), F.abs(y))).alias("mape"), F.avg(e).alias("bias"))
    return g.select(*by, "n", F.sqrt("mse").alias("rmse"), "mae", (F.lit(1.0) - F.try_divide("mse", "var")).alias("r2"), "mape", "bias")


def error_by_group(df: DataFrame, group: str, y: str, pred: str) -> DataFrame:
    """group, n, bias, least and greatest error, rmse."""
    e = F.col(pred) - F.col(y)
    return df.groupBy(group).agg(F.count("*").alias("n"), F.avg(e).alias("bias"), F.min(e).alias("min_error"), F.max(e).alias("max_error"), F.sqrt(F.avg(e * e)).alias("rmse"))


def kth_smallest(df: DataFrame, value: str, level: Column) -> DataFrame:
    """One row: the order statistic that the 'higher' quantile rule picks, place ceil((n - 1) * q) + 1, by running counts."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("__c"))
    n = counts.agg(F.sum("__c").alias("n"))
    t = running_totals(counts, value, {"__u": "__c"}).crossJoin(F.broadcast(n))
    place = F.ceil(F.round((F.col("n") - 1) * level, 9)) + 1
    return t.filter(F.col("__u") >= place).agg(F.min(value).alias("q"))


def conformal_level(coverage: float) -> Column:
    """min(1, ceil((n + 1) * coverage) / n) on a table that has n."""
    return F.least(F.lit(1.0), F.ceil(F.round((F.col("n") + 1) * F.lit(coverage), 9)) / F.col("n"))


def conformal_interval(calibration: DataFrame, test: DataFrame, y: str, pred: str, coverage: float = 0.9) -> DataFrame:
    """One row: half width from absolute calibration residuals, coverage and width on test rows."""
    r = calibration.select(F.abs(F.col(y) - F.col(pred)).alias("r"))
    q = kth_smallest(r, "r", conformal_level(coverage))
    return test.crossJoin(F.broadcast(q)).groupBy("q").agg(F.avg((F.abs(F.col(y) - F.col(pred)) <= F.col("q")).cast("double")).alias("coverage")).select(F.col("q").alias("half_width"), "coverage", (2 * F.col("q")).alias("width"))


def conformal_classes(calibration: DataFrame, test: DataFrame, y: str, p: str, coverage: float = 0.9) -> DataFrame:
    """One row: threshold on 1 - p(true class), coverage, mean set size, share of two-class sets."""
    q = kth_smallest(calibration.select(F.when(F.col(y) == 1, F.lit(1.0) - F.col(p)).otherwise(F.col(p)).alias("r")), "r", conformal_level(coverage))
    one, zero = F.lit(1.0) - F.col(p) <= F.col("q"), F.col(p) <= F.col("q")
    covered = F.when(F.col(y) == 1, one).otherwise(zero)
    return test.crossJoin(F.broadcast(q)).groupBy("q").agg(F.avg(covered.cast("double")).alias("coverage"), F.avg(one.cast("int") + zero.cast("int")).alias("mean_size"), F.avg((one & zero).cast("double")).alias("both")).withColumnRenamed("q", "threshold")


def isotonic(df: DataFrame, y: str, s: str) -> DataFrame:
    """score, p: the knots of the isotonic regression of y on s."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    rows = VectorAssembler(inputCols=[s], outputCol="__v").transform(df.select(F.col(s).cast("double").alias(s), F.col(y).cast("double").alias("label")))
    model = IsotonicRegression(featuresCol="__v").fit(rows)
    knots = list(zip(map(float, model.boundaries.toArray()), map(float, model.predictions.toArray()), strict=True))
    return df.sparkSession.createDataFrame(knots, "score double, p double")


def platt(df: DataFrame, y: str, s: str, rounds: int = 30) -> DataFrame:
    """One row: slope and intercept of the logistic recalibration of s, by Newton steps of one aggregation each.

    Null pairs are left out.  It stops at a step below 1e-12, and where classes are apart after ``rounds``.
    """
    rows, a, b = df.filter(F.col(y).isNotNull() & F.col(s).isNotNull()).select(F.col(s).cast("double").alias("x"), F.col(y).cast("double").alias("t")), 0.0, 0.0
    for _ in range(rounds):
        q = 1.0 / (1.0 + F.exp(-(a * F.col("x") + b)))
        w = q * (1 - q)
        g = rows.agg(F.sum((F.col("t") - q) * F.col("x")).alias("gx"), F.sum(F.col("t") - q).alias("g1"), F.sum(w * F.col("x") * F.col("x")).alias("xx"), F.sum(w * F.col("x")).alias("x1"), F.sum(w).alias("w")).head()
        det = (g.xx or 0) * (g.w or 0) - (g.x1 or 0) ** 2
        if not det > 0:
            break
        da, db = (g.w * g.gx - g.x1 * g.g1) / det, (g.xx * g.g1 - g.x1 * g.gx) / det
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-12:
            break
    return df.sparkSession.createDataFrame([(a, b)], "slope double, intercept double")


def residual_moments(df: DataFrame, y: str, pred: str) -> DataFrame:
    """One row: n, skew (biased), excess kurtosis, Jarque-Bera statistic, and White's n * R2 of e2 on pred and pred2."""
    e = F.col(y) - F.col(pred)
    x = df.select(e.alias("e"), F.col(pred).alias("p"))
    x = x.withColumns({"e2": F.col("e") * F.col("e"), "p2": F.col("p") * F.col("p")})
    g = x.agg(F.count("e").alias("n"), F.skewness("e").alias("skew"), F.kurtosis("e").alias("kurtosis"), corr("e2", "p").alias("a"), corr("e2", "p2").alias("b"), corr("p", "p2").alias("c"))
    r2 = F.try_divide(F.col("a") * F.col("a") + F.col("b") * F.col("b") - 2 * F.col("a") * F.col("b") * F.col("c"), F.lit(1.0) - F.col("c") * F.col("c"))
    jb = F.col("n") / 6.0 * (F.col("skew") * F.col("skew") + F.col("kurtosis") * F.col("kurtosis") / 4.0)
    return g.select("n", "skew", "kurtosis", jb.alias("jarque_bera"), (F.col("n") * r2).alias("white"))


def normality(df: DataFrame, y: str, pred: str) -> DataFrame:
    """One row: D'Agostino's K2 of the residuals (skewness and kurtosis turned into normal scores) and the p values of K2, Jarque-Bera and White.

    All three are chi-squared with two degrees of freedom, whose tail is exp(-x / 2).  Null below 20 rows.
    """
    m = residual_moments(df, y, pred)
    n, g, k = F.col("n").cast("double"), F.col("skew"), F.col("kurtosis") + 3
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (b2 - 1)) - 1
    u = g * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2))) / F.sqrt(2 / (w2 - 1))
    z1 = F.asinh(u) / F.sqrt(0.5 * F.ln(w2))
    x = (k - 3 * (n - 1) / (n + 1)) / F.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)))
    r = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / r * (2 / r + F.sqrt(1 + 4 / (r * r)))
    z2 = (1 - 2 / (9 * a) - F.cbrt((1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4))))) / F.sqrt(2 / (9 * a))
    k2 = F.when(F.col("n") >= 20, z1 * z1 + z2 * z2)
    p = lambda c: F.exp(-c / 2)
    return m.withColumn("k2", k2).select("n", "k2", p(F.col("k2")).alias("k2_p"), p(F.col("jarque_bera")).alias("jarque_bera_p"), p(F.col("white")).alias("white_p"))


def ljung_box(acf: DataFrame, n: int | Column, h: int) -> DataFrame:
    """One row: Q of lags 1..h from a table k, acf."""
    n = F.lit(n) if isinstance(n, int) else n
    return acf.filter(F.col("k").between(1, h)).agg((n * (n + 2) * F.sum(F.col("acf") * F.col("acf") / (n - F.col("k")))).alias("q"))


def outcome(y: str, pred: str) -> Column:
    """TP, FP, FN, TN of each row."""
    return branch(((F.col(y) == 1) & (F.col(pred) == 1), "TP"), ((F.col(y) == 0) & (F.col(pred) == 1), "FP"), ((F.col(y) == 1) & (F.col(pred) == 0), "FN"), ((F.col(y) == 0) & (F.col(pred) == 0), "TN"))


def verdict(p: str, diff: str, alpha: float = 0.05) -> Column:
    """wins, loses or ties by adjusted p and sign of the difference."""
    return F.when(F.col(p) >= alpha, "ties").when(F.col(diff) > 0, "wins").when(F.col(diff) < 0, "loses").otherwise("ties")
