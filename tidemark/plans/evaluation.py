"""Evaluation queries E1 to E35 and A43, A44, A48."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.columns import corr, dice, interp
from tidemark.operators import metrics as mt
from tidemark.operators.mixture import calibrated_sets
from tidemark.operators.order import lag_autocovariance, quantiles
from tidemark.plans.registry import R, query
from tidemark.plans.roles import customers, fold_values, predictions, scores

_RK = "rank() OVER ({w} ORDER BY {v}) + (count(*) OVER (PARTITION BY {k} {v}) - 1) / 2.0"


def _auc(v="s", y="y", by=""):
    k = f"{by}, " if by else ""
    w = f"PARTITION BY {by}" if by else ""
    g = f"GROUP BY {by}" if by else ""
    sel = f"{by}, " if by else ""
    return f"r AS (SELECT {k}{y} AS y, {_RK.format(w=w, k=k, v=v)} AS rk FROM sc) SELECT {sel}{R('(sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0)', 'auc')}, CAST(sum(y) AS BIGINT) AS n_pos, CAST(count(*) - sum(y) AS BIGINT) AS n_neg FROM r {g}"


@query("E1_auc", f"WITH {_auc()}")
def e1(spark, d):
    return mt.auc(scores(spark, d), "y", "s")


@query("E21_auc_by_segment", f"WITH {_auc(by='lang')}")
def e21(spark, d):
    return mt.auc(scores(spark, d), "y", "s", ["lang"])


_CM = "c AS (SELECT count(*) FILTER (WHERE y = 1 AND s > 1500)::DOUBLE AS tp, count(*) FILTER (WHERE y = 0 AND s > 1500)::DOUBLE AS fp, count(*) FILTER (WHERE y = 1 AND s <= 1500)::DOUBLE AS fn, count(*) FILTER (WHERE y = 0 AND s <= 1500)::DOUBLE AS tn FROM sc)"


@query("E2_confusion", f"WITH {_CM} SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, {R('(tp + tn) / (tp + fp + fn + tn)', 'accuracy')}, {R('tp / (tp + fp)', 'precision')}, {R('tp / (tp + fn)', 'recall')}, {R('2 * tp / (2 * tp + fp + fn)', 'f1')}, {R('(tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))', 'mcc')}, {R('(tp / (tp + fn) + tn / (tn + fp)) / 2', 'balanced_accuracy')} FROM c")
def e2(spark, d):
    return mt.confusion(scores(spark, d).withColumn("c", (F.col("s") > 1500).cast("int")), "y", "c")


def _cap(f):
    return f"SELECT {f} AS f, count(*) AS n, sum(y) AS pos, count(*) FILTER (WHERE k <= q) AS con, count(*) FILTER (WHERE k <= q AND y = 1) AS tp, min(s) FILTER (WHERE k <= q) AS cut FROM (SELECT y, s, row_number() OVER (ORDER BY s DESC, id) AS k, round_even({f} * count(*) OVER (), 0) AS q FROM sc)"


_CAPACITY = "m AS (" + " UNION ALL ".join(_cap(f) for f in (0.1, 0.25, 0.5)) + f") SELECT CAST(f AS DOUBLE) AS fraction, n, CAST(pos AS BIGINT) AS positives, con AS contacted, tp, con - tp AS fp, CAST(pos - tp AS BIGINT) AS fn, CAST(n - pos - con + tp AS BIGINT) AS tn, cut, {R('tp / pos', 'capture')}, {R('tp / con', 'precision')}, {R('pos / n', 'prevalence')}, {R('(tp / con) / (pos / n)', 'lift')} FROM m"


@query("E3_recall_at_capacity", f"WITH {_CAPACITY.split(') SELECT CAST(f')[0]}) SELECT CAST(f AS DOUBLE) AS fraction, {R('tp / pos', 'capture')}, {R('tp / con', 'precision')} FROM m")
def e3(spark, d):
    return mt.at_capacity(scores(spark, d), "y", "s", "id", (0.1, 0.25, 0.5)).select("fraction", "capture", "precision")


@query("E7_campaign", f"WITH {_CAPACITY}")
def e7(spark, d):
    return mt.at_capacity(scores(spark, d), "y", "s", "id", (0.1, 0.25, 0.5))


_CURVE = "k AS (SELECT s, sum(y) AS pos, count(*) - sum(y) AS neg FROM sc GROUP BY 1), c AS (SELECT s, pos, neg, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp FROM k)"


@query("E4_average_precision", f"WITH {_CURVE} SELECT {R('sum(pos * tp / (tp + fp)) / sum(pos)', 'average_precision')} FROM c")
def e4(spark, d):
    return mt.average_precision(scores(spark, d), "y", "s")


@query("E5_roc_points", f"WITH {_CURVE} SELECT {R('fp / (SELECT sum(neg) FROM k)', 'fpr')}, {R('tp / (SELECT sum(pos) FROM k)', 'tpr')} FROM c UNION ALL SELECT 0.0, 0.0")
def e5(spark, d):
    return mt.roc_points(scores(spark, d), "y", "s")


@query("E5_roc_curve", f"WITH {_CURVE}, p AS (SELECT fp * 1.0::DOUBLE / (SELECT sum(neg) FROM k) AS x, tp * 1.0::DOUBLE / (SELECT sum(pos) FROM k) AS t FROM c UNION ALL SELECT 0.0, 0.0), q AS (SELECT x, min(t) AS lo, max(t) AS hi FROM p GROUP BY 1), g AS (SELECT i / 200.0::DOUBLE AS g FROM (SELECT unnest(range(0, 201)) AS i)) SELECT {R('g', 'fpr')}, {R('CASE WHEN b.x IS NULL OR a.x >= g - 1e-12 THEN a.hi ELSE a.hi + (g - a.x) * (b.lo - a.hi) / (b.x - a.x) END', 'tpr')} FROM g JOIN q a ON a.x = (SELECT max(x) FROM q WHERE x <= g + 1e-12) LEFT JOIN q b ON b.x = (SELECT min(x) FROM q WHERE x > g + 1e-12)")
def e5b(spark, d):
    return mt.roc_curve(scores(spark, d), "y", "s")


@query("E6_capture_curve", f"WITH r AS (SELECT row_number() OVER (ORDER BY s DESC, id) AS k, y FROM sc), t AS (SELECT count(*) AS n, sum(y) AS pos FROM sc), g AS (SELECT i / 100.0::DOUBLE AS capacity, CAST(round_even(i / 100.0::DOUBLE * n, 0) AS BIGINT) AS contacted, pos FROM t, (SELECT unnest(range(0, 101)) AS i)) SELECT {R('capacity', 'capacity')}, contacted, CAST(tp AS BIGINT) AS tp, {R('tp / pos', 'capture')}, {R('tp / nullif(contacted, 0)', 'precision')} FROM (SELECT capacity, contacted, pos, coalesce((SELECT sum(y) FROM r WHERE k <= contacted), 0) AS tp FROM g)")
def e6(spark, d):
    return mt.capture_curve(scores(spark, d), "y", "s", "id")


@query("E8_brier_log_loss", f"SELECT {R('avg((p - y) ** 2)', 'brier')}, {R('avg(-(y * ln(least(greatest(p, 1e-6), 1 - 1e-6)) + (1 - y) * ln(1 - least(greatest(p, 1e-6), 1 - 1e-6))))', 'log_loss')} FROM sc")
def e8(spark, d):
    return mt.probability_losses(scores(spark, d), "y", "p")


def _ece(bin_, src="sc"):
    return f"b AS (SELECT {bin_} AS bin, y, p FROM {src}), m AS (SELECT bin, count(*) AS n, avg(y) AS my, avg(p) AS mp FROM b GROUP BY 1) SELECT {R('sum(n * abs(my - mp)) / sum(n)', 'ece')} FROM m"


@query("E9_ece_uniform", f"WITH {_ece('least(greatest(len(list_filter([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0], lambda x: x <= p)) - 1, 0), 9)')}")
def e9(spark, d):
    return mt.ece_uniform(scores(spark, d), "y", "p")


@query("E9_ece_quantile", f"WITH e AS (SELECT list_sort(list_distinct(quantile_cont(p, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS edges FROM sc), {_ece('least(greatest(len(list_filter(edges, lambda x: x <= p)) - 1, 0), len(edges) - 2)', 'sc, e')}")
def e9b(spark, d):
    return mt.ece_quantile(scores(spark, d), "y", "p")


@query("E9_ece_equal_count", f"WITH {_ece('ntile(10) OVER (ORDER BY p, id)')}")
def e9c(spark, d):
    return mt.ece_equal_count(scores(spark, d), "y", "p", "id")


@query("E9_ece_truncated", f"WITH {_ece('least(greatest(floor(p * 10), 0), 9)')}")
def e9d(spark, d):
    return mt.ece_truncated(scores(spark, d), "y", "p")


@query("E10_reliability", f"SELECT CAST(least(greatest(floor(p * 10), 0), 9) AS BIGINT) AS bin, count(*) AS n, {R('avg(p)', 'mean_p')}, {R('avg(y)', 'observed')} FROM sc GROUP BY 1")
def e10(spark, d):
    return mt.reliability(scores(spark, d), "y", "p")


_REG = f"count(*) AS n, {R('sqrt(avg((a - y) ** 2))', 'rmse')}, {R('avg(abs(a - y))', 'mae')}, {R('1 - avg((a - y) ** 2) / var_pop(y)', 'r2')}, {R('avg(abs(a - y) / nullif(abs(y), 0))', 'mape')}, {R('avg(a - y)', 'bias')} FROM pr"


@query("E11_regression_metrics", f"SELECT {_REG}")
def e11(spark, d):
    return mt.regression_metrics(predictions(spark, d), "y", "a")


@query("E21_errors_by_segment", f"SELECT priority, {_REG} GROUP BY 1")
def e21b(spark, d):
    return mt.regression_metrics(predictions(spark, d), "y", "a", ["priority"])


@query("A43_error_by_group", f"SELECT status, count(*) AS n, {R('avg(a - y)', 'bias')}, {R('min(a - y)', 'min_error')}, {R('max(a - y)', 'max_error')}, {R('sqrt(avg((a - y) ** 2))', 'rmse')} FROM pr GROUP BY 1")
def a43(spark, d):
    return mt.error_by_group(predictions(spark, d), "status", "y", "a")


@query("A44_tie_expectation", f"WITH k AS (SELECT s, sum(y) AS pos, count(*) AS n FROM sc GROUP BY 1), c AS (SELECT s, pos, n, sum(n) OVER (ORDER BY s DESC) AS u, sum(pos) OVER (ORDER BY s DESC) - pos AS sure, round_even(0.25 * (SELECT count(*) FROM sc), 0) AS q, (SELECT sum(y) FROM sc)::DOUBLE AS ap FROM k), z AS (SELECT *, q - (u - n) AS room FROM c WHERE u >= q AND u - n < q) SELECT (SELECT count(*) FROM k) AS distinct_scores, s AS cut, n AS tied, CAST(room AS BIGINT) AS room, CAST(pos AS BIGINT) AS tied_positives, CAST(sure AS BIGINT) AS sure_positives, {R('(sure + room * pos / n) / ap', 'expected')}, {R('sqrt(room * (pos / n) * (1 - pos / n) * (n - room) / greatest(n - 1, 1)) / ap', 'deviation')}, {R('(sure + greatest(0, room - (n - pos))) / ap', 'least')}, {R('(sure + least(room, pos)) / ap', 'greatest')} FROM z")
def a44(spark, d):
    return mt.tie_expectation(scores(spark, d), "y", "s", 0.25)


@query("E12_residual_diagnostics", f"WITH e AS (SELECT y - a AS e, (y - a) ** 2 AS e2, a AS p, a * a AS p2 FROM pr), m AS (SELECT count(*) AS n, avg(e) AS mu, var_pop(e) AS v FROM e), g AS (SELECT avg((e - mu) ** 3) / any_value(v) ** 1.5 AS sk, avg((e - mu) ** 4) / any_value(v) ** 2 - 3 AS ku, any_value(n) AS n, corr(e2, p) AS a, corr(e2, p2) AS b, corr(p, p2) AS c FROM e, m) SELECT n, {R('sk', 'skew')}, {R('ku', 'kurtosis')}, {R('n / 6.0 * (sk * sk + ku * ku / 4)', 'jarque_bera')}, {R('n * (a * a + b * b - 2 * a * b * c) / (1 - c * c)', 'white')} FROM g")
def e12(spark, d):
    return mt.residual_moments(predictions(spark, d), "y", "a")


@query("E12_normality", f"WITH e AS (SELECT y - a AS e, (y - a) ** 2 AS e2, a AS p, a * a AS p2 FROM pr), m AS (SELECT count(*) AS n, avg(e) AS mu, var_pop(e) AS v FROM e), g AS (SELECT avg((e - mu) ** 3) / any_value(v) ** 1.5 AS g, avg((e - mu) ** 4) / any_value(v) ** 2 AS k, any_value(n)::DOUBLE AS n, corr(e2, p) AS ca, corr(e2, p2) AS cb, corr(p, p2) AS cc FROM e, m), f AS (SELECT *, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS b2, (k - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS r FROM g), h AS (SELECT *, sqrt(2 * (b2 - 1)) - 1 AS w2, 6 + 8 / r * (2 / r + sqrt(1 + 4 / (r * r))) AS aa FROM f), z AS (SELECT *, asinh(g * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1, (1 - 2 / (9 * aa) - cbrt((1 - 2 / aa) / (1 + x * sqrt(2 / (aa - 4))))) / sqrt(2 / (9 * aa)) AS z2 FROM h) SELECT CAST(n AS BIGINT) AS n, {R('z1 * z1 + z2 * z2', 'k2')}, {R('exp(-(z1 * z1 + z2 * z2) / 2)', 'k2_p')}, {R('exp(-n / 12 * (g * g + (k - 3) ** 2 / 4))', 'jarque_bera_p')}, {R('exp(-n * (ca * ca + cb * cb - 2 * ca * cb * cc) / (1 - cc * cc) / 2)', 'white_p')} FROM z")
def e12b(spark, d):
    return mt.normality(predictions(spark, d), "y", "a")


@query("E13_ljung_box", f"WITH v AS (SELECT id, a - y - (SELECT avg(a - y) FROM pr) AS e FROM pr), l AS (SELECT e, lag(e, 1) OVER w AS e1, lag(e, 2) OVER w AS e2, lag(e, 3) OVER w AS e3 FROM v WINDOW w AS (ORDER BY id)), r AS (SELECT count(*)::DOUBLE AS n, sum(e * e1) / sum(e * e) AS r1, sum(e * e2) / sum(e * e) AS r2, sum(e * e3) / sum(e * e) AS r3 FROM l) SELECT {R('n * (n + 2) * (r1 * r1 / (n - 1) + r2 * r2 / (n - 2) + r3 * r3 / (n - 3))', 'q')} FROM r")
def e13(spark, d):
    p = predictions(spark, d).select("id", (F.col("a") - F.col("y")).alias("e"))
    acf = lag_autocovariance(p, "e", "id", 3).crossJoin(p.agg(F.count("*").cast("double").alias("n")))
    return acf.filter("k >= 1").groupBy("n").agg(F.sum(F.col("acf") * F.col("acf") / (F.col("n") - F.col("k"))).alias("t")).select((F.col("n") * (F.col("n") + 2) * F.col("t")).alias("q"))


@query("E14_score_kinds", "SELECT 'probability' AS kind, count(*) AS n FROM sc WHERE p BETWEEN 0 AND 1 UNION ALL SELECT 'margin', count(*) FROM sc WHERE s > 1")
def e14(spark, d):
    s = scores(spark, d)
    one = lambda c, k: s.filter(c).agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
    return one("p BETWEEN 0 AND 1", "probability").union(one("s > 1", "margin"))


@query("E15_isotonic", f"WITH k AS (SELECT s, sum(y)::DOUBLE AS t, count(*)::DOUBLE AS n FROM sc GROUP BY 1), c AS (SELECT s, t, n, row_number() OVER (ORDER BY s) AS i, sum(t) OVER (ORDER BY s) AS ct, sum(n) OVER (ORDER BY s) AS cn FROM k), pr2 AS (SELECT a.i AS j, b.i AS k, (b.ct - a.ct + a.t) / (b.cn - a.cn + a.n) AS v FROM c a JOIN c b ON b.i >= a.i), lo AS (SELECT j, k, min(v) OVER (PARTITION BY j ORDER BY k DESC) AS v FROM pr2), fit AS (SELECT k, max(v) AS p FROM lo GROUP BY 1) SELECT id, {R('fit.p', 'p')} FROM sc JOIN c ON c.s = sc.s JOIN fit ON fit.k = c.i")
def e15(spark, d):
    s = scores(spark, d)
    knots = mt.isotonic(s, "y", "s")
    arrays = knots.agg(F.array_sort(F.collect_list(F.struct("score", "p"))).alias("k"))  # a row per knot
    c = s.crossJoin(F.broadcast(arrays))
    return c.select("id", interp("s", F.transform("k", lambda x: x["score"]), F.transform("k", lambda x: x["p"])).alias("p"))


_NEWTON = "n0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b)" + "".join(f", q{i} AS (SELECT a, b, p, y, 1 / (1 + exp(-(a * p + b))) AS q FROM sc, n{i}), m{i} AS (SELECT any_value(a) AS a, any_value(b) AS b, sum((y - q) * p) AS gx, sum(y - q) AS g1, sum(q * (1 - q) * p * p) AS xx, sum(q * (1 - q) * p) AS x1, sum(q * (1 - q)) AS w FROM q{i}), n{i + 1} AS (SELECT a + (w * gx - x1 * g1) / (xx * w - x1 * x1) AS a, b + (xx * g1 - x1 * gx) / (xx * w - x1 * x1) AS b FROM m{i})" for i in range(12))


@query("E16_platt", f"WITH {_NEWTON} SELECT {R('a', 'slope')}, {R('b', 'intercept')} FROM n12")
def e16(spark, d):
    return mt.platt(scores(spark, d), "y", "p")


@query("E17_conformal_interval", f"WITH c AS (SELECT abs(y - a) AS r, row_number() OVER (ORDER BY abs(y - a)) AS k, count(*) OVER () AS n FROM pr WHERE id % 2 = 0), q AS (SELECT r AS q FROM c WHERE k = ceil(round((n - 1) * least(1.0, ceil(round((n + 1) * 0.9, 9)) / n), 9)) + 1) SELECT {R('any_value(q)', 'half_width')}, {R('avg(CASE WHEN abs(y - a) <= q THEN 1.0 ELSE 0.0 END)', 'coverage')}, {R('2 * any_value(q)', 'width')} FROM pr, q WHERE id % 2 = 1")
def e17(spark, d):
    p = predictions(spark, d)
    return mt.conformal_interval(p.filter("id % 2 = 0"), p.filter("id % 2 = 1"), "y", "a")


@query("E18_conformal_classes", f"WITH c AS (SELECT CASE WHEN y = 1 THEN 1 - p ELSE p END AS r, row_number() OVER (ORDER BY CASE WHEN y = 1 THEN 1 - p ELSE p END) AS k, count(*) OVER () AS n FROM sc WHERE id % 2 = 0), q AS (SELECT r AS q FROM c WHERE k = ceil(round((n - 1) * least(1.0, ceil(round((n + 1) * 0.9, 9)) / n), 9)) + 1) SELECT {R('any_value(q)', 'threshold')}, {R('avg(CASE WHEN CASE WHEN y = 1 THEN 1 - p <= q ELSE p <= q END THEN 1.0 ELSE 0.0 END)', 'coverage')}, {R('avg(CAST(1 - p <= q AS INT) + CAST(p <= q AS INT))', 'mean_size')}, {R('avg(CASE WHEN 1 - p <= q AND p <= q THEN 1.0 ELSE 0.0 END)', 'both')} FROM sc, q WHERE id % 2 = 1")
def e18(spark, d):
    s = scores(spark, d)
    return mt.conformal_classes(s.filter("id % 2 = 0"), s.filter("id % 2 = 1"), "y", "p")


@query("E19_information_ceiling", f"WITH c AS (SELECT lang, source, avg(y) AS best, count(*) AS n FROM sc GROUP BY 1, 2) SELECT {R('sum(n * best * (1 - best)) / sum(n)', 'brier')}, {R('sqrt(sum(n * best * (1 - best)) / sum(n))', 'rmse')}, {R('sum(n * 2 * best * (1 - best)) / sum(n)', 'mae')} FROM c")
def e19(spark, d):
    c = scores(spark, d).groupBy("lang", "source").agg(F.avg("y").alias("best"), F.count("*").alias("n"))
    v = F.col("best") * (1 - F.col("best"))
    return c.agg((F.sum(F.col("n") * v) / F.sum("n")).alias("brier"), F.sqrt(F.sum(F.col("n") * v) / F.sum("n")).alias("rmse"), (F.sum(F.col("n") * 2 * v) / F.sum("n")).alias("mae"))


@query("E19_ceiling_log_loss", f"WITH c AS (SELECT lang, source, avg(y) AS b, count(*) AS n FROM sc GROUP BY 1, 2) SELECT {R('sum(n * CASE WHEN b > 0 AND b < 1 THEN -(b * ln(b) + (1 - b) * ln(1 - b)) ELSE 0 END) / sum(n)', 'log_loss')} FROM c")
def e19b(spark, d):
    c, b = scores(spark, d).groupBy("lang", "source").agg(F.avg("y").alias("best"), F.count("*").alias("n")), F.col("best")
    loss = F.when((b > 0) & (b < 1), -(b * F.ln(b) + (1 - b) * F.ln(1 - b))).otherwise(0.0)
    return c.agg((F.sum(F.col("n") * loss) / F.sum("n")).alias("log_loss"))


@query("E19_ceiling_auc", "WITH c AS (SELECT lang, source, round(avg(y), 12) AS b, sum(y)::DOUBLE AS p, (count(*) - sum(y))::DOUBLE AS q FROM sc GROUP BY 1, 2) SELECT " + R("sum(a.p * d.q * CASE WHEN a.b > d.b THEN 1.0 WHEN a.b = d.b THEN 0.5 ELSE 0.0 END) / sum(a.p * d.q)", "auc") + " FROM c a, c d")
def e19c(spark, d):
    s = scores(spark, d)
    best = s.groupBy("lang", "source").agg(F.round(F.avg("y"), 12).alias("best"))
    return mt.auc(s.join(best, (s.lang.eqNullSafe(best.lang)) & (s.source.eqNullSafe(best.source))).select("y", "best"), "y", "best").select("auc")


@query("E20_optimal_comparison", f"WITH m AS (SELECT y, p, avg(y) OVER (PARTITION BY lang, source) AS best FROM sc) SELECT {R('avg((p - y) ** 2) - avg((best - y) ** 2)', 'brier_gap')} FROM m")
def e20(spark, d):
    s = scores(spark, d)
    m = s.join(s.groupBy("lang", "source").agg(F.avg("y").alias("best")), ["lang", "source"])
    return m.agg((F.avg((F.col("p") - F.col("y")) ** 2) - F.avg((F.col("best") - F.col("y")) ** 2)).alias("brier_gap"))


@query("E22_examples", "SELECT y, arg_min(id, (p, id)) AS lowest, arg_max(id, (p, id)) AS highest FROM sc GROUP BY 1")
def e22(spark, d):
    return scores(spark, d).groupBy("y").agg(F.min_by("id", F.struct("p", "id")).alias("lowest"), F.max_by("id", F.struct("p", "id")).alias("highest"))


@query("E30_concordance", f"WITH g AS (SELECT priority, avg((a - y) ** 2) FILTER (WHERE id % 2 = 0) AS cv, avg((a - y) ** 2) FILTER (WHERE id % 2 = 1) AS test FROM pr GROUP BY 1) SELECT {R('corr(cv, test)', 'r')}, {R('avg(test - cv)', 'gap')} FROM g")
def e30(spark, d):
    e = (F.col("a") - F.col("y")) ** 2
    g = predictions(spark, d).groupBy("priority").agg(F.avg(F.when(F.col("id") % 2 == 0, e)).alias("cv"), F.avg(F.when(F.col("id") % 2 == 1, e)).alias("test"))
    return g.agg(corr("cv", "test").alias("r"), F.avg(F.col("test") - F.col("cv")).alias("gap"))


@query("E32_index_error", f"SELECT {R('stddev_pop(a - 3 - y)', 'sd')} FROM pr")
def e32(spark, d):
    return predictions(spark, d).agg(F.stddev_pop(F.col("a") - 3 - F.col("y")).alias("sd"))


@query("E33_shifted_mae", f"WITH m AS (SELECT median(a - y) AS m FROM pr WHERE id % 2 = 0) SELECT {R('avg(abs(a - m - y))', 'mae')} FROM pr, m WHERE id % 2 = 1")
def e33(spark, d):
    p = predictions(spark, d)
    m = quantiles(p.filter("id % 2 = 0").select((F.col("a") - F.col("y")).alias("e")), "e", [0.5]).select(F.col("q")[0].alias("m"))
    return p.filter("id % 2 = 1").crossJoin(F.broadcast(m)).agg(F.avg(F.abs(F.col("a") - F.col("m") - F.col("y"))).alias("mae"))


@query("E33_calibrated_sets")
def e33b(spark, d):
    """Sets by density for forecast a: mixture on one half of the other rows, levels from the other half, coverage on every third row."""
    p = predictions(spark, d).select("id", (F.col("y") - F.col("a")).alias("r"))
    rest, half = p.filter("id % 3 <> 0"), dice(F.col("id"), 42) < 0.5
    return calibrated_sets(rest.filter(half), rest.filter(~half), p.filter("id % 3 = 0"), "r", [0.5, 0.8, 0.9, 0.95])


@query("A48_threshold_shift", f"WITH g AS (SELECT unnest([1, 2, 3]) AS seed), h AS (SELECT seed, balance, CAST(CAST('0x' || substr(md5(CAST(customer_id AS VARCHAR) || '#' || seed), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0 < 0.5 AS train FROM cu, g), m AS (SELECT seed, median(balance) AS m FROM h WHERE train GROUP BY 1), t AS (SELECT median(balance) AS t FROM cu) SELECT h.seed, {R('any_value(m)', 'median')}, count(*) FILTER (WHERE (balance > m) <> (balance > t)) AS flipped FROM h JOIN m ON h.seed = m.seed CROSS JOIN t WHERE NOT train GROUP BY 1")
def a48(spark, d):
    c = customers(spark, d)
    unit = F.conv(F.substring(F.md5(F.concat_ws("#", F.col("customer_id").cast("string"), F.col("seed").cast("string")).cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    h = c.withColumn("seed", F.explode(F.array(*map(F.lit, (1, 2, 3))))).withColumn("train", unit < 0.5)
    m = quantiles(h.filter("train"), "balance", [0.5], "q", ["seed"]).select("seed", F.col("q")[0].alias("median"))
    t = quantiles(c, "balance", [0.5]).select(F.col("q")[0].alias("t"))
    j = h.filter("NOT train").join(F.broadcast(m), "seed").crossJoin(F.broadcast(t))
    return j.groupBy("seed", "median").agg(F.count_if((F.col("balance") > F.col("median")) != (F.col("balance") > F.col("t"))).alias("flipped"))


@query("A49_history_quartiles", f"WITH t AS (SELECT treatment, value, row_number() OVER (PARTITION BY treatment ORDER BY block) - 1 AS step, count(*) OVER (PARTITION BY treatment) AS n, quantile_cont(value, 0.75) OVER (PARTITION BY treatment) AS q FROM fo) SELECT treatment, {R('avg(CASE WHEN value >= q THEN 1.0 ELSE 0.0 END) FILTER (WHERE step >= n // 2)', 'late_share')}, {R('median(value) FILTER (WHERE step < n // 2)', 'early_median')}, {R('median(value) FILTER (WHERE step >= n // 2)', 'late_median')} FROM t GROUP BY 1")
def a49(spark, d):
    f = fold_values(spark, d)
    q = f.groupBy("treatment").agg(F.percentile("value", 0.75).alias("q"), F.count("*").alias("n"))
    t = f.withColumn("step", F.row_number().over(Window.partitionBy("treatment").orderBy("block")) - 1).join(F.broadcast(q), "treatment")
    late = F.col("step") >= F.floor(F.col("n") / 2)
    return t.groupBy("treatment").agg(F.avg(F.when(late, (F.col("value") >= F.col("q")).cast("double"))).alias("late_share"), F.percentile(F.when(~late, F.col("value")), 0.5).alias("early_median"), F.percentile(F.when(late, F.col("value")), 0.5).alias("late_median"))
