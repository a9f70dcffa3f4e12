"""Inference queries T1 to T20."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import inference as inf
from tidemark.operators.features import folds
from tidemark.operators.metrics import auc
from tidemark.plans.registry import R, query
from tidemark.plans.roles import fold_values, predictions, scores


def _pl(v, n):
    """SQL for placements of score v under name n."""
    rk = lambda part: f"rank() OVER ({part} ORDER BY {v}) + (count(*) OVER (PARTITION BY {'y, ' if part else ''}{v}) - 1) / 2.0"
    return f"CASE WHEN y = 1 THEN ({rk('')} - ({rk('PARTITION BY y')})) / (count(*) FILTER (WHERE y = 0) OVER ()) ELSE 1 - ({rk('')} - ({rk('PARTITION BY y')})) / (count(*) FILTER (WHERE y = 1) OVER ()) END AS {n}"


def _pairs(spark, d):
    return scores(spark, d).withColumn("s2", F.col("s") % 977)


@query("T1_placements", f"WITH v AS (SELECT id, {_pl('s', 'v')} FROM sc) SELECT id, {R('v', 'v')} FROM v")
def t1a(spark, d):
    return inf.placements(scores(spark, d), "y", "s").select("id", "v")


_COV = "g AS (SELECT avg(va) FILTER (WHERE y = 1) AS auc_a, avg(vb) FILTER (WHERE y = 1) AS auc_b, count(*) FILTER (WHERE y = 1) AS m, count(*) FILTER (WHERE y = 0) AS n, var_samp(va) FILTER (WHERE y = 1) AS pa, var_samp(vb) FILTER (WHERE y = 1) AS pb, covar_samp(va, vb) FILTER (WHERE y = 1) AS pc, var_samp(va) FILTER (WHERE y = 0) AS na, var_samp(vb) FILTER (WHERE y = 0) AS nb, covar_samp(va, vb) FILTER (WHERE y = 0) AS nc FROM v), s AS (SELECT *, pa / m + na / n AS saa, pb / m + nb / n AS sbb, pc / m + nc / n AS sab FROM g)"


@query("T1_delong_parts", f"WITH v AS (SELECT y, {_pl('s', 'va')}, {_pl('(s % 977)', 'vb')} FROM sc), {_COV} SELECT {R('auc_a', 'auc_a')}, {R('auc_b', 'auc_b')}, {R('auc_b - auc_a', 'diff')}, {R('sqrt(saa + sbb - 2 * sab)', 'se')}, {R('(auc_b - auc_a) / sqrt(saa + sbb - 2 * sab)', 'z')}, {R('sab / sqrt(saa * sbb)', 'correlation')} FROM s")
def t1b(spark, d):
    return inf.delong(_pairs(spark, d), "y", "s", "s2").select("auc_a", "auc_b", "diff", "se", "z", "correlation")


@query("T1_delong")
def t1(spark, d):
    return inf.delong(_pairs(spark, d), "y", "s", "s2")


@query("T2_jackknife_auc", f"WITH v AS (SELECT id, y, {_pl('s', 'v')} FROM sc), g AS (SELECT avg(v) FILTER (WHERE y = 1) AS a, count(*) FILTER (WHERE y = 1) AS m, count(*) FILTER (WHERE y = 0) AS n FROM v) SELECT id, {R('CASE WHEN y = 1 THEN (m * a - v) / (m - 1) ELSE (n * a - v) / (n - 1) END', 'auc_without')} FROM v, g")
def t2(spark, d):
    return inf.jackknife_auc(scores(spark, d), "y", "s").select("id", "auc_without")


@query("T3_bca_interval")
def t3(spark, d):
    s = scores(spark, d)
    jack = inf.jackknife_auc(s, "y", "s").select(F.col("auc_without").alias("estimate"))
    return inf.bca(inf.bootstrap_auc(s, "id", "y", "s", inf.N_BOOT), "auc", auc(s, "y", "s").select(F.col("auc").alias("estimate")), jack)


@query("T4_bootstrap_auc")
def t4(spark, d):
    return inf.paired_bootstrap_auc(_pairs(spark, d), "id", "y", "s", "s2", inf.N_BOOT)


@query("T5_bootstrap_regression")
def t5(spark, d):
    return inf.bootstrap_regression(predictions(spark, d), "id", "y", "a", "b", inf.N_BOOT)


_SUMS = "g AS (SELECT count(*) AS n, sum((a - y) ** 2) AS qa, sum((b - y) ** 2) AS qb, sum(abs(b - y)) - sum(abs(a - y)) AS m, sum(y) AS sy, sum(y * y) AS qy FROM pr)"


@query("T5_differences", f"WITH {_SUMS} SELECT {R('sqrt(qb / n) - sqrt(qa / n)', 'rmse')}, {R('m / n', 'mae')}, {R('(qa - qb) / (qy - sy * sy / n)', 'r2')} FROM g")
def t5b(spark, d):
    return inf.regression_differences(predictions(spark, d), "y", "a", "b").select("rmse", "mae", "r2")


@query("T5_jackknife", f"WITH {_SUMS} SELECT id, {R('sqrt((qb - (b - y) ** 2) / (n - 1)) - sqrt((qa - (a - y) ** 2) / (n - 1))', 'rmse')}, {R('(m - abs(b - y) + abs(a - y)) / (n - 1)', 'mae')}, {R('(qa - (a - y) ** 2 - qb + (b - y) ** 2) / (qy - y * y - (sy - y) ** 2 / (n - 1))', 'r2')} FROM pr, g")
def t5c(spark, d):
    return inf.jackknife_regression(predictions(spark, d), "y", "a", "b").select("id", "rmse", "mae", "r2")


@query("T5_bca")
def t5d(spark, d):
    return inf.bca_regression(predictions(spark, d), "id", "y", "a", "b")


_WIDE = "w AS (SELECT block, max(value) FILTER (WHERE treatment = '1-URGENT') AS a, max(value) FILTER (WHERE treatment = '5-LOW') AS b FROM fo GROUP BY 1)"


def _wide(spark, d):
    f = fold_values(spark, d)
    return f.groupBy("block").agg(F.max(F.when(F.col("treatment") == "1-URGENT", F.col("value"))).alias("a"), F.max(F.when(F.col("treatment") == "5-LOW", F.col("value"))).alias("b"))


@query("T6_wilcoxon_statistic", f"WITH {_WIDE}, z AS (SELECT a - b AS d, abs(a - b) AS m FROM w WHERE a - b <> 0), r AS (SELECT d, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0 AS r FROM z) SELECT {R('least(sum(r) FILTER (WHERE d > 0), count(*) * (count(*) + 1) / 2.0 - sum(r) FILTER (WHERE d > 0))', 'statistic')}, (SELECT count(*) FROM w WHERE a - b IS NOT NULL) AS n, (SELECT count(*) FROM w WHERE a > b) AS wins FROM r")
def t6a(spark, d):
    return inf.wilcoxon(_wide(spark, d), "a", "b").select("statistic", "n", "wins")


@query("T6_wilcoxon")
def t6(spark, d):
    return inf.wilcoxon(_wide(spark, d), "a", "b")


@query("T7_corrected_t_statistic", f"WITH {_WIDE} SELECT {R('avg(a - b) / sqrt((1.0 / count(a - b) + 0.25) * var_samp(a - b))', 't')}, count(a - b) - 1 AS df, {R('avg(a - b)', 'mean')}, {R('stddev_samp(a - b)', 'sd')} FROM w")
def t7a(spark, d):
    return inf.corrected_t(_wide(spark, d), "a", "b").select("t", "df", "mean", "sd")


@query("T7_corrected_t")
def t7(spark, d):
    return inf.corrected_t(_wide(spark, d), "a", "b")


@query("T8_bayes_rope")
def t8(spark, d):
    return inf.bayes_correlated_t(_wide(spark, d), "a", "b", rope=2000.0)


@query("T9_permutation")
def t9(spark, d):
    p = predictions(spark, d)
    return inf.permutation_test(p.select("id", F.abs(F.col("a") - F.col("y")).alias("la"), F.abs(F.col("b") - F.col("y")).alias("lb")), "id", "la", "lb", inf.N_PERM)


@query("T10_mcnemar_counts", "SELECT count(*) FILTER (WHERE (s > 1500) = (y = 1) AND (toxic = 1) <> (y = 1)) AS only_a, count(*) FILTER (WHERE (s > 1500) <> (y = 1) AND (toxic = 1) = (y = 1)) AS only_b, count(*) AS n FROM sc")
def t10a(spark, d):
    return t10(spark, d).select("only_a", "only_b", "n")


@query("T10_mcnemar")
def t10(spark, d):
    return inf.mcnemar(scores(spark, d).withColumn("c", (F.col("s") > 1500).cast("long")), "y", "c", "toxic")


_LOSS = "l AS (SELECT id, (a - y) ** 2 - (b - y) ** 2 AS d FROM pr)"


def _losses(spark, d):
    return predictions(spark, d).select("id", ((F.col("a") - F.col("y")) ** 2).alias("la"), ((F.col("b") - F.col("y")) ** 2).alias("lb"), "y")


@query("T11_diebold_mariano_statistic", f"WITH {_LOSS} SELECT count(*) AS n, {R('avg(d)', 'mean')}, {R('avg(d) / sqrt(var_pop(d) / count(*))', 'dm')}, {R('avg(d) / sqrt(var_pop(d) / count(*)) * sqrt((count(*) - 1.0) / count(*))', 'statistic')} FROM l")
def t11a(spark, d):
    return inf.diebold_mariano(_losses(spark, d), "id", "la", "lb").select("n", "mean", "dm", "statistic")


@query("T11_diebold_mariano")
def t11(spark, d):
    return inf.diebold_mariano(_losses(spark, d), "id", "la", "lb", h=3)


@query("T12_stationary_bootstrap")
def t12(spark, d):
    return inf.stationary_bootstrap(_losses(spark, d).withColumn("d", F.col("la") - F.col("lb")), "id", "d", n=inf.N_BOOT)


@query("T12_optimal_block")
def t12b(spark, d):
    block = inf.optimal_block(_losses(spark, d).withColumn("d", F.col("la") - F.col("lb")), "id", "d")
    return spark.createDataFrame([(block,)], "block double")


@query("T13_cliffs_delta", f"WITH r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM sc), g AS (SELECT (sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS a FROM r) SELECT {R('2 * a - 1', 'delta')}, {R('a', 'a12')}, CASE WHEN abs(2 * a - 1) < 0.147 THEN 'negligible' WHEN abs(2 * a - 1) < 0.33 THEN 'small' WHEN abs(2 * a - 1) < 0.474 THEN 'medium' ELSE 'large' END AS magnitude FROM g")
def t13(spark, d):
    return inf.cliffs_delta(scores(spark, d), "y", "s")


@query("T13_cohens_d", f"WITH g AS (SELECT avg(s) FILTER (WHERE y = 1) - avg(s) FILTER (WHERE y = 0) AS m, sqrt(((count(*) FILTER (WHERE y = 1) - 1) * var_samp(s) FILTER (WHERE y = 1) + (count(*) FILTER (WHERE y = 0) - 1) * var_samp(s) FILTER (WHERE y = 0)) / (count(*) - 2)) AS sp FROM sc) SELECT {R('m / sp', 'd')}, CASE WHEN abs(m / sp) < 0.2 THEN 'negligible' WHEN abs(m / sp) < 0.5 THEN 'small' WHEN abs(m / sp) < 0.8 THEN 'medium' ELSE 'large' END AS magnitude FROM g")
def t13b(spark, d):
    return inf.cohens_d(scores(spark, d), "y", "s")


@query("T13_cohens_dz", f"WITH {_WIDE}, g AS (SELECT avg(a - b) / stddev_samp(a - b) AS d FROM w) SELECT {R('d', 'd')}, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS magnitude FROM g")
def t13c(spark, d):
    return inf.cohens_dz(_wide(spark, d), "a", "b")


_P = "p AS (SELECT nation AS k, abs(avg(balance) - 5000) / 20000 AS p FROM cu GROUP BY 1)"


def _ps(spark, d):
    from tidemark.plans.roles import customers

    return customers(spark, d).groupBy(F.col("nation").alias("k")).agg((F.abs(F.avg("balance") - 5000) / 20000).alias("p"))


@query("T14_holm", f"WITH {_P}, i AS (SELECT k, p, row_number() OVER (ORDER BY p, k) AS i, count(*) OVER () AS m FROM p) SELECT k, {R('p', 'p')}, {R('least(1.0, max((m - i + 1) * p) OVER (ORDER BY p, k))', 'p_adjusted')} FROM i")
def t14(spark, d):
    return inf.adjust_p(_ps(spark, d), "p", "k")


@query("T14_benjamini_hochberg", f"WITH {_P}, i AS (SELECT k, p, row_number() OVER (ORDER BY p, k) AS i, count(*) OVER () AS m FROM p) SELECT k, {R('p', 'p')}, {R('least(1.0, min(m * p / i) OVER (ORDER BY p DESC, k DESC))', 'p_adjusted')} FROM i")
def t14b(spark, d):
    return inf.adjust_p(_ps(spark, d), "p", "k", "bh")


@query("T14_bonferroni", f"WITH {_P} SELECT k, {R('p', 'p')}, {R('least(1.0, p * count(*) OVER ())', 'p_adjusted')} FROM p")
def t14c(spark, d):
    return inf.adjust_p(_ps(spark, d), "p", "k", "bonferroni")


_FR = "cb AS (SELECT block FROM fo GROUP BY 1 HAVING count(*) = 5), r AS (SELECT fo.block, treatment, value, rank() OVER (PARTITION BY fo.block ORDER BY value DESC) + (count(*) OVER (PARTITION BY fo.block, value) - 1) / 2.0 AS rk FROM fo JOIN cb ON fo.block = cb.block)"


@query("T15_mean_ranks", f"WITH {_FR} SELECT treatment, {R('avg(rk)', 'mean_rank')}, count(*) AS n_blocks FROM r GROUP BY 1")
def t15a(spark, d):
    return inf.mean_ranks(fold_values(spark, d))


_CHI = "q AS (SELECT treatment, sum(rk) AS s, count(*) AS n FROM r GROUP BY 1), t AS (SELECT sum(c * c * c - c) AS t FROM (SELECT count(*) AS c FROM r GROUP BY block, value)), c AS (SELECT max(n)::DOUBLE AS n, count(*)::DOUBLE AS k, sum(s * s) AS ss FROM q), x AS (SELECT n, k, (12 / (n * k * (k + 1)) * ss - 3 * n * (k + 1)) / (1 - t / (n * k * (k * k - 1))) AS chi2, 12 / (n * k * (k + 1)) * ss - 3 * n * (k + 1) AS plain FROM c, t)"


@query("T15_friedman_statistic", f"WITH {_FR}, {_CHI} SELECT CAST(n AS BIGINT) AS n_blocks, CAST(k AS BIGINT) AS k, {R('chi2', 'chi2')}, {R('(n - 1) * chi2 / (n * (k - 1) - chi2)', 'F')} FROM x")
def t15b(spark, d):
    return inf.friedman(fold_values(spark, d)).select("n_blocks", "k", "chi2", "F")


@query("T15_friedman_plain", f"WITH {_FR}, {_CHI} SELECT {R('plain', 'chi2')} FROM x")
def t15c(spark, d):
    return inf.friedman(fold_values(spark, d), tie_corrected=False).select("chi2")


@query("T15_friedman")
def t15(spark, d):
    return inf.friedman(fold_values(spark, d))


@query("T15_nemenyi")
def t15d(spark, d):
    return inf.nemenyi(fold_values(spark, d))


@query("T16_model_confidence_set")
def t16(spark, d):
    p = predictions(spark, d)
    return inf.model_confidence_set(p.select("id", ((F.col("a") - F.col("y")) ** 2).alias("a"), ((F.col("b") - F.col("y")) ** 2).alias("b"), ((F.col("y") * 0.98 - F.col("y")) ** 2).alias("c")), "id", ["a", "b", "c"], block=2.0, n=inf.N_MCS)


@query("T17_giacomini_white")
def t17(spark, d):
    return inf.giacomini_white(_losses(spark, d), "la", "lb", ["y"])


@query("T17_giacomini_white_constant", f"WITH {_LOSS} SELECT {R('count(*) * avg(d) ** 2 / avg(d * d)', 'statistic')}, CAST(1 AS BIGINT) AS df, {R('avg(d)', 'mean')} FROM l")
def t17b(spark, d):
    return inf.giacomini_white(_losses(spark, d), "la", "lb", []).select("statistic", "df", "mean")


@query("T18_interval_table")
def t18(spark, d):
    s = _pairs(spark, d)
    one = lambda c: inf.delong(s, "y", c).select(F.lit(c).alias("model"), "*")
    return one("s").unionByName(one("s2")).unionByName(one("p"))


@query("T19_hypothesis_battery")
def t19(spark, d):
    s = _pairs(spark, d).withColumn("s3", F.col("s") % 97)
    return inf.battery(folds(s, "id", 10), "id", "y", "p", ["s2", "s3"])


@query("T19_battery_regression")
def t19b(spark, d):
    p = predictions(spark, d).withColumn("c", F.col("y") * 0.98)
    return inf.battery_regression(folds(p, "id", 10), "id", "y", "a", ["b", "c"])


@query("T20_tie_break_mcnemar")
def t20(spark, d):
    return inf.tie_break_mcnemar(scores(spark, d), "y", "s", "toxic", 0.25, inf.N_BOOT)
