"""Profile queries: A8 to A35, A40, A45 to A53 and reshapes that belong to them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.columns import corr
from tidemark.operators import profile as pf
from tidemark.plans.registry import R, query
from tidemark.plans.roles import TYPES, customers, fold_values, predictions, scores, table, transactions

_GAPPY = "g AS (SELECT customer_id, CASE WHEN nation % 3 = 0 THEN NULL ELSE balance END AS balance, CASE WHEN nation % 4 = 0 THEN NULL ELSE segment END AS segment, city FROM cu)"


def _gappy(spark, d):
    return customers(spark, d).select("customer_id", F.when(F.col("nation") % 3 != 0, F.col("balance")).alias("balance"), F.when(F.col("nation") % 4 != 0, F.col("segment")).alias("segment"), "city")


@query("A8_missing", f"WITH {_GAPPY}, m AS (SELECT 'balance' AS variable, count(*) - count(balance) AS missing, count(*) AS n FROM g UNION ALL SELECT 'segment', count(*) - count(segment), count(*) FROM g UNION ALL SELECT 'city', count(*) - count(city), count(*) FROM g) SELECT variable, missing, {R('missing * 100.0 / n', 'pct')} FROM m WHERE missing > 0")
def a8(spark, d):
    return pf.missing(_gappy(spark, d))


@query("P3_missing_flags", f"WITH {_GAPPY} SELECT customer_id, CAST(balance IS NOT NULL AS BIGINT) AS has_balance, CAST(segment IS NOT NULL AS BIGINT) AS has_segment FROM g")
def p3(spark, d):
    return pf.missing_flags(_gappy(spark, d), ["balance", "segment"]).select("customer_id", "has_balance", "has_segment")


@query("A9_staircase", f"WITH s AS (SELECT nation, count(balance) AS n, avg(balance) AS mean, stddev_samp(balance) AS sd FROM cu GROUP BY 1) SELECT nation, n, {R('mean', 'mean')}, {R('sd', 'sd')}, {R('mean - lag(mean) OVER (ORDER BY nation)', 'step')} FROM s")
def a9(spark, d):
    return pf.staircase(customers(spark, d), "nation", "balance")


@query("A10_eta_squared", f"WITH m AS (SELECT segment, count(*) AS n, avg(balance) AS m FROM cu GROUP BY 1), t AS (SELECT avg(balance) AS mm, sum((balance - (SELECT avg(balance) FROM cu)) ** 2) AS total FROM cu) SELECT {R('(SELECT sum(n * (m - mm) ** 2) FROM m, t) / total', 'eta2')} FROM t")
def a10(spark, d):
    return pf.eta_squared(customers(spark, d), "segment", "balance")


@query("A11_contingency", f"WITH k AS (SELECT segment, city, count(*) AS n FROM cu GROUP BY 1, 2), f AS (SELECT a.segment, b.city, coalesce(k.n, 0) AS n FROM (SELECT DISTINCT segment FROM cu) a CROSS JOIN (SELECT DISTINCT city FROM cu) b LEFT JOIN k ON a.segment = k.segment AND b.city = k.city) SELECT segment, city, n, {R('n * 1.0 / sum(n) OVER (PARTITION BY segment)', 'share')} FROM f")
def a11(spark, d):
    return pf.contingency(customers(spark, d), "segment", "city")


@query("A12_cramers_v", f"""WITH k AS (SELECT status, priority, count(*) AS n FROM pr GROUP BY 1, 2), f AS (SELECT a.status, b.priority, coalesce(k.n, 0) AS n FROM (SELECT DISTINCT status FROM pr) a CROSS JOIN (SELECT DISTINCT priority FROM pr) b LEFT JOIN k ON a.status = k.status AND b.priority = k.priority),
 e AS (SELECT n, sum(n) OVER (PARTITION BY status) * sum(n) OVER (PARTITION BY priority) * 1.0 / sum(n) OVER () AS e FROM f), t AS (SELECT sum((n - e) ** 2 / e) AS chi2, CAST(sum(n) AS DOUBLE) AS n, (SELECT count(DISTINCT status) FROM pr)::DOUBLE AS r, (SELECT count(DISTINCT priority) FROM pr)::DOUBLE AS k FROM e)
 SELECT {R('sqrt(greatest(0.0, chi2 / n - (k - 1) * (r - 1) / (n - 1)) / least(r - (r - 1) ** 2 / (n - 1) - 1, k - (k - 1) ** 2 / (n - 1) - 1))', 'v')} FROM t""")
def a12(spark, d):
    return pf.cramers_v(predictions(spark, d), "status", "priority")


def _tukey(c, src):
    return f"SELECT '{c}' AS variable, {c} AS v, quantile_cont({c}, 0.25) OVER () AS q1, quantile_cont({c}, 0.75) OVER () AS q3 FROM {src} WHERE {c} IS NOT NULL"


@query("A13_outliers", f"WITH l AS ({_tukey('y', 'pr')} UNION ALL SELECT 'amount', amount, quantile_cont(amount, 0.25) OVER (), quantile_cont(amount, 0.75) OVER () FROM tx WHERE 1 = 0) SELECT variable, count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers, {R('100.0 * count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) / count(*)', 'pct')}, {R('any_value(q1 - 1.5 * (q3 - q1))', 'low')}, {R('any_value(q3 + 1.5 * (q3 - q1))', 'high')}, any_value(q1 = q3) AS zero_iqr FROM l GROUP BY 1")
def a13(spark, d):
    return pf.outliers(predictions(spark, d), ["y"])


@query("A14_box", f"WITH q AS (SELECT quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.5) AS q2, quantile_cont(amount, 0.75) AS q3 FROM tx), f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM q) SELECT {R('any_value(q1)', 'q1')}, {R('any_value(q2)', 'q2')}, {R('any_value(q3)', 'q3')}, {R('any_value(low)', 'low')}, {R('any_value(high)', 'high')}, {R('min(amount) FILTER (WHERE amount BETWEEN low AND high)', 'whisker_low')}, {R('max(amount) FILTER (WHERE amount BETWEEN low AND high)', 'whisker_high')}, count(amount) AS n FROM tx, f")
def a14(spark, d):
    return pf.box(transactions(spark, d), "amount")


@query("A46_box_by_group", f"WITH q AS (SELECT type, quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.5) AS q2, quantile_cont(amount, 0.75) AS q3 FROM tx GROUP BY 1), f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM q) SELECT tx.type, {R('any_value(q1)', 'q1')}, {R('any_value(q2)', 'q2')}, {R('any_value(q3)', 'q3')}, {R('any_value(low)', 'low')}, {R('any_value(high)', 'high')}, {R('min(amount) FILTER (WHERE amount BETWEEN low AND high)', 'whisker_low')}, {R('max(amount) FILTER (WHERE amount BETWEEN low AND high)', 'whisker_high')}, count(amount) AS n FROM tx JOIN f ON tx.type = f.type GROUP BY 1")
def a46(spark, d):
    return pf.box(transactions(spark, d), "amount", ["type"])


def _describe(c):
    return f"SELECT '{c}' AS variable, count({c}) AS n, {R(f'avg({c})', 'mean')}, {R(f'stddev_samp({c})', 'sd')}, {R(f'min({c})', 'min')}, {R(f'quantile_cont({c}, 0.25)', 'p25')}, {R(f'quantile_cont({c}, 0.5)', 'p50')}, {R(f'quantile_cont({c}, 0.75)', 'p75')}, {R(f'max({c})', 'max')}, {R(f'skewness({c})', 'skew')} FROM pr"


@query("A15_describe_numeric", f"{_describe('y')} UNION ALL {_describe('a')} UNION ALL {_describe('b')}")
def a15(spark, d):
    return pf.describe(predictions(spark, d), ["y", "a", "b"])


def _cats(c):
    return f"SELECT '{c}' AS variable, count(*) AS levels, (SELECT v FROM {c}_k ORDER BY n DESC, v LIMIT 1) AS most, {R(f'(SELECT n FROM {c}_k ORDER BY n DESC, v LIMIT 1) * 1.0 / sum(n)', 'most_share')}, (SELECT v FROM {c}_k ORDER BY n, v LIMIT 1) AS least, {R(f'(SELECT n FROM {c}_k ORDER BY n, v LIMIT 1) * 1.0 / sum(n)', 'least_share')} FROM {c}_k"


@query("A16_describe_categories", f"WITH segment_k AS (SELECT segment AS v, count(*) AS n FROM cu GROUP BY 1), city_k AS (SELECT city AS v, count(*) AS n FROM cu GROUP BY 1) {_cats('segment')} UNION ALL {_cats('city')}")
def a16(spark, d):
    return pf.describe_categories(customers(spark, d), ["segment", "city"])


@query("A17_value_counts", f"WITH k AS (SELECT city, count(*) AS n FROM cu GROUP BY 1) SELECT city, n, {R('n * 1.0 / (SELECT sum(n) FROM k)', 'share')} FROM k ORDER BY n DESC, city LIMIT 15")
def a17(spark, d):
    return pf.value_counts(customers(spark, d), "city", 15)


@query("A18_pearson", f"SELECT 'y' AS a, 'a' AS b, {R('corr(y, a)', 'r')} FROM pr UNION ALL SELECT 'y', 'b', {R('corr(y, b)', 'r')} FROM pr UNION ALL SELECT 'a', 'b', {R('corr(a, b)', 'r')} FROM pr")
def a18(spark, d):
    return pf.pearson(predictions(spark, d), [("y", "a"), ("y", "b"), ("a", "b")])


_AVG_RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"


@query("A19_spearman", f"WITH r AS (SELECT {_AVG_RANK.format('s')} AS rs, {_AVG_RANK.format('y')} AS ry FROM sc) SELECT {R('corr(rs, ry)', 'rho')} FROM r")
def a19(spark, d):
    return pf.spearman(scores(spark, d), "s", "y")


@query("A20_high_correlations", f"WITH c AS (SELECT 'y' AS a, 'a' AS b, corr(y, a) AS r FROM pr UNION ALL SELECT 'y', 'b', corr(y, b) FROM pr UNION ALL SELECT 'y', 'cust', corr(y, cust) FROM pr UNION ALL SELECT 'a', 'b', corr(a, b) FROM pr UNION ALL SELECT 'a', 'cust', corr(a, cust) FROM pr UNION ALL SELECT 'b', 'cust', corr(b, cust) FROM pr) SELECT a, b, {R('r', 'r')} FROM c WHERE abs(r) > 0.9")
def a20(spark, d):
    return pf.high_correlations(predictions(spark, d), ["y", "a", "b", "cust"])


@query("A21_association", f"WITH m AS (SELECT lang, count(*) AS n, avg(s) AS m FROM sc GROUP BY 1), r AS (SELECT {_AVG_RANK.format('s')} AS rs, {_AVG_RANK.format('y')} AS ry FROM sc) SELECT 'lang' AS variable, 'eta2' AS measure, {R('(SELECT sum(n * (m - (SELECT avg(s) FROM sc)) ** 2) FROM m) / (var_pop(s) * count(*))', 'value')} FROM sc UNION ALL SELECT 's', 'spearman', {R('corr(rs, ry)', 'value')} FROM r UNION ALL SELECT 's', 'pearson', {R('corr(s, y)', 'value')} FROM sc")
def a21(spark, d):
    s = scores(spark, d)
    one = lambda df, v, m, c: df.select(F.lit(v).alias("variable"), F.lit(m).alias("measure"), F.col(c).alias("value"))
    return one(pf.eta_squared(s, "lang", "s"), "lang", "eta2", "eta2").union(one(pf.spearman(s, "s", "y"), "s", "spearman", "rho")).union(one(pf.pearson(s, [("s", "y")]), "s", "pearson", "r"))


@query("A22_duplicate_columns", f"WITH z AS (SELECT o_orderkey * 1.0 AS a, (SELECT max(o_orderkey) FROM orders) - o_orderkey * 1.0 AS b FROM orders), x AS (SELECT a, row_number() OVER (ORDER BY a) AS i FROM z), w AS (SELECT b, row_number() OVER (ORDER BY b) AS i FROM z) SELECT {R('(SELECT avg(CASE WHEN abs(a - b) <= 1e-8 + 1e-6 * abs(b) THEN 100.0 ELSE 0.0 END) FROM z)', 'by_row_pct')}, {R('(SELECT avg(CASE WHEN abs(a - b) <= 1e-8 + 1e-6 * abs(b) THEN 100.0 ELSE 0.0 END) FROM x JOIN w ON x.i = w.i)', 'same_values_pct')}, {R('(SELECT corr(a, b) FROM z)', 'r')}, {R('(SELECT quantile_cont(a, 0.5) / quantile_cont(b, 0.5) FROM z)', 'median_ratio')}")
def a22(spark, d):
    o = table(spark, d, "orders").select((F.col("o_orderkey") * F.lit(1.0)).alias("a"))
    top = o.agg(F.max("a").alias("m"))
    return pf.duplicate_columns(o.crossJoin(F.broadcast(top)).select("a", (F.col("m") - F.col("a")).alias("b")), "a", "b")


@query("A23_reconciliation", f"WITH real AS (SELECT customer_id, count(*)::DOUBLE AS n, sum(amount) AS total, avg(amount) AS mean FROM tx GROUP BY 1), j AS (SELECT 67.0 AS rep_n, balance AS rep_total, 50.0 AS rep_mean, n, total, mean FROM cu LEFT JOIN real ON cu.customer_id = real.customer_id) SELECT 'n' AS measure, {R('avg(CASE WHEN abs(rep_n - n) <= 1e-8 + 0.01 * abs(n) THEN 100.0 ELSE 0.0 END)', 'pct')} FROM j UNION ALL SELECT 'total', {R('avg(CASE WHEN abs(rep_total - total) <= 1e-8 + 0.01 * abs(total) THEN 100.0 ELSE 0.0 END)', 'pct')} FROM j UNION ALL SELECT 'mean', {R('avg(CASE WHEN abs(rep_mean - mean) <= 1e-8 + 0.01 * abs(mean) THEN 100.0 ELSE 0.0 END)', 'pct')} FROM j")
def a23(spark, d):
    c = customers(spark, d).select("customer_id", F.lit(67.0).alias("rep_n"), F.col("balance").alias("rep_total"), F.lit(50.0).alias("rep_mean"))
    return pf.reconcile(c, transactions(spark, d), {"n": "rep_n", "total": "rep_total", "mean": "rep_mean"})


@query("A24_conditional_mean", f"SELECT s > 1500 AS flag, count(*) AS n, {R('avg(y)', 'mean_y')}, {R('avg(toxic)', 'mean_toxic')} FROM sc GROUP BY 1")
def a24(spark, d):
    return pf.conditional_means(scores(spark, d), F.col("s") > 1500, ["y", "toxic"])


@query("A25_adoption_rates", f"SELECT 'y' AS product, {R('avg(y) * 100', 'pct')} FROM sc UNION ALL SELECT 'toxic', {R('avg(toxic) * 100', 'pct')} FROM sc")
def a25(spark, d):
    return pf._long(scores(spark, d).agg(F.avg("y").alias("y"), F.avg("toxic").alias("toxic")), {c: (F.col(c) * 100,) for c in ("y", "toxic")}, ("pct",), "product")


@query("A26_boolean_sum", f"SELECT {R('avg(CASE WHEN y + toxic = 1 THEN 100.0 ELSE 0.0 END)', 'equal_pct')}, {R('corr(y + toxic, s)', 'r')} FROM sc")
def a26(spark, d):
    total = F.col("y") + F.col("toxic")
    return scores(spark, d).agg(F.avg((total == 1).cast("double") * 100).alias("equal_pct"), corr(total.cast("double"), F.col("s")).alias("r"))


@query("A27_monthly", f"SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, {R('sum(o_totalprice)', 'volume')} FROM orders GROUP BY 1")
def a27(spark, d):
    return pf.monthly(table(spark, d, "orders").select(F.col("o_orderdate").alias("date"), F.col("o_totalprice").alias("amount")))


@query("A27_monthly_mix", "SELECT strftime(date, '%Y-%m') AS month, " + ", ".join(f"count(*) FILTER (WHERE type = '{t}') AS n_{t}" for t in TYPES) + " FROM tx GROUP BY 1")
def a27b(spark, d):
    return pf.monthly_mix(transactions(spark, d), TYPES)


@query("A27_weekdays", "SELECT isodow(date) - 1 AS weekday, count(*) AS n FROM tx GROUP BY 1")
def a27c(spark, d):
    return pf.weekdays(transactions(spark, d))


_QC = "e AS (SELECT list_sort(list_distinct(quantile_cont({0}, [{1}]))) AS edges FROM {2})"


def _bins(col, n, src):
    return _QC.format(col, ", ".join(str(k / n) for k in range(n + 1)), src)


_BIN = "greatest(len(list_filter(edges, lambda x: x < {0})), 1)"


@query("A28_profile_bins", f"WITH {_bins('balance', 20, 'cu')}, b AS (SELECT {_BIN.format('balance')} AS bin, balance, nation FROM cu, e) SELECT 'bin' AS kind, {R('quantile_cont(balance, 0.5)', 'x')}, {R('min(balance)', 'low')}, {R('max(balance)', 'high')}, CAST(NULL AS VARCHAR) AS level, count(*) AS n, {R('avg(nation)', 'mean_target')}, {R('avg(CASE WHEN nation > 12 THEN 1.0 ELSE 0.0 END)', 'positive_rate')} FROM b GROUP BY bin")
def a28(spark, d):
    c = customers(spark, d).withColumn("high", (F.col("nation") > 12).cast("int"))
    return pf.profile_variable(c, "balance", "nation", "high")


@query("A28_profile_values", f"SELECT 'value' AS kind, {R('nation', 'x')}, {R('nation', 'low')}, {R('nation', 'high')}, CAST(NULL AS VARCHAR) AS level, count(*) AS n, {R('avg(balance)', 'mean_target')}, {R('avg(CASE WHEN balance > 5000 THEN 1.0 ELSE 0.0 END)', 'positive_rate')} FROM cu GROUP BY nation")
def a28b(spark, d):
    c = customers(spark, d).withColumn("high", (F.col("balance") > 5000).cast("int"))
    return pf.profile_variable(c, "nation", "balance", "high")


@query("A28_profile_categories", f"SELECT 'category' AS kind, CAST(NULL AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high, segment AS level, count(*) AS n, {R('avg(balance)', 'mean_target')}, {R('avg(CASE WHEN balance > 5000 THEN 1.0 ELSE 0.0 END)', 'positive_rate')} FROM cu GROUP BY segment")
def a28c(spark, d):
    c = customers(spark, d).withColumn("high", (F.col("balance") > 5000).cast("int"))
    return pf.profile_variable(c, "segment", "balance", "high", categorical=True)


_HB = "CAST(least(greatest(floor((v - lo) / (hi - lo) * {n}) + 1, 1), {n}) AS BIGINT)"


@query("A29_histogram", f"WITH e AS (SELECT min(o_orderkey)::DOUBLE AS lo, max(o_orderkey)::DOUBLE AS hi FROM orders), b AS (SELECT {_HB.format(n=60).replace('v -', 'o_orderkey -')} AS bin, count(*) AS n FROM orders, e GROUP BY 1) SELECT g.bin, {R('lo + (g.bin - 1) * ((hi - lo) / 60)', 'low')}, {R('lo + g.bin * ((hi - lo) / 60)', 'high')}, coalesce(n, 0) AS n FROM (SELECT unnest(range(1, 61)) AS bin) g CROSS JOIN e LEFT JOIN b ON g.bin = b.bin")
def a29(spark, d):
    return pf.histogram(table(spark, d, "orders"), "o_orderkey", 60)


@query("A29_histogram_tail", f"WITH e AS (SELECT min(amount) AS lo, quantile_cont(amount, 0.99) AS hi FROM tx) SELECT CASE WHEN amount > hi THEN 31 ELSE {_HB.format(n=30).replace('v -', 'amount -')} END AS bin, count(*) AS n FROM tx, e GROUP BY 1")
def a29b(spark, d):
    return pf.histogram_with_tail(transactions(spark, d), "amount")


@query("A30_share_comparison", f"WITH e AS (SELECT min(amount) AS lo, max(amount) AS hi FROM tx), b AS (SELECT {_HB.format(n=20).replace('v -', 'amount -')} AS bin, count(*) FILTER (WHERE type = 'view') AS a, count(*) AS c FROM tx, e GROUP BY 1) SELECT bin, {R('a * 1.0 / (SELECT sum(a) FROM b)', 'share_kept')}, {R('c * 1.0 / (SELECT sum(c) FROM b)', 'share_all')} FROM b")
def a30(spark, d):
    return pf.compare_shares(transactions(spark, d), F.col("type") == "view", "amount", 20)


@query("A31_cohort_split", f"SELECT nation < 20 AS train, segment, count(*) AS n, {R('avg(balance)', 'mean_balance')}, {R('avg(CASE WHEN balance > 5000 THEN 1.0 ELSE 0.0 END)', 'rate')} FROM cu GROUP BY 1, 2")
def a31(spark, d):
    return customers(spark, d).groupBy((F.col("nation") < 20).alias("train"), "segment").agg(F.count("*").alias("n"), F.avg("balance").alias("mean_balance"), F.avg((F.col("balance") > 5000).cast("double")).alias("rate"))


@query("A33_quintile_profile", f"WITH {_bins('amount', 5, 'tx')}, b AS (SELECT {_BIN.format('amount')} AS bin, amount FROM tx, e) SELECT bin, count(*) AS n, {R('min(amount)', 'low')}, {R('max(amount)', 'high')}, {R('avg(amount)', 'mean')} FROM b GROUP BY 1")
def a33(spark, d):
    return pf.quantile_bins(transactions(spark, d), "amount", 5).groupBy("bin").agg(F.count("*").alias("n"), F.min("amount").alias("low"), F.max("amount").alias("high"), F.avg("amount").alias("mean"))


@query("A34_median_by_category", f"SELECT segment, {R('quantile_cont(balance, 0.5)', 'median')}, count(*) AS n FROM cu GROUP BY 1")
def a34(spark, d):
    return customers(spark, d).groupBy("segment").agg(F.percentile("balance", 0.5).alias("median"), F.count("*").alias("n"))


def _screen(c):
    return f"SELECT '{c}' AS variable, {R(f'min({c})', 'min')}, {R(f'quantile_cont({c}, 0.01)', 'p1')}, {R(f'quantile_cont({c}, 0.99)', 'p99')}, {R(f'max({c})', 'max')}, {R(f'avg(CASE WHEN {c} = 0 THEN 1.0 ELSE 0.0 END)', 'zero_share')} FROM sc"


@query("A35_screen", f"{_screen('s')} UNION ALL {_screen('y')} UNION ALL {_screen('toxic')}")
def a35(spark, d):
    return pf.screen(scores(spark, d), ["s", "y", "toxic"])


@query("A36_two_level_quantiles", f"WITH m AS (SELECT customer_id, type, sum(amount) AS t FROM tx GROUP BY 1, 2) SELECT type, {R('avg(t)', 'mean')}, {R('quantile_cont(t, 0.25)', 'q25')}, {R('quantile_cont(t, 0.75)', 'q75')} FROM m GROUP BY 1")
def a36(spark, d):
    m = transactions(spark, d).groupBy("customer_id", "type").agg(F.sum("amount").alias("t"))
    return m.groupBy("type").agg(F.avg("t").alias("mean"), F.percentile("t", 0.25).alias("q25"), F.percentile("t", 0.75).alias("q75"))


@query("A37_unit_conversions", f"SELECT type, {R('avg(amount) / 60', 'mean_minutes')}, {R('sum(amount) / 3600', 'hours')} FROM tx GROUP BY 1")
def a37(spark, d):
    return transactions(spark, d).groupBy("type").agg((F.avg("amount") / 60).alias("mean_minutes"), (F.sum("amount") / 3600).alias("hours"))


@query("A39_over_seeds", f"SELECT treatment, {R('avg(value)', 'mean')}, {R('stddev_samp(value)', 'sd')}, {R('min(value)', 'min')}, {R('max(value)', 'max')}, count(*) AS n FROM fo GROUP BY 1")
def a39(spark, d):
    return fold_values(spark, d).groupBy("treatment").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("n"))


@query("A40_within_slope", f"WITH m AS (SELECT s - avg(s) OVER (PARTITION BY lang) AS dx, y - avg(y) OVER (PARTITION BY lang) AS dy FROM sc) SELECT {R('sum(dx * dy) / sum(dx * dx)', 'slope')} FROM m")
def a40(spark, d):
    return pf.within_slope(scores(spark, d), ["lang"], "s", "y")


@query("A42_any_all", "WITH g AS (SELECT lang, source, bool_and(y = 1) AS all_good FROM sc GROUP BY 1, 2), h AS (SELECT lang, bool_and(all_good) AS complete, bool_or(all_good) AS any_one FROM g GROUP BY 1) SELECT count(*) FILTER (WHERE complete) AS complete, count(*) FILTER (WHERE any_one) AS any_one FROM h")
def a42(spark, d):
    g = scores(spark, d).groupBy("lang", "source").agg(F.bool_and(F.col("y") == 1).alias("all_good"))
    h = g.groupBy("lang").agg(F.bool_and("all_good").alias("complete"), F.bool_or("all_good").alias("any_one"))
    return h.agg(F.count_if("complete").alias("complete"), F.count_if("any_one").alias("any_one"))


@query("A45_bin_medians", f"WITH {_bins('y', 10, 'pr')}, b AS (SELECT status, {_BIN.format('y')} AS bin, y, a FROM pr, e) SELECT status, bin, count(*) AS n, {R('quantile_cont(y, 0.5)', 'x')}, {R('quantile_cont(a, 0.5)', 'y')} FROM b GROUP BY 1, 2")
def a45(spark, d):
    return pf.grouped_bin_medians(predictions(spark, d), "y", "a", "status", 10)


@query("A47_any_outlier", f"WITH q AS (SELECT quantile_cont(s, 0.25) AS q1, quantile_cont(s, 0.75) AS q3, quantile_cont(p, 0.25) AS p1, quantile_cont(p, 0.75) AS p3 FROM sc) SELECT s < q1 - 1.5 * (q3 - q1) OR s > q3 + 1.5 * (q3 - q1) OR p < p1 - 1.5 * (p3 - p1) OR p > p3 + 1.5 * (p3 - p1) AS outlier, count(*) AS n, {R('avg(y)', 'positive_rate')} FROM sc, q GROUP BY 1")
def a47(spark, d):
    return pf.any_outlier(scores(spark, d), ["s", "p"], "y")


@query("A50_share_non_null", f"WITH {_GAPPY} SELECT city, {R('avg(CASE WHEN balance IS NOT NULL THEN 1.0 ELSE 0.0 END)', 'share')}, {R('avg(balance)', 'mean')} FROM g GROUP BY 1")
def a50(spark, d):
    return _gappy(spark, d).groupBy("city").agg(F.avg(F.col("balance").isNotNull().cast("double")).alias("share"), F.avg("balance").alias("mean"))


@query("A51_error_share", f"WITH g AS (SELECT priority, count(*) AS n, sum((a - y) ** 2) AS sq FROM pr GROUP BY 1) SELECT priority, n, {R('sq / n', 'mse')}, {R('n * 1.0 / sum(n) OVER ()', 'row_share')}, {R('sq / sum(sq) OVER ()', 'error_share')} FROM g")
def a51(spark, d):
    return pf.squared_error_share(predictions(spark, d).withColumn("e", F.col("a") - F.col("y")), "priority", "e")


_OVER = {"all": "true", "final": "status = 'F'", "urgent": "priority = '1-URGENT'", "large": "y > 300"}


@query("A52_overlapping_groups", " UNION ALL ".join(f"SELECT '{k}' AS \"group\", count(*) AS n, {R('sqrt(avg((a - y) ** 2))', 'rmse')} FROM pr WHERE {v}" for k, v in _OVER.items()))
def a52(spark, d):
    return pf.overlapping_groups(predictions(spark, d), {k: F.expr(v) for k, v in _OVER.items()}, [F.count("*").alias("n"), F.sqrt(F.avg((F.col("a") - F.col("y")) ** 2)).alias("rmse")])


@query("A53_robust_dispersion", f"WITH m AS (SELECT median(amount) AS m FROM tx) SELECT {R('1.4826 * median(abs(amount - m))', 'sigma')} FROM tx, m")
def a53(spark, d):
    return pf.mad_sigma(transactions(spark, d), "amount")


@query("A54_clipped_scale", f"WITH q AS (SELECT quantile_cont(balance, 0.05) AS lo, quantile_cont(balance, 0.95) AS hi FROM cu) SELECT customer_id, {R('least(greatest((balance - lo) / (hi - lo), 0.0), 1.0)', 'scaled')} FROM cu, q")
def a54(spark, d):
    return pf.clipped_scale(customers(spark, d), "balance").select("customer_id", "scaled")


@query("R4_unpivot", f"SELECT id, 'a' AS variable, {R('a', 'value')} FROM pr UNION ALL SELECT id, 'b', {R('b', 'value')} FROM pr")
def r4(spark, d):
    return pf.unpivot(predictions(spark, d), ["a", "b"], ["id"])
