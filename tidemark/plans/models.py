"""Model queries M2 to M30."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import additive as ad
from tidemark.operators import metrics as mt
from tidemark.operators import mixture as mx
from tidemark.operators import model as md
from tidemark.operators.neighbours import adasyn, adasyn_shares, nearest, smote
from tidemark.plans.registry import DICE, TAIL, R, query
from tidemark.plans.roles import customers, predictions, scores, table


@query("M2_standardize", f"WITH m AS (SELECT avg(balance) AS mu, stddev_pop(balance) AS sd FROM cu WHERE nation < 20) SELECT customer_id, {R('(balance - mu) / sd', 'balance')} FROM cu, m")
def m2(spark, d):
    c = customers(spark, d)
    return md.standardize(c, c.filter("nation < 20"), ["balance"]).select("customer_id", "balance")


@query("M2_one_hot", "SELECT id, CAST(status = 'O' AS BIGINT) AS status__O, CAST(status = 'P' AS BIGINT) AS status__P FROM pr")
def m2b(spark, d):
    return md.one_hot(predictions(spark, d).select("id", "status"), "status", ["P", "F", "O"])


@query("M3_variable_names", "SELECT 'status__O' AS name, 'status' AS variable UNION ALL SELECT 'y', 'y'")
def m3(spark, d):
    return spark.createDataFrame(list(md.variable_of(["status__O", "y"]).items()), "name string, variable string")


@query("M4_class_weight", f"SELECT {R('(count(*) - sum(y)) / sum(y)', 'weight')} FROM sc")
def m4(spark, d):
    return md.class_weight(scores(spark, d), "y")


@query("M4_applicability", "SELECT model, balancing, NOT (balancing = 'weights' AND model IN ('knn', 'naive_bayes')) AS ok FROM (VALUES ('knn'), ('tree'), ('naive_bayes')) m(model) CROSS JOIN (VALUES ('none'), ('weights')) b(balancing)")
def m4b(spark, d):
    from tidemark.operators.relational import plan_grid

    return plan_grid(spark, model=["knn", "tree", "naive_bayes"], balancing=["none", "weights"]).select("model", "balancing", md.applicable("model", "balancing").alias("ok"))


@query("M8_search_decode", f"WITH u AS (SELECT customer_id, (customer_id % 100) / 100.0::DOUBLE AS u FROM cu) SELECT customer_id, {R('exp(ln(0.001::DOUBLE) + u * (ln(10.0::DOUBLE) - ln(0.001::DOUBLE)))', 'rate')}, CAST(round_even(2 + u * 10, 0) AS BIGINT) AS depth, CASE WHEN floor(u * 3) = 0 THEN 'x' WHEN floor(u * 3) = 1 THEN 'y' ELSE 'z' END AS kind FROM u")
def m8(spark, d):
    u = (F.col("customer_id") % 100) / 100.0
    return customers(spark, d).select("customer_id", md.decode_search(u, "log", 0.001, 10.0).alias("rate"), md.decode_search(u, "int", 2, 12).alias("depth"), md.decode_search(u, "cat", 0, 0, ["x", "y", "z"]).alias("kind"))


_Q = "[" + ", ".join(str(k / 16) for k in range(1, 16)) + "]"
_CUTS = f"ct AS (SELECT 'balance' AS variable, list_sort(list_distinct(quantile_cont(balance, {_Q}))) AS cuts FROM cu UNION ALL SELECT 'five', list_sort(list((v + p) / 2) FILTER (WHERE p IS NOT NULL)) FROM (SELECT v, lag(v) OVER (ORDER BY v) AS p FROM (SELECT DISTINCT CAST(nation % 5 AS DOUBLE) AS v FROM cu)))"
_CODES = f"{_CUTS}, lg AS (SELECT customer_id, 'balance' AS variable, balance AS v FROM cu UNION ALL SELECT customer_id, 'five', CAST(nation % 5 AS DOUBLE) FROM cu), cd AS (SELECT customer_id, lg.variable, CAST(len(list_filter(cuts, lambda x: x < v)) AS BIGINT) AS code FROM lg JOIN ct ON lg.variable = ct.variable), rs AS (SELECT customer_id, nation - 12 + CASE WHEN balance > 5000 THEN 8 ELSE 0 END AS r FROM cu)"


def _codes(spark, d):
    c = customers(spark, d).select("customer_id", "balance", (F.col("nation") % 5).cast("double").alias("five"), (F.col("nation") - 12 + F.when(F.col("balance") > 5000, 8).otherwise(0)).cast("double").alias("r"))
    cuts = md.bin_cuts(c, ["balance", "five"], 16)
    return md.encode_bins(c, ["balance", "five"], cuts, ["customer_id", "r"])


@query("M11_bin_cuts", f"WITH {_CUTS} SELECT variable, i - 1 AS place, {R('cuts[i]', 'cut')} FROM (SELECT variable, cuts, unnest(range(1, len(cuts) + 1)) AS i FROM ct)")
def m11(spark, d):
    c = customers(spark, d).select("balance", (F.col("nation") % 5).cast("double").alias("five"))
    return md.bin_cuts(c, ["balance", "five"], 16).select("variable", F.posexplode("cuts").alias("place", "cut"))


@query("M11_bin_codes", f"WITH {_CODES} SELECT customer_id, variable, code FROM cd")
def m11b(spark, d):
    return _codes(spark, d).select("customer_id", "variable", "code")


@query("M12_bin_sums", f"WITH {_CODES} SELECT variable, code, {R('sum(r)', 'g')}, count(*) AS n FROM cd JOIN rs ON cd.customer_id = rs.customer_id GROUP BY 1, 2")
def m12(spark, d):
    return md.bin_sums(_codes(spark, d), "r")


@query("M13_best_split", f"WITH {_CODES}, h AS (SELECT variable, code, sum(r)::DOUBLE AS g, count(*) AS n FROM cd JOIN rs ON cd.customer_id = rs.customer_id GROUP BY 1, 2), c AS (SELECT variable, code, sum(g) OVER w AS gl, sum(n) OVER w AS nl, sum(g) OVER (PARTITION BY variable) AS gt, sum(n) OVER (PARTITION BY variable) AS nt FROM h WINDOW w AS (PARTITION BY variable ORDER BY code)), s AS (SELECT variable, code, gl ** 2 / (nl + 1) + (gt - gl) ** 2 / (nt - nl + 1) - gt ** 2 / (nt + 1) AS gain, nl, nt - nl AS nr FROM c WHERE nl >= 20 AND nt - nl >= 20) SELECT variable, code, {R('gain', 'gain')}, CAST(nl AS BIGINT) AS nl, CAST(nr AS BIGINT) AS nr FROM s ORDER BY round(gain, 9) DESC, variable, code LIMIT 1")
def m13(spark, d):
    return md.best_split(md.bin_sums(_codes(spark, d), "r"), 20, 1.0).drop("gl", "gr")


def _tree(depth):
    """SQL of a tree grown by levels: splits s0, s1, ... and rows with their last node."""
    out = [f"{_CODES}, cw AS (SELECT customer_id, max(code) FILTER (WHERE variable = 'balance') AS cb, max(code) FILTER (WHERE variable = 'five') AS cf FROM cd GROUP BY 1), t0 AS (SELECT cw.customer_id, cb, cf, r, 0 AS node FROM cw JOIN rs ON cw.customer_id = rs.customer_id)"]
    for l in range(depth):
        out.append(f"h{l} AS (SELECT node, variable, code, sum(r)::DOUBLE AS g, count(*) AS n FROM (SELECT node, r, 'balance' AS variable, cb AS code FROM t{l} UNION ALL SELECT node, r, 'five', cf FROM t{l}) WHERE node >= {2**l - 1} GROUP BY 1, 2, 3)")
        out.append(f"c{l} AS (SELECT node, variable, code, sum(g) OVER w AS gl, sum(n) OVER w AS nl, sum(g) OVER v AS gt, sum(n) OVER v AS nt FROM h{l} WINDOW w AS (PARTITION BY node, variable ORDER BY code), v AS (PARTITION BY node, variable))")
        out.append(f"g{l} AS (SELECT node, variable, code, gl ** 2 / (nl + 1) + (gt - gl) ** 2 / (nt - nl + 1) - gt ** 2 / (nt + 1) AS gain FROM c{l} WHERE nl >= 20 AND nt - nl >= 20)")
        out.append(f"s{l} AS (SELECT node, variable, code FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(gain, 9) DESC, variable, code) AS k FROM g{l} WHERE gain > 1e-9) WHERE k = 1)")
        out.append(f"t{l + 1} AS (SELECT customer_id, cb, cf, r, CASE WHEN s.node IS NULL THEN t.node WHEN CASE WHEN s.variable = 'balance' THEN cb ELSE cf END <= s.code THEN 2 * t.node + 1 ELSE 2 * t.node + 2 END AS node FROM t{l} t LEFT JOIN s{l} s ON s.node = t.node)")
    return ", ".join(out)


_INNER = " UNION ALL ".join(f"SELECT node, variable, code, NULL::DOUBLE AS value, NULL::BIGINT AS n FROM s{l}" for l in range(3))


@query("M14_tree", f"WITH {_tree(3)} SELECT CAST(node AS BIGINT) AS node, variable, CAST(code AS BIGINT) AS code, value, n FROM ({_INNER}) UNION ALL SELECT CAST(node AS BIGINT), NULL, NULL, {R('sum(r) / (count(*) + 1)', 'value')}, count(*) FROM t3 GROUP BY 1")
def m14(spark, d):
    return md.grow_tree(_codes(spark, d), "customer_id", "r", 3, 20, 1.0)


@query("M14_tree_predictions", f"WITH {_tree(2)}, lf AS (SELECT node, sum(r) / (count(*) + 1) AS v FROM t2 GROUP BY 1) SELECT customer_id, {R('v', 'value')} FROM t2 JOIN lf ON t2.node = lf.node")
def m14b(spark, d):
    codes = _codes(spark, d)
    return md.predict_tree(codes, "customer_id", md.grow_tree(codes, "customer_id", "r", 2, 20, 1.0))


_MIX = "pi AS (SELECT 0.25::DOUBLE AS p1, 0.75::DOUBLE AS p2, -5.0::DOUBLE AS c1, 3.0::DOUBLE AS c2, 4.0::DOUBLE AS s), lg AS (SELECT id, a - y AS r, ln(p1) - 0.5 * ((a - y - c1) / s) ** 2 AS l1, ln(p2) - 0.5 * ((a - y - c2) / s) ** 2 AS l2, s FROM pr, pi), gm AS (SELECT id, r, exp(l1) / (exp(l1) + exp(l2)) AS g1, ln(exp(l1) + exp(l2)) - ln(s) - 0.5 * ln(2 * pi()) AS ld FROM lg)"


def _mix(spark, d):
    params = spark.sql("SELECT array(0.25D, 0.75D) AS pi, array(-5.0D, 3.0D) AS c, 4.0D AS sigma")
    return md.mixture_e_step(predictions(spark, d).select("id", (F.col("a") - F.col("y")).alias("r")), "r", params)


@query("M15_e_step", f"WITH {_MIX} SELECT id, {R('g1', 'gamma1')}, {R('ld', 'log_density')} FROM gm")
def m15(spark, d):
    return _mix(spark, d).select("id", F.get("gamma", F.lit(0)).alias("gamma1"), "log_density")


@query("M15_m_step", f"WITH {_MIX}, m AS (SELECT avg(g1) AS p1, sum(g1 * r) / sum(g1) AS c1, sum((1 - g1) * r) / sum(1 - g1) AS c2 FROM gm) SELECT {R('any_value(p1)', 'pi1')}, {R('any_value(c1)', 'c1')}, {R('any_value(c2)', 'c2')}, {R('sqrt(avg(g1 * (r - c1) ** 2 + (1 - g1) * (r - c2) ** 2))', 'sigma')} FROM gm, m")
def m15b(spark, d):
    return md.mixture_m_step(_mix(spark, d), "r", 2, 1e-6).select(F.get("pi", F.lit(0)).alias("pi1"), F.get("c", F.lit(0)).alias("c1"), F.get("c", F.lit(1)).alias("c2"), "sigma")


@query("M16_mixture_fit")
def m16(spark, d):
    m = mx.fit_mixture(predictions(spark, d).select((F.col("a") - F.col("y")).alias("r")), "r")
    return m.select(F.size("c").alias("k"), F.get("pi", F.lit(0)).alias("pi1"), F.get("c", F.lit(0)).alias("c1"), F.get("c", F.lit(1)).alias("c2"), "sigma", "log_likelihood")


_EXCEEDS = f"z AS (SELECT id, y, a, (250 - a + 5) / 4.0::DOUBLE AS z1, (250 - a - 3) / 4.0::DOUBLE AS z2 FROM pr), x AS (SELECT id, y, a, 0.25::DOUBLE * {TAIL('z1')} + 0.75::DOUBLE * {TAIL('z2')} AS p FROM z)"


@query("M18_exceedance", f"WITH {_EXCEEDS} SELECT id, {R('p', 'p')} FROM x")
def m18(spark, d):
    p = spark.sql("SELECT array(0.25D, 0.75D) AS pi, array(-5.0D, 3.0D) AS c, 4.0D AS sigma")
    return predictions(spark, d).crossJoin(F.broadcast(p)).select("id", mx.exceedance(F.col("a"), F.lit(250.0), F.col("pi"), F.col("c"), F.col("sigma")).alias("p"))


@query("M18_outputs")
def m18b(spark, d):
    """Exceedance, quantile, interval and level set of forecasts with one fitted mixture of residuals."""
    p = predictions(spark, d)
    m = mx.fit_mixture(p.filter("id % 2 = 0").select((F.col("y") - F.col("a")).alias("r")), "r").head()
    out = mx.mixture_outputs(p.filter("id % 2 = 1"), "a", mx.Mixture(mx.np.array(m.pi), mx.np.array(m.c), m.sigma), 250.0)
    return out.select("id", "y", "p_exceeds", "quantile", "low", "high", F.size("level_set").alias("intervals"), F.element_at("level_set", 1)["low"].alias("set_low"), F.element_at("level_set", -1)["high"].alias("set_high"))


@query("M18_coverage")
def m18c(spark, d):
    p = predictions(spark, d)
    m = mx.fit_mixture(p.filter("id % 2 = 0").select((F.col("y") - F.col("a")).alias("r")), "r").head()
    return mx.set_coverage(mx.mixture_outputs(p.filter("id % 2 = 1"), "a", mx.Mixture(mx.np.array(m.pi), mx.np.array(m.c), m.sigma), 250.0), "y")


_TERMS = [("balance", "balance", "numeric", 5000.0, 2500.0, None, [-1.0, 0.0, 1.0], [0.0, -0.5, -0.1, 0.2, 0.6, 0.0]), ("machinery", "segment", "category", None, None, "MACHINERY", [0.5], [0.0, -0.05, 0.3, 0.0])]


def _terms(spark):
    return spark.createDataFrame(_TERMS, "term string, variable string, kind string, mean double, scale double, category string, cuts array<double>, scores array<double>")


def _long(spark, d):
    c, none = customers(spark, d), F.lit(None)
    rows = F.array(F.struct(F.lit("balance").alias("variable"), F.col("balance").alias("number"), none.cast("string").alias("text")), F.struct(F.lit("segment").alias("variable"), none.cast("double").alias("number"), F.col("segment").alias("text")))
    return c.select("customer_id", F.inline(rows))


_RAW = "t AS (SELECT customer_id, segment, (balance - 5000) / 2500 AS z FROM cu), sr AS (SELECT customer_id, 0.1 + CASE WHEN z < -1 THEN -0.5 WHEN z < 0 THEN -0.1 WHEN z < 1 THEN 0.2 ELSE 0.6 END + CASE WHEN segment = 'MACHINERY' THEN 0.3 ELSE -0.05 END AS raw FROM t)"


@query("M21_table_scoring", f"WITH {_RAW} SELECT customer_id, {R('raw', 'raw')}, {R('1 / (1 + exp(-CAST(raw AS DOUBLE)))', 'prediction')} FROM sr")
def m21(spark, d):
    return md.score_terms(_long(spark, d), "customer_id", _terms(spark), 0.1)


@query("M22_term_shape", f"SELECT 'balance' AS term, i AS step, {R('e[i + 1]', '\"from\"')}, {R('e[i + 2]', '\"to\"')}, {R('s[i + 1]', 'effect')} FROM (SELECT [0.0, 2500, 5000, 7500, 12500] AS e, [-0.5, -0.1, 0.2, 0.6] AS s), (SELECT unnest([0, 1, 2]) AS i) UNION ALL SELECT 'balance', 3, 7500.0, 12500.0, 0.6")
def m22(spark, d):
    return md.term_shape(_terms(spark).withColumns({"low": F.lit(-2.0), "high": F.lit(3.0)}))


@query("M22_importance", f"WITH t AS (SELECT (balance - 5000) / 2500 AS z, segment FROM cu), c AS (SELECT avg(abs(CASE WHEN z < -1 THEN -0.5 WHEN z < 0 THEN -0.1 WHEN z < 1 THEN 0.2 ELSE 0.6 END)) AS b, avg(abs(CASE WHEN segment = 'MACHINERY' THEN 0.3 ELSE -0.05 END)) AS s FROM t) SELECT 'balance' AS variable, {R('b / (b + s)', 'share')} FROM c UNION ALL SELECT 'segment', {R('s / (b + s)', 'share')} FROM c")
def m22b(spark, d):
    j = _long(spark, d).join(F.broadcast(_terms(spark)), "variable")
    z = F.when(F.col("kind") == "numeric", (F.col("number") - F.col("mean")) / F.col("scale")).otherwise((F.col("text") == F.col("category")).cast("double"))
    from tidemark.functions.columns import bin_right

    j = j.withColumn("z", z).withColumn("contribution", F.get("scores", bin_right("z", F.col("cuts")) + 1))
    return md.term_importance(j)


@query("M23_linear_score", f"SELECT id, {R('0.5 + 2 * a - 1.5 * b', 'score')} FROM pr")
def m23(spark, d):
    p = predictions(spark, d)
    return p.select("id", md.linear_score(p, {"a": 2.0, "b": -1.5}, 0.5).alias("score"))


@query("M24_what_if", "SELECT CAST(id AS BIGINT) AS id, CAST(round_even(0.5 * (id % 10) + 0.25 * least(300 / 600.0, 1) + 0.25 * (CAST(status = 'F' AS INT) + 1) / 2, 0) AS BIGINT) AS satisfaction_score FROM pr")
def m24(spark, d):
    p = predictions(spark, d).select("id", (F.col("id") % 10).cast("double").alias("base_satisfaction"), (F.col("status") == "F").alias("card"), F.lit(True).alias("loan"), F.lit(0.0).alias("tx_count"))
    return md.what_if(p, {"tx_count": 300.0}, ["card", "loan"]).select("id", "satisfaction_score")


@query("M25_linear_explanation", f"SELECT id, 'a' AS variable, {R('2 * (a - avg(a) OVER ())', 'contribution')} FROM pr UNION ALL SELECT id, 'b', {R('-1.5 * (b - avg(b) OVER ())', 'contribution')} FROM pr")
def m25(spark, d):
    return md.linear_explanation(predictions(spark, d), "id", {"a": 2.0, "b": -1.5})


@query("M19_shapley", f"WITH v AS (SELECT id, a * b / 1000 AS ab, a AS x, b AS z FROM pr) SELECT id, {R('0.5 * x + 0.5 * (ab - z)', 'phi_a')}, {R('0.5 * z + 0.5 * (ab - x)', 'phi_b')} FROM v")
def m19(spark, d):
    def value(s):
        return F.col("a") * F.col("b") / 1000 if len(s) == 2 else F.col("a") if s == {"a"} else F.col("b") if s == {"b"} else F.lit(0.0)

    phi = md.shapley(value, ["a", "b"])
    return predictions(spark, d).select("id", phi["a"].alias("phi_a"), phi["b"].alias("phi_b"))


@query("M26_forest", f"SELECT id, {R('1 + 0.5 * (CASE WHEN a <= 200 THEN CASE WHEN b <= 100 THEN 1.0 ELSE 2.0 END ELSE 5.0 END + CASE WHEN b <= 300 THEN -1.0 ELSE 1.0 END)', 'score')} FROM pr")
def m26(spark, d):
    trees = [{"variable": [0, 1, -1, -1, -1], "cut": [200, 100, 0, 0, 0], "value": [0, 0, 5.0, 1.0, 2.0]}, {"variable": [1, -1, -1], "cut": [300, 0, 0], "value": [0, -1.0, 1.0]}]
    return md.evaluate_forest(predictions(spark, d), "id", ["a", "b"], trees, 1.0, 0.5)


@query("M27_out_of_fold", f"WITH f AS (SELECT id, priority, y, id % 5 AS k FROM pr), g AS (SELECT priority, k, sum(y) AS s, count(*) AS n FROM f GROUP BY 1, 2), o AS (SELECT priority, k, (sum(s) OVER (PARTITION BY priority) - s) / (sum(n) OVER (PARTITION BY priority) - n) AS p FROM g) SELECT id, {R('p', 'prediction')} FROM f JOIN o ON f.priority = o.priority AND f.k = o.k")
def m27(spark, d):
    from pyspark.sql import Window

    f = predictions(spark, d).withColumn("k", F.col("id") % 5)
    g = f.groupBy("priority", "k").agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    w = Window.partitionBy("priority")
    o = g.select("priority", "k", ((F.sum("s").over(w) - F.col("s")) / (F.sum("n").over(w) - F.col("n"))).alias("prediction"))
    return f.join(o, ["priority", "k"]).select("id", "prediction")


@query("M28_permutation_importance", f"WITH b AS (SELECT id, y, a, floor({DICE('id', 42)} * 64) AS b FROM pr), p AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY id) AS i, row_number() OVER (PARTITION BY b ORDER BY {DICE('id', 43)}, id) AS j FROM b), g AS (SELECT (SELECT sqrt(avg((a - y) ** 2)) FROM pr) AS base, sqrt(avg((q.a - p.y) ** 2)) AS shuffled FROM p JOIN p q ON p.b = q.b AND p.i = q.j) SELECT {R('base', 'base')}, {R('shuffled', 'shuffled')}, {R('shuffled - base', 'importance')} FROM g")
def m28(spark, d):
    return md.permutation_importance(predictions(spark, d), "id", "a", lambda df: df.withColumn("prediction", F.col("a")), F.sqrt(F.avg((F.col("prediction") - F.col("y")) ** 2)))


@query("M28_learning_curve", " UNION ALL ".join(f"SELECT {f}::DOUBLE AS fraction, count(*) AS n, {R('avg(y)', 'mean')} FROM pr WHERE {DICE('id', 42)} < {f}" for f in (0.1, 0.3, 1.0)))
def m28b(spark, d):
    return md.learning_curve(predictions(spark, d), "id", [0.1, 0.3, 1.0], [F.count("*").alias("n"), F.avg("y").alias("mean")])


@query("M28_sensitivity", f"WITH s AS (SELECT stddev_samp(a) AS sa, stddev_samp(b) AS sb, avg(a * b) AS m FROM pr) SELECT 'a' AS variable, {R('avg((a - sa) * b) - any_value(m)', 'low')}, {R('avg((a + sa) * b) - any_value(m)', 'high')} FROM pr, s UNION ALL SELECT 'b', {R('avg(a * (b - sb)) - any_value(m)', 'low')}, {R('avg(a * (b + sb)) - any_value(m)', 'high')} FROM pr, s")
def m28c(spark, d):
    return md.sensitivity(predictions(spark, d), ["a", "b"], lambda c: c["a"] * c["b"])


@query("M29_outliers", f"WITH o AS (SELECT y, CASE WHEN {DICE('id', 42)} < 0.05 THEN a * 3 ELSE a END AS a FROM pr) SELECT count(*) AS n, {R('sqrt(avg((a - y) ** 2))', 'rmse')}, {R('avg(abs(a - y))', 'mae')}, {R('1 - avg((a - y) ** 2) / var_pop(y)', 'r2')}, {R('avg(abs(a - y) / nullif(abs(y), 0))', 'mape')}, {R('avg(a - y)', 'bias')} FROM o")
def m29c(spark, d):
    return mt.regression_metrics(md.add_outliers(predictions(spark, d), "a", "id", 0.05, 3.0), "y", "a")


@query("M29_sample_size", " UNION ALL ".join(f"SELECT {f}::DOUBLE AS fraction, count(*) AS n, {R('sqrt(avg((a - y) ** 2))', 'rmse')} FROM pr WHERE {DICE('id', 42)} < {f}" for f in (0.2, 0.5, 1.0)))
def m29d(spark, d):
    return md.learning_curve(predictions(spark, d), "id", [0.2, 0.5, 1.0], [F.count("*").alias("n"), F.sqrt(F.avg((F.col("a") - F.col("y")) ** 2)).alias("rmse")])


@query("M25_bayes_explanation", "WITH c AS (SELECT id, CAST(y > 150 AS INT) AS k, a, b FROM pr), g AS (SELECT " + ", ".join(f"avg({v}) FILTER (WHERE k = {k}) AS m{k}{v}, var_pop({v}) FILTER (WHERE k = {k}) AS v{k}{v}" for v in "ab" for k in (0, 1)) + " FROM c), l AS (SELECT id, " + ", ".join(f"-0.5 * (ln(v1{v}) + ({v} - m1{v}) ** 2 / v1{v}) + 0.5 * (ln(v0{v}) + ({v} - m0{v}) ** 2 / v0{v}) AS l{v}" for v in "ab") + " FROM c, g) " + " UNION ALL ".join(f"SELECT id, '{v}' AS variable, {R(f'l{v} - avg(l{v}) OVER ()', 'contribution')} FROM l" for v in "ab"))
def m25b(spark, d):
    return md.bayes_explanation(predictions(spark, d).withColumn("k", (F.col("y") > 150).cast("int")), "id", "k", ["a", "b"])


_VALUES = "v AS (SELECT id, 3.0::DOUBLE AS v0, CASE WHEN a <= 200 THEN 5 / 3.0::DOUBLE ELSE 5.0 END AS va, 2 + 0.6::DOUBLE * CASE WHEN b <= 100 THEN 1.0 ELSE 2.0 END AS vb, CASE WHEN a > 200 THEN 5.0 WHEN b <= 100 THEN 1.0 ELSE 2.0 END AS vab FROM pr)"


@query("M25_tree_explanation", f"WITH {_VALUES} SELECT id, 'a' AS variable, {R('0.25 * (va - v0 + vab - vb)', 'contribution')} FROM v UNION ALL SELECT id, 'b', {R('0.25 * (vb - v0 + vab - va)', 'contribution')} FROM v")
def m25c(spark, d):
    tree = {"variable": [0, 1, -1, -1, -1], "cut": [200, 100, 0, 0, 0], "value": [0, 0, 5.0, 1.0, 2.0], "cover": [10, 6, 4, 2, 4]}
    return md.tree_explanation(predictions(spark, d), "id", ["a", "b"], [tree], 0.5)


@query("M25_permutation_explanation", f"WITH g AS (SELECT a AS xa, b AS xb FROM pr ORDER BY {DICE('id', 42)}, id LIMIT 20), m AS (SELECT avg(xa) AS ma, avg(xb) AS mb, avg(xa * xb) AS mab FROM g) SELECT id, 'a' AS variable, {R('0.5 * (a * mb - mab + a * b - ma * b)', 'contribution')} FROM pr, m UNION ALL SELECT id, 'b', {R('0.5 * (b * ma - mab + a * b - mb * a)', 'contribution')} FROM pr, m")
def m25d(spark, d):
    from tidemark.functions.columns import dice

    p = predictions(spark, d)
    return md.permutation_explanation(p, "id", ["a", "b"], lambda c: c["a"] * c["b"], p, F.struct(dice(F.col("id"), 42), F.col("id")), most=20, turns=2)


@query("M22_density", f"WITH s AS (SELECT CASE WHEN balance < 2500 THEN 0 WHEN balance < 5000 THEN 1 WHEN balance < 7500 THEN 2 ELSE 3 END AS step FROM cu) SELECT CAST(step AS BIGINT) AS step, count(*) AS n, {R('count(*) / (SELECT count(*) FROM s)::DOUBLE', 'share')} FROM s GROUP BY 1")
def m22c(spark, d):
    return md.term_density(customers(spark, d), "balance", [2500.0, 5000.0, 7500.0])


@query("M22_category_effect", f"SELECT segment, count(*) AS n, {R('avg(CASE WHEN segment = $$MACHINERY$$ THEN 0.3 ELSE -0.05 END)', 'effect')} FROM cu GROUP BY 1")
def m22d(spark, d):
    c = customers(spark, d).withColumn("contribution", F.when(F.col("segment") == "MACHINERY", 0.3).otherwise(-0.05))
    return md.category_effect(c, "segment")


@query("M29_noise", f"WITH o AS (SELECT y, a + 5.0::DOUBLE * sqrt(-2 * ln(greatest({DICE('id', 42)}, 1e-12::DOUBLE))) * cos(2 * pi() * {DICE('id', 43)}) AS a FROM pr) SELECT count(*) AS n, {R('sqrt(avg((a - y) ** 2))', 'rmse')}, {R('avg(abs(a - y))', 'mae')}, {R('1 - avg((a - y) ** 2) / var_pop(y)', 'r2')}, {R('avg(abs(a - y) / nullif(abs(y), 0))', 'mape')}, {R('avg(a - y)', 'bias')} FROM o")
def m29(spark, d):
    p = predictions(spark, d)
    return mt.regression_metrics(md.add_noise(p, "a", "id", 5.0), "y", "a")


@query("M29_leave_group_out", f"WITH g AS (SELECT priority, sum(y) AS s, count(*) AS n FROM pr GROUP BY 1) SELECT priority, {R('(sum(s) OVER () - s) / (sum(n) OVER () - n)', 'mean')} FROM g")
def m29b(spark, d):
    return md.leave_group_out(predictions(spark, d), "priority", {"mean": "y"})


@query("M30_scenario_ablation", f"SELECT 'a' AS scenario, {R('sqrt(avg((a - y) ** 2))', 'rmse')} FROM pr UNION ALL SELECT 'b', {R('sqrt(avg((b - y) ** 2))', 'rmse')} FROM pr UNION ALL SELECT 'a+b', {R('sqrt(avg(((a + b) / 2 - y) ** 2))', 'rmse')} FROM pr")
def m30(spark, d):
    cases = {"a": F.col("a"), "b": F.col("b"), "a+b": (F.col("a") + F.col("b")) / 2}
    wide = predictions(spark, d).agg(*(F.sqrt(F.avg((c - F.col("y")) ** 2)).alias(n) for n, c in cases.items()))
    return wide.select(F.inline(F.array(*(F.struct(F.lit(n).alias("scenario"), F.col(f"`{n}`").alias("rmse")) for n in cases))))


@query("M10_classifiers")
def m10(spark, d):
    """AUC of every classifier of the catalogue on held-out rows."""
    from tidemark.operators import catalogue as cg

    rows, out = cg.vectors(scores(spark, d), ["s", "toxic"], "y"), None
    for name in cg.classifiers():
        p = cg.fitted_scores(rows.filter("id % 3 <> 0"), rows.filter("id % 3 = 0"), ["s", "toxic"], cg.classifiers()[name])
        one = mt.auc(p, "y", "score").select(F.lit(name).alias("model"), "auc")
        out = one if out is None else out.union(one)
    return out


@query("M10_regressors")
def m10b(spark, d):
    """RMSE of every regressor of the catalogue on held-out rows."""
    from tidemark.operators import catalogue as cg

    rows, out = cg.vectors(predictions(spark, d).withColumn("c", F.col("cust") % 17), ["b", "c"], "y"), None
    for name in cg.regressors():
        p = cg.fitted_scores(rows.filter("id % 3 <> 0"), rows.filter("id % 3 = 0"), ["b", "c"], cg.regressors()[name])
        one = mt.regression_metrics(p, "y", "score").select(F.lit(name).alias("model"), "rmse")
        out = one if out is None else out.union(one)
    return out


@query("S_embedding_norms", f"SELECT vec_id, {R('sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)))', 'norm')} FROM embeddings")
def norms(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("norm"))


@query("M7_grid_configs", f"SELECT row_number() OVER (ORDER BY penalty, depth) - 1 AS config, {R('penalty', 'penalty')}, {R('depth', 'depth')} FROM (SELECT unnest([0.1, 1.0, 10.0]) AS penalty) CROSS JOIN (SELECT unnest([2, 4]) AS depth)")
def m7(spark, d):
    from tidemark.operators.search import grid

    return grid(spark, penalty=[0.1, 1.0, 10.0], depth=[2, 4])


@query("M7_random_configs", f"SELECT config, {R(f'exp(ln(0.001::DOUBLE) + {DICE("config", 42)} * (ln(1000.0::DOUBLE) - ln(0.001::DOUBLE)))', 'penalty')} FROM (SELECT unnest(range(0, 20)) AS config)")
def m7b(spark, d):
    from tidemark.operators.search import random_configs

    return random_configs(spark, 20, penalty=(1e-3, 1e3))


def _search_rows(spark, d):
    from tidemark.operators.features import folds

    p = predictions(spark, d).withColumns({"u": (F.col("cust") % 17).cast("double"), "v": ((F.col("cust") * 7) % 23).cast("double")})
    return folds(p, "id", 5)


@query("M7_adaptive_search")
def m7c(spark, d):
    from tidemark.operators.search import search

    return search(_search_rows(spark, d), "id", ["a", "b", "u", "v"], "y")


@query("M9_successive_halving")
def m9b(spark, d):
    from tidemark.operators.search import halving

    return halving(_search_rows(spark, d), "id", ["a", "b", "u", "v"], "y")


@query("M9_nested_cross_validation")
def m9(spark, d):
    from tidemark.operators.features import folds
    from tidemark.operators.search import nested_ridge, random_configs

    p = folds(predictions(spark, d).withColumn("c", F.col("cust") % 17), "id", 5)
    return nested_ridge(p, ["a", "b", "c"], "y", random_configs(spark, 20, penalty=(1e-3, 1e3)))


#: Turns at most and trees of a turn in the queries; the operator's own defaults are 400 and 5.
STEP_TURNS, STEP_TREES = 3, 2


@query("M17_step_mixture_regressor")
def m17(spark, d):
    from tidemark.operators.boosting import fit_steps, step_outputs

    p = predictions(spark, d).select("id", "y", "a", "b", (F.col("cust") % 17).cast("double").alias("c"))
    model = fit_steps(p.filter("id % 3 = 1"), p.filter("id % 6 = 0"), ["a", "b", "c"], "y", warm=100, turns=STEP_TURNS, rounds=STEP_TREES, validation=p.filter("id % 3 = 2"), depth=2, rate=0.5)
    return step_outputs(p.filter("id % 6 = 3"), model, 250.0).select("id", "y", "forecast", "low", "high", "p_exceeds")


@query("M20_step_mixture_classifier")
def m20(spark, d):
    from tidemark.operators.boosting import checkpointed, fit_steps, step_outputs

    p = predictions(spark, d).select("id", "y", "a", "b")
    model = fit_steps(p.filter("id % 3 = 1"), p.filter("id % 6 = 0"), ["a", "b"], "y", warm=100, turns=STEP_TURNS, rounds=STEP_TREES, validation=p.filter("id % 3 = 2"), depth=2, rate=0.5)
    out = checkpointed(step_outputs(p.filter("id % 6 = 3"), model, 250.0).select((F.col("y") > 250).cast("int").alias("label"), "p_exceeds"))  # the ranks read the score more than once
    return mt.auc(out, "label", "p_exceeds")


@query("M20_logistic_boosting")
def m20b(spark, d):
    """AUC and log-loss of trees boosted on the log odds, on held-out rows."""
    from tidemark.functions.columns import sigmoid
    from tidemark.operators.boosting import boost, predict_column

    p = predictions(spark, d).select("id", "a", "b", (F.col("y") > 250).cast("int").alias("label"))
    model = boost(p.filter("id % 3 <> 0"), ["a", "b"], "label", rounds=20, depth=2, rate=0.5, logistic=True)
    out = p.filter("id % 3 = 0").withColumn("p", sigmoid(predict_column(model)))
    return mt.auc(out, "label", "p").select("auc").crossJoin(mt.probability_losses(out, "label", "p").select("log_loss"))


_RARE = "x AS (SELECT id, y AS u, CAST(cust % 17 AS DOUBLE) AS v, CAST((cust * 7) % 23 AS DOUBLE) AS w, CAST(status = 'P' AS INT) AS rare FROM pr), f AS (SELECT * FROM x WHERE rare = 1)"
_PAIR = "power(a.u - b.u, 2) + power(a.v - b.v, 2) + power(a.w - b.w, 2)"
_NEAR = f"n AS MATERIALIZED (SELECT a.id, b.id AS neighbour, {_PAIR} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {_PAIR}, b.id) AS place FROM f a JOIN f b ON a.id <> b.id QUALIFY place <= 5)"
_LACKS = "c AS (SELECT count(*) FILTER (WHERE rare = 0) - sum(rare) AS lacking, sum(rare) AS few FROM x)"


def _rare(spark, d):
    p = predictions(spark, d)
    return p.select("id", F.col("y").alias("u"), (F.col("cust") % 17).cast("double").alias("v"), ((F.col("cust") * 7) % 23).cast("double").alias("w"), (F.col("status") == "P").cast("int").alias("rare"))


@query("M5_neighbours", f"WITH {_RARE}, {_NEAR} SELECT id, place, neighbour, {R('sqrt(d)', 'distance')} FROM n")
def m5a(spark, d):
    few = _rare(spark, d).filter("rare = 1")
    near = nearest(few, few, "id", ["u", "v", "w"])
    return near.select("id", F.posexplode(F.arrays_zip("n", "d")).alias("place", "p")).select("id", (F.col("place") + 1).alias("place"), F.col("p.n").alias("neighbour"), F.col("p.d").alias("distance"))


@query("M5_smote", f"WITH {_RARE}, {_NEAR}, {_LACKS}, k AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS place FROM f), m AS (SELECT id, max(place) AS most FROM n GROUP BY 1), s AS (SELECT unnest(range(CAST(lacking AS BIGINT))) AS s, few FROM c), t AS (SELECT s, id AS base FROM s JOIN k ON k.place = CAST(floor({DICE('s', 42)} * few) AS BIGINT)), g AS (SELECT s, base, neighbour, {DICE('s', 44)} AS gap FROM t JOIN m ON base = m.id JOIN n ON n.id = base AND n.place = CAST(floor({DICE('s', 43)} * most) AS BIGINT) + 1) SELECT s, base, neighbour, {R('gap', 'gap')}, {R('a.u + gap * (b.u - a.u)', 'u')}, {R('a.v + gap * (b.v - a.v)', 'v')}, {R('a.w + gap * (b.w - a.w)', 'w')} FROM g JOIN f a ON a.id = base JOIN f b ON b.id = neighbour")
def m5b(spark, d):
    return smote(_rare(spark, d), "id", "rare", ["u", "v", "w"], 1)


@query("M5_adasyn_shares", f"WITH {_RARE}, {_LACKS}, e AS (SELECT a.id, b.rare, row_number() OVER (PARTITION BY a.id ORDER BY {_PAIR}, b.id) AS place FROM f a JOIN x b ON a.id <> b.id QUALIFY place <= 5), o AS (SELECT id, sum(1 - rare) / 5.0::DOUBLE AS others FROM e GROUP BY 1) SELECT id, {R('others', 'others')}, CAST(round_even(others / (SELECT sum(others) FROM o) * lacking, 0) AS BIGINT) AS copies FROM o, c")
def m5c(spark, d):
    return adasyn_shares(_rare(spark, d), "id", "rare", ["u", "v", "w"], 1)


@query("M5_adasyn")
def m5d(spark, d):
    return adasyn(_rare(spark, d), "id", "rare", ["u", "v", "w"], 1)


def _additive(spark, d):
    p = predictions(spark, d)
    rows = p.select("id", "y", F.col("a").alias("u"), (F.col("cust") % 17).cast("double").alias("v"), ((F.col("cust") * 7) % 23).cast("double").alias("w"))
    return rows, ad.fit_additive(rows, "id", ["u", "v", "w"], "y", pairs=1)


@query("M10_additive_terms")
def m10c(spark, d):
    _, m = _additive(spark, d)
    main = [(f, "", k, 0, float(s)) for f in m.features for k, s in enumerate(m.scores[f])]
    both = [(a, b, i, j, float(s)) for (a, b), t in m.pairs.items() for i, row in enumerate(t) for j, s in enumerate(row)]
    return spark.createDataFrame(main + both, "term string, other string, slot long, other_slot long, score double")


@query("M10_additive_fit")
def m10d(spark, d):
    rows, m = _additive(spark, d)
    p = ad.additive_column(m)
    return rows.withColumn("p", p).groupBy((F.floor(F.col("y") / 50) * 50).alias("from")).agg(F.count("*").alias("n"), F.avg("p").alias("predicted"), F.sqrt(F.avg((F.col("y") - F.col("p")) ** 2)).alias("rmse"))
