"""Window queries W1 to W23."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import order as od
from tidemark.plans.registry import R, query
from tidemark.plans.roles import customers, fold_values, predictions, scores

_AVG = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"


@query("W1_average_rank", f"SELECT id, {R(_AVG.format('s'), 'rank')} FROM sc")
def w1(spark, d):
    return od.average_rank(scores(spark, d), "s").select("id", "rank")


@query("W2_min_rank_winner", "SELECT block, treatment, rank() OVER (PARTITION BY block ORDER BY value DESC) AS place, CAST(rank() OVER (PARTITION BY block ORDER BY value DESC) = 1 AS BIGINT) AS wins FROM fo")
def w2(spark, d):
    r = F.rank().over(Window.partitionBy("block").orderBy(F.col("value").desc()))
    return fold_values(spark, d).select("block", "treatment", r.alias("place"), (r == 1).cast("long").alias("wins"))


@query("W3_rank_in_block", f"SELECT block, treatment, {R('rank() OVER (PARTITION BY block ORDER BY value DESC) + (count(*) OVER (PARTITION BY block, value) - 1) / 2.0', 'rank')} FROM fo")
def w3(spark, d):
    return fold_values(spark, d).select("block", "treatment", od.group_rank("value", ["block"], descending=True).alias("rank"))


@query("W4_percent_rank", f"SELECT id, {R('(' + _AVG.format('s') + ') / count(*) OVER ()', 'pct')} FROM sc")
def w4(spark, d):
    return od.percent_rank_avg(scores(spark, d), "s").select("id", "pct")


@query("W5_place_of_score", f"WITH x AS (SELECT unnest([500.0, 1500.0, 4000.0]) AS x) SELECT {R('x', 'x')}, {R('(SELECT count(*) FROM sc WHERE s <= x) * 1.0 / (SELECT count(*) FROM sc)', 'percentile')}, (SELECT count(*) FROM sc WHERE s > x) + 1 AS place FROM x")
def w5(spark, d):
    return od.place_of(scores(spark, d), "s", spark.createDataFrame([(500.0,), (1500.0,), (4000.0,)], "x double"))


@query("W6_difference", f"WITH m AS (SELECT treatment, block, value FROM fo) SELECT treatment, block, {R('value - lag(value) OVER (PARTITION BY treatment ORDER BY block)', 'step')} FROM m")
def w6(spark, d):
    return fold_values(spark, d).select("treatment", "block", (F.col("value") - F.lag("value").over(Window.partitionBy("treatment").orderBy("block"))).alias("step"))


@query("W7_running_sum", "WITH k AS (SELECT s, sum(y)::BIGINT AS pos, count(*) AS n FROM sc GROUP BY 1) SELECT s, sum(pos) OVER (ORDER BY s DESC)::BIGINT AS tp, sum(n) OVER (ORDER BY s DESC)::BIGINT AS upto FROM k")
def w7(spark, d):
    k = scores(spark, d).groupBy("s").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    return od.running_totals(k, "s", {"tp": "pos", "upto": "n"}, descending=True).select("s", "tp", "upto")


@query("W8_running_max", f"SELECT treatment, block, {R('max(value) OVER (PARTITION BY treatment ORDER BY block)', 'best')} FROM fo")
def w8(spark, d):
    w = Window.partitionBy("treatment").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    return fold_values(spark, d).select("treatment", "block", F.max("value").over(w).alias("best"))


@query("W9_distinct_per_group", "WITH k AS (SELECT segment, count(DISTINCT nation) AS n FROM cu GROUP BY 1) SELECT customer_id, n FROM cu JOIN k ON cu.segment = k.segment")
def w9(spark, d):
    c = customers(spark, d)
    return c.join(c.groupBy("segment").agg(F.count_distinct("nation").alias("n")), "segment").select("customer_id", "n")


@query("W10_arg_max_row", "SELECT treatment, block FROM (SELECT *, row_number() OVER (PARTITION BY treatment ORDER BY value DESC, block) AS k FROM fo) WHERE k = 1")
def w10(spark, d):
    return od.arg_max(fold_values(spark, d), "value", ["treatment"], ["block"]).select("treatment", "block")


@query("W11_runner_up", f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY value DESC, treatment) AS k, lead(treatment) OVER (PARTITION BY block ORDER BY value DESC, treatment) AS second, value - lead(value) OVER (PARTITION BY block ORDER BY value DESC, treatment) AS margin, count(*) OVER (PARTITION BY block, value) - 1 AS ties FROM fo) SELECT block, treatment AS best, second, {R('margin', 'margin')}, ties FROM r WHERE k = 1")
def w11(spark, d):
    w = Window.partitionBy("block").orderBy(F.col("value").desc(), "treatment")
    r = fold_values(spark, d).select("block", F.col("treatment").alias("best"), F.row_number().over(w).alias("k"), F.lead("treatment").over(w).alias("second"), (F.col("value") - F.lead("value").over(w)).alias("margin"), (F.count("*").over(Window.partitionBy("block", "value")) - 1).alias("ties"))
    return r.filter("k = 1").drop("k")


@query("W12_top_fraction", "WITH r AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS k, round_even(0.25 * count(*) OVER (), 0) AS n FROM sc) SELECT id, CAST(k <= n AS BIGINT) AS selected FROM r")
def w12(spark, d):
    return od.top_fraction(scores(spark, d), "s", 0.25, "id").select("id", "selected")


@query("W13_autocorrelation", f"WITH v AS (SELECT id, a - y - (SELECT avg(a - y) FROM pr) AS e FROM pr), l AS (SELECT e, lag(e, 1) OVER (ORDER BY id) AS e1, lag(e, 2) OVER (ORDER BY id) AS e2 FROM v) SELECT 0 AS k, {R('sum(e * e) / count(*)', 'acov')}, 1.0 AS acf FROM l UNION ALL SELECT 1, {R('sum(e * e1) / count(*)', 'acov')}, {R('sum(e * e1) / sum(e * e)', 'acf')} FROM l UNION ALL SELECT 2, {R('sum(e * e2) / count(*)', 'acov')}, {R('sum(e * e2) / sum(e * e)', 'acf')} FROM l")
def w13(spark, d):
    return od.lag_autocovariance(predictions(spark, d).select("id", (F.col("a") - F.col("y")).alias("e")), "e", "id", 2)


@query("W14_equal_chunks", "SELECT treatment, block, ntile(7) OVER (PARTITION BY treatment ORDER BY block) AS chunk FROM fo")
def w14(spark, d):
    return fold_values(spark, d).select("treatment", "block", F.ntile(7).over(Window.partitionBy("treatment").orderBy("block")).alias("chunk"))


@query("A32_position_deciles", f"WITH t AS (SELECT customer_id, balance, ntile(10) OVER (ORDER BY customer_id) AS decile FROM cu) SELECT decile, count(*) AS n, {R('avg(balance)', 'mean')} FROM t GROUP BY 1")
def a32(spark, d):
    c = customers(spark, d)
    n = c.agg(F.count("*").alias("total"))
    place = od.value_ranks(c, "customer_id").select("customer_id", (F.col("rank_min") - 1).alias("i"))
    j = c.join(place, "customer_id").crossJoin(F.broadcast(n))
    size, extra = F.floor(F.col("total") / 10), F.col("total") % 10
    edge = extra * (size + 1)
    chunk = F.when(F.col("i") < edge, F.floor(F.col("i") / (size + 1))).otherwise(extra + F.floor((F.col("i") - edge) / size)) + 1
    return j.groupBy(chunk.alias("decile")).agg(F.count("*").alias("n"), F.avg("balance").alias("mean"))


@query("W15_runs", "WITH l AS (SELECT cust, id, status, lag(status) OVER (PARTITION BY cust ORDER BY id) AS prev FROM pr) SELECT cust, CAST(sum(CASE WHEN prev IS NULL OR prev <> status THEN 1 ELSE 0 END) AS BIGINT) AS runs FROM l GROUP BY 1")
def w15(spark, d):
    prev = F.lag("status").over(Window.partitionBy("cust").orderBy("id"))
    return predictions(spark, d).withColumn("new", F.coalesce((prev != F.col("status")).cast("int"), F.lit(1))).groupBy("cust").agg(F.sum("new").alias("runs"))


@query("W16_first_reaching", "SELECT treatment, min(block) FILTER (WHERE value >= 255000) AS first FROM fo GROUP BY 1")
def w16(spark, d):
    return fold_values(spark, d).groupBy("treatment").agg(F.min(F.when(F.col("value") >= 255000, F.col("block"))).alias("first"))


@query("W17_resampled_grid", "WITH t AS (SELECT treatment, block, row_number() OVER (PARTITION BY treatment ORDER BY block) - 1 AS step, count(*) OVER (PARTITION BY treatment) AS n FROM fo) SELECT treatment, g, block FROM t, (SELECT unnest(range(1, 11)) AS g) WHERE step = least(ceil(round(g / 10.0 * n, 9)) - 1, n - 1)")
def w17(spark, d):
    t = fold_values(spark, d).select("treatment", "block", (F.row_number().over(Window.partitionBy("treatment").orderBy("block")) - 1).alias("step"), F.count("*").over(Window.partitionBy("treatment")).alias("n"))
    t = t.withColumn("g", F.explode(F.sequence(F.lit(1), F.lit(10))))
    return t.filter(F.col("step") == F.least(F.ceil(F.round(F.col("g") / 10.0 * F.col("n"), 9)) - 1, F.col("n") - 1)).select("treatment", "g", "block")


@query("W18_mixed_sort", "SELECT city, n, row_number() OVER (ORDER BY n DESC, city) AS place FROM (SELECT city, count(*) AS n FROM cu GROUP BY 1)")
def w18(spark, d):
    g = customers(spark, d).groupBy("city").agg(F.count("*").alias("n"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.col("n").desc(), "city")))


@query("W19_sort_by_absolute", f"WITH c AS (SELECT 's' AS v, corr(s, y) AS r FROM sc UNION ALL SELECT 'p', corr(p, y) FROM sc UNION ALL SELECT 'toxic', corr(toxic, y) FROM sc) SELECT v, {R('r', 'r')}, row_number() OVER (ORDER BY abs(r) DESC, v) AS place FROM c")
def w19(spark, d):
    from tidemark.operators.profile import pearson

    c = pearson(scores(spark, d), [(v, "y") for v in ("s", "p", "toxic")]).select(F.col("a").alias("v"), "r")
    return c.withColumn("place", F.row_number().over(Window.orderBy(F.abs("r").desc(), "v")))


@query("W20_largest_gap", f"WITH m AS (SELECT city, avg(balance) AS v FROM cu GROUP BY 1), l AS (SELECT v, lead(v) OVER (ORDER BY v) - v AS gap FROM m) SELECT {R('arg_max(v, gap)', 'below')}, {R('max(gap)', 'gap')} FROM l")
def w20(spark, d):
    m = customers(spark, d).groupBy("city").agg(F.avg("balance").alias("v"))
    return m.withColumn("gap", F.lead("v").over(Window.orderBy("v")) - F.col("v")).agg(F.max_by("v", "gap").alias("below"), F.max("gap").alias("gap"))


@query("W21_top_k", f"SELECT customer_id, {R('balance', 'balance')} FROM cu ORDER BY balance DESC, customer_id LIMIT 10")
def w21(spark, d):
    return customers(spark, d).orderBy(F.col("balance").desc(), "customer_id").select("customer_id", "balance").limit(10)


@query("W22_alternating_stack", "WITH b AS (SELECT customer_id, floor(balance / 500) AS bin, row_number() OVER (PARTITION BY floor(balance / 500) ORDER BY balance, customer_id) - 1 AS k FROM cu) SELECT customer_id, CAST(ceil(k / 2.0) * CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END AS BIGINT) AS height FROM b")
def w22(spark, d):
    k = F.row_number().over(Window.partitionBy(F.floor(F.col("balance") / 500)).orderBy("balance", "customer_id")) - 1
    return customers(spark, d).withColumn("k", k).select("customer_id", (F.ceil(F.col("k") / 2.0) * F.when(F.col("k") % 2 == 1, 1).otherwise(-1)).alias("height"))


@query("W23_value_chains", f"WITH v AS (SELECT DISTINCT customer_id % 7 AS g, balance FROM cu), l AS (SELECT g, balance, CASE WHEN balance - lag(balance) OVER (PARTITION BY g ORDER BY balance) > 100 THEN 1 ELSE 0 END AS new FROM v), c AS (SELECT g, balance, sum(new) OVER (PARTITION BY g ORDER BY balance) AS chain FROM l) SELECT g, CAST(chain AS BIGINT) AS chain, count(*) AS n, {R('avg(balance)', 'mean')} FROM c GROUP BY 1, 2")
def w23(spark, d):
    v = customers(spark, d).select((F.col("customer_id") % 7).alias("g"), "balance").distinct()
    w = Window.partitionBy("g").orderBy("balance")
    new = F.coalesce((F.col("balance") - F.lag("balance").over(w) > 100).cast("long"), F.lit(0))
    c = v.withColumn("new", new).withColumn("chain", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return c.groupBy("g", "chain").agg(F.count("*").alias("n"), F.avg("balance").alias("mean"))
