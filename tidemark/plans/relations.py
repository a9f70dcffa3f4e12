"""Relational queries: predicates, joins, set operations, pivots."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.columns import branch, recode
from tidemark.operators import profile as pf
from tidemark.operators import relational as rl
from tidemark.plans.registry import R, query
from tidemark.plans.roles import PRIORITIES, TYPES, customers, fold_values, predictions, scores, table, transactions


@query("P1_drop_columns", f"SELECT customer_id, {R('balance', 'balance')} FROM cu")
def p1(spark, d):
    return customers(spark, d).drop("segment", "city", "nation")


@query("P2_fill_structural", "SELECT cu.customer_id, coalesce(n, 0) AS n FROM cu LEFT JOIN (SELECT customer_id, count(*) AS n FROM tx GROUP BY 1) f ON cu.customer_id = f.customer_id")
def p2(spark, d):
    f = transactions(spark, d).groupBy("customer_id").agg(F.count("*").alias("n"))
    return customers(spark, d).join(f, "customer_id", "left").select("customer_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("P4_columns_by_kind", "SELECT 'numeric' AS kind, 'customer_id' AS name UNION ALL SELECT 'numeric', 'amount' UNION ALL SELECT 'date', 'date' UNION ALL SELECT 'text', 'type'")
def p4(spark, d):
    return spark.createDataFrame([(k, c) for k, cs in rl.columns_by_kind(transactions(spark, d)).items() for c in cs], "kind string, name string")


@query("P6_lookup_one", f"SELECT customer_id, {R('balance', 'balance')}, segment FROM cu WHERE customer_id = 7")
def p6(spark, d):
    return rl.lookup_one(customers(spark, d), customer_id=7).select("customer_id", "balance", "segment")


@query("P7_facets", "SELECT customer_id FROM cu WHERE segment = 'MACHINERY' AND balance BETWEEN 1000 - 1e-9 AND 6000 + 1e-9")
def p7(spark, d):
    return rl.facets(customers(spark, d), {"segment": "MACHINERY", "city": None}, {"balance": (6000, 1000)}).select("customer_id")


@query("P8_minimum_support", "SELECT city, segment, count(*) AS n FROM cu GROUP BY 1, 2 HAVING count(*) >= 15")
def p8(spark, d):
    return rl.with_support(customers(spark, d).groupBy("city", "segment").agg(F.count("*").alias("n")), "n", 15)


@query("P9_text_predicate", "SELECT id FROM pr WHERE status = 'F' AND priority <> '5-LOW' AND y > 300")
def p9(spark, d):
    return predictions(spark, d).filter("status = 'F' AND priority <> '5-LOW' AND y > 300").select("id")


@query("P10_recode", "SELECT CASE priority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'middle' ELSE 'low' END AS band, count(*) AS n FROM pr GROUP BY 1")
def p10(spark, d):
    return predictions(spark, d).groupBy(recode("priority", {"1-URGENT": "high", "2-HIGH": "high", "3-MEDIUM": "middle"}, "low").alias("band")).agg(F.count("*").alias("n"))


@query("P11_branches", "SELECT CASE WHEN y = 1 AND s > 1500 THEN 'TP' WHEN y = 0 AND s > 1500 THEN 'FP' WHEN y = 1 THEN 'FN' ELSE 'TN' END AS outcome, count(*) AS n FROM sc GROUP BY 1")
def p11(spark, d):
    from tidemark.operators.metrics import outcome

    return scores(spark, d).withColumn("c", (F.col("s") > 1500).cast("int")).groupBy(outcome("y", "c").alias("outcome")).agg(F.count("*").alias("n"))


@query("P12_sign_flip", f"SELECT id, {R('CASE WHEN status = chr(70) THEN -a ELSE a END', 'metric')} FROM pr")
def p12(spark, d):
    return predictions(spark, d).select("id", branch((F.col("status") == "F", -F.col("a")), otherwise=F.col("a")).alias("metric"))


@query("P14_clip", f"SELECT customer_id, {R('least(greatest(balance, 0), 9000)', 'balance')} FROM cu")
def p14(spark, d):
    from tidemark.functions.columns import clip

    return customers(spark, d).select("customer_id", clip("balance", 0.0, 9000.0).alias("balance"))


@query("P15_contiguous_cohorts", "WITH v AS (SELECT DISTINCT nation FROM cu WHERE nation % 5 <> 3), g AS (SELECT nation, nation - row_number() OVER (ORDER BY nation) AS k FROM v) SELECT min(nation) AS low, max(nation) AS high, count(*) AS n FROM g GROUP BY k")
def p15(spark, d):
    from tidemark.operators.order import islands

    return islands(customers(spark, d).filter("nation % 5 <> 3"), "nation").groupBy("island").agg(F.min("nation").alias("low"), F.max("nation").alias("high"), F.count("*").alias("n")).drop("island")


@query("P16_list_order", "WITH k AS (SELECT priority, count(*) AS n FROM pr GROUP BY 1) SELECT priority, n, row_number() OVER (ORDER BY CASE priority WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END, priority) AS place FROM k")
def p16(spark, d):
    from pyspark.sql import Window

    g = predictions(spark, d).groupBy("priority").agg(F.count("*").alias("n"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(*rl.by_order_list("priority", ["3-MEDIUM", "1-URGENT"]))))


@query("P17_nice_limits", f"SELECT {R('min(balance)', 'low')}, {R('max(balance)', 'high')}, {R('pow(10, floor(log10(max(balance) - min(balance))) - 2)', 'step')} FROM cu")
def p17(spark, d):
    return rl.nice_limits(customers(spark, d), "balance")


@query("P18_violations", "SELECT customer_id, concat_ws('; ', CASE WHEN balance < 0 OR balance > 5000 THEN 'balance: out of range' END, CASE WHEN segment NOT IN ('BUILDING', 'MACHINERY') THEN 'segment: unknown category' END, CASE WHEN nation > 12 THEN 'nation: out of range' END) AS violations FROM cu")
def p18(spark, d):
    rules = {"balance": {"kind": "number", "min": 0, "max": 5000}, "segment": {"kind": "category", "levels": ["BUILDING", "MACHINERY"]}, "nation": {"kind": "integer", "min": 0, "max": 12}}
    return rl.violations(customers(spark, d), rules).select("customer_id", F.array_join("violations", "; ").alias("violations"))


@query("P19_typed_row", "SELECT CAST(7 AS BIGINT) AS customer_id, CAST(1.5 AS DOUBLE) AS balance, true AS active, 'x' AS segment")
def p19(spark, d):
    return spark.createDataFrame([("7", "1.5", "true", "x")], "customer_id string, balance string, active string, segment string").select(F.col("customer_id").cast("long"), F.col("balance").cast("double"), F.col("active").cast("boolean"), "segment")


@query("P20_suffixed_join", "WITH k AS (SELECT status, priority, count(*) AS n, min(id) AS first FROM pr GROUP BY 1, 2) SELECT a.status, a.priority, a.n, a.first, b.n AS n_test, b.first AS first_test FROM k a LEFT JOIN (SELECT * FROM k WHERE n > 1000) b ON a.status = b.status AND a.priority = b.priority")
def p20(spark, d):
    k = predictions(spark, d).groupBy("status", "priority").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    return rl.suffixed_join(k, k.filter("n > 1000"), ["status", "priority"], "_test")


@query("P21_random_other_row")
def p21(spark, d):
    return rl.sample_rows(customers(spark, d).filter("segment = 'MACHINERY' AND customer_id <> 7"), "customer_id", 1, seed=3)


@query("P22_fixed_sample")
def p22(spark, d):
    return rl.sample_rows(customers(spark, d), "customer_id", 100)


@query("P23_split_label", "SELECT cu.customer_id, CASE WHEN t.customer_id IS NOT NULL THEN 'train' ELSE 'test' END AS part FROM cu LEFT JOIN (SELECT DISTINCT customer_id FROM tx) t ON cu.customer_id = t.customer_id")
def p23(spark, d):
    t = transactions(spark, d).select("customer_id").distinct().withColumn("t", F.lit(1))
    return customers(spark, d).join(t, "customer_id", "left").select("customer_id", F.when(F.col("t") == 1, "train").otherwise("test").alias("part"))


@query("P24_groups_of_size", "SELECT id FROM (SELECT id, count(*) OVER (PARTITION BY cust) AS n FROM pr) WHERE n = 3")
def p24(spark, d):
    return rl.groups_of_size(predictions(spark, d), ["cust"], 3).select("id")


@query("J3_inner_multi_key", "WITH k AS (SELECT status, priority, min(id) AS first FROM pr GROUP BY 1, 2) SELECT pr.id FROM pr JOIN k ON pr.status = k.status AND pr.priority = k.priority AND pr.id = k.first")
def j3(spark, d):
    p = predictions(spark, d)
    k = p.groupBy("status", "priority").agg(F.min("id").alias("id"))
    return p.join(k, ["status", "priority", "id"]).select("id")


@query("J4_left_four_keys", "WITH l AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT * FROM l WHERE l_linenumber = 1) SELECT l.l_orderkey, l.l_linenumber, l.l_returnflag, l.l_linestatus, r.n AS n_first FROM l LEFT JOIN r USING (l_orderkey, l_linenumber, l_returnflag, l_linestatus)")
def j4(spark, d):
    keys = ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"]
    g = table(spark, d, "lineitem").groupBy(*keys).agg(F.count("*").alias("n"))
    return g.select(*keys).join(g.filter("l_linenumber = 1").withColumnRenamed("n", "n_first"), keys, "left")


@query("J5_left_reconciliation", f"SELECT cu.customer_id, n, {R('total', 'total')} FROM cu LEFT JOIN (SELECT customer_id, count(*) AS n, sum(amount) AS total FROM tx GROUP BY 1) r ON cu.customer_id = r.customer_id")
def j5(spark, d):
    r = transactions(spark, d).groupBy("customer_id").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))
    return customers(spark, d).select("customer_id").join(r, "customer_id", "left")


@query("J8_key_differences", "SELECT 'only_a' AS side, count(*) AS n FROM (SELECT customer_id FROM tx EXCEPT SELECT customer_id FROM cu) UNION ALL SELECT 'only_b', count(*) FROM (SELECT customer_id FROM cu EXCEPT SELECT customer_id FROM tx)")
def j8(spark, d):
    return rl.key_differences(transactions(spark, d), customers(spark, d), "customer_id")


@query("J9_common_rows", "SELECT segment, nation FROM cu WHERE nation < 12 INTERSECT SELECT segment, nation FROM cu WHERE nation > 8")
def j9(spark, d):
    c = customers(spark, d).select("segment", "nation")
    return rl.common_rows(c.filter("nation < 12"), c.filter("nation > 8"))


@query("J10_align", f"SELECT t.customer_id, {R('balance', 'balance')} FROM (SELECT DISTINCT customer_id FROM tx) t LEFT JOIN cu ON t.customer_id = cu.customer_id")
def j10(spark, d):
    return rl.align(customers(spark, d), transactions(spark, d).select("customer_id").distinct(), "customer_id").select("customer_id", "balance")


@query("J11_map_lookup", f"WITH m AS (SELECT segment, avg(balance) AS mean FROM cu GROUP BY 1) SELECT customer_id, {R('mean', 'segment_mean')} FROM cu JOIN m ON cu.segment = m.segment")
def j11(spark, d):
    c = customers(spark, d)
    return c.join(c.groupBy("segment").agg(F.avg("balance").alias("segment_mean")), "segment").select("customer_id", "segment_mean")


@query("J12_group_mean", f"SELECT customer_id, {R('balance - avg(balance) OVER (PARTITION BY nation)', 'gap')} FROM cu")
def j12(spark, d):
    from pyspark.sql import Window

    return customers(spark, d).select("customer_id", (F.col("balance") - F.avg("balance").over(Window.partitionBy("nation"))).alias("gap"))


@query("J13_plan_grid", "SELECT * FROM (VALUES ('clf'), ('reg')) a(task) CROSS JOIN (VALUES ('tree'), ('linear'), ('knn')) b(model) CROSS JOIN (VALUES ('grid'), ('random')) c(optimizer)")
def j13(spark, d):
    return rl.plan_grid(spark, task=["clf", "reg"], model=["tree", "linear", "knn"], optimizer=["grid", "random"])


@query("J14_pairwise_grid", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {R(f'corr({a}, {b})', 'r')} FROM pr" for a in ("y", "a", "b") for b in ("y", "a", "b")))
def j14(spark, d):
    return pf.pearson(predictions(spark, d), [(a, b) for a in ("y", "a", "b") for b in ("y", "a", "b")])


@query("J15_list_overlap", "SELECT CASE WHEN nation < 12 AND balance > 5000 THEN 'both' WHEN nation < 12 THEN 'only_a' WHEN balance > 5000 THEN 'only_b' ELSE 'none' END AS \"group\", count(*) AS n FROM cu GROUP BY 1")
def j15(spark, d):
    c = customers(spark, d)
    return rl.overlap(c.filter("nation < 12"), c.filter("balance > 5000"), c, "customer_id")


@query("J16_nearest", f"WITH q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0), d AS (SELECT q.vec_id AS query, e.vec_id AS vec_id, sqrt(list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: (CAST(q.embedding[i] AS DOUBLE) - CAST(e.embedding[i] AS DOUBLE)) ** 2))) AS distance FROM q, embeddings e WHERE q.vec_id <> e.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) AS place FROM d) SELECT query, vec_id, {R('distance', 'distance')}, place FROM r WHERE place <= 5")
def j16(spark, d):
    e = table(spark, d, "embeddings")
    return rl.nearest(e.filter("vec_id % 50 = 0"), e, "vec_id", "embedding", 5)


@query("U1_union_by_name", "SELECT customer_id, segment, NULL AS city FROM cu WHERE nation < 3 UNION ALL SELECT customer_id, NULL, city FROM cu WHERE nation > 20")
def u1(spark, d):
    c = customers(spark, d)
    return c.filter("nation < 3").select("customer_id", "segment").unionByName(c.filter("nation > 20").select("customer_id", "city"), allowMissingColumns=True)


@query("U2_distinct", "SELECT DISTINCT segment, nation FROM cu")
def u2(spark, d):
    return customers(spark, d).select("segment", "nation").distinct()


@query("U3_disjoint_splits", "SELECT count(*) AS shared FROM (SELECT customer_id FROM cu WHERE nation < 20 INTERSECT SELECT customer_id FROM cu WHERE nation >= 20)")
def u3(spark, d):
    c = customers(spark, d)
    return c.filter("nation < 20").select("customer_id").intersect(c.filter("nation >= 20").select("customer_id")).agg(F.count("*").alias("shared"))


@query("U4_set_difference", "SELECT customer_id FROM cu EXCEPT SELECT customer_id FROM tx")
def u4(spark, d):
    return customers(spark, d).select("customer_id").exceptAll(transactions(spark, d).select("customer_id").distinct()).distinct()


@query("U5_horizontal_concat", f"SELECT cu.customer_id, segment, n FROM cu JOIN (SELECT customer_id, count(*) AS n FROM tx GROUP BY 1) f ON cu.customer_id = f.customer_id")
def u5(spark, d):
    return customers(spark, d).select("customer_id", "segment").join(transactions(spark, d).groupBy("customer_id").agg(F.count("*").alias("n")), "customer_id")


_PIVOT = ", ".join(R(f"avg(value) FILTER (WHERE treatment = '{p}')", f'"{p}"') for p in PRIORITIES)


@query("R1_pivot_mean", f"SELECT block, {_PIVOT} FROM fo GROUP BY 1")
def r1(spark, d):
    return rl.pivot_mean(fold_values(spark, d), "block", "treatment", PRIORITIES, "value")


@query("R2_pivot_unique", f"SELECT block, {_PIVOT} FROM fo GROUP BY 1")
def r2(spark, d):
    return rl.pivot_unique(fold_values(spark, d), "block", "treatment", PRIORITIES, "value")


@query("R3_pivot_counts", "SELECT customer_id, " + ", ".join(f'count(*) FILTER (WHERE type = \'{t}\') AS "{t}"' for t in TYPES) + " FROM tx GROUP BY 1")
def r3(spark, d):
    return rl.pivot_counts(transactions(spark, d), "customer_id", "type", TYPES)


@query("R5_row_extreme", "SELECT block, arg_max(treatment, value) AS best, arg_min(treatment, value) AS worst FROM fo GROUP BY 1")
def r5(spark, d):
    p = rl.pivot_mean(fold_values(spark, d), "block", "treatment", PRIORITIES, "value")
    return rl.row_extreme(rl.row_extreme(p, PRIORITIES), PRIORITIES, "worst", greatest=False).select("block", "best", "worst")


@query("R6_explode_lists", f"SELECT vec_id, i - 1 AS step, {R('embedding[i]', 'value')} FROM embeddings, (SELECT unnest(range(1, 5)) AS i)")
def r6(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 4)).alias("step", "value"))


@query("R7_json_columns", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def r7(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint").alias("j")).select("event_id", "j.*")
