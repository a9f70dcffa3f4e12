"""Feature queries: A1 to A7 and the flagship, J1, J6, J7, splits and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import features as fe
from tidemark.plans.registry import R, query
from tidemark.plans.roles import TYPES, customers, transactions

_CUT = "ct AS (SELECT max(date) AS cutoff FROM tx WHERE customer_id IN (SELECT customer_id FROM cu WHERE nation < 20))"
_SHARES = ", ".join(R(f"avg(CASE WHEN type = '{t}' THEN 1.0 ELSE 0.0 END)", f"share_{t}") for t in TYPES)
_FEATURES = f"""SELECT customer_id, count(*) AS n_tx, {R("sum(amount)", "total_amount")}, {R("avg(amount)", "mean_amount")}, {R("quantile_cont(amount, 0.5)", "median_amount")},
 greatest(date_sub('day', max(date), any_value(cutoff)), 0) AS recency_days, date_sub('day', min(date), max(date)) AS active_days,
 {R("stddev_samp(amount) / nullif(avg(amount), 0)", "amount_volatility")}, count(DISTINCT date_trunc('month', date)) AS active_months, {_SHARES}
 FROM (SELECT DISTINCT * FROM tx) t, ct WHERE customer_id IS NOT NULL GROUP BY customer_id"""


def _features(spark, d):
    tx = fe.drop_duplicates(transactions(spark, d))
    return fe.behaviour(tx, fe.cutoff_date(tx, customers(spark, d).filter("nation < 20")), TYPES)


@query("a_star_features", f"WITH {_CUT} {_FEATURES}")
def a_star(spark, d):
    return _features(spark, d)


@query("A1_customer_aggregates", f"SELECT customer_id, count(*) AS n_tx, {R('sum(amount)', 'total_amount')}, {R('avg(amount)', 'mean_amount')}, {R('quantile_cont(amount, 0.5)', 'median_amount')}, {R('stddev_samp(amount)', 'sd_amount')}, max(date) AS last_tx, min(date) AS first_tx FROM tx WHERE customer_id IS NOT NULL GROUP BY 1")
def a1(spark, d):
    return fe.customer_aggregates(transactions(spark, d))


@query("A2_derived_features", f"WITH {_CUT}, f AS ({_FEATURES}) SELECT customer_id, recency_days, active_days, amount_volatility FROM f")
def a2(spark, d):
    return _features(spark, d).select("customer_id", "recency_days", "active_days", "amount_volatility")


@query("A3_active_months", "SELECT customer_id, count(DISTINCT date_trunc('month', date)) AS active_months FROM tx WHERE customer_id IS NOT NULL GROUP BY 1")
def a3(spark, d):
    return transactions(spark, d).filter("customer_id IS NOT NULL").groupBy("customer_id").agg(F.count_distinct(F.date_trunc("month", "date")).alias("active_months"))


@query("A4_type_shares", f"SELECT customer_id, {_SHARES} FROM tx WHERE customer_id IS NOT NULL GROUP BY 1")
def a4(spark, d):
    g = transactions(spark, d).filter("customer_id IS NOT NULL").groupBy("customer_id")
    return g.agg(*(F.avg((F.col("type") == t).cast("double")).alias(f"share_{t}") for t in TYPES))


@query("A5_cutoff_date", f"WITH {_CUT} SELECT cutoff FROM ct")
def a5(spark, d):
    return fe.cutoff_date(transactions(spark, d), customers(spark, d).filter("nation < 20"))


@query("A6_duplicate_rows", "SELECT (SELECT count(*) FROM (SELECT segment, nation FROM cu)) - (SELECT count(*) FROM (SELECT DISTINCT segment, nation FROM cu)) AS duplicates")
def a6(spark, d):
    from tidemark.operators.profile import duplicates

    return duplicates(customers(spark, d).select("segment", "nation"))


@query(
    "A7_table_audit",
    """SELECT (SELECT count(*) FROM tx) - (SELECT count(*) FROM (SELECT DISTINCT * FROM tx)) AS duplicates, (SELECT count(*) FROM tx WHERE amount <= 0) AS non_positive,
 (SELECT count(*) FROM tx WHERE date IS NULL) AS null_dates, (SELECT count(*) FROM tx WHERE customer_id NOT IN (SELECT customer_id FROM cu WHERE nation < 20)) AS orphans,
 (SELECT count(*) FROM cu WHERE nation < 20 AND customer_id NOT IN (SELECT customer_id FROM tx)) AS customers_without_tx""",
)
def a7(spark, d):
    return fe.audit(customers(spark, d).filter("nation < 20"), transactions(spark, d))


@query("J1_join_features", f"WITH {_CUT}, f AS ({_FEATURES}) SELECT cu.customer_id, segment, city, nation, {R('balance', 'balance')}, f.* EXCLUDE (customer_id) FROM cu LEFT JOIN f ON cu.customer_id = f.customer_id")
def j1(spark, d):
    return fe.join_features(customers(spark, d), _features(spark, d))


@query("J2_one_groupby_features", f"WITH {_CUT}, f AS ({_FEATURES}) SELECT customer_id, n_tx, active_months, share_view FROM f")
def j2(spark, d):
    return _features(spark, d).select("customer_id", "n_tx", "active_months", "share_view")


@query("J6_semi_join", "SELECT customer_id, count(*) AS n FROM tx WHERE customer_id IN (SELECT customer_id FROM cu WHERE nation < 10) GROUP BY 1")
def j6(spark, d):
    return transactions(spark, d).join(customers(spark, d).filter("nation < 10").select("customer_id"), "customer_id", "left_semi").groupBy("customer_id").agg(F.count("*").alias("n"))


@query("J7_anti_join", "SELECT city, count(*) AS n FROM cu WHERE customer_id NOT IN (SELECT customer_id FROM tx) GROUP BY 1")
def j7(spark, d):
    return customers(spark, d).join(transactions(spark, d).select("customer_id"), "customer_id", "left_anti").groupBy("city").agg(F.count("*").alias("n"))


def _dice(key: str, seed: int) -> str:
    return f"CAST(CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || '#{seed}'), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0"


@query("M1_random_split", f"SELECT customer_id, CASE WHEN {_dice('customer_id', 42)} < 0.2 THEN 'test' WHEN {_dice('customer_id', 42)} < 0.30000000000000004 THEN 'validation' ELSE 'train' END AS split FROM cu")
def m1(spark, d):
    return fe.split(customers(spark, d), validation=0.1).select("customer_id", "split")


@query("M6_stratified_folds", f"SELECT id, (row_number() OVER (PARTITION BY y ORDER BY {_dice('id', 42)}, id) - 1) % 5 AS fold FROM sc")
def m6(spark, d):
    from tidemark.plans.roles import scores

    return fe.folds(scores(spark, d), "id", 5, "y").select("id", "fold")


@query("P13_binarize", "WITH t AS (SELECT quantile_cont(balance, 0.75) AS threshold FROM cu WHERE nation < 20) SELECT customer_id, CAST(balance > threshold AS BIGINT) AS label FROM cu, t")
def p13(spark, d):
    c = customers(spark, d)
    return fe.binarize(c, "balance", fe.label_threshold(c.filter("nation < 20"), "balance")).select("customer_id", "label")


@query(
    "PREP_prepare_all",
    f"""WITH parts AS (SELECT *, CASE WHEN {_dice('customer_id', 42)} < 0.2 THEN 'test' ELSE 'train' END AS split FROM cu), ct AS (SELECT max(date) AS cutoff FROM tx WHERE customer_id IN (SELECT customer_id FROM parts WHERE split = 'train')),
 f AS ({_FEATURES}), t AS (SELECT quantile_cont(balance, 0.75) AS threshold FROM parts WHERE split = 'train')
 SELECT parts.customer_id, segment, nation, {R('balance', 'balance')}, split, coalesce(n_tx, 0) AS n_tx, f.* EXCLUDE (customer_id, n_tx), CAST(balance > threshold AS BIGINT) AS label FROM parts LEFT JOIN f ON parts.customer_id = f.customer_id, t""",
)
def prep(spark, d):
    return fe.prepare(customers(spark, d), transactions(spark, d), "balance", TYPES, drop=["city"], structural=["n_tx"])


@query("P5_feature_columns", "SELECT unnest(['n_tx', 'total_amount', 'mean_amount', 'median_amount', 'recency_days', 'active_days', 'amount_volatility', 'active_months', 'share_click', 'share_error', 'share_purchase', 'share_signup', 'share_view']) AS name")
def p5(spark, d):
    return spark.createDataFrame([(c,) for c in fe.feature_columns(_features(spark, d))], "name string")


@query("A55_fold_invariant", "WITH f AS (SELECT nation % 5 AS fold, max(date) AS last FROM tx JOIN cu ON tx.customer_id = cu.customer_id GROUP BY 1), c AS (SELECT a.fold, max(b.last) AS cutoff FROM f a JOIN f b ON a.fold <> b.fold GROUP BY 1) SELECT count(*) AS folds, count(DISTINCT cutoff) AS cutoffs, count(*) FILTER (WHERE cutoff <> (SELECT max(last) FROM f)) AS moved FROM c")
def a55(spark, d):
    f = transactions(spark, d).join(customers(spark, d), "customer_id").groupBy((F.col("nation") % 5).alias("fold")).agg(F.max("date").alias("last"))
    c = f.alias("a").join(f.alias("b"), F.col("a.fold") != F.col("b.fold")).groupBy("a.fold").agg(F.max("b.last").alias("cutoff"))
    whole = f.agg(F.max("last").alias("whole"))
    return c.crossJoin(F.broadcast(whole)).agg(F.count("*").alias("folds"), F.count_distinct("cutoff").alias("cutoffs"), F.count_if(F.col("cutoff") != F.col("whole")).alias("moved"))
