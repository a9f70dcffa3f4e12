"""The driver's tables in the roles of the engine: transactions, customers, scores, predictions, folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = ["click", "error", "purchase", "signup", "view"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("customer_id"), F.col("ts").alias("date"), F.col("value").alias("amount"), F.col("event_type").alias("type"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    j = c.join(n, c.c_nationkey == n.n_nationkey)
    return j.select(F.col("c_custkey").alias("customer_id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("city"), F.col("c_nationkey").cast("long").alias("nation"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label y, a second label toxic, tied score s, probability p, lang, source."""
    l, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    s = F.col("n_chars").cast("double")
    return l.join(d, "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").cast("long").alias("y"), F.col("toxic").cast("long").alias("toxic"), s.alias("s"), (s / (s + 1500)).alias("p"), "lang", "source")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, value y, two forecasts a and b, and attributes."""
    o, y = table(spark, sf_dir, "orders"), F.col("o_totalprice") / 1000
    return o.select(F.col("o_orderkey").alias("id"), y.alias("y"), (y + F.col("o_custkey") % 17 - 8).alias("a"), (y + (F.col("o_custkey") * 7) % 23 - 11).alias("b"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("cust"), F.col("o_orderdate").alias("date"))


def fold_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks (months), treatments (priorities) and a value each."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("block"), F.col("o_orderpriority").alias("treatment")).agg(F.round(F.avg("o_totalprice"), 4).alias("value"))
