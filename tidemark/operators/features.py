"""Customer features from a transaction log: audit, clean-up, leak-safe cut-off, aggregates, join, split and label.

Tables: transactions (customer_id, date, amount, type) and customers (customer_id, ...).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import clip, days_between, dice, ratio
from tidemark.operators.order import quantiles

FIXED = ["n_tx", "total_amount", "mean_amount", "median_amount", "recency_days", "active_days", "amount_volatility", "active_months"]


def drop_duplicates(tx: DataFrame) -> DataFrame:
    """Rows that are equal in all columns count once."""
    return tx.dropDuplicates()


def audit(customers: DataFrame, tx: DataFrame) -> DataFrame:
    """One row: exact duplicates, non-positive amounts, null dates, transactions of unknown customers, customers without any."""
    distinct = tx.distinct().agg(F.count("*").alias("n_distinct"))
    base = tx.agg(F.count("*").alias("n"), F.count_if(F.col("amount") <= 0).alias("non_positive"), F.count_if(F.col("date").isNull()).alias("null_dates"))
    orphans = tx.join(customers.select("customer_id"), "customer_id", "left_anti").agg(F.count("*").alias("orphans"))
    silent = customers.join(tx.select("customer_id"), "customer_id", "left_anti").agg(F.count("*").alias("customers_without_tx"))
    one = base.crossJoin(distinct).crossJoin(orphans).crossJoin(silent)
    return one.select((F.col("n") - F.col("n_distinct")).alias("duplicates"), "non_positive", "null_dates", "orphans", "customers_without_tx")


def cutoff_date(tx: DataFrame, train: DataFrame) -> DataFrame:
    """One row: the last date of the training customers' transactions.  It fails where they have none."""
    last = tx.join(train.select("customer_id"), "customer_id", "left_semi").agg(F.max("date").alias("cutoff"))
    return last.select(F.when(F.col("cutoff").isNull(), F.raise_error(F.lit("no training customer has transactions")).cast(tx.schema["date"].dataType)).otherwise(F.col("cutoff")).alias("cutoff"))


def customer_aggregates(tx: DataFrame) -> DataFrame:
    """Count, sum, mean, median, sample deviation, first and last date per customer, in one aggregation."""
    return tx.filter("customer_id IS NOT NULL").groupBy("customer_id").agg(*_base())


def _base() -> list[Column]:
    a = F.col("amount")
    return [F.count("*").alias("n_tx"), F.sum(a).alias("total_amount"), F.avg(a).alias("mean_amount"), F.percentile(a, 0.5).alias("median_amount"), F.stddev_samp(a).alias("sd_amount"), F.max("date").alias("last_tx"), F.min("date").alias("first_tx")]


def behaviour(tx: DataFrame, cutoff: DataFrame, types: Sequence[str]) -> DataFrame:
    """The behavioural features of each customer, in one shuffle on customer_id.

    ``cutoff`` is the one-row table of cutoff_date; ``types`` the values that become share_<type> columns,
    named beforehand so that the schema doesn't depend on the data.  Recency is clipped at 0; shares of
    absent types are 0; the volatility of a single transaction is null.
    """
    shares = [F.avg((F.col("type") == t).cast("double")).alias(f"share_{t}") for t in types]
    months = F.count_distinct(F.date_trunc("month", "date")).alias("active_months")
    g = tx.filter("customer_id IS NOT NULL").groupBy("customer_id").agg(*_base(), months, *shares)
    g = g.crossJoin(F.broadcast(cutoff))
    return g.select(
        "customer_id",
        "n_tx",
        "total_amount",
        "mean_amount",
        "median_amount",
        clip(days_between("cutoff", "last_tx"), low=0).cast("long").alias("recency_days"),
        days_between("last_tx", "first_tx").cast("long").alias("active_days"),
        ratio("sd_amount", "mean_amount").alias("amount_volatility"),
        "active_months",
        *(F.coalesce(F.col(f"share_{t}"), F.lit(0.0)).alias(f"share_{t}") for t in types),
    )


def join_features(customers: DataFrame, features: DataFrame) -> DataFrame:
    """All customers, with nulls where one has no transactions."""
    return customers.join(features, "customer_id", "left")


def feature_columns(df: DataFrame) -> list[str]:
    """The behavioural columns of a table, by name and prefix."""
    return [c for c in df.columns if c in FIXED or c.startswith("share_")]


def prune(df: DataFrame, drop: Sequence[str], structural: Sequence[str] = ()) -> DataFrame:
    """Without the dropped columns; nulls of structural columns, which mean 'none', become 0."""
    return df.drop(*drop).fillna(0, subset=list(structural))


def split(df: DataFrame, key: str = "customer_id", test: float = 0.2, validation: float = 0.0, seed: int = 42) -> DataFrame:
    """Add ``split`` (train, validation, test) by a hash of the key: reproducible, and no row decides another's side."""
    u = dice(F.col(key), seed)
    return df.withColumn("split", F.when(u < test, "test").when(u < test + validation, "validation").otherwise("train"))


def folds(df: DataFrame, key: str, k: int, stratum: str | None = None, seed: int = 42) -> DataFrame:
    """Add ``fold`` 0..k-1.  Stratified folds differ by at most one row within a stratum; plain ones go by hash alone."""
    if stratum is None:
        return df.withColumn("fold", F.floor(dice(F.col(key), seed) * k).cast("int"))
    from pyspark.sql import Window

    order = Window.partitionBy(stratum).orderBy(dice(F.col(key), seed), F.col(key))
    return df.withColumn("fold", ((F.row_number().over(order) - 1) % k).cast("int"))


def label_threshold(train: DataFrame, target: str, q: float = 0.75) -> DataFrame:
    """One row: the q-quantile of the training targets (linear interpolation)."""
    return quantiles(train, target, [q]).select(F.col("q")[0].alias("threshold")).crossJoin(train.agg(F.count(target).alias("n_train")))


def binarize(df: DataFrame, target: str, threshold: DataFrame, out: str = "label") -> DataFrame:
    """1 strictly above the threshold of a one-row table."""
    return df.crossJoin(F.broadcast(threshold.select("threshold"))).withColumn(out, (F.col(target) > F.col("threshold")).cast("int")).drop("threshold")


def prepare(customers: DataFrame, tx: DataFrame, target: str, types: Sequence[str], drop: Sequence[str] = (), structural: Sequence[str] = (), test: float = 0.2, q: float = 0.75, seed: int = 42) -> DataFrame:
    """The whole preparation, in the leak-safe order: clean, split, cut-off and threshold from train, features, join, prune, label."""
    tx = drop_duplicates(tx)
    parts = split(customers, test=test, seed=seed)
    train = parts.filter("split = 'train'")
    features = behaviour(tx, cutoff_date(tx, train), types)
    joined = prune(join_features(parts, features), drop, structural)
    return binarize(joined, target, label_threshold(train, target, q))
