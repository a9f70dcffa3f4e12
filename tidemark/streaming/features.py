"""Extension without a counterpart in the batch source: customer features kept up to date over a stream of transactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_features(tx: DataFrame, types: Sequence[str]) -> DataFrame:
    """Running n_tx, total, mean, deviation, first and last date, shares per customer; for update mode.

    State is a few sums per customer, so medians and distinct months, which need all values, aren't here.
    """
    shares = [F.avg((F.col("type") == t).cast("double")).alias(f"share_{t}") for t in types]
    a = F.col("amount")
    return tx.filter("customer_id IS NOT NULL").groupBy("customer_id").agg(F.count("*").alias("n_tx"), F.sum(a).alias("total_amount"), F.avg(a).alias("mean_amount"), F.stddev_samp(a).alias("sd_amount"), F.min("date").alias("first_tx"), F.max("date").alias("last_tx"), *shares)


def windowed_volume(tx: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Volume per window and type; windows close once the watermark has passed."""
    return tx.withWatermark("date", late).groupBy(F.window("date", window).alias("w"), "type").agg(F.count("*").alias("n"), F.sum("amount").alias("volume"))
