"""One order over all rows, in parts: places by range partitions, and parts that see the rows after their end.

Rows are range-partitioned by the order and sorted; a row's place is its partition's start plus its index, so
the driver sees one number per partition.  Places are then cut into parts of equal length, and the first rows of a part are
copied to the part before it (its halo), so that lagged products and blocks that begin in a part end within its
task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.replicates import count_table, mixed, poisson

INDEX_BITS = 33
#: Rows of a part, about.
PART = 1 << 16
#: Blocks longer than so many mean lengths are cut there; one in exp(40) is.
LONGEST = 40


def numbered(df: DataFrame, order: str, values: Sequence[str]) -> tuple[DataFrame, int]:
    """place (from 0, ties of the order by values) and values of all rows, and their number."""
    from tidemark.operators.boosting import checkpointed

    spark = df.sparkSession
    by = [order, *(v for v in values if v != order), "__t"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(*dict.fromkeys([order, *values])).withColumn("__t", F.monotonically_increasing_id())
    rows = checkpointed(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).select(*values, F.monotonically_increasing_id().alias("__at")))
    part = F.shiftright("__at", INDEX_BITS)
    starts, total = [], 0
    for r in sorted(rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):  # a row per shuffle partition
        starts.append((r.part, total))
        total += r.n
    begun = F.broadcast(spark.createDataFrame(starts, "__part long, __start long"))
    placed = rows.withColumn("__part", part).join(begun, "__part")
    return placed.select((F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << INDEX_BITS) - 1))).alias("place"), *values), total


def in_parts(rows: DataFrame, n: int, ahead: int, around: bool) -> DataFrame:
    """rows with part, pos (place, beyond n where it goes on at the start) and own (False in a halo of ahead rows)."""
    k = max(1, min(-(-n // PART), n // max(1, ahead)))
    part = F.floor(F.col("place") * k / F.lit(n)).cast("long")
    part = F.when(F.floor((part * n + k - 1) / F.lit(k)) > F.col("place"), part - 1).otherwise(part)
    rows = rows.withColumn("__p", part)
    first = F.floor((F.col("__p") * n + k - 1) / F.lit(k)).cast("long")  # the least place of the part
    mine = F.struct(F.col("__p").alias("part"), F.col("place").alias("pos"), F.lit(True).alias("own"))
    halo = F.struct(F.pmod(F.col("__p") - 1, F.lit(k)).alias("part"), F.when(F.col("__p") == 0, F.col("place") + n).otherwise(F.col("place")).alias("pos"), F.lit(False).alias("own"))
    copied = (F.col("place") - first < ahead) & (F.lit(around) | (F.col("__p") > 0))
    return rows.withColumn("__c", F.explode(F.when(copied, F.array(mine, halo)).otherwise(F.array(mine)))).select("__c.*", *(c for c in rows.columns if c not in ("__p", "place")))


def lagged_products(df: DataFrame, value: str, order: str, lags: int) -> DataFrame:
    """k and s, the sum over the order of each value times the one k later, k from 0 to lags; nulls count as 0."""
    rows, n = numbered(df.withColumn("__v", F.coalesce(F.col(value).cast("double"), F.lit(0.0))), order, ["__v"])
    lags = min(lags, max(0, n - 1))

    def run(t: pa.Table) -> pa.Table:
        order_ = np.argsort(t["pos"].to_numpy())
        v, own = t["__v"].to_numpy()[order_], int(t["own"].to_numpy().sum())
        s = [float(v[: min(own, len(v) - k)] @ v[k : k + min(own, len(v) - k)]) if len(v) > k else 0.0 for k in range(lags + 1)]
        return pa.table({"k": pa.array(range(lags + 1), pa.int32()), "s": s})

    return in_parts(rows, max(n, 1), lags, False).groupBy("part").applyInArrow(run, "k int, s double").groupBy("k").agg(F.sum("s").alias("s"))


def stationary_means(df: DataFrame, order: str, values: Sequence[str], block: float, n: int, seed: int) -> DataFrame:
    """rep 1..n and, of each value, its mean in a stationary bootstrap with blocks of geometric length, ``block`` on average.

    At each place a Poisson number of blocks starts, one in ``block`` on average, and a block reads on from there, around the
    end; a replicate's mean is over the rows that its blocks read, about as many as there are.  So places are independent, and
    a part settles all blocks that start in it.
    """
    values = list(values)
    rows, size = numbered(df, order, values)
    ahead = min(max(0, size - 1), math.ceil(LONGEST * block)) if block > 1 else 0
    table = count_table(1 / block)

    def run(t: pa.Table) -> pa.Table:
        order_ = np.argsort(t["pos"].to_numpy())
        pos = t["pos"].to_numpy()[order_]
        v = np.stack([np.asarray(t[c].to_numpy(), float)[order_] for c in values], 1)
        own = int(t["own"].to_numpy().sum())
        total = np.concatenate((np.zeros((1, len(values))), np.cumsum(v, 0)))
        acc, step = np.zeros((n, len(values) + 1)), max(1, (1 << 19) // n)
        for at in range(0, own, step):
            here = np.arange(at, min(own, at + step))
            h = mixed(pos[here].astype(np.uint64) + mixed(np.array([seed], np.uint64)))
            c = poisson(h, n, table)
            if not ahead:
                acc += c.T.astype(float) @ np.concatenate((v[here], np.ones((len(here), 1))), 1)
                continue
            row, rep = np.nonzero(c)
            times = c[row, rep]
            row, rep = np.repeat(row, times), np.repeat(rep, times)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(times, dtype=np.int64) - times, times)
            u = (mixed(h[row] + np.uint64(0xD1B54A32D192ED03) * (rep.astype(np.uint64) + np.uint64(1)) + nth.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(11)).astype(float) + 0.5
            long = np.minimum(1 + np.floor(np.log(u / (1 << 53)) / math.log1p(-1 / block)), ahead).astype(np.int64)
            start = here[row]
            gone = total[np.minimum(start + long, len(total) - 1)] - total[start]
            for i in range(len(values)):
                acc[:, i] += np.bincount(rep, gone[:, i], n)
            acc[:, -1] += np.bincount(rep, long, n)
        return pa.table({"rep": pa.array(np.arange(1, n + 1), pa.int32()), **{f"__s{i}": acc[:, i] for i in range(len(values) + 1)}})

    schema = "rep int, " + ", ".join(f"__s{i} double" for i in range(len(values) + 1))
    sums = in_parts(rows, max(size, 1), ahead, True).groupBy("part").applyInArrow(run, schema)
    sums = sums.groupBy("rep").agg(*(F.sum(f"__s{i}").alias(f"__s{i}") for i in range(len(values) + 1)))
    return sums.select("rep", *(F.try_divide(f"__s{i}", f"__s{len(values)}").alias(c) for i, c in enumerate(values)))
