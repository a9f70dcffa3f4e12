"""Replicates without replicated rows: weights of all replicates are drawn inside a task, and only their sums leave it.

A row's weights come from a 64-bit hash of its key and a counter, so they don't depend on how rows are dealt and reruns agree.
A batch of rows times its matrix of weights is one product; a task gives a vector of sums per replicate, whatever
its number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import bin_left

#: Weights that a task holds at a time, about.
CELLS = 1 << 19
#: Value ranges at least, for orders over all rows.
RANGES = 64


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer on 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def bits(h: np.ndarray, words: int) -> np.ndarray:
    """words 64-bit numbers for each hash."""
    step = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mixed(h.view(np.uint64)[:, None] + step)


def count_table(rate: float) -> np.ndarray:
    """Poisson count of each 16-bit number."""
    cum, term = [], math.exp(-rate)
    for k in range(40):
        cum.append((cum[-1] if cum else 0.0) + term)
        term *= rate / (k + 1)
    return np.searchsorted(cum, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def poisson(h: np.ndarray, n: int, table: np.ndarray) -> np.ndarray:
    """Counts of n replicates, a row for each hash."""
    return table[bits(h, -(-n // 4)).view(np.uint16)[:, :n]]


def coins(h: np.ndarray, n: int) -> np.ndarray:
    """Zeros and ones of n replicates, a row for each hash."""
    return np.unpackbits(bits(h, -(-n // 64)).view(np.uint8), axis=1)[:, :n]


def hashed(key: str | Column, seed: int) -> Column:
    return F.xxhash64(F.col(key) if isinstance(key, str) else key, F.lit(seed))


def _floats(b: pa.RecordBatch | pa.Table, names: Sequence[str]) -> np.ndarray:
    return np.stack([np.asarray(b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) if isinstance(b, pa.RecordBatch) else b[c].to_numpy(), float) for c in names], 1)


def replicate_sums(df: DataFrame, key: str, values: dict[str, Column], n: int, seed: int, draw: str = "poisson") -> DataFrame:
    """rep 1..n and, of each value, its sum under the replicate's weights (poisson counts, or coins of 0 and 1).

    Rows where a value is null are left out.
    """
    names = list(values)
    rows = df.select(hashed(key, seed).alias("__h"), *(v.cast("double").alias(c) for c, v in values.items())).dropna(subset=names)
    table = count_table(1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc, step = np.zeros((n, len(names))), max(1, CELLS // n)
        for b in batches:
            h, x = b.column(0).to_numpy(), _floats(b, names)
            for at in range(0, len(h), step):
                w = poisson(h[at : at + step], n, table) if draw == "poisson" else coins(h[at : at + step], n)
                acc += w.T.astype(float) @ x[at : at + step]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, n + 1), pa.int32()), *(pa.array(acc[:, i]) for i in range(len(names)))], ["rep", *names])

    partial = rows.mapInArrow(run, "rep int, " + ", ".join(f"{c} double" for c in names))
    return partial.groupBy("rep").agg(*(F.sum(c).alias(c) for c in names))


def _concordance(score: np.ndarray, positive: np.ndarray, h: np.ndarray, n: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of n replicates: positive weight times negative weight below it (ties half), positive weight, negative weight."""
    order = np.argsort(score, kind="stable")
    score, positive, h = score[order], positive[order], h[order]
    right, below, pos, open_pos, open_neg = (np.zeros(n) for _ in range(5))
    step, last = max(1, CELLS // n), None
    for at in range(0, len(h), step):
        s = score[at : at + step]
        w = poisson(h[at : at + step], n, table).astype(float)
        mine = positive[at : at + step, None]
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        p, q = np.add.reduceat(w * mine, first, 0), np.add.reduceat(w * ~mine, first, 0)
        if last is not None and s[0] == last:
            p[0] += open_pos
            q[0] += open_neg
        else:
            p, q = np.concatenate((open_pos[None], p)), np.concatenate((open_neg[None], q))
        done = q[:-1]
        right += (p[:-1] * (below + np.cumsum(done, 0) - done / 2)).sum(0)
        below = below + done.sum(0)
        pos += p[:-1].sum(0)
        open_pos, open_neg, last = p[-1].copy(), q[-1].copy(), s[-1]
    right += open_pos * (below + open_neg / 2)
    return right, pos + open_pos, below + open_neg


def bootstrap_auc(df: DataFrame, key: str, y: str, a: str, n: int = 200, seed: int = 42) -> DataFrame:
    """rep, auc under Poisson weights of rows, each class's weights over their own total (strata).

    Scores are cut into value ranges by a quantile sketch; a range gives its own concordance and its weights' totals per
    replicate, and totals of lower ranges are added after.  A value that fills several ranges alone is dealt among as many tasks.
    """
    spark = df.sparkSession
    rows = df.filter(F.col(y).isNotNull() & F.col(a).isNotNull()).select(hashed(key, seed).alias("h"), (F.col(y) == 1).alias("positive"), F.col(a).cast("double").alias("score"))
    ranges = max(RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = rows.agg(F.percentile_approx("score", [k / ranges for k in range(1, ranges)], 20 * ranges)).first()[0] or []
    values = sorted(set(cuts))
    full = {c: cuts.count(c) for c in values if cuts.count(c) > 1}  # a value that fills ranges, and how many
    place = 2 * bin_left("score", F.array(*map(F.lit, values)) if values else F.expr("cast(array() as array<double>)"))
    share = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in full.items() for x in pair)), F.col("score")), F.lit(1)) if full else F.lit(1)
    place = place + (share > 1).cast("int")
    table = count_table(1.0)

    def run(t: pa.Table) -> pa.Table:
        right, pos, neg = _concordance(t["score"].to_numpy(), t["positive"].to_numpy().astype(bool), t["h"].to_numpy(), n, table)
        if t["place"][0].as_py() % 2:  # one value in several groups: ties are counted from the groups' sums
            right[:] = 0
        return pa.table({"place": pa.array(np.full(n, t["place"][0].as_py()), pa.int32()), "rep": pa.array(np.arange(1, n + 1), pa.int32()), "right": right, "pos": pos, "neg": neg})

    dealt = rows.withColumns({"place": place, "part": F.pmod(F.shiftright("h", 7), share)})
    sums = dealt.groupBy("place", "part").applyInArrow(run, "place int, rep int, right double, pos double, neg double")
    sums = sums.groupBy("place", "rep").agg(*(F.sum(c).alias(c) for c in ("right", "pos", "neg")))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy("rep").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    right = F.when(F.col("place") % 2 == 1, F.col("pos") * F.col("neg") / 2).otherwise(F.col("right"))
    return sums.withColumn("all", right + F.col("pos") * below).groupBy("rep").agg(F.try_divide(F.sum("all"), F.sum("pos") * F.sum("neg")).alias("auc"))


def paired_bootstrap_auc(df: DataFrame, key: str, y: str, a: str, b: str, n: int = 200, seed: int = 42) -> DataFrame:
    """rep, auc_a, auc_b and their difference b - a, on the same rows' weights; rows without one of the scores are left out."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    one = lambda c, name: bootstrap_auc(both, key, y, c, n, seed).withColumnRenamed("auc", name)
    return one(a, "auc_a").join(one(b, "auc_b"), "rep").withColumn("diff", F.col("auc_b") - F.col("auc_a"))
