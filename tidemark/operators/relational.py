"""Joins, set operations, predicates, validation and reshaping."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, TimestampNTZType, TimestampType


def columns_by_kind(df: DataFrame) -> dict[str, list[str]]:
    """numeric, boolean, date and text columns."""
    out: dict[str, list[str]] = {"numeric": [], "boolean": [], "date": [], "text": []}
    for f in df.schema.fields:
        t = f.dataType
        kind = "numeric" if isinstance(t, NumericType) else "boolean" if isinstance(t, BooleanType) else "date" if isinstance(t, DateType | TimestampType | TimestampNTZType) else "text"
        out[kind].append(f.name)
    return out


def lookup_one(df: DataFrame, **where) -> DataFrame:
    """The row that meets all equalities; it fails unless there is exactly one."""
    hit = df.filter(reduce(Column.__and__, (F.col(k) == v for k, v in where.items())))
    n = F.count("*").over(Window.partitionBy())
    return hit.withColumn("__n", n).filter(F.when(F.col("__n") == 1, True).otherwise(F.raise_error(F.lit("not exactly one row")).cast("boolean"))).drop("__n")


def facets(df: DataFrame, equal: dict[str, object] | None = None, between: dict[str, tuple[float, float]] | None = None, tolerance: float = 1e-9) -> DataFrame:
    """Rows that meet all given facets; None leaves a facet open, reversed limits are turned."""
    out = df
    for c, v in (equal or {}).items():
        if v is not None:
            out = out.filter(F.col(c) == v)
    for c, (a, b) in (between or {}).items():
        out = out.filter(F.col(c).between(min(a, b) - tolerance, max(a, b) + tolerance))
    return out


def with_support(groups: DataFrame, n: str, least: int) -> DataFrame:
    """Groups of at least ``least`` rows; others give no answer."""
    return groups.filter(F.col(n) >= least)


def groups_of_size(df: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """Rows of groups that have exactly k."""
    return df.withColumn("__n", F.count("*").over(Window.partitionBy(*by))).filter(F.col("__n") == k).drop("__n")


def nice_limits(df: DataFrame, column: str) -> DataFrame:
    """One row: least, greatest, and a decade step a hundredth of the range or so."""
    g = df.agg(F.min(column).cast("double").alias("low"), F.max(column).cast("double").alias("high"))
    return g.withColumn("step", F.when(F.col("high") > F.col("low"), F.pow(F.lit(10.0), F.floor(F.log10(F.col("high") - F.col("low"))) - 2)).otherwise(1.0))


def violations(df: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """Add ``violations``: missing, not a number, not whole, out of range or of categories, by column.

    A rule has kind (integer, number, category, boolean), and min and max or levels.
    """
    found = []
    for c, r in rules.items():
        x, text = F.col(c), F.col(c).cast("string")
        say = lambda cond, what, c=c: F.when(F.coalesce(cond, F.lit(False)), F.lit(f"{c}: {what}"))
        blank = x.isNull() | (text == "")
        found.append(say(blank, "missing"))
        if r["kind"] == "category":
            found.append(say(~blank & ~text.isin(r["levels"]), "unknown category"))
        elif r["kind"] == "boolean":
            found.append(say(~blank & ~text.isin("true", "false", "0", "1"), "not a boolean"))
        else:
            v = text.try_cast("double")
            bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
            found.append(say(~blank & bad, "not a number"))
            if r["kind"] == "integer":
                found.append(say(~blank & ~bad & (v != F.floor(v)), "not an integer"))
            found.append(say(~blank & ~bad & ((v < r["min"]) | (v > r["max"])), "out of range"))
    return df.withColumn("violations", F.filter(F.array(*found), lambda x: x.isNotNull()))


def suffixed_join(a: DataFrame, b: DataFrame, on: Sequence[str], suffix: str, how: str = "left") -> DataFrame:
    """Join on several keys, b's other columns renamed by a suffix."""
    return a.join(b.withColumnsRenamed({c: f"{c}{suffix}" for c in b.columns if c not in on}), list(on), how)


def key_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """side, n: distinct keys only in a, only in b."""
    only = lambda x, y, s: x.select(key).distinct().join(y.select(key), key, "left_anti").agg(F.count("*").alias("n")).select(F.lit(s).alias("side"), "n")
    return only(a, b, "only_a").union(only(b, a, "only_b"))


def common_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows equal in all columns, nulls equal to nulls."""
    return a.intersect(b.select(*a.columns))


def align(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of the keys, in a join that fails where a key repeats in df."""
    n = F.count("*").over(Window.partitionBy(key))
    checked = df.withColumn("__n", n).withColumn("__n", F.when(F.col("__n") > 1, F.raise_error(F.lit("repeated key")).cast("long")).otherwise(F.col("__n")))
    return keys.select(key).join(checked, key, "left").filter(F.coalesce(F.col("__n"), F.lit(1)) == 1).drop("__n")


def plan_grid(spark, **axes: Sequence[str]) -> DataFrame:
    """Cartesian product of small lists."""
    out = None
    for name, values in axes.items():
        one = spark.createDataFrame([(v,) for v in values], f"{name} string")
        out = one if out is None else out.crossJoin(one)
    return out


def overlap(a: DataFrame, b: DataFrame, everyone: DataFrame, key: str) -> DataFrame:
    """group, n: keys in both lists, in one of them, in none."""
    mark = lambda df, n: df.select(key).distinct().withColumn(n, F.lit(1))
    j = everyone.select(key).join(mark(a, "__a"), key, "left").join(mark(b, "__b"), key, "left")
    both, one, two = F.col("__a").isNotNull() & F.col("__b").isNotNull(), F.col("__a").isNotNull(), F.col("__b").isNotNull()
    return j.groupBy(F.when(both, "both").when(one, "only_a").when(two, "only_b").otherwise("none").alias("group")).agg(F.count("*").alias("n"))


def _to_all(q: np.ndarray, v: np.ndarray, p: float) -> np.ndarray:
    """Distances of the pairs of rows, their terms summed in the order of the components."""
    out = np.zeros(np.broadcast_shapes(q.shape[:-1], v.shape[:-1]))
    for i in range(q.shape[-1]):
        d = np.abs(q[..., i] - v[..., i])
        out += d * d if p == 2 else d**p
    return np.sqrt(out) if p == 2 else out ** (1 / p)


def _near(q: np.ndarray, own: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int, p: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every query the k nearest of v, ids ascending: (place of the query, place in v, distance), exact.

    For p = 2 a matrix product gives distances up to rounding, and only pairs that rounding could bring among the k are looked at.
    """
    at, to, far = [], [], []
    qq, vv = (q * q).sum(1), (v * v).sum(1)
    fast = p == 2 and np.isfinite(qq).all() and np.isfinite(vv).all()
    slack = 1e-13 * (q.shape[1] + 8) * (vv.max(initial=0.0) + qq) if fast else np.zeros(len(q))
    for lo in range(0, len(q), max(1, (1 << 21) // max(1, len(v)))):
        x = slice(lo, lo + max(1, (1 << 21) // max(1, len(v))))
        d = qq[x, None] - 2 * (q[x] @ v.T) + vv if fast else _to_all(q[x, None, :], v[None], p)
        d[own[x, None] == ids] = np.inf
        m = min(k, len(v))
        limit = np.partition(d, m - 1, axis=1)[:, m - 1]
        a, b = np.nonzero((d <= (limit + 2 * slack[x])[:, None]) & (own[x, None] != ids))
        e = _to_all(q[x][a], v[b], p)
        order = np.lexsort((b, e, a))  # ids ascend, so ties go by id
        a, b, e = a[order], b[order], e[order]
        first = np.searchsorted(a, a)
        kept = np.arange(len(a)) - first < k
        at.append(a[kept] + lo)
        to.append(b[kept])
        far.append(e[kept])
    return tuple(np.concatenate(x) if x else np.empty(0, int) for x in (at, to, far))


#: Rows that a task holds at once, and queries of a block.
NEAR_ROWS, NEAR_QUERIES = 8192, 1024


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, p: float = 2.0) -> DataFrame:
    """query, key, distance, place of the k nearest rows in Minkowski distance, exactly; ties by key.

    Queries are packed into blocks; each block meets packs of rows once by matrix products, and every pack keeps k per query before the
    shuffle, so what moves is k rows per query and pack.  Keys are whole numbers; rows without a key or vector, or with a null or
    NaN in it, are left out on both sides.  Vectors of two lengths meet over the components that both have.
    """
    clean = lambda df: df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x")).filter(F.col("id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))

    from tidemark.operators.boosting import checkpointed

    def packs(df: DataFrame, size: int) -> DataFrame:
        """Rows of about size vectors: ids, and vectors end to end."""

        def run(batches):
            held, n = [], 0
            for b in batches:
                held.append(b)
                n += b.num_rows
                if n >= size:
                    yield from cut(held, n)
                    held, n = [], 0
            if n:
                yield from cut(held, n)

        def cut(held, n):
            t = pa.Table.from_batches(held)
            lengths = np.asarray(pc.list_value_length(t["x"]))
            for m in np.unique(lengths[lengths > 0]):
                mine = t.filter(pa.array(lengths == m))
                for lo in range(0, len(mine), size):
                    part = mine.slice(lo, size)
                    xs = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in part["x"].chunks])
                    yield pa.RecordBatch.from_arrays([pa.array([part["id"].to_numpy()], pa.list_(pa.int64())), pa.array([xs], pa.list_(pa.float64()))], ["ids", "xs"])

        return df.mapInArrow(run, "ids array<long>, xs array<double>")

    def meet(batches):
        for b in batches:
            for r in range(b.num_rows):
                qi, qx, vi, vx = (np.asarray(b.column(c)[r].values.to_numpy(zero_copy_only=False)) for c in range(4))
                order = np.argsort(vi, kind="stable")
                q, v = qx.reshape(len(qi), -1), vx.reshape(len(vi), -1)[order]
                both = min(q.shape[1], v.shape[1])
                at, to, far = _near(q[:, :both], qi, v[:, :both], vi[order], k, p)
                yield pa.RecordBatch.from_arrays([pa.array(qi[at], pa.int64()), pa.array(vi[order][to], pa.int64()), pa.array(far, pa.float64())], ["query", key, "distance"])

    few = clean(queries)
    parts = max(1, -(-few.count() // NEAR_QUERIES))
    asked = checkpointed(packs(few.repartition(parts, "id"), NEAR_QUERIES).withColumnsRenamed({"ids": "qi", "xs": "qx"}))  # else packed again for every part of rows
    pairs = packs(clean(rows), NEAR_ROWS).crossJoin(asked).select("qi", "qx", "ids", "xs").mapInArrow(meet, f"query long, `{key}` long, distance double")
    place = F.row_number().over(Window.partitionBy("query").orderBy("distance", key))
    return pairs.withColumn("place", place).filter(F.col("place") <= k)


def pivot_mean(df: DataFrame, index: str, column: str, values: Sequence[str], value: str, fill: float | None = None) -> DataFrame:
    """A mean per index and named column value."""
    out = df.groupBy(index).pivot(column, list(values)).agg(F.avg(value))
    return out if fill is None else out.fillna(fill)


def pivot_unique(df: DataFrame, index: str, column: str, values: Sequence[str], value: str) -> DataFrame:
    """One value per cell; it fails where a cell has several."""
    cell = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("several rows in a cell")).cast("double")).otherwise(F.first(value))
    return df.groupBy(index).pivot(column, list(values)).agg(cell)


def pivot_counts(df: DataFrame, index: str, column: str, values: Sequence[str]) -> DataFrame:
    """A count per index and named column value, 0 where absent."""
    return df.groupBy(index).agg(*(F.count_if(F.col(column) == v).alias(v) for v in values))


def row_extreme(df: DataFrame, columns: Sequence[str], out: str = "best", greatest: bool = True) -> DataFrame:
    """Add the name of the column of greatest (least) value, the first on ties; nulls don't count."""
    top = F.greatest(*columns) if greatest else F.least(*columns)
    name = reduce(lambda acc, c: F.when(F.col(c) == top, c).otherwise(acc), reversed(columns), F.lit(None).cast("string"))
    return df.withColumn(out, name)


def explode_traces(df: DataFrame, keys: Sequence[str], traces: str) -> DataFrame:
    """Arrays of arrays as rows: keys, fold, step, value."""
    one = df.select(*keys, F.posexplode(traces).alias("fold", "__t"))
    return one.select(*keys, "fold", F.posexplode("__t").alias("step", "value"))


def by_order_list(column: str, order: Sequence[str]) -> list[Column]:
    """Sort keys: place in the list, unknown values last by name."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return [F.when(place == 0, len(order) + 1).otherwise(place), F.col(column)]


def sample_rows(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """The k rows of least hash: a fixed-size sample that reruns reproduce."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(k)
