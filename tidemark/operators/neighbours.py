"""Exact nearest neighbours by cells, and oversampling of a rare class on them.

Cells are the leaves of a tree of cuts, made from candidates drawn by a hash; their number grows with the candidates.  A query first meets
the candidates of its own cell, which bounds how far its k-th neighbour is, and then only cells whose box of candidates this
radius reaches: all queries of a cell look for such boxes at once, then each among what was found.
Of equal candidates only k + 1 can be anybody's neighbours, so a vector that repeats doesn't fill its cell; queries of a
crowded cell are dealt in blocks.  Neighbours are ordered by distance, then key.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import dice
from tidemark.operators.series import numbered

#: Cells at most, candidates of a cell about, queries of a block, and candidates drawn for a cell.
CELLS, CELL, BLOCK, DRAWN = 1 << 14, 1000, 4000, 8


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(a.flatten().to_numpy(zero_copy_only=False), float).reshape(len(a), -1)


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs, summed in the order of the components."""
    out = np.zeros((len(x), len(y)))
    for i in range(x.shape[1]):
        d = x[:, i, None] - y[None, :, i]
        out += d * d
    return out


def _cut_tree(drawn: np.ndarray, leaf: int) -> list[tuple]:
    """Nodes (dimension, cut, left, right), leaves (-1, 0, cell, 0), root first: boxes of about leaf drawn rows, halved where they are widest."""
    nodes: list[tuple] = [(-1, 0.0, 0, 0)]
    cells, open_ = 0, [(0, np.arange(len(drawn)))]
    while open_:
        at, rows = open_.pop()
        x = drawn[rows]
        wide = x.max(0) - x.min(0) if len(x) else np.zeros(1)
        dim = int(wide.argmax())
        if len(rows) < 2 * leaf or not wide[dim] > 0:
            nodes[at], cells = (-1, 0.0, cells, 0), cells + 1
            continue
        v = np.sort(x[:, dim])
        cut = v[(len(v) - 1) // 2]
        cut = cut if cut < v[-1] else v[np.searchsorted(v, v[-1]) - 1]
        nodes[at] = (dim, float(cut), len(nodes), len(nodes) + 1)
        left = x[:, dim] <= cut
        open_ += [(len(nodes), rows[left]), (len(nodes) + 1, rows[~left])]
        nodes += [(-1, 0.0, 0, 0)] * 2
    return nodes


def _cell_of(x: np.ndarray, tree: tuple[np.ndarray, ...]) -> np.ndarray:
    dim, cut, left, right = tree
    at = np.zeros(len(x), np.int64)
    while (live := np.flatnonzero(dim[at] >= 0)).size:
        n = at[live]
        at[live] = np.where(x[live, dim[n]] <= cut[n], left[n], right[n])
    return left[at]


def _celled(rows: DataFrame, tree: tuple[np.ndarray, ...]) -> DataFrame:
    """rows (id, x) with cell."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_cell_of(_matrix(b.column(1)), tree), pa.int32())], ["id", "x", "cell"])

    return rows.mapInArrow(run, "id long, x array<double>, cell int")


def _best(q: pa.Table, c: pa.Table, k: int, itself: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of c for every row of q: how many were found, and one after another their squared distances and ids."""
    if not c.num_rows or not q.num_rows:
        return np.zeros(q.num_rows, np.int64), np.empty(0), np.empty(0, np.int64)
    x, y = _matrix(q["x"]), _matrix(c["x"])
    own, ids = q["id"].to_numpy(), c["id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    y, ids = y[order], ids[order]
    found, far, near = [], [], []
    m, step = min(k, len(y)), max(1, (1 << 20) // len(y))
    for lo in range(0, len(x), step):
        d = _squared(x[lo : lo + step], y)
        if not itself:
            d[own[lo : lo + step, None] == ids] = np.inf
        limit = np.partition(d, m - 1, axis=1)[:, m - 1]
        a, b = np.nonzero((d <= limit[:, None]) & np.isfinite(d))
        e = d[a, b]
        sort = np.lexsort((b, e, a))  # ids are in order, so ties are too
        a, b, e = a[sort], b[sort], e[sort]
        kept = np.arange(len(a)) - np.searchsorted(a, a) < m
        found.append(np.bincount(a[kept], minlength=len(d)))
        far.append(e[kept])
        near.append(ids[b[kept]])
    return np.concatenate(found), np.concatenate(far), np.concatenate(near)


def _lists(sizes: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values, kind))


class _Boxes:
    """The boxes of the cells' candidates: lo, hi (cells x components, empty ones nowhere) and how many candidates each has."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, n: np.ndarray):
        self.lo, self.hi, self.n = lo, hi, n

    def bound(self, x: np.ndarray, k: int) -> np.ndarray:
        """A radius that surely holds k candidates, inf where there are no k."""
        out = np.full(len(x), np.inf)
        some = np.flatnonzero(self.n)
        for i, row in enumerate(x):
            far = (np.maximum(np.abs(row - self.lo[some]), np.abs(row - self.hi[some])) ** 2).sum(1)
            order = np.argsort(far)
            at = np.searchsorted(np.cumsum(self.n[some][order]), k)
            out[i] = np.sqrt(far[order[at]]) if at < len(order) else np.inf
        return out

    def reached(self, x: np.ndarray, reach: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """How many other cells each row's reach meets, and one after another their numbers."""
        reach = reach * (1 + 1e-9) + 1e-12
        gap = np.maximum(0.0, np.maximum(self.lo - x.max(0), x.min(0) - self.hi))
        near = np.flatnonzero((self.n > 0) & (np.sqrt((gap * gap).sum(1)) <= reach.max()))
        near = near[near != own]
        sizes, cells = [], []
        for at in range(0, len(x), step := max(1, (1 << 20) // max(1, len(near)))):
            part = x[at : at + step]
            d = np.zeros((len(part), len(near)))
            for i in range(x.shape[1]):
                g = np.maximum(0.0, np.maximum(self.lo[near, i] - part[:, i, None], part[:, i, None] - self.hi[near, i]))
                d += g * g
            a, b = np.nonzero(np.sqrt(d) <= reach[at : at + step, None])
            sizes.append(np.bincount(a, minlength=len(part)))
            cells.append(near[b])
        return np.concatenate(sizes), np.concatenate(cells)


FOUND = "id long, x array<double>, d array<double>, n array<long>, cells array<int>"


def nearest(queries: DataFrame, candidates: DataFrame, key: str, features: Sequence[str], k: int = 5, itself: bool = False) -> DataFrame:
    """One row per query row: key, x (its features), d (distances, ascending) and n (the candidates' keys), k of them or as many as there are.

    A candidate with the query's own key is left out unless ``itself``.  Keys are whole numbers; rows without one or with a null or
    NaN feature are left out on both sides.  Repeated keys among queries must have the same features.  The cuts and boxes of
    at most CELLS cells, and DRAWN candidates for each, are on the driver, cuts and boxes in every task.
    """
    from tidemark.operators.boosting import checkpointed

    spark = queries.sparkSession
    vector = F.array(*(F.col(f).cast("double") for f in features))
    clean = lambda df: df.select(F.col(key).cast("long").alias("id"), vector.alias("x")).filter(F.col("id").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))
    every = clean(candidates)
    n = every.count()
    if not n:
        return clean(queries).select(F.col("id").alias(key), "x", F.expr("cast(array() as array<double>)").alias("d"), F.expr("cast(array() as array<long>)").alias("n"))
    drawn = every.filter(dice(F.col("id"), 7) < min(CELLS, -(-n // CELL)) * DRAWN / n).select("x").collect()
    nodes = _cut_tree(np.array(sorted(tuple(r.x) for r in drawn)).reshape(-1, len(features)), DRAWN // 2 + 1)
    tree = tuple(np.array(c) for c in zip(*nodes, strict=True))
    once = every.withColumn("__n", F.row_number().over(Window.partitionBy("x").orderBy("id"))).filter(F.col("__n") <= k + 1).select("id", "x")  # cut before the shuffle, too
    held = checkpointed(_celled(once, tree))
    asked = checkpointed(_celled(clean(queries).dropDuplicates(["id"]), tree))
    cells, f = (len(nodes) + 1) // 2, range(len(features))
    boxes = _Boxes(np.full((cells, len(f)), np.inf), np.full((cells, len(f)), -np.inf), np.zeros(cells, np.int64))
    for r in held.groupBy("cell").agg(F.count("*").alias("n"), F.array(*(F.min(F.get("x", F.lit(i))) for i in f)).alias("lo"), F.array(*(F.max(F.get("x", F.lit(i))) for i in f)).alias("hi")).collect():  # a row per cell
        boxes.n[r.cell], boxes.lo[r.cell], boxes.hi[r.cell] = r.n, r.lo, r.hi

    def meet(df: DataFrame, run, schema: str) -> DataFrame:
        """Each cell's queries, in blocks, with its candidates."""
        many = F.broadcast(checkpointed(df.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))))  # a row per cell
        mine = df.join(many, "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
        copies = held.join(many, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        return mine.groupBy("cell", "block").cogroup(copies.groupBy("cell", "block")).applyInArrow(run, schema)

    def home(q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "x": pa.array([], pa.list_(pa.float64())), "d": pa.array([], pa.list_(pa.float64())), "n": pa.array([], pa.list_(pa.int64())), "cells": pa.array([], pa.list_(pa.int32()))})
        found, d, near = _best(q, c, k, itself)
        x = _matrix(q["x"])
        reach, full = np.empty(len(x)), found == k
        reach[full] = np.sqrt(d[np.cumsum(found)[full] - 1])
        reach[~full] = boxes.bound(x[~full], k + 1)
        sizes, cells_ = boxes.reached(x, reach, q["cell"][0].as_py())
        return pa.table({"id": q["id"], "x": q["x"], "d": _lists(found, d, pa.float64()), "n": _lists(found, near, pa.int64()), "cells": _lists(sizes, cells_, pa.int32())})

    def away(q: pa.Table, c: pa.Table) -> pa.Table:
        found, d, near = _best(q, c, k, itself)
        return pa.table({"id": q["id"], "d": _lists(found, d, pa.float64()), "n": _lists(found, near, pa.int64())})

    first = checkpointed(meet(asked, home, FOUND))
    calls = first.select("id", "x", F.explode("cells").alias("cell"))
    more = meet(calls, away, "id long, d array<double>, n array<long>")
    pairs = first.select("id", F.explode_outer(F.arrays_zip("d", "n")).alias("p")).union(more.select("id", F.explode(F.arrays_zip("d", "n")).alias("p")))
    best = pairs.groupBy("id").agg(F.slice(F.array_sort(F.collect_list("p")), 1, k).alias("p"))  # at most k per cell met
    out = first.select("id", "x").join(best, "id")
    return out.select(F.col("id").alias(key), "x", F.transform("p", lambda p: F.sqrt(p["d"])).alias("d"), F.transform("p", lambda p: p["n"]).alias("n"))


def _on_segments(drawn: DataFrame, near: DataFrame, key: str, features: Sequence[str], seed: int) -> DataFrame:
    """For rows (base, s): the point on the way from base to a neighbour that s draws, at a share that s draws."""
    of = drawn.join(near.select(F.col(key).alias("base"), F.col("x").alias("__x"), F.col("n").alias("__n")), "base")
    pick = F.floor(dice(F.col("s"), seed + 1) * F.size("__n")).cast("int")
    of = of.withColumn("neighbour", F.get("__n", pick)).filter("neighbour IS NOT NULL")
    of = of.join(near.select(F.col(key).alias("neighbour"), F.col("x").alias("__y")), "neighbour").withColumn("gap", dice(F.col("s"), seed + 2))
    at = lambda i: F.get("__x", F.lit(i)) + F.col("gap") * (F.get("__y", F.lit(i)) - F.get("__x", F.lit(i)))
    return of.select("s", "base", "neighbour", "gap", *(at(i).alias(f) for i, f in enumerate(features)))


def smote(df: DataFrame, key: str, label: str, features: Sequence[str], minority, k: int = 5, seed: int = 42) -> DataFrame:
    """s, base, neighbour, gap and features of new rows of the minority, as many as it lacks to the rest.

    Each new row's base is drawn from the minority with equal chances, its neighbour from the base's k nearest within the minority, and it
    lies on the segment between them; all draws are hashes of s and seed.  Rows without a label, key or feature take no part.  A
    minority of one row has no neighbour and gives no rows, one that isn't rarer than the rest none either.
    """
    clean = df.dropna(subset=[key, label, *features])
    few = clean.filter(F.col(label) == minority)
    near = nearest(few, few, key, features, k)
    counts = {r.m: r.n for r in clean.groupBy((F.col(label) == minority).alias("m")).agg(F.count("*").alias("n")).collect()}
    lacking = max(0, counts.get(False, 0) - counts.get(True, 0)) if counts.get(True, 0) > 1 else 0
    places, n = numbered(near.select(F.col(key).alias("__k")), "__k", ["__k"])
    s = df.sparkSession.range(lacking).select(F.col("id").alias("s"), F.floor(dice(F.col("id"), seed) * n).cast("long").alias("place"))
    return _on_segments(s.join(places, "place").select("s", F.col("__k").alias("base")), near, key, features, seed)


def adasyn_shares(df: DataFrame, key: str, label: str, features: Sequence[str], minority, k: int = 5) -> DataFrame:
    """key, x, others (share of the rest among the row's k nearest of all rows) and copies, for every row of the minority.

    Copies are others over the sum of others, times the rows that the minority lacks, rounded to even.
    """
    clean = df.dropna(subset=[key, label, *features])
    few = clean.filter(F.col(label) == minority)
    near = nearest(few, clean, key, features, k)
    hits = near.select(key, F.explode("n").alias("__n")).join(clean.select(F.col(key).alias("__n"), (F.col(label) != minority).cast("double").alias("__o")), "__n")
    others = hits.groupBy(key).agg((F.sum("__o") / F.lit(float(k))).alias("others"))
    counts = {r.m: r.n for r in clean.groupBy((F.col(label) == minority).alias("m")).agg(F.count("*").alias("n")).collect()}
    lacking = max(0, counts.get(False, 0) - counts.get(True, 0))
    total = others.agg(F.sum("others").alias("__t"))
    return others.crossJoin(F.broadcast(total)).select(key, "others", F.coalesce(F.bround(F.try_divide("others", "__t") * lacking), F.lit(0.0)).cast("long").alias("copies"))


def adasyn(df: DataFrame, key: str, label: str, features: Sequence[str], minority, k: int = 5, seed: int = 42) -> DataFrame:
    """New rows as smote gives them, more where a minority row has more of the rest around it; s is base and number of the copy."""
    shares = adasyn_shares(df, key, label, features, minority, k).filter("copies > 0")
    few = df.dropna(subset=[key, label, *features]).filter(F.col(label) == minority)
    near = nearest(few, few, key, features, k)
    drawn = shares.select(F.col(key).alias("base"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("__c"))
    return _on_segments(drawn.select("base", F.concat_ws(":", "base", "__c").alias("s")), near, key, features, seed)
