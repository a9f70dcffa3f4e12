"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, leave, materialize, shuffle_parts, trimmed

#: A node is a hub if it has more edges than this and than a task has on average; so many hubs at most, the largest, go to every task.
HUB, HUBS = 256, 4096
#: Edges that a task holds at once before it makes a forest of them.
HELD = 1 << 20


def spanning(edges: np.ndarray) -> np.ndarray:
    """A forest (larger, least node) with the components of the edges, by least labels and pointer jumps."""
    nodes, ends = np.unique(edges, return_inverse=True)
    ends = ends.reshape(-1, 2)
    label = np.arange(len(nodes))
    while len(ends):
        low = np.minimum(label[ends[:, 0]], label[ends[:, 1]])
        new = label.copy()
        np.minimum.at(new, label[ends[:, 0]], low)
        np.minimum.at(new, label[ends[:, 1]], low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, label):
            break
        label = new
    up = np.flatnonzero(label != np.arange(len(nodes)))
    return np.stack([nodes[up], nodes[label[up]]], 1)


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars (u, v) that connect what a task's edges connect, of about HELD edges at a time."""
    held, n = [], 0
    sent = lambda e: pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["u", "v"])
    for b in batches:
        held.append(np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)], 1))
        n += b.num_rows
        if n >= HELD:
            held = [spanning(np.concatenate(held))]
            n = len(held[0])
            if 2 * n > HELD:
                yield sent(held[0])
                held, n = [], 0
    if n:
        yield sent(spanning(np.concatenate(held)))


def _ways(edges: DataFrame) -> DataFrame:
    """Every edge in both directions."""
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _mark(edges: DataFrame) -> tuple:
    """Number of directed edges, how many nodes keep the edges from being stars, and the most edges of a node.

    Edges (larger, smaller) are stars if a node that hangs on a smaller one has no other edge.
    """
    nodes = edges.select("u", F.lit(1).alias("up")).union(edges.select(F.col("v").alias("u"), F.lit(0).alias("up"))).groupBy("u").agg(F.count("*").alias("n"), F.max("up").alias("up"))
    loose = F.sum(((F.col("up") == 1) & (F.col("n") > 1)).cast("long"))
    return tuple(nodes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(loose, F.lit(0)), F.max("n")).first())


def _with_least(edges: DataFrame, least: DataFrame, hub: int | None) -> DataFrame:
    """Edges (u, v) with m, the least neighbour that least (u, m, n) gives for u.

    The edges of a node with more than hub stay where they are and get m from a broadcast of at most HUBS rows, so
    that they don't meet in one task; all other edges are joined by u.
    """
    if hub is None:
        return edges.join(least.select("u", "m"), "u")
    hubs = least.filter(F.col("n") > hub).orderBy(F.desc("n"), "u").limit(HUBS).select("u", F.col("m").alias("hub"))
    told = edges.join(F.broadcast(hubs), "u", "left")
    rest = told.filter("hub IS NULL").select("u", "v").join(least.select("u", "m"), "u")
    return told.filter("hub IS NOT NULL").select("u", "v", F.col("hub").alias("m")).union(rest)


def _starred(edges: DataFrame) -> DataFrame:
    """The edges as stars of each task's own, written."""
    return materialize(edges.select("u", "v").mapInArrow(trimmed(_forests), "u long, v long"), "edges")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of an edge (u, v), and the least node that it reaches.

    Each task makes stars of the edges that it reads, and rounds end as soon as all edges are stars: a round is some ten
    jobs, and the driver keeps count of every task of them.  No step raises the sum of all edges' nodes, and only stars
    keep it, so rounds end.  Each round hangs all neighbours of a node on the least of them, first the larger ones, then the
    smaller; the least neighbour is an aggregate with map-side partials, no neighbour list is ever
    gathered, and hubs' edges are not shuffled by their hub.  Rounds grow with the logarithm of
    the longest path; each is written to the shared folder, which also cuts the lineage.
    """
    first = _starred(edges)
    cur = _starred(first)  # a few tasks read what many wrote
    discard(first)
    n, loose, most = _mark(cur)
    parts = shuffle_parts(edges.sparkSession)
    while loose:
        both = _ways(cur)
        limit = max(HUB, n // parts)
        hub = limit if most > limit else None
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _with_least(both, least, hub).filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, least, hub).filter("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        new = materialize(least.select("u", F.col("m").alias("v")).union(small).filter("u <> v").distinct(), "edges")
        discard(cur)
        cur = _starred(new)
        discard(new)
        n, loose, most = _mark(cur)
    leave(cur)
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
