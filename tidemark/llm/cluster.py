"""Centroid clustering of embeddings by Lloyd's rounds that only look at what changed.

Vectors become whole numbers once and are packed into blocks (a row has up to ``BLOCK`` vectors); blocks and
the assignments of each round are bucketed alike by block number, so joining them moves nothing.

A round knows each vector's owner, its distance, and which centroids changed.  While the owner stands
still, the centroids that also do can't win now if they didn't before, so the vector is compared with the
changed ones only; a vector whose owner moved is compared with all.  The global sums and counts of the
clusters follow by signed transfers: a vector that changes hands is taken from one sum and added to
another, a block writes the net numbers, and Spark sums them.  All arithmetic is in whole numbers.  Each round's
assignments and sums are written before the next reads them, so a lost executor costs its tasks only.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialize, release, shuffle_parts, trim
from tidemark.session import scratch_root

#: Vectors of a block.
BLOCK = 2048
#: Components are held to this magnitude, so that a squared distance fits a long.
MOST = 1 << 27
#: Blocks of a bucket, about; more vectors make more buckets.
BUCKET_BLOCKS = 64


def _bucketed(df: DataFrame, parts: int, kind: str) -> DataFrame:
    """df as a table bucketed by block; a task of a bucketed table writes its own bucket."""
    spark = df.sparkSession
    name = f"tm_{kind}_{uuid.uuid4().hex}"
    path = f"{scratch_root(spark)}/{name}"
    df.write.bucketBy(parts, "block").option("compression", "zstd").option("path", path).format("parquet").saveAsTable(name)
    out = spark.table(name)
    out._tm_path, out._tm_name = path, name
    return out


def pack(rows: DataFrame, id_col: str, vector: str, dims: int, scale: int) -> DataFrame:
    """block, ids (null as they are) and x, floor(scale * component) as int32, of the vectors with dims finite components."""
    whole = (F.size(vector) == dims) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                cut = b.slice(at, BLOCK)
                x = np.asarray(cut.column(1).flatten()).reshape(-1, dims)
                x = np.clip(np.floor(x * scale), -MOST, MOST).astype("<i4")
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([cut.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary())], ["block", "ids", "x"])
                block += 1
        trim()

    return kept.mapInArrow(run, "block long, ids array<long>, x binary")


def seeds(blocks: DataFrame, k: int, dims: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``seed:id``, ties by components; vectors without an id are never seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[str, list[int]]] = []
        for b in batches:
            for ids, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                m = np.frombuffer(x, "<i4").reshape(-1, dims)
                named = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), j) for j, i in enumerate(ids) if i is not None)
                least = named[k - 1][0] if len(named) > k else "g"  # ties at the last place stay
                best = sorted(best + [(h, m[j].tolist()) for h, j in named if h <= least])[:k]
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in best], pa.string()), pa.array([c for _, c in best], pa.list_(pa.int32()))], ["hash", "x"])

    few = blocks.select("ids", "x").mapInArrow(run, "hash string, x array<int>").orderBy("hash", "x").limit(k).collect()
    return np.array([r.x for r in few], np.int64).reshape(-1, dims)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def _nearest(x: np.ndarray, centroids: np.ndarray, which: list[int], owner: np.ndarray, dist: np.ndarray) -> None:
    """Better owners among the centroids of which, in place; ties go to the smaller number."""
    for j in which:
        d = _squared(x, centroids[j])
        wins = (d < dist) | ((d == dist) & (j < owner))
        owner[wins], dist[wins] = j, d[wins]


def reassign(x: np.ndarray, centroids: np.ndarray, changed: np.ndarray, owner: np.ndarray | None, dist: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    """Owners and distances of a block's vectors after some centroids changed, and the signed transfers of sums and counts.

    Transfers are by place in the sums: cluster * (dims + 1) + component, the count last.
    """
    n, (k, dims) = len(x), centroids.shape
    before = np.full(n, -1, np.int64) if owner is None else owner
    now, best = before.copy(), np.full(n, np.iinfo(np.int64).max) if dist is None else dist.copy()
    moved = np.flatnonzero(changed[before] | (before < 0)) if owner is not None else np.arange(n)
    still = np.setdiff1d(np.arange(n), moved, assume_unique=True)
    for rows, which in ((moved, range(k)), (still, np.flatnonzero(changed).tolist())):
        if len(rows):
            o, d = (np.full(len(rows), k), np.full(len(rows), np.iinfo(np.int64).max)) if rows is moved else (now[rows], best[rows])
            _nearest(x[rows], centroids, which, o, d)
            now[rows], best[rows] = o, d
    net = np.zeros((k, dims + 1), np.int64)
    went = np.flatnonzero(now != before)
    for sign, side in ((1, now), (-1, before)):
        for j in np.unique(side[went]):
            if j >= 0:
                mine = went[side[went] == j]
                net[j, :dims] += sign * x[mine].sum(0)
                net[j, dims] += sign * len(mine)
    flat = net.ravel()
    return now, best, {int(i): int(flat[i]) for i in np.flatnonzero(flat)}


def _round(blocks: DataFrame, last: DataFrame | None, centroids: np.ndarray, changed: np.ndarray) -> DataFrame:
    """The assignments of a round, a row per block, with its transfers."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                get = lambda c: b.column(b.schema.get_field_index(c))[row].as_py()  # noqa: B023, E731
                x = np.frombuffer(get("x"), "<i4").reshape(-1, dims).astype(np.int64)
                old = (np.frombuffer(get("owner"), "<i4").astype(np.int64), np.frombuffer(get("distance"), "<i8")) if "owner" in b.schema.names and get("owner") is not None else (None, None)
                owner, dist, net = reassign(x, centroids, changed, *old)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([get("block")], pa.int64()), pa.array([owner.astype("<i4").tobytes()], pa.binary()), pa.array([dist.astype("<i8").tobytes()], pa.binary()), pa.array([list(net)], pa.list_(pa.int32())), pa.array([list(net.values())], pa.list_(pa.int64()))],
                    ["block", "owner", "distance", "place", "amount"],
                )
        trim()

    rows = blocks.select("block", "x") if last is None else blocks.select("block", "x").join(last.select("block", "owner", "distance").hint("shuffle_hash"), "block")
    return rows.mapInArrow(run, "block long, owner binary, distance binary, place array<int>, amount array<long>")


def kmeans(rows: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors with exactly dims components, none null, NaN or infinite; the others give no row.  A
    component is floor(scale * x), held to -2**27 .. 2**27 so that every distance fits a long; an inertia that doesn't is null.
    Repeated rows and null ids stay and are assigned like any other; null ids aren't seeds.  Fewer vectors than k
    make fewer clusters, none make no rows.  Empty clusters keep their centroid.  Other columns are ignored.
    The driver holds centroids and sums, k * (dims + 1) numbers.
    """
    spark = rows.sparkSession
    packed = materialize(pack(rows, id_col, vector, dims, scale), "blocks")
    parts = max(shuffle_parts(spark), -(-packed.count() // BUCKET_BLOCKS))
    blocks = _bucketed(packed.repartition(parts, "block"), parts, "blocks")
    discard(packed)
    release(spark)
    centroids = seeds(blocks, k, dims, seed)
    schema = f"{id_col} long, cluster int, distance long"
    if not len(centroids):
        out = spark.createDataFrame([], schema)
        return out.select(id_col, "cluster", "distance", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    sums = [[0] * (dims + 1) for _ in centroids]  # Python's integers: exact however many vectors there are
    changed, last = np.ones(len(centroids), bool), None
    for r in range(rounds + 1):
        if not changed.any():
            break  # every further round would repeat this one
        now = _bucketed(_round(blocks, last, centroids, changed), parts, "owners")
        if last is not None:
            discard(last)
        last = now
        if r == rounds:
            break
        moves = now.select(F.explode(F.arrays_zip("place", "amount")).alias("x")).groupBy("x.place").agg(F.sum(F.col("x.amount").cast("decimal(38,0)")).alias("amount"))
        for m in moves.collect():  # at most k * (dims + 1) rows
            sums[m.place // (dims + 1)][m.place % (dims + 1)] += int(m.amount)
        after = np.array([[s // c[dims] for s in c[:dims]] if c[dims] else old.tolist() for c, old in zip(sums, centroids, strict=True)], np.int64)
        changed, centroids = (after != centroids).any(1), after

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, owner, dist in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.frombuffer(owner, "<i4")), pa.array(np.frombuffer(dist, "<i8"))], [id_col, "cluster", "distance"])

    found = materialize(blocks.select("block", "ids").join(last.select("block", "owner", "distance").hint("shuffle_hash"), "block").select("ids", "owner", "distance").mapInArrow(rows_of, schema), "clusters")
    discard(blocks, last)
    most = (1 << 63) - 1
    each = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # at most k rows
    total = sum(each.values())
    told = [(j, each[j] if each[j] <= most else None, total if total <= most else None, hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j in sorted(each)]
    return found.join(F.broadcast(spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
