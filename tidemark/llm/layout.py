"""A clustered layout over several dimensions, and what range queries on it would open.

Coordinates: a value's coordinate is floor(cells * s / n), where s of all n rows have a smaller value.
It is at least j exactly if the value is above the ceil(j * n / cells)-th smallest, so a dimension needs
cells - 1 order statistics and no rank for each row.  They are found among distinct values: counted with
map-side partials, range-partitioned, and only the partitions that hold a wanted place are numbered.

Order: coordinates are interleaved bit by bit into z; rows are range-partitioned by (z, key) and sorted,
so a row's place is its partition's start (one number per shuffle partition) plus its index there.  A
last sort key, different for every row, lets Spark cut a group of equal keys anywhere.

Files: the range of a file's coordinates is a box.  A row's query meets a box dilated by the reach of
each dimension if its cell lies inside, so each file adds signed corners to a difference array of
(cells + 1) ** dimensions numbers, summed by Spark, and numpy's prefix sums give the count for every
cell.  A cell's rows are neighbours in the order and lie in one run of files; the files that match a
query are the union of the runs of its cells.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from tidemark.llm.common import discard, materialize, shuffle_parts

#: Row number within a partition takes the low bits of monotonically_increasing_id.
INDEX_BITS = 33


@dataclass(frozen=True)
class Dim:
    """A dimension: strings compare by UTF-8 bytes, others are whole numbers; queries reach so many coordinates to both sides."""

    name: str
    value: Column
    reach: int = 0


def _sort_key(value: Column, text: bool) -> Column:
    """Bytes that compare as the values do, null smallest."""
    low = F.lit(bytearray(b"\x00"))
    if text:
        return F.coalesce(F.concat(F.lit(bytearray(b"\x01")), value.cast("binary")), low)
    shifted = F.lpad(F.hex(value.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")  # the sign bit turned, negative numbers come first
    return F.coalesce(F.concat(F.lit(bytearray(b"\x01")), shifted.cast("binary")), low)


def _place() -> tuple[Column, Column]:
    """Partition and index in it, of monotonically_increasing_id in column at."""
    return F.shiftright("at", INDEX_BITS), F.col("at").bitwiseAND(F.lit((1 << INDEX_BITS) - 1))


def cut_values(slim: DataFrame, dims: list[Column], cells: int) -> tuple[int, list[list[bytes]]]:
    """Number of rows, and for each sort key its order statistics at ceil(j * n / cells), j from 1 to cells - 1."""
    spark = slim.sparkSession
    long = slim.select(F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), d.alias("v")) for i, d in enumerate(dims)])).alias("x")).select("x.*")
    counts = long.groupBy("dim", "v").agg(F.count("*").alias("n"))
    ordered = materialize(counts.repartitionByRange(shuffle_parts(spark), "dim", "v").sortWithinPartitions("dim", "v").withColumn("at", F.monotonically_increasing_id()), "values")
    part, _ = _place()
    totals = sorted((r.dim, r.part, r.n) for r in ordered.groupBy("dim", part.alias("part")).agg(F.sum("n").alias("n")).collect())
    n = sum(t for d, _, t in totals if d == 0)
    wanted, before = [], dict.fromkeys(range(len(dims)), 0)
    for d, p, t in totals:
        for j in range(1, cells):
            place = -(-j * n // cells)
            if before[d] < place <= before[d] + t:
                wanted.append((d, p, j, place - before[d]))
        before[d] += t
    cuts: list[list[bytes]] = [[] for _ in dims]
    if wanted:
        want = F.broadcast(spark.createDataFrame(wanted, "dim int, part long, j int, place long"))  # at most (cells - 1) * dimensions rows
        rows = ordered.withColumn("part", part).join(F.broadcast(spark.createDataFrame(sorted({x[:2] for x in wanted}), "dim int, part long")), ["dim", "part"])
        run = F.sum("n").over(Window.partitionBy("dim", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        found = rows.withColumn("run", run).join(want, ["dim", "part"]).filter(F.col("run") >= F.col("place"))
        for r in found.groupBy("dim", "j").agg(F.min("v").alias("v")).orderBy("dim", "j").collect():
            cuts[r.dim].append(bytes(r.v))
    discard(ordered)
    return n, cuts


def _bits(cells: int) -> int:
    return max(1, (cells - 1).bit_length())


def _interleaved(coords: list[Column], cells: int) -> Column:
    """z: the coordinates' binary digits, highest first, each round in the order of coords."""
    bits, k = _bits(cells), len(coords)
    return reduce(add, [F.shiftleft(F.shiftright(c, b).bitwiseAND(F.lit(1).cast("long")), b * k + k - 1 - i) for b in range(bits) for i, c in enumerate(coords)])


def _taken_apart(z: Column, i: int, k: int, cells: int) -> Column:
    """The i-th coordinate of z."""
    return reduce(add, [F.shiftleft(F.shiftright(z, b * k + k - 1 - i).bitwiseAND(F.lit(1).cast("long")), b) for b in range(_bits(cells))])


def _z_of(cell: tuple[int, ...], cells: int) -> int:
    k = len(cell)
    return sum((c >> b & 1) << b * k + k - 1 - i for b in range(_bits(cells)) for i, c in enumerate(cell))


def _corners(boxes: DataFrame, reaches: list[int], cells: int) -> np.ndarray:
    """For every cell, how many boxes (columns lo0, hi0, lo1, ...) meet the query around it."""
    ends = [(F.greatest(F.col(f"lo{i}") - r, F.lit(0)), F.least(F.col(f"hi{i}") + r, F.lit(cells - 1)) + 1) for i, r in enumerate(reaches)]
    base = cells + 1
    signed = []
    for pick in itertools.product((0, 1), repeat=len(reaches)):
        at = reduce(add, [e[p] * base**i for i, (e, p) in enumerate(zip(ends, pick, strict=True))])
        signed.append(F.struct(at.cast("long").alias("at"), F.lit(-1 if sum(pick) % 2 else 1).alias("sign")))
    sums = boxes.select(F.explode(F.array(*signed)).alias("x")).groupBy("x.at").agg(F.sum("x.sign").alias("n"))
    grid = np.zeros(base ** len(reaches), np.int64)
    for r in sums.collect():  # at most (cells + 1) ** dimensions rows
        grid[r.at] = r.n
    grid = grid.reshape((base,) * len(reaches), order="F")
    for axis in range(len(reaches)):
        grid = grid.cumsum(axis)
    return grid


def _union(runs: list[tuple[int, int]]) -> int:
    """Numbers covered by inclusive ranges."""
    total, last = 0, -1
    for lo, hi in sorted(runs):
        if hi > last:
            total += hi - max(lo, last + 1) + 1
            last = hi
    return total


def layout(rows: DataFrame, key: str, dims: list[Dim], cells: int = 8, rows_per_file: int = 2000, bounds_order: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of rows: key, z, position, file, files_touched, files_matching, file_bounds, and the columns of keep.

    dims are in the order of their turn in z; bounds_order names them in the order of file_bounds.  cells to the
    power of the number of dimensions must be small (4,096 here): a number for every cell goes through the driver.
    Null values are smallest, null keys first; rows with equal z and key are numbered in any order among
    themselves, which changes no row of the result; with keep, those columns follow as sort keys.  Columns of the input
    beyond key, dims and keep are ignored, so their names can't clash.  No rows give no rows.
    """
    spark, k = rows.sparkSession, len(dims)
    named = rows.select(*[d.value.alias(f"__d{i}") for i, d in enumerate(dims)], F.col(key).alias("__key"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)])
    text = [isinstance(named.schema[f"__d{i}"].dataType, StringType | BinaryType) for i in range(k)]
    slim = materialize(named, "dims")  # the only read of what dims are made of
    keys = [_sort_key(F.col(f"__d{i}"), t) for i, t in enumerate(text)]
    n, cuts = cut_values(slim, keys, cells)
    coords = [reduce(add, [(s > F.lit(bytearray(c))).cast("long") for c in cut], F.lit(0).cast("long")) for s, cut in zip(keys, cuts, strict=True)]
    carried = ["__key", *[f"__k{i}" for i in range(len(keep))]]
    zed = slim.select(_interleaved(coords, cells).alias("z"), *carried).withColumn("__tie", F.monotonically_increasing_id())
    order = ["z", *[F.col(c).asc_nulls_first() for c in carried], "__tie"]
    placed = materialize(zed.repartitionByRange(shuffle_parts(spark), *order).sortWithinPartitions(*order).drop("__tie").withColumn("at", F.monotonically_increasing_id()), "placed")
    discard(slim)
    part, index = _place()
    counted = sorted((r.part, r.z, r.n) for r in placed.groupBy(part.alias("part"), "z").agg(F.count("*").alias("n")).collect())  # a number per partition and one per cell
    starts, runs, done = {}, {}, 0
    for p, z, m in counted:
        starts.setdefault(p, done)
        runs[z] = (runs[z][0] if z in runs else done // rows_per_file, (done + m - 1) // rows_per_file)
        done += m
    begun = F.broadcast(spark.createDataFrame(sorted(starts.items()), "part long, start long"))  # a row per shuffle partition
    position = F.col("start") + index
    at = placed.withColumn("part", part).join(begun, "part").select("z", *carried, position.alias("position"), F.floor(position / F.lit(rows_per_file)).cast("long").alias("file"))
    parted = {f"c{i}": _taken_apart(F.col("z"), i, k, cells) for i in range(k)}
    boxes = at.withColumns(parted).groupBy("file").agg(*[f(f"c{i}").alias(f"{name}{i}") for i in range(k) for f, name in ((F.min, "lo"), (F.max, "hi"))])
    reaches = [d.reach for d in dims]
    touched = _corners(boxes, reaches, cells)
    by_z = []
    for cell in itertools.product(range(cells), repeat=k):
        if (z := _z_of(cell, cells)) in runs:
            near = itertools.product(*[range(max(0, c - r), min(cells, c + r + 1)) for c, r in zip(cell, reaches, strict=True)])
            by_z.append((z, int(touched[cell]), _union([runs[y] for x in near if (y := _z_of(x, cells)) in runs])))
    found = F.broadcast(spark.createDataFrame(by_z, "z long, files_touched long, files_matching long"))  # a row per cell
    mine = Window.partitionBy("file")
    listed = [i for name in bounds_order or [d.name for d in dims] for i, d in enumerate(dims) if d.name == name]
    bounds = F.concat_ws(",", *[f(f"c{i}").over(mine).cast("string") for i in listed for f in (F.min, F.max)])
    out = at.withColumns(parted).withColumn("file_bounds", bounds).join(found, "z")
    return out.select(F.col("__key").alias(key), "z", "position", "file", "files_touched", "files_matching", "file_bounds", *[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)])


def document_layout(docs: DataFrame, cells: int = 8, rows_per_file: int = 2000) -> DataFrame:
    """The layout of documents by date, length, language and source.

    length is UTF-8 bytes of the text, -1 for null; date is crc32 of the decimal doc_id modulo 365, null for a null
    doc_id.  Queries take equal source and lang coordinates, and length and date one to either side.  Whole texts count,
    however long.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.octet_length("text"), F.lit(-1)).alias("length"))
    date = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 365
    dims = [Dim("date", date, 1), Dim("length", F.col("length"), 1), Dim("lang", F.col("lang")), Dim("source", F.col("source"))]
    return layout(rows, "doc_id", dims, cells, rows_per_file, ["source", "lang", "length", "date"])


def write_clustered(rows: DataFrame, key: str, dims: list[Dim], path: str, cells: int = 8, rows_per_file: int = 2000) -> DataFrame:
    """Write rows as Parquet in the order of the layout, each of its files in a folder file=<n>; give back the files' bounds.

    All columns of rows are kept beside z, position and file_bounds (a row's own columns of these names are an error).
    """
    if clash := {"z", "position", "file", "file_bounds"} & set(rows.columns):
        raise ValueError(f"columns of the layout's own names: {sorted(clash)}")
    keep = tuple(c for c in rows.columns if c != key)
    placed = layout(rows, key, dims, cells, rows_per_file, keep=keep).select("z", "position", "file", "file_bounds", *rows.columns)
    placed.repartition("file").sortWithinPartitions("file", "position").write.partitionBy("file").parquet(path)
    return rows.sparkSession.read.parquet(path).groupBy("file").agg(F.count("*").alias("n_rows"), F.first("file_bounds").alias("file_bounds"))
