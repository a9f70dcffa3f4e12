"""What the operators of this folder share: scratch tables, Arrow batches, word hashes."""

from __future__ import annotations

import ctypes
import gc
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import scratch_root

#: ASCII white space, the only separator of the word contracts.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tm_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more, and their names in the catalog."""
    for t in tables:
        if name := getattr(t, "_tm_name", None):
            t.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        _delete(t.sparkSession, t._tm_path)


_read_later: list[DataFrame] = []


def leave(table: DataFrame) -> DataFrame:
    """A scratch table that an operator's lazy result still reads; whoever has written that result may drop it."""
    _read_later.append(table)
    return table


def left_since(mark: int) -> list[DataFrame]:
    """Take the tables left after the first mark ones out of the list."""
    out = _read_later[mark:]
    del _read_later[mark:]
    return out


def left_marks() -> int:
    return len(_read_later)


def drop_unread(tables: list[DataFrame], docs: DataFrame) -> list[DataFrame]:
    """Delete those tables that docs doesn't read; the others.  Tables of another application are forgotten."""
    own = scratch_root(docs.sparkSession)
    tables = [t for t in tables if t._tm_path.startswith(own)]
    files = docs.inputFiles() if tables else []
    read = [t for t in tables if any(t._tm_path.rsplit("/", 1)[-1] in f for f in files)]
    discard(*(t for t in tables if not any(t is r for r in read)))
    return read


def packed_rows(docs: DataFrame, *more: Column) -> DataFrame:
    """Each row of docs as one struct ``row``, with the columns of more: no name of docs can clash with them."""
    return docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"), *more)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def unpacked_rows(df: DataFrame, columns: list[str], **replaced: Column) -> DataFrame:
    """The rows of packed_rows again, some columns replaced."""
    return df.select(*(replaced.get(c, F.col(f"row.{quoted(c)}")).alias(c) for c in columns))


def free_name(name: str, taken: list[str]) -> str:
    """The name, with underscores behind it until no column has it in any case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that this application's operators have written; their results can't be read after it."""
    _read_later.clear()
    _delete(spark, scratch_root(spark))


def dealt(rows: DataFrame, parts: int, by: str) -> DataFrame:
    """The rows, hash-dealt by a column and written bucketed, so that joins and groups on it leave them in place."""
    spark = rows.sparkSession
    name = f"tm_texts_{uuid.uuid4().hex}"
    path = f"{scratch_root(spark)}/{name}"
    rows.repartition(parts, by).write.bucketBy(parts, by).option("compression", "zstd").option("path", path).format("parquet").saveAsTable(name)
    release(spark)
    out = spark.table(name)
    out._tm_path, out._tm_name = path, name
    return out


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def data_parts(rows: DataFrame, text: str, least_bytes: int) -> int:
    """Number of groups to deal rows to: the session's, and more where one would hold above least_bytes of text."""
    total = rows.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return max(shuffle_parts(rows.sparkSession), -(-total // least_bytes))


def _murmur(k: int) -> int:
    """Spark's hash of an int column: Murmur3 (x86, 32 bits) of one block, seed 42, as a signed number."""
    turn = lambda x, r: (x << r | x >> 32 - r) & 0xFFFFFFFF
    h = 42 ^ turn(k * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
    h = (turn(h, 13) * 5 + 0xE6546B64 & 0xFFFFFFFF) ^ 4
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    h ^= h >> 16
    return h - (h >> 31 << 32)


def even_keys(parts: int) -> list[int]:
    """An int for each of parts groups; Spark's hash partitioning puts each group into a partition of its own.

    Beyond some thousand groups chance deals them evenly enough, and the keys are 0, 1, ...
    """
    if parts > 4096:
        return list(range(parts))
    keys: dict[int, int] = {}
    k = 0
    while len(keys) < parts:
        keys.setdefault(_murmur(k) % parts, k)
        k += 1
    return [keys[p] for p in range(parts)]


def long_hash(ids: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of a bigint column (XXH64 of 8 bytes, seed 42)."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    h = np.uint64((42 + 0x27D4EB2F165667C5 + 8) & (1 << 64) - 1) ^ turn(ids.astype(np.uint64) * p2, 31) * p1
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice has at most ``limit`` bytes of text, or one row."""
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(b.schema.get_field_index(text))
        size = np.zeros(b.num_rows + 1, np.int64)
        np.cumsum(np.asarray(pc.fill_null(pc.binary_length(col), 0)), out=size[1:])
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(size, size[at] + limit, side="right")) - 1)
            yield b.slice(at, to - at)
            at = to


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of the words."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer on 64 bits (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n word hashes; empty when there are fewer words."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    acc = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        acc = mix(acc + words[k : len(words) - n + 1 + k])
    return acc


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All indexes start, start + 1, ... of every (start, length), one range after another."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def sliding(h: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best (minimum or maximum) of h[i : i + width] for every start of a whole window."""
    out, span = h, 1
    while span < width:
        step = min(span, width - span)
        out = best(out[: len(out) - step], out[step:])
        span += step
    return out


def winnow(h: np.ndarray, width: int) -> np.ndarray:
    """Positions whose hash is least in some window of width hashes (all of them if there are fewer)."""
    if len(h) <= width:
        return np.flatnonzero(h == h.min()) if len(h) else np.empty(0, np.int64)
    low = sliding(h, width, np.minimum)
    pad = np.concatenate([np.zeros(width - 1, h.dtype), low, np.zeros(width - 1, h.dtype)])
    return np.flatnonzero(sliding(pad, width, np.maximum) == h)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished, unreferenced plans now, not at some later collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.5)  # the cleaner is a thread of its own


def trim() -> None:
    """Give a worker's free memory back to the system; idle workers stay alive beside the JVM's next tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(run):
    """The function of batches that gives its memory back at its end."""

    def batches(it):
        yield from run(it)
        trim()

    return batches


def trimmed_group(run):
    """The function of a group's table that gives its memory back at its end."""

    def table(group):
        out = run(group)
        trim()
        return out

    return table


def trimmed_pair(run):
    """The function of two tables with one key that gives its memory back at its end."""

    def tables(left, right):
        out = run(left, right)
        trim()
        return out

    return tables
