"""Benchmark decontamination by winnowing.

A window is ``SPAN`` consecutive words of a benchmark item (a shorter item is one window).  Items and
documents keep the least ``GRAM``-word hash of every ``SPAN - GRAM + 1`` consecutive ones, so a shared
window always shares a fingerprint; a fingerprint hit is extended to all windows around it, which
are compared by their own hashes.  Items shorter than SPAN are looked up by their length.

The fingerprint index of the benchmark is broadcast in blocks of at most ``BLOCK_WORDS`` words, after
its size is measured; a benchmark beyond one block takes one pass over the documents per block, and
hits are merged per document.  So what is broadcast is bounded, and documents are never shuffled with
their texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import gram_hashes, hash_words, leave, materialize, ranges, raw, slices, trimmed, winnow

SPAN, GRAM = 10, 5
BLOCK_WORDS = 2_000_000
#: Bytes of text that a task has as words and hashes at once.
SLICE = 1 << 20
#: Words are runs of ASCII letters and digits, lower-cased, and of all other characters beyond ASCII.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def word_lists(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the number of words of each text."""
    words = [t.translate(TABLE).split() for t in texts]
    flat = [w for x in words for w in x]
    return hash_words(flat), np.fromiter(map(len, words), np.int64, len(words))


class Index:
    """Sorted hashes of windows by length, the items of each, and fingerprints of the long ones."""

    def __init__(self, items: list[tuple[str, bytes]]):
        self.ids = [i for i, _ in items]
        found: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
        prints = [np.empty(0, np.uint64)]
        words, counts = word_lists([t for _, t in items])
        ends = np.cumsum(counts)
        for k, (end, n) in enumerate(zip(ends, counts, strict=True)):
            if not n:
                continue
            w, length = words[end - n : end], int(min(n, SPAN))
            grams = gram_hashes(w, length)
            hashes, owners = found.setdefault(length, ([], []))
            hashes.append(grams)
            owners.append(np.full(len(grams), k))
            if length == SPAN:
                g = gram_hashes(w, GRAM)
                prints.append(g[winnow(g, SPAN - GRAM + 1)])
        self.prints = np.unique(np.concatenate(prints))
        self.windows = {}
        for length, (hashes, owners) in found.items():
            h, o = np.concatenate(hashes), np.concatenate(owners)
            pairs = np.unique(np.stack([h, o.astype(np.uint64)], 1), axis=0)
            keys, first = np.unique(pairs[:, 0], return_index=True)
            self.windows[length] = (keys, np.append(first, len(pairs)), pairs[:, 1].astype(np.int64))


def inside(table: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index in the sorted table, -1 where absent."""
    if not len(table):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return np.where(table[at] == wanted, at, -1)


def scan(texts: list[bytes], index: Index) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, list[str]]]]:
    """Words per text; for texts with hits, the hit word positions (sorted) and the item ids."""
    words, counts = word_lists(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    hits: list[tuple[int, np.ndarray, np.ndarray]] = []  # length, starts, windows
    for length, (keys, _, _) in index.windows.items():
        h = gram_hashes(words, length)
        if not len(h):
            continue
        if length == SPAN:
            g = gram_hashes(words, GRAM)
            at = winnow(g, SPAN - GRAM + 1)
            at = at[inside(index.prints, g[at]) >= 0]
            starts = np.unique((at[:, None] + np.arange(GRAM - SPAN, 1)).ravel())
            starts = starts[(starts >= 0) & (starts < len(h))]
        else:
            starts = np.arange(len(h))
        starts = starts[owner[starts] == owner[starts + length - 1]]
        got = inside(keys, h[starts])
        hits.append((length, starts[got >= 0], got[got >= 0]))
    first = np.cumsum(counts) - counts
    rows: dict[int, tuple[set[int], set[int]]] = {}
    for length, starts, got in hits:
        _, edges, items = index.windows[length]
        who = owner[starts]
        for row in np.unique(who):
            mine = who == row
            covered, ids = rows.setdefault(int(row), (set(), set()))
            covered.update((starts[mine][:, None] + np.arange(length)).ravel().tolist())
            windows = np.unique(got[mine])
            ids.update(items[ranges(edges[windows], edges[windows + 1] - edges[windows])].tolist())
    return counts, {row: (np.array(sorted(c)) - first[row], [index.ids[i] for i in ids]) for row, (c, ids) in rows.items()}


def blocks_of(benchmark: DataFrame, block_words: int):
    """Broadcast indexes of the benchmark, one after another, each of about block_words words at most.

    Items with a null id or without words have no windows that could be reported.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // (block_words * 4)))
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        yield spark.sparkContext.broadcast(Index([(r.item_id, r.text.encode()) for r in part.toLocalIterator()])), n


REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _sha(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def contamination_report(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated per row of docs.

    Null texts have no words, and neither has an empty benchmark windows: nothing is hit then.  Item ids
    that repeat count once.  Repeated rows and null doc_ids stay; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    partial = []
    for sent, n in blocks_of(benchmark, block_words):

        def report(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text", SLICE):
                counts, hit = scan(raw(b.column(1)), sent.value)
                n_hit, n_items, sha = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64), [_sha([])] * len(counts)
                for row, (at, ids) in hit.items():
                    ids = list(set(ids))
                    n_hit[row], n_items[row], sha[row] = len(at), len(ids), _sha(ids)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts), pa.array(n_hit), pa.array(n_items), pa.array(sha, pa.string()), pa.array(n_hit > 0)], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

        if n == 1:
            return rows.mapInArrow(trimmed(report), REPORT)

        def hits(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text", SLICE):
                counts, hit = scan(raw(b.column(1)), sent.value)
                at = [hit[r][0].tolist() if r in hit else [] for r in range(len(counts))]
                ids = [hit[r][1] if r in hit else [] for r in range(len(counts))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(counts), pa.array(at, pa.list_(pa.int64())), pa.array(ids, pa.list_(pa.string()))], ["doc_id", "row", "n_words", "at", "ids"])

        keyed = rows.withColumn("row", F.sha2(F.coalesce("text", F.lit("")), 256))
        partial.append(leave(materialize(keyed.mapInArrow(trimmed(hits), "doc_id long, row string, n_words long, at array<long>, ids array<string>"), "hits")))
        sent.unpersist()
    found = partial[0].select("doc_id", "row", "n_words")
    every = partial[0]
    for p in partial[1:]:
        every = every.union(p)
    merged = every.filter(F.size("ids") > 0).groupBy("doc_id", "row").agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    merged = merged.withColumnsRenamed({"doc_id": "m_id", "row": "m_row"})
    out = found.join(merged, found.doc_id.eqNullSafe(merged.m_id) & (found.row == merged.m_row), "left")
    ids = F.coalesce(F.col("ids"), F.expr("cast(array() as array<string>)"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs without any hit, with all their columns as they were; one map-side pass per block.

    Null and empty texts, null doc_ids and repeated rows stay, and all rows if the benchmark is empty.  With several blocks
    each pass is written before the next block is read, so that one block is held at a time.
    """
    at = docs.columns.index("text")
    for sent, n in blocks_of(benchmark, block_words):

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text", SLICE):
                keep = np.ones(b.num_rows, bool)
                keep[list(scan(raw(b.column(at)), sent.value)[1])] = False
                if keep.any():
                    yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(trimmed(clean), docs.schema)
        if n > 1:
            docs = leave(materialize(docs, "clean"))
            sent.unpersist()
    return docs
