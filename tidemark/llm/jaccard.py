"""N-gram Jaccard join with prefix trees.

Documents become sets of hashed word n-grams in one global order: rare grams first, as told by a
sketch of fixed size over all documents, then by hash.  Texts with equal sets form a class, and a class
joins through one representative.

1. Sketch: grams are counted by cell; a gram's level is how far its cell lies above the mean.  Only
   the order depends on it, never a result.
2. Prefix index: of sets in order, neighbouring grams are the index's keys.  A gram that only one of two sets
   has breaks at most two neighbourships of its own set and one of the other, so linked sets share
   ``SHARED`` neighbourships (or all that small sets must) within prefixes of about half their length.
   One common phrase, as unrelated texts have it ever more often in a larger corpus, hardly ever
   makes neighbours in both.  Keys are dealt by hash as packed arrays; sets with a common key that may
   link by size and place become counted pairs, where up to ``PAIRS`` sets have the key, else a forest
   of edges that connects at least as much.  Counted pairs must also pass a parity bitmap: where two
   bitmaps differ, the sets do, and linked sets differ little.
3. Rooms: what is connected forms a room; each set goes to its room once.
4. Prefix trees: a room's sets hang in a trie in the global order.  A set walks the tree; overlap along a
   path is shared by all sets below it, and a subtree is left where overlap and remaining lengths can't
   reach the threshold.  Verdicts are exact.  Sets already connected aren't compared again, so a
   large group of near copies costs about one walk.
   A room above ``ROOM_GRAMS`` grams is dealt to blocks of about ``BLOCK_GRAMS``.  Each block is walked with the
   first one, by separate tasks; in a group of near copies that connects nearly all.  What is then not
   in the room's greatest component is away, and two sets that aren't away needn't meet.  Away sets meet every block
   of the room, or, where that moves fewer grams, sets meet by the grams of their prefixes:
   linked sets have one in common among the first quarter of each, so a set goes to as many groups at
   most as its prefix has grams, and work grows with the room, not its square.
5. Links become components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, even_keys, gram_hashes, hash_words, leave, materialize, mix, raw, release, shuffle_parts, slices, trimmed, trimmed_group
from tidemark.llm.graph import components, spanning

N = 5
#: Similarity of at least NUM / DEN.
NUM, DEN = 75, 100
#: Cells of the sketch: about one for 100 grams, between these powers of two, so a task holds 4 to 128 MB
#: and broadcast levels are 1 to 32 MB.
CELL_BITS = (20, 25)
#: Neighbourships that linked sets must share in their prefixes.
SHARED = 4
#: Sets with one common key up to which pairs are counted.
PAIRS = 8
SKETCH_BLOCKS = 64
#: Bytes of text that a task has as words and hashes at once.
SLICE = 1 << 20
#: Index entries that a task holds before it sends them.
ENTRIES = 1 << 19
#: Grams of a room that one task walks; a larger one is dealt to blocks.
ROOM_GRAMS = 100_000
BLOCK_GRAMS = 25_000
#: What a gram sent by prefix costs, against one sent to a block.
PREFIX_COST = 1.0
#: Index entries of a part, about, where the session has no more shuffle partitions.
PART_ENTRIES = 2_000_000
#: What an edge of a forest counts.
SURE = 1 << 32
#: The same up to which a forest is exact; beyond, neighbours in size are chained.
WIDE = 20_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def gram_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; of fewer words the one gram of all; none of no word."""
    words = [t.translate(_LOWER).split() for t in texts]
    flat = hash_words([w for x in words for w in x])
    grams = gram_hashes(flat, n)
    out, at = [], 0
    for x in words:
        k = len(x)
        if k >= n:
            g = np.sort(grams[at : at + k - n + 1])
            out.append(g[np.concatenate(([True], g[1:] != g[:-1]))])
        else:
            out.append(gram_hashes(flat[at : at + k], k) if k else np.empty(0, np.uint64))
        at += k
    return out


def signature(grams: np.ndarray) -> tuple[int, int]:
    """128 bits for a set, as two signed longs."""
    if not len(grams):
        return 0, 0
    a, b = mix(grams).sum(), mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def ordered(grams: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Sorted keys in the global order: five bits of level, then the hash without its last five bits."""
    level = levels[(grams & np.uint64(len(levels) - 1)).astype(np.int64)].astype(np.uint64)
    return np.sort((level << np.uint64(59)) | (grams >> np.uint64(5)))


def breaks(n: int) -> int:
    """Most neighbourships of a set of n grams that another set can break and still link with it."""
    m = np.arange(-(-NUM * n // DEN), DEN * n // NUM + 1)
    return int((2 * n + m - 3 * -(-NUM * (n + m) // (NUM + DEN))).max())


def least_shared(n: int) -> int:
    """Neighbourships that a set of n grams must share with any different set it links with; n is 3 at least."""
    return min(SHARED, n - 1 - breaks(n))


def bitmap(grams: np.ndarray) -> np.ndarray:
    """Parity of the grams in each of 2**k bits, 64 at least and n at least."""
    bits = max(6, int(len(grams) - 1).bit_length())
    return (np.bincount((mix(grams) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1).astype(np.uint8)


def may_link(a: bytes, n: int, b: bytes, m: int) -> bool:
    """False only if the packed bitmaps of sets of n and m grams show that they differ too much."""
    x, y = (np.unpackbits(np.frombuffer(z, np.uint8)) for z in (a, b))
    if len(x) < len(y):
        x, y = y, x
    x = np.bitwise_xor.reduce(x.reshape(len(y), -1), axis=1)
    return (NUM + DEN) * int((x != y).sum()) <= (DEN - NUM) * (n + m)


def needed(a: int, b: int) -> int:
    """Least overlap of linked sets of a and b grams."""
    return -(-NUM * (a + b) // (NUM + DEN))


# 1. classes and sketch ---------------------------------------------------------------------------

_HEAD = "kind int, doc_id long, n long, a long, b long, cells binary"


def _cell_bits(docs: DataFrame) -> int:
    """From the size that the plan expects of its input, which only the order's quality depends on."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 1 << 60:  # unknown
        return CELL_BITS[0]
    return max(CELL_BITS[0], min(CELL_BITS[1], (size // 800).bit_length()))


def _heads(n: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, kinds = np.zeros(1 << bits, np.uint32), pa.int32()
        names = ["kind", "doc_id", "n", "a", "b", "cells"]
        for b in slices(batches, "text", SLICE):
            sets = gram_sets(raw(b.column(1)), n)
            every = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            cells += np.bincount((every & np.uint64(len(cells) - 1)).astype(np.int64), minlength=len(cells)).astype(np.uint32)
            sig = [signature(s) for s in sets]
            m = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m), kinds), b.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array([s[0] for s in sig], pa.int64()), pa.array([s[1] for s in sig], pa.int64()), pa.array([np.packbits(bitmap(g)).tobytes() for g in sets], pa.binary())], names)
        if cells.any():
            parts = np.split(cells, SKETCH_BLOCKS)
            zero = pa.array([0] * SKETCH_BLOCKS, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([1] * SKETCH_BLOCKS, kinds), pa.array(range(SKETCH_BLOCKS), pa.int64()), zero, zero, zero, pa.array([p.tobytes() for p in parts], pa.binary())], names)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the cells of each block; counts become bytes of 8 * log2, the form that is collected."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for k, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            c = np.frombuffer(cells, np.uint32).astype(np.int64)
            sums[k] = sums[k] + c if k in sums else c
    if sums:
        logs = [np.minimum(np.round(4 * np.log2(s + 1.0)), 255).astype(np.uint8).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(logs, pa.binary())], ["block", "logs"])


def _levels(heads: DataFrame, bits: int) -> np.ndarray:
    """Level of each cell, 0 to 31: 0 up to twice the median count, then quarter octaves."""
    rows = heads.filter("kind = 1").select(F.col("doc_id").alias("block"), "cells").repartition(SKETCH_BLOCKS, "block").mapInArrow(trimmed(_merge), "block long, logs binary").collect()
    logs = np.zeros(1 << bits, np.uint8)
    size = len(logs) // SKETCH_BLOCKS
    for r in rows:
        logs[r.block * size : (r.block + 1) * size] = np.frombuffer(r.logs, np.uint8)
    base = int(np.median(logs)) + 3
    return np.clip(logs.astype(np.int64) - base, 0, 31).astype(np.uint8)


# 2. prefix index ---------------------------------------------------------------------------------


def _index(n: int, parts: int, keys_of: list[int], sent):
    """Packed prefix entries: per part the entries' keys, their set's number, remaining length; and the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, seen, prefix_of = sent.value, set(), {}
        held: list[tuple[np.ndarray, int, int, int]] = []
        count = 0

        def send() -> pa.RecordBatch:
            keys = np.concatenate([h[0] for h in held])
            size = np.array([len(h[0]) for h in held])
            sig, n_of = np.array([h[1] for h in held], np.int64), np.array([h[2:] for h in held], np.int32)
            who = np.repeat(np.arange(len(held), dtype=np.int32), size)
            place = np.arange(len(keys), dtype=np.int32) - np.repeat(np.cumsum(size) - size, size).astype(np.int32)
            part = (mix(keys) % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.int32)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order])) + 1
            rows = []
            for o in np.split(order, cuts):
                own, inv = np.unique(who[o], return_inverse=True)
                rows.append((keys_of[part[o[0]]], keys[o].tobytes(), np.diff(inv, prepend=0).astype(np.uint16).tobytes() if len(own) < 1 << 16 else b"", inv.astype(np.int32).tobytes() if len(own) >= 1 << 16 else b"", place[o].tobytes(), sig[own].tobytes(), n_of[own].tobytes()))
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32())] + [pa.array(c, pa.binary()) for c in cols[1:]], ["part", "keys", "step", "who", "place", "sig", "n"])

        for b in slices(batches, "text", SLICE):
            for grams in gram_sets(raw(b.column(0)), n):
                size = len(grams)
                if size < 3:  # smaller sets link with equal ones only, which are their class
                    continue
                sig = signature(grams)
                if sig in seen:
                    continue
                if len(seen) > 2_000_000:
                    seen.clear()
                seen.add(sig)
                if size not in prefix_of:
                    prefix_of[size] = (breaks(size) + least_shared(size), least_shared(size))
                prefix, least = prefix_of[size]
                first = ordered(grams, levels)[: prefix + 1]
                held.append((mix(mix(first[:-1]) + first[1:]), sig[0], size, least))
                count += prefix
                if count >= ENTRIES:
                    yield send()
                    held.clear()
                    count = 0
        if held:
            yield send()

    return run


_INDEX = "part int, keys binary, step binary, who binary, place binary, sig binary, n binary"


_PAIRS = "part int, u binary, v binary, shared binary, need binary"


def _chain(parts: int, keys_of: list[int]):
    """Possible pairs (u, v) of a part, how many keys they share here and must in all, packed by the part that counts them."""

    def run(table: pa.Table) -> pa.Table:
        rows, shared = _possible(table)
        to = (mix(mix(rows[:, 0].view(np.uint64)) + rows[:, 1].view(np.uint64)) % np.uint64(parts)).astype(np.int32) if len(rows) else np.empty(0, np.int32)
        order = np.argsort(to, kind="stable")
        out = [(keys_of[to[o[0]]], rows[o, 0].tobytes(), rows[o, 1].tobytes(), shared[o].tobytes(), rows[o, 2].tobytes()) for o in (np.split(order, np.flatnonzero(np.diff(to[order])) + 1) if len(order) else [])]
        cols = list(zip(*out, strict=True)) or [()] * 5
        return pa.table([pa.array(cols[0], pa.int32())] + [pa.array(c, pa.binary()) for c in cols[1:]], names=["part", "u", "v", "shared", "need"])

    return run


def _counted(table: pa.Table) -> pa.Table:
    """Pairs of a counting part that share as many keys as they must."""
    u, v, shared, need = (np.concatenate([np.frombuffer(x, np.int64) for x in table.column(c).to_pylist()]) for c in ("u", "v", "shared", "need"))
    order = np.lexsort((v, u))
    u, v, shared, need = u[order], v[order], shared[order], need[order]
    first = np.flatnonzero(np.concatenate(([True], (u[1:] != u[:-1]) | (v[1:] != v[:-1]))))
    total, least = np.add.reduceat(shared, first), np.minimum.reduceat(need, first)
    keep = total >= least
    return pa.table({"u": u[first][keep], "v": v[first][keep], "shared": total[keep]})


def _possible(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows (u, v, need) and the count of shared keys here."""
    keys, sigs, sizes, places, leasts = [], [], [], [], []
    for k, step, who, place, sig, n in zip(*(table.column(c).to_pylist() for c in ("keys", "step", "who", "place", "sig", "n")), strict=True):
        own = np.frombuffer(who, np.int32) if who else np.cumsum(np.frombuffer(step, np.uint16).astype(np.int64))
        n_of = np.frombuffer(n, np.int32).astype(np.int64).reshape(-1, 2)[own]
        keys.append(np.frombuffer(k, np.uint64))
        sigs.append(np.frombuffer(sig, np.int64)[own])
        sizes.append(n_of[:, 0])
        leasts.append(n_of[:, 1])
        places.append(np.frombuffer(place, np.int32).astype(np.int64))
    key, sig, n, place, least = map(np.concatenate, (keys, sigs, sizes, places, leasts))
    order = np.argsort(key, kind="stable")
    key = key[order]
    twin = np.zeros(len(key), bool)
    twin[1:] = key[1:] == key[:-1]
    twin[:-1] |= twin[1:]
    order, key = order[twin], key[twin]
    sig, n, place, least = sig[order], n[order], place[order], least[order]
    order = np.lexsort((sig, n, key))
    key, sig, n, place, least = key[order], sig[order], n[order], place[order], least[order]
    if len(key):  # the same set from several tasks
        keep = np.ones(len(key), bool)
        keep[1:] = (key[1:] != key[:-1]) | (sig[1:] != sig[:-1]) | (n[1:] != n[:-1])
        key, sig, n, place, least = key[keep], sig[keep], n[keep], place[keep], least[keep]
    def fit(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether sizes and places allow the overlap that a link needs."""
        most = np.minimum(place[i], place[j]) + np.minimum(n[i] - place[i], n[j] - place[j])
        return (NUM + DEN) * most >= NUM * (n[i] + n[j])

    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    size = np.diff(np.append(start, len(key)))
    two = start[size == 2]
    two = two[fit(two, two + 1)]
    u, v, sure = [two], [two + 1], []
    for at, k in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        one = slice(at, at + k)
        if k <= PAIRS:
            i, j = np.triu_indices(k, 1)
            ok = fit(at + i, at + j)
            u.append(at + i[ok])
            v.append(at + j[ok])
        else:
            sure.append(at + np.stack(_forest(n[one], DEN * n[one] // NUM), 1))
    u, v = np.concatenate(u), np.concatenate(v)
    need = np.minimum(least[u], least[v])
    rows = np.stack([np.maximum(sig[u], sig[v]), np.minimum(sig[u], sig[v]), need], 1) if len(u) else np.empty((0, 3), np.int64)
    order = np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))
    rows = rows[order]
    first = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]).any(1)))) if len(rows) else np.empty(0, np.int64)
    shared = np.diff(np.append(first, len(rows)))
    rows = rows[first]
    # what is certain here already needs no counting elsewhere, and a forest says it: pairs that share enough in this
    # part, and the edges that stand for pairs of common keys
    done = shared >= rows[:, 2]
    e = [rows[done, :2]]
    if sure:
        i, j = np.concatenate(sure).T
        e.append(np.stack([sig[i], sig[j]], 1))
    e = spanning(np.concatenate(e))
    rows = np.concatenate([rows[~done], np.concatenate([e, np.zeros((len(e), 1), np.int64)], 1)])
    shared = np.concatenate([shared[~done], np.full(len(e), SURE)])
    keep = rows[:, 0] != rows[:, 1]
    return rows[keep], shared[keep].astype(np.int64)


def _fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose bitmaps allow a link."""
    for b in batches:
        shared, m, n, x, y = (b.column(k).to_pylist() for k in (2, 3, 4, 5, 6))
        keep = [s >= SURE or may_link(p, i, q, j) for s, i, j, p, q in zip(shared, m, n, x, y, strict=True)]
        if any(keep):
            yield b.filter(pa.array(keep)).select(["u", "v"])


def _forest(n: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect just what possible pairs connect: sizes n, ascending, and largest partner sizes.

    Beyond ``WIDE`` sets, neighbours in size are chained as far as any set before them reaches; that
    connects at least as much.
    """
    k = len(n)
    if k > WIDE:
        at = np.flatnonzero(n[1:] <= np.maximum.accumulate(most)[:-1]) + 1
        return at, at - 1
    label, u, v = np.arange(k), [], []
    for y in range(1, k):
        x = np.flatnonzero((n[:y] <= most[y]) & (n[y] <= most[:y]))
        if len(x):
            groups, first = np.unique(label[x], return_index=True)
            u += [y] * len(first)
            v += x[first].tolist()
            if len(groups) > 1:
                label[:y][np.isin(label[:y], groups)] = groups[0]
            label[y] = groups[0]
    return np.array(u, np.int64), np.array(v, np.int64)


# 4. prefix trees ---------------------------------------------------------------------------------


class PrefixTree:
    """A trie of sets in the global order, kept as sorted sets, each with the depth that it shares with the one before."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.sets = [sets[i] for i in self.order]
        self.shared = [0]
        for a, b in zip(self.sets, self.sets[1:], strict=False):
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            self.shared.append(int(differ[0]) if len(differ) else m)

    def similar(self, probe: np.ndarray, wanted: list[bool]) -> list[int]:
        """Sets (by number) among the wanted ones that link with the probe."""
        out, n = [], len(probe)
        path: list[tuple[int, np.ndarray]] = []  # depth where a segment begins, overlap after each of its grams
        dead = -1  # within a subtree below this depth nothing can link
        for k, (own, grams, depth) in enumerate(zip(self.order, self.sets, self.shared, strict=True)):
            if dead >= 0 and depth >= dead:
                continue
            dead = -1
            while path and path[-1][0] >= depth:
                path.pop()
            base = int(path[-1][1][depth - path[-1][0] - 1]) if depth else 0
            size = len(grams)
            least = needed(n, size)
            segment = grams[depth:]
            below = k + 1 < len(self.sets) and self.shared[k + 1] > depth
            if not below:
                if not wanted[own] or DEN * min(n, size) < NUM * max(n, size):
                    continue
                # the head of the segment first: where it misses too much, the rest can't make up
                head = segment[: max(8, size // 3)]
                met = base + int((probe[np.minimum(np.searchsorted(probe, head), n - 1)] == head).sum()) if len(head) else base
                passed = int(np.searchsorted(probe, head[-1], side="right")) if len(head) else 0
                if met + min(size - depth - len(head), n - passed) < least:
                    continue
                tail = segment[len(head) :]
                met += int((probe[np.minimum(np.searchsorted(probe, tail), n - 1)] == tail).sum()) if len(tail) else 0
            else:
                hit = np.cumsum(probe[np.minimum(np.searchsorted(probe, segment), n - 1)] == segment) + base
                path.append((depth, hit))
                met = int(hit[-1]) if len(hit) else base
                fork = self.shared[k + 1]
                at = fork - depth
                passed = int(np.searchsorted(probe, segment[at - 1], side="right"))
                # every set below the fork has more than ``fork`` grams; the bound grows with its size
                if int(hit[at - 1]) + (n - passed) < needed(n, fork):
                    dead = fork
            if wanted[own] and met >= least:
                out.append(own)
        return out


def link_room(ids: list[int], sets: list[np.ndarray], away: list[bool] | None = None) -> list[tuple[int, int]]:
    """Links (larger, smaller id) that connect just those ids that any links of the room connect.

    With ``away``, sets that aren't away are known to be connected: they are found, but nothing starts from them.
    """
    tree, found = PrefixTree(sets), []
    away = away or [True] * len(sets)
    free = [True] * len(sets)
    for first in sorted(range(len(sets)), key=lambda i: ids[i]):
        if not free[first] or not away[first]:
            continue
        free[first], queue = False, [first]
        while queue:
            at = queue.pop()
            hits = tree.similar(sets[at], free)
            home = [k for k in hits if not away[k]]
            for k in [*(k for k in hits if away[k]), *home[:1]]:  # one link to what is connected is enough
                if away[k]:
                    free[k] = False
                    queue.append(k)
                found.append((max(ids[first], ids[k]), min(ids[first], ids[k])))
    return found


def _walk(table: pa.Table) -> pa.Table:
    ids = table.column("doc_id").to_pylist()
    sets = [np.frombuffer(g, np.uint64) for g in table.column("grams").to_pylist()]
    found = link_room(ids, sets, table.column("away").to_pylist())
    return pa.table({"u": pa.array([f[0] for f in found], pa.int64()), "v": pa.array([f[1] for f in found], pa.int64())})


def prefix_groups(grams: np.ndarray, groups: int) -> list[int]:
    """The groups of the grams among which linked sets, in order, have one in common."""
    return np.unique(mix(grams[: len(grams) - -(-NUM * len(grams) // DEN) + 1]) % np.uint64(groups)).tolist()


# the join ----------------------------------------------------------------------------------------


def classes(docs: DataFrame, n: int = N) -> tuple[DataFrame, DataFrame]:
    """Per row with an id: doc_id, n (grams), a, b (signature); and links (u, v) between class representatives."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL")
    spark = docs.sparkSession
    bits = _cell_bits(rows)
    heads = leave(materialize(rows.mapInArrow(trimmed(_heads(n, bits)), _HEAD), "heads"))
    sent = spark.sparkContext.broadcast(_levels(heads, bits))
    base = heads.filter("kind = 0").select("doc_id", "n", "a", "b")
    entries = (base.agg(F.sum("n")).first()[0] or 0) // 2
    parts = max(shuffle_parts(spark), -(-entries // PART_ENTRIES))
    keys_of = even_keys(parts)
    index = rows.select("text").mapInArrow(trimmed(_index(n, parts, keys_of, sent)), _INDEX)
    pairs = index.groupBy("part").applyInArrow(trimmed_group(_chain(parts, keys_of)), _PAIRS).groupBy("part").applyInArrow(trimmed_group(_counted), "u long, v long, shared long")
    pairs = materialize(pairs, "pairs")
    release(spark)
    maps = heads.filter("kind = 0").groupBy("a", "b").agg(F.first("n").alias("n"), F.first("cells").alias("bits"))
    both = pairs.join(maps.select(F.col("a").alias("u"), F.col("n").alias("m"), F.col("bits").alias("x")), "u").join(maps.select(F.col("a").alias("v"), "n", F.col("bits").alias("y")), "v")
    fitting = both.select("u", "v", "shared", "m", "n", "x", "y").mapInArrow(trimmed(_fitting), "u long, v long")
    room_of = materialize(components(fitting), "rooms")
    reps = base.filter("n > 0").groupBy("a", "b").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    placed = reps.join(room_of.withColumnRenamed("node", "a"), "a").select("doc_id", "n", F.col("root").alias("room"))
    weight = placed.groupBy("room").agg(F.sum("n").alias("grams"))
    blocks = F.when(F.col("grams") <= ROOM_GRAMS, 1).otherwise(F.ceil(F.col("grams") / F.lit(float(BLOCK_GRAMS)))).cast("int")
    placed = placed.join(weight, "room").withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    placed = materialize(placed.select("doc_id", "n", "room", "blocks", "mine"), "placed")

    spot = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32())]))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            grams = [ordered(g, sent.value) for g in gram_sets(raw(b.column(4)), n)]
            spots = [s if g[0]["j"] >= 0 else [{"i": k, "j": -1} for k in prefix_groups(x, g[0]["i"])] for x, g in zip(grams, b.column(2).to_pylist(), strict=True) for s in [g]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spots, spot), b.column(3), pa.array([g.tobytes() for g in grams], pa.binary())], ["doc_id", "room", "spots", "away", "grams"])

    def walked(spots: DataFrame) -> DataFrame:
        """Links within the parts of rooms that spots (doc_id, room, away, array of part numbers i, j) name.

        One spot (i, -1) stands for the prefix's groups, of i.
        """
        # a repeated doc_id with another text brings that text into the room too: verdicts are on sets
        texts = rows.join(spots.hint("shuffle_hash"), "doc_id").select("doc_id", "room", "spots", "away", "text")
        held = texts.mapInArrow(trimmed(sets), "doc_id long, room long, spots array<struct<i:int,j:int>>, away boolean, grams binary")
        held = held.select("room", "doc_id", "away", "grams", F.explode("spots").alias("s")).select("room", "s.i", "s.j", "doc_id", "away", "grams")
        return leave(materialize(held.groupBy("room", "i", "j").applyInArrow(trimmed_group(_walk), "u long, v long"), "links"))

    at = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    zero, mine = F.lit(0), F.col("mine")
    star = F.when((F.col("blocks") > 1) & (mine == 0), F.transform(F.sequence(F.lit(1), F.greatest(F.col("blocks") - 1, F.lit(1))), lambda j: at(zero, j))).otherwise(F.array(at(zero, mine)))
    links = walked(placed.select("doc_id", "room", F.lit(True).alias("away"), star.alias("spots")))
    large = placed.filter("blocks > 1")
    if large.limit(1).count():
        links = links.union(_rest(large, links, walked))
    discard(pairs, room_of, placed)
    return base, links


def _rest(large: DataFrame, links: DataFrame, walked) -> DataFrame:
    """Links of rooms in blocks that the walks with the first block left open."""
    comp = components(links)
    big = materialize(large.join(comp, large.doc_id == comp.node, "left").select("doc_id", "n", "room", "blocks", "mine", F.coalesce("root", "doc_id").alias("comp")), "big")
    sizes = big.groupBy("room", "comp").agg(F.count("*").alias("size"))
    main = sizes.groupBy("room").agg(F.max_by("comp", F.struct("size", "comp")).alias("main"), F.count("*").alias("kinds")).filter("kinds > 1").drop("kinds")
    rest = big.join(main, "room").withColumn("away", F.col("comp") != F.col("main"))
    prefix = F.col("n") - F.ceil(F.lit(NUM) * F.col("n") / F.lit(float(DEN))) + 1
    gone = F.sum(F.when(F.col("away"), F.col("n")).otherwise(0))
    weight = rest.groupBy("room").agg(gone.alias("gone"), F.sum("n").alias("grams"), F.sum(F.col("n") * prefix).alias("sent"), F.first("blocks").alias("b"))
    groups = F.ceil(F.col("gone") / F.lit(float(BLOCK_GRAMS))).cast("int")
    cheaper = F.col("sent") * F.lit(PREFIX_COST) < F.col("gone") * F.col("b") + F.col("grams") * groups
    weight = weight.select("room", groups.alias("groups"), F.ceil(F.col("sent") / F.lit(float(ROOM_GRAMS))).cast("int").alias("shares"), cheaper.alias("cheaper"))
    rest = rest.join(weight, "room")
    at = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    own = F.transform(upto("groups"), lambda i: at(i, F.col("mine")))
    group = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("groups"))
    out = F.transform(upto("blocks"), lambda j: at(group, j))
    by_prefix = F.array(at(F.col("shares"), F.lit(-1)))
    spots = F.when(F.col("cheaper"), by_prefix).when(F.col("away"), F.array_union(own, out)).otherwise(own)
    found = walked(rest.select("doc_id", "room", "away", spots.alias("spots")))
    discard(big)
    return found


def jaccard_components(docs: DataFrame, n: int = N) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id per row of docs.

    component_id is the least doc_id reachable by links (Jaccard of word n-gram sets at least NUM / DEN), class_id
    the least doc_id with the same set.  Texts without a word, and null texts, have an empty set and
    are linked with nothing, so both ids are their own.  Rows with a null doc_id return nulls for both
    and are linked with nothing.  Repeated rows stay.  Other columns are ignored.
    """
    base, links = classes(docs, n)
    comp = components(links)
    reps = base.filter("n > 0").groupBy("a", "b").agg(F.min("doc_id").alias("class_id"))
    reps = reps.join(comp, reps.class_id == comp.node, "left").select("a", "b", "class_id", F.coalesce("root", "class_id").alias("component_id"))
    out = base.join(reps, ["a", "b"], "left")
    own = F.col("n") == 0
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(own, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            nulls = pa.nulls(b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([nulls, pa.array([len(g) for g in gram_sets(raw(b.column(0)), n)], pa.int64()), nulls, nulls], ["doc_id", "n_shingles", "component_id", "class_id"])

    nameless = docs.filter(F.col("doc_id").isNull()).select(F.col("text").cast("string").alias("text"))
    return out.union(nameless.mapInArrow(sizes, out.schema))


def deduplicate(docs: DataFrame, n: int = N) -> DataFrame:
    """docs without near copies: of each component the row with the least doc_id stays, with all its columns.

    Rows with a null doc_id are linked with nothing and all stay.
    """
    report = jaccard_components(docs.select("doc_id", "text"), n)
    keep = report.filter("doc_id = component_id").select("doc_id").distinct()
    named = docs.filter(F.col("doc_id").isNotNull())
    return named.join(keep.hint("shuffle_hash"), "doc_id", "left_semi").select(*docs.columns).union(docs.filter(F.col("doc_id").isNull()))
