"""Removal of repeated byte strings by suffix arrays of sampled suffixes.

Every byte covered by a ``LEAST``-byte string that also starts in a document with a smaller id goes.
Sorting and moving every suffix of a large corpus takes several times its size on disk, so suffixes are sampled
by content: of each LEAST-byte string the position of the least ``GRAM``-byte hash is an anchor
(winnowing), which equal strings share.  Each anchor stands for the strings around it, its context of
LEAST - GRAM bytes on either side.

1. Texts are dealt by a hash of doc_id once, into a bucketed table, which later steps read in place.
2. Each task's anchors are cut, by binary search of the cuts of the hash range, into parts; equal grams of all
   tasks meet.  Of equal contexts every one but the smallest document's is covered; grams with several
   contexts ask for those contexts' bytes, once per distinct context.  Answers go to buckets of documents
   as packed sets of hashes of (document, context).
3. A part cuts its contexts into shards of ``SHARD``.  Each shard gets its suffix array by Larsson and
   Sadakane: suffixes are ranked by 8 bytes, then doubled, 16, 32, LEAST, and only suffixes that still
   share a rank are sorted again.  Kasai's scan gives the common prefix of neighbours in it; neighbours
   with LEAST bytes in common are equal strings.  Shards that share a gram are merged by binary search of
   each one's strings in the others.
4. Covered intervals return to the buckets of their documents.

No gram's contexts gather without bound.  Grams that a sample finds in very many contexts are dealt by
context instead, and a gram with more than ``WIDE`` contexts sends hashes of its strings, of which each
bucket keeps the smallest document's, so that a string costs one entry a bucket, however common it is.

Steps 2 and 4 compare 64-bit hashes (of a context within its gram, of a document's context, of a wide gram's
string), not bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import data_parts, dealt, discard, even_keys, long_hash, materialize, mix, raw, release, slices, trimmed, trimmed_group, trimmed_pair, winnow

LEAST, GRAM = 50, 24
SIDE = LEAST - GRAM
CONTEXT = GRAM + 2 * SIDE
PAD = 32
#: Anchors that a task holds before it sends them.
ENTRIES = 1 << 19
#: Bytes of text that are held as arrays at once; a longer text is one batch.
BATCH = 1 << 20
#: Bytes of text for each part and bucket, about, where the session has no more shuffle partitions.
PART_BYTES = 32 << 20
#: Contexts in one suffix array.
SHARD = 8_000
#: A gram with more contexts sends hashes of its strings.
WIDE = 20_000
#: One document in so many is read for common grams, of which so many at most go to every task.
SAMPLE, COMMON = 16, 4_096


def words8(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one number."""
    w = buf.astype(np.uint64)
    w = w[:-1] | (w[1:] << np.uint64(8))
    w = w[:-2] | (w[2:] << np.uint64(16))
    return w[:-4] | (w[4:] << np.uint64(32))


class Anchors:
    """Anchors of some texts: text number, place in the text, gram hash, context hash, bytes at hand on both sides."""

    def __init__(self, texts: list[bytes]):
        self.buf = np.frombuffer(bytes(PAD) + bytes(PAD).join(texts) + bytes(PAD), np.uint8)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        start = np.cumsum(size + PAD) - size
        long = size >= LEAST
        marks = np.zeros(len(self.buf) + 1, np.int32)
        marks[start[long]] = 1
        marks[(start + size - GRAM + 1)[long]] = -1
        ok = np.cumsum(marks[: len(self.buf) - GRAM + 1]).astype(bool)
        self.w8 = w8 = words8(self.buf)
        h = np.zeros(len(ok), np.uint64)
        for j in range(0, GRAM, 8):
            h = (h ^ w8[j : j + len(ok)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        h[~ok] = ~np.uint64(0)
        at = winnow(h, LEAST - GRAM + 1)
        at = at[ok[at]]
        self.at, self.gram = at, mix(h[at])
        self.text = np.searchsorted(start, at, side="right") - 1
        self.place = at - start[self.text]
        self.left = np.minimum(self.place, SIDE)
        self.right = np.minimum(size[self.text] - self.place - GRAM, SIDE)
        c = self.left.astype(np.uint64) * np.uint64(64) + self.right.astype(np.uint64)
        for j in range(-SIDE, GRAM + SIDE - 7, 8):
            c = mix(c + self._word(at + j))
        self.context = mix(c + self._word(at + GRAM + SIDE - 8))

    def _word(self, at: np.ndarray) -> np.ndarray:
        """8 bytes from each place, zero for bytes outside the text (PAD is wider than SIDE reaches)."""
        return self.w8[np.clip(at, 0, len(self.w8) - 1)]

    def contexts(self, which: np.ndarray) -> np.ndarray:
        """Rows of CONTEXT bytes."""
        return self.buf[np.clip(self.at[which][:, None] + np.arange(-SIDE, GRAM + SIDE), 0, len(self.buf) - 1)]

    def strings(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the LEAST-byte strings in some contexts: the anchor's index, the place in the text, a hash."""
        o = np.arange(SIDE + 1) - SIDE
        real = (o >= -self.left[which][:, None]) & (o + LEAST <= GRAM + self.right[which][:, None])
        row, col = np.nonzero(real)
        at = self.at[which][row] + o[col]
        h = np.full(len(at), LEAST, np.uint64)
        for j in (*range(0, LEAST - 8, 8), LEAST - 8):
            h = mix(h + self.w8[at + j])
        return which[row], self.place[which][row] + o[col], h


def _cuts(parts: int) -> np.ndarray:
    return np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)


def _home(doc_hash: np.ndarray, parts: int) -> np.ndarray:
    """The bucket of a document, as Spark's pmod(xxhash64(doc_id), parts)."""
    return doc_hash.view(np.int64) % parts


def _groups(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each key and the positions of its entries."""
    order = np.argsort(keys, kind="stable")
    if len(order):
        for o in np.split(order, np.flatnonzero(np.diff(keys[order])) + 1):
            yield int(keys[o[0]]), o


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _numbers(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The packed numbers of all rows."""
    return np.concatenate([np.empty(0, kind), *(np.frombuffer(x, kind) for x in column.to_pylist() if x)])


def _inside(table: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Whether each wanted number is in the sorted table."""
    if not len(table):
        return np.zeros(len(wanted), bool)
    return table[np.minimum(np.searchsorted(table, wanted), len(table) - 1)] == wanted


def _low40(gram: np.ndarray) -> np.ndarray:
    """What is sent of a gram's hash."""
    return gram & np.uint64((1 << 40) - 1)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams with several contexts in this task's sample, and how many."""
    held = [(a.gram, a.context) for b in slices(batches, "text", BATCH) for a in [Anchors(raw(b.column(0)))]]
    if held:
        gram, context = (np.concatenate(x) for x in zip(*held, strict=True))
        gram = gram[np.unique(context, return_index=True)[1]]
        names, n = np.unique(gram, return_counts=True)
        names, n = names[n > 3], n[n > 3]
        yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n)], ["gram", "n"])


def common_grams(texts: DataFrame) -> np.ndarray:
    """The most common of the grams with about WIDE contexts, at most COMMON; only costs depend on the sample."""
    few = texts.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SAMPLE)) == 0).select("text")
    found = few.mapInArrow(trimmed(_sampled), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    rows = found.filter(F.col("n") * SAMPLE >= WIDE).orderBy(F.desc("n"), "gram").limit(COMMON).collect()
    return np.sort(np.array([r.gram for r in rows], np.int64).view(np.uint64))


_SENT = pa.schema([("part", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("context", pa.binary()), ("step", pa.binary()), ("docs", pa.binary()), ("done", pa.binary())])


def _send_anchors(parts: int, keys: list[int], common: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = _cuts(parts)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def send() -> pa.RecordBatch:
            gram, context, doc = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            # of equal contexts only the smallest document's goes to the gram's part; the rest are covered, and their
            # documents' buckets are told, so that no part has to take a very common text from everyone
            order = np.lexsort((doc, context))
            first = np.ones(len(order), bool)
            first[1:] = context[order][1:] != context[order][:-1]
            least = doc[order][np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
            covered = np.zeros(len(order), bool)
            covered[order] = doc[order] > least
            named = long_hash(doc)
            part = np.searchsorted(cuts, np.where(_inside(common, gram), mix(context), gram), side="right")
            part[covered] = _home(named[covered], parts)
            rows = []
            for p, o in _groups(part.astype(np.uint16 if parts <= 1 << 16 else np.int32)):
                c, o = o[covered[o]], o[~covered[o]]
                own, inv = np.unique(doc[o], return_inverse=True)
                by = np.argsort(inv, kind="stable")
                o, inv = o[by], inv[by]
                step = np.diff(inv, prepend=0).astype(np.uint32)
                rows.append((keys[p], gram[o].astype(np.uint32).tobytes(), (gram[o] >> np.uint64(32)).astype(np.uint8).tobytes(), context[o].tobytes(), step.tobytes(), own.tobytes(), np.unique(mix(context[c] ^ named[c])).tobytes()))
            return _batch(rows, _SENT)

        count = 0
        for b in slices(batches, "text", BATCH):
            a = Anchors(raw(b.column(1)))
            held.append((a.gram, a.context, b.column(0).to_numpy()[a.text]))
            count += len(a.at)
            if count >= ENTRIES:
                count = 0
                yield send()
        if count:
            yield send()

    return run


#: Hashes of (document, context) for the documents of a bucket: covered, bytes wanted, hashes of strings wanted.
_ANSWER = pa.schema([("bucket", pa.int32()), ("covered", pa.binary()), ("wanted", pa.binary()), ("wide", pa.binary())])


def _answer(parts: int, keys: list[int], common: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        gram, context, doc = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for low, high, c, step, docs in zip(*(table.column(x).to_pylist() for x in ("low", "high", "context", "step", "docs")), strict=True):
            if c:
                gram.append(np.frombuffer(low, np.uint32).astype(np.uint64) | (np.frombuffer(high, np.uint8).astype(np.uint64) << np.uint64(32)))
                context.append(np.frombuffer(c, np.uint64))
                doc.append(np.frombuffer(docs, np.int64)[np.cumsum(np.frombuffer(step, np.uint32).astype(np.int64))])
        gram, context, doc = map(np.concatenate, (gram, context, doc))
        often = np.sort(_low40(common))
        order = np.argsort(gram)
        g = gram[order]
        twin = _inside(often, g)
        twin[1:] |= g[1:] == g[:-1]
        twin[:-1] |= g[1:] == g[:-1]
        order = order[twin]
        gram, context, doc = gram[order], context[order], doc[order]
        order = np.lexsort((doc, context, gram))
        gram, context, doc = gram[order], context[order], doc[order]
        n = len(gram)
        covered = wanted = wide = np.zeros(n, bool)
        if n:
            new_gram, new_context = np.ones(n, bool), np.ones(n, bool)
            new_gram[1:] = gram[1:] != gram[:-1]
            new_context[1:] = new_gram[1:] | (context[1:] != context[:-1])
            covered = doc > doc[np.flatnonzero(new_context)][np.cumsum(new_context) - 1]
            group, starts = np.cumsum(new_gram) - 1, np.flatnonzero(new_gram)
            kinds = np.bincount(group[new_context])
            everywhere = _inside(often, gram[starts])
            several = (kinds > 1) & (np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)) | everywhere
            # a document's context may occur in it more than once; one request finds them all
            asked = new_context & several[group]
            wide = asked & ((kinds > WIDE) | everywhere)[group]
            wanted = asked & ~wide
        named = long_hash(doc)
        what, home = mix(context ^ named), _home(named, parts)
        found: dict[int, list[np.ndarray]] = {}
        for k, mask in enumerate((covered, wanted, wide)):
            for bucket, o in _groups(home[mask]):
                found.setdefault(bucket, [np.empty(0, np.uint64)] * 3)[k] = what[mask][o]
        rows = [(keys[b], *(x.tobytes() for x in sets)) for b, sets in found.items()]
        if done := [x for x in table.column("done").to_pylist() if x]:  # of this very bucket's documents
            rows.append((table.column("part")[0].as_py(), b"".join(done), b"", b""))
        return pa.Table.from_batches([_batch(rows, _ANSWER)])

    return run


def merged(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Union of intervals as rows (start, end)."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1) if len(s) else np.empty(0, np.int64)
    return np.stack([s[new], e[last]], 1) if len(s) else np.empty((0, 2), np.int64)


def unions(rows: np.ndarray) -> np.ndarray:
    """Rows (document, text key, start, end), the intervals of each text merged."""
    order = np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))
    rows = rows[order]
    if not len(rows):
        return rows
    new = np.ones(len(rows), bool)
    new[1:] = (np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0)
    base = np.cumsum(new).astype(np.int64) << 40  # texts one after another, so that one running maximum serves all
    reach = np.maximum.accumulate(base + rows[:, 3]) - base
    new[1:] |= rows[1:, 2] > reach[:-1]
    first = np.flatnonzero(new)
    out = rows[first].copy()
    out[:, 3] = reach[np.append(first[1:] - 1, len(rows) - 1)]
    return out


_BYTES = pa.schema([("part", pa.int32()), *((c, pa.binary()) for c in ("gram", "bytes", "left", "right", "doc", "place", "strings", "runs"))])


def _send_contexts(parts: int, keys: list[int]):
    """From a bucket's texts and the answers to them: bytes of wanted contexts, strings of wide ones, intervals already known."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        cuts = _cuts(parts)
        covered, wanted, wide = (np.sort(_numbers(answers.column(c), np.uint64)) for c in ("covered", "wanted", "wide"))
        rows, runs, strings = [], [np.empty((0, 4), np.int64)], []
        for b in slices(iter(texts.to_batches() if answers.num_rows else []), "text", BATCH):
            a = Anchors(raw(b.column(3)))
            ids, tkeys = b.column(1).to_numpy(), b.column(2).to_numpy()
            probe = mix(a.context ^ long_hash(ids)[a.text])
            c = np.flatnonzero(_inside(covered, probe))
            runs.append(unions(np.stack([ids[a.text[c]], tkeys[a.text[c]], a.place[c] - a.left[c], a.place[c] + GRAM + a.right[c]], 1)))
            w = np.flatnonzero(_inside(wanted, probe))
            for p, o in _groups(np.searchsorted(cuts, a.gram[w], side="right")):
                o = w[o]
                o = o[np.argsort(a.gram[o], kind="stable")]
                rows.append((keys[p], a.gram[o].tobytes(), a.contexts(o).tobytes(), a.left[o].astype(np.uint8).tobytes(), a.right[o].astype(np.uint8).tobytes(), np.stack([ids[a.text[o]], tkeys[a.text[o]]], 1).tobytes(), a.place[o].tobytes(), b"", b""))
            o, place, h = a.strings(np.flatnonzero(_inside(wide, probe)))
            strings.append(np.stack([h.view(np.int64), ids[a.text[o]], tkeys[a.text[o]], place], 1))
        if strings:
            every = np.concatenate(strings)
            hit = every[:, 1] > _least(every[:, 0], every[:, 1])
            runs.append(_runs(every[hit]))
            kept = every[~hit]
            for p, o in _groups(np.searchsorted(cuts, mix(kept[:, 0].view(np.uint64)), side="right")):
                rows.append((keys[p], b"", b"", b"", b"", b"", b"", kept[o].tobytes(), b""))
        if len(known := unions(np.concatenate(runs))):
            rows.append((texts.column(0)[0].as_py(), b"", b"", b"", b"", b"", b"", b"", known.tobytes()))
        return pa.Table.from_batches([_batch(rows, _BYTES)])

    return run


def _least(string: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each entry the smallest document with its string."""
    order = np.lexsort((doc, string))
    s = string[order]
    first = np.ones(len(s), bool)
    first[1:] = s[1:] != s[:-1]
    out = np.empty(len(s), np.int64)
    out[order] = doc[order][np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))]
    return out


def _runs(entries: np.ndarray) -> np.ndarray:
    """Rows (document, text key, start, end) of entries (string, document, text key, start)."""
    return unions(np.concatenate([entries[:, 1:], entries[:, 3:] + LEAST], 1))


def suffix_array(rows: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Places in rows.ravel() of the suffixes with least bytes left in their row, in the order of those bytes.

    Larsson-Sadakane: a suffix's rank is the place in the order of the first one that is equal so far;
    ranks of 8 bytes, then of pairs of ranks at distance 8, 16, ...; a suffix alone in its rank is never
    sorted again.
    """
    m, width = rows.shape
    w8 = words8(np.concatenate([rows.ravel(), np.zeros(8, np.uint8)]))[: m * width].byteswap()  # as numbers in byte order
    sa = (np.arange(m)[:, None] * width + np.arange(width - 7)).ravel()
    key = w8[sa]
    order = np.argsort(key)
    sa, key = sa[order], key[order]
    rank = np.zeros(m * width, np.int64)
    new = np.ones(len(sa), bool)
    new[1:] = key[1:] != key[:-1]
    size = 8
    while True:
        slot = np.maximum.accumulate(np.where(new, np.arange(len(sa)), 0))
        rank[sa] = slot
        if size == least:
            return sa
        step = min(size, least - size)
        stay = sa % width <= width - size - step
        sa, slot = sa[stay], slot[stay]
        new = np.ones(len(sa), bool)
        new[1:] = slot[1:] != slot[:-1]
        alone = new.copy()
        alone[:-1] &= new[1:]
        shared = np.flatnonzero(~alone)
        pair = (slot[shared].astype(np.uint64) << np.uint64(32)) | rank[sa[shared] + step].astype(np.uint64)
        order = np.argsort(pair)
        sa[shared] = sa[shared][order]
        pair = pair[order]
        new[shared[1:]] |= pair[1:] != pair[:-1]
        size += step


def common_prefixes(rows: np.ndarray, sa: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Common prefix of each suffix of sa and the one before it, least at most, by Kasai's scan.

    The scan goes through all rows at once, from suffix to next suffix: where the neighbour's next suffix
    still comes earlier, all but one of the common bytes remain common and aren't read again.
    """
    m, width = rows.shape
    flat = rows.ravel()
    place = np.full(m * width + 1, -1, np.int64)
    place[sa] = np.arange(len(sa))
    out = np.zeros(len(sa), np.int64)
    same, before = np.zeros(m, np.int64), np.full(m, -1, np.int64)
    for o in range(width - least + 1):
        i = np.arange(m) * width + o
        p = place[i]
        after = before + 1
        keeps = (before >= 0) & (after % width > 0) & (place[after] >= 0) & (place[after] < p)
        before = np.where(p > 0, sa[p - 1], -1)
        same = np.where(keeps & (before >= 0), np.maximum(same - 1, 0), 0)
        open_ = np.flatnonzero((before >= 0) & (same < least))
        while len(open_):
            open_ = open_[flat[i[open_] + same[open_]] == flat[before[open_] + same[open_]]]
            same[open_] += 1
            open_ = open_[same[open_] < least]
        out[p] = same
    return out


class Shard:
    """Strings of some contexts: the suffix array's equal neighbours are one string; the smallest document of each."""

    def __init__(self, rows: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray, place: np.ndarray):
        sa = suffix_array(rows)
        new = common_prefixes(rows, sa) < LEAST
        at, o = sa // CONTEXT, sa % CONTEXT
        real = (o >= SIDE - left[at]) & (o + LEAST <= SIDE + GRAM + right[at])
        string = (np.cumsum(new) - 1)[real]
        at, o, sa = at[real], o[real], sa[real]
        first = np.ones(len(sa), bool)
        first[1:] = string[1:] != string[:-1]
        self.string = np.cumsum(first) - 1
        self.entries = np.concatenate([doc[at], (place[at] - SIDE + o)[:, None]], 1)
        heads = np.flatnonzero(first)
        self.least = np.minimum.reduceat(self.entries[:, 0], heads) if len(heads) else np.empty(0, np.int64)
        self.heads, self.flat = sa[heads], rows.ravel()

    def names(self) -> np.ndarray:
        """The strings in order."""
        return np.ascontiguousarray(self.flat[self.heads[:, None] + np.arange(LEAST)]).view(f"S{LEAST}").ravel()

    def runs(self) -> np.ndarray:
        """Rows (document, text key, start, end) of strings that a smaller document has."""
        e = self.entries[self.entries[:, 0] > self.least[self.string]]
        return unions(np.concatenate([e, e[:, 2:] + LEAST], 1))


def merge(shards: list[Shard]) -> None:
    """Tell each shard the smallest documents of its strings in the others, by binary search."""
    names = [s.names() for s in shards]
    least = [s.least.copy() for s in shards]
    for i, s in enumerate(shards):
        for j in range(len(shards)):
            if i != j and len(names[j]):
                at = np.minimum(np.searchsorted(names[j], names[i]), len(names[j]) - 1)
                s.least = np.where(names[j][at] == names[i], np.minimum(s.least, least[j][at]), s.least)


def _shards(gram: np.ndarray) -> Iterator[list[slice]]:
    """Lists of slices of sorted grams: whole grams up to SHARD contexts in one slice, a larger gram in several."""
    edges = np.append(np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1]))), len(gram))
    lo = 0
    while lo < len(edges) - 1:
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + SHARD, side="right")) - 1)
        a, b = int(edges[lo]), int(edges[hi])
        n = -(-(b - a) // SHARD)
        yield [slice(a + (b - a) * k // n, a + (b - a) * (k + 1) // n) for k in range(n)]
        lo = hi


def _cover(parts: int, keys: list[int]):
    """Intervals that earlier documents cover, packed by bucket, from the contexts and strings of this part."""

    def run(table: pa.Table) -> pa.Table:
        runs = [_numbers(table.column("runs"), np.int64).reshape(-1, 4)]
        strings = _numbers(table.column("strings"), np.int64).reshape(-1, 4)
        runs.append(_runs(strings[strings[:, 1] > _least(strings[:, 0], strings[:, 1])]))
        gram = _numbers(table.column("gram"), np.uint64)
        order = np.argsort(gram, kind="stable")
        rows = _numbers(table.column("bytes"), np.uint8).reshape(-1, CONTEXT)
        left, right = (_numbers(table.column(c), np.uint8).astype(np.int64)[order] for c in ("left", "right"))
        doc, place = _numbers(table.column("doc"), np.int64).reshape(-1, 2)[order], _numbers(table.column("place"), np.int64)[order]
        for cut in _shards(gram[order]) if len(gram) else ():
            shards = [Shard(rows[order[s]], left[s], right[s], doc[s], place[s]) for s in cut]
            if len(shards) > 1:
                merge(shards)
            runs += [s.runs() for s in shards]
        every = unions(np.concatenate(runs))
        out = [(keys[b], every[o].tobytes()) for b, o in _groups(_home(long_hash(every[:, 0]), parts))]
        return pa.Table.from_batches([_batch(out, pa.schema([("bucket", pa.int32()), ("runs", pa.binary())]))])

    return run


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
_OUT_SQL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _kept(doc: int | None, text: bytes, runs: np.ndarray) -> tuple:
    both = merged(runs[:, 0], runs[:, 1])
    sha, at = hashlib.sha256(), 0
    for s, e in both.tolist():
        sha.update(text[at:s])
        at = e
    sha.update(text[at:])
    return doc, len(text), int((both[:, 1] - both[:, 0]).sum()), len(both), sha.hexdigest()


def _finish(texts: pa.Table, runs: pa.Table) -> pa.Table:
    every = unions(_numbers(runs.column("runs"), np.int64).reshape(-1, 4))
    cut = np.flatnonzero((np.diff(every[:, 0]) != 0) | (np.diff(every[:, 1]) != 0)) + 1
    found = {(int(r[0, 0]), int(r[0, 1])): r[:, 2:] for r in np.split(every, cut) if len(r)}
    none = np.empty((0, 2), np.int64)
    out = []
    for b in slices(iter(texts.to_batches()), "text", BATCH):
        out.append(_batch([_kept(d, t, found.get((d, k), none)) for d, k, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), raw(b.column(3)), strict=True)], _OUT))
    return pa.Table.from_batches(out, _OUT)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = np.empty((0, 2), np.int64)
    for b in slices(batches, "text", BATCH):
        yield _batch([_kept(None, t, none) for t in raw(b.column(0))], _OUT)


def covered_runs(texts: DataFrame, parts: int, keys: list[int]) -> DataFrame:
    """bucket and runs: packed rows (doc_id, text key, start, end) that earlier documents cover."""
    spark = texts.sparkSession
    common = common_grams(texts)
    sent = texts.select("doc_id", "text").mapInArrow(trimmed(_send_anchors(parts, keys, common)), "part int, low binary, high binary, context binary, step binary, docs binary, done binary")
    answers = materialize(sent.groupBy("part").applyInArrow(trimmed_group(_answer(parts, keys, common)), "bucket int, covered binary, wanted binary, wide binary"), "answers")
    del sent
    release(spark)
    both = texts.groupBy("bucket").cogroup(answers.groupBy("bucket"))
    asked = both.applyInArrow(trimmed_pair(_send_contexts(parts, keys)), "part int, gram binary, bytes binary, left binary, right binary, doc binary, place binary, strings binary, runs binary")
    found = materialize(asked.groupBy("part").applyInArrow(trimmed_group(_cover(parts, keys)), "bucket int, runs binary"), "runs")
    del both, asked
    discard(answers)
    release(spark)
    return found


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row of docs.

    Null texts count as empty.  Rows with a null doc_id lose nothing and cover nothing, for no id is
    smaller.  Rows that share a doc_id are no earlier documents to each other.  Texts of fewer than LEAST
    bytes hold no string and stay whole.  A text of any length is one row of a bucket.  Other columns are
    ignored.  The result is written to the shared folder; texts and intermediate rows are deleted.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = data_parts(rows, "text", PART_BYTES)
    keys = even_keys(parts)
    home = F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")
    bucket = home if keys == list(range(parts)) else F.element_at(F.array(*map(F.lit, keys)), home + 1)
    named = rows.filter("doc_id IS NOT NULL").select(bucket.alias("bucket"), "doc_id", F.xxhash64("text").alias("tkey"), "text")
    texts = dealt(named, parts, "bucket")
    runs = covered_runs(texts, parts, keys)
    done = texts.groupBy("bucket").cogroup(runs.groupBy("bucket")).applyInArrow(trimmed_pair(_finish), _OUT_SQL)
    nameless = rows.filter("doc_id IS NULL").select("text").mapInArrow(trimmed(_whole), _OUT_SQL)
    out = materialize(done.union(nameless), "removed")
    discard(texts, runs)
    return out
